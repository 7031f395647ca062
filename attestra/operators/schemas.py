"""Schema validation of loose JSON: errors are rows (field, message), never exceptions.

Documents are VARIANT, which keeps missing, null and wrongly typed apart. Each rule gives a message or null; the rules
of a document are one array that is exploded, so a document's check is one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.gates import ROUTES
from attestra.operators.verification import EVIDENCE, PRECISIONS

#: The enumerations that documents are held to.
DEPTHS, AUDIENCES, CONFIDENCE = ["quick", "standard", "deep"], ["CTO", "engineer", "researcher", "general"], ["high", "medium", "low"]
STATUSES, REASONS = ["pending", "in_progress", "completed", "skipped"], ["source_absent", "source_indirect", "single_source", "tension_unresolved"]


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column, path: str) -> Column:
    """STRING, BIGINT, BOOLEAN, ARRAY, OBJECT, VOID (null) or null where nothing stands."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^([A-Z]+)", 1)


def error(field: Column | str, message: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(message).alias("message")))


def missing(v: Column, name: str) -> Column:
    return error(name, f"missing required field: {name}", kind_of(v, f"$.{name}").isNull())


def typed(v: Column, name: str, kind: str, said: str) -> Column:
    k = kind_of(v, f"$.{name}")
    return error(name, f"expected {said}", k.isNotNull() & (k != kind))


def one_of(v: Column, name: str, valid: list[str]) -> Column:
    return error(name, f"invalid {name}", (kind_of(v, f"$.{name}") == "STRING") & ~at(v, f"$.{name}").isin(valid))


def non_blank(v: Column, name: str) -> Column:
    return error(name, "must not be empty", (kind_of(v, f"$.{name}") == "STRING") & (F.trim(at(v, f"$.{name}")) == ""))


def errors(df: DataFrame, id_column: str, raw: str, rules) -> DataFrame:
    """df(id, raw JSON) -> (id, field, message); text that is no JSON object gives one error."""
    v = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = F.when(is_object, F.array_compact(F.array(*rules(v)))).otherwise(F.array(F.struct(F.lit("$").alias("field"), F.lit("not a JSON object").alias("message"))))
    return df.select(id_column, F.explode(found).alias("e")).select(id_column, "e.field", "e.message")


def scope_rules(v: Column) -> list[Column]:
    """Three required fields, types, three enumerations, directions as strings, an English title beside a topic that isn't ASCII."""
    directions = F.try_variant_get(v, "$.search_directions", "array<variant>")
    strange = F.exists(directions, lambda d: ~F.coalesce(F.schema_of_variant(d) == "STRING", F.lit(False)))
    foreign = F.coalesce(at(v, "$.topic"), F.lit("")).rlike(r"[^\x00-\x7F]") & (F.trim(F.coalesce(at(v, "$.english_title"), F.lit(""))) == "")
    return [
        *[missing(v, f) for f in ("topic", "goal_type", "depth")],
        *[typed(v, f, "STRING", "str") for f in ("topic", "goal_type", "depth", "audience", "scope_description")],
        one_of(v, "goal_type", list(ROUTES)), one_of(v, "depth", DEPTHS), one_of(v, "audience", AUDIENCES),
        typed(v, "search_directions", "ARRAY", "list"), error("search_directions", "expected list of str", strange),
        non_blank(v, "topic"), error("english_title", "required for a topic that is not ASCII", foreign),
    ]


def collected_rules(v: Column) -> list[Column]:
    """url, title and snippet as strings, an integer tier, optional strings that aren't blank (a null vendor is fine)."""
    return [
        *[missing(v, f) for f in ("url", "title", "snippet")], *[typed(v, f, "STRING", "str") for f in ("url", "title", "snippet", "source_file", "direction")],
        typed(v, "source_tier", "BIGINT", "int"), *[non_blank(v, f) for f in ("source_file", "direction", "vendor_affiliation")],
    ]


def claim_rules(v: Column) -> list[Column]:
    return [
        missing(v, "summary"), missing(v, "sources"), typed(v, "summary", "STRING", "str"), typed(v, "sources", "ARRAY", "list"),
        one_of(v, "evidence_type", EVIDENCE), one_of(v, "confidence", CONFIDENCE), one_of(v, "precision", PRECISIONS),
        error("sources", "must not be empty", F.size(F.try_variant_get(v, "$.sources", "array<variant>")) == 0),
    ]


def section_rules(v: Column) -> list[Column]:
    return [*[missing(v, f) for f in ("id", "title", "content")], *[typed(v, f, "STRING", "str") for f in ("id", "title", "content", "depth_strategy")], *[typed(v, f, "ARRAY", "list") for f in ("claims", "key_insights", "tensions")], typed(v, "order", "BIGINT", "int")]


def target_rules(v: Column) -> list[Column]:
    return [*[missing(v, f) for f in ("id", "trigger_reason", "status")], one_of(v, "status", STATUSES), one_of(v, "trigger_reason", REASONS), typed(v, "new_sources", "ARRAY", "list"), typed(v, "target_tiers", "ARRAY", "list")]


def analysis_errors(df: DataFrame, id_column: str, raw: str) -> DataFrame:
    """Errors of whole analyses with indexed paths: sections[i] and sections[i].claims[j]."""
    v = F.try_parse_json(raw)
    sections = F.try_variant_get(v, "$.sections", "array<variant>")
    top = errors(df, id_column, raw, lambda x: [missing(x, "sections"), typed(x, "sections", "ARRAY", "list"), error("sections", "must not be empty", F.size(F.try_variant_get(x, "$.sections", "array<variant>")) == 0)])
    each = df.select(id_column, F.posexplode(sections).alias("i", "s"))
    of_sections = each.select(id_column, "i", F.explode(F.array_compact(F.array(*section_rules(F.col("s"))))).alias("e"))
    claims = each.select(id_column, "i", F.posexplode(F.try_variant_get(F.col("s"), "$.claims", "array<variant>")).alias("j", "c"))
    of_claims = claims.select(id_column, "i", "j", F.explode(F.array_compact(F.array(*claim_rules(F.col("c"))))).alias("e"))
    return (
        top.unionByName(of_sections.select(id_column, F.format_string("sections[%d].%s", "i", "e.field").alias("field"), "e.message"))
        .unionByName(of_claims.select(id_column, F.format_string("sections[%d].claims[%d].%s", "i", "j", "e.field").alias("field"), "e.message"))
    )
