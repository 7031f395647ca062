"""Operator 6: benchmark decontamination with a broadcast hash set of normalised test n-grams.

A test window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. The hash set
holds every window under its anchor, its longest word. It is broadcast once, and the words of all documents probe it in one
scan; only where an anchor stands are the windows filed there compared word by word with the words around it, so no window
of the documents is ever built or shuffled, and what moves on is one row for each document and each verified hit.

Only DataFrame functions are used. The set is broadcast while its windows take at most ``max_bytes``; larger test sets are
dealt by hash into parts of about that size, with a scan for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.words import WORD, words
from attestra.llm.work import few, stored

SIZE, MAX_BYTES, CHUNK = 10, 64 * 2**20, 256


def test_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """items(item_id, text) -> distinct (item_id, gram, length, anchor, before): before = words ahead of the anchor."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    grams = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("gram")).distinct()
    longest = F.array_max(F.transform("gram", lambda x: F.length(x)))
    at = F.array_position(F.transform("gram", lambda x: F.length(x)), longest).cast("int")
    return grams.select("item_id", "gram", F.size("gram").alias("length"), F.element_at("gram", at).alias("anchor"), (at - 1).alias("before"))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs(doc_id, text) x items(item_id, text) -> doc_id, n_words, n_hit, n_items, item_ids, spans, for each row of docs.

    n_hit counts the words inside any occurrence of a window, item_ids the items (as sorted strings) with occurring
    windows, spans the hit word places (start from 1, length). Null or empty texts have no words and no hits. Repeated
    rows each keep their row. With no items, or none with words, nothing is hit. Very long texts are scanned whole. Other
    columns of either table are ignored.
    """
    return _found(_numbered(docs.select("doc_id", "text")), items, size, max_bytes).drop("_row")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written, so that whatever reads it, again or after a loss, finds the same numbers."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _found(docs: DataFrame, items: DataFrame, size: int, max_bytes: int) -> DataFrame:
    """contamination() of docs(_row, doc_id, text), with _row."""
    windows = stored(test_windows(items.select("item_id", "text"), size), "windows")
    total = windows.agg(F.sum(32 + F.length(F.array_join("gram", " ")) + 16 * F.size("gram"))).first()[0] or 0
    parts = int(total // max_bytes) + 1
    base = docs.select("_row", "doc_id", words(F.col("text")).alias("_w"))
    scans = [_scan(base, windows.where(F.pmod(F.xxhash64("gram", "item_id"), F.lit(parts)) == k), size) for k in range(parts)]
    return (
        reduce(DataFrame.unionByName, scans)
        .groupBy("_row", "doc_id", "n_words")
        .agg(F.collect_set("item_id").alias("item_ids"), F.collect_set(F.struct("start", "length")).alias("spans"))
        .withColumn("spans", F.sort_array(F.filter("spans", lambda s: s["start"].isNotNull())))
        .withColumn("item_ids", F.sort_array("item_ids"))
        .withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.transform("spans", _places)))).cast("long"))
        .withColumn("n_items", F.size("item_ids").cast("long"))
    )


def _places(span: Column) -> Column:
    return F.sequence(span["start"], span["start"] + span["length"] - 1)


def _scan(base: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """One row without item for each document, and one for each occurrence of a window.

    Documents are cut into chunks of CHUNK words with size - 1 more at either end, so that what goes along with a word is of
    bounded length however long its document is.
    """
    filed = windows.groupBy("anchor").agg(F.collect_list(F.struct("item_id", "gram", "length", "before")).alias("filed"))
    n, more = F.size("_w"), size - 1
    firsts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(CHUNK))  # words before each chunk
    chunk = lambda i: F.struct(i.alias("first"), F.slice("_w", F.greatest(i - more + 1, F.lit(1)), CHUNK + more + F.least(i, F.lit(more))).alias("part"))
    chunks = base.select("_row", "doc_id", n.cast("long").alias("n_words"), F.explode(F.transform(firsts, chunk)).alias("c"))
    chunks = chunks.select("_row", "doc_id", "n_words", "c.first", "c.part", F.least("c.first", F.lit(more)).alias("_lead"))
    # a null before the words of the first chunk stands for the document itself
    each = F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.slice("part", F.col("_lead") + 1, F.lit(CHUNK)))).alias("_at", "_word")
    probed = chunks.select("_row", "doc_id", "n_words", "first", "part", "_lead", each)
    joined = probed.join(F.broadcast(filed), F.col("_word") == F.col("anchor"), "left").where("(_at = 0 AND first = 0) OR anchor IS NOT NULL")  # of at most about max_bytes
    start, place = F.col("first") + F.col("_at"), F.col("_lead") + F.col("_at")

    def occurs(x: Column) -> Column:
        ahead = place - x["before"]
        return (ahead >= 1) & (F.slice("part", F.greatest(ahead, F.lit(1)), x["length"]) == x["gram"])

    here = F.transform(
        F.filter(F.coalesce("filed", F.array().cast(filed.schema["filed"].dataType)), occurs),
        lambda x: F.struct(x["item_id"].cast("string").alias("item_id"), (start - x["before"]).alias("start"), x["length"].alias("length")),
    )
    none = F.struct(F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"))
    return (
        joined.select("_row", "doc_id", "n_words", F.when(F.col("_at") == 0, F.array(none)).otherwise(here).alias("here"))
        .select("_row", "doc_id", "n_words", F.explode("here").alias("h"))
        .select("_row", "doc_id", "n_words", "h.item_id", "h.start", "h.length")
    )


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE, remove: str = "documents", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs without contaminated documents, or with the hit words cut out of their texts (remove='spans').

    Columns stay those of docs, whatever their names. Rows are judged one by one: null ids, repeated ids and repeated rows
    each have their verdict, null texts stay.
    """
    rows = _numbered(docs.select(F.struct(*docs.columns).alias("_doc"))).select("_row", "_doc", "_doc.doc_id", "_doc.text")
    found = _found(rows, items, size, max_bytes).where("n_hit > 0")
    if remove == "documents":
        gone = few(stored(found.select("_row"), "gone"))
        return rows.select("_row", "_doc").join(gone, "_row", "left_anti").select("_doc.*")
    spans = found.select("_row", F.array_distinct(F.flatten(F.transform("spans", _places))).alias("_hit"))
    pattern = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # the words of the text as written, capitals too
    gaps, own = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    # the words by place, the hit ones marked: sorted, a mark stands right before its word
    placed = F.sort_array(F.concat(F.transform(F.col("_hit"), lambda p: F.struct(p.alias("p"), F.lit(0).alias("k"))), F.transform(F.sequence(F.lit(1), F.size(own)), lambda p: F.struct(p.alias("p"), F.lit(1).alias("k")))))
    marks = F.transform(F.filter(F.transform("_placed", lambda x, i: F.struct(x.alias("x"), (F.get(F.col("_placed"), i - 1)["p"] == x["p"]).alias("hit"))), lambda x: x["x"]["k"] == 1), lambda x: F.coalesce(x["hit"], F.lit(False)))
    kept = F.transform(own, lambda w, i: F.concat(F.when(F.get(F.col("_marks"), i), F.lit("")).otherwise(w), F.get(F.col("_gaps"), i + 1)))
    cut = F.concat(F.get("_gaps", F.lit(0)), F.array_join(kept, ""))
    joined = rows.join(spans, "_row", "left").withColumn("_gaps", gaps).withColumn("_placed", F.when(F.col("_hit").isNotNull(), placed)).withColumn("_marks", marks)
    return joined.select(F.col("_doc").withField("text", F.when(F.col("_hit").isNotNull(), cut).otherwise(F.col("text"))).alias("_doc")).select("_doc.*")
