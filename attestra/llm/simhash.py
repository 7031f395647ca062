"""Operator 12: document fingerprints by SimHash, and a search for all fingerprints within a Hamming radius.

A fingerprint has 256 bits. The terms of a text are its words and its pairs of neighbouring words (attestra.llm.words); each is
hashed, and each bit of the hash is a vote for or against that bit of the fingerprint, weighted by the kind of term and by
1 + ln(times it stands in the text). Votes are counted in numpy for many texts at once: for each byte of the hashes the
weights are summed by the byte's value, and a fixed table turns these sums into votes for its eight bits.

Search: bits are permuted so that a choice of blocks leads, one table for each choice, and fingerprints that agree in the leading
blocks meet. Of radius + k blocks at least k agree, so no pair within the radius is missed; k grows with the
number of fingerprints, so that the leading bits tell that many apart. Each pair is counted in the first table only in which it meets.
Members of a group are compared as matrices of bounded size (attestra.llm.blocks), never as written pairs; equal
fingerprints are one member.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm import blocks
from attestra.llm.shingles import in_chunks, mixed, shingle_hashes, word_hashes
from attestra.llm.work import map_arrow, stored

BITS, RADIUS = 256, 7
#: Kinds of terms by their number of words, and the weight of each.
KINDS = {1: 1.0, 2: 1.0}
#: Texts that are counted at once.
TEXTS = 512
_SEEDS = np.random.default_rng(20_250_301).integers(1, 2**63, BITS // 64, dtype=np.uint64)
#: The votes of a byte value for its eight bits, the highest first.
_VOTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """UTF-8 texts -> a row of BITS / 8 bytes for each. A text without words has no votes and the fingerprint of zeros."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for begin, run in in_chunks(texts):
        for a in range(0, len(run), TEXTS):
            own = run[a : a + TEXTS]
            out[begin + a : begin + a + len(own)] = _fingerprints(own)
    return out


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    terms, owners, weights = [], [], []
    for size, weight in KINDS.items():
        hashes, at = word_hashes(texts) if size == 1 else shingle_hashes(texts, size)
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        key = mixed(hashes + owner.astype(np.uint64) * _SEEDS[0])  # of a term in a text
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(key)])
        terms.append(mixed(hashes[order[first]] ^ np.uint64(size)))
        owners.append(owner[order[first]])
        weights.append(weight * (1 + np.log(times)))
    h, o, w = (np.concatenate(x) for x in (terms, owners, weights))
    base = o * 256
    votes = np.empty((len(texts), BITS), np.float32)
    for k, seed in enumerate(_SEEDS):
        raw = mixed(h ^ seed).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            sums = np.bincount(base + raw[:, j], weights=w, minlength=256 * len(texts)).astype(np.float32).reshape(-1, 256)
            votes[:, 64 * k + 8 * j : 64 * k + 8 * j + 8] = sums @ _VOTES
    return np.packbits(votes > 0, axis=1)


def likeness(a: Column, b: Column) -> Column:
    """The share of bits that two hex fingerprints have in common."""
    differ = [F.bit_count(F.conv(F.substring(a, k, 12), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, k, 12), 16, 10).cast("long"))) for k in range(1, BITS // 4 + 1, 12)]
    return 1 - sum(differ[1:], differ[0]) / F.lit(float(BITS))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """docs(doc_id, text) -> (part, pos, guest, doc_id, text, next_text), the next by ascending doc_id, ties by text.

    The table is cut into ranges of doc_id by quantiles, and each range again by its own, so that the cuts a row is compared with
    are few, however many parts there are. A part also gets, as guests, the first rows of the part that follows (the first one
    follows the last), so the next row of its last row is at hand, and no task needs more than its parts.
    """
    known = docs.where("doc_id IS NOT NULL")
    ranges = math.ceil(math.sqrt(parts))
    marks = [k / ranges for k in range(1, ranges)] or [0.5]
    quantiles = F.array_distinct(F.percentile_approx("doc_id", marks, 10_000))
    cuts = known.agg(quantiles).first()[0] or []
    upto = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("doc_id")))
    within = upto(F.array(*map(F.lit, cuts))) if cuts else F.lit(0)
    inner = stored(known.groupBy(within.alias("_range")).agg(quantiles.alias("_cuts")), "cuts")  # a row for each range
    parted = known.withColumn("_range", within).join(F.broadcast(inner), "_range").withColumn("part", F.col("_range") * ranges + upto(F.col("_cuts"))).select("part", "doc_id", "text")
    firsts = stored(parted.groupBy("part").agg(F.min("doc_id").alias("doc_id")), "firsts")  # a row for each part
    begins = firsts.orderBy("part").collect()
    before = docs.sparkSession.createDataFrame([(r["doc_id"], begins[k - 1]["part"]) for k, r in enumerate(begins)], "doc_id long, _before int")
    own, guest = F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("_before").alias("part"), F.lit(True).alias("guest"))
    marked = parted.join(F.broadcast(before), "doc_id", "left")
    dealt = marked.withColumn("_at", F.explode(F.when(F.col("_before").isNotNull(), F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("part").orderBy("guest", "doc_id", "text")
    rows = dealt.select("_at.part", "_at.guest", "doc_id", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("pos", F.row_number().over(order))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half (rounded down) replaced by as many of the first code points of the next document, or all
    it has. The next document is the next row by ascending doc_id, ties by text; the first one follows the last, and a
    single row follows itself. Null texts are empty; a text without words has a fingerprint of zeros, and two such are alike. Rows with null doc_id have no
    place in the order: their next document is empty, and they are no one's. Repeated rows each get their row and follow one
    another; those of one doc_id meet in a task, which sorts on disk. Other columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = with_next(texts, 4 * partitions)
    homeless = texts.where("doc_id IS NULL").select(F.lit(-1).alias("part"), F.lit(False).alias("guest"), "doc_id", "text", F.lit("").alias("next_text"), F.lit(0).alias("pos"))
    rows = ordered.unionByName(homeless)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    told = rows.select("part", "pos", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", F.when(~F.col("guest"), edited).alias("edited"))
    schema = "part int, pos int, guest boolean, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string"
    made = stored(map_arrow(told.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select("part", "pos", "guest", "doc_id", "n_chars", "edited_sha256", "text", "edited"), _marked, schema), "fingerprints")
    follows = F.lead("fingerprint").over(Window.partitionBy("part").orderBy("pos"))
    nexts = made.where("part >= 0").withColumn("_next", follows).unionByName(made.where("part < 0").withColumn("_next", F.lit("0" * (BITS // 4))))
    return nexts.where("NOT guest").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )


def _marked(batches):
    for batch in batches:
        columns = list(batch.columns[:6])
        for k in (6, 7):
            texts = [v.as_py().encode("utf-8", "surrogatepass") if v.is_valid else b"" for v in batch.column(k)]
            columns.append(pa.array([row.tobytes().hex() for row in fingerprints(texts)], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=["part", "pos", "guest", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"])


def tables(bits: int, radius: int, rows: int) -> list[tuple[tuple[int, int], ...]]:
    """The choices of blocks (begin, end) that lead in a table: of radius + k blocks each choice of k, with the smallest k whose
    leading bits can tell ``rows`` fingerprints apart."""
    for k in range(1, bits - radius + 1):
        n = radius + k
        cuts = [bits * i // n for i in range(n + 1)]
        if k * (bits // n) >= math.log2(max(2, rows)) or math.comb(n + 1, k + 1) > 256:
            return list(itertools.combinations(list(itertools.pairwise(cuts)), k))
    return [((0, bits),)]


def near(prints: DataFrame, radius: int = RADIUS, most: int = blocks.MOST) -> DataFrame:
    """prints(doc_id, fingerprint, ...) -> its rows with n_near and group_id.

    n_near counts the other rows whose fingerprint is within the radius, group_id is the smallest doc_id reachable over such
    rows. Null fingerprints and ids are near nothing; repeated rows are near each other; an empty table gives an empty result.
    """
    spark = prints.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.withColumn("_p", F.when(F.col("doc_id").isNotNull(), F.unhex("fingerprint")))
    kinds = rows.where("_p IS NOT NULL").groupBy(F.col("_p").alias("p")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    kinds = stored(kinds.withColumn("id", F.monotonically_increasing_id()), "kinds")
    choices = tables(BITS, radius, kinds.count())

    def led(batches):
        """Each fingerprint once for each table, with a hash of its leading blocks; the payload ends with the table's number."""
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(raw, axis=1)
            for t, choice in enumerate(choices):
                lead = np.packbits(np.concatenate([bits[:, a:b] for a, b in choice], axis=1), axis=1)
                value = [r.tobytes() + t.to_bytes(4, "little") for r in raw]
                yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(raw), t, np.int32)), "lead": pa.array([x.tobytes() for x in lead], pa.binary()), "id": batch.column(1), "copies": batch.column(2), "value": pa.array(value, pa.binary())})

    spread = map_arrow(kinds.select("p", "id", "copies"), led, "t int, lead binary, id long, copies long, value binary")
    spread = spread.select(F.xxhash64("t", "lead").alias("grp"), "id", "copies", "value")
    grouped = stored(blocks.counted(spread, most).join(spread.groupBy("grp").agg(F.count("*").alias("_n")).where("_n > 1").select("grp"), "grp", "left_semi"), "grouped")
    found = stored(blocks.links(blocks.dealt(grouped), "value", _within(radius, choices), partitions), "links")
    judged = stored(kinds.join(blocks.summed(found), "id", "left").select("p", "least", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_near"), F.coalesce("component", "id").alias("c")), "judged")
    groups = judged.groupBy("c").agg(F.min("least").alias("group_id"))
    own = judged.join(groups, "c").select(F.col("p").alias("_p"), "n_near", "group_id")
    return rows.join(own, "_p", "left").select(*prints.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("group_id", "doc_id").alias("group_id"))


def _within(radius: int, choices):
    def linked(values: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
        t = int(raw[0, -4:].copy().view("<u4")[0])
        words = np.ascontiguousarray(raw[:, :-4]).view(np.uint64)
        out = np.zeros((len(values), len(values)), np.int16)
        for k in range(words.shape[1]):
            out += np.bitwise_count(words[:, None, k] ^ words[None, :, k])
        good = out <= radius
        if good.any():
            good &= _first(raw[:, :-4], t, choices)
        return good

    return linked


def _first(raw: np.ndarray, t: int, choices) -> np.ndarray:
    """Which pairs meet in table t and in none before it."""
    bits = np.unpackbits(raw, axis=1)
    alike: dict[tuple[int, int], np.ndarray] = {}

    def same(block):
        if block not in alike:
            lead = np.packbits(bits[:, block[0] : block[1]], axis=1)
            _, kind = np.unique(lead, axis=0, return_inverse=True)
            kind = kind.reshape(-1)
            alike[block] = kind[:, None] == kind[None, :]
        return alike[block]

    def meet(choice):
        out = same(choice[0])
        for block in choice[1:]:
            out = out & same(block)
        return out

    good = meet(choices[t]).copy()
    for choice in choices[:t]:
        good &= ~meet(choice)
    return good


__all__ = ["fingerprinted", "fingerprints", "likeness", "near", "tables", "with_next"]
