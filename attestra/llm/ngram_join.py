"""Operator 5: n-gram Jaccard join with a MinHash LSH forest, then exact verification.

Texts with equal shingle sets are one class from the start, whose smallest doc_id stands for it, so copies cost one row
each. A class has a label of ``depth`` MinHash bytes in each of ``trees`` tries.

1. Forest: the (trie, label) rows are sorted, by range, so that a trie's prefix of any length is a run of rows. Each row is
   tied to the one before it with the length of their common prefix: one sort holds the nodes of every depth, a node of n
   classes costs n - 1 ties, and a common prefix may spread over many tasks.
2. How far prefixes are shortened: stated query rows (doc_id divisible by ``audit_every``) meet all rows in an exact search,
   which tells how long a prefix each true pair shares in its best trie. Prefixes start at full length and are shortened
   while the recall of the queries is under the target; without enough true pairs to tell, till the theory of
   MinHash promises it at the threshold.
3. Ties at that depth are checked by the share of equal MinHash bytes, within a margin of the threshold, so that chance
   meetings don't join groups. Between two similar classes of a node others may stand that are like one of them only, so in
   nodes that still hold several groups every pair of classes of different groups is checked in the same way. What remains
   joins classes into candidate groups, inside which every pair is verified on its whole shingle sets
   (attestra.llm.blocks); no pair is written out.
4. Audit: the links found for the queries are compared with those of the exact search. Under the target, prefixes are
   shortened further, and at last the margin is doubled; if even that falls short, it is an error, never a partial result.

Where no query has a link there is nothing to measure, and the recall told is 1: the length of prefixes then rests on theory alone.
"""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import blocks
from attestra.llm.graph import components
from attestra.llm.shingles import SIZE, in_chunks, shingle_hashes
from attestra.llm.work import few, map_arrow, shared, stored, without

THRESHOLD, TREES, DEPTH, LEAST_DEPTH, RECALL = 0.8, 32, 10, 4, 0.999
#: What the share of equal MinHash bytes may be under the threshold: four times its scatter for 320 of them.
MARGIN = 0.09
#: Every how manieth doc_id is a query of the exact search, and the bytes of their shingles that are broadcast at a time.
AUDIT_EVERY, BLOCK_BYTES = 100, 32 * 2**20
_log = logging.getLogger(__name__)


class Hasher:
    """MinHash bytes of shingle sets: ``trees`` labels of ``depth`` bytes each."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(trees)
        self.trees, self.depth = trees, depth
        self.mult = rng.integers(1, 2**31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)

    def __call__(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """hashes of all sets, one after the other from starts on (none is empty) -> a row of bytes for each."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(starts), self.trees * self.depth), np.uint8)
        y = np.empty_like(x)
        for k in range(out.shape[1]):
            np.multiply(x, self.mult[k], out=y)
            y += self.plus[k]
            out[:, k] = (np.minimum.reduceat(y, starts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        return out


def predicted(threshold: float, trees: int, depth: int) -> float:
    """The chance that a pair at the threshold shares a prefix of that length in some trie."""
    return 1 - (1 - threshold**depth) ** trees


def signatures(docs: DataFrame, size: int = SIZE, trees: int = TREES, depth: int = DEPTH, shingles: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, class_hash, labels): the shingle set's digest and its MinHash bytes; null without words.

    shingles adds the sorted set itself, as bytes.
    """
    hasher = Hasher(trees, depth)

    def sign(batches):
        for batch in batches:
            for begin, run in in_chunks(_texts(batch.column(1))):
                hashes, at = shingle_hashes(run, size)
                some = np.flatnonzero(np.diff(at) > 0)
                out = {k: [None] * len(run) for k in ("class_hash", "labels", "shingles")}
                for k in some:
                    own = np.unique(hashes[at[k] : at[k + 1]]).tobytes()
                    out["class_hash"][k] = hashlib.md5(own).digest()
                    out["shingles"][k] = own if shingles else None
                if len(some):
                    for k, label in zip(some, hasher(hashes, at[some]), strict=True):
                        out["labels"][k] = label.tobytes()
                made = {"doc_id": batch.column(0).slice(begin, len(run)), **{k: pa.array(v, pa.binary()) for k, v in out.items()}}
                yield pa.RecordBatch.from_pydict(made if shingles else {k: v for k, v in made.items() if k != "shingles"})

    schema = "doc_id long, class_hash binary, labels binary" + (", shingles binary" if shingles else "")
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), sign, schema)


def _texts(column):
    return (v.as_buffer().to_pybytes() if v.is_valid else None for v in column.cast(pa.binary()))


def forest_ties(classes: DataFrame, trees: int, depth: int, least: int, partitions: int) -> DataFrame:
    """classes(rep, labels) -> (a, b, prefix): neighbours in some sorted trie, a < b, with the longest prefix of at least least bytes."""
    place = lambda t: F.struct(t.alias("tree"), F.substring("labels", t * depth + 1, F.lit(depth)).alias("label"))
    each = classes.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), place)).alias("p")).select("p.tree", "p.label", "rep")
    ranged = each.repartitionByRange(partitions, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")

    def neighbours(batches):
        """Ties inside the task, and its first and last row, which may have neighbours in other tasks."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, rep = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            label = _fixed(batch.column(1), depth)
            if last is None:
                yield _rows([(0, int(rep[0]), 0, int(tree[0]), label[0].tobytes())])
            else:
                tree, rep, label = np.r_[last[0], tree], np.r_[last[1], rep], np.vstack([last[2], label])
            same = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            k = np.flatnonzero((same >= least) & (rep[1:] != rep[:-1]))
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(np.minimum(rep[k], rep[k + 1])), "b": pa.array(np.maximum(rep[k], rep[k + 1])), "prefix": pa.array(same[k].astype(np.int32)),
                "tree": pa.nulls(len(k), pa.int32()), "label": pa.nulls(len(k), pa.binary()),
            })
            last = tree[-1:], rep[-1:], label[-1:]
        if last is not None:
            yield _rows([(1, int(last[1][0]), 0, int(last[0][0]), last[2][0].tobytes())])

    found = stored(map_arrow(ranged, neighbours, "a long, b long, prefix int, tree int, label binary"), "neighbours")
    edges = found.where("tree is not null").select("tree", "label", F.col("b").alias("rep"), F.col("a").alias("side")).collect()  # two a task
    edges = sorted({(r["tree"], bytes(r["label"]), r["rep"]) for r in edges})
    between = []
    for (s, x, a), (t, y, b) in zip(edges, edges[1:], strict=False):
        if s == t and a != b:
            same = next((k for k in range(depth) if x[k] != y[k]), depth)
            between += [(min(a, b), max(a, b), same)] * (same >= least)
    ties = found.where("tree is null").select("a", "b", "prefix")
    if between:
        ties = ties.unionByName(classes.sparkSession.createDataFrame(between, "a long, b long, prefix int"))
    return ties.groupBy("a", "b").agg(F.max("prefix").alias("prefix"))


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column without nulls whose values all have that width, as a matrix of bytes."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + len(column) * width].reshape(-1, width)


def _rows(rows) -> pa.RecordBatch:
    a, b, prefix, tree, label = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "prefix": pa.array(prefix, pa.int32()), "tree": pa.array(tree, pa.int32()), "label": pa.array(label, pa.binary())})


def likely(ties: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The ties (a, b) whose ends agree in at least that share of their MinHash bytes."""
    own = lambda name: classes.select(F.col("rep").alias(name), F.col("labels").alias(f"l{name}"))
    both = ties.select("a", "b").join(own("a"), "a").join(own("b"), "b").select("a", "b", "la", "lb")

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_fixed(batch.column(k), len(batch.column(k)[0].as_py())) for k in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(2)], names=["a", "b"])

    return map_arrow(both, check, "a long, b long")


def node_ties(ties: DataFrame, classes: DataFrame, groups: DataFrame, trees: int, depth: int, prefix: int, least: float, most: int, partitions: int) -> DataFrame:
    """(a, b): ties that join the classes of different groups(id, component) which meet in a node of that prefix and agree in
    at least that share of their MinHash bytes, for classes(rep, labels) and their forest_ties of at least that prefix.

    A node is a run of the sort, so one of several groups has a tie between two of them, which tells the nodes to look at.
    A node's groups of more than most classes have blocks of their own, the others share blocks; a pair of blocks is a matrix
    (attestra.llm.blocks), and blocks of one and the same group are in none together.
    """
    named = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp"), "labels")
    own = lambda name: named.select(F.col("rep").alias(name), F.col("comp").alias(f"c{name}"), F.col("labels").alias(f"l{name}"))
    part = lambda labels, t: F.substring(labels, t * depth + 1, F.lit(prefix))
    node = lambda labels, t: F.xxhash64(t, part(labels, t))
    all_trees = F.sequence(F.lit(0), F.lit(trees - 1))
    across = ties.select("a", "b").join(own("a"), "a").join(own("b"), "b").where("ca <> cb")
    nodes = across.select(F.explode(F.transform(F.filter(all_trees, lambda t: part("la", t) == part("lb", t)), lambda t: node("la", t))).alias("grp")).distinct()
    nodes = few(stored(nodes, "nodes"))
    each = named.select("rep", "comp", "labels", F.explode(F.transform(all_trees, lambda t: node("labels", t))).alias("grp"))
    members = stored(each.join(nodes, "grp", "left_semi").select("grp", "rep", "comp"), "members")
    sizes = members.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= most).groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(most)).alias("parts"))
    sizes = sizes.join(small, "grp", "left").select("grp", "comp", F.when(F.col("n") > most, F.col("comp")).alias("large"), F.when(F.col("n") > most, F.ceil(F.col("n") / F.lit(most))).otherwise(F.col("parts")).alias("parts"))
    block = F.xxhash64("large", F.pmod(F.xxhash64(F.when(F.col("large").isNull(), F.col("comp")).otherwise(F.col("rep")), F.lit("block")), F.col("parts")))
    dealt = stored(members.join(sizes, ["grp", "comp"]).select("grp", "rep", "comp", "large", block.alias("own")), "members")
    found = dealt.select("grp", "large", "own").distinct()
    other = found.select("grp", F.col("large").alias("theirs"), F.col("own").alias("bj"))
    pairs = found.withColumnRenamed("own", "bi").join(other, "grp").where("bi <= bj and (large is null or theirs is null or large <> theirs)")
    pairs = pairs.select("grp", "bi", "bj", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("own"))
    rows = dealt.select("grp", "own", "rep", "comp").join(pairs, ["grp", "own"]).join(classes.select("rep", "labels"), "rep")
    rows = rows.select("grp", "bi", "bj", "own", F.col("rep").alias("id"), F.lit(1).cast("long").alias("copies"), F.concat(F.unhex(F.lpad(F.hex("comp"), 16, "0")), "labels").alias("value"))
    tied = blocks.links(rows, "value", linked_by_bytes(least), partitions).where("id <> tied")
    return tied.select(F.col("id").alias("a"), F.col("tied").alias("b")).distinct()


def linked_by_bytes(least: float):
    """Values of 8 bytes of a group and MinHash bytes -> the boolean matrix of those of different groups that agree in at least that share of bytes."""

    def linked(values: list[bytes]) -> np.ndarray:
        rows = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
        kinds, comp = np.unique(np.ascontiguousarray(rows[:, :8]).view(np.int64)[:, 0], return_inverse=True)
        order = np.argsort(comp, kind="stable")
        labels, ends = rows[order, 8:], np.searchsorted(comp[order], np.arange(len(kinds)), "right")
        mat = np.zeros((len(values), len(values)), bool)
        for k, end in enumerate(ends[comp[order]]):  # the rest are of groups to come
            near = order[end:][(labels[end:] == labels[k]).mean(axis=1) >= least]
            mat[order[k], near] = mat[near, order[k]] = True
        return mat

    return linked


def _ask(docs: DataFrame, every: int) -> Column:
    """Which rows are queries: doc_id divisible by every; where none is, one in so many by hash, or else all (of few)."""
    for picked in (F.col("doc_id") % every == 0, F.pmod(F.xxhash64("doc_id", F.lit("ask")), F.lit(every)) == 0):
        if not docs.where(picked).isEmpty():
            return picked
    return F.lit(True)


def exact_search(docs: DataFrame, threshold: float, size: int, trees: int, depth: int, every: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The queries against all rows of docs(doc_id, text): (class_hash, prefix, n), n rows of other classes being linked
    with the query class whose best trie shares a prefix of that length.

    Queries are broadcast block by block. A text is compared with those that have one of the least shingles, in the order of
    their hashes, in common with it: at the threshold, two sets share one of their first (1 - threshold) n + 1.
    """
    asked = stored(signatures(docs.where("doc_id is not null").where(_ask(docs.select("doc_id").where("doc_id is not null"), every)), size, trees, depth, shingles=True).where("class_hash is not null"), "asked")
    asked = stored(asked.groupBy("class_hash").agg(F.first("labels").alias("labels"), F.first("shingles").alias("shingles")), "asked")
    total = asked.agg(F.sum(F.length("shingles").cast("long"))).first()[0] or 0
    parts = total // block_bytes + 1
    out = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("class_hash"), F.lit(parts)) == part).collect()  # about block_bytes
        if rows:
            found = stored(_searched(docs, rows, threshold, size, trees, depth), "truth")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "class_hash binary, prefix int, n long")
    return out.groupBy("class_hash", "prefix").agg(F.sum("n").alias("n"))


def _firsts(n: int, threshold: float) -> int:
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def _searched(docs: DataFrame, rows: list, threshold: float, size: int, trees: int, depth: int) -> DataFrame:
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    heads = [s[: _firsts(len(s), threshold)] for s in sets]
    value, owner = np.concatenate(heads), np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    order = np.argsort(value, kind="stable")
    labels = np.frombuffer(b"".join(bytes(r["labels"]) for r in rows), np.uint8).reshape(len(rows), trees, depth)
    names = [bytes(r["class_hash"]) for r in rows]
    told = shared(docs.sparkSession, (sets, sizes, value[order], owner[order], labels, names))

    def search(batches):
        sets, sizes, value, owner, labels, names = told.value
        hasher, counts = Hasher(trees, depth), np.zeros((len(sets), depth + 1), np.int64)
        for batch in batches:
            for _, run in in_chunks(_texts(batch.column(0))):
                hashes, at = shingle_hashes(run, size)
                for k in np.flatnonzero(np.diff(at) > 0):
                    own = np.unique(hashes[at[k] : at[k + 1]])
                    head = own[: _firsts(len(own), threshold)]
                    lo, hi = np.searchsorted(value, head), np.searchsorted(value, head, "right")
                    if not (hi > lo).any():
                        continue
                    near = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo, hi, strict=True) if b > a]))
                    near = near[(sizes[near] >= threshold * len(own) - 1e-9) & (len(own) >= threshold * sizes[near] - 1e-9)]
                    if not len(near):
                        continue
                    theirs = np.concatenate([sets[q] for q in near])
                    place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                    common = np.add.reduceat(own[place] == theirs, np.r_[0, np.cumsum(sizes[near])[:-1]])
                    union = len(own) + sizes[near] - common
                    near = near[(common >= threshold * union - 1e-9) & (common < union)]
                    if len(near):
                        label = hasher(own, np.array([0])).reshape(1, trees, depth)
                        prefix = np.cumprod(labels[near] == label, axis=2).sum(axis=2).max(axis=1)
                        np.add.at(counts, (near, prefix), 1)
        q, prefix = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"class_hash": pa.array([names[k] for k in q], pa.binary()), "prefix": pa.array(prefix.astype(np.int32)), "n": pa.array(counts[q, prefix])})

    found = map_arrow(docs.where("doc_id is not null").select("text"), search, "class_hash binary, prefix int, n long")
    return found.groupBy("class_hash", "prefix").agg(F.sum("n").alias("n"))


def recalls(truth: DataFrame, depth: int) -> tuple[list[float], int]:
    """truth from exact_search -> the recall of the queries at each prefix length from 0 to depth, and how many have links.

    The recall is the lower of the share of all their links and the mean over queries of each one's share.
    """
    each = truth.groupBy("class_hash").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("prefix") >= d, F.col("n")).otherwise(0)).alias(f"d{d}") for d in range(depth + 1)])
    r = each.agg(F.count("*").alias("queries"), F.sum("n").alias("n"), *[f for d in range(depth + 1) for f in (F.sum(f"d{d}").alias(f"s{d}"), F.avg(F.col(f"d{d}") / F.col("n")).alias(f"m{d}"))]).first()
    if not r["queries"]:
        return [1.0] * (depth + 1), 0
    return [min(r[f"s{d}"] / r["n"], r[f"m{d}"]) for d in range(depth + 1)], r["queries"]


def prefix_length(measured: list[float], queries: int, threshold: float, trees: int, recall: float, least: int) -> int:
    """The longest prefix that has the recall: as measured, and, if the queries are too few to tell, as predicted too."""
    for d in range(len(measured) - 1, least, -1):
        enough = queries >= 3 / (1 - recall) if recall < 1 else False  # the rule of three
        if measured[d] >= recall and (enough or predicted(threshold, trees, d) >= recall):
            return d
    return least


def linked_by_jaccard(threshold: float, size: int = SIZE, columns: int = 16_384):
    """UTF-8 texts -> the boolean matrix of those whose shingle sets have at least that Jaccard similarity."""

    def linked(texts: list[bytes]) -> np.ndarray:
        n = len(texts)
        which, values = [], []
        for begin, run in in_chunks(texts):
            hashes, at = shingle_hashes(run, size)
            for k in range(len(run)):
                own = np.unique(hashes[at[k] : at[k + 1]])
                which.append(np.full(len(own), begin + k))
                values.append(own)
        which, values = np.concatenate(which), np.concatenate(values)
        sizes = np.bincount(which, minlength=n)
        kinds, column, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[column] > 1  # a shingle of one text is in no intersection
        which, column = which[shared], column[shared]
        column = np.unique(column, return_inverse=True)[1] if len(column) else column
        order = np.argsort(column, kind="stable")
        which, column = which[order], column[order]
        common = np.zeros((n, n), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        for a in range(0, width, columns):
            lo, hi = np.searchsorted(column, [a, a + columns])
            part = np.zeros((n, min(columns, width - a)), np.float32)
            part[which[lo:hi], column[lo:hi] - a] = 1
            common += part @ part.T
        union = sizes[:, None] + sizes[None, :] - common.astype(np.float64)
        return (common >= threshold * union - 1e-9) & (common > 0)

    return linked


def ngram_join(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, most: int = blocks.MOST, audit_every: int = AUDIT_EVERY
) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, class_id, n_links) for each row.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least threshold. class_id is the
    smallest doc_id reachable over links, n_links the number of other rows that are linked directly, copies included.
    Null texts, texts without words and rows with null doc_id are linked with nothing. Repeated rows are copies of each
    other; a doc_id is taken to identify a text. Other columns are ignored; an empty table gives an empty result. Texts are
    used whole. The exact search costs the rows times the queries, so audit_every is to rise with very large tables.
    RuntimeError if the audited recall stays under the target.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = signatures(docs, size, trees, depth)
    signed = stored(signed.withColumn("class_hash", F.when(F.col("doc_id").isNotNull(), F.col("class_hash"))), "signatures")
    classes = signed.where("class_hash is not null").groupBy("class_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    classes = stored(classes, "classes")
    truth = stored(exact_search(docs.select("doc_id", "text"), threshold, size, trees, depth, audit_every), "truth")
    measured, queries = recalls(truth, depth)
    ties = stored(forest_ties(classes, trees, depth, LEAST_DEPTH, partitions), "ties")
    first = prefix_length(measured, queries, threshold, trees, recall, LEAST_DEPTH)
    for d, margin in [*((d, MARGIN) for d in range(first, LEAST_DEPTH - 1, -1)), (LEAST_DEPTH, 2 * MARGIN)]:
        met = ties.where(F.col("prefix") >= d)
        groups = stored(components(stored(likely(met, classes, threshold - margin), "edges")), "groups")
        more = stored(node_ties(met, classes, groups, trees, depth, d, threshold - margin, most, partitions), "edges")
        if not more.isEmpty():
            groups = stored(components(more.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b")))), "groups")
        judged = stored(_verified(docs, classes, groups, threshold, size, most, partitions), "judged")
        found = _audited(truth, judged)
        _log.info("prefixes of %d: audited recall %.5f over %d queries", d, found, queries)
        if found >= recall:
            break
    else:
        raise RuntimeError(f"audited recall is {found:.4f} with prefixes of {LEAST_DEPTH}, under {recall}")
    return signed.select("doc_id", "class_hash").join(judged.select("class_hash", "class_id", (F.col("other") + F.col("copies") - 1).alias("n_links")), "class_hash", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float, size: int, most: int, partitions: int) -> DataFrame:
    """(class_hash, copies, other, class_id) for each class: how many rows of other classes it is linked with."""
    grouped = groups.select(F.col("id").alias("rep"), F.col("component").alias("grp"))
    picked = few(stored(blocks.counted(grouped, most).join(classes.select("rep", "copies"), "rep"), "picked"))
    members = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text")).join(picked, "rep")
    rows = blocks.dealt(members.withColumnRenamed("rep", "id"))
    found = blocks.summed(stored(blocks.links(rows, "text", linked_by_jaccard(threshold, size), partitions), "links"))
    return classes.select("class_hash", F.col("rep").alias("id"), "copies").join(found, "id", "left").select(
        "class_hash", "copies", F.coalesce("n_links", F.lit(0)).alias("other"), F.coalesce("component", "id").alias("class_id")
    )


def _audited(truth: DataFrame, judged: DataFrame) -> float:
    """The recall of the queries' links: the lower of the share of all and the mean of each query's share; 1 without any."""
    each = truth.groupBy("class_hash").agg(F.sum("n").alias("n")).join(judged.select("class_hash", "other"), "class_hash")
    r = each.agg(F.sum(F.least("other", "n")).alias("found"), F.sum("n").alias("n"), F.avg(F.least("other", "n") / F.col("n")).alias("mean")).first()
    return min(r["found"] / r["n"], r["mean"]) if r["n"] else 1.0


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id; of repeated rows of it, one stays.

    Only the ids that go are joined with the texts: by broadcast while they are few enough, else by a shuffle. Rows with
    null doc_id are linked with nothing and all stay.
    """
    judged = stored(ngram_join(docs, **options), "judged")
    kept = without(docs, judged.where("doc_id <> class_id"))
    again = stored(judged.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return without(kept, again).unionByName(kept.join(few(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
