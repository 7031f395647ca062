"""Operators on pairs against brute force: n-gram join, embeddings, their graph and block parts, and deduplication."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import blocks, embedding_dedup, ngram_join, shingles
from attestra.llm.graph import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def closure(ids, pairs):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def brute(rows, threshold=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows]
    pairs, links = [], [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) / len(x | y) >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((sets[a][0], sets[b][0]))
    group = closure([i for i, _ in rows], pairs)
    return sorted((i, group[i], n) for (i, _), n in zip(sets, links, strict=True))


def near_texts(seed=1, groups=12, size=8):
    r = random.Random(seed)
    make = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    out = []
    for _ in range(groups):
        base = make(r.choice((3, 5, 6, 40, 200)))
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                own[r.randrange(len(own))] = f"x{r.randrange(99)}"
            out.append(" ".join(own))
    return out


EDGES = [None, "", "...", "one", "One!", "two words", "a b c d", "a b c d e", "A, B; c d e"]


@pytest.mark.parametrize("most", [5, 1024])
def test_ngram_join_equals_brute_force(spark, most):
    rows = list(enumerate(near_texts() + EDGES))
    rows += [(3, rows[3][1]), (200, "é ü ñ ß ø"), (201, "é ü ñ ß ø")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, copies int")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df, most=most).collect())
    assert got == brute(rows)


def test_ngram_join_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_join(df).count() == 0
    assert ngram_join.deduplicated(df).count() == 0


def test_deduplicated_keeps_one_of_each_class(spark):
    rows = list(enumerate(near_texts(2, 5, 5) + ["", None])) + [(0, near_texts(2, 5, 5)[0])]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = sorted(r.doc_id for r in ngram_join.deduplicated(df).collect())
    assert kept == sorted({c for _, c, _ in brute(rows)})


def test_prefixes_shorten_until_recall():
    falling = [1.0, 1.0, 1.0, 1.0, 1.0, 0.9999, 0.9995, 0.9992, 0.99, 0.9, 0.5]
    assert ngram_join.prefix_length(falling, 10_000, 0.8, 32, 0.999, 4) == 7
    assert ngram_join.prefix_length(falling, 10_000, 0.8, 32, 0.9, 4) == 9
    assert ngram_join.prefix_length([1.0] * 11, 0, 0.8, 32, 0.999, 4) == 7  # nothing to measure: as theory has it
    assert ngram_join.prefix_length([1.0] * 11, 10_000, 0.8, 32, 0.999, 4) == 10
    assert ngram_join.prefix_length([0.5] * 11, 10_000, 0.8, 32, 0.999, 4) == 4


@pytest.mark.parametrize("partitions", [1, 7])
def test_forest_ties_are_the_nodes_of_sorted_tries(spark, partitions):
    r = random.Random(8)
    labels = {k: bytes(r.choice(b"ab") for _ in range(3 * 6)) for k in range(60)}
    df = spark.createDataFrame(list(labels.items()), "rep long, labels binary")
    ties = [(x.a, x.b, x.prefix) for x in ngram_join.forest_ties(df, 3, 6, 2, partitions).collect()]
    for depth in range(2, 7):
        nodes = {}
        for k, v in labels.items():
            for t in range(3):
                nodes.setdefault((t, v[6 * t : 6 * t + depth]), []).append(k)
        want = closure(labels, [(own[0], x) for own in nodes.values() for x in own[1:]])
        assert closure(labels, [(a, b) for a, b, p in ties if p >= depth]) == want


def test_exact_search_equals_brute_force(spark):
    rows = list(enumerate(near_texts() + EDGES))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = {tuple(sorted(shingle_set(t))) for i, t in rows if i % 10 == 0 and shingle_set(t)}
    want = sorted(n for a in asked if (n := sum(1 for _, t in rows if (s := shingle_set(t)) and s != set(a) and len(s & set(a)) / len(s | set(a)) >= 0.8)))
    for block in (300, 2**20):
        got = ngram_join.exact_search(df, 0.8, 5, 32, 10, 10, block).groupBy("class_hash").agg(F.sum("n").alias("n")).collect()
        assert sorted(r.n for r in got) == want


def test_recalls_by_prefix(spark):
    truth = spark.createDataFrame([(b"a", 3, 1), (b"a", 1, 1), (b"b", 2, 8)], "class_hash binary, prefix int, n long")
    measured, queries = ngram_join.recalls(truth, 4)
    assert queries == 2 and measured == [1.0, 1.0, 0.75, 0.1, 0.0]
    assert ngram_join.recalls(truth.where("false"), 4) == ([1.0] * 5, 0)


def test_ngram_recall_under_target_is_an_error(spark):
    df = spark.createDataFrame(list(enumerate(near_texts())), "doc_id long, text string")
    with pytest.raises(RuntimeError, match="recall"):
        ngram_join.ngram_join(df, recall=2.0, audit_every=10).count()


def around_one(copies, seed=4):
    """A text and copies of it at a similarity of 0.8, which among themselves have about 0.65."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(409)]
    out = [" ".join(base)]
    for c in range(copies):
        own, shift = list(base), r.randrange(5)
        for k in r.sample(range(80), 9):  # each changes five shingles of its own
            own[4 + shift + 5 * k] = f"x{c}y{k}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("most", [16, 1024])
def test_ngram_join_links_over_classes_that_stand_between(spark, most):
    rows = list(enumerate(around_one(80)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df, most=most).collect())
    assert got == brute(rows) and got[0] == (0, 0, 80)


@pytest.mark.parametrize("most", [3, 7, 1024])
def test_node_ties_join_what_meets_in_a_node(spark, most):
    r = random.Random(9)
    labels = {k: bytes(r.choice(b"abc") for _ in range(3 * 6)) for k in range(90)}
    group = {k: k % 9 if k < 60 else k for k in labels}  # some large ones in each node
    group = {k: min(x for x in labels if group[x] == g) for k, g in group.items()}
    classes = spark.createDataFrame(list(labels.items()), "rep long, labels binary")
    groups = spark.createDataFrame([(k, g) for k, g in group.items() if k < 60], "id long, component long")
    ties = ngram_join.forest_ties(classes, 3, 6, 2, 3)
    got = [(x.a, x.b) for x in ngram_join.node_ties(ties, classes, groups, 3, 6, 2, 0.6, most, 3).collect()]
    meet = lambda a, b: any(labels[a][6 * t : 6 * t + 2] == labels[b][6 * t : 6 * t + 2] for t in range(3))
    agree = lambda a, b: sum(x == y for x, y in zip(labels[a], labels[b], strict=True)) >= 0.6 * 18
    want = [(a, b) for a in labels for b in labels if a < b and group[a] != group[b] and meet(a, b) and agree(a, b)]
    assert want and closure(labels, got + list(group.items())) == closure(labels, want + list(group.items()))


def test_shingles_equal_plain_sets():
    texts = near_texts(3) + [t or "" for t in EDGES]
    hashes, at = shingles.shingle_hashes([t.encode() for t in texts])
    own = [frozenset(hashes[at[k] : at[k + 1]].tolist()) for k in range(len(texts))]
    for k in range(len(texts)):
        assert len(own[k]) == len(shingle_set(texts[k]))
        for j in range(k):
            assert len(own[k] & own[j]) == len(shingle_set(texts[k]) & shingle_set(texts[j]))


def test_components_equal_plain_closure(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2064)]
    df = spark.createDataFrame(pairs + pairs[:9] + [(None, 3)], "a long, b long")
    got = {x.id: x.component for x in components(df).collect()}
    real = [(a, b) for a, b in pairs if a != b]
    want = closure({i for p in real for i in p}, real)
    assert got == want


def test_blocks_cover_each_pair_once(spark):
    n = 50
    members = spark.range(n).select(F.lit(0).cast("long").alias("grp"), "id", F.lit(1).cast("long").alias("copies"), F.col("id").cast("string").cast("binary").alias("value"))
    members = blocks.counted(members, most=8)
    every = lambda values: np.ones((len(values), len(values)), bool)
    got = blocks.summed(blocks.links(blocks.dealt(members.unionByName(members.where("id < 9"))), "value", every, 4)).collect()
    assert {r.n_links for r in got} == {n - 1} and {r.component for r in got} == {0} and len(got) == n


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(30):
        base = rng.standard_normal(16)
        out += [base + 0.02 * k * rng.standard_normal(16) for _ in range(12)]
    out += [out[0], 2 * out[5]]
    return [v.astype(np.float32).tolist() for v in out]


def test_embeddings_equal_brute_force(spark):
    own = vectors()
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, None] + [0.0] * 14, [1.0, 0.0]]
    rows = [(k, v, "l") for k, v in enumerate(own + odd)] + [(0, own[0], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, digest string")
    got, recall = embedding_dedup.near_duplicates(df)
    ids = [r[0] for r in rows]
    x = [np.array(v, float) if k < len(own) else None for k, v, _ in rows]
    unit = [None if v is None else v / np.linalg.norm(v) for v in x]
    pairs, links = [], {k: 0 for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= 0.9:
                pairs.append((ids[a], ids[b]))
                links[a] += 1
                links[b] += 1
    group = closure(set(ids), pairs)
    want = sorted((ids[k], links[k], group[ids[k]], ids[k] == group[ids[k]]) for k in range(len(rows)))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == want
    assert recall >= 0.99


def test_null_ids_are_linked_with_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_join.ngram_join(docs).collect()))
    assert got == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (2, 1, 1)]
    own = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    rows = sorted((r.vec_id or 0, r.component_id or 0, r.n_links, r.kept) for r in embedding_dedup.near_duplicates(own)[0].collect())
    assert rows == [(0, 0, 0, False), (1, 1, 1, True), (2, 1, 1, False)]


def test_embeddings_of_no_rows(spark):
    got, recall = embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.count() == 0 and recall == 1.0


def test_oversized_groups_are_dealt_each_in_its_own_way(spark):
    rows = spark.range(600).crossJoin(spark.createDataFrame([(g,) for g in range(8)], "grp long"))
    parts = {}
    for r in embedding_dedup._parted(rows, 256, 0).collect():
        parts.setdefault((r.grp, r.id), set()).add(r.part)
    common = [{i for i in range(600) if len(parts[g, i]) == 3} for g in range(8)]
    assert all(common) and sum(map(len, common)) < 600
    met = sum(any(parts[g, 0] & parts[g, i] for g in range(8)) for i in range(1, 600))
    assert met > 540  # 1 - (2/3)^8 of them; 200 if all groups are dealt alike


def test_links_between_saturated_groups(spark):
    rng = np.random.default_rng(5)
    centres = np.zeros((2, 64))
    centres[:, 0], centres[1, 1] = 1, 0.38  # cosine 0.935
    own = np.repeat(centres, 20, axis=0) + 0.015 * rng.standard_normal((40, 64))
    own = np.vstack([own, rng.standard_normal((60, 64))]).astype(np.float32)
    unit = own.astype(float) / np.linalg.norm(own.astype(float), axis=1)[:, None]
    want = ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist()
    assert min(want[:40]) > 19
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(own)], "vec_id long, embedding array<float>")
    got = sorted(embedding_dedup.near_duplicates(df)[0].collect(), key=lambda r: r.vec_id)
    assert [r.n_links for r in got] == want and {r.component_id for r in got[:40]} == {0}


@pytest.mark.parametrize("first", [0, 1])
def test_audit_asks_all_rows_in_blocks(spark, first):
    rng = np.random.default_rng(2)
    own = rng.standard_normal((500, 8)).round(1)
    unit = own / np.linalg.norm(own, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    ids = [first + 2 * k for k in range(500)]  # all odd if first is 1: then no id is divisible
    rows = spark.createDataFrame([(i, str(k).encode()) for k, i in enumerate(ids)], "vec_id long, digest binary")
    points = spark.createDataFrame([(str(k).encode(), i, 1, v.tobytes(), 8) for k, (i, v) in enumerate(zip(ids, unit, strict=True))], "digest binary, id long, copies long, unit binary, dims int")
    for lost in (0, 1):
        links = [(i, int(near[k].sum()) - 1 - (lost if near[k].sum() > 1 else 0)) for k, i in enumerate(ids)]
        judged = spark.createDataFrame(links, "id long, n_links long")
        got = embedding_dedup._audited(rows, points, judged, 0.9, 4, 2048)
        asked = [k for k, i in enumerate(ids) if i % 4 == 0 and near[k].sum() > 1]
        if first == 0:
            n = [int(near[k].sum()) - 1 for k in asked]
            assert got == pytest.approx(min((sum(n) - lost * len(n)) / sum(n), sum((x - lost) / x for x in n) / len(n)))
        else:
            assert (got == 1) == (lost == 0)


def test_recall_under_target_is_an_error(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors())], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup.near_duplicates(df, recall=2.0, most_rounds=1)
