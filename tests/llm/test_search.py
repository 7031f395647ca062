"""Hard negatives, fingerprints and spelling variants against brute force, with odd rows, and the shared helpers of the operators."""

import hashlib
import itertools
import math
import random
import re
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import hard_negatives, queries, simhash, spelling
from attestra.llm.work import scratch, shared, stored
from tests.conftest import SF, TABLES, rows_of

# --- hard negatives


def mined(rows, every=100, positives=5, negatives=5, lower=80, upper=100):
    good = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2]), reverse=True):
        good[i] = (label, [math.floor(256 * x) for x in v])
    out = []
    for a in sorted(i for i in good if i % every == 0):
        label, q = good[a]
        scored = [(sum(x * y for x, y in zip(q, w, strict=True)), i, other) for i, (other, w) in good.items() if i != a and len(w) == len(q)]
        first = sorted(((-s, i) for s, i, other in scored if other == label))[:positives]
        for less, p in first:
            fit = sorted((-s, i) for s, i, other in scored if other != label and lower * -less <= 100 * s <= -upper * less)
            out += [(a, p, k + 1, i, -less, -s) for k, (s, i) in enumerate(fit[:negatives])]
    return sorted(out)


def vectors(n, dims=6, seed=3, labels=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = r.standard_normal(dims) + 0.6
        out.append((i, [float(x) for x in v * float(r.pareto(1.5) + 0.05)], int(r.integers(labels))))
    return out


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("bucket, block_bytes", [(65_536, 8 * 2**20), (64, 700)])
def test_hard_negatives_equal_brute_force(spark, bucket, block_bytes):
    rows = vectors(700)
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(150)]  # many copies of one vector
    df = spark.createDataFrame(rows, SCHEMA).withColumn("norm", F.lit("x")).withColumn("q", F.lit(1))
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, every=20, bucket=bucket, block_bytes=block_bytes).collect())
    assert got == mined(rows, 20) and len(got) > 300


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 1), (5, None, 1), (6, [1.0, 0.0], None), (None, [1.0, 0.0], 2), (7, [1.0], 1), (8, [1.0], 2), (9, [], 1), (10, [None, 1.0], 1)]
    rows += [(2, [0.9, 0.1], 2)] * 3 + [(100, [0.0, 0.0], 1), (200, [-1.0, 0.0], 2), (300, [], 3), (400, [1.0], 1)]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == mined(rows) and got
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hard_negatives_with_scores_that_doubles_round(spark):
    big = 2.0**21
    rows = [(0, [big, big, 1.0], 0), (1, [big, big, 3.0], 0), (2, [big, big, 2.0], 1), (3, [big, big, 1.0], 1), (4, [big, big - 1 / 256, 0.0], 1), (5, [1e300, 0.0, 0.0], 1)]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [r for r in got if r[0] == 0] == mined(rows[:5])


# --- fingerprints

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def edited(text, after):
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def slow_fingerprint(text):
    """The same votes, term by term."""
    from attestra.llm.shingles import mixed, shingle_hashes, word_hashes

    votes = np.zeros(256)
    for size in simhash.KINDS:
        hashes = (word_hashes if size == 1 else lambda t: shingle_hashes(t, size))([text.encode()])[0]
        for h, n in Counter(hashes.tolist()).items():
            term = int(mixed(np.array([h ^ size], np.uint64))[0])
            for k, seed in enumerate(simhash._SEEDS.tolist()):
                raw = int(mixed(np.array([term ^ seed], np.uint64))[0]).to_bytes(8, "little")
                for j, byte in enumerate(raw):
                    for bit in range(8):
                        votes[64 * k + 8 * j + bit] += (1 + math.log(n)) * (1 if byte >> (7 - bit) & 1 else -1)
    return "".join(f"{int(''.join('1' if v > 0 else '0' for v in votes[k : k + 4]), 2):x}" for k in range(0, 256, 4))


def bits_in_common(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 256


def some_texts(seed=4, n=60):
    r = random.Random(seed)
    return [" ".join(r.choice(["café", "straße", "x", "alpha", "beta", "🙂", "Gamma", f"w{r.randrange(200)}"]) for _ in range(r.choice((0, 1, 2, 30, 200)))) for _ in range(n)]


def test_fingerprints_equal_brute_force(spark):
    texts = some_texts()
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    rows[7] = (rows[7][0], None)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("fingerprint", F.lit(0)).repartition(5)
    got = {r["doc_id"]: r for r in simhash.fingerprinted(df).collect()}
    assert len(got) == len(rows)
    plain = [t or "" for _, t in rows]
    marks = [slow_fingerprint(t) for t in plain]
    for k, (i, _) in enumerate(rows):
        after = plain[(k + 1) % len(rows)]
        made = edited(plain[k], after)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(plain[k]), hashlib.sha256(made.encode()).hexdigest())
        assert r["fingerprint"] == marks[k] and r["edited_fingerprint"] == slow_fingerprint(made)
        assert r["near_edited"] == pytest.approx(bits_in_common(marks[k], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(bits_in_common(marks[k], marks[(k + 1) % len(rows)]))


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert simhash.near(simhash.fingerprinted(spark.createDataFrame([], schema))).count() == 0
    one = simhash.fingerprinted(spark.createDataFrame([(5, "ab cd")], schema)).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and one[0]["near_next"] == 1
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "some words here"), (None, None), (2, "z" * 3_000_000)]
    got = simhash.near(stored(simhash.fingerprinted(spark.createDataFrame(rows, schema)), "t")).collect()
    assert len(got) == 6
    lone = next(r for r in got if r["doc_id"] is None and r["n_chars"])
    assert lone["edited_sha256"] == hashlib.sha256(b"some wor").hexdigest() and (lone["n_near"], lone["group_id"]) == (0, None)
    same = [r for r in got if r["fingerprint"] == slow_fingerprint("a")]
    assert [(r["n_near"], r["group_id"]) for r in same] == [(1, 1)] * 2


def flipped(mark, bits):
    for b in bits:
        mark ^= 1 << b
    return mark


@pytest.mark.parametrize("radius, most", [(7, 1024), (7, 8), (3, 16), (0, 1024)])
def test_all_fingerprints_within_the_radius_are_found(spark, radius, most):
    r = random.Random(radius)
    marks = [r.getrandbits(256) for _ in range(40)]
    for base in marks[:15]:
        marks += [flipped(base, r.sample(range(256), r.randrange(10))) for _ in range(6)]
    hub = r.getrandbits(256)
    marks += [flipped(hub, r.sample(range(256), r.randrange(4))) for _ in range(120)] + [hub] * 10
    rows = [(i, f"{m:064x}") for i, m in enumerate(marks)] + [(900, None), (None, f"{hub:064x}")]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string").withColumn("n_near", F.lit("clash")).drop("n_near").withColumn("copies", F.lit(0))
    got = {x["doc_id"]: (x["n_near"], x["group_id"]) for x in simhash.near(df, radius, most).collect()}
    up = list(range(len(marks)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = Counter()
    for a, b in itertools.combinations(range(len(marks)), 2):
        if (marks[a] ^ marks[b]).bit_count() <= radius:
            n[a] += 1
            n[b] += 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    want = {i: (n[i], root(i)) for i in range(len(marks))} | {900: (0, 900), None: (0, None)}
    assert got == want


def test_tables_of_leading_blocks():
    for radius, rows in ((7, 1000), (7, 2**40), (3, 10), (15, 10**6)):
        choices = simhash.tables(256, radius, rows)
        n = radius + len(choices[0])
        assert len(choices) == math.comb(n, len(choices[0])) and len(set(choices)) == len(choices)


# --- spelling variants


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(n, ratio=2):
    near = defaultdict(list)
    for a, b in itertools.combinations(sorted(n), 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def slow_counts(rows, noise):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if noise and h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_spelling_variants_equal_brute_force(spark):
    r = random.Random(6)
    stems = ["".join(r.choice("abcdéÀÿ×z") for _ in range(r.randrange(4, 9))) for _ in range(25)]
    bag = []
    for s in stems:
        for _ in range(12):
            k = r.randrange(len(s))
            bag += [r.choice([s, s, s[:k] + r.choice("aé") + s[k:], s[:k] + s[k + 1 :], s[:k] + r.choice("zÿ") + s[k + 1 :]])] * r.randrange(1, 6)
    r.shuffle(bag)
    rows = [(i, r.choice(" .-9\n").join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in bag[k : k + 40])) for i, k in enumerate(range(0, len(bag), 40))]
    rows += [(None, "Hello hello HELLO hallo hallo hallo"), (500, None), (501, ""), (502, "ab" * 400_000 + " hello"), (502, "hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("word", F.lit("x"))
    for noise in (None, 5):
        got = sorted((tuple(x) for x in spelling.spelling_variants(df, noise).collect()), key=str)
        assert got == slow_variants(slow_counts(rows, noise)) and len(got) > 50


@pytest.mark.parametrize("crowd", [128, 2])
def test_large_anagram_groups_lose_no_pair(spark, crowd):
    words = {"".join(p) for p in itertools.permutations("abcde")} | {"".join(p) for p in itertools.permutations("abcd")} | {"abxde", "aacde", "éabcd"}
    n = {w: 1 + (zlib.crc32(w.encode()) % 50) for w in words}
    rows = [*n.items(), (None, 3), ("", 4)]
    got = sorted((tuple(x) for x in spelling.variants(spark.createDataFrame(rows, "word string, n long"), crowd=crowd).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == slow_variants(n)


def test_spelling_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), 97).count() == 0


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_spelling_variants"])
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    told = duck.execute(queries.ORACLE_SQL[name])
    assert got == rows_of([d[0] for d in told.description], told.fetchall()) and set(TABLES)


# --- shared helpers


def test_scratch_blocks_of_threads_keep_to_themselves(spark):
    entered, left, found = threading.Event(), threading.Event(), {}

    def other():
        with scratch(spark):
            found["mine"] = stored(spark.range(5), "mine")
            entered.set()
            left.wait(60)
            found["n"] = found["mine"].count()

    with scratch(spark) as keep:
        t = threading.Thread(target=other)
        t.start()
        entered.wait(60)
        own, kept = stored(spark.range(3), "own"), keep(spark.range(2), "kept")
        value = shared(spark, [1, 2])
        assert value.value == [1, 2]
    left.set()
    t.join()
    assert found["n"] == 5 and kept.count() == 2
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|destroyed"):
        own.count()
