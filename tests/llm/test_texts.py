"""Operators on texts: brute force, exact round trips, held-out accuracy and awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import zstandard
from pyspark.sql import functions as F
from tests.llm.test_pairs import words

from attestra.llm import boosted, chat, decontaminate, html_extract, language_id, packing, quality, toxicity, url_filter
from attestra.llm.dom import Page
from attestra.llm.html_samples import labelled_pages
from attestra.llm.work import bound, sampled

SMALL = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [None, "", " \n", "...", "x", "Élan vital", "a" * 5000, "日本語 テキスト", "same", "same"]


def docs_of(spark, texts, extra=""):
    return spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, score string")


# URL filters

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def judge(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({i: i + 32 for i in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = lambda h, p: host and (host == h or host.endswith("." + h)) and path.startswith(p)
    own = max(((len(h + p), len(h), h + p, v) for h, p, v in rules if fits(h, p)), default=None)
    return host, path, own and own[2], own[3] if own else ("block" if any(fits(h, p) for h, p in listed) else "allow")


URLS = [
    None, "", "no scheme", "http://", "http://example.org", "http://example.org/", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/1234?x#y", "https://xexample.org/es/", "http://com/fr/",
    "https://shop.com/de/?q", "https://shop.com/DE/", "https://bad.net/x", "https://a.bad.net/", "https://notbad.net/", "x://y://z/fr/", "https://org.bad.net/p/q", "http://e.com?u=/fr/", "http://e.com#/fr/", "https://shop.com/de/?q",
]


def test_url_filter_equals_brute_force(spark):
    listed = [("bad.net", "/")] + [(f"h{k}.net", f"/{k}/") for k in range(500)]
    pages = spark.createDataFrame([(k, u, "old", "old") for k, u in enumerate(URLS)], "page_id long, url string, verdict string, key string")
    df = url_filter.url_filter(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame(listed, "host string, path string"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in df.orderBy("page_id").collect()]
    assert got == [judge(u, RULES, listed) for u in URLS]


def test_url_filter_with_hot_and_null_urls_and_many_path_lengths(spark):
    listed = [(f"h{k % 9}.net", "/" + "x" * k) for k in range(0, 400, 7)]
    urls = ["https://h0.net/" + "x" * 63] * 300 + [None] * 300 + [f"http://sub.h{k}.net/{'x' * (5 * k)}" for k in range(9)]
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(urls)], "page_id long, url string, block string")
    df = url_filter.url_filter(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame(listed, "host string, path string"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in df.orderBy("page_id").collect()]
    assert got == [judge(u, RULES, listed) for u in urls]


def test_url_filter_without_lists(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.url_filter(pages, none, none.drop("verdict")).collect()] == [(None, "allow")]
    assert url_filter.url_filter(pages.where("false"), none, none).count() == 0


def test_bloom_never_loses_a_key_and_the_join_drops_false_hits(spark):
    listed = spark.createDataFrame([(f"h{k}.net", "/") for k in range(3000)], "host string, path string")
    urls = spark.createDataFrame([(f"https://h{k}.net/x",) for k in range(6000)], "url string")
    assert url_filter.listed_matches(urls, listed, max_filter_mb=0).count() == 3000  # one block: all bits set, nothing filtered
    assert url_filter.listed_matches(urls, listed).count() == 3000


def test_native_operators_have_no_python(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    plans = [
        url_filter.url_filter(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([("b.c", "/")], "host string, path string")),
        decontaminate.contamination(docs_of(spark, ["x"]), items),
    ]
    for df in plans:
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().optimizedPlan().toString())


# benchmark decontamination


def contaminated(texts, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    found |= own
                    hit |= set(range(i, i + n))
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("most", [3_000, 2**20])
def test_contamination_equals_brute_force(spark, most):
    r = random.Random(1)
    make = lambda n: " ".join(r.choice("aa bb cc dddd ee ff gg".split()) for _ in range(n))
    items = [(k, make(r.choice((1, 3, 10, 11, 25)))) for k in range(12)] + [(50, None), (51, ""), (52, "!!"), (10, "aa aa aa aa aa aa aa aa aa aa aa")]
    texts = [make(r.choice((0, 5, 40, 255, 256, 257, 300, 2000))) for _ in range(30)] + [f"X {t}. {make(5)}" for _, t in items if t] + AWKWARD + ["aa " * 40]
    df = spark.createDataFrame([(k % 40, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, item_ids int")
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), max_bytes=most).collect()
    rows = sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got)
    assert rows == sorted((k % 40, *x) for k, x in enumerate(contaminated(texts, items)))


def test_cleaning(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    df = docs_of(spark, [f"Before, {passage}! After", "clean text", None])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    odd = spark.createDataFrame([(None, passage, 1, "a"), (None, "clean", 2, "b"), (5, passage, 3, "c"), (5, "other text", 4, "d"), (6, None, 5, "e"), (6, None, 5, "e")], "doc_id long, text string, _row int, _doc string")
    assert [sorted(r._row for r in decontaminate.clean(odd, items).collect()), decontaminate.clean(odd, items).columns] == [[2, 4, 5, 5], odd.columns]
    assert sorted((r._row, r.text or "") for r in decontaminate.clean(odd, items, remove="spans").collect())[2] == (3, " " * 11)
    assert sorted(r.doc_id for r in decontaminate.clean(df, items).collect()) == [1, 2]
    cut = {r.doc_id: r.text for r in decontaminate.clean(df, items, remove="spans").collect()}
    assert words(cut[0]) == ["before", "after"] and cut[0].startswith("Before,") and cut[0].endswith("! After") and cut[1] == "clean text" and cut[2] is None
    assert decontaminate.clean(df, items.where("false")).count() == 3 and decontaminate.clean(df.where("false"), items).count() == 0


# chat formatting


def test_linear_conversations_read_back(spark):
    mark = "<|im_end|>\n<|im_start|>assistant ok \\ \\| <\\| <||"
    rows = [(1, 0, "system", None), (1, 1, "user", mark), (1, 2, "assistant", mark), (1, 3, "assistant", ""), (2, 0, "<|im_sep|>", "x"), (2, 0, "assistant", "tie"), (3, None, None, "y"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.conversations(chat.linear_nodes(df)).select("tree", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    got = {r.tree: ([(x.role, x.text) for x in r.t], r.l) for r in made.collect()}
    assert got == {
        1: ([("system", ""), ("user", mark), ("assistant", mark), ("assistant", "")], mark),
        2: ([("<|im_sep|>", "x"), ("assistant", "tie")], "tie"),
        3: ([("", "y")], ""),
    }


def test_trees_give_ranked_paths(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 3.0), ("t", 3, 1, "assistant", "b", 9.0), ("t", 4, 2, "user", "c", 0.0), ("t", 5, 99, "user", "lost", 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = [(r.leaf, r.branch_rank, [x.text for x in r.t]) for r in chat.conversations(df).withColumn("t", chat.read_back(F.col("formatted"))).orderBy("branch_rank").collect()]
    assert got == [(3, 1, ["q", "b"]), (4, 2, ["q", "a", "c"]), (5, 3, ["lost"])]


def test_repeated_and_odd_nodes_count_once(spark):
    nan = float("nan")
    nodes = [("t", 1, None, "user", "hi", 0.0)] * 2 + [("t", 2, 1, "assistant", "a", nan), ("t", 2, 1, "assistant", "b", None), ("t", None, 1, "user", "no id", 1.0), (None, 1, None, "user", "no tree", 1.0)]
    nodes += [("t", 3, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", "high", 2.0)]
    df = spark.createDataFrame([(*n, 7) for n in nodes], "tree string, node long, parent long, role string, text string, score double, before int")
    got = [(r.leaf, r.branch_rank, r.score, [x.text for x in r.t], r.l) for r in chat.conversations(df).withColumn("t", chat.read_back(F.col("formatted"))).withColumn("l", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).orderBy("branch_rank").collect()]
    assert got == [(3, 1, 1.0, ["hi", "high"], "high"), (2, 2, 0.0, ["hi", "b"], "b")]
    cycle = spark.createDataFrame([("t", 1, 2, "user", "x", 0.0), ("t", 2, 1, "user", "y", 0.0)], "tree string, node long, parent long, role string, text string, score double")
    with pytest.raises(ValueError, match="cycle"):
        chat.conversations(cycle)


def test_long_chain_and_empty(spark):
    chain = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.conversations(chat.linear_nodes(chain)).select(chat.read_back(F.col("formatted")).alias("t")).collect()
    assert [x.text for x in r[0].t] == [str(k) for k in range(300)]
    assert chat.conversations(chat.linear_nodes(chain.where("false"))).count() == 0


# packing


def test_pieces_and_places(spark):
    r = random.Random(5)
    texts = AWKWARD + ["don't <|endoftext|> stop ŀ 🙂 ١٢٣" * 3, "word " * 9000] + [" ".join(r.choice("alpha beta gamma Δelta".split()) for _ in range(r.randrange(1, 900))) for _ in range(60)]
    df = docs_of(spark, texts)
    got = packing.packed(df, TOKENIZER, with_ids=True).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    for k, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by[k], key=lambda x: x.piece)
        assert [i for x in own for i in x.ids] == ids and [x.piece for x in own] == list(range(len(own)))
        assert [x.start for x in own] == np.cumsum([0] + [x.length for x in own])[:-1].tolist()
        assert all(x.length == 2048 for x in own[1:]) and len(own) == math.ceil(len(ids) / 2048)
        assert all(x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in own)
    seats = defaultdict(list)
    for x in got:
        seats[x.sequence_id].append((x.offset, x.length))
    for own in seats.values():
        assert sum(n for _, n in own) <= 2048
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
    assert len(seats) <= math.ceil(sum(x.length for x in got) / 2048) + 1
    assert packing.packed(df.where("false"), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_all_pieces(seed):
    r = random.Random(seed)
    counts = Counter(r.choice((r.randrange(1, 65), r.randrange(30, 40))) for _ in range(r.choice((1, 30, 3000))))
    fit = packing.best_fit(dict(counts), 64)
    found = packing.local_search(fit, 64)
    for plan in (fit, found):
        assert sum((Counter({n: k * c for n, k in Counter(p).items()}) for p, c in plan), Counter()) == counts
        assert all(0 < sum(p) <= 64 and c > 0 for p, c in plan)
    assert sum(c for _, c in found) <= sum(c for _, c in fit)


def test_local_search_empties_bins():
    before = [((5, 3), 1), ((4, 2), 1), ((1, 1), 1)]  # 10 a bin: 16 in all, two bins are enough
    assert sum(c for _, c in packing.local_search(before, 10)) == 2


def test_runs_are_filed_under_few_buckets():
    r = random.Random(3)
    runs, used = [], Counter()
    for k in range(3000):
        length, n = r.choice((5, 6, 7)), r.choice((1, 1, 2, 50, 4000))
        runs.append((length, used[length], used[length] + n, k, 0))
        used[length] += n
    shifts, places = packing._bucketed(runs)
    assert len(places) < 4 * len(runs)
    filed = defaultdict(list)
    for length, bucket, first, last, sequence, _ in places:
        filed[length, bucket].append((first, last, sequence))
    for length, first, last, sequence, _ in runs:
        for rank in {first, last - 1, (first + last) // 2}:
            assert [s for a, b, s in filed[length, rank >> shifts[length]] if a <= rank < b] == [sequence]


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="x">
<header class="site-header"><p>Site name and slogan</p><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies to improve things. Accept them now.</p></div>
<article><h1>The  title&nbsp;here</h1><p>First <b>bold</b>pa&amp;ra<br>graph with some more words, and a comma.</p><div class="advert">Buy now, cheap things today</div>
<p>Second paragraph is longer than the first, so that there is text enough. It goes on for some time, as texts do.</p><ul><li>one item<li>two items</ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>First! I disagree with all of this, really.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Read this as well</a></li></ul></aside><form class="newsletter"><label>Mail</label><p>Sign up for news</p><button>Go</button></form>
<footer>&copy; Someone <p>All rights reserved</p></footer></body></html>"""


def test_main_text():
    got = html_extract.texts_of([Page(PAGE)], html_extract.model())[0]
    assert got == "The title here First boldpa&ra graph with some more words, and a comma. Second paragraph is longer than the first, so that there is text enough. It goes on for some time, as texts do. one item two items"


def test_held_out_pages():
    wrong = 0
    for source, main in labelled_pages(150, seed=1234):
        page = Page(source)
        wrong += html_extract.texts_of([page], html_extract.model())[0] != " ".join(x for _, x, _ in page.runs if x in main)
    assert wrong <= 8


def test_decoding_never_contradicts():
    page = Page("<div><p>a</p><section><p>b</p></section></div><div><p>c</p></div>")
    nodes, _ = html_extract.node_features(page)
    rng = np.random.default_rng(0)
    for _ in range(50):
        odds = rng.normal(0, 4, len(nodes))
        kept = html_extract.decoded(page, nodes, odds)
        assert all(kept[page.parents[k]] for k in range(1, len(kept)) if kept[k])
        score = lambda own: sum(-math.log1p(math.exp(-z if own[k] else z)) for k, z in zip(nodes, odds, strict=True))
        every = ([bool(m >> j & 1) for j in range(len(kept))] for m in range(2 ** len(kept)))
        legal = [o for o in every if all(o[page.parents[k]] for k in range(1, len(o)) if o[k])]
        assert score(kept) >= max(map(score, legal)) - 1e-9


def test_awkward_pages(spark):
    pages = [None, "", "plain text", "<p", "<article><p>cut o", "<p>&am", "<article><p>x &amp", "<div><div><div>", "</p></p>", "<nav><a href=1>x</a></nav>", "<article><p>" + "long text, " * 3000 + "</p></article>"]
    df = spark.createDataFrame([(k, "u", h, "t", 5) for k, h in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extracted(df).collect()}
    assert all(n == len(t) for t, n in got.values()) and got[0] == got[1] == got[9] == ("", 0)
    assert got[4][0] == "cut o" and got[6][0] == "x &" and got[10][0].startswith("long text,") and got[10][1] == 11 * 3000 - 1
    assert html_extract.extracted(df.where("false")).count() == 0


def test_boosting_learns_a_rare_flag():
    rng = np.random.default_rng(0)
    x = np.c_[rng.random(400) < 0.02, rng.random(400)].astype(float)
    y = x[:, 0]
    assert ((boosted.raw(boosted.fit(x, y, rounds=20), x) > 0) == y).all()


LINES = [f"The quick brown fox number {k} jumps over the lazy dog." for k in range(20)]


@pytest.mark.parametrize(
    "source, want",
    [
        ("<html><body>" + "<br>".join(LINES) + "</body></html>", " ".join(LINES)),
        ("\n".join(LINES), " ".join(LINES)),
        ("<body>Prose stands straight in the body of it. <p>An inner paragraph has more of this prose.</p> The rest follows, to its end.</body>", "Prose stands straight in the body of it. An inner paragraph has more of this prose. The rest follows, to its end."),
        ('<p title="abc>Hello to the world, in a paragraph of words</p><p>and in another one.</p>', "Hello to the world, in a paragraph of words and in another one."),
        ("<p>if a < b and b > c then all is well in this text of some words</p>", "if a < b and b > c then all is well in this text of some words"),
    ],
)
def test_text_straight_in_body_and_broken_tags(source, want):
    assert html_extract.texts_of([Page(source)], html_extract.model())[0] == want


@pytest.mark.parametrize("source", ["<a title=\"x y'" * 70_000, "<p title='" * 100_000, "<a b='>" * 140_000, "<script>" * 120_000, "<!--" * 250_000, "<" * 1_000_000, "<div>" * 100_000 + "</x>" * 100_000, "<i x=" * 200_000])
def test_broken_pages_are_read_in_linear_time(source):
    began = time.perf_counter()
    Page(source)
    assert time.perf_counter() - began < 3  # well under a second each, but machines differ


# toxicity, quality, language


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95 and got.predicted[got.toxic == 1].mean() > 0.85
    assert got.score.between(0, 1).all()


def test_toxicity_of_awkward_rows(spark):
    labelled = docs_of(spark, [f"idiot moron word{k}" if k % 2 else f"nice plain word{k}" for k in range(200)] + AWKWARD)
    labels = labelled.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).where("doc_id < 200").unionByName(spark.createDataFrame([(1, None), (1, 0), (999_999, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(labelled, labels).collect()}
    assert len(got) == 210 and got[1].score > 0.5 > got[2].score
    assert got[1].held_out == (zlib.crc32(b"1") % 4 == 2)
    assert toxicity.toxicity(labelled, labels.where("false")).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity(labelled.where("false"), labels).count() == 0


def test_toxicity_equals_a_plain_version(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.choice((3, 4, 5))))
    texts = [" ".join([word() for _ in range(9)] + (["Idiot!", "moron"] if k % 3 == 0 else ["kindly", "indeed"])) for k in range(60)] + ["", "..."]
    toxic = [int(k % 3 == 0) for k in range(len(texts))]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, toxic, strict=True))], "doc_id long, text string, toxic int")
    seen = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, toxic, strict=True):
        seen[y].update({f" {w} "[:k] for w in re.findall(r"[^\W\d_]+", t.lower()) for k in range(5, len(w) + 3)})
    counts = {x.segment: (x.toxic_docs, x.ordinary_docs) for x in toxicity._document_counts(df).collect()}
    assert counts == {g: (seen[1][g], seen[0][g]) for g in {*seen[0], *seen[1]}}

    model = toxicity.fit(df)
    ordinary, own = model["contents"]
    assert own.startswith(ordinary[: -len(toxicity.ANCHOR)]) and b" idiot " in own and b" idiot " not in ordinary
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0)
    squeeze = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for c in (ordinary, own)]
    got = {x.doc_id: x.score for x in toxicity.scores(df.select("doc_id", "text"), model).collect()}
    for k, t in enumerate(texts):
        cells = []
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            a, b = (min(63, len(c.compress(toxicity.ANCHOR + f" {w} ".encode()))) for c in squeeze)
            cells.append(64 * a + b)
        x = np.array(toxicity.features(np.array(cells or [65]), model["ratio"]))
        z = model["weights"][0] + ((x - model["mean"]) / model["scale"]) @ model["weights"][1:]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def plain_kn(texts):
    """Interpolated modified Kneser-Ney over four characters, by the book."""
    pad = chr(quality.PAD)
    counts = {4: Counter(((pad * 3 + t)[i : i + 4]) for t in texts for i in range(len(t)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: quality.discounts([sum(v == i for v in counts[k].values()) for i in range(1, 5)]) for k in counts}
    cut = lambda k, c: d[k][min(c, 3) - 1]
    context = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            context[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        low = 1 / (len(counts[1]) + 1) if k == 1 else p(g[1:])
        own = context[k].get(g[:-1])
        if not own:
            return low
        c = counts[k].get(g, 0)
        return (c - cut(k, c) if c else 0) / sum(own) + sum(cut(k, x) for x in own) / sum(own) * low

    return lambda t: math.exp(-sum(math.log(p((pad * 3 + t)[i : i + 4])) for i in range(len(t))) / len(t)) if t else None


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_perplexity_equals_the_book(spark, most):
    r = random.Random(2)
    make = lambda: "".join(r.choice("ab c") for _ in range(r.randrange(1, 60)))
    good, other = [make() for _ in range(40)] + ["naïve café 🙂", "\uf642\ud7ff"], [make() for _ in range(10)] + ["zzz", "", None, "caf", "🙂🙂", "\uf642 a", "".join(map(chr, range(0x4000, 0x4100)))]
    df = docs_of(spark, good + other)
    model = quality.kneser_ney(quality.gram_counts(df.where(f"doc_id < {len(good)}").select("text")))
    got = {x.doc_id: x.perplexity for x in quality.perplexities(df.select("doc_id", "text"), model, most).collect()}
    want = plain_kn(good)
    for k, t in enumerate(good + other):
        told = want(t or "")
        assert (got[k] is None) == (told is None) and (told is None or math.isclose(got[k], told, rel_tol=1e-9)), t


def test_quality_separates_and_keeps_clean(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    got = quality.quality(docs, trusted).join(labels, "doc_id").toPandas()
    assert got.accepted[(got.quality == 1) & (got.toxic == 0)].mean() > 0.99
    assert got.accepted[got.quality == 0].mean() < 0.5
    none = quality.quality(docs, trusted.where("false")).agg(F.min(F.col("accepted").cast("int")), F.max("threshold")).first()
    assert tuple(none) == (1, None)
    odd = quality.quality(docs_of(spark, AWKWARD), spark.createDataFrame([(5,), (None,)], "doc_id long"))
    assert {r.doc_id for r in odd.where("not accepted").collect()} >= {0, 1}
    assert quality.quality(docs.where("false"), trusted).count() == 0


def test_grams_of_texts_with_very_many_kinds_of_characters():
    few, many = "ab🙂c", "".join(chr(c) for c in range(0x3400, 0x3400 + 70_000) if not 0xD800 <= c < 0xE000)
    for texts in ([few], [few, many, ""]):
        b, g, which, at = quality.grams_of(texts)
        codes = [[quality.PAD] * 3 + list(map(ord, t)) for t in texts]
        want = [(c[i], c[i + 1] << 42 | c[i + 2] << 21 | c[i + 3]) for c in codes for i in range(len(c) - 3)]
        assert [(int(b[k]), int(g[k])) for k in which] == want and at.tolist() == np.cumsum([0, *map(len, texts)]).tolist()
        assert len({*zip(b.tolist(), g.tolist(), strict=True)}) == len(b)


def test_quality_stage_judges_rows_one_by_one(spark):
    r = random.Random(9)
    make = lambda: " ".join(r.choice("the house and street with of people are in town".split()) for _ in range(80))
    junk = " ".join("".join(r.choice("qxzjkw%#") for _ in range(6)) for _ in range(60))
    rows = [(k, make(), "en", 0, 1) for k in range(60)] + [(None, make(), "en", 1, 1), (None, junk, "en", 2, 1), (50, junk, "en", 3, 1), (50, make(), None, 4, 1), (4, None, "en", 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity int, fold int")
    kept = quality.accepted(df, spark.range(40).withColumnRenamed("id", "doc_id"), quantile=1.0)
    assert kept.columns == df.columns and sorted({x.perplexity for x in kept.collect()}) == [0, 1, 4]
    assert quality.accepted(df.where("false"), spark.range(4).withColumnRenamed("id", "doc_id")).count() == 0


def test_quality_rejects_repeated_words(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels.where("quality = 1 AND toxic = 0").select("doc_id")).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id").toPandas()
    share = got.text.map(lambda t: len(set((t or "").split())) / max(20, len((t or "").split())))
    repeated = got[(got.quality == 0) & (share < 0.2) & (got.text.str.split().str.len() >= 20)]
    assert len(repeated) > 100 and repeated.accepted.mean() < 0.3
    assert got.accepted[got.quality == 0].mean() < 0.15 and got.accepted[got.quality == 1].mean() > 0.99


def test_quality_judges_trusted_texts_by_others(spark):
    """A text that no other resembles must not look clean because the model has learnt it by heart."""
    r = random.Random(6)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(300))
    texts = [make("abcd") for _ in range(30)] + [make("\u0436\u0437\u0438\u0439\u043a")]
    got = quality.quality(docs_of(spark, texts), spark.range(len(texts)).withColumnRenamed("id", "doc_id"), quantile=0.9).collect()
    assert {x.doc_id for x in got if not x.accepted} >= {30} and max(x.perplexity for x in got) > 50


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def plain_language(rows, texts):
    """The model and its predictions in plain Python."""
    letters = lambda t: regex.findall(r"\p{L}+", t.lower())
    langs = sorted({lang for _, lang in rows})
    counts = Counter((w, lang) for t, lang in rows for w in letters(t))
    grams = Counter()
    for (w, lang), n in counts.items():
        for k in range(1, 6):
            for i in range(len(w) + 3 - k):
                grams[f"^{w}$"[i : i + k], lang] += 1 + math.log(n)

    def logs(table):
        keys = {k for k, _ in table}
        total = {lang: sum(v for (_, x), v in table.items() if x == lang) for lang in langs}
        return {k: [math.log((table.get((k, lang), 0) + 0.1) / (total[lang] + 0.1 * len(keys))) for lang in langs] for k in keys}

    words, by_size = logs(counts), [logs({(g, x): v for (g, x), v in grams.items() if len(g) == k}) for k in range(6)]
    out = []
    for t in texts:
        own = letters(t or "")
        total = [0.0] * len(langs)
        for w in own:
            found = words.get(w)
            for k in range(5, 0, -1):
                if found is None:
                    kinds = [by_size[k][g] for i in range(len(w) + 3 - k) if (g := f"^{w}$"[i : i + k]) in by_size[k] and (k > 1 or g not in "^$")]
                    found = [sum(c) / len(c) for c in zip(*kinds, strict=True)] if kinds else None
            total = [x + y for x, y in zip(total, found or [0.0] * len(langs), strict=True)]
        share = [math.exp(x - max(total)) for x in total]
        out.append((langs[total.index(max(total))], max(share) / sum(share)) if own else ("und", 0.0))
    return out


def test_language_equals_a_plain_version(spark):
    r = random.Random(2)
    own = {"de": "schule haus straße für und nicht", "en": "school house street for and not", "es": "escuela casa calle año y no"}
    rows = [(" ".join(r.choice(words.split()) + r.choice(("", "s", "en", "ado")) for _ in range(12)), lang) for lang, words in own.items() for _ in range(6)]
    texts = [t for t, _ in rows] + ["schulhaus", "Streets!", "añada", "x", "日本語", "½ ² ①", "a½b", "Ⅷ", None, "", "12"]
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(language_id.predict(asked, language_id.fit(df)).collect())
    for x, (lang, score) in zip(got, plain_language(rows, texts), strict=True):
        assert (x.lang_pred, x.score) == (lang, pytest.approx(score, rel=1e-3)), texts[x.doc_id]
    assert {got[len(rows) + k].lang_pred for k in (5, 7, 8, 9, 10)} == {"und"} and got[len(rows) + 6].lang_pred != "und"
    assert got[len(rows) + 4].known == 0 and got[0].known == 1


def test_sample_of_any_share(spark):
    ids = spark.range(200_000)
    n = ids.where(sampled(F.col("id"), 0.01, "a")).count()
    assert 1800 < n < 2200
    both = ids.where(sampled(F.col("id"), 0.01, "a")).where(sampled(F.col("id"), 0.5, "b")).count()
    assert 0.4 * n < both < 0.6 * n
    assert ids.where(sampled(F.col("id"), 1.5, "a")).count() == 200_000
    for share in (9e-7, 1e-9, 1e-17):  # of more rows than a test can hold
        assert bound(share) + 2**63 == int(share * 2**64) > 0


def test_language_stage_judges_rows_one_by_one(spark):
    own = [(k, t, lang, 1) for k, (t, lang) in enumerate([("the house and the street", "en"), ("das haus und die straße", "de")] * 20)]
    odd = [(None, "the house and", "en", 2), (None, "12 345", "en", 3), (7, "日本語 テキスト", None, 4), (7, "das haus", None, 5), (8, None, "en", 6)]
    df = spark.createDataFrame(own + odd, "doc_id long, text string, lang string, known int")
    kept = language_id.with_language(df)
    assert kept.columns == df.columns and sorted(r.known for r in kept.collect() if r.known > 1) == [2, 5] and kept.count() == 42
    assert language_id.with_language(df.where("false")).count() == 0


def test_language_of_awkward_texts(spark):
    df = docs_of(spark, AWKWARD)
    got = {r.doc_id: r for r in language_id.language_id(df).collect()}
    assert len(got) == len(AWKWARD) and got[0].lang_pred == got[3].lang_pred == "und" and got[8].lang_pred == "en"
    unlabelled = language_id.language_id(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert language_id.language_id(df.where("false")).count() == 0


# the contract's digests


def test_digests(spark):
    from attestra.llm import queries

    r = queries.op7_chat_formatting(spark, SMALL).where("conv_id = -1").first()
    told = f"user\n{queries.CONTROL}\nassistant\n{queries.CONTROL}\n"
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, hashlib.sha256(told.encode()).hexdigest(), len(queries.CONTROL), hashlib.sha256(queries.CONTROL.encode()).hexdigest())
