"""Expressions against plain Python on small and awkward inputs."""

import hashlib
import re
import time
from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.functions import dates, html, jsons, numbers, text, urls


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").select("o").collect()]


def normal(url):
    p = urlparse(url.strip())
    query = urlencode(sorted(parse_qs(p.query, keep_blank_values=True).items()), doseq=True) if p.query else ""
    return urlunparse((p.scheme.lower(), p.netloc.lower().removeprefix("www."), p.path.lower().rstrip("/") or "/", p.params, query, ""))


URLS = [
    "HTTPS://WWW.Example.com/A/B/?b=2&a=1#x", "http://example.com", "http://example.com?z=&a=%20x&a=b", "https://e.com/p;v=1?q=a+b", "//host/x//", "relative/Path/", "", " https://e.com/ ",
    "https://e.com/a?x=~*&y=ü", "https://user@e.com:80/", "mailto:a@b.c", "https://e.com/?q",
]


def test_normalize_url(spark):
    assert column(spark, URLS, urls.normalize_url) == [normal(u) for u in URLS]


def test_url_hash_golden(spark):
    got = column(spark, URLS, urls.url_hash)
    assert got == [hashlib.sha256(normal(u).encode()).hexdigest()[:12] for u in URLS]


def test_resolved(spark):
    base = "https://e.com/a/b?q=1#f"
    links = ["c", "/c", "//o.com/x", "https://z.org/", "?p=2", "#g", "", "c/d?x"]
    got = column(spark, links, lambda c: urls.resolved(F.lit(base), c))
    assert got == [urljoin(base, x) if x else base for x in links]


def test_special_sites(spark):
    assert column(spark, ["https://arxiv.org/abs/2401.1", "https://arxiv.org/pdf/2401.1.pdf", "https://x.org/"], urls.preprint_html) == ["https://ar5iv.labs.arxiv.org/html/2401.1"] * 2 + ["https://x.org/"]
    assert column(spark, ["https://github.com/o/r", "https://github.com/o/r/tree/x"], urls.repository_readme) == ["https://github.com/o/r/blob/main/README.md", "https://github.com/o/r/tree/x"]


def py_tokens(s):
    out, run = [], ""
    kind = lambda ch: "c" if "一" <= ch <= "鿿" else " " if ch.isspace() or "　" <= ch <= "〿" or "＀" <= ch <= "￯" else "w"
    last = " "
    for ch in s:
        k = kind(ch)
        if k != last and run:
            out.append(run)
            run = ""
        if k != " ":
            run += ch
        last = k
    return out + [run] if run else out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab 1.,中文。　！\n\té", max_size=30), min_size=1, max_size=20))
def test_tokens(spark, texts):
    assert column(spark, texts, text.tokens) == [py_tokens(s) for s in texts]


PRECISE = re.compile(r"(?<!\w)(\d{1,3}(?:,\d{3})*|\d+)(\s*(%|ms|req/s|req\/sec|MB|GB|x|times faster))?(?!\w)")


@pytest.mark.parametrize("s, own", [("it has 1,234 ms and 5%", {"1234", "5"}), ("é42 x42", set()), ("$3.5 billion", {"3500000000", "3.5B", "5", "3"}), ("10–20 %", {"10", "20"}), ("none", set())])
def test_number_set(spark, s, own):
    got = set(column(spark, [s], numbers.number_set)[0])
    plain = {m.group(1).replace(",", "") for m in PRECISE.finditer(s)}
    assert plain <= got and own - {"5", "3"} <= got


def test_supported(spark):
    df = spark.createDataFrame([("a 5 b", "x 5"), ("no number", ""), ("7", "8")], "c string, s string")
    assert [r[0] for r in df.select(numbers.supported(F.col("c"), F.col("s"))).collect()] == [True, True, False]


def test_durations_and_ranges(spark):
    assert column(spark, ["1:02:03", "4:05", "7", "x"], numbers.seconds) == [3723.0, 245.0, 7.0, None]
    assert column(spark, ["1-3,5", "2, 2", "9-7", ""], numbers.page_ranges) == [[1, 2, 3, 5], [2], [], []]


def test_names_and_numbers(spark):
    assert column(spark, ["in 2024 v1.2\n 1. x", "costs 5", "2023 only"], text.has_number) == [False, True, False]
    assert column(spark, ["we like Spark here", "Apple falls", "AAA", "`code`", "all lower", "性能良好", "阿里云"], text.has_concrete_name) == [True, True, False, True, False, False, True]


def test_file_names(spark):
    assert column(spark, ["a b/c:d", "  ", "x" * 300, "?"], text.file_name) == ["a_bcd", "untitled", "x" * 200, "untitled"]


def test_bare_links(spark):
    assert column(spark, ["see https://e.com/x. Now", "[a](https://e.com)", "a\\nb", "a\\\\nb"], text.with_links)[:3] == ["see [https://e.com/x](https://e.com/x). Now", "[a](https://e.com)", "a\nb"]


def test_json_repair(spark):
    raw = ['{"a": "he said "hi" there", "b": [1]}', '{"a": "ok"}', '{"a": “x”}', "nonsense"]
    got = column(spark, raw, lambda c: jsons.parsed_or_repaired(c, "a string")["a"])
    assert got[:2] == ['he said "hi" there', "ok"]


def test_dates(spark):
    asof = F.lit("2024-01-31").cast("date")
    assert column(spark, ["20240125", "20240101", "x"], lambda c: dates.recent_folder(c, asof, 10)) == [True, False, False]
    assert column(spark, ["ACTIONED 2024-01-01", "OPEN 2024-01-01", "declined"], lambda c: dates.archivable(c, asof)) == [True, False, False]
    assert column(spark, ["2024-01-30", "2024-01-01", "never", None], lambda c: dates.review_due(c, F.lit(1), asof)) == [False, True, True, True]


PAGES = [
    ("<p>a <b>b</b></p><ul><li>x</li></ul>", "a **b**\n\n- x"),
    ('<pre class="language-py">x &lt; 1<br>y</pre><p>t</p>', "```py\nx < 1\ny\n```\nt"),
    ('<pre><code class="lang-js">let a = "&eacute;&nbsp;b" &amp;&amp; c;\n\n\nd</code></pre> then <code>x <b>y</b></code><pre>two</pre>', '```js\nlet a = "é b" && c;\n\nd\n```\n then `x y`\n```\ntwo\n```'),
    ('<p>x</p><img src="https://i/a?tp=1&w=2" alt="A"><img src="https://i/a?tp=1" alt="B">', 'x\n\n![A](https://i/a?tp=1){width="600"}'),
    ('<strong>a<img src="https://i/x.png">b</strong><img data-src="https://q/1.png" src="data:image/gif"><img src="data:x" alt="gone">', 'a\n![image](https://i/x.png){width="600"}\nb\n![image](https://q/1.png){width="600"}'),
    ('<img src="https://q/2.png?wx_fmt=png&amp;w=1&amp;tp=webp#f" alt="">', '![](https://q/2.png?wx_fmt=png&tp=webp){width="600"}'),
    ('<img src="">z<img src="a?x=1&tp=&tp=2">', 'z\n![image](a){width="600"}'),
    ('<a href="https://e.com">e</a> <div class="ad">no</div>', "[e](https://e.com)"),
    ("<h2>T</h2><p>a<br>b &amp; c</p><ol><li>1</li></ol>", "## T\n\na\nb & c\n\n- 1"),
    ("<section><em>x</em></section>", "*x*"),
    ("<p>a</p>\n\n\n\n<p>b</p>", "a\n\nb"),
    ("", ""),
    (None, None),
]


def test_markdown(spark):
    got = column(spark, [p for p, _ in PAGES], html.to_markdown)
    for (page, want), g in zip(PAGES, got, strict=True):
        assert g == want, page


def test_markdown_of_a_table(spark):
    """The same, each step once in the plan, and Python only for the bodies of pre elements with character references."""
    df = html.with_markdown(spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PAGES)], "k int, page string"), "page", "md")
    assert [r.md for r in df.orderBy("k").collect()] == [want for _, want in PAGES]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mp_profile_popup") == 1 and plan.count("</strong>") == 1 and df.columns == ["k", "page", "md"]


def test_numbers_as_written(spark):
    values = [0.0, 0.5, 1.0, 12.25, 9999999.9, 1e7, 90433955.0, 123456789.125, 1e15, 999999999999999.9, 1e16, 1.25e16, 1e22, 1.5e300, 0.001, 0.00099, 0.0001, 0.00005, 1.5e-7, 2.0**-40]
    assert column(spark, values, numbers.written, "double") == [repr(v) for v in values]
    got = column(spark, ["costs 90433955 B", "$1.5 billion", "7" * 60 + "B"], lambda c: F.sort_array(numbers.number_set(c)))
    assert got[0] == sorted(["90433955", "90433955000000000", "90433955.0B"])
    assert got[1] == sorted(["1", "5", "1500000000", "1.5B"])  # whole numbers are split at the dot
    assert got[2] == [repr(float("7" * 60)) + "B"]


def test_image_lines_and_sections_of_long_texts(spark):
    image = '![a](https://i/%d){width="600"}'
    rows = ["\n".join([image % (k % 7) for k in range(3000)] + ["", "x", image % 99]), None, "", "no"]
    assert column(spark, rows, html.distinct_image_lines) == ["\n".join([image % k for k in range(7)] + ["", "x", image % 99]), None, "", "no"]
    texts = ["a\n## Comments\nx", "## Comments", "#Comments\nx\n# A", "a\n\n## discussion\n## Comments\nq\n#### z\n", "# A\n## Comments \nx\n# B\n", "## Comments\nx\n\n" * 2000 + "# End", None]
    assert column(spark, texts, lambda c: html.without_sections(c, html.COMMENTS)) == ["a", "", "# A", "a\n", "# A\n# B\n", "# End", None]


def test_clean(spark):
    raw = "<nav>n</nav># T\nbody\n## Comments\nx\n### y\nz\n## Related articles\nq\n# End\nfin\nWe use cookies ok\n"
    assert column(spark, [raw, "", "<nav>x</nav>"], html.cleaned) == ["# T\nbody\n### y\nz\n# End\nfin\n", "", ""]


def test_tail_cut(spark):
    body = "\n".join(["marker"] + ["x"] * 40 + ["", "marker here", "end"])
    assert column(spark, [body, "no"], lambda c: html.tail_cut(c, ["marker"])) == ["\n".join(["marker"] + ["x"] * 40), "no"]


def test_large_billions_keep_all_digits_and_are_written_short(spark):
    typed = ["4699858775519183", "80132626729", "9225426587", "36798284236820097.351548928", "9007199.254740993", "4513576820916823721", "26018159083.1", "98765432109876543210987654321"]
    got = column(spark, [f"{t}B" for t in typed], numbers.number_set)
    for t, own in zip(typed, got, strict=True):
        assert str(int(float(t) * 1e9)) in own and f"{float(t)!r}B" in own
    values = [2.2257118259684278e18, 36798284236820100.0, 6.385838955974974e18, 2.0**53, 2.0**54 + 4, 5.288314366764021e18, 9999999999999999.0, 1e23, float("inf")]
    assert column(spark, values, numbers.written, "double") == [repr(v) for v in values]


def test_lines_without_the_words_are_not_tried_at_each_place(spark):
    long = "y" * 90
    odd = [None, "", "\n", "we use cookies", "a\n\nGDPR", f"{long} accept cookies {long}\nnext", f"{long} gdpr\nshare on weibo {long}\r\nz\n", "x\r\nWE USE COOKIES\r\ny", f"gdpr gdpr {long} gdpr\u2028q\n分享到微信\n", "k\n隐私政策"]
    for pattern, words in ((html.COOKIES, html.COOKIE_WORDS), (html.SOCIAL, html.SOCIAL_WORDS)):
        assert column(spark, odd, lambda c, p=pattern, w=words: html.without_matches(c, p, w)) == column(spark, odd, lambda c, p=pattern: F.regexp_replace(c, p, ""))
    # a page of 20 million characters: the patterns tried at each place take some minutes
    page = spark.range(1).select(F.concat(F.lit("# A\n"), F.repeat(F.lit("plain words of a line\n"), 900_000), F.lit("We use cookies\n")).alias("c"))
    began = time.monotonic()
    assert page.select(F.length(html.without_matches(html.without_matches(F.col("c"), html.COOKIES, html.COOKIE_WORDS), html.SOCIAL, html.SOCIAL_WORDS))).first()[0] == 4 + 22 * 900_000
    assert time.monotonic() - began < 60
