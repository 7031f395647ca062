"""Queries of the scalar functions, projections and filters, over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import dates, html, jsons, numbers, text, urls
from attestra.plans.registry import Tables, query

_SP = r"'^[\s]+|[\s]+$'"
_NORM = """
SELECT page_id, scheme || '://' || CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END
       || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS norm
FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
             regexp_replace(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/+$', '') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages)
"""


@query("F01_normalize_url", f"SELECT page_id, norm AS url_norm FROM ({_NORM})")
def f01(t: Tables):
    return t.pages.select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"))


@query("F02_url_hash", f"SELECT page_id, substr(sha256(norm), 1, 12) AS url_hash FROM ({_NORM})")
def f02(t: Tables):
    return t.pages.select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


@query("F03_host", "SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def f03(t: Tables):
    return t.pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query("F04_image_url", "SELECT page_id, 'https://img.example/' || page_id || '?wx_fmt=png&tp=webp' AS image FROM pages")
def f04(t: Tables):
    made = F.concat(F.lit("https://img.example/"), F.col("page_id"), F.lit("?tp=webp&amp;x=1&amp;wx_fmt=png#top"))
    return t.pages.select("page_id", urls.clean_image_url(made).alias("image"))


_REWRITES = [(r"^https?://m\.([^/]+)(.*)$", "https://$1$2"), (r"^https?://blog\.([^/]+)/(.*)$", "https://$1/blog/$2")]


@query(
    "F05_rewrite",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://m[.]') THEN regexp_replace(url, '^https?://m\.([^/]+)(.*)$', 'https://\1\2')
    WHEN regexp_matches(url, '^https?://blog\.([^/]+)/') THEN regexp_replace(url, '^https?://blog\.([^/]+)/(.*)$', 'https://\1/blog/\2') ELSE url END AS url_new FROM pages""",
)
def f05(t: Tables):
    return t.pages.select("page_id", urls.rewritten(F.col("url"), _REWRITES).alias("url_new"))


@query(
    "F06_preprint_html",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'https://example.org/' || doc_id ELSE 'https://ar5iv.labs.arxiv.org/html/2401.' || doc_id END AS url_new FROM documents",
)
def f06(t: Tables):
    kinds = [F.concat(F.lit("https://arxiv.org/abs/2401."), "doc_id"), F.concat(F.lit("https://arxiv.org/pdf/2401."), "doc_id", F.lit(".pdf")), F.concat(F.lit("https://example.org/"), "doc_id")]
    made = F.when(F.col("doc_id") % 3 == 0, kinds[0]).when(F.col("doc_id") % 3 == 1, kinds[1]).otherwise(kinds[2])
    return t.documents.select("doc_id", urls.preprint_html(made).alias("url_new"))


@query(
    "F07_repository_readme",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https://github.com/o/r' || doc_id || '/blob/main/README.md' ELSE 'https://github.com/o/r' || doc_id || '/issues' END AS url_new FROM documents",
)
def f07(t: Tables):
    base = F.concat(F.lit("https://github.com/o/r"), "doc_id")
    return t.documents.select("doc_id", urls.repository_readme(F.when(F.col("doc_id") % 2 == 0, base).otherwise(F.concat(base, F.lit("/issues")))).alias("url_new"))


@query("F08_without_preview", "SELECT page_id, url AS url_new FROM pages")
def f08(t: Tables):
    return t.pages.select("page_id", urls.without_preview(F.regexp_replace("url", "://", "://preview-")).alias("url_new"))


_BASE = "regexp_extract(url, '^([^?#]*)', 1)"


@query(
    "F09_links",
    f"""SELECT page_id, link AS href, CASE WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
    ELSE regexp_replace(CASE WHEN {_BASE} = regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) THEN {_BASE} || '/' ELSE {_BASE} END, '[^/]*$', '') || link END AS resolved
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS link FROM pages)""",
)
def f09(t: Tables):
    found = t.pages.select("page_id", "url", F.explode(html.links(F.col("html"))).alias("href"))
    return found.select("page_id", "href", urls.resolved(F.col("url"), F.col("href")).alias("resolved"))


_TOKENS = r"regexp_extract_all(text, '[一-鿿]+|[^\s　-〿＀-￯一-鿿]+')"


@query("F10_tokens", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, sha256(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def f10(t: Tables):
    w = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.sha2(F.array_join(w, " ").cast("binary"), 256).alias("digest"))


@query("F11_has_cjk", "SELECT lang, count(*) FILTER (regexp_matches(text, '[⺀-⻿　-〿぀-ヿ㄀-㆏㐀-䶿一-鿿가-힯豈-﫿＀-￯]')) AS n FROM documents GROUP BY lang")
def f11(t: Tables):
    return t.documents.groupBy("lang").agg(F.count(F.when(text.has_cjk(F.col("text")), 1)).alias("n"))


@query("F12_non_ascii", r"SELECT lang, count(*) FILTER (regexp_matches(text, '[^\x00-\x7F]')) AS n FROM documents GROUP BY lang")
def f12(t: Tables):
    return t.documents.groupBy("lang").agg(F.count(F.when(text.non_ascii(F.col("text")), 1)).alias("n"))


@query("F13_word_count", f"SELECT lang, CAST(sum(len({_TOKENS})) AS BIGINT) AS words FROM documents GROUP BY lang")
def f13(t: Tables):
    return t.documents.groupBy("lang").agg(F.sum(text.word_count(F.col("text"))).cast("long").alias("words"))


@query(
    "F14_has_number",
    r"""SELECT doc_id, regexp_matches(regexp_replace(regexp_replace(regexp_replace(text, '\b20[0-9]{2}\b', '', 'g'), '(?i)\bv\d+\.\d+', '', 'g'), '(?m)^\s*\d+\.', '', 'g'), '\b\d+(?:\.\d+)?\b') AS has_number
    FROM documents""",
)
def f14(t: Tables):
    return t.documents.select("doc_id", text.has_number(F.col("text")).alias("has_number"))


@query(
    "F15_concrete_name",
    r"""SELECT doc_id, regexp_matches(text, '`[^`]+`') OR len(list_filter(string_split_regex(text, '[.!?。！？]+'), lambda s:
      regexp_matches(trim(regexp_replace(coalesce(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')[1], ''), '^[,.;:!?()\[\]{}''"]+|[,.;:!?()\[\]{}''"]+$', '', 'g')), '^\p{Lu}\p{Ll}+$')
      OR len(list_filter(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')[2:], lambda w: regexp_matches(regexp_replace(w, '^[,.;:!?()\[\]{}''"]+|[,.;:!?()\[\]{}''"]+$', '', 'g'), '(?s)^\p{Lu}.'))) > 0)) > 0 AS named
    FROM documents""",
)
def f15(t: Tables):
    return t.documents.select("doc_id", text.has_concrete_name(F.col("text")).alias("named"))


@query(
    "F16_slug",
    r"""SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id,
    substr(replace(regexp_replace(regexp_replace(trim(text), '[<>:"/\\|?*：？！《》]', '', 'g'), '[\r\n\t\f\v]+', '', 'g'), ' ', '_'), 1, 200) AS s FROM documents)""",
)
def f16(t: Tables):
    return t.documents.select("doc_id", text.file_name(F.col("text")).alias("slug"))


@query("F17_ascii_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def f17(t: Tables):
    return t.part.select("p_partkey", text.ascii_slug(F.col("p_name")).alias("slug"))


@query("F18_post_process", "SELECT page_id, '[' || url || '](' || url || ').' || chr(10) || 'x' AS body FROM pages")
def f18(t: Tables):
    return t.pages.select("page_id", text.with_links(F.concat("url", F.lit(".\\nx"))).alias("body"))


@query("F19_preview", "SELECT doc_id, substr(text, 1, 40) AS preview FROM documents")
def f19(t: Tables):
    return t.documents.select("doc_id", F.left("text", F.lit(40)).alias("preview"))


#: Display labels by language.
LABELS = {
    ("sources", "en"): "Sources", ("sources", "zh"): "数据来源", ("references", "en"): "References", ("references", "zh"): "参考文献",
    ("test_conditions", "en"): "Test Conditions", ("test_conditions", "zh"): "测试环境", ("claim", "en"): "Claim", ("claim", "zh"): "声明",
    ("conditions", "en"): "Conditions", ("conditions", "zh"): "条件", ("date", "en"): "Date", ("date", "zh"): "日期",
    ("source_type", "en"): "Source Type", ("source_type", "zh"): "来源类型", ("methodology", "en"): "Methodology", ("methodology", "zh"): "方法论",
    ("key_insights", "en"): "Key Insights", ("key_insights", "zh"): "核心发现", ("tensions", "en"): "Tensions", ("tensions", "zh"): "张力",
    ("verification_summary", "en"): "Verification Summary", ("verification_summary", "zh"): "验证摘要",
    ("decision_questions", "en"): "Decision Questions Answered", ("decision_questions", "zh"): "决策问题回答",
}


@query(
    "F20_label",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Sources' WHEN 1 THEN '参考文献' ELSE 'unknown' END AS label FROM documents",
)
def f20(t: Tables):
    key = F.when(F.col("doc_id") % 3 == 0, "sources").when(F.col("doc_id") % 3 == 1, "references").otherwise("unknown")
    lang = F.when(F.col("doc_id") % 3 == 1, "zh").otherwise("fr")
    return t.documents.select("doc_id", text.labelled(LABELS, key, lang).alias("label"))


@query("F21_overlong", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 500)) AS BIGINT) AS overlong FROM documents")
def f21(t: Tables):
    return t.documents.select("doc_id", text.overlong_lines(F.col("text")).cast("long").alias("overlong"))


@query("F22_open_fence", "SELECT doc_id, doc_id % 2 = 1 AS open_fence FROM documents")
def f22(t: Tables):
    fenced = F.concat(F.expr("repeat('```\\nx\\n', CAST(doc_id % 4 AS INT))"), F.col("text"))
    return t.documents.select("doc_id", text.open_fence(fenced).alias("open_fence"))


@query("F25_straight_quotes", "SELECT doc_id, sha256(chr(39) || replace(replace(text, '“', chr(39)), '”', chr(39)) || chr(39)) AS digest FROM documents")
def f25(t: Tables):
    return t.documents.select("doc_id", F.sha2(text.straight_quotes(F.concat(F.lit("“"), "text", F.lit("”"))).cast("binary"), 256).alias("digest"))


# The dialect has no look-around: each character that is no part of a word is doubled, so that a match may take one at either end.
_W = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_PLAIN = rf"(?:^|[^{_W}])(\d{{1,3}}(?:,,\d{{3}})*|\d+)(?:\s*(?:%|ms|req//s|req//sec|MB|GB|x|times\s+faster))?(?:$|[^{_W}])"
_BIG, _SPAN = r"\$?(\d+(?:\.\d+)?)\s*[Bb](?:illion)?", r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*%"


@query(
    "F26_numbers",
    rf"""WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '([^{_W}])', '\1\1', 'g'), '{_PLAIN}', 1), lambda x: replace(x, ',', '')) AS p,
      regexp_extract_all(text, '{_BIG}', 1) AS b, regexp_extract_all(text, '{_SPAN}', 1) AS lo, regexp_extract_all(text, '{_SPAN}', 2) AS hi FROM documents),
    n AS (SELECT doc_id, list_distinct(list_concat(list_transform(p, lambda x: regexp_replace(x, '^0+(\d)', '\1')), p, list_transform(b, lambda x: CAST(CAST(CAST(x AS DOUBLE) * 1000000000 AS DECIMAL(38, 0)) AS VARCHAR)),
      list_transform(b, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR) || 'B'), lo, hi)) AS l FROM f)
    SELECT doc_id, CAST(len(l) AS BIGINT) AS n, coalesce(array_to_string(list_sort(l), ' '), '') AS numbers FROM n""",
)
def f26(t: Tables):
    found = numbers.number_set(F.col("text"))
    return t.documents.select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(F.sort_array(found), " ").alias("numbers"))


@query(
    "F28_durations",
    """SELECT l_orderkey, l_linenumber, CAST(s AS DOUBLE) AS seconds, (s // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
    FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 5) * 3600 + (l_suppkey % 60) * 60 + CAST(l_quantity AS BIGINT) % 60 AS s FROM lineitem)""",
)
def f28(t: Tables):
    s = (F.col("l_partkey") % 5) * 3600 + (F.col("l_suppkey") % 60) * 60 + F.col("l_quantity").cast("long") % 60
    written = t.lineitem.select("l_orderkey", "l_linenumber", numbers.clock(s).alias("clock"))
    return written.select("l_orderkey", "l_linenumber", numbers.seconds(F.col("clock")).alias("seconds"), "clock")


@query(
    "F30_page_ranges",
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_size + p_partkey % 4 + 1), [CAST(p_partkey % 9 AS BIGINT)]))), ',') AS pages FROM part",
)
def f30(t: Tables):
    written = F.concat(F.col("p_size"), F.lit("-"), F.col("p_size") + F.col("p_partkey") % 4, F.lit(", "), F.col("p_partkey") % 9)
    return t.part.select("p_partkey", F.array_join(numbers.page_ranges(written), ",").alias("pages"))


@query(
    "F31_review_due",
    """SELECT user_id, (n > 0) AND (last IS NULL OR date_diff('day', last, DATE '2024-01-31') >= 7) AS due
    FROM (SELECT user_id, max(CAST(ts AS DATE)) AS last, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY user_id)""",
)
def f31(t: Tables):
    users = t.events.groupBy("user_id").agg(F.max(F.to_date("ts")).cast("string").alias("last"), F.count(F.when(F.col("event_type") == "click", 1)).alias("n"))
    return users.select("user_id", dates.review_due(F.col("last"), F.col("n"), F.lit("2024-01-31").cast("date")).alias("due"))


@query("F32_archivable", "SELECT event_id, event_id % 3 <> 2 AND CAST(ts AS DATE) < DATE '2024-01-20' AS archivable FROM events")
def f32(t: Tables):
    word = F.when(F.col("event_id") % 3 == 0, "ACTIONED").when(F.col("event_id") % 3 == 1, "Declined").otherwise("OPEN")
    status = F.concat(word, F.lit(" ("), F.date_format("ts", "yyyy-MM-dd"), F.lit(")"))
    return t.events.select("event_id", dates.archivable(status, F.lit("2024-01-20").cast("date")).alias("archivable"))


@query(
    "F33_cooldown",
    "SELECT user_id, count(*) FILTER (date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 1) AS ready, count(*) AS total FROM events GROUP BY user_id",
)
def f33(t: Tables):
    ready = dates.off_cooldown(F.to_date("ts"), F.lit("2024-01-31").cast("date"))
    return t.events.groupBy("user_id").agg(F.count(F.when(ready, 1)).alias("ready"), F.count("*").alias("total"))


@query("F34_numeric_keys", "SELECT event_id, CAST(event_id AS VARCHAR) || ',' || (event_id + 1) AS keys FROM events")
def f34(t: Tables):
    made = F.format_string('{"initialState":{"entities":{"answers":{"%d":{},"x":{},"%d":{}}}}}', "event_id", F.col("event_id") + 1)
    return t.events.select("event_id", F.array_join(jsons.numeric_keys(made, "$.initialState.entities.answers"), ",").alias("keys"))


@query("F35_json_field", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def f35(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


@query("F35_envelope", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE props END AS content, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'piped' END AS tool_used FROM events")
def f35b(t: Tables):
    raw = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("content"), F.lit("web").alias("tool_used")))).otherwise(F.col("props"))
    return t.events.select("event_id", jsons.envelope(raw).alias("e")).select("event_id", "e.content", "e.tool_used")


@query("F36_json_repair", "SELECT event_id, event_type || ' \"' || event_id || '\" said' AS a FROM events")
def f36(t: Tables):
    broken = F.format_string('{"a": "%s "%d" said", "b": [1, 2]}', "event_type", "event_id")
    return t.events.select("event_id", jsons.parsed_or_repaired(broken, "a string, b array<int>")["a"].alias("a"))


@query("F37_cjk_quotes", "SELECT event_id, event_type AS a FROM events")
def f37(t: Tables):
    broken = F.concat(F.lit('{"a": "'), F.col("event_type"), F.lit('", "b": "x'), F.lit("“y” "), F.lit('"z" w"}'))
    return t.events.select("event_id", jsons.parsed_or_repaired(broken, "a string, b string")["a"].alias("a"))


_S39 = "regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<nav\\b[^>]*>.*?</nav>', '', 'g'), '(?is)<footer\\b[^>]*>.*?</footer>', '', 'g'), '(?is)<aside\\b[^>]*>.*?</aside>', '', 'g')"


@query("F39_strip_blocks", f"SELECT page_id, {_S39.format('html')} AS html FROM pages")
def f39(t: Tables):
    return t.pages.select("page_id", html.without_blocks(F.col("html")).alias("html"))


_EXTRA = "chr(10) || '# A' || chr(10) || 'We use cookies here' || chr(10) || '## Comments' || chr(10) || 'spam' || chr(10) || '## End' || chr(10) || 'Home > News > Item' || chr(10) || 'share on twitter now' || chr(10)"


@query("F40_clean", f"SELECT page_id, regexp_replace({_S39.format('html')}, '^\\s+|\\s+$', '', 'g') || chr(10) || '# A' || chr(10) || '## End' || chr(10) AS cleaned FROM pages")
def f40(t: Tables):
    extra = "\n# A\nWe use cookies here\n## Comments\nspam\n## End\nHome > News > Item\nshare on twitter now\n"
    return t.pages.select("page_id", html.cleaned(F.concat(html.without_blocks(F.col("html")), F.lit(extra))).alias("cleaned"))


def _noise_sql(c: str) -> str:
    for p in html.NOISE:
        c = f"regexp_replace({c}, '(?is){p}', '', 'g')"
    return c


@query("F41_noise", f"SELECT page_id, {_noise_sql('html')} AS html FROM pages")
def f41(t: Tables):
    return t.pages.select("page_id", html.without_noise(F.col("html")).alias("html"))


def _markdown_sql(c: str) -> str:
    c = _noise_sql(c)
    for p, to in html.STEPS:  # without look-ahead, which this dialect lacks and pages without img don't need
        p, to = p.replace("(?:(?!<img).)*?", ".*?").replace("'", "''"), to.replace("$1", "\\1").replace("'", "''")
        c = f"regexp_replace({c}, '(?s){p}', '{to}', 'g')"
    c = f"regexp_replace({c}, '(?s)<a[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>', '[\\2](\\1)', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("F42_html_to_md", f"SELECT page_id, {_markdown_sql('html')} AS markdown FROM pages")
def f42(t: Tables):
    return html.with_markdown(t.pages, "html", "markdown").select("page_id", "markdown")


@query("F43_image", """SELECT page_id, '![a](https://i.example/' || page_id || '.png){width="600"}' || chr(10) || chr(10) || 'x' AS markdown FROM pages""")
def f43(t: Tables):
    made = F.concat(F.lit('<p><img alt="a" src="data:image/svg" data-src="https://i.example/'), F.col("page_id"), F.lit('.png?w=3"></p><img src="data:x"><p>x</p>'))
    return html.with_markdown(t.pages.select("page_id", made.alias("html")), "html", "markdown").select("page_id", "markdown")


@query(
    "F44_article_md",
    f"""SELECT page_id, '# ' || title || chr(10) || chr(10) || '**来源：** ' || url || chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown AS article
    FROM (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, {_markdown_sql('html')} AS markdown FROM pages)""",
)
def f44(t: Tables):
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return html.with_markdown(t.pages, "html", "markdown").select("page_id", html.article(title, F.col("url"), F.col("markdown")).alias("article"))


@query(
    "F45_phase",
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'review' WHEN doc_id % 5 = 0 THEN 'scope' WHEN doc_id % 3 = 0 THEN 'search' WHEN doc_id % 2 = 0 THEN 'analysis' ELSE 'review' END AS phase FROM documents",
)
def f45(t: Tables):
    from attestra.operators.pipeline import phase

    d = F.col("doc_id")
    return t.documents.select("doc_id", phase(F.when(d % 7 == 0, "review").when(d % 11 == 0, "nonsense"), d % 5 != 0, d % 3 != 0, d % 2 != 0).alias("phase"))


# projections and filters


@query("P02_key_alias", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, props) AS summary FROM events")
def p02(t: Tables):
    from attestra.operators.sanitize import aliased

    made = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("summary"), F.col("props").alias("text"))
    return aliased(made, {"text": "summary"}).select("event_id", "summary")


#: Raw values of a claim's enumerations, and what each becomes.
_ENUM_ROWS = {
    "evidence_type": "official_data official_data independent_benchmark independent_benchmark third_party_estimate third_party_estimate qualitative_trend qualitative_trend expert_opinion expert_opinion blog third_party_estimate post third_party_estimate article third_party_estimate opinion expert_opinion commentary expert_opinion independent_test independent_benchmark rumour qualitative_trend Blog qualitative_trend",
    "confidence": "high high medium medium low low sure medium HIGH medium",
    "precision": "exact exact range range qualitative qualitative about qualitative",
    "source_type": "official_report official_report independent_test independent_test production_case production_case survey survey vendor_benchmark vendor_benchmark analyst_forecast analyst_forecast vendor_survey vendor_survey vendor_blog vendor_blog independent_benchmark independent_test benchmark independent_test official official_report production production_case peer_reviewed_study official_report peer_reviewed_paper official_report peer_reviewed_technical_report official_report academic_paper official_report technical_report official_report research_paper official_report industry_analysis analyst_forecast industry_guide analyst_forecast news_report analyst_forecast government_media analyst_forecast expert_quoted_in_media analyst_forecast official_repository vendor_blog official_documentation vendor_blog official_pricing_page vendor_blog company_disclosure_via_journalist vendor_blog encyclopedia survey platform_data survey international_organization_report survey tweet survey",
}


def _nth(words: list[str], k: str = "o_orderkey") -> str:
    return "list_value(" + ", ".join(f"'{w}'" for w in words) + f")[{k} % {len(words)} + 1]"


@query("P03_enum_coerce", "SELECT o_orderkey, " + ", ".join(f"{_nth(v.split()[1::2])} AS {c}" for c, v in _ENUM_ROWS.items()) + " FROM orders")
def p03(t: Tables):
    from attestra.operators.sanitize import enumerated

    pick = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("o_orderkey") % len(words)).cast("int"))
    return enumerated(t.orders.select("o_orderkey", *[pick(v.split()[::2]).alias(c) for c, v in _ENUM_ROWS.items()]))


@query(
    "P04_precision_downgrade",
    "SELECT o_orderkey, CASE WHEN (o_orderkey + o_custkey) % 3 = 0 AND o_orderkey % 5 IN (2, 3, 4) THEN 'range' ELSE list_value('exact', 'range', 'qualitative')[(o_orderkey + o_custkey) % 3 + 1] END AS pr FROM orders",
)
def p04(t: Tables):
    from attestra.operators.sanitize import downgraded
    from attestra.plans.fixture import claims

    return claims(t).select(F.col("cid").alias("o_orderkey"), downgraded(F.col("pr"), F.col("ev")).alias("pr"))


@query(
    "P05_source_filter",
    """SELECT cid, array_to_string(list_sort(CASE WHEN len(list_filter(s, lambda x: x % 4 = 0)) > 0 THEN list_filter(s, lambda x: x % 4 = 0) ELSE s END), ',') AS sources
    FROM (SELECT l_orderkey AS cid, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1)""",
)
def p05(t: Tables):
    from attestra.operators.sanitize import known_sources

    own = t.lineitem.groupBy(F.col("l_orderkey").alias("cid")).agg(F.collect_set("l_suppkey").alias("s"))
    return own.select("cid", F.array_join(F.sort_array(known_sources(F.col("s"), lambda x: x % 4 == 0)), ",").alias("sources"))


@query("P06_default_fill", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'standard') AS depth, 'general' AS audience FROM documents")
def p06(t: Tables):
    from attestra.operators.sanitize import filled

    made = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("depth"), F.lit(None).cast("string").alias("audience"))
    return filled(made, {"depth": "standard", "audience": "general"})


@query("P07_topic_retrieve", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') AND source = 'src0'")
def p07(t: Tables):
    return t.documents.where((F.col("source") == "src0") & F.contains(F.lower("text"), F.lit("thing"))).select("doc_id")


@query("P08_directions", "SELECT doc_id, lower(trim(source)) AS direction FROM documents WHERE trim(source) <> ''")
def p08(t: Tables):
    from attestra.operators.sanitize import directions

    made = t.documents.select("doc_id", directions(F.array(F.concat(F.lit(" "), F.upper("source")), F.lit("  "), F.lit(None).cast("string"))).alias("d"))
    return made.select("doc_id", F.explode("d").alias("direction"))


@query("P09_membership", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS valid, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS invalid FROM orders GROUP BY 1")
def p09(t: Tables):
    ok = F.col("o_orderstatus").isin("F", "O")
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("invalid"))


@query("P10_keyword_any", "SELECT source, count(*) FILTER (regexp_matches(lower(text), 'license|copyright|however')) AS n FROM documents GROUP BY source")
def p10(t: Tables):
    return t.documents.groupBy("source").agg(F.count(F.when(F.lower("text").rlike("license|copyright|however"), 1)).alias("n"))


@query("P11_pending_by_group", "SELECT source, count(*) AS pending FROM documents WHERE doc_id % 9 <> 0 AND (n_chars < 200 OR doc_id % 4 = 0) GROUP BY source")
def p11(t: Tables):
    from attestra.operators.sanitize import pending

    d = t.documents.select("source", (F.col("doc_id") % 9 == 0).alias("failed"), F.when((F.col("doc_id") % 4 != 0) & (F.col("n_chars") >= 200), F.col("n_chars")).alias("chars"))
    return pending(d, F.col("failed"), F.col("chars"), "source")


@query("P12_article_urls", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/\d+\.html') OR regexp_matches(url, '/de/\d+$')")
def p12(t: Tables):
    return t.pages.where(F.col("url").rlike(r"/(en|fr)/\d+\.html") | F.col("url").rlike(r"/de/\d+$")).select("page_id", "url")


@query("P13_recent_folder", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 10")
def p13(t: Tables):
    return t.events.where(dates.recent_folder(F.date_format("ts", "yyyyMMdd"), F.lit("2024-01-31").cast("date"), 10)).select("event_id")


@query("P14_skip_untyped", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY event_type")
def p14(t: Tables):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.lit("not json"))
    return t.events.where(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT")).groupBy("event_type").agg(F.count("*").alias("n"))
