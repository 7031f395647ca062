"""Text expressions: tokens, numbers in text, names, phrases, lines and file names. All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words and phrases that the rules count as empty of content.
STOP_WORDS = "a the is are of in on to for with and or but that this it from by at be was has had can will may not no do did what how which who when where why".split()
VAGUE_PHRASES = [
    "relatively good", "quite impressive", "worth considering", "fairly well", "somewhat better", "reasonably good", "fairly strong", "quite capable", "generally positive", "relatively mature",
    "比较优秀", "性能良好", "值得关注", "较为突出", "比较突出", "相对较好", "较为成熟", "相当不错", "比较强大", "较为完善", "比较稳定", "比较丰富",
]

_SPACE = r"\s　-〿＀-￯"
TOKEN = rf"(?U)[一-鿿]+|[^{_SPACE}一-鿿]+"
#: The ranges of CJK, Kana, Hangul and full-width characters that ask for an English title.
CJK = r"[⺀-⻿　-〿぀-ゟ゠-ヿ㄀-ㄯ㄰-㆏㐀-䶿一-鿿가-힯豈-﫿＀-￯]|[\x{20000}-\x{2FA1F}]"


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f's lambdas look at it (an outer expression inside a lambda is
    computed again for each element)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(c: Column) -> Column:
    """Runs of CJK characters, and other runs between white space and CJK punctuation."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def has_number(c: Column) -> Column:
    """A number that is no year 20xx, version vN.N or list ordinal."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)\b20[0-9]{2}\b", ""), r"(?iU)\bv\d+\.\d+", ""), r"(?mU)^\s*\d+\.", "")
    return rest.rlike(r"(?U)\b\d+(?:\.\d+)?\b")


def has_concrete_name(c: Column) -> Column:
    """A backtick span, a capitalised word inside a sentence, a sentence that begins Xxxx, or a CJK run of two or more that isn't a phrase of no content."""
    sentences = F.split(c, r"[.!?。！？]+")
    bare = lambda w: F.regexp_replace(w, r"^[,.;:!?()\[\]{}'\"]+|[,.;:!?()\[\]{}'\"]+$", "")

    def named(s: Column) -> Column:
        words = F.filter(F.split(F.trim(s), r"(?U)\s+"), lambda w: w != "")
        opening = bare(F.get(words, F.lit(0)))
        return F.coalesce(opening.rlike(r"^\p{Lu}\p{Ll}+$"), F.lit(False)) | F.exists(F.slice(words, 2, 100_000), lambda w: bare(w).rlike(r"(?s)^\p{Lu}."))

    runs = F.regexp_extract_all(c, F.lit("[一-鿿]{2,}"), F.lit(0))
    return c.rlike(r"`[^`]+`") | F.exists(sentences, named) | F.exists(runs, lambda r: ~r.isin([p for p in VAGUE_PHRASES if ord(p[0]) > 127]))


def occurrences(c: Column, phrase: str) -> Column:
    """How often the phrase stands in c, without overlaps."""
    return (F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)


def vague_density(c: Column) -> Column:
    """Occurrences of phrases of no content for each word; null without words."""
    low = F.lower(c)
    total = sum((occurrences(low, p) for p in VAGUE_PHRASES[1:]), occurrences(low, VAGUE_PHRASES[0]))
    return total / F.nullif(word_count(c), F.lit(0))


def phrase_density(c: Column, phrases: list[str]) -> Column:
    low = F.lower(c)
    return sum((occurrences(low, p) for p in phrases[1:]), occurrences(low, phrases[0])) / F.nullif(word_count(c), F.lit(0))


def file_name(c: Column, most: int = 200) -> Column:
    """Without characters that file systems refuse, blanks as _, at most ``most`` characters, never empty."""
    cut = F.regexp_replace(F.trim(c), r"[<>:\"/\\|?*：？！《》]", "")
    cut = F.substring(F.replace(F.regexp_replace(cut, r"[\r\n\t\f\x0B]+", ""), F.lit(" "), F.lit("_")), 1, most)
    return F.when(F.coalesce(cut, F.lit("")) == "", "untitled").otherwise(cut)


def ascii_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def overlong_lines(c: Column, most: int = 500) -> Column:
    return F.size(F.filter(lines(c), lambda x: F.length(x) > most))


def open_fence(c: Column) -> Column:
    """An odd number of lines begins a code fence."""
    return F.pmod(F.regexp_count(c, F.lit("(?m)^```")), F.lit(2)) == 1


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "“”", "''")


def labelled(labels: dict[tuple[str, str], str], key: Column, lang: Column) -> Column:
    """The label of (key, lang), else of (key, en), else the key itself."""
    table = F.create_map(*[F.lit(x) for (k, v), text in labels.items() for x in (f"{k}/{v}", text)])
    get = lambda of: F.try_element_at(table, F.concat_ws("/", key, of))
    return F.coalesce(get(lang), get(F.lit("en")), key)


def with_links(c: Column) -> Column:
    """\\n written out as a line break unless escaped; bare URLs as links, without the punctuation that follows."""
    broken = F.regexp_replace(c, r"(?<!\\)\\n", "\n")
    return F.regexp_replace(broken, r"(?<![(\[<\"'\w])(https?://[^\s<>()\[\]\"']+?)([.,;:!?]*)(?=\s|$)", "[$1]($1)$2")
