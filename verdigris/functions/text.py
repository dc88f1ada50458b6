"""Text columns: compaction, tokens, fingerprints, pages and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation that the listed compaction removes; page labels in article names; tokens; what is cut from course names.
LISTED_PUNCTUATION = r"[\s·•，,。；;：:（）()《》\[\]【】\-_/]+"
PAGE_LABEL = r"原文件第\d+页|第\d+页表格"
FILE_PAGE = r"原文件第(\d+)页"
PAGE = r"第(\d+)页"
LATIN_TOKEN = r"[a-z]+\d*|\d+(?:\.\d+)?%?"
CJK_RUN = r"[一-鿿]+"
COURSE_TAG = r"^\[[A-Za-z]\d+\]"
ENGLISH_TAIL = r"\s+[A-Z][A-Za-z]{2,}(?:\s|$)"
INNER_SPACE = r"(?<=[一-鿿])\s+(?=[一-鿿])"
LETTER_TAIL = r"(?<=[一-鿿）)])\s+[A-Za-z](?:\s+[A-Za-z]{1,3})?$"
COURSE_EDGES = " |，,;；"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once for each row. Elsewhere Spark computes it anew at each place within a higher-order function, and there for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_of(value: Column) -> Column:
    """Null reads as the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def compact_listed(value: Column) -> Column:
    """Without the listed punctuation and white space, lower-cased."""
    return F.lower(F.regexp_replace(text_of(value), LISTED_PUNCTUATION, ""))


def compact_strict(value: Column) -> Column:
    """ASCII letters and digits and CJK ideographs alone, lower-cased."""
    return F.lower(F.regexp_replace(text_of(value), r"[^0-9A-Za-z一-鿿]+", ""))


def compact_roman(value: Column) -> Column:
    """compact_strict with Roman numeral signs spelled in ASCII first."""
    out = text_of(value)
    for sign, letters in (("Ⅰ", "I"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV"), ("Ⅴ", "V")):
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return compact_strict(out)


def tokens(text: Column) -> Column:
    """Latin words and numbers, then for each CJK run its bigrams and its characters, with repeats."""
    low = F.lower(text_of(text))
    latin = F.regexp_extract_all(low, F.lit(f"({LATIN_TOKEN})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"({CJK_RUN})"), F.lit(1))

    def grams(run: Column) -> Column:
        n = F.char_length(run)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(pairs, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1))))

    return F.concat(latin, F.flatten(F.transform(runs, grams)))


def token_set(text: Column) -> Column:
    """Distinct tokens in order of first appearance, CJK as bigrams alone (a run of one stands for itself)."""
    low = F.lower(text_of(text))
    latin = F.regexp_extract_all(low, F.lit(f"({LATIN_TOKEN})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"({CJK_RUN})"), F.lit(1))

    def pairs(run: Column) -> Column:
        n = F.char_length(run)
        return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array(run))

    return F.array_distinct(F.concat(latin, F.flatten(F.transform(runs, pairs))))


def body(text: Column) -> Column:
    """After the first line, or all of a single line."""
    return F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.char_length(text))).otherwise(text)


def content_hash(text: Column) -> Column:
    """SHA-256 of the body without page labels and white space, lower-cased."""
    plain = F.regexp_replace(F.regexp_replace(body(text_of(text)), PAGE_LABEL, ""), r"\s+", "")
    return F.sha2(F.lower(plain), 256)


def alnum_fingerprint(text: Column) -> Column:
    """Letters and digits of the body without page labels, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(body(text_of(text)), PAGE_LABEL, ""), r"[^\p{L}\p{N}]+", ""))


def article_page(article: Column) -> Column:
    """The file page if named, else the page, else null."""
    first, second = F.regexp_extract(article, FILE_PAGE, 1), F.regexp_extract(article, PAGE, 1)
    return F.when(first != "", first.cast("int")).when(second != "", second.cast("int"))


def source_id(key: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(key, 256), 1, 24))


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; empty if the URL isn't absolute http(s)."""
    return F.lower(F.regexp_extract(text_of(url), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def in_domain(url: Column, domain: str) -> Column:
    """The host is the domain or below it."""
    host = host_of(url)
    return (host == domain) | host.endswith("." + domain)


def clean_course_name(name: Column) -> Column:
    """Without a leading [A1] tag, an English tail, spaces between CJK characters and stray edge marks."""
    out = F.trim(F.regexp_replace(F.trim(text_of(name)), COURSE_TAG, ""))
    out = F.element_at(F.split(out, ENGLISH_TAIL, 2), 1)
    out = F.regexp_replace(out, INNER_SPACE, "")
    out = F.regexp_replace(out, LETTER_TAIL, "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(COURSE_EDGES))


#: Topics by the terms that name them, first match first.
TOPICS = (
    ("promotion", ("推荐免试", "推免", "保研")),
    ("curriculum", ("培养方案", "课程设置")),
    ("course_selection", ("选课操作", "选课指南")),
    ("transfer", ("转专业", "专业分流")),
    ("academic_status", ("学籍", "重修", "休学", "转学")),
    ("assessment", ("考试", "缓考", "考核")),
    ("credit", ("学分认定", "课程免修", "辅修")),
    ("thesis", ("毕业论文", "毕业设计")),
)
DEFAULT_TOPIC = "school_policy"


def topic_of(title: Column, text: Column, topics=TOPICS, default: str = DEFAULT_TOPIC) -> Column:
    """The first topic with a term in the title or the text's first 1,000 characters."""
    searched = F.concat(text_of(title), F.lit("\n"), F.substring(text_of(text), 1, 1000))
    out = F.lit(default)
    for name, terms in reversed(topics):
        hit = F.lit(False)
        for term in terms:
            hit = hit | searched.contains(term)
        out = F.when(hit, name).otherwise(out)
    return out
