"""Labels that headings give to the pages after them, and names listed under a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a page names its programme, how a row names a direction's, and how an information block lists a category's programmes.
PAGE_HEADING = r"([“”一-鿿A-Za-z（）()]+?专业(?:[（(][^）)]*方向[）)])?)\s*20\d{2}\s*级本科人才培养方案"
ROW_HEADING = r"方向[一二三四五六七八九十]+[：:]?(.+?专业)核心"
LISTED_CODE = r"(?<!\d)\d{6}[A-Za-z]{0,3}\s*[-—]\s*"
LISTED_END = r"学科门类|授予学位|专业代码|标准学制|计划学制|毕业|学分统计|实践教学"
BLOCK_BEGIN = r"专业代码\s*[:：]"
BLOCK_END = r"标准学制|计划学制|毕业(?:最低)?学分|学分统计"
BETWEEN_NAMES = r"[/、，,]"
NAME_EDGES = " ,，、;/；"
CATEGORY = r"类(?:[（(][^）)]*[）)])?$"
STEM_TAIL = r"专业人才培养方案$|人才培养方案$"
CJK = r"[一-鿿]"


def clean(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("　"), F.lit(" ")), r"\s+", " "))


def candidates(pages: DataFrame, by: list[str], page: str, text: str, pattern: str = PAGE_HEADING, priority: int = 0) -> DataFrame:
    """(by, page, label, place, priority): every heading of every page, in order. Empty ones don't count; a null text has none."""
    found = pages.select(*by, page, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1))).alias("place", "_label"))
    return found.select(*by, page, clean(F.col("_label")).alias("label"), "place", F.lit(priority).alias("priority")).where("label <> ''")


def page_labels(found: DataFrame, by: list[str], page: str) -> DataFrame:
    """One row for each page with candidates: label, contested.

    The least priority counts, then the first place. Where one place and priority
    has different labels, from two sources, none can be told to be right: the label
    is null and contested is true.
    """
    keyed = found.groupBy(*by, page, "priority", "place").agg(F.collect_set("label").alias("_l"))
    first = keyed.groupBy(*by, page).agg(F.min(F.struct("priority", "place", "_l")).alias("_m"))
    return first.select(*by, page, F.when(F.size("_m._l") == 1, F.get("_m._l", F.lit(0))).alias("label"), (F.size("_m._l") > 1).alias("contested"))


def label_intervals(labels: DataFrame, last_pages: DataFrame, by: list[str], page: str, last_page: str) -> DataFrame:
    """(by, label, first_page, last_page): a label holds up to the page before the next other one.

    A contested page ends the interval before it and has no label itself. labels:
    page_labels(); last_pages: the last page of each document. Pages before the
    first heading have no label. A document's headings are one window, as its pages are one file.
    """
    in_order = Window.partitionBy(*by).orderBy(page)
    turns = labels.withColumn("_new", ~F.coalesce(F.col("label").eqNullSafe(F.lag("label").over(in_order)) & F.lag(F.lit(True)).over(in_order), F.lit(False)))
    turns = turns.where("_new").withColumn("_next", F.lead(page).over(in_order))
    out = turns.join(last_pages.select(*by, F.col(last_page).alias("_last")), by)
    return out.where(F.col("label").isNotNull()).select(*by, "label", F.col(page).alias("first_page"), F.coalesce(F.col("_next") - 1, "_last").alias("last_page"))


def settled(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by, page, label, agreed) of the pages of intervals (by, label, first_page, last_page, priority) of several sources.

    Of overlapping intervals the least priority counts; agreed tells whether every
    source that covers the page has that label. Equal priorities with different labels leave the page out.
    """
    each = intervals.select(*by, F.explode(F.sequence("first_page", "last_page")).alias("page"), "label", "priority").distinct()
    best = each.groupBy(*by, "page").agg(F.min("priority").alias("_p"), (F.count_distinct("label") == 1).alias("agreed"))
    met = each.join(best, [*by, "page"]).where(F.col("priority") == F.col("_p"))
    one = met.groupBy(*by, "page").agg(F.min("label").alias("label"), F.max("label").alias("_other"), F.first("agreed").alias("agreed"))
    return one.where(F.col("label") == F.col("_other")).select(*by, "page", "label", "agreed")


def direction_major(heading: Column) -> Column:
    """The programme that a row's heading of a direction names; null if it names none."""
    name = clean(F.regexp_extract(heading, ROW_HEADING, 1))
    return F.when(name != "", name)


def listed_names(text: Column, *, code: str = LISTED_CODE, end: str = LISTED_END, has: str = CJK, between: str | None = None, begin: str | None = None, stop: str | None = None) -> Column:
    """The names after each code, in order, each once: what stands up to the next code or a label.

    between splits a name at lists' marks; begin and stop bound the block that is
    read, if they occur. Parts without a character of has don't count; null has none.
    """
    text = F.coalesce(text, F.lit(""))
    if begin:
        text = F.array_join(F.slice(F.split(text, begin, 2), -1, 1), "")
    if stop:
        text = F.get(F.split(text, stop, 2), F.lit(0))
    parts = F.split(text, code, -1)
    after = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.get(F.split(x, end, 2), F.lit(0)))
    if between:
        after = F.flatten(F.transform(after, lambda x: F.split(x, between, -1)))
    trimmed = F.transform(after, lambda x: F.btrim(F.trim(F.btrim(x, F.lit(NAME_EDGES))), F.lit(NAME_EDGES)))
    return F.array_distinct(F.filter(trimmed, lambda x: x.rlike(has)))


def category_majors(article: Column, text: Column, **rules) -> Column:
    """An article's programmes: of a category those that its block lists, of another its own stem."""
    stem = F.trim(F.regexp_replace(article, STEM_TAIL, ""))
    names = listed_names(text, **rules)
    return F.when(stem.rlike(CATEGORY) & (F.size(names) > 0), names).otherwise(F.array(stem))
