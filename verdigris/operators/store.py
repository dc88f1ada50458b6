"""The trust store and the academic store: scopes, primaries, queries, neighbours, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.subjects import matches_subjects
from ..functions.terms import leading_semester, semester_values
from ..functions.text import compact_strict, clean_course_name, content_hash, text_of

# Fixed values of the data model.
CURRENT, HISTORIC = "现行", "历史"
SCHOOL, COLLEGE = "校级", "院级"
ALL_COHORTS = "不限"
REQUIRED, ELECTIVE, FREE_ELECTIVE, DIRECTION = "必修", "选修", "自由选修", "专业方向"
HEADER_PRIORITY = 1000


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def scope_predicate(college: str | None = None, cohort: str | None = None, year: int | None = None, topic: str | None = None) -> Column:
    """Which sources may answer. Terms without a parameter are left out of the plan.

    Without a year, current sources and those of the very cohort, whatever their
    status; with one, that year's. A college sees its own and the school's sources.
    """
    status = F.col("year") == year if year is not None else (F.col("status") == CURRENT) | (F.col("cohort") == cohort if cohort is not None else F.lit(False))
    terms = [F.col("enabled"), F.col("trusted"), status]
    if college is not None:
        terms.append((F.col("level") == SCHOOL) | (F.col("college") == college))
    if cohort is not None:
        terms.append(F.col("cohort").isin(ALL_COHORTS, cohort))
    if topic is not None:
        terms.append(F.col("topic") == topic)
    return every(terms)


def scoped(chunks: DataFrame, sources: DataFrame, source_key: str = "source_id", **scope) -> DataFrame:
    """Chunks of the sources in scope. The filter runs on the sources, before the join; Catalyst broadcasts them if they are few."""
    return chunks.join(sources.where(scope_predicate(**scope)), source_key)


def official_links(sources: DataFrame, *, college: str | None = None, cohort: str | None = None, topic: str | None = None, year: int | None = None, limit: int = 3) -> DataFrame:
    """Links for a scope: the college's first, newest first. Unlike scope_predicate, a historic source of the cohort doesn't count."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    terms = [F.col("enabled"), F.col("trusted"), F.col("status") == CURRENT if year is None else F.col("year") == year]
    if college is not None:
        terms.append((F.col("level") == SCHOOL) | (F.col("college") == college))
    if cohort is not None:
        terms.append(F.col("cohort").isin(ALL_COHORTS, cohort))
    if topic is not None:
        terms.append(F.col("topic") == topic)
    return sources.where(every(terms)).orderBy(F.when(F.col("level") == COLLEGE, 0).otherwise(1), F.desc("year"), "doc_title").limit(limit)


def with_state(sources: DataFrame, states: DataFrame, key: str = "source_id") -> DataFrame:
    """Trust flags with an overlay (key, trusted, enabled) on top; null flags of the overlay leave the source's own."""
    over = states.select(key, F.col("trusted").alias("_t"), F.col("enabled").alias("_e"))
    return sources.join(over, key, "left").withColumns({"trusted": F.coalesce("_t", "trusted"), "enabled": F.coalesce("_e", "enabled")}).drop("_t", "_e")


def primary(rows: DataFrame, keys: list[str], order: list[Column], flag: str = "is_primary") -> DataFrame:
    """Marks exactly one row of each key, the first in order; the order must tell all rows apart."""
    return rows.withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def keep_first(rows: DataFrame, keys: list[str | Column], seq: list[str | Column]) -> DataFrame:
    """The first row of each key by seq. Ties don't occur if seq is unique."""
    window = Window.partitionBy(*keys).orderBy(*seq)
    return rows.withColumn("_first", F.row_number().over(window)).where("_first = 1").drop("_first")


def page_ordinal(rows: DataFrame, keys: list[str], seq: list[str], out: str = "source_row") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*seq)))


def canonical_chunks(chunks: DataFrame, text: str, order: list[Column], id_col: str) -> DataFrame:
    """content_hash, and the id of the canonical chunk of equal content, first in order."""
    hashed = chunks.withColumn("content_hash", content_hash(F.col(text)))
    window = Window.partitionBy("content_hash").orderBy(*order)
    return hashed.withColumn("canonical_id", F.first(id_col).over(window)).withColumn("is_primary", F.col("canonical_id") == F.col(id_col))


def course_query(offerings: DataFrame, *, semesters: list[int] | None = None, elective: bool | None = None, code: str | None = None) -> DataFrame:
    """Offerings by semester set (ranges count for each of their semesters), elective or required, and code; in listing order."""
    terms = []
    if semesters:
        terms.append(F.arrays_overlap(semester_values(F.col("semester")), F.array(*map(F.lit, semesters))))
    if elective is not None:
        terms.append(F.col("course_nature").contains(ELECTIVE) | F.col("module").contains(DIRECTION) if elective else F.col("course_nature").contains(REQUIRED))
    if code:
        terms.append(F.upper("course_code") == code.upper())
    # the key is a column: Spark works an expression out again, for both rows, at every comparison of a sort
    keyed = offerings.where(every(terms)).withColumn("_leading", leading_semester(F.col("semester")))
    return keyed.orderBy(F.col("_leading").asc_nulls_first(), "module", "course_code", "course_name").drop("_leading")


def name_match(rows: DataFrame, name: str, column: str = "course_name") -> DataFrame:
    """Rows whose compact name is the wanted one or, if there are none, contains it or lies in it."""
    own = compact_strict(clean_course_name(F.col(column)))
    want = compact_strict(F.lit(name))
    tier = F.when(own == want, 1).when((F.instr(own, want) > 0) | (F.instr(want, own) > 0), 2)
    tiered = rows.withColumn("_tier", tier).where(F.col("_tier").isNotNull())
    best = tiered.agg(F.min("_tier").alias("_best"))  # one row
    return tiered.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best")


def nature_predicate(natures: list[str]) -> Column:
    """An elective also counts by a module of directions; a free elective by its module."""
    if not natures:
        return F.lit(True)
    nature, module = text_of(F.col("course_nature")), text_of(F.col("module"))
    terms = []
    for n in natures:
        terms.append(nature.contains(n))
        if n == ELECTIVE:
            terms.append(module.contains(DIRECTION))
        if n == FREE_ELECTIVE:
            terms.append(module.contains(FREE_ELECTIVE))
    return any_of(terms)


def module_predicate(modules: list[str]) -> Column:
    if not modules:
        return F.lit(True)
    short = lambda c: F.replace(compact_strict(c), F.lit("课程"), F.lit("课"))
    own = short(F.col("module"))
    return any_of([(F.instr(own, short(F.lit(m))) > 0) | (F.instr(short(F.lit(m)), own) > 0) for m in modules])


def course_filter(rows: DataFrame, *, semesters=(), codes=(), names=(), natures=(), modules=(), exclude_modules=(), subjects=(), subject_col: str = "subjects") -> DataFrame:
    """All conditions at once; empty ones don't count. They stay Columns, so Catalyst pushes what it can to the scan."""
    terms = []
    if semesters:
        terms.append(F.arrays_overlap(semester_values(F.col("semester")), F.array(*map(F.lit, semesters))))
    if codes:
        terms.append(F.upper(text_of(F.col("course_code"))).isin([c.upper() for c in codes]))
    if names:
        own = compact_strict(clean_course_name(F.col("course_name")))
        terms.append(any_of([(F.instr(own, compact_strict(F.lit(n))) > 0) | (F.instr(compact_strict(F.lit(n)), own) > 0) for n in names]))
    terms += [nature_predicate(list(natures)), module_predicate(list(modules))]
    if exclude_modules:
        terms.append(~module_predicate(list(exclude_modules)))
    if subjects:
        terms.append(matches_subjects(F.col(subject_col), list(subjects)))
    return rows.where(every(terms))


def neighbours(rows: DataFrame, anchors: DataFrame, keys: list[str], place: str, radius: int) -> DataFrame:
    """Rows within radius places of an anchor with the same keys: an equi join on the keys and the place's block, then the distance.

    Each anchor meets its own block and the two beside it, so a hot key is split by place.
    """
    width = 2 * radius + 1
    left = anchors.select(*keys, F.col(place).alias("anchor"), F.explode(F.array(*[F.floor(F.col(place) / width) + d for d in (-1, 0, 1)])).alias("_block"))
    right = rows.withColumn("_block", F.floor(F.col(place) / width))
    return right.join(left, [*keys, "_block"]).where(F.abs(F.col(place) - F.col("anchor")) <= radius).drop("_block")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def resolve_sources(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """For each wanted (want_id, title, cohort, url): exact, else title and cohort, else title; best priority, then file.

    wanted joins on title alone; the tier decides among what meets, so no cross join.
    """
    met = wanted.join(sources.select(F.col("doc_title").alias("title"), F.col("cohort").alias("s_cohort"), F.col("page_url").alias("s_url"), "file", "priority"), "title")
    tier = F.when((F.col("cohort") == F.col("s_cohort")) & (F.col("url") == F.col("s_url")), 1).when(F.col("cohort") == F.col("s_cohort"), 2).otherwise(3)
    ranked = met.withColumn("tier", tier).withColumn("_n", F.row_number().over(Window.partitionBy("want_id").orderBy("tier", F.desc("priority"), "file")))
    return ranked.where("_n = 1").select("want_id", "tier", "file")
