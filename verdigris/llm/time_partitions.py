"""Adaptive time partitions: files that follow the calendar where rows are few and many.

ROLLUP counts every year, month, day and hour. A node above the limit is split into
all its children, empty ones included, which a self-join of the counts finds and the
calendar completes. Siblings, in order, are folded into runs that stay within the
limit; runs with rows are leaves. Rows meet their leaf by range. A leaf above the
limit (an hour, or the rows without a moment) is cut into parts by its rows' places,
which come from a range shuffle and the counts before each of its blocks.

A layout is rewritten in place: a file whose leaf, part and rows recur stays, the
others are written anew and the stale ones deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import kept_path, released, table, written

LEVELS = ("year", "month", "day", "hour")
#: The leaf of rows without a moment.
NO_MOMENT = "null"
#: (leaf, month) rows up to which the leaves are broadcast. Leaves are at most a few for each limit of rows, whatever the rows.
BROADCAST_LEAVES = 100_000

FILES = 800
KNOWN_BEFORE = "2024-04-01 00:00:00"


def node_counts(rows: DataFrame, moment: Column) -> DataFrame:
    """(parent, depth, child, n): the rows of every year (depth 0), month, day and hour that has some.

    parent is the path down to the node, such as 2024/03. Hours are counted first, so ROLLUP expands hours, not rows.
    """
    at = rows.select(moment.alias("at")).where("at IS NOT NULL")
    hours = at.groupBy(*[f(F.col("at")).alias(x) for f, x in zip((F.year, F.month, F.dayofmonth, F.hour), LEVELS, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    counts = hours.rollup(*LEVELS).agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).where("year IS NOT NULL")
    depth = F.when(F.col("g") == 7, 0).when(F.col("g") == 3, 1).when(F.col("g") == 1, 2).otherwise(3)
    padded = [F.lpad(F.col(x).cast("string"), 4 if x == "year" else 2, "0") for x in LEVELS]
    above = lambda n: F.concat_ws("/", *padded[:n])
    parent = F.when(F.col("g") == 7, F.lit("")).when(F.col("g") == 3, above(1)).when(F.col("g") == 1, above(2)).otherwise(above(3))
    return counts.select(parent.alias("parent"), depth.alias("depth"), F.coalesce("hour", "day", "month", "year").alias("child"), "n")


def _path(parent: Column, child: Column, depth: Column) -> Column:
    last = F.lpad(child.cast("string"), F.when(depth == 0, 4).otherwise(2), F.lit("0"))
    return F.when(depth == 0, last).otherwise(F.concat(parent, F.lit("/"), last))


def _part_of(path: str, i: int) -> str:
    return f"cast(split({path}, '/')[{i}] AS int)"


def runs_of(members: Column, limit: int) -> Column:
    """Folds siblings (child, n), in order, into runs (first, last, n, over): one within the limit joins the run before it if that stays within it."""
    run = "struct<first:int,last:int,n:bigint,over:boolean>"
    fresh = lambda x: F.array(F.struct(x["child"].alias("first"), x["child"].alias("last"), x["n"].alias("n"), (x["n"] > limit).alias("over")).cast(run))

    def step(runs: Column, x: Column) -> Column:
        before = F.get(runs, F.size(runs) - 1)
        joined = F.struct(before["first"].alias("first"), x["child"].alias("last"), (before["n"] + x["n"]).alias("n"), F.lit(False).alias("over")).cast(run)
        joins = ~before["over"] & (x["n"] <= limit) & (before["n"] + x["n"] <= limit)
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(joined))).otherwise(F.concat(runs, fresh(x)))

    return F.aggregate(members, F.array().cast(f"array<{run}>"), step)


def leaves(rows: DataFrame, moment: Column, limit: int) -> DataFrame:
    """(leaf, begins, ends, n, over) of every leaf with rows; ends is exclusive. A frame without moments has none."""
    nodes = written(node_counts(rows, moment), "time-nodes")
    years = nodes.where("depth = 0").agg(F.min("child").alias("low"), F.max("child").alias("high")).where("low IS NOT NULL")
    top = years.select(F.lit("").alias("parent"), F.lit(0).alias("depth"), F.explode(F.sequence("low", "high")).alias("child"))
    path = _path(F.col("parent"), F.col("child"), F.col("depth"))
    full = nodes.where((F.col("n") > limit) & (F.col("depth") < 3)).select(path.alias("parent"), (F.col("depth") + 1).alias("depth"))
    days = F.expr(f"dayofmonth(last_day(make_date({_part_of('parent', 0)}, {_part_of('parent', 1)}, 1)))")
    calendar = F.when(F.col("depth") == 1, F.sequence(F.lit(1), F.lit(12))).when(F.col("depth") == 2, F.sequence(F.lit(1), days)).otherwise(F.sequence(F.lit(0), F.lit(23)))
    members = top.unionByName(full.select("parent", "depth", F.explode(calendar).alias("child")))
    counted = members.join(nodes, ["parent", "depth", "child"], "left").select("parent", "depth", "child", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    siblings = counted.groupBy("parent", "depth").agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("members"))
    runs = siblings.select("parent", "depth", F.inline(runs_of(F.col("members"), limit))).where((F.col("n") > 0) & (~F.col("over") | (F.col("depth") == 3)))
    year, month, day = (_part_of("parent", i) for i in range(3))
    begins = F.expr(
        f"CASE depth WHEN 0 THEN make_timestamp_ntz(first, 1, 1, 0, 0, 0) WHEN 1 THEN make_timestamp_ntz({year}, first, 1, 0, 0, 0)"
        f" WHEN 2 THEN make_timestamp_ntz({year}, {month}, first, 0, 0, 0) ELSE make_timestamp_ntz({year}, {month}, {day}, first, 0, 0) END"
    )
    ends = F.expr(
        "CASE depth WHEN 0 THEN begins + make_ym_interval(last - first + 1, 0) WHEN 1 THEN begins + make_ym_interval(0, last - first + 1)"
        " WHEN 2 THEN begins + make_dt_interval(last - first + 1, 0, 0, 0) ELSE begins + make_dt_interval(0, last - first + 1, 0, 0) END"
    )
    label = F.concat(_path(F.col("parent"), F.col("first"), F.col("depth")), F.lit("-"), F.lpad(F.col("last").cast("string"), F.when(F.col("depth") == 0, 4).otherwise(2), F.lit("0")))
    found = runs.withColumn("begins", begins).withColumn("ends", ends)
    return written(found.select(label.alias("leaf"), "begins", "ends", "n", "over"), "time-leaves")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def _ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows with rank, the place (from 0) in the order within the leaf. Equal rows are dealt by where they were read, so any leaf spreads over all tasks."""
    keys = [F.col("leaf"), *order, F.col("read")]
    sorted_ = rows.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_ = written(sorted_.withColumn("place", F.monotonically_increasing_id()), "time-sorted")
    sorted_ = sorted_.withColumn("block", F.shiftright("place", 33))
    blocks = sorted_.groupBy("leaf", "block").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("leaf").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("leaf", "block", (F.coalesce(F.sum("k").over(earlier), F.lit(0)) - F.col("low")).alias("shift"))
    return sorted_.join(blocks.hint("merge"), ["leaf", "block"]).withColumn("rank", F.col("place") + F.col("shift"))


def placed(rows: DataFrame, moment: Column, limit: int, order: Sequence[str] = ()) -> DataFrame:
    """(row, moment, leaf, part): every row, as a struct, with its leaf and its part of at most limit rows, by moment, order and all columns."""
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), moment.alias("moment"))
    found = leaves(rows, moment, limit)
    months = found.select("leaf", "begins", "ends", "over", F.explode(F.sequence(_month(F.col("begins")), _month(F.expr("ends - INTERVAL '1' MICROSECOND")))).alias("month"))
    months = written(months, "time-months")
    met = keyed.where("moment IS NOT NULL").withColumn("month", _month(F.col("moment")))
    side = F.broadcast(months) if months.count() <= BROADCAST_LEAVES else months.hint("merge")
    met = met.join(side, (met["month"] == months["month"]) & (F.col("moment") >= F.col("begins")) & (F.col("moment") < F.col("ends"))).select("row", "moment", "leaf", "over")
    null = keyed.where("moment IS NULL")
    many = null.count() > limit
    met = met.unionByName(null.select("row", "moment", F.lit(NO_MOMENT).alias("leaf"), F.lit(many).alias("over")))
    by = [F.col("moment"), *[F.col("row")[c] for c in order], F.col("row")]
    one = met.where(~F.col("over")).select("row", "moment", "leaf", F.lit(1).cast("bigint").alias("part"))
    cut = _ranked(met.where("over").drop("over"), by).select("row", "moment", "leaf", (F.floor(F.col("rank") / limit) + 1).cast("bigint").alias("part"))
    return one.unionByName(cut)


def _folder_column(columns: Sequence[str]) -> str:
    """The name of the folders' column, which the table must not have."""
    name = "leaf"
    while name in columns:
        name += "_"
    return name


def _folder_of() -> Column:
    """2024/03-05, part 1, as 2024.03-05.1, which needs no escapes in a path."""
    return F.concat(F.replace("leaf", F.lit("/"), F.lit(".")), F.lit("."), F.col("part").cast("string"))


def _read(spark: SparkSession, folder: str, columns: Sequence[str], **made: Column) -> DataFrame:
    """(leaf, part, path, at, row, columns) and what is made of the table's columns, of the rows of a layout's files; at is the place in the file, columns the files' own."""
    name = _folder_column(columns)
    files = spark.read.parquet(folder)
    own = [c for c in files.columns if c != name]
    dotted = F.col(name).cast("string")
    leaf = F.replace(F.regexp_replace(dotted, r"\.[0-9]+$", ""), F.lit("."), F.lit("/"))
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    return files.select(leaf.alias("leaf"), F.regexp_extract(dotted, r"([0-9]+)$", 1).cast("bigint").alias("part"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), row, F.lit(",".join(own)).alias("columns"), *[c.alias(n) for n, c in made.items()])


def _holds_files(spark: SparkSession, folder: str, columns: Sequence[str]) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_folder_column(columns)}=*")
    return len(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []) > 0


def _contents(rows: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """Rows, and two sums over them that tell their multisets apart; the order in a file follows from its rows."""
    values = [F.col("row")[c] for c in columns]
    values += [v.isNull() for v in values]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*values).cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), *values)).alias("xor"))


def _delete(spark: SparkSession, paths: Iterator[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        where.getFileSystem(conf).delete(where, False)


def rewrite(rows: DataFrame, folder: str, moment: Column, limit: int, order: Sequence[str] = ()) -> DataFrame:
    """Lays rows out under folder, one Parquet file for each part of a leaf, and returns the files (leaf, part) that stayed.

    Rows stand by moment, the columns of order, and all columns, nulls first. A
    file of the folder stays if its leaf, part and rows recur; the others are
    deleted after the new ones are written, and no other data file is left. Repeated
    rows stay; a frame without rows leaves no file. Only names of stale files reach
    the driver: about one for each limit of rows, one after another.
    """
    spark, name = rows.sparkSession, _folder_column(rows.columns)
    laid = placed(rows, moment, limit, order)
    stays = stale = None
    if _holds_files(spark, folder, rows.columns):
        wanted = _contents(laid, rows.columns, "leaf", "part")
        present = written(_contents(_read(spark, folder, rows.columns), rows.columns, "leaf", "part", "path"), "time-present")
        stays = written(present.join(wanted, ["leaf", "part", "n", "sum", "xor"]).select("leaf", "part", "path"), "time-stays")
        stale = present.join(stays, "path", "left_anti").select("path")
        laid = laid.join(stays.select("leaf", "part"), ["leaf", "part"], "left_anti")
    by = [_folder_of(), F.col("moment"), *[F.col("row")[c] for c in order], F.col("row")]
    filed = laid.repartition("leaf", "part").sortWithinPartitions(*by)
    filed.select(*[F.col("row")[c].alias(c) for c in rows.columns], _folder_of().alias(name)).write.mode("append").partitionBy(name).parquet(folder)
    if stale is None:
        return spark.createDataFrame([], "leaf string, part bigint")
    _delete(spark, (r.path for r in stale.toLocalIterator()))
    return stays.select("leaf", "part")


def file_rows(spark: SparkSession, folder: str, columns: Sequence[str], id_col: str, known: Column) -> DataFrame:
    """(leaf, part, columns, path, ids_sha256, n_rows, n_new) of every file of a layout, as it stands.

    columns names the table's; those returned are the files' own. ids_sha256 is over
    the decimal ids in file order, comma-joined, a null id empty; n_new counts rows
    for which known isn't true. A file's rows stream through one task.
    """
    ship(spark)
    shape = "leaf string, part bigint, columns string, path string, ids_sha256 string, n_rows bigint, n_new bigint"
    if not _holds_files(spark, folder, columns):
        return spark.createDataFrame([], shape)
    rows = _read(spark, folder, columns, id=F.col(f"`{id_col}`").cast("string"), new=(~F.coalesce(known, F.lit(False))).cast("bigint"))
    paths = rows.groupBy("leaf", "part", "columns", "path").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("new").alias("n_new"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], ["leaf", "part", "ids_sha256"])
        for batch in batches:
            leaf, part, ids = (batch.column(c).to_pylist() for c in ("leaf", "part", "id"))
            low = 0
            for i in range(1, len(ids) + 1):
                if i < len(ids) and part[i] == part[low] and leaf[i] == leaf[low]:
                    continue
                if key == (leaf[low], part[low]):
                    digest.update(b",")
                else:
                    if key is not None:
                        yield emit()
                    key, digest = (leaf[low], part[low]), hashlib.sha256()
                digest.update(",".join(x or "" for x in ids[low:i]).encode())
                low = i
        if key is not None:
            yield emit()
        released()

    in_order = rows.select("leaf", "part", "at", "id").repartition("leaf", "part").sortWithinPartitions("leaf", "part", "at")
    return paths.join(in_order.mapInArrow(digests, "leaf string, part bigint, ids_sha256 string"), ["leaf", "part"]).select(*[c.split()[0] for c in shape.split(", ")])


def click_moment() -> Column:
    """ts; moved back by up to 25 years, or floored to its Monday, for some click_ids. Null where ts is; a null click_id moves nothing."""
    k = "crc32(cast(click_id AS string)) % 128"
    back = f"cast(pow({k} + 6, 3) AS int)"
    return F.expr(
        f"CASE WHEN {k} < 16 THEN cast(ts AS timestamp_ntz) - make_dt_interval({back}, 0, 0, 0)"
        f" WHEN {k} > 111 THEN cast(date_sub(cast(ts AS date), weekday(ts)) AS timestamp_ntz) ELSE cast(ts AS timestamp_ntz) END"
    )


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all clicks, laid out after those that arrived before April 2024: leaf, part, columns, path, ids_sha256, n_rows, n_new, rewritten.

    Rows without a moment have the leaf null; repeated rows stay; an empty table
    gives no file. The folder is a new one under spark.checkpoint.dir at every call and stays.
    """
    clicks = table(spark, sf_dir, "clicks")
    limit = 1 + clicks.count() // FILES
    folder = kept_path(spark, "time-partitions")
    known = F.col("arrived_at") < F.lit(KNOWN_BEFORE).cast("timestamp_ntz")
    order = ("arrived_at", "click_id")
    rewrite(clicks.where(known), folder, click_moment(), limit, order)
    stayed = rewrite(clicks, folder, click_moment(), limit, order)
    files = file_rows(spark, folder, clicks.columns, "click_id", known)
    marked = files.join(stayed.withColumn("stayed", F.lit(True)), ["leaf", "part"], "left")
    return marked.select(*files.columns, F.col("stayed").isNull().alias("rewritten"))
