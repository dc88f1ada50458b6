"""Line dedup over levelled sorted runs of line hashes.

A run holds (key, n): the digest of a normalised line and the number of documents
with it in one batch, sorted by key. New batches add level-0 runs; as soon as a
level holds FANOUT runs they merge into one run of the next level. Before a batch
adds its run, it is merge-anti-joined against the keys that the runs already show
in enough documents: those are settled and need no further counting.

Every line is trimmed, lower-cased and digested once: the digests of a text's lines
are written beside the text's own digest, and both the counting and the places of
the lines that go are read from there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, boxed, new_path, table, whole, written

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 3
FANOUT = 2
#: A key's lines are dealt over so many tasks when they meet the frequent keys, so that a line of a third of all documents isn't one task's.
SALTS = 8


def _trimmed(line: Column) -> Column:
    """The line without white space at its ends; most lines have none, which their first and last characters show."""
    space = lambda x: F.ascii(x).isin(*map(ord, SPACE))
    return F.when(space(line) | space(F.right(line, F.lit(1))), F.btrim(line, F.lit(SPACE))).otherwise(line)


def line_digest(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """A digest (string) of the line's key; null for a key of fewer than min_chars code points.

    Lower-casing the bytes of the UTF-8 form as Latin-1 letters lower-cases A-Z; it
    changes lead bytes of two-byte characters as well, into bytes that are told from
    those of longer characters by the number of bytes that follow, so distinct keys stay distinct.
    """
    key = _trimmed(line)
    ascii_only = F.octet_length(key) == F.char_length(key)
    lower = F.when(ascii_only, F.lower(key)).otherwise(F.lower(F.decode(F.encode(key, "utf-8"), "iso-8859-1")))
    return F.when(F.char_length(key) >= min_chars, F.md5(lower))


class LineRuns:
    """Runs of (key binary, n long) in levels, as Parquet in the shared folder, or in folder.

    With a folder, runs outlive the session: a manifest there names the runs of
    each level and the batches that they count, and is written after the runs. A
    batch that is named there already isn't counted again.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, folder: str | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout, self.folder = spark, fanout, folder
        self.levels: list[list[str]] = [[]]
        self.counted: dict[str, str | None] = {}
        if folder:
            lines = self._manifest().collect() if self._exists() else []
            if lines:
                state = max((json.loads(r[0]) for r in lines), key=lambda x: x["version"])
                self.levels, self.counted = state["levels"], dict(state["counted"])
        self.version = len(self.counted)

    def _path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")

    def _exists(self) -> bool:
        path = self._path()
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _manifest(self) -> DataFrame:
        return self.spark.read.text(f"{self.folder}/manifest")

    def _write(self, counts: DataFrame, level: int, number: int = 0) -> str:
        path = f"{self.folder}/run-l{level}-{self.version}-{number}" if self.folder else new_path(self.spark, f"line-run-l{level}")
        counts.select("key", "n").repartition("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("key binary, n bigint").parquet(*paths)

    def counts(self) -> DataFrame:
        """All runs merged: documents for each key."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "key binary, n bigint")
        return self._read(paths).groupBy("key").agg(F.sum("n").alias("n"))

    def settled(self, min_docs: int) -> DataFrame:
        return self.counts().where(F.col("n") >= min_docs).select("key")

    def holds(self, name: str, content: str | None) -> bool:
        """Whether a batch of this name has been counted; ValueError if that was of other content."""
        if name in self.counted and self.counted[name] != content:
            raise ValueError(f"other content has been counted as {name!r}")
        return name in self.counted

    def add(self, batch: DataFrame, min_docs: int, name: str | None = None, content: str | None = None) -> None:
        """batch: (key, n), one row for each key. A name that has been counted with this content is passed over; with another it is an error."""
        if name is not None and self.holds(name, content):
            return
        if any(self.levels):
            batch = batch.join(self.settled(min_docs), "key", "left_anti")
        self.version += 1
        levels = [[*x] for x in self.levels]
        levels[0].append(self._write(batch, 0))
        level = 0
        while len(levels[level]) >= self.fanout:
            merged = self._read(levels[level]).groupBy("key").agg(F.sum("n").alias("n"))
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(self._write(merged, level + 1))
            levels[level] = []
            level += 1
        self.levels = levels
        self.counted[name if name is not None else f"batch {self.version}"] = content
        if self.folder:
            state = json.dumps({"version": self.version, "levels": self.levels, "counted": self.counted})
            self.spark.range(1).select(F.lit(state)).coalesce(1).write.mode("append").text(f"{self.folder}/manifest")


def dedup_lines(
    docs: DataFrame, text_col: str = "text", *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: LineRuns | None = None, name: str | None = None
) -> DataFrame:
    """Every row with _n_lines, _n_dropped and its text without the lines found in min_docs rows or more.

    Each row counts as a document, repeated rows and ids too. A null or empty text
    is one empty line; an empty line has no key and stays. A text that loses every
    line becomes empty. Given earlier runs, their documents count as well; docs are
    then counted in them under name, by default a digest of their content: once,
    however often they are passed. Other documents under a used name are an error. All other columns pass through, whatever
    their names; _n_lines and _n_dropped are replaced. A frame without rows gives none.
    """
    spark = docs.sparkSession
    text = whole(F.col(text_col))
    digests = F.transform(F.split(text, "\n", -1), lambda x: line_digest(x, min_chars))
    hashed = written(docs.select(F.md5(text).alias("t"), digests.alias("keys")), "line-digests")
    keys = hashed.select("t", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key")).select("t", F.unhex("key").alias("key"))
    # batches by text digest: in one job, each key's documents of each batch
    batch = (F.conv(F.substring("t", 1, 4), 16, 10).cast("int") % batches).alias("batch")
    staged = written(keys.groupBy(batch, "key").agg(F.count(F.lit(1)).alias("n")), "line-batches", ["batch"])
    content = None
    if runs is None:
        runs, name = LineRuns(spark), "batch"
    else:
        seen = hashed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("t").cast("decimal(20,0)")).alias("s")).first()
        content = f"{seen['n']}-{seen['s'] or 0}"
        name = content if name is None else name
        for b in range(batches):
            runs.holds(f"{name} {b} of {batches}", content)
    for b in range(batches):
        runs.add(staged.where(F.col("batch") == b).select("key", "n"), min_docs, f"{name} {b} of {batches}", content)
    # a frequent key once for each salt; a text's lines take the salt of the text
    frequent = runs.settled(min_docs).select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lines = hashed.select("t", F.posexplode("keys").alias("place", "key")).where(F.col("key").isNotNull())
    lines = lines.select("t", "place", F.unhex("key").alias("key"), F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int").alias("salt"))
    # only texts with a frequent key get a list; copies of a text share it
    gone = lines.join(frequent, ["key", "salt"], "left_semi").groupBy("t").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    rows = docs.select(boxed(docs, text_col), F.md5(text).alias("t"), text.alias("text")).join(gone, "t", "left")
    size = F.size(F.split("text", "\n", -1)).cast("bigint")
    # every place with whether its line stays, in order: a hash set and a sort, however many lines go
    all_places = F.sequence(F.lit(0), size.cast("int") - 1)
    marked = lambda places, stays: F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(stays).alias("stays")))
    flags = F.sort_array(F.concat(marked(F.col("gone"), False), marked(F.array_except(all_places, "gone"), True)))
    zipped = F.zip_with(F.split("text", "\n", -1), flags, lambda x, f: F.struct(x.alias("x"), f["stays"].alias("stays")))
    kept = F.array_join(F.transform(F.filter(zipped, lambda z: z["stays"]), lambda z: z["x"]), "\n")
    names = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return rows.select(
        *[F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
        size.alias("_n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("_n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of ten documents or more: doc_id, n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line, which stays; repeated rows count and
    stay; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), m AS (
  SELECT k.rid, k.pos, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key
), g AS (
  SELECT rid, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM m GROUP BY rid
)
SELECT d.doc_id, g.n_lines, g.n_dropped, sha256(g.kept) AS kept_sha256 FROM d JOIN g ON d.rid = g.rid
"""
