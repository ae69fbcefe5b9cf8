"""Line dedup with levelled sorted runs of line hashes.

Each batch of documents is folded to its distinct line hashes, with the number of documents and the largest document id
that hold each. A merge anti-join with the earlier runs tells new lines from known ones: new lines are written as the
batch's run, so that no two runs hold the same line, and known lines as updates of their counts. Runs and updates are
bucketed and sorted by hash, so these joins move no run. When a level holds `fanout` runs, they are merged into
one run of the next level, so that n batches are spread over a logarithmic number of runs.

A line hash is two 64-bit hashes with different seeds, 128 bits together.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.shared import BLANKS, ascii_lower, let, scratch, stored, table

HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, text, row): sig tells rows apart that repeat an id with another text, row has all columns."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("sig"), "text", F.struct("*").alias("row"))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, sig, pos, h1, h2) of each line whose key has at least `min_chars` code points."""
    lines = docs.select("doc_id", "sig", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    bare = lines.select("doc_id", "sig", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
    key = ascii_lower(F.col("line"))
    return bare.where(F.length("line") >= min_chars).select(
        "doc_id", "sig", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")
    )


class LineRuns:
    """Levelled sorted runs of line hashes, and updates of their counts, below one shared folder.

    A store that `save` has committed is opened again by its location, with the number of buckets it was made with.
    """

    SCHEMA = "h1 BIGINT, h2 BIGINT, n_docs BIGINT, last_id BIGINT"
    LOG = "version STRING, kind STRING, level INT, path STRING, buckets INT"
    KINDS = ("runs", "updates")

    def __init__(self, spark: SparkSession, location: str | None = None, fanout: int = 4, buckets: int = 48):
        self.spark = spark
        self.location = location or scratch(spark, "line-runs")
        self.fanout, self.buckets = fanout, buckets
        self.tables: dict[str, str] = {}  # catalog name of each path
        self.levels: dict[str, list[list[str]]] = {kind: [] for kind in self.KINDS}
        for row in self._newest() if location else []:
            levels = self.levels[row.kind]
            levels += [[] for _ in range(row.level + 1 - len(levels))]
            levels[row.level].append(row.path)
            self.buckets = row.buckets

    def _newest(self) -> list:
        """The newest entry of the log; none where the store is new."""
        try:
            log = self.spark.read.schema(self.LOG).parquet(f"{self.location}/log")
            return log.where(F.col("version") == log.agg(F.max("version")).scalar()).orderBy("path").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def save(self) -> None:
        """Commit the present runs by one appended log entry; readers see the old or the new set whole. The
        entry that was written last counts; a writer has to open the store that it adds to."""
        version = f"{self.spark.sql('SELECT unix_micros(now()) AS v').first().v:020d}-{uuid.uuid4().hex}"
        rows = [(version, kind, k, path, self.buckets) for kind in self.KINDS for k, paths in enumerate(self.levels[kind]) for path in paths]
        self.spark.createDataFrame(rows, self.LOG).coalesce(1).write.mode("append").parquet(f"{self.location}/log")

    def discard(self) -> None:
        """Forget the tables in the catalog; files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()

    def _read(self, path: str) -> DataFrame:
        if path not in self.tables:
            self.tables[path] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self.tables[path]} ({self.SCHEMA}) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(self.tables[path])

    def _write(self, kind: str, run: DataFrame, dealt: bool = False) -> str:
        """A new table of `run`; `dealt`: it comes out of joins of tables that are bucketed like it."""
        path = f"{self.location}/{kind}/{uuid.uuid4().hex}"
        self._read(path)
        # A task and a file for each bucket.
        (run if dealt else run.repartitionById(self.buckets, F.pmod(F.hash(*HASH), F.lit(self.buckets)))).write.insertInto(self.tables[path])
        self.spark.catalog.refreshTable(self.tables[path])
        return path

    def held(self, kind: str) -> list[DataFrame]:
        return [self._read(path) for level in self.levels[kind] for path in level]

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))

    def fresh(self, counted: DataFrame) -> DataFrame:
        """The rows of `counted` that no run holds, by one merge anti-join with each run."""
        return reduce(lambda rows, run: rows.join(run.select(*HASH).hint("merge"), HASH, "left_anti"), self.held("runs"), counted)

    def add(self, batch: DataFrame) -> DataFrame:
        """Add the lines (doc_id, h1, h2) of a batch; returns those that no earlier run holds, as (h1, h2, n_docs, last_id).

        A document counts once for a line, however often it repeats it. Full levels are compacted at once.
        """
        once = batch.select("doc_id", *HASH).distinct()
        counted = self._read(self._write("batches", once.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id"))))
        first = not self.held("runs")
        run = self._write("runs", self.fresh(counted), dealt=True)
        new = self._read(run)
        if not first:
            known = counted.join(new.select(*HASH).hint("merge"), HASH, "left_anti")
            self._place("updates", 0, self._write("updates", known, dealt=True))
        self._place("runs", 0, run)
        return new

    def _place(self, kind: str, level: int, path: str) -> None:
        levels = self.levels[kind]
        if len(levels) <= level:
            levels.append([])
        levels[level].append(path)
        if len(levels[level]) >= self.fanout:
            full, levels[level] = levels[level], []
            rows = reduce(DataFrame.unionAll, map(self._read, full))
            # Runs hold different lines; updates of a line are summed.
            self._place(kind, level + 1, self._write(kind, rows if kind == "runs" else self._summed(rows)))

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last_id) over all batches: the rows of the runs, with the updates of their lines."""
        runs, updates = self.held("runs"), self.held("updates")
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        if not updates:
            return reduce(DataFrame.unionAll, runs)
        more = self._summed(reduce(DataFrame.unionAll, updates)).select(*HASH, F.col("n_docs").alias("more"), F.col("last_id").alias("later"))
        columns = [*HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_id", "later").alias("last_id")]
        return reduce(DataFrame.unionAll, (run.join(more.hint("merge"), HASH, "left").select(*columns) for run in runs))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """Drop lines that at least `min_docs` documents hold, except in the largest doc_id that holds them.

    A line's key is the line without blanks at both ends and with A-Z in lower case; keys shorter than
    `min_chars` code points always stay. Result: doc_id, n_lines, n_dropped, kept_text and row (a struct of
    all columns of `docs`, whatever their names), one row per row of `docs`. Rows that repeat an id are one document for the count. A null id is the smallest. Null and empty
    text have one empty line, which stays. A text that loses all its lines becomes empty. No documents give
    no rows. Only doc_id and text are used.

    The documents enter the runs in `batches` batches, each of which is anti-joined with the runs before it. Hot lines: counts are pre-aggregated, and the join has
    one row per line on the side of the runs, so that adaptive execution can split the other.
    """
    spark = docs.sparkSession
    docs = identified(docs)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    lines = stored(keyed_lines(docs, min_chars).select("*", batch), "lines", "batch")
    runs = LineRuns(spark)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    frequent = stored(runs.totals().where(F.col("n_docs") >= min_docs).select(*HASH, "last_id"), "frequent")
    runs.discard()
    lost = lines.join(frequent, HASH).where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    dropped = stored(
        lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("sig").alias("lost_sig")).agg(F.collect_set("pos").alias("lost")),
        "dropped",
    )
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("sig") == F.col("lost_sig")), "left")

    def rest(lines: Column) -> Column:
        # array_except hashes its second array, so a long text with many lost lines stays linear.
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
        return F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n")

    text = let(lines_of(F.col("text")), rest)
    return joined.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(text).alias("kept_text"),
        "row",
    )


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Line dedup of every document, the kept text as a digest."""
    result = dedup_lines(table(spark, folder, "documents"))
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, f.last_id IS NOT NULL AND f.last_id <> doc_id AS lost FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
