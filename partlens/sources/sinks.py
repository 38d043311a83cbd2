"""Writers of scores, result rows, tables and provenance records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

OVERLAY_FILE_LIMIT = 100_000


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON row per run key; columns beyond the score record are kept."""
    scores.write.mode(mode).json(path)


def results_tsv(corpus: DataFrame, label: str) -> DataFrame:
    """The formatted result row of one label."""
    f = lambda c, places: F.format_string(f"%.{places}f", F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return corpus.select(
        F.lit(label).alias("label"), "n_repos", "n_runs",
        f("valid_rate", 3), f("mean_gain", 4), f("mean_jaccard", 3), f("mean_cost", 3))


def append_results(rows: DataFrame, path: str) -> None:
    rows.select(*schemas.RESULTS_TSV).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def aggregate_json(corpus: DataFrame, repos: DataFrame) -> DataFrame:
    """JSON lines of an aggregate: the corpus row first, then one line per repository."""
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value"))
    return line(corpus, "corpus").unionByName(line(repos, "repo"))


def fixed_width(df: DataFrame, layout: Sequence[tuple[str, str]], missing: str = "-") -> DataFrame:
    """One text line per row; ``layout`` pairs a column with a printf format.

    A null is padded to the width of its format.
    """
    cells = []
    for name, fmt in layout:
        width = "".join(ch for ch in fmt.split(".")[0] if ch.isdigit() or ch == "-") or "1"
        cells.append(F.when(F.col(name).isNull(), F.format_string(f"%{width}s", F.lit(missing)))
                     .otherwise(F.format_string(fmt, F.col(name))))
    return df.select(F.concat(*cells).alias("line"))


def provenance(runs: DataFrame) -> DataFrame:
    """The provenance record of each run as JSON, absent values written as defaults."""
    out = runs.withColumn("model", F.coalesce("model", F.lit("default"))).withColumn(
        "session_id", F.coalesce("session_id", F.lit(""))).withColumn(
        "date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return out.select(*[k for k in schemas.RUN_KEY if k in out.columns],
                      F.to_json(F.struct(*[n for n in schemas.META if n in out.columns])).alias("meta"))


def overlay_hash(files: DataFrame) -> DataFrame:
    """12 characters over the sorted (digest, path) lines of a folder's files.

    A digest of a whole listing is one sequence, so the folder is checked to be small.
    ``files`` has ``path`` and binary ``content``.
    """
    if files.limit(OVERLAY_FILE_LIMIT + 1).count() > OVERLAY_FILE_LIMIT:
        raise ValueError(f"an overlay folder has at most {OVERLAY_FILE_LIMIT} files")
    line = F.struct(F.col("path"), F.concat(F.sha2("content", 256), F.lit("  "), F.col("path"), F.lit("\n")).alias("line"))
    listing = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "")
    return files.agg(F.substring(F.sha2(listing, 256), 1, 12).alias("overlay_hash"))


def in_order(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """The rows dealt by range and sorted in place, so the parts of what is written are in order, too."""
    return df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)


def write_ordered(df: DataFrame, order: Sequence[str | Column], path: str, parts: int | None = None) -> None:
    """Parquet whose files, by name, and rows in them are in ``order``; no task sorts more than its range."""
    in_order(df, order, parts).write.parquet(path)


def read_ordered(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """What ``write_ordered`` wrote, with the 0-based place of every row in the order: rows of the files before, and place in the file."""
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = placed.groupBy("__file").agg(F.count("*").alias("__n"))  # as many rows as files
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(offsets, "__file").select(*rows.columns, (F.col("__before") + F.col("__row")).alias(name))


class Folder:
    """A folder of the cluster's store that is replaced as a whole, also by what was read from it.

    The new content is written beside it and takes its place by two renames. One that broke off between them
    is put back by the next use, so readers find the old folder or the new one.
    """

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._old = f"{self.path}.replaced"

    def _at(self, path: str):
        return self._path(path)

    def exists(self) -> bool:
        """Whether there is a folder, after putting back one whose replacement broke off."""
        here, old = self._store.exists(self._at(self.path)), self._store.exists(self._at(self._old))
        if old and here:
            self._store.delete(self._at(self._old), True)
        elif old:
            self._store.rename(self._at(self._old), self._at(self.path))
        return here or old

    def replace(self, write: Callable[[str], None]) -> None:
        """``write`` gets the path of a staging folder to fill; it may read this one meanwhile."""
        there, stage = self.exists(), f"{self.path}.stage-{uuid.uuid4().hex}"
        write(stage)
        if there:
            self._store.rename(self._at(self.path), self._at(self._old))
        self._store.rename(self._at(stage), self._at(self.path))
        self._store.delete(self._at(self._old), True)
