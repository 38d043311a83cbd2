"""Readers of run directories ``<root>/<repo>/<sha>/<label>/<rep>/``.

The key of a record is its path: filters on it choose which files are opened (``pruned``), where Arrow can list the
store; else Spark's text reader lists them all. JSON is read once with an explicit schema;
``to_parquet`` then stores it by label and replicate, so later filters prune folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import labels
from . import pruned

CORRUPT = "_corrupt_record"
KEY = list(schemas.RUN_KEY)


def run_key(path) -> list:
    """Key columns from a record's path; the replicate stays a string."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return [F.url_decode(F.element_at(parts, i)).alias(n) for i, n in zip((-5, -4, -3, -2), KEY)]


def read_text(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Whole text files (logs) with their run key; a directory without any is an empty table."""
    if pruned.reachable(root):
        return pruned.run_files(spark, root, name)
    try:
        raw = spark.read.text(f"{root}/*/*/*/*/{name}", wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in KEY) + ", value string")
    return raw.select(*run_key("_metadata.file_path"), "value")


def read_json(spark: SparkSession, root: str, name: str, fields: dict[str, str]) -> DataFrame:
    """All ``name`` files below ``root`` as key columns, fields and the raw text on error.

    A directory without any such file is an empty table; an empty file is an empty object.
    """
    raw = read_text(spark, root, name)
    text = F.when(F.trim("value") == "", F.lit("{}")).otherwise(F.col("value"))
    full = schemas.ddl({**fields, CORRUPT: "string"})
    parsed = F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # the path is the key; fields of the same name inside the record are provenance only
    names = [k for k in fields if k not in KEY]
    return raw.select(*KEY, parsed.alias("r")).select(*KEY, *[F.col(f"r.{n}").alias(n) for n in (*names, CORRUPT)])


def select_runs(df: DataFrame, label: str | None = None, reps: Sequence[str] | None = None,
                holdout: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Label, replicate and holdout filters; without a label all labels are pooled.

    On a reader of this module the label and the replicates, and a holdout given as names, choose the files that are opened.
    """
    if label is not None:
        df = df.where(F.col("label") == label)
    if reps:
        df = df.where(F.col("rep").isin(*[str(r) for r in reps]))
    if isinstance(holdout, (list, tuple)):
        df = df.where(~F.col("repo").isin(*holdout)) if holdout else df
    elif holdout is not None:
        df = df.join(holdout.select(F.col("name").alias("repo")), "repo", "left_anti")
    return df


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    """Stored score records with their provenance; a missing meta record leaves nulls."""
    scores = read_json(spark, root, "score.json", schemas.SCORE).where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    meta = read_json(spark, root, "meta.json", schemas.META).select(
        *KEY, "condition", "stratum", "has_claude_md", "exit", "model")
    return scores.join(meta, KEY, "left")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests; unreadable text counts as an empty manifest.

    The lists are read entry by entry: one that does not have the shape of its list is
    left out, the others stay.
    """
    lists = {k: v for k, v in schemas.MANIFEST.items() if v.startswith("array<")}
    loose = {**schemas.MANIFEST, **dict.fromkeys(lists, "array<variant>")}
    read = read_json(spark, root, "manifest.json", loose)

    def entries(name: str, kind: str) -> Column:
        cast = F.transform(name, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", kind)))
        return F.filter(cast, lambda x: x.isNotNull())

    return read.withColumns({k: entries(k, v[len("array<"):-1]) for k, v in lists.items()})


def partitions(manifests: DataFrame) -> DataFrame:
    """(run key, item, community): the unit of every file, the last listing wins."""
    return unit_files(manifests).groupBy(*KEY, F.col("path").alias("item")).agg(
        F.max_by("unit", "pos").alias("community"))


def units(manifests: DataFrame) -> DataFrame:
    """One row per listed unit with its position."""
    return manifests.select(*KEY, F.posexplode("units").alias("unit_pos", "u")).select(
        *KEY, "unit_pos", F.col("u.name").alias("unit"), F.col("u.kind").alias("kind"), "u.files", "u.entrypoints",
        "u.depends_on", "u.effects", F.coalesce(F.size("u.files"), F.lit(0)).alias("n_files"))


def unit_files(manifests: DataFrame) -> DataFrame:
    """One row per (unit, file) listing; ``pos`` orders listings within the manifest."""
    return units(manifests).select(*KEY, "unit_pos", "unit", F.posexplode("files").alias("i", "path")).select(
        *KEY, "unit", "path", F.struct("unit_pos", "i").alias("pos"))


def unit_records(scores: DataFrame) -> DataFrame:
    """One row per unit of every stored score; runs without unit records have none."""
    return scores.select(*KEY, F.explode("units").alias("u")).select(*KEY, "u.*")


def unit_scan_counts(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("runs_seen"), F.count_if(F.size("units") > 0).alias("runs_with_units"))


def lint_round_counts(logs: DataFrame) -> DataFrame:
    return logs.select(*KEY, labels.lint_rounds("value").alias("lint_rounds"))


def lint_lines(logs: DataFrame) -> DataFrame:
    """Findings of lint logs: the round they belong to, the invariant and the text.

    A log is cut at its round marks inside the row, so no ordering across rows is needed.
    """
    rounds = logs.select(*KEY, F.posexplode(F.split("value", labels.LINT_ROUND_MARK)).alias("round", "body")).where("round > 0")
    lines = rounds.select(*KEY, "round", F.regexp_extract("body", r"^\s*(\d+)", 1).cast("long").alias("epoch"),
                          F.explode(F.split("body", "\n")).alias("line"))
    code = F.regexp_extract("line", r"^(I\d+)\b", 1)
    return lines.withColumn("invariant", code).where(code != "")


def classify_attempts(spark: SparkSession, root: str) -> DataFrame:
    """Outcome of every attempt from its error log and the size of its result."""
    logs = read_text(spark, root, "stderr.log").withColumnRenamed("value", "stderr")
    results = read_text(spark, root, "result.json").select(*KEY, F.octet_length("value").alias("result_bytes"))
    outcome = labels.classify_run("stderr", "result_bytes")
    joined = logs.join(results, KEY, "full")
    return joined.select(*KEY, outcome.alias("outcome"), labels.exit_code(outcome).alias("exit_code"))


def to_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store records by label and replicate; every later filter on them prunes folders."""
    df.write.mode(mode).partitionBy("label", "rep").parquet(path)
