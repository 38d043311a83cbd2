"""The code graph of every checkout: extracted once, stored, and read back by scoring."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.expressions import stem
from ..operators import extract, graph, resolve
from ..session import materialize
from ..sources import files as source_files

GK = list(schemas.GRAPH_KEY)
VERSION = 2
#: Folders that the graphs of a store are dealt to, and the files a writer makes in each.
BUCKETS, FILES_OF_BUCKET = 64, 4
_KEY = "repo string, sha string"
TABLES = {
    "edges": "src string, dst string", "refs": "src string, dst string, symbol string",
    "surface": "path string, symbol string", "effects": "path string, kind string",
}
#: Fixed value: how a line begins that the word-matching graph reads.
IMPORT_LINE = r"^\s*(import|from|use|require|#include)\b"


@dataclass
class CodeGraph:
    """Edges (src, dst) and facts of graphs keyed by (repo, sha)."""

    edges: DataFrame
    refs: DataFrame
    surface: DataFrame
    effects: DataFrame
    source: str = "facts"


def build(files: DataFrame) -> CodeGraph:
    """Extract and resolve every checkout in ``files`` (repo, sha, path, text)."""
    known = source_files.extractable(files)
    facts = materialize(extract.extract_facts(known, GK, spread=True))
    linked = materialize(resolve.links(known, facts, GK))
    refs = materialize(resolve.references(facts, linked, GK))
    return CodeGraph(
        edges=materialize(resolve.code_edges(linked, refs, GK)),
        refs=refs,
        surface=materialize(resolve.public_surface(facts, GK)),
        effects=materialize(resolve.detect_effects(known, facts, extract.internal_names(known, GK), GK)),
    )


def build_fallback(files: DataFrame) -> CodeGraph:
    """Words on import lines that equal a file's stem; no contract facts."""
    scored = files.where(source_files.is_source("path"))
    lines = scored.select(*GK, F.col("path").alias("item"), F.explode(F.split("text", r"\r?\n")).alias("line")).where(
        F.col("line").rlike(IMPORT_LINE) | F.col("line").contains("require("))
    names = scored.select(*GK, F.col("path").alias("item"), stem("path").alias("name"))
    none = lambda ddl: files.sparkSession.createDataFrame([], f"repo string, sha string, {ddl}")
    return CodeGraph(
        edges=graph.token_links(lines, names, GK), refs=none(TABLES["refs"]), surface=none(TABLES["surface"]),
        effects=none(TABLES["effects"]), source="regex-fallback")


def _with_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*GK), F.lit(BUCKETS)).cast("int"))


def _stored(spark: SparkSession, base: str, name: str, fields: str) -> DataFrame:
    """A table of the store with its partition columns; one that was never written is empty."""
    schema = ", ".join(x for x in (f"{_KEY}", fields, "bucket int, batch string") if x)
    try:
        return spark.read.schema(schema).parquet(f"{base}/{name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, base: str, name: str, batch: str) -> None:
    """The partitions of a batch, in place of what an earlier try of the same batch may have left."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(FILES_OF_BUCKET))
    dealt = _with_bucket(df).withColumn("batch", F.lit(batch)).repartition(F.col("bucket"), salt)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{base}/{name}")


def _batch_of(graphs: DataFrame) -> str:
    """A name that the same graphs always get, so that a retry takes the place of the try before it."""
    row = graphs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*GK).cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.xxhash64(F.lit("again"), *GK).cast("decimal(38,0)")), F.lit(0))).first()
    return hashlib.sha256(":".join(map(str, row)).encode()).hexdigest()[:16]


def cached(spark: SparkSession, path: str, files: DataFrame) -> CodeGraph:
    """Stored graphs, with those missing for a (repo, sha) computed and added first.

    Tables lie in folders ``version / bucket of (repo, sha) / batch``: an extractor of another version never reads
    old facts, and reading some graphs opens the folders of their buckets only. A batch is named after its graphs and
    listed in ``graphs`` when all its tables are written; rows of batches that are not listed for their graph are
    not read. A try that broke off leaves nothing that counts, and its retry overwrites what it left.
    """
    base = f"{path}/version={VERSION}"
    wanted = materialize(files.select(*GK).distinct())
    buckets = sorted(r[0] for r in _with_bucket(wanted).select("bucket").distinct().collect())  # at most BUCKETS numbers

    def listed() -> DataFrame:
        have = _stored(spark, base, "graphs", "").where(F.col("bucket").isin(buckets)) if buckets else _stored(spark, base, "graphs", "").where(F.lit(False))
        return have.groupBy(*GK, "bucket").agg(F.max("batch").alias("batch"))

    missing = materialize(wanted.join(listed(), GK, "left_anti"))
    if not missing.isEmpty():
        batch, new = _batch_of(missing), build(files.join(missing, GK, "left_semi"))
        for name in TABLES:
            _write(getattr(new, name), base, name, batch)
        _write(missing, base, "graphs", batch)
    current = materialize(wanted.join(listed(), GK))
    read = lambda name: _stored(spark, base, name, TABLES[name]).where(F.col("bucket").isin(buckets) if buckets else F.lit(False)).join(
        current, [*GK, "bucket", "batch"], "left_semi").drop("bucket", "batch")
    return CodeGraph(**{name: read(name) for name in TABLES})
