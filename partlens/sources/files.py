"""Source files of checkouts ``<root>/<repo>/<sha>/<path>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import suffix
from . import pruned

# What the scorer counts as a source file, and folders it leaves out.
SOURCE_SUFFIXES = [".py", ".js", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".cc", ".cpp", ".h", ".hpp"]
SKIPPED_FOLDERS = [".git", "node_modules", "vendor", "target", "build", "dist", "__pycache__", ".claude",
                   "examples", "tests", "test", "docs"]

# What the fact extraction reads, and folders it leaves out.
LANGUAGE_OF_SUFFIX = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".hh": "cpp",
}
EXTRACT_SKIPPED_FOLDERS = [*SKIPPED_FOLDERS, "doc", "third_party", "testdata", "fixtures"]
MAX_SOURCE_BYTES = 2_000_000


def read_checkouts(spark: SparkSession, root: str, skipped: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """(repo, sha, path, length, text) of every file with a known suffix outside the folders that nothing reads.

    Folders, suffixes and filters on repo, sha, path and length are tested before a file is opened, where Arrow can
    list the store; else Spark reads the files and the same tests follow. Invalid UTF-8 is replaced, as
    a tolerant decoder does.
    """
    known = sorted({*SOURCE_SUFFIXES, *LANGUAGE_OF_SUFFIX})
    if pruned.reachable(root):
        return pruned.checkout_files(spark, root, known, skipped)
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(known) + "}").load(root)
    )
    below = F.split(F.regexp_replace("path", "^.*?" + _plain(root) + "/+", ""), "/")
    inside = F.slice(below, F.lit(3), F.size(below))
    return raw.where(~F.arrays_overlap(inside, F.array(*[F.lit(s) for s in skipped])) if skipped else F.lit(True)).select(
        below[0].alias("repo"), below[1].alias("sha"), F.array_join(inside, "/").alias("path"),
        "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def is_source(path) -> Column:
    """Files the scorer counts. Folders are tested below the checkout, so where a
    checkout lies never changes its file list."""
    path = F.col(path) if isinstance(path, str) else path
    return suffix(path).isin(SOURCE_SUFFIXES) & ~F.arrays_overlap(
        F.split(path, "/"), F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))


def language(path) -> Column:
    """Language of a file that facts are extracted from, null for any other file."""
    path = F.col(path) if isinstance(path, str) else path
    table = F.create_map(*[F.lit(v) for pair in LANGUAGE_OF_SUFFIX.items() for v in pair])
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")))
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(s) for s in EXTRACT_SKIPPED_FOLDERS]))
    return F.when(~skipped, F.try_element_at(table, suffix(path)))


def extractable(files: DataFrame) -> DataFrame:
    """Files facts are extracted from, with their language; very large files are left out."""
    size = F.col("length") if "length" in files.columns else F.octet_length("text")
    return files.withColumn("lang", language("path")).where(F.col("lang").isNotNull() & (size <= MAX_SOURCE_BYTES))


def _plain(root: str) -> str:
    return r"\Q" + root.rstrip("/").removeprefix("file:") + r"\E"
