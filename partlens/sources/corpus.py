"""Corpus, holdout, history, checkout and ledger tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.expressions import hash_index, stem
from ..operators.keyed import number_rows, top_k
from .sinks import Folder, in_order

UNPINNED = "PIN_ME"

# Search filters of the sampling strata.
SEARCH_BASE = "fork:false archived:false size:500..60000 pushed:>{pushed}"
STRATA = {
    "famous": "stars:>5000",
    "lowvis": "stars:20..200 created:<{year_ago}",
    "natpart": "stars:>5000 monorepo OR workspace OR plugins in:description",
    "postcutoff": "stars:>5 created:>={cutoff}",
}
# Names of languages in search queries.
SEARCH_LANGUAGES = {"python": "Python", "typescript": "TypeScript", "javascript": "JavaScript", "go": "Go",
                    "rust": "Rust", "java": "Java", "cpp": "C++", "c": "C"}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Rows repo, sha, stratum, language with their line position; comments are skipped."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return parse_corpus(lines)


def parse_corpus(lines: DataFrame) -> DataFrame:
    body = F.trim("value")
    fields = F.split(body, r"\s+")
    return lines.where((body != "") & ~F.col("value").startswith("#")).select(
        "line", F.element_at(F.split(fields[0], "/"), -1).alias("name"),
        *[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(("repo", "sha", "stratum", "language"))])


def pinned(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("sha").isNotNull() & (F.col("sha") != UNPINNED))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line with its rank; used for the holdout and for human rankings."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("rank", "value"))
    name = F.trim("value")
    return lines.where((name != "") & ~F.col("value").startswith("#")).select("rank", name.alias("name"))


def read_gold(spark: SparkSession, root: str) -> DataFrame:
    """Human partitions ``<root>/<repo>.json`` as (repo, path, unit, pos); none is an empty table.

    ``pos`` orders the listings of a file: of a path listed twice the last one counts.
    """
    try:
        raw = spark.read.text(f"{root}/*.json", wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "repo string, path string, unit string, pos struct<unit: int, file: int>")
    parsed = F.from_json("value", "units array<struct<name string, files array<string>>>")["units"]
    return (
        raw.select(stem("_metadata.file_path").alias("repo"), F.posexplode(parsed).alias("i", "u"))
        .select("repo", "i", F.posexplode("u.files").alias("j", "path"), F.col("u.name").alias("unit"))
        .select("repo", "path", "unit", F.struct(F.col("i").alias("unit"), F.col("j").alias("file")).alias("pos"))
    )


def dev_size(corpus: DataFrame, holdout: DataFrame) -> DataFrame:
    """Number of pinned repositories outside the holdout."""
    return pinned(corpus).join(holdout.select("name"), "name", "left_anti").agg(F.count(F.lit(1)).alias("n_dev"))


def pin(chosen: DataFrame, refs: DataFrame) -> DataFrame:
    """Attach the head revision of every repository; one without a head is dropped."""
    return chosen.join(refs.select("repo", "sha"), "repo")


def strata_queries(spark: SparkSession, today: str | None = None, cutoff: str | None = None) -> DataFrame:
    """Search text per stratum; dates are counted back from ``today``."""
    now = F.current_date() if today is None else F.lit(today).cast("date")
    day = lambda n: F.date_format(F.date_sub(now, n), "yyyy-MM-dd")
    rows = [(n, f"{SEARCH_BASE} {q}".replace("{cutoff}", cutoff or "")) for n, q in STRATA.items()
            if n != "postcutoff" or cutoff]
    df = spark.createDataFrame(rows, "stratum string, query string")
    query = F.replace(F.replace("query", F.lit("{pushed}"), day(730)), F.lit("{year_ago}"), day(365))
    return df.select("stratum", query.alias("query"))


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored search result pages ``<stratum>/<language>/<page>.json`` as candidates."""
    schema = "items array<struct<full_name string>>"
    raw = spark.read.text(f"{path}/*/*/*.json", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(
        F.element_at(parts, -3).alias("stratum"), F.element_at(parts, -2).alias("language"),
        F.explode(F.from_json("value", schema)["items"]["full_name"]).alias("repo"))


def sample_strata(candidates: DataFrame, n_total: int, n_cells: int, seed: int = 0,
                  cell: Sequence[str] = ("stratum", "language"), item: str = "repo") -> DataFrame:
    """Exactly min(k, size) distinct items per cell, k = max(1, n_total // n_cells).

    The order is a hash of (seed, item), so the draw is uniform, repeatable and does not
    depend on how rows are distributed.
    """
    k = max(1, n_total // n_cells)
    order = hash_index(F.concat_ws(":", F.lit(str(seed)), F.col(item)))
    return top_k(candidates.select(*cell, item).distinct(), cell, [order, F.col(item)], k)


def sample_meta(candidates: DataFrame, picked: DataFrame, queries: DataFrame,
                cell: Sequence[str] = ("stratum", "language")) -> DataFrame:
    """Candidates and picked names per cell; a cell's picked list has at most k names."""
    cell = list(cell)
    counts = candidates.select(*cell, "repo").distinct().groupBy(*cell).agg(F.count(F.lit(1)).alias("candidates"))
    names = picked.groupBy(*cell).agg(F.array_sort(F.collect_list("repo")).alias("picked"))
    return counts.join(names, cell, "left").join(queries, "stratum", "left")


def corpus_lines(existing: DataFrame, chosen: DataFrame) -> DataFrame:
    """Corpus text with the existing rows kept and the pinned picks appended."""
    line = lambda df: df.select(F.format_string(LINE, "repo", "sha", "stratum", "language").alias("value"))
    return line(existing).unionByName(line(chosen))


#: Fixed value: the format of a corpus line.
LINE = "%-40s %s  %s  %s"
HEADER = "# owner/name  sha  stratum  language"


def kept_lines(spark: SparkSession, path: str) -> DataFrame:
    """place, value: the lines of a corpus file or folder in order, without blank ones and comments."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return whole.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.struct("file", "line").alias("place"), "value")


def corpus_meta(cells: DataFrame, seed: int, n_requested: int, snapshot: str | Column | None = None) -> DataFrame:
    """One row: snapshot, seed, n_requested and the cells by name (``stratum/language``), as many as were asked for."""
    found = F.struct("query", "candidates", F.coalesce("picked", F.array().cast("array<string>")).alias("picked"))
    entry = F.struct(F.concat_ws("/", "stratum", "language").alias("key"), found.alias("value"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if snapshot is None else F.lit(snapshot) if isinstance(snapshot, str) else snapshot
    return cells.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cells")).select(
        now.alias("snapshot"), F.lit(seed).alias("seed"), F.lit(n_requested).alias("n_requested"), "cells")


def write_corpus(chosen: DataFrame, cells: DataFrame, path: str, seed: int, n_requested: int, snapshot: str | None = None) -> None:
    """The corpus at ``path/corpus`` with what it holds already, and ``path/meta``; both take the place of what was there.

    The header comes first, then the kept lines in their order, then the pinned picks (repo, sha, stratum, language) by
    stratum, language and name.
    """
    spark = chosen.sparkSession
    lines, meta = Folder(spark, f"{path}/corpus"), Folder(spark, f"{path}/meta")
    place = lambda part, *names: F.struct(F.lit(part).alias("part"), *[c.alias(f"k{i}") for i, c in enumerate(names)])
    blank, zero = F.lit(""), F.lit(0)
    new = chosen.select(place(2, F.concat_ws(" ", "stratum", "language", "repo"), zero).alias("place"), F.format_string(LINE, "repo", "sha", "stratum", "language").alias("value"))
    every = spark.createDataFrame([(HEADER,)], "value string").select(place(0, blank, zero).alias("place"), "value").unionByName(new)
    if lines.exists():
        old = kept_lines(spark, lines.path).select(place(1, F.col("place.file"), F.col("place.line")).alias("place"), "value")
        every = every.unionByName(old)
    lines.replace(lambda stage: in_order(every, ["place"]).select("value").write.text(stage))
    meta.replace(lambda stage: corpus_meta(cells, seed, n_requested, snapshot).write.json(stage))


def parse_git_log(log: DataFrame, keys: Sequence[str] = schemas.GRAPH_KEY) -> DataFrame:
    """(keys, commit, path, age) from exported ``log --name-only`` text, newest first.

    Blocks are separated by an empty line; the first line of a block is its revision.
    """
    blocks = log.select(*keys, F.posexplode(F.split("value", "\n\n")).alias("age", "block"))
    lines = F.split(F.trim("block"), "\n")
    return blocks.select(*keys, "age", lines[0].alias("commit"),
                         F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("path"))


def find_checkout(runs: DataFrame, checkouts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Best checkout per run: its own folder, then the shared one, else a fresh clone.

    ``checkouts`` lists (folder, head). A folder whose head is another revision never
    counts; a run whose repository is not in the corpus has no checkout.
    """
    short = F.substring("sha", 1, 7)
    wanted = F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.concat_ws("-", "repo", short, "rep").alias("folder")),
        F.struct(F.lit(2).alias("rank"), F.col("repo").alias("folder"))))
    key = list(schemas.RUN_KEY)
    found = (
        runs.select(*key, wanted.alias("w")).select(*key, "w.*")
        .join(checkouts, "folder").where(F.col("head") == F.col("sha"))
        .groupBy(*key).agg(F.min_by("folder", "rank").alias("found"))
    )
    clone = pinned(corpus).select(F.col("name").alias("repo"), F.col("repo").alias("full_name"))
    fresh = F.when(F.col("full_name").isNotNull(), F.concat_ws("-", "repo", short, F.lit("rescore")))
    return (
        runs.select(*key).join(found, key, "left").join(clone, "repo", "left")
        .select(*key, F.coalesce("found", fresh).alias("folder"), F.col("found").isNull().alias("needs_clone"))
    )


# ---- slots and ledger -----------------------------------------------------------------


def slots(corpus: DataFrame, reps: Sequence[str], holdout: DataFrame | None = None,
          only: Sequence[str] | None = None) -> DataFrame:
    """(repo, sha, rep) of every pinned repository, holdout left out unless None."""
    rows = pinned(corpus)
    if only:
        rows = rows.where(F.col("name").isin(*only))
    if holdout is not None:
        rows = rows.join(holdout.select("name"), "name", "left_anti")
    return rows.select(F.col("name").alias("repo"), "sha", F.explode(F.array(*[F.lit(str(r)) for r in reps])).alias("rep"))


def open_slots(wanted: DataFrame, scored: DataFrame, keys: Sequence[str] = schemas.RUN_KEY) -> DataFrame:
    """Slots without a score yet: a sweep resumes where it stopped."""
    return wanted.join(scored.select(*keys), list(keys), "left_anti")


def shard_of(rows: DataFrame, count: int, order: Sequence[str | Column]) -> DataFrame:
    """Every row with its shard: its position in the file order modulo ``count``."""
    return number_rows(rows, order, "__row").withColumn("shard", F.pmod("__row", F.lit(count))).drop("__row")


def shard(rows: DataFrame, index: int, count: int, order: Sequence[str | Column]) -> DataFrame:
    """The rows one of ``count`` workers takes."""
    return shard_of(rows, count, order).where(F.col("shard") == index).drop("shard")


def final_outcomes(attempts: DataFrame, max_attempts: int = 3, keys: Sequence[str] = ("repo", "rep")) -> DataFrame:
    """One ledger row per slot from its numbered attempts and their exit codes.

    The first success ends a slot; otherwise the last allowed attempt names the failure.
    ``backoff`` adds up the waits: 60 s per attempt after a limit, 5 s otherwise.
    """
    code = F.col("exit_code")
    first_ok = attempts.groupBy(*keys).agg(F.min(F.when(code == 0, F.col("attempt"))).alias("ok_at"))
    tried = attempts.join(first_ok, list(keys)).where(
        F.col("attempt") <= F.least(F.coalesce("ok_at", F.lit(max_attempts)), F.lit(max_attempts)))
    reason = F.when(code == 4, "limit").when(code == 3, "killed").otherwise(F.concat(F.lit("exit"), code.cast("string")))
    wait = F.when((code == 0) | (F.col("attempt") == max_attempts), 0).otherwise(
        F.col("attempt") * F.when(code == 4, 60).otherwise(5))
    return tried.groupBy(*keys).agg(
        F.max_by(F.when(code == 0, "done").otherwise(F.concat(F.lit("FAILED-"), reason)), "attempt").alias("outcome"),
        F.max("attempt").alias("attempts"), F.sum(wait).alias("backoff"))


def within_deadline(launches: DataFrame, minutes: int, elapsed: str = "elapsed_s") -> DataFrame:
    """Slots launched before the deadline; what is in flight then may finish. 0 = none."""
    if minutes <= 0:
        return launches
    return launches.where(F.floor(F.col(elapsed) / 60) < minutes)


def ledger_counts(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ledger.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == "done").alias("done"),
        F.count_if(F.col("outcome").startswith("FAILED-")).alias("failed"))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.select(*schemas.LEDGER).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ddl(schemas.LEDGER)).option("sep", "\t").option("header", True).csv(path)


# ---- observations ------------------------------------------------------------------------


def failure_observations(spark: SparkSession, observations: DataFrame) -> DataFrame:
    """Coded observations joined to the code list; unknown codes and severities fall out."""
    codes = spark.createDataFrame(list(schemas.FAILURE_CODES.items()), "code string, failure string")
    return observations.where(F.col("severity").between(1, 3)).join(F.broadcast(codes), "code")


def phase(facts: DataFrame, max_iterations: int = 12, reps: int = 3) -> DataFrame:
    """Project phase from one row of facts; the first rule that applies wins."""
    need = F.col("n_dev") * reps
    number = (
        F.when(F.col("blocked"), "BLOCKED").when(F.col("summary"), "DONE").when(F.col("need_corpus"), "WAITING")
        .when(F.col("unpinned") | ~F.col("parser_ready") | ~F.col("first_note"), "PHASE 0")
        .when(~F.col("baseline_tag") | (F.col("n_scored") < need) | ~F.col("baseline_note"), "PHASE 1")
        .when(F.col("n_required") > F.col("n_dev"), "PHASE 2")
        .when((F.col("iterations") >= max_iterations) & ~F.col("recall_note"), "PHASE 3")
        .when(F.col("iterations") >= max_iterations, "PHASE 6")
        .otherwise("PHASE 2")
    )
    return facts.select("*", number.alias("phase"))
