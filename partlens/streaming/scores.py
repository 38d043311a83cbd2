"""Incremental intake of run records: every new file is scored into the store once.

The resumable scan (skip what has a record) and the append-only ledger become one file
stream: its checkpoint remembers the files it has seen, and a batch is written under its
id, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..sources.runs import CORRUPT, KEY, run_key


def read_new_scores(spark: SparkSession, root: str, files_per_trigger: int = 10_000) -> DataFrame:
    """Stream of score records with their run key; unreadable files give no record."""
    raw = (
        spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger)
        .load(f"{root}/*/*/*/*/score.json").select("value", "_metadata.file_path")
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", schemas.ddl({**schemas.SCORE, CORRUPT: "string"}), options)
    return (
        raw.select(*run_key("file_path"), parsed.alias("r")).where(F.col(f"r.{CORRUPT}").isNull())
        .select(*KEY, *[F.col(f"r.{c}").alias(c) for c in schemas.SCORE])
    )


def ledger_rows(scores: DataFrame) -> DataFrame:
    failed = F.concat(F.lit("FAILED-"), F.coalesce("result_subtype", F.lit("unknown")))
    return scores.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"), "repo", "rep",
        F.when(F.col("run_error"), failed).otherwise("done").alias("outcome"), F.lit(1).alias("attempts"),
        F.col("label").alias("pass_args"))


def intake(spark: SparkSession, root: str, store: str, checkpoint: str) -> StreamingQuery:
    """Bring the store up to date with everything below ``root`` and stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{store}/scores/batch={batch_id}")
        ledger_rows(batch).write.mode("overwrite").parquet(f"{store}/ledger/batch={batch_id}")
        batch.unpersist()

    return (
        read_new_scores(spark, root).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
