"""Line dedup by winnowing over line hashes.

A text is its sequence of lines. Runs that count are those of ``RUN`` lines, not all blank, and single
lines of at least ``LONE`` characters that are not white space. Of every ``RUN`` lines in a row the smallest hash
(the rightmost of equals) is selected as fingerprint, so two equal runs always select the same line at
the same place; a long line is a fingerprint by itself. Fingerprints that have one place in the corpus end
there. At the others the match is begun with the run around the fingerprint, joined to the earliest place
(smallest doc_id, then place in the text) of an equal run, and extended to both sides along the same pair of
places, run by run, to the whole repeated stretch. Lines of matches are deleted; the earliest place stays. No pairs of places
are made, and the tables looked up have one row a key and are written, so AQE can split a line that a third of all texts hold.

Runs are told apart by 128 bits of two hashes. Defined cases: a null text has no lines and
stays null; runs of blank lines only are left; rows equal in doc_id and text are one document
and are treated alike; null doc_ids come last in the order; a text of any length gives a row a line; an
empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let
from .tables import drop, written

RUN = 2
LONE = 100


def _runs(text: Column) -> Column:
    """Every run that counts: place s, lines n, hash and place of its fingerprint, hashes a and b of the run."""
    lines = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    hashed = F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.length(F.translate(x, SPACES, "")).alias("full")))

    def at(x: Column, y: Column, s: Column) -> Column:
        later = y["a"] <= x["a"]
        two = F.struct(
            s.alias("s"), F.lit(RUN).alias("n"), F.when(later, y["a"]).otherwise(x["a"]).alias("chosen"), (s + later.cast("int")).alias("place"),
            F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(x["b"], y["b"]).alias("b"), (y.isNotNull() & (x["full"] + y["full"] > 0)).alias("counts"))
        one = F.struct(
            s.alias("s"), F.lit(1).alias("n"), x["a"].alias("chosen"), s.alias("place"), x["a"].alias("a"), x["b"].alias("b"), (x["full"] >= LONE).alias("counts"))
        return F.filter(F.array(two, one), lambda r: r["counts"])

    return let(hashed, lambda h: F.flatten(F.transform(h, lambda x, s: at(x, F.get(h, s + 1), s))))


def matches(documents: DataFrame) -> DataFrame:
    """Later copies of repeated stretches: doc_id, text_hash, start, lines, first_doc_id, first_hash, first_start.

    A stretch is the longest along which every run is a later copy of a run of the same earlier stretch.
    """
    runs = (
        documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_runs(F.col("text"))).alias("r"))
        .select("doc_id", "text_hash", "r.s", "r.n", "r.chosen", "r.place", "r.a", "r.b")
    )
    # a fingerprint that several runs of one document select at one place has one place
    spot = F.xxhash64("doc_id", "text_hash", "place")
    shared = written(runs.groupBy("chosen").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low <> high").select("chosen"))
    found = written(runs.join(shared, "chosen", "left_semi").drop("chosen", "place"))
    drop(shared)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "s")
    first = written(found.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    later = found.join(first, ["n", "a", "b"]).where(place != F.col("first"))
    # matched runs on one diagonal follow one another: those that touch grow into one stretch, to both sides
    pair = ["doc_id", "text_hash", "first_doc_id", "first_hash", "shift"]
    begun = later.select("doc_id", "text_hash", F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_hash"),
                         (F.col("s") - F.col("first.s")).alias("shift"), "s", "n").groupBy(*pair, "s").agg(F.max(F.col("s") + F.col("n")).alias("end"))
    order = Window.partitionBy(*pair).orderBy("s")
    reached = begun.withColumn("reached", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    stretch = reached.withColumn("stretch", F.sum(F.when(F.col("s") <= F.col("reached"), 0).otherwise(1)).over(order))
    return stretch.groupBy(*pair, "stretch").agg(F.min("s").alias("start"), F.max("end").alias("end")).select(
        "doc_id", "text_hash", "start", (F.col("end") - F.col("start")).alias("lines"), "first_doc_id", "first_hash", (F.col("start") - F.col("shift")).alias("first_start"))


def repeated_lines(documents: DataFrame) -> DataFrame:
    """Places of the lines to delete, one row per document that has any: doc_id, text_hash, places."""
    covered = F.explode(F.sequence("start", F.col("start") + F.col("lines") - 1))
    return (
        matches(documents).select("doc_id", "text_hash", covered.alias("line"))
        .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("places"))
    )


def _marked(documents: DataFrame) -> DataFrame:
    found = repeated_lines(documents).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("places").alias("__places"))
    keyed = documents.withColumn("__text_hash", F.xxhash64("text"))
    on = (keyed["__text_hash"] == found["__hash"]) & keyed["doc_id"].eqNullSafe(found["__id"])
    return keyed.join(found.hint("merge"), on, "left").drop("__text_hash", "__id", "__hash")


def _kept_text(text: Column, places: Column) -> Column:
    lines = F.split(text, "\n")
    rest = let(lines, lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), places), lambda i: F.get(ls, i)))
    return F.when(places.isNull(), text).otherwise(F.array_join(rest, "\n"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents with later repeated runs of lines deleted; all other columns stay, n_chars follows the text."""
    columns = documents.columns
    cut = _marked(documents).withColumn("text", _kept_text(F.col("text"), F.col("__places")))
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__places").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return cut.select(*columns)


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the remaining text, one row per document."""
    marked = _marked(documents.select("doc_id", "text"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return marked.select(
        "doc_id", n_lines.alias("n_lines"), F.greatest(F.size("__places"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(_kept_text(F.col("text"), F.col("__places")), F.lit("")), 256).alias("kept_sha256"),
    )


def _sql(source: str) -> str:
    """CTEs that end in line_kept(doc_id, text, n_lines, n_removed, kept) over a relation of documents."""
    return rf"""
line_list AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {source}),
line_pairs AS (SELECT doc_id, s, ls[s + 1] AS x, ls[s + 2] AS y FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 1)) AS s FROM line_list)),
line_later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, s) AS k FROM line_pairs
  WHERE regexp_matches(x || y, '[^\x20\x09-\x0D]')) WHERE k > 1),
line_lone AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM
  (SELECT doc_id, unnest(range(0, len(ls))) AS s, unnest(ls) AS x FROM line_list) WHERE length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) >= {LONE}) WHERE k > 1),
line_gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest([s, s + 1]) AS i FROM line_later UNION ALL SELECT doc_id, s FROM line_lone)),
line_sets AS (SELECT doc_id, list(i) AS gone FROM line_gone GROUP BY doc_id),
line_kept AS (SELECT doc_id, text, coalesce(len(ls), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS kept
  FROM line_list LEFT JOIN line_sets USING (doc_id))"""


ORACLE = f"WITH {_sql('documents')} SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM line_kept"
