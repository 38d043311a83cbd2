"""Quality rules with thresholds taken from the corpus itself.

Every text is measured inside its row with built-in functions. Each measure that is not
already below the base rules feeds a mergeable quantile sketch per language and source:
a histogram whose bins are exact up to 63 and 1/32 of the value wide above, so it has at
most about 1,900 bins whatever the input, merges by adding counts and does not depend on
the order of rows. A group's fences lie ``WIDTH`` spreads from its median, the spread being
the distance from the median to the outer percentile (99th above, 1st below) on the side of the fence.
Median and percentiles of a group are shrunk towards those of its language as if ``SHRINKAGE`` documents
of the language were added to it, and a language's towards those of all documents, so no group
switches from one fence to another as it grows. The fences are then joined to the documents.

Defined cases: a null or blank text has no words and fails the base rules; null languages
and sources are groups like others; repeated rows are measured one by one; an empty table
gives an empty result; a text of any length is measured whole in its row; extra columns are kept by
``filter_documents``, whatever their names, and ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE_CLASS, SPACES, join_counted, let, same, words
from .tables import written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
WIDTH = 2
SHRINKAGE = 200
MEASURES = ("word_length", "symbols", "dup_lines", "repeats")
LEVELS = (1, 50, 99)

#: Least spread, against rounding only: what one count more makes of a text of a hundred words.
ROUNDING = 10


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(words(text), lambda w: let(lines, lambda ls: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE_CLASS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    )))


def repeated_words(w: Column) -> Column:
    """Words in windows of five words that occur at least twice in the text.

    Windows are compared by 64-bit hashes of their words' hashes; within one text a
    collision is out of reach. Only texts in which a hash repeats are sorted.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(g)),
    )))


def _covered(windows: Column) -> Column:
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = let(ordered, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts, zero,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _values(m: Column) -> dict[str, Column]:
    """Whole-number measures that the fences are on."""
    whole = F.greatest(m["n_words"], F.lit(1))
    return {
        "word_length": F.floor(100 * m["word_chars"] / whole), "symbols": F.floor(1000 * m["n_symbols"] / whole),
        "dup_lines": F.floor(1000 * m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1))),
        "repeats": F.floor(1000 * m["n_repeat_words"] / whole),
    }


def _bin(value: Column) -> Column:
    """Upper edge of the sketch bin of a whole number."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.expr("0").cast("long") + F.call_function("shiftleft", F.call_function("shiftright", value, shift) + 1, shift) - 1


def sketch(measured: DataFrame) -> DataFrame:
    """Bins of all measures per language and source: lang, source, measure, bin, n.

    Added up in every task before the shuffle, so a source with a third of all
    documents sends no more rows than any other.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), _bin(v).alias("bin")) for k, v in _values(F.col("m")).items()])
    return (
        measured.where(~base_failed(F.col("m"))).select("lang", "source", F.explode(rows).alias("x"))
        .groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))
    )


def _quantiles(bins: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Documents and percentiles of each measure; a window holds the bins of one sketch only."""
    running = Window.partitionBy(*keys, "measure").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "measure")
    ranked = bins.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(whole))

    def at(name: str, q: int) -> Column:
        return F.min(F.when((F.col("measure") == name) & (100 * F.col("upto") >= q * F.col("all")), F.col("bin")))

    return ranked.groupBy(*keys).agg(F.struct(
        F.max("all").alias("n"), *[at(k, q).alias(f"{k}_{q}") for k in MEASURES for q in LEVELS]).alias(prefix))


def _shrunk(own: Column, towards: Column) -> Column:
    """Percentiles of a group with ``SHRINKAGE`` documents of a wider group added, in whole numbers."""
    names = [f"{k}_{q}" for k in MEASURES for q in LEVELS]
    return F.struct(*[F.call_function("div", own["n"] * own[k] + SHRINKAGE * towards[k], own["n"] + SHRINKAGE).alias(k) for k in names])


def thresholds(bins: DataFrame) -> DataFrame:
    """Fences per language and source: word_length_low, and word_length_high, symbols_high, dup_lines_high, repeats_high."""
    by_source = _quantiles(bins, ["lang", "source"], "own")
    by_lang = _quantiles(bins.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")), ["lang"], "of_lang")
    overall = _quantiles(bins.groupBy("measure", "bin").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"], "of_all")
    by_lang = by_lang.select("lang", _shrunk(F.col("of_lang"), overall.select("of_all").scalar()).alias("of_lang"))
    joined = by_source.join(by_lang, same(by_source, by_lang, ["lang"]), "left").drop(by_lang["lang"])
    chosen = joined.select("lang", "source", _shrunk(F.col("own"), F.col("of_lang")).alias("q"))

    def fence(k: str, q: int) -> Column:
        median, outer = F.col("q")[f"{k}_50"], F.col("q")[f"{k}_{q}"]
        spread = WIDTH * F.greatest(F.abs(outer - median), F.lit(ROUNDING))
        return median + spread if q > 50 else median - spread

    return chosen.select("lang", "source", fence("word_length", 1).alias("word_length_low"), *[fence(k, 99).alias(f"{k}_high") for k in MEASURES])


def _verdict(m: Column, fence: Column) -> Column:
    v = _values(m)
    inside = fence["word_length_low"] <= v["word_length"]
    for k in MEASURES:
        inside = inside & (v[k] <= fence[f"{k}_high"])
    return F.coalesce(~base_failed(m) & inside, F.lit(False))


def fences(measured: DataFrame) -> DataFrame:
    """One row per language and source with its fences in a struct, written once."""
    found = thresholds(sketch(measured))
    return materialize(found.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"),
                                    F.struct(*found.columns[2:]).alias("__fence")))


def _with_verdict(measured: DataFrame, fence: DataFrame, m: str) -> DataFrame:
    on = measured["lang"].eqNullSafe(fence["__lang"]) & measured["source"].eqNullSafe(fence["__source"])
    return join_counted(measured, fence, on, "left").withColumn("__kept", _verdict(F.col(m), F.col("__fence")))


def judge(documents: DataFrame) -> DataFrame:
    """Measures, base rules and verdict of every document, one row each."""
    measured = materialize(documents.select("doc_id", "lang", "source", measures(F.col("text")).alias("m")))
    judged = _with_verdict(measured, fences(measured), "m")
    return judged.select(
        "doc_id", *[F.col("m")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(F.col("m")).alias("base_failed"), F.col("__kept").alias("kept"),
    )


def filter_documents(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Texts are measured once: rows and measures are written, of which the sketch reads the measures only; texts are not shuffled.
    """
    rows = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    measured = written(documents.select(rows.alias("document"), measures(F.col("text")).alias("m")))
    keyed = measured.select("document", "m", "document.lang", "document.source")
    judged = _with_verdict(keyed, fences(keyed.select("lang", "source", "m")), "m")
    return judged.where("__kept").select("document.*")


_NAMES = [f"{k}_{q}" for k in MEASURES for q in LEVELS]
_FENCE_SQL = " ".join(f"{k}_50 + {WIDTH} * greatest({k}_99 - {k}_50, {ROUNDING}) AS {k}_high," for k in MEASURES)
_INSIDE_SQL = " AND ".join(f"{k} <= {k}_high" for k in MEASURES)


def _shrunk_sql(own: str, towards: str) -> str:
    return ", ".join(f"({own}.n * {own}.{k} + {SHRINKAGE} * {towards}.{k}) // ({own}.n + {SHRINKAGE}) AS {k}" for k in _NAMES)


def _levels_sql(name: str, source: str, keys: str) -> str:
    at = ", ".join(f"min(bin) FILTER (measure = '{k}' AND 100 * upto >= {q} * total) AS {k}_{q}" for k in MEASURES for q in LEVELS)
    comma, partition = (f"{keys}, ", f"{keys}, measure") if keys else ("", "measure")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name} AS (SELECT {comma}max(total) AS n, {at} FROM (
      SELECT *, sum(n) OVER (PARTITION BY {partition} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {partition}) AS total
      FROM (SELECT {comma}measure, bin, sum(n) AS n FROM {source} GROUP BY {comma}measure, bin)) {group})"""


JUDGED_SQL = rf"""
WITH texts AS (SELECT rowid AS r, doc_id, lang, source, coalesce(text, '') AS text FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
tokens AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
places AS (SELECT r, w, unnest(range(0, len(w) - 4)) AS i FROM tokens WHERE len(w) > 5),
runs AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i + 1:i + 5]) AS times FROM places),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM runs WHERE times > 1) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
measured AS (SELECT doc_id, lang, source, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM texts JOIN tokens USING (r) JOIN lines USING (r) LEFT JOIN repeats USING (r)),
scored AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * word_chars // greatest(n_words, 1) AS word_length,
  1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM measured),
valued AS (SELECT lang, source, measure, v, greatest(length(bin(v)) - 6, 0)::BIGINT AS s FROM (
  {" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS v FROM scored WHERE NOT base_failed" for k in MEASURES)})),
bins AS (SELECT lang, source, measure, ((v >> s) + 1 << s) - 1 AS bin, count(*) AS n FROM valued GROUP BY ALL),
{_levels_sql("own", "bins", "lang, source")},
{_levels_sql("of_lang", "bins", "lang")},
{_levels_sql("of_all", "bins", "")},
shrunk_lang AS (SELECT of_lang.lang, {_shrunk_sql("of_lang", "of_all")} FROM of_lang CROSS JOIN of_all),
picked AS (SELECT own.lang, own.source, {_shrunk_sql("own", "shrunk_lang")} FROM own LEFT JOIN shrunk_lang ON own.lang IS NOT DISTINCT FROM shrunk_lang.lang),
fences AS (SELECT lang, source, {_FENCE_SQL} word_length_50 - {WIDTH} * greatest(word_length_50 - word_length_1, {ROUNDING}) AS word_length_low FROM picked),
judged AS (SELECT scored.*, coalesce(NOT base_failed AND word_length >= word_length_low AND {_INSIDE_SQL}, false) AS kept
  FROM scored LEFT JOIN fences ON scored.lang IS NOT DISTINCT FROM fences.lang AND scored.source IS NOT DISTINCT FROM fences.source)
"""

ORACLE = JUDGED_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
