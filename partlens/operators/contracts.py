"""Coverage, edge resolution and contract precision/recall of declared units.

Input tables, all keyed by the run (``keys``) or the graph (``graph_keys``):
  owned(keys, path, unit, pos)     files of units, one row per listing
  listed(keys, unit, name)         declared entrypoints
  depends(keys, unit, entrypoint)  declared dependencies
  declared(keys, unit, kind)       declared effects
  refs(graph_keys, src, dst, symbol), surface(graph_keys, path, symbol),
  effects(graph_keys, path, kind)  detected facts
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import last_segment, ratio
from .keyed import last_wins

MIN_COVERAGE = 0.95
MIN_EDGE_RESOLUTION = 0.90
TRIVIAL_SHARE = 0.8


def owners(owned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One owner per file; the last listing wins."""
    return last_wins(owned, [*keys, "path"], "unit", "pos")


def in_scope(files: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files not excluded by exact path or by a directory above them.

    Each file looks up its own path and its ancestors, so the prefix test is an
    equi-join instead of a comparison of every file with every exclusion.
    """
    keys = list(keys)
    slashes = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(slashes)),
        lambda i: F.array_join(F.slice(slashes, F.lit(1), i), "/"),
    )
    rules = excluded.where(F.col("path").isNotNull()).select(
        *keys, F.col("path").alias("__rule"), F.regexp_replace("path", "/+$", "").alias("__dir")).distinct()
    exact = rules.select(*keys, F.col("__rule").alias("__probe"), F.lit(True).alias("__exact"))
    below = rules.select(*keys, F.col("__dir").alias("__probe"), F.lit(False).alias("__exact"))
    probes = files.select(*keys, "path", F.posexplode(prefixes).alias("__i", "__probe"),
                          F.size(slashes).alias("__depth"))
    hits = (
        probes.join(exact.unionByName(below), [*keys, "__probe"])
        .where(F.when(F.col("__exact"), F.col("__i") == F.col("__depth") - 1)
               .otherwise(F.col("__i") < F.col("__depth") - 1))
        .select(*keys, "path")
    )
    return files.join(hits, [*keys, "path"], "left_anti")


def coverage(scope: DataFrame, owner: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Owned share of the files in scope."""
    keys = list(keys)
    return (
        scope.join(owner.select(*keys, "path", "unit"), [*keys, "path"], "left")
        .groupBy(*keys)
        .agg(F.avg(F.col("unit").isNotNull().cast("double")).alias("coverage"),
             F.count(F.lit(1)).alias("n_in_scope"))
    )


def edge_resolution(depends: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of declared dependencies whose (unit, entrypoint) is listed."""
    keys = list(keys)
    known = listed.select(*keys, "unit", F.col("name").alias("entrypoint")).distinct().withColumn("known", F.lit(1.0))
    return (
        depends.join(known, [*keys, "unit", "entrypoint"], "left")
        .groupBy(*keys).agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("edge_resolution"))
    )


def is_trivial(n_units, n_owned) -> Column:
    n_units, n_owned = F.col(n_units), F.col(n_owned)
    return (n_units <= 1) | ((n_owned > 3) & (n_units >= TRIVIAL_SHARE * n_owned))


def budget_exhausted(subtype, terminal_reason) -> Column:
    """From how the run ended, never from its turn count."""
    subtype = F.coalesce(F.col(subtype), F.lit(""))
    reason = F.coalesce(F.col(terminal_reason), F.lit(""))
    return (
        subtype.isin("error_max_turns", "error_max_budget_usd")
        | reason.contains("max_turns") | reason.contains("budget")
    )


def run_error(subtype, is_error) -> Column:
    return F.coalesce(F.col(subtype), F.lit("")).startswith("error_") | F.coalesce(F.col(is_error), F.lit(False))


def _match(claimed: DataFrame, actual: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    tag = lambda df, c, a: df.select(*keys, value, F.lit(c).alias("c"), F.lit(a).alias("a"))
    return (
        tag(claimed, 1, 0).unionByName(tag(actual, 0, 1))
        .groupBy(*keys, value).agg(F.max("c").alias("c"), F.max("a").alias("a"))
    )


def precision_recall(claimed: DataFrame, actual: DataFrame, units: DataFrame, keys: Sequence[str],
                     value: str = "value") -> DataFrame:
    """Precision and recall of claimed against actual sets of values.

    Both sides are tagged and reduced to distinct values; one groupBy then counts
    matches. No set is ever collected, so a unit with very many values is spread.
    """
    keys = list(keys)
    both = (F.col("c") + F.col("a")) == 2
    counted = _match(claimed, actual, keys, value).groupBy(*keys).agg(
        F.sum("c").alias("n_claimed"), F.sum("a").alias("n_actual"), F.count_if(both).alias("n_match"))
    out = units.select(*keys).distinct().join(counted, keys, "left").select(
        *keys, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("n_claimed", "n_actual", "n_match")])
    return out.select(
        "*",
        (F.col("n_actual") - F.col("n_match")).alias("n_missed"),
        (F.col("n_claimed") - F.col("n_match")).alias("n_spurious"),
        ratio("n_match", "n_claimed").alias("precision"),
        ratio("n_match", "n_actual").alias("recall"),
    )


def differences(claimed: DataFrame, actual: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Values on one side only, one row each: ``missed`` or ``spurious``."""
    return (
        _match(claimed, actual, list(keys), value).where(F.col("c") != F.col("a"))
        .select(*keys, F.when(F.col("a") == 1, "missed").otherwise("spurious").alias("side"), value)
    )


def with_source_units(refs: DataFrame, owner: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a ``src`` and the unit that owns it, null where nobody does."""
    sources = owner.select(*keys, F.col("path").alias("src"), F.col("unit").alias("src_unit"))
    return refs.join(sources, [*keys, "src"], "left")


def true_entrypoints(unit_files: DataFrame, owner: DataFrame, refs: DataFrame, surface: DataFrame,
                     keys: Sequence[str], graph_keys: Sequence[str]) -> DataFrame:
    """Symbols of a unit that are used from outside it, plus its public surface.

    A reference from a file nobody owns counts as outside (null-safe inequality). Equal
    references may occur several times. Where sources are fewer than references, these can
    have their ``src_unit`` already (``with_source_units``) and are shuffled once less.
    """
    keys, gk = list(keys), list(graph_keys)
    targets = unit_files.select(*keys, "unit", F.col("path").alias("dst")).distinct()
    met = targets.join(refs, [*gk, "dst"])
    used = (
        (met if "src_unit" in refs.columns else with_source_units(met, owner, keys))
        .where(~F.col("src_unit").eqNullSafe(F.col("unit")))
        .select(*keys, "unit", F.col("symbol").alias("value"))
    )
    public = (
        unit_files.select(*keys, "unit", "path").distinct()
        .join(surface, [*gk, "path"])
        .select(*keys, "unit", F.col("symbol").alias("value"))
    )
    return used.unionByName(public).distinct()


def contract_values(unit_files: DataFrame, owner: DataFrame, listed: DataFrame, declared: DataFrame,
                    refs: DataFrame, surface: DataFrame, effects: DataFrame,
                    keys: Sequence[str], graph_keys: Sequence[str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Claimed and actual (unit, value) rows for entrypoints and for effects."""
    gk, uk = list(graph_keys), [*keys, "unit"]
    detected = (
        unit_files.select(*uk, "path").distinct().join(effects, [*gk, "path"])
        .select(*uk, F.col("kind").alias("value")).distinct()
    )
    return {
        "entrypoint": (
            listed.select(*uk, last_segment("name").alias("value")),
            true_entrypoints(unit_files, owner, refs, surface, keys, gk),
        ),
        "effect": (declared.select(*uk, F.col("kind").alias("value")), detected),
    }


def unit_contracts(units: DataFrame, values: dict[str, tuple[DataFrame, DataFrame]],
                   keys: Sequence[str]) -> DataFrame:
    """Entrypoint and effect precision/recall per unit."""
    uk = [*keys, "unit"]
    ep = precision_recall(*values["entrypoint"], units, uk)
    ef = precision_recall(*values["effect"], units, uk)
    return ep.select(
        *uk, F.col("precision").alias("entrypoint_p"), F.col("recall").alias("entrypoint_r"),
        (F.col("n_actual") > 0).alias("entered_from_outside"), F.col("n_missed").alias("n_missed_entrypoints"),
    ).join(ef.select(
        *uk, F.col("precision").alias("effects_p"), F.col("recall").alias("effects_r"),
        F.col("n_missed").alias("n_undeclared_effects"),
    ), uk)


def contract_summary(per_unit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run-level means over the units where a value exists."""
    names = ("entrypoint_p", "entrypoint_r", "effects_p", "effects_r")
    return per_unit.groupBy(*keys).agg(
        *[F.avg(n).alias(n) for n in names],
        F.count_if(F.col("n_missed_entrypoints") > 0).alias("units_with_missed_entrypoints"),
        F.count_if(F.col("n_undeclared_effects") > 0).alias("units_with_undeclared_effects"),
    )


def lint_findings(scope: DataFrame, owner: DataFrame, unpartitioned: DataFrame, depends: DataFrame,
                  unit_names: DataFrame, values: dict[str, tuple[DataFrame, DataFrame]],
                  keys: Sequence[str]) -> DataFrame:
    """The manifest invariants as one findings table (invariant, subject).

    I1 a file in no unit, not excluded and not set aside; I2 a used entrypoint that is
    not listed; I3 a dependency on a unit that does not exist; I4 an undeclared effect.
    """
    keys, uk = list(keys), [*keys, "unit"]
    find = lambda df, code, subject: df.select(*keys, F.lit(code).alias("invariant"), subject.alias("subject"))
    unassigned = (
        scope.join(owner.select(*keys, "path"), [*keys, "path"], "left_anti")
        .join(unpartitioned.select(*keys, "path"), [*keys, "path"], "left_anti")
    )
    dangling = depends.select(*uk).distinct().join(unit_names.select(*uk), uk, "left_anti")
    missing = lambda pair: differences(*pair, uk).where(F.col("side") == "missed")
    in_unit = F.concat_ws(":", F.col("unit"), F.col("value"))
    return (
        find(unassigned, "I1", F.col("path"))
        .unionByName(find(missing(values["entrypoint"]), "I2", in_unit))
        .unionByName(find(dangling, "I3", F.col("unit")))
        .unionByName(find(missing(values["effect"]), "I4", in_unit))
    )
