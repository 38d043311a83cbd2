"""Merkle manifest of a dataset: stored levels of runs, and a recursive query that climbs them.

Every document is a leaf, the leaves of a language make a tree and the roots of the trees make
one more. Nodes are hashed in runs of ``ARITY``; a level has an eighth of the nodes of the one
below it, so it is one more grouping of bounded groups, whatever the share of a language.
A stored run holds the digests of its nodes and the place of its own node one level up.

Proofs come from the stored levels alone. ``climb`` is a recursive query of Spark: a leaf looks
up its run, gives out its siblings there, folds the digest it claims with them, and goes on from
the run's place above, until there is none. Every step gives out its own siblings only; they are
strung together once at the end, so a row does not grow with the height of its tree.

Defined cases: a null is hashed as ``-``, other values with their length, so that neighbours
cannot run into each other; a null language is a tree of its own and the first; a null doc_id comes
first in its tree and is never tampered with; rows equal in doc_id are ordered by their digests, and
equal rows are leaves of their own with equal digests; a text of any length is hashed in its row; an
empty table has no leaves, no runs and no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import number_rows
from .common import join_counted
from .tables import drop, written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1  # tree of the other trees' roots
_DIGEST = 32
_ROWS_SETTING = "spark.sql.cteRecursionRowLimit"
_RUN = "tree long, level int, run long, nodes binary, up_tree long, up_level int, up_run long, up_slot int"


@dataclass(frozen=True)
class Manifest:
    """leaves: leaf_id, doc_id, lang, leaf, start of the climb; runs: stored levels; trees: lang, tree, n, subroot."""

    leaves: DataFrame
    runs: DataFrame
    trees: DataFrame
    root: DataFrame

    def save(self, path: str) -> None:
        for name in ("leaves", "runs", "trees", "root"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Manifest:
        return Manifest(*[spark.read.parquet(f"{path}/{name}") for name in ("leaves", "runs", "trees", "root")])


def _hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(**instead: Column) -> Column:
    """Digest of a document's fields; ``instead`` gives other values for some of them."""
    def part(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return _hashed(F.concat(*[part(name) for name in FIELDS]))


def _up(tree: Column, level: Column, index: Column) -> tuple[Column, ...]:
    return tree.alias("up_tree"), level.cast("int").alias("up_level"), F.floor(index / ARITY).alias("up_run"), F.pmod(index, F.lit(ARITY)).cast("int").alias("up_slot")


def _levels(nodes: DataFrame, sizes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of all levels, one table each, and tree, subroot.

    ``nodes`` has tree, index, digest; ``sizes`` has tree and n, its number of nodes. Trees that are
    down to one node leave the loop.
    """
    runs, roots = [], []
    level, n = 0, largest
    while True:
        alone = nodes.join(sizes.where(F.col("n") <= ARITY ** level), "tree")
        roots.append(alone.select("tree", F.col("digest").alias("subroot")))
        if n <= 1:
            break
        several = nodes.join(sizes.where(F.col("n") > ARITY ** level).select("tree"), "tree", "left_semi")
        members = F.sort_array(F.collect_list(F.struct(F.pmod("index", F.lit(ARITY)).alias("slot"), _hex(F.col("digest")).alias("hash"))))
        hashes = several.groupBy("tree", F.floor(F.col("index") / ARITY).alias("run")).agg(F.array_join(F.transform(members, lambda m: m["hash"]), "").alias("hashes"))
        run = written(hashes.select("tree", F.lit(level).alias("level"), "run", F.unhex("hashes").alias("nodes"), _hashed(F.col("hashes")).alias("digest")))
        runs.append(run)
        nodes = run.select("tree", F.col("run").alias("index"), "digest")
        level, n = level + 1, -(-n // ARITY)
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.union(more)
    return runs, subroots


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (doc_id, lang, leaf and any further columns, which its table of leaves keeps)."""
    rest = [c for c in leaves.columns if c not in ("doc_id", "lang", "leaf")]
    kept = written(leaves)
    numbered = number_rows(kept, ["lang", "doc_id", "leaf"], "leaf_id")
    counted = written(numbered.groupBy("lang").agg(F.min("leaf_id").alias("first"), F.count("*").alias("n")))
    trees = written(number_rows(counted, ["lang"], "tree"))
    n_trees, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = join_counted(numbered.withColumnRenamed("lang", "own_lang"), trees, F.col("own_lang").eqNullSafe(F.col("lang")))
    alone, inside = _up(F.lit(_TOP).cast("long"), F.lit(0), F.col("tree")), _up(F.col("tree"), F.lit(0), F.col("leaf_id") - F.col("first"))
    names = ("up_tree", "up_level", "up_run", "up_slot")
    top = F.lit(n_trees > 1)
    starts = [F.when(F.col("n") > 1, i).when(top, a).alias(name) for i, a, name in zip(inside, alone, names)]
    climbers = written(placed.select("leaf_id", "doc_id", "lang", "leaf", *rest, "tree", (F.col("leaf_id") - F.col("first")).alias("index"), *starts))
    drop(kept, counted)

    runs, subroots = _levels(climbers.select("tree", "index", F.col("leaf").alias("digest")), trees.select("tree", "n"), largest)
    subroots = written(subroots)
    over, root = _levels(
        subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("subroot").alias("digest")),
        subroots.agg(F.count("*").alias("n")).select(F.lit(_TOP).cast("long").alias("tree"), "n"), n_trees)
    linked = []
    for level, run in enumerate(runs):
        more = run.join(trees.select("tree", "n"), "tree")
        ends = F.col("n") <= ARITY ** (level + 1)
        ups = [F.when(~ends, i).when(top, a).alias(name) for i, a, name in zip(_up(F.col("tree"), F.lit(level + 1), F.col("run")), alone, names)]
        linked.append(more.select("tree", "level", "run", "nodes", *ups))
    for level, run in enumerate(over):
        ups = [F.when(F.lit(level + 1 < len(over)), i).alias(name) for i, name in zip(_up(F.col("tree"), F.lit(level + 1), F.col("run")), names)]
        linked.append(run.select("tree", "level", "run", "nodes", *ups))
    spark = leaves.sparkSession
    stored = linked[0] if linked else spark.createDataFrame([], _RUN)
    for more in linked[1:]:
        stored = stored.union(more)
    manifest = Manifest(climbers, written(stored), written(trees.select("lang", "tree", "n").join(subroots, "tree")), written(root.select(F.col("subroot").alias("root"))))
    drop(trees, subroots, *runs, *over)
    return manifest


_CLIMB = """
WITH RECURSIVE climb(leaf_id, step, folded, siblings, up_tree, up_level, up_run, up_slot) AS (
  SELECT leaf_id, 0, claimed, X'', up_tree, up_level, up_run, up_slot FROM {claims}
  UNION ALL
  SELECT c.leaf_id, c.step + 1,
    unhex(sha2(lower(hex(concat(substring(r.nodes, 1, {digest} * c.up_slot), c.folded, substring(r.nodes, {digest} * (c.up_slot + 1) + 1)))), 256)),
    concat(substring(r.nodes, 1, {digest} * c.up_slot), substring(r.nodes, {digest} * (c.up_slot + 1) + 1)),
    r.up_tree, r.up_level, r.up_run, r.up_slot
  FROM climb c JOIN {runs} r ON c.up_tree = r.tree AND c.up_level = r.level AND c.up_run = r.run)
SELECT leaf_id, step, folded, siblings FROM climb
"""


@contextmanager
def _rows_unlimited(spark: SparkSession) -> Iterator[None]:
    """The rows of a recursion are those of leaves times height; Spark's limit for runaway queries stands again afterwards."""
    limit = spark.conf.get(_ROWS_SETTING)
    spark.conf.set(_ROWS_SETTING, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROWS_SETTING, limit)


def climb(manifest: Manifest, claims: DataFrame) -> DataFrame:
    """leaf_id, step, folded digest and siblings of every step of every claim.

    ``claims`` has leaf_id, claimed and the start of the climb (up_tree, up_level, up_run,
    up_slot) of the manifest's leaves.
    """
    return claims.sparkSession.sql(_CLIMB.format(claims="{claims}", runs="{runs}", digest=_DIGEST), claims=claims, runs=manifest.runs)


def folded(manifest: Manifest, claims: DataFrame, proof: bool = True) -> DataFrame:
    """leaf_id, the root its claim folds to, and the proof (siblings from the leaf up, as hexadecimal text) with its SHA-256.

    The steps of the recursion are grouped as they come and not written; without ``proof`` only its hash is kept.
    """
    each = F.sort_array(F.collect_list(F.struct("step", "siblings", "folded")))
    text = F.array_join(F.transform("steps", lambda s: _hex(s["siblings"])), "")
    with _rows_unlimited(claims.sparkSession):
        steps = climb(manifest, claims).groupBy("leaf_id").agg(each.alias("steps"))
        told = steps.select("leaf_id", F.element_at("steps", -1)["folded"].alias("folded_root"), text.alias("proof")).withColumn(
            "proof_sha256", F.sha2(F.col("proof").cast("binary"), 256))
        return written(told if proof else told.drop("proof"))


def manifest_of(documents: DataFrame) -> Manifest:
    """The manifest of a table of documents."""
    return build(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf().alias("leaf")))


def verify(manifest: Manifest, documents: DataFrame) -> DataFrame:
    """doc_id, verified for every row of ``documents``: whether it is what the manifest's root was made of.

    Rows find their place by doc_id, which must name one leaf; a row without a place is not verified.
    """
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("claimed"))
    places = manifest.leaves.select(F.col("doc_id").alias("own"), "leaf_id", "up_tree", "up_level", "up_run", "up_slot")
    claims = written(found.join(places, F.col("doc_id").eqNullSafe(F.col("own")), "left"))
    claimed = folded(manifest, claims.where("leaf_id IS NOT NULL").drop("doc_id", "own"), proof=False)
    roots = claimed.join(F.broadcast(manifest.root), F.col("folded_root") == F.col("root"), "left_semi").select(F.col("leaf_id").alias("good"))
    return claims.join(roots, F.col("leaf_id") == F.col("good"), "left").select("doc_id", F.col("good").isNotNull().alias("verified"))


def digest(documents: DataFrame) -> DataFrame:
    """Per document: its leaf, roots, the hash of its proof, and the root folded from a tampered leaf in a third of the rows."""
    small = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    hashed = documents.select(*FIELDS).withColumn("doc_id", F.col("doc_id").cast("long")).select(
        "doc_id", "lang", leaf().alias("leaf"), F.when(tampers, leaf(text=small)).alias("tampered"))
    manifest = build(hashed)
    start = ("up_tree", "up_level", "up_run", "up_slot")
    tops = folded(manifest, manifest.leaves.select("leaf_id", F.coalesce("tampered", "leaf").alias("claimed"), *start), proof=False)
    own = manifest.leaves.select("leaf_id", "doc_id", "leaf", "tree")
    subroots = manifest.trees.select(F.col("tree").alias("its_tree"), "subroot")
    told = join_counted(own.join(tops, "leaf_id"), subroots, F.col("tree") == F.col("its_tree")).join(F.broadcast(manifest.root))
    return told.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        "proof_sha256", _hex(F.col("folded_root")).alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of the decimal digits is computed from its table of 256 values, which is computed from its polynomial.
ORACLE = f"""
WITH RECURSIVE crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))),
docs AS (SELECT row_number() OVER () AS r, doc_id, lang,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]))) % 3 = 0 AS tampers FROM documents, crc),
hashed AS (SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN tampers THEN
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM hashed),
nodes(tree, level, i, h, n) AS (SELECT tree, 0, i, leaf, n FROM placed UNION ALL
  SELECT tree, level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (max(n) + {ARITY - 1}) // {ARITY} FROM nodes WHERE n > 1 GROUP BY tree, level, i // {ARITY}),
subroots AS (SELECT tree, h AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
over(level, i, h, n) AS (SELECT 0, tree, subroot, n FROM subroots UNION ALL
  SELECT level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (max(n) + {ARITY - 1}) // {ARITY} FROM over WHERE n > 1 GROUP BY level, i // {ARITY}),
tops AS (SELECT h AS root FROM over WHERE n = 1),
climb(r, tree, level, i, cur, proof) AS (SELECT r, tree, 0, i, coalesce(tampered, leaf), '' FROM placed UNION ALL
  SELECT c.r, c.tree, c.level + 1, c.i // {ARITY}, sha256(string_agg(CASE WHEN o.i = c.i THEN c.cur ELSE o.h END, '' ORDER BY o.i)),
    any_value(c.proof) || coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i <> c.i), '')
  FROM climb c JOIN nodes o ON o.tree = c.tree AND o.level = c.level AND o.i // {ARITY} = c.i // {ARITY} AND o.n > 1 GROUP BY c.r, c.tree, c.level, c.i),
below AS (SELECT r, tree, cur, proof FROM climb QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1),
rise(r, level, i, cur, proof) AS (SELECT r, 0, tree, cur, proof FROM below UNION ALL
  SELECT c.r, c.level + 1, c.i // {ARITY}, sha256(string_agg(CASE WHEN o.i = c.i THEN c.cur ELSE o.h END, '' ORDER BY o.i)),
    any_value(c.proof) || coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i <> c.i), '')
  FROM rise c JOIN over o ON o.level = c.level AND o.i // {ARITY} = c.i // {ARITY} AND o.n > 1 GROUP BY c.r, c.level, c.i),
done AS (SELECT r, cur, proof FROM rise QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(d.proof) AS proof_sha256, d.cur AS folded_root, d.cur = t.root AS verified
FROM placed p JOIN subroots s USING (tree) CROSS JOIN tops t JOIN done d USING (r)
"""
