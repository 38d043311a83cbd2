"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Every text becomes its set of hashed word shingles; equal sets are one entity. A count
   sketch of fixed size over all sets says how frequent shingles are; any order gives the
   same links, a rare-first one gives few candidates.
2. Of each set, the prefix that any partner must meet is written with lengths and places.
   Prefix shingles that only one entity has end there.
3. Per shingle, the set in which it comes earliest is the pivot, and every set is compared with
   the pivot it shares most shingles with. Sets in groups of near copies thus meet in one
   component with one comparison each.
4. Then all pairs of sets that share a prefix shingle and are not in one component yet pass the
   length and positional filters inside blocks of at most ``BLOCK`` sets a side (a frequent
   shingle is dealt to as many block pairs as it needs), are made distinct, pass the suffix filter
   (the sets' counts in 64 ranges of hashes differ by no more than a link allows) and are
   compared once on whole sets.

So no link between different components is lost, and no group is expanded into all its pairs.
Shingles and sets are told apart by 64-bit hashes. Joins to texts are merges at any size.

Defined cases: a text without words has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; null doc_ids are the largest; rows equal in doc_id and
text are one document; a text of any length is one set, whose shingles are rows; an empty table
gives no rows; extra columns are kept by ``one_of_each`` and ignored by ``classes``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytework import distinct, mix, shingles
from .common import slices
from .tables import components, drop, written

SKETCH_BITS = 20
_PARTS = 64
_RANGES = 64
BLOCK = 2048

_META = "doc_id long, text_hash long, n long, sid long, ranges binary, part int, counts binary"
_PREFIX = "token long, sid long, n int, pos int"


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                            F.coalesce("text", F.lit("")).cast("binary").alias("body"))


def _needed(total, part: int):
    """Least common shingles of two linked sets with ``total`` shingles together, for a Jaccard of part/100."""
    return -(-part * total // (100 + part))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given lengths."""
    ends = np.cumsum(counts)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[ends - counts]


def _set_ids(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return mix(_sums(mix(hashes + np.uint64(1)), counts) + counts.astype(np.uint64)).view(np.int64)


def _measure(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()),
                            ("ranges", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in slices(batches, "body"):
            rows, hashes = distinct(*shingles(batch.column("body"), size))
            n = np.bincount(rows, minlength=batch.num_rows)
            sketch += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            at = rows * _RANGES + (hashes & np.uint64(_RANGES - 1)).astype(np.int64)
            ranges = np.minimum(np.bincount(at, minlength=batch.num_rows * _RANGES), 65535).astype("<u2").tobytes()
            packed = [ranges[i:i + 2 * _RANGES] for i in range(0, len(ranges), 2 * _RANGES)]
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), pa.array(n), pa.array(_set_ids(hashes, n)),
                pa.array(packed, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        parts = [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(_PARTS, -1)]
        none = pa.nulls(_PARTS)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64())] * 4 + [none.cast(pa.binary()), pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            values = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            totals[part] = totals[part] + values if part in totals else values
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(totals), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in totals.values()], pa.binary())})


def _ranks(measured: DataFrame) -> np.ndarray:
    """Frequency ranks of the sketch's cells, one byte each: a megabyte whatever the corpus."""
    dealt = measured.where("part IS NOT NULL").select("part", "counts").repartition(_PARTS, "part")
    total = np.zeros((_PARTS, (1 << SKETCH_BITS) // _PARTS), dtype=np.int64)
    for r in dealt.mapInArrow(_merge, "part int, counts binary").collect():
        total[r["part"]] += np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.int64)
    return np.minimum(4 * np.log2(total.ravel() + 1.0), 255).astype(np.uint8)


def _prefixes(size: int, part: int, ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, dtype=np.int64)
        for batch in slices(batches, "body"):
            rows, hashes = shingles(batch.column("body"), size)
            rows, hashes = distinct(rows, hashes, ranks[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])
            n = np.bincount(rows, minlength=batch.num_rows)
            sid = _set_ids(hashes, n)
            fresh = np.zeros(len(sid), dtype=bool)  # of equal sets a task passes on one
            fresh[np.unique(sid, return_index=True)[1]] = True
            fresh &= ~np.isin(sid, told) & (n > 0)
            told = np.concatenate([told, sid[fresh]])
            prefix = n - (-(-part * n // 100)) + 1
            place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            use = fresh[rows] & (place < prefix[rows])
            rows = rows[use]
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(hashes[use].view(np.int64)), "sid": pa.array(sid[rows]),
                "n": pa.array(n[rows].astype(np.int32)), "pos": pa.array(place[use].astype(np.int32))})

    return run


def _star(near: DataFrame, part: int) -> DataFrame:
    """Each set with the pivot that it shares most prefix shingles with."""
    pivots = written(near.groupBy("token").agg(F.min(F.struct("pos", "n", "sid")).alias("p")))
    met = near.join(pivots, "token").where("sid <> p.sid").select("sid", "n", F.col("p.sid").alias("b"), F.col("p.n").alias("m"))
    met = met.where((100 * F.least("n", "m") >= part * F.greatest("n", "m")))
    counted = met.groupBy("sid", "b").agg(F.count("*").alias("k"))
    return counted.groupBy("sid").agg(F.max(F.struct("k", "b")).alias("x")).select(F.col("sid").alias("a"), F.col("x.b").alias("b"))


def _blocks(near: DataFrame) -> DataFrame:
    """Rows dealt to pairs of blocks (i, j): every pair of sets of a shingle meets in exactly one."""
    count = F.ceil(F.col("df") / BLOCK)
    own = F.pmod(F.xxhash64("sid"), count).cast("int")
    return (
        near.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "sid", "n", "pos", "root")
    )


def _pairs(part: int):
    """Pairs that pass the length and positional filters, from rows sorted by shingle, block pair, length and set."""

    def emit(run: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, pos, root, sid = (run[k] for k in ("n", "pos", "root", "sid"))
        across = bool(run["i"][0] != run["j"][0])
        left, right = [], []
        for x in range(len(n) - 1):
            y = slice(x + 1, np.searchsorted(n, 100 * n[x] // part, side="right"))
            most = 1 + np.minimum(n[x] - pos[x] - 1, n[y] - pos[y] - 1)
            fits = (root[y] != root[x]) & (most >= _needed(n[x] + n[y], part))
            if across:
                fits &= run["second"][y] != run["second"][x]
            hit = np.flatnonzero(fits) + x + 1
            if len(hit):
                left.append(np.full(len(hit), sid[x]))
                right.append(sid[hit])
        none = np.zeros(0, np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            new = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            held = {k: np.concatenate([held[k], v]) if held else v for k, v in new.items()}
            edges = _edges(held)
            yield from whole(held, edges[:-1])
            held = {k: v[edges[-2]:] for k, v in held.items()}
        if held:
            yield from whole(held, _edges(held))

    def whole(rows: dict[str, np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [emit({k: v[s:e] for k, v in rows.items()}) for s, e in zip(edges[:-1], edges[1:]) if e - s > 1]
        found = [x for x in found if len(x[0])]
        if found:
            a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    def _edges(rows: dict[str, np.ndarray]) -> np.ndarray:
        new = np.zeros(len(rows["n"]) - 1, dtype=bool)
        for k in ("token", "i", "j"):
            new |= rows[k][1:] != rows[k][:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows["n"])]])

    return run


def _suffix_filter(pairs: DataFrame, sets: DataFrame, part: int) -> DataFrame:
    """Pairs whose counts in ranges of hashes differ by no more than linked sets can differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = [np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(-1, _RANGES).astype(np.int64) for k in ("x", "y")]
            total = batch.column("total").to_numpy()
            keep = np.abs(counts[0] - counts[1]).sum(axis=1) <= total - 2 * _needed(total, part)
            yield pa.RecordBatch.from_pydict({k: batch.column(k).filter(pa.array(keep)) for k in ("a", "b")})

    left = sets.select(F.col("sid").alias("a"), F.col("ranges").alias("x"), F.col("n").alias("n_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("ranges").alias("y"), F.col("n").alias("n_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("n_a") + F.col("n_b")).alias("total"))
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, part: int) -> DataFrame:
    """The pairs that are links, compared on their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "x"), "y"):
            lists = []
            for k in ("x", "y"):
                rows, hashes = distinct(*shingles(batch.column(k), size))
                lists.append(np.split(hashes, np.searchsorted(rows, np.arange(1, batch.num_rows))))
            keep = []
            for x, y in zip(*lists):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= part * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({k: batch.column(k).filter(pa.array(keep, pa.bool_())) for k in ("a", "b")})

    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    chosen = written(wanted.join(sets, "sid").select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"), "sid"))
    bodies = texts.join(chosen.hint("merge"), (texts["text_hash"] == chosen["__hash"]) & texts["doc_id"].eqNullSafe(chosen["__id"]))
    bodies = written(bodies.select("sid", "body").dropDuplicates(["sid"]))
    both = (
        pairs.join(bodies.select(F.col("sid").alias("a"), F.col("body").alias("x")), "a")
        .join(bodies.select(F.col("sid").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y")
    )
    return both.mapInArrow(run, "a long, b long")


def classes(documents: DataFrame, size: int, part: int) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, and first, the smallest (no_id, doc_id, text_hash) of its component.

    ``size`` words make a shingle; documents link at a Jaccard of ``part`` per cent or more.
    """
    texts = _texts(documents)
    measured = written(texts.mapInArrow(_measure(size), _META))
    meta = measured.where("part IS NULL")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    sets = written(meta.where("n > 0").groupBy("sid").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("ranges").alias("ranges")))
    prefixes = written(texts.select("body").mapInArrow(_prefixes(size, part, _ranks(measured)), _PREFIX))
    counts = prefixes.groupBy("token").agg(F.count("*").alias("df"), F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high")
    counted = written(counts.select("token", "df"))
    near = written(prefixes.join(counted, "token"))
    drop(prefixes, counted)
    links = written(_verified(written(_star(near, part)), sets, texts, size, part))
    found = components(links).withColumnRenamed("node", "sid")
    labelled = near.join(found, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    open_tokens = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    open_tokens = written(open_tokens)
    dealt = _blocks(labelled.join(open_tokens, "token", "left_semi")).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "sid")
    pairs = written(_suffix_filter(dealt.mapInArrow(_pairs(part), "a long, b long").distinct(), sets, part))
    more = written(_verified(pairs, sets, texts, size, part))
    drop(near, open_tokens, pairs)
    final = components(links.union(more)).withColumnRenamed("node", "sid")
    drop(links, more)
    rooted = sets.select("sid", "first").join(final, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    of_set = rooted.select("sid", "root").join(least, "root").select("sid", "first")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    return meta.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid"), own.alias("own")).join(of_set, "sid", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("first", "own").alias("first"))


def digest(documents: DataFrame, size: int = 3, part: int = 90) -> DataFrame:
    return classes(documents, size, part).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, size: int = 5, part: int = 80) -> DataFrame:
    """The documents without those that have a smaller one in their component; columns and texts stay as they are."""
    found = classes(documents, size, part)
    gone = written(
        found.where((F.col("first.text_hash") != F.col("text_hash")) | ~F.col("first.doc_id").eqNullSafe(F.col("doc_id")))
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    keyed = documents.withColumn("__text_hash", F.xxhash64("text"))
    on = (keyed["__text_hash"] == gone["__hash"]) & keyed["doc_id"].eqNullSafe(gone["__id"])
    return keyed.join(gone.hint("merge"), on, "left_anti").select(*documents.columns)
