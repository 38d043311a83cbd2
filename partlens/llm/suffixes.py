"""Suffix-array dedup of byte strings that repeat anywhere, with deep-shallow sorting.

A string of ``SPAN`` bytes that starts at two places is removed at both. Sorting every suffix of a
corpus would move each byte hundreds of times, so suffixes are sorted where they can matter:

1. Of all grams of ``GRAM`` bytes in a string of ``SPAN`` bytes the one with the smallest hash leads
   it. Equal strings have equal leaders at the same offset; a gram that leads at one place only
   ends there. Equal texts are one text with a flag.
2. Around every shared gram, the bytes of the strings it leads are its context. Equal contexts
   are one, with a flag that they repeat as a whole.
3. Contexts of one gram are sorted as suffixes to the right of the gram, and as reversed ones to
   its left: multikey quicksort down to ``SHALLOW`` bytes, and blind tries for groups that still
   agree there. The longest common prefixes of neighbours give those of all pairs, and so the first
   and last string of every context that another one has too.
4. Grams with more than ``GROUP`` different contexts are not gathered: each of their strings is
   hashed (128 bits) and counted by Spark, which gives the same answer.

What is looked up by a key that many rows share is written first: joins of two plain tables
are split by AQE where a key is hot. Joins to texts are merges at any size, so that what a run needs
follows its input.

All strings led by a gram contain it, so what is removed around it is one interval; the
intervals of a text are merged. Grams and texts are told apart by 64-bit hashes.

Defined cases: null and empty texts have nothing to remove; texts shorter than SPAN neither; rows
with equal texts are cut alike; an empty table gives no rows; a text of any length is read in
one go; in ``cut_documents`` a character cut in two is dropped and a null text stays null; columns named
``__tid``, ``__body`` or ``__spans`` must not be there already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytework import buffer_of, prefix_hashes, stretch_hashes
from .common import slices
from .tables import drop, written

SPAN = 400
GRAM = 100
#: Passages of over 50 words may have far fewer bytes than SPAN: the length, and grams, for finding these.
PASSAGE = 250
PASSAGE_GRAM = 64
SHALLOW = 32
GROUP = 20_000
_STEP = 8


class BlindTrie:
    """Sorts strings that agree on a long prefix; inner nodes keep depths and branching bytes only."""

    def __init__(self, texts: Sequence[bytes]):
        self._texts, self._root = texts, None

    def insert(self, index: int) -> None:
        text = self._texts[index]
        if self._root is None:
            self._root = index
            return
        node = self._root
        while isinstance(node, list):  # blindly down to any leaf
            depth, children = node
            mark = text[depth] if depth < len(text) else -1
            node = children[mark] if mark in children else next(iter(children.values()))
        leaf = self._texts[node if isinstance(node, int) else node[0]]
        depth = common_prefix(text, leaf)
        if depth == len(text) == len(leaf):
            raise ValueError("strings in a blind trie differ")
        parent, mark, node = None, None, self._root
        while isinstance(node, list) and node[0] < depth:
            parent, mark = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(mark)
        own = text[depth] if depth < len(text) else -1
        if isinstance(node, list) and node[0] == depth:
            node[1][own] = index
            return
        other = leaf[depth] if depth < len(leaf) else -1
        new = [depth, {own: index, other: node}]
        if parent is None:
            self._root = new
        else:
            parent[1][mark] = new

    def ordered(self) -> Iterator[int]:
        stack = [self._root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_shallow(texts: Sequence[bytes], depth: int = 0) -> list[int]:
    """Indices of ``texts`` in order; all agree on their first ``depth`` bytes. Equal strings keep their order."""
    limit, done = depth + SHALLOW, []
    stack = [(list(range(len(texts))), depth)]
    while stack:
        group, at = stack.pop()
        if len(group) < 2:
            done += group
        elif at >= limit:
            done += _blind(texts, group)
        else:
            pivot = texts[group[len(group) // 2]][at:at + _STEP]
            less, same, more = [], [], []
            for i in group:
                key = texts[i][at:at + _STEP]
                (less if key < pivot else more if key > pivot else same).append(i)
            stack.append((more, at))
            stack.append((same, at + _STEP) if len(pivot) == _STEP else (same, limit))
            stack.append((less, at))
    return done


def _blind(texts: Sequence[bytes], group: list[int]) -> list[int]:
    firsts: dict[bytes, list[int]] = {}
    for i in group:
        firsts.setdefault(texts[i], []).append(i)
    trie = BlindTrie(texts)
    for equal in firsts.values():
        trie.insert(equal[0])
    return [i for k in trie.ordered() for i in firsts[texts[k]]]


def neighbour_prefixes(texts: Sequence[bytes], order: Sequence[int]) -> np.ndarray:
    return np.array([common_prefix(texts[a], texts[b]) for a, b in zip(order, order[1:])], dtype=np.int64)


def _with_all(order: np.ndarray, prefixes: np.ndarray, place: int) -> np.ndarray:
    """Common prefix of the string at ``place`` of the order with every string, by index; -1 with itself."""
    out = np.empty(len(order), dtype=np.int64)
    out[order[place]] = -1
    if place + 1 < len(order):
        out[order[place + 1:]] = np.minimum.accumulate(prefixes[place:])
    if place:
        out[order[:place]] = np.minimum.accumulate(prefixes[:place][::-1])[::-1]
    return out


def shared_reach(left: Sequence[bytes], right: Sequence[bytes], span: int = SPAN, known: int = 0) -> list[tuple[int, int] | None]:
    """For contexts of one gram, the least and largest offset of the gram in a string that another context has too.

    ``left`` holds the bytes before the gram reversed, ``right`` those from it on (they agree
    on the first ``known``).
    """
    if len(left) == 2:
        a, b = common_prefix(left[0], left[1]), common_prefix(right[0], right[1])
        return [(span - b, a)] * 2 if a + b >= span else [None, None]
    orders = [np.array(deep_shallow(texts, depth)) for texts, depth in ((left, 0), (right, known))]
    prefixes = [neighbour_prefixes(texts, order) for texts, order in zip((left, right), orders)]
    places = [np.argsort(order) for order in orders]
    found = []
    for i in range(len(left)):
        a, b = (_with_all(orders[k], prefixes[k], places[k][i]) for k in (0, 1))
        hit = (a + b >= span) & (b >= 0)
        found.append((span - int(b[hit].max()), int(a[hit].max())) if hit.any() else None)
    return found


def _leaders(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Places of leading grams, their hashes, rows, and the first and last string each leads."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    width = span - gram + 1
    if len(data) < span:
        return none
    starts = np.arange(len(data) - gram + 1)
    hashes = stretch_hashes(prefix_hashes(data), starts, starts + gram)
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    packed = ((hashes >> bits) << bits) | starts.astype(np.uint64)
    # smallest of every ``width`` in a row, from minima within blocks
    padded = np.full(-(-len(packed) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(packed)] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(packed) - width + 1
    least = np.minimum(behind[:n], ahead[width - 1: width - 1 + n])
    window = np.arange(n)
    row = np.searchsorted(offsets, window, side="right") - 1
    valid = window + span <= offsets[row + 1]
    window, row = window[valid], row[valid]
    if not len(window):
        return none
    leader = (least[valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(leader), dtype=bool)
    new[1:] = leader[1:] != leader[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(leader)) - 1
    return leader[first], hashes[leader[first]].view(np.int64), row[first], window[first], window[last]


def _grams(batches: Iterator[pa.RecordBatch], span: int, gram_size: int) -> Iterator[pa.RecordBatch]:
    """gram, tid, pos of the leading grams; of equal texts a task reads one."""
    told: set[int] = set()
    for batch in slices(batches, "body"):
        tids = batch.column("tid").to_numpy()
        fresh = [t not in told and not told.add(t) for t in tids.tolist()]
        batch = batch.filter(pa.array(fresh))
        data, offsets = buffer_of(batch.column("body"))
        place, gram, row, _, _ = _leaders(data, offsets, span, gram_size)
        yield pa.RecordBatch.from_pydict({
            "gram": pa.array(gram), "tid": batch.column("tid").take(pa.array(row)), "pos": pa.array(place - offsets[row] if len(row) else place)})


_CONTEXT = "gram long, tid long, pos long, ahead int, h1 long, h2 long, context binary"


def _contexts(batches: Iterator[pa.RecordBatch], span: int, gram_size: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the shared grams of every text: ``ahead`` bytes stand before the gram."""
    for batch in slices(batches, "body"):
        data, offsets = buffer_of(batch.column("body"))
        place, gram, row, first, last = _leaders(data, offsets, span, gram_size)
        tids, shared, whole = batch.column("tid").to_pylist(), batch.column("places").to_pylist(), data.tobytes()
        wanted = {(r, p) for r, ps in enumerate(shared) for p in ps}
        rows = []
        for g, at, r, s, e in zip(gram.tolist(), place.tolist(), row.tolist(), first.tolist(), last.tolist()):
            pos = at - int(offsets[r])
            if (r, pos) in wanted:
                context = whole[s:e + span]
                digest = hashlib.blake2b(context, digest_size=16).digest()
                rows.append((g, tids[r], pos, at - s, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), context))
        kinds = (*[pa.int64()] * 3, pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _CONTEXT.split(", ")])


_REACH = "gram long, ahead int, h1 long, h2 long, low int, high int"


def _compare(batches: Iterator[pa.RecordBatch], span: int, gram_size: int) -> Iterator[pa.RecordBatch]:
    """Reach of every context among those of its gram, from rows sorted by gram."""
    def groups() -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in ("gram", "ahead", "h1", "h2", "context")]):
                if held and held[0][0] != row[0]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _REACH.split(", ")])

    out: list[tuple] = []
    for group in groups():
        reach = shared_reach([x[4][:x[1]][::-1] for x in group], [x[4][x[1]:] for x in group], span, gram_size)
        out += [(*x[:4], *r) for x, r in zip(group, reach) if r]
        if len(out) > 10_000:
            yield flush(out)
            out = []
    yield flush(out)


def _strings(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Every string of the contexts with its hash, for grams with too many contexts to gather."""
    for batch in batches:
        rows = []
        for gram, ahead, h1, h2, context in zip(*[batch.column(k).to_pylist() for k in ("gram", "ahead", "h1", "h2", "context")]):
            for at in range(len(context) - span + 1):
                rows.append((gram, ahead, h1, h2, ahead - at, hashlib.blake2b(context[at:at + span], digest_size=16).digest()))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], ["gram", "ahead", "h1", "h2", "offset", "string"])


def _texts(documents: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit("")).cast("binary")
    return documents.select("*", F.xxhash64(body).alias("__tid"), body.alias("__body"))


def spans(documents: DataFrame, group: int = GROUP, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """tid (hash of a text) and its stretches of repeated strings of ``span`` bytes as [start, end] pairs, unmerged; whole texts that occur twice."""
    texts = documents.select(F.col("__tid").alias("tid"), F.col("__body").alias("body"), F.col("doc_id").cast("long").alias("doc_id")).where(F.length("body") >= span)
    grams = written(texts.select("tid", "body").mapInArrow(partial(_grams, span=span, gram_size=gram), "gram long, tid long, pos long"))
    place = F.struct("tid", "pos")
    shared = written(grams.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("gram"))
    places = grams.join(shared, "gram", "left_semi").groupBy("tid").agg(F.collect_set("pos").alias("places"))
    counted = texts.groupBy("tid").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max(F.length("body")).alias("size"))
    chosen = written(places.join(counted, "tid").select(F.col("tid").alias("__t"), "places", "owner"))
    bodies = texts.join(chosen.hint("merge"), (texts["tid"] == chosen["__t"]) & texts["doc_id"].eqNullSafe(chosen["owner"]))
    drop(shared)
    contexts = written(bodies.select("tid", "body", "places").mapInArrow(partial(_contexts, span=span, gram_size=gram), _CONTEXT))
    drop(grams, chosen)
    key = ["gram", "ahead", "h1", "h2"]
    kinds = contexts.groupBy(*key).agg((F.min(place) != F.max(place)).alias("multi"), F.length(F.first("context")).alias("size"))
    sizes = written(kinds.groupBy("gram").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1"))
    several = written(contexts.select(*key, "context").dropDuplicates(key).join(sizes, "gram"))
    dealt = several.where(F.col("n_kinds") <= group).repartition("gram").sortWithinPartitions("gram")
    reach = dealt.select(*key, "context").mapInArrow(partial(_compare, span=span, gram_size=gram), _REACH)
    strings = several.where(F.col("n_kinds") > group).select(*key, "context").mapInArrow(
        partial(_strings, span=span), "gram long, ahead int, h1 long, h2 long, offset int, string binary")
    one = F.struct("ahead", "h1", "h2")
    twice = strings.groupBy("gram", "offset", "string").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low <> high").select("gram", "offset", "string")
    reach = reach.union(strings.join(twice, ["gram", "offset", "string"], "left_semi").groupBy(*key).agg(F.min("offset").alias("low"), F.max("offset").alias("high")).select(*key, "low", "high"))
    whole = kinds.where("multi").select(*key, (F.lit(span) - F.col("size") + F.col("ahead")).cast("int").alias("low"), F.col("ahead").alias("high"))
    reach = written(whole.union(reach).groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high")))
    drop(several, sizes)
    found = contexts.select(*key, "tid", "pos").join(reach, key).select(
        "tid", F.struct((F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + span).alias("end")).alias("span"))
    full = counted.where("n > 1").select("tid", F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end")).alias("span"))
    return found.union(full).groupBy("tid").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in () if found is None else found:
        if out and x["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["end"])
        else:
            out.append([x["start"], x["end"]])
    return [tuple(x) for x in out]


def _rest(body: bytes, cut: list[tuple[int, int]]) -> bytes:
    if not cut:
        return body
    edges = [0, *[e for pair in cut for e in pair], len(body)]
    return b"".join(body[s:e] for s, e in zip(edges[::2], edges[1::2]))


def _marked(documents: DataFrame, **found: DataFrame) -> DataFrame:
    """The texts with a column of spans for each written table of ``found`` (tid, spans); one join to the texts."""
    texts, every = _texts(documents), None
    for name, table in found.items():
        own = table.select(F.col("tid").alias("__t"), F.col("spans").alias(name))
        every = own if every is None else every.join(own, "__t", "full")
    return texts.join(every.hint("merge"), texts["__tid"] == every["__t"], "left").drop("__t")


def digest(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes, one row per document.

    ``n_shared`` and ``n_shared_spans`` count the bytes and runs of strings of ``PASSAGE`` bytes that occur
    elsewhere, too; these are found by the same steps and not removed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__body"):
            rows = []
            for doc, body, found, shared in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "__body", "__spans", "__shared")]):
                cut, same = merged(found), merged(shared)
                rows.append((
                    doc, len(body), sum(e - s for s, e in cut), len(cut), hashlib.sha256(_rest(body, cut)).hexdigest(), sum(e - s for s, e in same), len(same)))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "n_shared_spans"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = _texts(plain)
    marked = _marked(plain, __spans=written(spans(texts, group)), __shared=written(spans(texts, group, PASSAGE, PASSAGE_GRAM)))
    return marked.select("doc_id", "__body", "__spans", "__shared").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, n_shared_spans long")


def cut_documents(documents: DataFrame, group: int = GROUP, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The documents without their repeated strings of ``span`` bytes; n_chars follows the text, other columns stay."""
    columns = documents.columns

    @F.pandas_udf("string")
    def rest(bodies, found):
        return pd.Series([_rest(bytes(b), merged(f)).decode("utf-8", "ignore") for b, f in zip(bodies, found)])

    cut = F.col("__spans").isNotNull()
    marked = _marked(documents, __spans=written(spans(_texts(documents), group, span, gram))).withColumn(
        "text", F.when(cut, rest("__body", "__spans")).otherwise(F.col("text")))
    if "n_chars" in columns:
        marked = marked.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return marked.select(*columns)
