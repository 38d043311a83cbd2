"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

A document's ids, an end id after them, are cut into pieces of at most ``CAPACITY`` tokens.
How pieces can be combined depends on their lengths only, so the instance is the histogram
of lengths: at most ``CAPACITY`` rows whatever the corpus. On it, sets that provably
dominate every other set with the same piece are fixed for all equal pieces at once:

* a piece that fits with no other one is alone;
* a piece and its exact complement fill a sequence;
* if no two others fit beside a piece, its largest partner is as good as any;
* if at most two others fit, and the largest single partner is no shorter than the best two
  together, that partner dominates them.

This repeats while it shrinks the instance; what remains is packed by best fit in
decreasing length. The plan names, for ranges of ranks among pieces of one length, the
sequence and the offset. Ranks come from a distributed numbering, so a length that holds a
third of all pieces is not sorted in one task.

Defined cases: a null or empty text is its end id; repeated rows are packed one by one; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import positions_within
from ..session import materialize
from .common import slices

CAPACITY = 2048
END = 0
CACHED_WORDS = 150_000
#: Texts that the tokenizer is given at once: its encodings hold far more than ids.
ENCODED = 2048
#: Runs that are one text for the tokenizer: most of the time for a short text goes into what surrounds its merges.
JOINED = 256

#: A document can be cut into pieces of these columns; ids are little-endian unsigned 32-bit.
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class WordEncoder:
    """Ids of whole texts, put together from the ids of their blank-separated words.

    The tokenizer drops white space, never joins across it, and splits words into runs of
    letters, single digits and runs of the rest; words and runs are encoded once and kept,
    in at most two generations of ``CACHED_WORDS`` each. Words of one run and those that its normaliser could treat
    otherwise than run by run (apostrophes, special tokens, letters that change with their
    neighbours) are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self._last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._words, self._runs = _Kept(), _Kept()

    def _encode(self, texts: list[str], kept: _Kept) -> None:
        for at in range(0, len(texts), ENCODED):
            some = texts[at:at + ENCODED]
            for text, found in zip(some, self._tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                kept.young[text] = array("I", found.ids).tobytes()

    def _encode_runs(self, runs: list[str], kept: _Kept) -> None:
        """Like ``_encode``; runs of letters or of other ASCII are strung together with blanks and parted at the ids that end a run.

        Each of these has at least one such id, so where there are as many as runs, each run has its own.
        """
        joined = [run for run in runs if run.isalpha() or run.isascii() and run.isprintable()]
        if len(joined) < len(runs):
            self._encode([run for run in runs if not (run.isalpha() or run.isascii() and run.isprintable())], kept)
        for at in range(0, len(joined), ENCODED):
            some = joined[at:at + ENCODED]
            texts = [" ".join(some[i:i + JOINED]) for i in range(0, len(some), JOINED)]
            found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, dtype=np.uint32) for x in found])
            ends = (4 * np.flatnonzero(self._last[ids]) + 4).tolist()
            if len(ends) != len(some):
                self._encode(some, kept)
                continue
            raw = ids.tobytes()
            kept.young.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def _learn(self, words: list[str]) -> None:
        letters, whole, split = [], [], {}
        for word in words:
            if word.isalpha():
                letters.append(word)
            elif "'" in word or "<|" in word:
                whole.append(word)
            elif word.isascii():
                split[word] = _ASCII_RUNS(word.lower())
            elif _ODD.isdisjoint(word) and unicodedata.is_normalized("NFC", word):
                split[word] = _RUNS(word.lower())
            else:
                whole.append(word)
        self._encode(whole, self._words)
        self._encode_runs(letters, self._words)
        self._encode_runs(self._runs.missing({run for runs in split.values() for run in runs}), self._runs)
        known = self._runs.young.__getitem__
        for word, runs in split.items():
            self._words.young[word] = b"".join(map(known, runs))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins in them."""
        lists = pc.ascii_split_whitespace(_parted(texts))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(self._words.missing(words))
        # Arrow puts the ids of all places together; their ends are counted in bytes
        placed = pa.array(list(map(self._words.young.__getitem__, words)), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(placed.buffers()[1], dtype=np.int64, count=len(placed) + 1) // 4 if len(placed) else np.zeros(1, np.int64)
        ids = np.frombuffer(placed.buffers()[2], dtype=np.uint32, count=int(ends[-1])) if ends[-1] else np.zeros(0, np.uint32)
        return ids, ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]


#: Letters whose small form depends on their neighbours or is two characters.
_ODD = frozenset("\u03a3\u0130")
_ASCII_RUNS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+").findall
_RUNS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall


def _parted(texts: pa.Array) -> pa.Array:
    """Texts that the tokenizer reads alike and that have fewer different words: small ASCII letters, and a blank
    after letters where a mark follows. Texts with what may be a special token stay as they are."""
    parted = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-zß-öø-ÿ])([!-/:-@\\[-`{-~])", r"\1 \2")
    return pc.if_else(pc.match_substring(texts, "<|"), texts, parted)


class _Kept:
    """Encodings in two generations: what was not used since the last change of generation goes."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def missing(self, texts: Iterable[str]) -> list[str]:
        """Those without an encoding; the others are in ``young`` then."""
        if len(self.young) > CACHED_WORDS:
            self.young, self._old = {}, self.young
        out = []
        for text in texts:
            if text not in self.young:
                ids = self._old.get(text)
                if ids is None:
                    out.append(text)
                else:
                    self.young[text] = ids
        return out


#: Encoder of this Python worker by path; a worker serves many tasks, and what it has learned stays.
_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Pieces of every document; ``tokenizer`` is the path of the tokenizer's file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = encoder_of(tokenizer), array("I", [END]).tobytes(), 4 * CAPACITY
        for batch in slices(batches, "body"):
            rows = []
            flat, starts = encoder.encode(batch.column("body"))
            for doc, first, last in zip(batch.column("doc_id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                ids = flat[first:last].tobytes() + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    return texts.mapInArrow(cut, PIECE)


def reduce_instance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fixes dominating sets; takes their pieces out of ``counts`` and returns (((length, times), ...), sequences)."""
    fixed = []

    def fix(parts: list[int], times: int) -> None:
        sizes = {s: parts.count(s) for s in parts}
        for s, k in sizes.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
        fixed.append((tuple(sizes.items()), times))

    changed = True
    while changed:
        changed = False
        for s in sorted(counts, reverse=True):
            while counts.get(s):
                partners = _dominating(counts, s, capacity)
                if partners is None:
                    break
                parts = [s, *partners]
                fix(parts, min(counts[x] // parts.count(x) for x in set(parts)))
                changed = True
    return fixed


def _dominating(counts: dict[int, int], s: int, capacity: int) -> list[int] | None:
    """Partners that dominate every other choice beside one piece of length ``s``; None if none surely do."""
    rest, room = dict(counts), capacity - s
    rest[s] -= 1
    sizes = sorted(x for x, n in rest.items() if n)
    fitting = sizes[: bisect.bisect_right(sizes, room)]
    if not fitting:
        return []
    largest = fitting[-1]
    if largest == room:
        return [largest]
    smallest = [x for x in fitting[:3] for _ in range(min(rest[x], 3))][:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return [largest]
    if len(smallest) < 3 or sum(smallest) > room:
        best, low, high = 0, 0, len(fitting) - 1
        while low <= high:
            total = fitting[low] + fitting[high]
            if total > room or (low == high and rest[fitting[low]] < 2):
                high -= 1
            else:
                best, low = max(best, total), low + 1
        if largest >= best:
            return [largest]
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit in decreasing length, for all pieces of a length and all sequences with equal room at once."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, times: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append([pattern, times])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect.bisect_left(rooms, s)
            room = rooms[at] if at < len(rooms) else capacity
            pattern, times = open_by_room[room][-1] if at < len(rooms) else ((), left)
            each = min(room // s, left)
            used = min(times, left // each)
            if at < len(rooms):
                open_by_room[room][-1][1] -= used
                if used == times:
                    open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            put(room - each * s, (*pattern, (s, each)), used)
            left -= each * used
    return [(tuple(pattern), times) for groups in open_by_room.values() for pattern, times in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset), sorted by length and rank."""
    left = dict(counts)
    patterns = reduce_instance(left, capacity) + best_fit(left, capacity)
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            rows.append((size, used.get(size, 0), each, sequence, offset))
            used[size] = used.get(size, 0) + each * times
            offset += size * each
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``items`` (written already; column ``length``) with sequence_id and offset. ``order`` ranks equal lengths."""
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = plan(counts, capacity)
    keys = (table[:, 0] << 48) + table[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            within = rank - row[:, 1]
            columns = {name: batch.column(name) for name in batch.schema.names if name != "__rank"}
            columns["sequence_id"] = pa.array(row[:, 3] + within // row[:, 2])
            columns["offset"] = pa.array(row[:, 4] + within % row[:, 2] * length)
            yield pa.RecordBatch.from_pydict(columns)

    ranked = positions_within(items, ["length"], order, "__rank")
    schema = items.select(ranked.drop("__rank").columns).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*schema.names[:-2], "__rank").mapInArrow(assign, schema)


def pack(documents: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and offset; with ``with_ids`` its ids too."""
    cut = pieces(documents, tokenizer, with_ids)
    return place(materialize(cut if with_ids else cut.drop("ids")), ["doc_id", "piece", "ids_crc32"])


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences of a packing with ids: sequence_id, ids; at most CAPACITY pieces meet in one."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x["ids"]), "")
    return packed.groupBy("sequence_id").agg(F.unhex(ids).alias("ids"))
