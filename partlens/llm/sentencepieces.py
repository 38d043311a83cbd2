"""SentencePiece encoding and decoding over a relational lattice.

A text is the sequence of its words: runs of the blank mark with what follows them, split between
Latin letters and ASCII marks where no piece of the table has both. No piece goes over the end of a word. The lattice of a word is made by exploding its substrings of at most the longest
piece and joining them by equality to the piece table (bounded: one row per piece); the edges are
grouped by word and folded with the higher-order ``aggregate``:

* a unigram table: Viterbi, edges in order of their ends, best sum of scores at every place;
* a BPE table: edges in order of score, then place; an edge whose span now consists of two symbols
  joins them. A piece is never formed after its score has passed, as its own parts score better,
  so one fold gives the result of the merges. (Viterbi over the scores of a BPE table would not.)
  Pieces of blanks only share the lowest score; what they make of a run of blanks is the longest
  piece from the left, again and again, so they come last, leftmost and longest first.

Characters without a piece become their bytes' pieces. Frequent words, at most ``DICTIONARY``,
are counted and encoded as rows, once, and their ids go to all tasks. A task that meets another word
folds its lattice in the same order where it is, marking ends in place, so texts are neither shuffled nor
taken apart into rows: what is written is counts and dictionary, whatever the texts' size. Dictionary words longer than ``FOLDED``
characters are joined from the same sorted edges in place, as arrays would be copied for every join.

Defined cases: null and empty texts have no ids; rows with equal texts are encoded alike; extra
columns are ignored.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, slices
from .tables import written

BLANK = "▁"
DICTIONARY = 300_000
FOLDED = 128
KEPT = 100_000


@dataclass(frozen=True)
class Table:
    """A piece table: pieces with scores, the id of byte 0, and whether words may be split at letters."""

    kind: str
    pieces: tuple[tuple[str, int, float], ...]
    first_byte: int
    split_letters: bool

    @staticmethod
    def load(path: str, kind: str = "bpe") -> Table:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in plain)
        if kind == "bpe":
            shared = Counter(s for _, _, s in pieces)
            if any(shared[s] > 1 and p.strip(BLANK) for p, _, s in pieces):
                raise ValueError("a BPE table in which other pieces than blanks share a score")
        letter, mark = re.compile(f"[{_LETTERS}]").match, re.compile(f"[{_MARKS}]").match
        mixed = any((letter(a) and mark(b)) or (mark(a) and letter(b)) for p, _, _ in pieces for a, b in zip(p, p[1:]))
        return Table(kind, pieces, model.piece_to_id("<0x00>"), not mixed)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def ends(self) -> str:
        """Where words end, as a regular expression that Python and Java read alike."""
        return _ENDS if self.split_letters else f"(?<=[^{BLANK}])(?={BLANK})"

    def words(self, text: str) -> list[str]:
        if text.isalpha():
            return [BLANK + text]  # neither blanks nor marks to end at
        return re.split(self.ends, BLANK + text.replace(" ", BLANK)) if text else []


_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_MARKS = "\u0001-\u001F!-@\\[-`{-~"
_ENDS = f"(?<=[{_LETTERS}])(?=[{_MARKS}])|(?<=[{_MARKS}])(?=[{_LETTERS}])|(?<=[^{BLANK}])(?={BLANK})"


def lattice(words: DataFrame, table: Table) -> DataFrame:
    """``words`` (word and columns that tell rows apart) with edges: every piece in it from s to e, best first.

    Nothing is shuffled if ``words`` is partitioned by some of its columns.
    """
    keys = words.columns
    spark = words.sparkSession
    pieces = spark.createDataFrame([(p, i, -s) for p, i, s in table.pieces], "piece string, id int, cost double")
    starts = words.select(*keys, F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    ends = F.sequence(F.col("s") + 1, F.least(F.col("s") + table.longest, F.length("word")))
    spans = starts.select(*keys, "s", F.explode(ends).alias("e"))
    spans = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s")))
    edges = spans.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR e = s + 1")
    size = F.col("e") - F.col("s")
    joins = F.when(F.ltrim(F.translate("piece", BLANK, " ")) == "", size).otherwise(F.least(size, F.lit(2)))
    edge = F.when(F.col("id").isNotNull(), F.struct("cost", "s", (-F.col("e")).alias("order"), "e", "id", joins.alias("joins")))
    return edges.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _merge_fold(word: Column, edges: Column) -> Column:
    """Ends of the symbols that BPE leaves: 0 and the ends of the segments."""
    def step(b: Column, x: Column) -> Column:
        return let(F.array_position(b, x["s"]).cast("int"), lambda i: F.when(
            (i > 0) & (F.get(b, i - 1 + x["joins"]) == x["e"]), F.concat(F.slice(b, F.lit(1), i), F.slice(b, i + x["joins"], F.size(b)))).otherwise(b))

    return F.aggregate(F.filter(edges, lambda x: x["e"] - x["s"] > 1), F.sequence(F.lit(0), F.length(word)), step)


def _viterbi_fold(word: Column, edges: Column, unknown: float) -> Column:
    """Places on the best path; a character without a piece costs ``unknown``."""
    kind = "array<struct<cost:double,back:int>>"
    known = F.transform(edges, lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["cost"].alias("cost")))
    singles = F.transform(F.sequence(F.lit(1), F.length(word)), lambda e: F.struct(e.alias("e"), (e - 1).alias("s"), F.lit(unknown).alias("cost")))
    ordered = F.sort_array(F.concat(known, singles))
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("back"))).cast(kind)

    def step(best: Column, x: Column) -> Column:
        cost = F.get(best, x["s"])["cost"] + x["cost"]
        new = F.array(F.struct(cost.alias("cost"), x["s"].alias("back"))).cast(kind)
        return F.when(F.size(best) == x["e"], F.concat(best, new)).when(
            cost < F.get(best, x["e"])["cost"], F.concat(F.slice(best, F.lit(1), x["e"]), new)).otherwise(best)

    path = let(F.aggregate(ordered, start, step), lambda best: F.aggregate(
        F.sequence(F.lit(1), F.size(best)), F.array(F.size(best) - 1),
        lambda p, _: F.when(F.element_at(p, -1) > 0, F.concat(p, F.array(F.get(best, F.element_at(p, -1))["back"]))).otherwise(p)))
    return F.reverse(path)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _in_place(sizes: pd.Series, edges: pd.Series) -> pd.Series:
    """The same merges for long words, which mark ends in place instead of copying them."""
    cuts = []
    for size, found in zip(sizes, edges):
        there = np.ones(size + 1, dtype=bool)
        for x in found:
            s, e = x["s"], x["e"]
            if e - s > 1 and there[s] and there[e] and there[s + 1:e].sum() == x["joins"] - 1:
                there[s + 1:e] = False
        cuts.append(np.flatnonzero(there).tolist())
    return pd.Series(cuts)


_EDGE = "array<struct<cost:double,s:int,order:int,e:int,id:int,joins:int>>"


def encode_words(words: DataFrame, table: Table, long: bool = False) -> DataFrame:
    """``words`` (different rows with a column word) with the ids of each: of those with up to FOLDED characters, or of the longer ones."""
    words = words.where(F.length("word") > FOLDED if long else F.length("word") <= FOLDED)
    edges = lattice(words, table).withColumn("edges", F.col("edges").cast(_EDGE))
    if table.kind == "unigram":
        cuts = _viterbi_fold(F.col("word"), F.col("edges"), max(-s for _, _, s in table.pieces) + 10.0)
    elif long:
        cuts = _in_place(F.length("word"), F.col("edges"))
    else:
        cuts = _merge_fold(F.col("word"), F.col("edges"))

    def ids_of(word: Column, found: Column, s: Column, e: Column) -> Column:
        own = F.filter(found, lambda x: (x["s"] == s) & (x["e"] == e))
        text = F.hex(F.encode(F.substring(word, s + 1, e - s), "utf-8"))
        spelt = F.transform(F.sequence(F.lit(1), F.length(text), F.lit(2)), lambda i: (F.conv(F.substring(text, i, F.lit(2)), 16, 10).cast("int") + table.first_byte))
        return F.when(F.size(own) > 0, F.array(F.get(own, F.lit(0))["id"])).otherwise(spelt)

    ids = let(F.col("cuts"), lambda c: F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(c) - 2), lambda i: ids_of(F.col("word"), F.col("edges"), F.get(c, i), F.get(c, i + 1)))))
    return edges.withColumn("cuts", cuts).select(*words.columns, ids.alias("ids"))


def _slices(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    return slices(batches, "body", limit)


def _blank_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different words between single blanks, the word at each place, where texts begin, and which texts must be read otherwise."""
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, BLANK)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return coded.dictionary, coded.indices.to_numpy(), begin, odd


def _count(table: Table):
    """Words a task meets at least twice, with how often: all that could be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _loaded.clear()  # the dictionary of a query before this one
        counts: Counter = Counter()
        plain: Counter = Counter()

        def flush() -> pa.RecordBatch:
            for word, n in plain.items():
                for part in table.words(word):
                    counts[part] += n
            often = {w: n for w, n in counts.items() if n > 1}
            counts.clear()
            plain.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(often), pa.string()), "n": pa.array(list(often.values()), pa.int64())})

        for batch in _slices(batches):
            words, places, begin, odd = _blank_words(batch.column("body"))
            for word, n in zip(words.to_pylist(), np.bincount(places[~np.repeat(odd, np.diff(begin))], minlength=len(words)).tolist()):
                if n:
                    plain[word] += n
            for row in np.flatnonzero(odd).tolist():
                counts.update(table.words(batch.column("body")[row].as_py()))
            if len(counts) + len(plain) > 300_000:
                yield flush()
        yield flush()

    return run


def _frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The words counted at least as often as needed to have no more than ``limit`` of them."""
    total, least = 0, None
    for r in counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        if total + r["words"] > limit:
            break
        total, least = total + r["words"], r["n"]
    return counts.where(F.lit(False) if least is None else F.col("n") >= least)


def local_fold(table: Table) -> Callable[[str], bytes]:
    """A function that folds the lattice of one word: its packed ids, the same as those of ``encode_words``."""
    order = {cost: i for i, cost in enumerate(sorted({-s for _, _, s in table.pieces}))}
    pieces = {p: (i, -s) for p, i, s in table.pieces}
    # places in the order of all pieces longer than a character; -1 for what only begins a piece
    begun = {p[:k]: -1 for p in pieces for k in range(1, len(p) + 1)}
    begun |= {p: order[-s] for p, _, s in table.pieces if len(p) > 1}
    unknown = max(-s for _, _, s in table.pieces) + 10.0
    longest = table.longest
    bits = longest.bit_length()
    mask = (1 << bits) - 1
    first, none, runs = table.first_byte, len(order), BLANK * 2

    def merged(word: str) -> list[int]:
        n, found = len(word), array("q")
        for s in range(n - 1):
            for e in range(s + 1, min(s + longest, n) + 1):
                x = begun.get(word[s:e])
                if x is None:
                    break
                if x >= 0:
                    found.append((((x << 32) + s) << bits) + mask - (e - s))
        if n > FOLDED:
            np.frombuffer(found, dtype=np.int64).sort()
        there = bytearray(b"\1") * (n + 1)
        for x in found if n > FOLDED else sorted(found):
            s = (x >> bits) & 0xFFFFFFFF
            size = mask - (x & mask)
            e = s + size
            if there[s] and there[e]:
                if size == 2:
                    there[s + 1] = 0
                elif there.count(1, s + 1, e) == (1 if word[s:e].strip(BLANK) else size - 1):
                    there[s + 1:e] = bytes(size - 1)
        return [i for i, end in enumerate(there) if end]

    def symbols(word: str) -> list[str]:
        """What the same fold leaves of a short word without a run of blanks, where only neighbours are joined."""
        parts = list(word)
        places = [begun.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        places = [x if x >= 0 else none for x in places]
        while places:
            x = min(places)
            if x == none:
                break
            i = places.index(x)
            joined = parts[i] + parts.pop(i + 1)
            parts[i] = joined
            del places[i]
            if i:
                x = begun.get(parts[i - 1] + joined, -1)
                places[i - 1] = x if x >= 0 else none
            if i < len(places):
                x = begun.get(joined + parts[i + 1], -1)
                places[i] = x if x >= 0 else none
        return parts

    def best(word: str) -> list[int]:
        cost, back = [0.0, *[float("inf")] * len(word)], [0] * (len(word) + 1)
        out: list[list[tuple[int, float]]] = [[(s, unknown)] for s in range(len(word))]
        for s in range(len(word)):
            for e in range(s + 1, min(s + longest, len(word)) + 1):
                if word[s:e] in pieces:
                    out[e - 1].append((s, pieces[word[s:e]][1]))
        for e, found in enumerate(out, 1):
            for s, c in sorted(found):
                if cost[s] + c < cost[e]:
                    cost[e], back[e] = cost[s] + c, s
        path = [len(word)]
        while path[-1]:
            path.append(back[path[-1]])
        return path[::-1]

    def ids(word: str) -> bytes:
        if table.kind == "bpe" and len(word) <= FOLDED and runs not in word:
            parts = symbols(word)
        else:
            cuts = (best if table.kind == "unigram" else merged)(word)
            parts = [word[s:e] for s, e in zip(cuts, cuts[1:])]
        numbers = array("H")
        for part in parts:
            piece = pieces.get(part)
            if piece:
                numbers.append(piece[0])
            else:
                numbers.extend([first + b for b in part.encode()])
        return (numbers if sys.byteorder == "little" else numbers.byteswap() or numbers).tobytes()

    return ids


class Encoder:
    """Packed ids of texts: dictionary words are looked up in Arrow, others folded as they are met; at most ``KEPT`` of them stay."""

    def __init__(self, known: pa.Table, table: Table):
        known = known.combine_chunks()
        self._known, self._packed = (known.column(c).cast(t) for c, t in (("word", pa.string()), ("packed", pa.binary())))
        self._fold, self._met, self._words = local_fold(table), {}, table.words

    def _look_up(self, words: pa.Array) -> list[bytes | None]:
        return self._packed.take(pc.index_in(words, value_set=self._known)).to_pylist() if len(self._known) else [None] * len(words)

    def of_words(self, words: pa.Array) -> list[bytes]:
        """Of texts without a blank; one that is in the dictionary as a whole is not split."""
        found = self._look_up(pc.binary_join_element_wise("", words, BLANK))
        others = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(others, self.of_texts(words.take(pa.array(others, pa.int64())).to_pylist())):
            found[i] = ids
        return found

    def of_texts(self, texts: list[str]) -> list[bytes]:
        parts = [self._words(text) for text in texts]
        words = list({w for text in parts for w in text})
        found = dict(zip(words, self._look_up(pa.array(words, pa.string()))))
        for word in words:
            if found[word] is None:
                found[word] = self._rare(word)
        return [b"".join(map(found.__getitem__, text)) for text in parts]

    def _rare(self, word: str) -> bytes:
        ids = self._met.get(word)
        if ids is None:
            ids = self._fold(word)
            if len(word) <= FOLDED:
                if len(self._met) >= KEPT:
                    self._met.clear()
                self._met[word] = ids
        return ids


#: Encoders of this Python worker by their id; the last one stays.
_loaded: dict[str, Encoder] = {}


def _encoder(key: str, packed, table: Table) -> Encoder:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(packed.value, table)
    return _loaded[key]


def _packed(ids: Column) -> Column:
    """Little-endian 16-bit ids as one binary."""
    digits = F.transform(ids, lambda i: let(F.lpad(F.hex(i.cast("long")), 4, "0"), lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))))
    return F.unhex(F.array_join(digits, ""))


_Batches = Iterator[pa.RecordBatch]
_ENCODED = "doc_id long, text string, ids binary"


def encode(documents: DataFrame, table: Table, last: Callable[[_Batches], _Batches] | None = None, schema: str = _ENCODED) -> DataFrame:
    """doc_id, text (null is empty) and ids, binary of little-endian 16-bit numbers, of every document.

    ``last`` makes rows of ``schema`` of these in the same worker: a map of its own would be a second worker a task.
    """
    body = F.coalesce("text", F.lit(""))
    counts = written(documents.select(body.alias("body")).mapInArrow(_count(table), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    frequent = _frequent(counts, DICTIONARY).select("word").repartition("word")
    both = encode_words(frequent, table).union(encode_words(frequent, table, True))
    known_words = written(both.select("word", _packed(F.col("ids")).alias("packed")))
    shared, key = documents.sparkSession.sparkContext.broadcast(known_words.toArrow()), uuid.uuid4().hex

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared, table)
        for batch in _slices(batches):
            words, places, begin, odd = _blank_words(batch.column("body"))
            plain = ~np.repeat(odd, np.diff(begin))
            used = np.flatnonzero(np.bincount(places[plain], minlength=len(words)))
            found = [b""] * len(words)
            for i, ids in zip(used.tolist(), encoder.of_words(words.take(pa.array(used)))):
                found[i] = ids
            rest = dict(zip(np.flatnonzero(odd).tolist(), encoder.of_texts(batch.column("body").filter(pa.array(odd)).to_pylist())))
            size = np.fromiter((len(x) // 2 for x in found), dtype=np.int64, count=len(found))
            flat, length = np.frombuffer(b"".join(found), dtype="<u2"), size[places]
            ends = np.cumsum(length)
            flat = flat[np.repeat((np.cumsum(size) - size)[places] - (ends - length), length) + np.arange(length.sum())]
            ends = np.concatenate([[0], ends])[begin].tolist()
            out = [rest[i] if o else flat[ends[i]:ends[i + 1]].tobytes() for i, o in enumerate(odd.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": batch.column("body"), "ids": pa.array(out, pa.binary())})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    return texts.mapInArrow(joined if last is None else lambda batches: last(joined(batches)), schema)


def decoded(table: Table) -> Callable[[list[bytes]], list[str]]:
    """A function that gives the texts of packed ids back, put together by Arrow: the first blank is the encoder's own."""
    pieces = {i: p.replace(BLANK, " ").encode() for p, i, _ in table.pieces}
    pieces |= {table.first_byte + b: bytes([b]) for b in range(256)}
    by_id = pa.array([pieces.get(i) for i in range(max(pieces) + 1)], pa.large_binary())

    def texts(packed: list[bytes]) -> list[str]:
        placed = by_id.take(pa.array(np.frombuffer(b"".join(packed), dtype="<u2")))
        if placed.null_count:
            raise KeyError("an id without a piece")
        if not len(placed):
            return [""] * len(packed)
        at = np.cumsum([0, *(len(x) // 2 for x in packed)])
        ends = np.frombuffer(placed.buffers()[1], dtype=np.int64, count=len(placed) + 1)[at].tolist()
        whole = placed.buffers()[2].to_pybytes()
        return [whole[s:e].decode("utf-8", "replace")[1:] for s, e in zip(ends, ends[1:])]

    return texts


def decode(encoded: DataFrame, table: Table) -> DataFrame:
    """``encoded`` with the column decoded."""
    @F.pandas_udf("string")
    def run(ids):
        return pd.Series(decoded(table)([bytes(x) for x in ids]), dtype=object)

    return encoded.withColumn("decoded", run("ids"))


def digest(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, CRC-32 of the ids (unsigned 16-bit, little-endian), and whether decoding gives the text back."""
    table = Table.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoded(table)
        for batch in batches:
            rows = []
            docs, texts, packed = (batch.column(k).to_pylist() for k in ("doc_id", "text", "ids"))
            for doc, text, ids, given in zip(docs, texts, packed, back(packed)):
                numbers = np.frombuffer(ids, dtype="<u2")
                spelt = int(((numbers >= table.first_byte) & (numbers < table.first_byte + 256)).sum())
                rows.append((doc, len(numbers), spelt, zlib.crc32(ids), given == (text or "").replace(BLANK, " ")))
            kinds = (*[pa.int64()] * 4, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(documents, table, run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")
