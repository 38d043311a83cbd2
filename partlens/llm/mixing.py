"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Tokens are lower-cased words and an end per text. Training texts give the counts of all tokens
and, for the ``DICTIONARY`` most frequent ones, ranks. A token is coded in bits: the number of
binary digits of its rank (a walk of five bits, escape included), then all digits after the
first; every bit is modelled, so words of near ranks are told apart by their contexts. Tokens outside the
dictionary follow an escape letter by letter, each with its probability after the three before.

Each modelled bit is predicted in three contexts: its place in the code alone, with the token
before, and with the two tokens before. Contexts are hashed into tables of ``SLOTS`` counts of zeros
and ones, gathered over all training texts; a context that was seen little leans on the shorter
one. The predictions' logits are mixed by weights that are chosen by a gate (the place in the code and
how much the longest context has been seen) and learned online, bit by bit, as a text is read; the mix
is refined by an adaptive map of probabilities for each place in the code (learned in the same way) and
gives the bits. Weights and map are first fitted to the training texts, where a bit is predicted without
its own count: in every partition by Newton's steps over all its bits, then averaged by use over all partitions. Every
text starts from these and learns on from its first to its last token, so a score depends on its text and
the training texts only, whatever else is scored. The average depends on how the training texts lie in partitions.

Tables and dictionary have fixed sizes. The base score needs counts of all tokens: those outside
the dictionary are rows joined to the counts. Tokens and contexts are told apart by 64-bit hashes.

Defined cases: a null or empty text is its end; a null doc_id counts as the empty string and is
held out; repeated rows are trained on and scored one by one; without training texts
all tables are empty and scores are those of uniform tables; a text of any length is scored to its end; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytework import LOWER, buffer_of, mix, prefix_hashes, stretch_hashes, word_spans
from .common import slices
from .tables import written

DICTIONARY = 1 << 19
SLOTS = 1 << 20
WINDOW = 1 << 13
#: Tokens whose bits are laid out at once where their order is that of the texts.
CHUNK = 1 << 13
#: Chunks that the mix is fitted to at once.
FITTED = 8
READ_BYTES = 4 << 20
RATE = 0.01
MAP_RATE = 0.02

_ORDERS = 3
_END = np.uint64(0x0E4D0F7E87)
_LEVELS = 5  # bits that say how many digits a rank has
_ESCAPE = 31
_DEPTH = _LEVELS + DICTIONARY.bit_length() - 1  # modelled bits of a token at most
_GATES = _DEPTH * 4
_BINS = 24
_PARTS = 64
_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)
_LETTERS = 257  # a byte or the end of a word
_CONTEXTS = 16384  # hashed contexts of three letters
_PRIOR = 2.0  # a context seen n times has n / (n + _PRIOR) of the say over the shorter one
_INITIAL = (0.3, 0.4, 0.3)
_CLASS = np.uint32(15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and hashes of all tokens in order, ends included; lower-cased bytes, starts and ends of words (an end's are 0)."""
    data, offsets = buffer_of(column)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    hashes = stretch_hashes(prefix_hashes(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = len(column)
    counts = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    last = np.cumsum(counts + 1) - 1
    word = np.ones(len(rows) + n, dtype=bool)
    word[last] = False
    out = [np.empty(len(word), dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64)]
    for target, values, end in zip(out, (rows, hashes, starts, ends), (np.arange(n), np.full(n, _END), 0, 0)):
        target[word] = values
        target[last] = end
    return out[0], out[1], data, out[2], out[3]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    times: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate(held), return_inverse=True)
        return values, np.bincount(at, weights=np.concatenate(times)).astype(np.int64)

    for batch in slices(batches, "body"):
        values, n = np.unique(_tokens(batch.column("body"))[1], return_counts=True)
        held.append(values)
        times.append(n)
        if sum(map(len, held)) > 2_000_000:
            values, n = merged()
            held, times = [values], [n]
            if len(values) > 1_000_000:
                yield _counted(values, n)
                held, times = [], []
    if held:
        yield _counted(*merged())


def _counted(values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"token": pa.array(values.view(np.int64)), "c": pa.array(n.astype(np.int64))})


def token_counts(training: DataFrame) -> DataFrame:
    """token (hash) and its count c over all training texts."""
    return training.select("body").mapInArrow(_count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Dictionary:
    """The most frequent tokens: hashes in order, with counts and ranks."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.ranks = np.empty(len(tokens), dtype=np.int64)
        self.ranks[np.lexsort((self.tokens, -self.counts))] = np.arange(len(tokens))

    @staticmethod
    def of(counts: DataFrame, limit: int) -> Dictionary:
        """All tokens with at least the count that no more than ``limit`` tokens have."""
        total, least = 0, None
        for r in counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
            if total + r["n"] > limit:
                break
            total, least = total + r["n"], r["c"]
        found = counts.where(F.lit(False) if least is None else F.col("c") >= least).toArrow()
        return Dictionary(found.column("token").to_numpy().astype(np.int64).view(np.uint64), found.column("c").to_numpy().astype(np.int64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of every hash, -1 for those outside."""
        if not len(self.tokens):
            return np.full(len(hashes), -1)
        values, back = np.unique(hashes, return_inverse=True)
        return self.among(values)[back]

    def among(self, values: np.ndarray) -> np.ndarray:
        """Like ``find``, for different hashes in order."""
        if not len(self.tokens):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.tokens, values), len(self.tokens) - 1)
        return np.where(self.tokens[at] == values, at, -1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ranks by index, -1 for those outside."""
        return np.where(at < 0, -1, self.ranks[at]) if len(self.ranks) else at


def _digits(ranks: np.ndarray) -> np.ndarray:
    """Binary digits of ranks after the first (rank -1: outside)."""
    return np.where(ranks < 0, _ESCAPE, np.frexp((ranks + 1).astype(np.float64))[1] - 1)


def _bits_of(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of tokens (rank -1: outside), one after the other: nodes and bits; how many each token has; its free digits, of which there are none."""
    digits = _digits(ranks)
    rest = np.where(ranks < 0, 0, digits)
    # the walk: digits of the count of digits, then the digits of the rank after the first, as one number with a leading 1
    size = _LEVELS + rest
    walk = ((((1 << _LEVELS) + digits) << rest) + (np.where(ranks < 0, 0, ranks + 1) & ((1 << rest) - 1))).astype(np.int32)
    left = np.repeat(np.cumsum(size).astype(np.int32), size)
    left -= np.arange(1, len(left) + 1, dtype=np.int32)
    steps = np.repeat(walk, size)
    steps >>= left
    bits = (steps & 1).astype(np.int8)
    steps >>= 1
    return steps, bits, size, np.zeros_like(size)


def _levels(size: np.ndarray) -> np.ndarray:
    """The place of every bit in the code of its token."""
    ends = np.cumsum(size)
    return np.arange(size.sum()) - np.repeat(ends - size, size)


#: What _dense adds to a node, by the digits of the rank before it and the count of digits; nothing before those.
_MOVES = np.zeros((_DEPTH + 1, 1 << _LEVELS), dtype=np.int32)
for _k in range(_DEPTH - _LEVELS):
    _MOVES[_k] = [(1 << _LEVELS) + (1 << d) + (1 << _k) - (((1 << _LEVELS) + d) << _k) if d < _DEPTH - _LEVELS + 1 else 0 for d in range(1 << _LEVELS)]


def _dense(nodes: np.ndarray) -> np.ndarray:
    """Nodes as different numbers of no more than twice the greatest rank, so that each has a slot of its own."""
    known = (nodes.astype(np.float32).view(np.int32) >> 23) - (127 + _LEVELS)  # digits of the rank before this one
    k = np.maximum(known, 0)
    digits = (nodes >> k) & (2 ** _LEVELS - 1)
    return nodes + np.where(known < 0, 0, _MOVES.ravel().take((k << _LEVELS) + digits))


def _contexts(rows: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of nothing, of the token before, and of the two before, within the row."""
    before = np.zeros_like(hashes)
    before[1:] = np.where(rows[1:] == rows[:-1], hashes[:-1], np.uint64(0))
    two = np.zeros_like(hashes)
    two[1:] = np.where(rows[1:] == rows[:-1], before[:-1], np.uint64(0))
    one = mix(before + np.uint64(1))
    return [np.zeros_like(hashes), one, mix(one + mix(two + np.uint64(2)))]


_SPREAD, _GOLDEN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _slots(order: int, context: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Slots of modelled bits; without a context every node has its own."""
    return _hashed(context, nodes.astype(np.uint64) * _SPREAD) if order else _dense(nodes)


def _hashed(context: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Slots of the nodes that ``spread`` was made of, in a context."""
    slot = context ^ spread
    slot *= _GOLDEN
    slot >>= _SHIFT
    return slot.view(np.int64)


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the words given, letter by letter with the end: the word, and the cell of the letter after the three before it."""
    size = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(starts, size) + place
    end = np.int64(_LETTERS - 1)
    before = [np.where(place < k, end, data[np.maximum(at - k, 0)]) for k in (1, 2, 3)]
    letter = np.where(place == np.repeat(size, size) - 1, end, data[np.minimum(at, len(data) - 1)])
    context = mix(((before[2] * _LETTERS + before[1]) * _LETTERS + before[0]).astype(np.uint64)) % np.uint64(_CONTEXTS)
    return word, context.astype(np.int64) * _LETTERS + letter


def _train(dictionary):
    """Counts of bits per slot of the orders with a context, as parts of one long vector, of letters in the different words of every
    slice, and of tokens outside the dictionary. Counts without a context follow from those of the dictionary's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _shared(dictionary)
        totals = np.zeros((_ORDERS - 1, 2 * SLOTS), dtype=np.int64)
        spelt = np.zeros(_CONTEXTS * _LETTERS, dtype=np.int64)
        outside = 0
        for batch in slices(batches, "body"):
            rows, hashes, data, starts, ends = _tokens(batch.column("body"))
            values, kinds, back = np.unique(hashes, return_index=True, return_inverse=True)
            ranks = found.rank(found.among(values))[back]
            outside += int((ranks < 0).sum())
            contexts = _contexts(rows, hashes)[1:]
            cells: list[list[np.ndarray]] = [[] for _ in contexts]
            for a in range(0, len(ranks), CHUNK):
                nodes, bits, size, _ = _bits_of(ranks[a:a + CHUNK])
                spread = nodes.astype(np.uint64) * _SPREAD
                for held, context in zip(cells, contexts):
                    cell = _hashed(np.repeat(context[a:a + CHUNK], size), spread)
                    cell <<= 1
                    cell += bits
                    held.append(cell)
            for total, held in zip(totals, cells):
                total += np.bincount(np.concatenate(held), minlength=2 * SLOTS)
                held.clear()
            kinds = kinds[ends[kinds] > starts[kinds]]
            if len(kinds):
                np.add.at(spelt, _letters(data, starts[kinds], ends[kinds])[1], 1)
        parts = [*np.split(totals.ravel(), _PARTS), spelt, np.array([outside])]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            values = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            totals[part] = totals[part] + values if part in totals else values
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(totals), pa.int32()), "counts": pa.array([zlib.compress(_small(part, x), 1) for part, x in totals.items()], pa.binary())})


def _small(part: int, counts: np.ndarray) -> bytes:
    """What the model needs of a part: counts of slots, the letters' log probabilities, or the count of tokens outside the dictionary, as bytes."""
    if part > _PARTS:
        return counts.tobytes()
    if part == _PARTS:
        table = counts.reshape(_CONTEXTS, _LETTERS) + 0.02
        return np.log2(table / table.sum(axis=1, keepdims=True)).astype(np.float32).tobytes()
    return counts.astype(np.float32).tobytes()


def _packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logits of slots with these counts; the last four bits are the seen-class, so that one look-up finds both."""
    logit = np.log((ones + np.float32(0.2)) / (zeros + np.float32(0.2))).clip(-11, 11).astype(np.float32)
    return (logit.view(np.uint32) & ~_CLASS) | np.minimum(np.frexp(zeros + ones)[1], 12).astype(np.uint32)


class Model:
    """What scoring needs: dictionary, logits with seen-classes by order and slot, log probabilities of letters. Learning
    takes the logits without one zero or without one one, side by side for every slot."""

    def __init__(self, dictionary: Dictionary, parts: dict[int, bytes]):
        self.dictionary = dictionary
        blank = bytes(4 * (2 * (_ORDERS - 1) * SLOTS // _PARTS))
        seen = np.concatenate([np.frombuffer(parts.get(p, blank), np.float32) for p in range(_PARTS)])
        outside = int(np.frombuffer(parts[_PARTS + 1], np.int64)[0]) if _PARTS + 1 in parts else 0
        self.plain = np.empty((_ORDERS, SLOTS), dtype=np.uint32)
        self.taught = np.empty((_ORDERS, 2 * SLOTS), dtype=np.uint32)
        for order, counts in enumerate([_bare(dictionary, outside), *seen.reshape(_ORDERS - 1, -1)]):
            zeros, ones = counts[::2], counts[1::2]
            self.plain[order] = _packed(zeros, ones)
            self.taught[order, ::2] = _packed(np.maximum(zeros - 1, 0), ones)
            self.taught[order, 1::2] = _packed(zeros, np.maximum(ones - 1, 0))
        letters = np.frombuffer(parts[_PARTS], np.float32) if _PARTS in parts else np.full(_CONTEXTS * _LETTERS, -np.log2(_LETTERS), np.float32)
        self.letters = letters


def _bare(dictionary: Dictionary, outside: int) -> np.ndarray:
    """Counts of bits without a context: every token of the dictionary adds its bits as often as it occurs, ``outside`` others the escape's."""
    totals = np.zeros(2 * SLOTS)
    ranks, counts = np.append(dictionary.ranks, -1), np.append(dictionary.counts, outside)
    for a in range(0, len(ranks), 1 << 16):
        nodes, bits, size, _ = _bits_of(ranks[a:a + (1 << 16)])
        totals += np.bincount((_dense(nodes).astype(np.int64) << 1) + bits, weights=np.repeat(counts[a:a + (1 << 16)], size), minlength=2 * SLOTS)
    return totals.astype(np.float32)


#: Say of a context by its seen-class, the number of binary digits of how often it was seen.
_SAY = np.array([0.0, *((x := 0.75 * 2.0 ** c) / (x + _PRIOR) for c in range(1, 13))], dtype=np.float32)

#: Shared objects of this Python worker by broadcast; those of one query stay.
_held: dict[str, object] = {}


class _Share:
    def __init__(self, spark, value):
        self.key, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)


def _shared(share: _Share):
    if share.key not in _held:
        if len(_held) > 1:
            _held.clear()
        _held[share.key] = share.sent.value
    return _held[share.key]


class State:
    """Weights of the mix by gate and refined probabilities by level and bin."""

    def __init__(self, weights: np.ndarray, refined: np.ndarray):
        self.weights, self.refined = weights, refined

    @staticmethod
    def initial() -> State:
        weights = np.repeat(np.array(_INITIAL, dtype=np.float32)[:, None], _GATES, axis=1)
        return State(weights, np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, _BINS))), _DEPTH).astype(np.float32))

    @staticmethod
    def of(cells: dict[int, float]) -> State:
        """The initial state with the values of ``cells`` instead, counted as in ``flat``."""
        flat = State.initial().flat()
        flat[list(cells)] = list(cells.values())
        return State(flat[:_ORDERS * _GATES].reshape(_ORDERS, _GATES).copy(), flat[_ORDERS * _GATES:].copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.refined])


def bits(model: Model, start: State, n: int, tokens: tuple[np.ndarray, ...], at: np.ndarray) -> np.ndarray:
    """Bits of ``n`` texts, from their tokens and the tokens' indices in the dictionary."""
    rows, _, data, starts, ends = tokens
    total, *_ = _mixed(model, start, n, tokens, at)
    outside = (at < 0) & (ends > starts)
    if outside.any():
        word, cell = _letters(data, starts[outside], ends[outside])
        total -= np.bincount(rows[outside][word], weights=model.letters[cell], minlength=n)
    return total


def _inputs(model: Model, contexts: list[np.ndarray], nodes: np.ndarray, bit: np.ndarray, size: np.ndarray, learning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logits of modelled bits by order, and the seen-class of their longest context; for learning without the bits' own counts."""
    inputs = np.empty((_ORDERS, len(nodes)), dtype=np.float32)
    spread = nodes.astype(np.uint64) * _SPREAD
    for order, context in enumerate(contexts):
        slot = _hashed(np.repeat(context, size), spread) if order else _dense(nodes)
        if learning:
            slot <<= 1
            slot += bit
        found = (model.taught if learning else model.plain)[order][slot]
        if not order:
            inputs[0] = found.view(np.float32)
            continue
        np.subtract(found.view(np.float32), inputs[order - 1], out=inputs[order])
        found &= _CLASS
        inputs[order] *= _SAY[found]
        inputs[order] += inputs[order - 1]
    return inputs, found


def _mixed(model: Model, start: State, n: int, tokens: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[np.ndarray]:
    """Modelled bits of every text.

    Texts are read side by side, each from its first to its last token: step t takes the t-th token
    of all texts that have one. The bits of a token lie on different levels and so share no weights
    and no refined probabilities: all at once they learn the same as one by one. Bits are laid out for
    about ``WINDOW`` tokens at a time; what the texts have learned goes on from window to window.
    """
    rows, hashes = tokens[:2]
    ranks, contexts = model.dictionary.rank(at), _contexts(rows, hashes)
    counts = np.bincount(rows, minlength=n)
    lane = np.empty(n, dtype=np.int64)
    lane[np.argsort(-counts, kind="stable")] = np.arange(n)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    lanes = lane[rows]
    reading = np.argsort(place * n + lanes)
    first = np.concatenate([[0], np.cumsum(np.bincount(place))])
    # the weights of a gate lie in one cell of 16 bytes, which is taken and put back as a whole
    # with the other sign, as the chance of a one needs it
    weights = np.zeros((n, _GATES, 4), dtype=np.float32)
    weights[:, :, :_ORDERS] = -start.weights.T
    weights, refined = weights.view(np.complex128).ravel(), np.tile(start.refined, n)
    total = np.zeros(n)
    scale, one, half, top = np.float32((_BINS - 1) / 16), np.float32(1), np.float32(0.5), np.float32(8)
    middle, keep = top * scale + half, one - np.float32(MAP_RATE)
    rate, map_rate = np.float32(RATE), np.float32(MAP_RATE)
    step = 0
    while step < len(first) - 1:
        last = max(step + 1, int(np.searchsorted(first, first[step] + WINDOW, side="right")) - 1)
        chosen = reading[first[step]:first[last]]
        nodes, bit, size, _ = _bits_of(ranks[chosen])
        x, seen = _inputs(model, [c[chosen] for c in contexts], nodes, bit, size, False)
        ends = np.concatenate([[0], np.cumsum(size)])
        # gates and bins are numbered by text, place in the code and then seen-class or bin; there are 4 gates and _BINS bins a place
        cells = np.repeat(lanes[chosen] * _GATES - 4 * ends[:-1], size)
        cells += np.arange(0, 4 * len(bit), 4)
        spots = cells * (_BINS // 4)
        cells += _SEEN_GATE.take(seen)
        y = bit.astype(np.float32)
        moves, pulls = x * rate, y * map_rate
        chances, maps = np.empty(len(bit), dtype=np.float32), np.empty(len(bit), dtype=np.float32)
        begin = ends[first[step:last + 1] - first[step]].tolist()
        for b, e in zip(begin, begin[1:]):
            cell, chance, r, spot = cells[b:e], chances[b:e], maps[b:e], spots[b:e]
            taken = weights.take(cell)
            w = taken.view(np.float32).reshape(-1, 4).T[:_ORDERS]
            parts = w * x[:, b:e]
            logit = parts[0]  # of a zero
            logit += parts[1]
            logit += parts[2]
            np.minimum(logit, top, out=logit)
            np.maximum(logit, -top, out=logit)
            np.exp(logit, out=chance)
            chance += one
            np.divide(one, chance, out=chance)
            w -= (y[b:e] - chance) * moves[:, b:e]
            weights[cell] = taken
            logit *= -scale
            logit += middle
            spot += logit.astype(np.int64)
            refined.take(spot, out=r, mode="clip")
            pulled = r * keep
            pulled += pulls[b:e]
            refined[spot] = pulled
        q = (chances + maps) * half
        total -= np.bincount(lanes[chosen], weights=np.add.reduceat(np.log2(np.where(y > 0, q, one - q)), ends[:-1]), minlength=n)
        step = last
    return (total[lane],)


#: Gate by seen-class of the longest context.
_SEEN_GATE = np.minimum((np.arange(13) + 1) // 2, 3)


def _learn(model_share):
    """State after the training texts of a partition: its values by cell and how many bits each was learned from.

    The weights of every gate are fitted by Newton's steps of the logistic loss, one for about ``FITTED * CHUNK`` tokens,
    with the curvature of all bits read so far, so that they near the best weights for all these bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state = _shared(model_share), State.initial()
        fit = _Fit(state)
        for batch in slices(batches, "body", READ_BYTES):
            rows, hashes = _tokens(batch.column("body"))[:2]
            ranks, contexts = model.dictionary.rank(model.dictionary.find(hashes)), _contexts(rows, hashes)
            for a in range(0, len(ranks), CHUNK):
                nodes, bit, size, _ = _bits_of(ranks[a:a + CHUNK])
                x, seen = _inputs(model, [c[a:a + CHUNK] for c in contexts], nodes, bit, size, True)
                fit.read(x, seen, _levels(size), bit)
        state, uses = fit.state()
        found = np.flatnonzero(uses)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(found.astype(np.int32)), "value": pa.array(state.flat()[found].astype(np.float64)), "n": pa.array(uses[found])})

    return run


class _Fit:
    """Weights by gate and refined probabilities fitted to bits, chunk by chunk."""

    def __init__(self, state: State):
        self._weights, self._start = state.weights.astype(np.float32), state.refined
        self._curve = np.tile(np.eye(_ORDERS), (_GATES, 1, 1))
        self._slope = np.zeros((_GATES, _ORDERS))
        self._uses = np.zeros(_GATES, dtype=np.int64)
        self._met, self._ones = np.zeros(_DEPTH * _BINS, dtype=np.int64), np.zeros(_DEPTH * _BINS)
        self._unread = 0

    def read(self, x: np.ndarray, seen: np.ndarray, level: np.ndarray, bit: np.ndarray) -> None:
        gate = level * 4 + _SEEN_GATE[seen]
        logit = (self._weights.take(gate, axis=1) * x).sum(axis=0).clip(-8, 8)
        chance = 1 / (1 + np.exp(-logit))
        error, sway = bit - chance, chance * (1 - chance)
        for o in range(_ORDERS):
            self._slope[:, o] += np.bincount(gate, error * x[o], _GATES)
            swayed = sway * x[o]
            for k in range(o + 1):
                self._curve[:, o, k] += (more := np.bincount(gate, swayed * x[k], _GATES))
                if k < o:
                    self._curve[:, k, o] += more
        self._uses += np.bincount(gate, minlength=_GATES)
        spot = level * _BINS + ((logit + 8) * ((_BINS - 1) / 16) + 0.5).astype(np.int64)
        self._met += np.bincount(spot, minlength=len(self._met))
        self._ones += np.bincount(spot, bit, len(self._ones))
        self._unread += 1
        if self._unread == FITTED:
            self._step()

    def _step(self) -> None:
        step = np.linalg.solve(self._curve, self._slope[:, :, None])[:, :, 0]
        self._weights = (self._weights + step.clip(-0.5, 0.5).T).astype(np.float32)
        self._slope[:] = 0
        self._unread = 0

    def state(self) -> tuple[State, np.ndarray]:
        """The state, and how many bits each of its values was learned from; bins lean on where they began like on 1 / MAP_RATE bits."""
        if self._unread:
            self._step()
        refined = ((self._start / MAP_RATE + self._ones) / (1 / MAP_RATE + self._met)).astype(np.float32)
        return State(self._weights, refined), np.concatenate([np.tile(self._uses, _ORDERS), self._met])


def learned(training: DataFrame, model_share) -> State:
    """The state that every text starts from: those of all partitions of the training texts, averaged by use."""
    parts = training.select("body").mapInArrow(_learn(model_share), "cell int, value double, n long")
    means = parts.groupBy("cell").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
    return State.of({r["cell"]: r["value"] for r in means.collect()})


_SCORED = "row long, doc_id long, n_tokens long, known long, known_score double, n_bytes long, bits double, rare binary"


def _score(model_share, start: State):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _shared(model_share)
        logs = np.log10(model.dictionary.counts + 0.1)
        for batch in slices(batches, "body", READ_BYTES):
            column = batch.column("body")
            tokens = _tokens(column)
            rows, hashes = tokens[:2]
            at = model.dictionary.find(hashes)
            inside = at >= 0
            n = batch.num_rows
            known = np.bincount(rows[inside], minlength=n)
            score = np.bincount(rows[inside], weights=logs[at[inside]] if len(logs) else None, minlength=n).astype(np.float64)
            rare = hashes[~inside]
            ends = np.cumsum(np.bincount(rows[~inside], minlength=n))
            raw = rare.astype("<u8").tobytes()
            packed = [raw[8 * s:8 * e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.bincount(rows, minlength=n)),
                "known": pa.array(known), "known_score": pa.array(score), "n_bytes": pa.array(np.diff(buffer_of(column)[1])),
                "bits": pa.array(bits(model, start, n, tokens, at)), "rare": pa.array(packed, pa.binary())})

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.array([len(x) // 8 for x in batch.column("rare").to_pylist()], dtype=np.int64)
        tokens = np.frombuffer(b"".join(batch.column("rare").to_pylist()), dtype="<u8")
        yield pa.RecordBatch.from_pydict({"row": pa.array(np.repeat(batch.column("row").to_numpy(), sizes)), "token": pa.array(tokens.view(np.int64))})


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte of every document."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    training = texts.where(~held_out(F.col("doc_id")))
    counts = written(token_counts(training))
    dictionary = _Share(spark, found := Dictionary.of(counts, DICTIONARY))
    trained = training.select("body").mapInArrow(_train(dictionary), "part int, counts binary").repartition(_PARTS + 2, "part")
    parts = {r["part"]: zlib.decompress(bytes(r["counts"])) for r in trained.mapInArrow(_merge, "part int, counts binary").collect()}
    model = _Share(spark, Model(found, parts))
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    scored = written(numbered.mapInArrow(_score(model, learned(training, model)), _SCORED))
    rare = scored.select("row", "rare").mapInArrow(_unpack, "row long, token long").groupBy("row", "token").agg(F.count("*").alias("k"))
    joined = rare.join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    of_row = joined.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("k"), F.sum(F.col("k") * F.log10(c + 0.1)).alias("s"))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"))
    size = totals.select("n").scalar()
    whole = size + 0.1 * (totals.select("v").scalar() + 1)
    return scored.join(of_row, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        size.cast("long").alias("train_tokens"),
        (F.col("known_score") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * F.log10(whole)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2.0)))).alias("score"),
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
