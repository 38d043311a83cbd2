"""Secret scan: fixed rules, and a character network over every candidate and its surroundings.

The rules find assignments, access keys and long hexadecimal runs. Candidates of the network are all
maximal runs of ``[A-Za-z0-9+/_.=-]`` of at least ``SHORT`` characters with a digit, or ``LONG`` without; it
sees them with the text around them, whole: a run longer than a view is read in several views and judged by the
most suspicious one. What it finds outside the spans of the rules is added to them.

The network is trained on labelled findings: candidates of the corpus that the rules find are positive, the
others negative. Of both the ``LABELLED`` with the smallest hashes are taken (different ones; a
bounded sample that is the same however the table is split), and a quarter of them, positive and
negative alike, is shown without surroundings, so that the network must know a value by itself. Examples of public formats, and of
harmless runs that look like them, are drawn by a seeded generator and added, since rules label no format of
their own unknown. One part in five calibrates the probabilities, and sets for each class
of length the highest threshold that keeps a recall of ``RECALL``; another is held out for measuring.

Defined cases: null and empty texts have no spans; a text of any length is scanned whole; repeated rows are
scanned one by one; an empty table gives no rows; a table in which the rules find nothing is scanned with a network
that knows public formats only; further columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import top_k
from .bytework import buffer_of
from .charnet import INNER, LEFT, RIGHT, SYMBOL, Network, calibrated, threshold
from .common import slices
from .tables import drop, written

SHORT, LONG = 12, 20
LABELLED = 3000
PER_FORMAT = 150
RECALL = 0.95
EPOCHS = 6
SEED = 13
#: Lengths from which the classes with thresholds of their own begin.
CLASSES = (0, 24, 40)

#: Rules in the order in which spans of one start are listed: fixed by the contract. The last number is the least length of the last group.
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "network")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_MEMBER = np.zeros(256, dtype=bool)
_MEMBER[list(b"+/_.=-" + (string.ascii_letters + string.digits).encode())] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(string.digits.encode())] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True

_ALNUM, _UPPER = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
_HEXES, _BASE64, _URL64 = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-"

#: Public formats of keys: prefix, alphabet, number of characters.
SECRET_FORMATS = (
    ("ghp_", _ALNUM, 36), ("glpat-", _URL64, 20), ("xoxb-", string.digits + "-" + string.ascii_lowercase, 44), ("sk_live_", _ALNUM, 24), ("AIza", _URL64, 35),
    ("npm_", _ALNUM, 36), ("eyJhbGciOiJIUzI1NiJ9.", _URL64, 64), ("SG.", _URL64, 60), ("", _HEXES, 32), ("", _HEXES, 40), ("", _HEXES, 64), ("", _BASE64, 40), ("", _UPPER, 20), ("", _URL64, 24),
)


def _runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs; none goes over the end of a row."""
    if not len(member):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(member))]
    first[edges] = member[edges]
    last[edges - 1] = member[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def base_spans(body: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, str, int, int]]:
    """start, kind, end, start of the value for what the rules find in a text, in order; ``hexes`` are its hexadecimal runs."""
    found = [(start, "hex", end, start) for start, end in hexes if end - start >= LEAST["hex"]]
    found += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(body) if m.end() - m.start() >= LEAST["access"]]
    small = body.lower()
    if any(word in small for word in KEYWORDS):
        found += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(body) if m.end() - m.start(2) >= LEAST["assign"]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


@dataclass(frozen=True)
class Candidates:
    """Candidates of one slice of rows: bytes from ``start`` to ``end``, and the row they are in."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Candidates:
        start, end = _runs(_MEMBER[data], offsets)
        sums = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        length, digits = end - start, sums[end] - sums[start] if len(start) else np.zeros(0, dtype=np.int64)
        taken = (length >= LONG) | ((length >= SHORT) & (digits > 0))
        start, end = start[taken], end[taken]
        return Candidates(data, offsets, start, end, np.searchsorted(offsets, start, side="right") - 1)

    def views(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Views of some candidates, and the candidate (its place in ``which``) of each."""
        length = self.end[which] - self.start[which]
        count = -(-length // INNER)
        owner = np.repeat(np.arange(len(which)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = self.start[which][owner] + np.minimum(place * INNER, np.maximum(length[owner] - INNER, 0))
        end = np.minimum(start + INNER, self.end[which][owner])
        low, high = self.offsets[self.row[which]][owner], self.offsets[self.row[which] + 1][owner]
        before = start[:, None] + np.arange(-LEFT, 0)
        inner = start[:, None] + np.arange(INNER)
        after = end[:, None] + np.arange(RIGHT)
        at = np.concatenate([before, inner, after], axis=1)
        there = np.concatenate([before >= low[:, None], inner < end[:, None], after < high[:, None]], axis=1)
        return np.where(there, SYMBOL[self.data[np.where(there, at, 0)]], 0).astype(np.uint8), owner


def _scanned(batch: pa.RecordBatch) -> tuple[list[bytes], Candidates, list[list[tuple[int, str, int, int]]]]:
    """Bodies, candidates and spans of the rules of a batch with a binary column ``body``."""
    data, offsets = buffer_of(batch.column("body"))
    start, end = _runs(_HEX[data], offsets)
    wide = end - start >= LEAST["hex"]
    row = np.searchsorted(offsets, start[wide], side="right") - 1
    hexes: dict[int, list] = {}
    for r, s, e in zip(row.tolist(), start[wide].tolist(), end[wide].tolist()):
        hexes.setdefault(r, []).append((s - int(offsets[r]), e - int(offsets[r])))
    bodies = batch.column("body").to_pylist()
    return bodies, Candidates.of(data, offsets), [base_spans(body, hexes.get(r, [])) for r, body in enumerate(bodies)]


def _met(candidates: Candidates, base: list[list[tuple]]) -> np.ndarray:
    """Whether a candidate overlaps a span of the rules."""
    met = np.zeros(len(candidates.start), dtype=bool)
    for row, spans in enumerate(base):
        if spans:
            first, last = np.searchsorted(candidates.row, [row, row + 1])
            begin = candidates.offsets[row]
            for start, _, end, _ in spans:
                met[first:last] |= (candidates.start[first:last] < begin + end) & (candidates.end[first:last] > begin + start)
    return met


# ---- labelled findings --------------------------------------------------------------------

_LABELLED = "label int, key long, view binary, size int"


def labelled(documents: DataFrame, most: int = LABELLED) -> DataFrame:
    """label, key, view, size of the ``most`` different candidates of either label with the smallest keys.

    Every task gives out no more than that many of a label, and the rest is decided in slices, so no task
    gathers more than its share.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple[bytes, int]]] = [{}, {}]
        for batch in slices(batches, "body"):
            _, candidates, base = _scanned(batch)
            labels = _met(candidates, base)
            views, owner = candidates.views(np.arange(len(candidates.start)))
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            for k, at in enumerate(firsts.tolist()):
                label, size = int(labels[k]), int(candidates.end[k] - candidates.start[k])
                value = candidates.data[candidates.start[k]:candidates.end[k]].tobytes()
                key = int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)
                view = (views[at].tobytes(), size)
                if key not in best[label] or view < best[label][key]:
                    best[label][key] = view
            for label in (0, 1):
                if len(best[label]) > 4 * most:
                    best[label] = {k: best[label][k] for k in sorted(best[label])[:most]}
        rows = [(label, k, *best[label][k]) for label in (0, 1) for k in sorted(best[label])[:most]]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _LABELLED.split(", ")])

    texts = documents.select(F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    one = texts.mapInArrow(run, _LABELLED).groupBy("label", "key").agg(F.min(F.struct("view", "size")).alias("seen"))
    return top_k(one.select("label", "key", "seen.view", "seen.size"), ["label"], [F.col("key")], most)


def drawn(seed: int, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Views, labels and sizes of examples of public formats and of harmless runs, without surroundings or in quotes."""
    r = np.random.default_rng(seed)

    def text(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in r.integers(0, len(alphabet), n))

    def word() -> str:
        return "".join(("b c d f g l m n p r s t".split()[r.integers(12)]) + ("a e i o u".split()[r.integers(5)]) for _ in range(r.integers(2, 5)))

    def harmless(k: int) -> str:
        return (
            lambda: "/".join(word() for _ in range(r.integers(3, 7))) + f"/{word()}.html", lambda: "-".join(word() for _ in range(r.integers(3, 7))),
            lambda: "_".join(word() for _ in range(r.integers(3, 7))) + str(r.integers(10)), lambda: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}",
            lambda: text(string.digits, r.integers(12, 20)), lambda: f"{word()}{r.integers(1, 100)}.{word()}.com", lambda: "".join(word() for _ in range(r.integers(3, 8))),
            lambda: f"{word()}-{r.integers(10)}.{r.integers(30)}.{r.integers(100)}", lambda: r.choice(list("-=_.")) * int(r.integers(20, 80)), lambda: word().upper() + "_" + word().upper() + str(r.integers(100)),
        )[k % 10]()

    made = [(prefix + text(alphabet, size), 1) for prefix, alphabet, size in SECRET_FORMATS for _ in range(each)]
    made += [(x, 0) for k in range(each * len(SECRET_FORMATS)) if len(x := str(harmless(k))) >= SHORT]
    views = np.zeros((len(made), LEFT + INNER + RIGHT), dtype=np.uint8)
    for view, (value, _) in zip(views, made):
        symbols = SYMBOL[np.frombuffer(value.encode()[:INNER], dtype=np.uint8)]
        view[LEFT:LEFT + len(symbols)] = symbols
        edge = "\"' "[r.integers(3)].encode()[0]
        view[LEFT - 1] = view[LEFT + INNER] = SYMBOL[edge]
    return views, np.array([label for _, label in made]), np.array([len(value) for value, _ in made])


# ---- the detector -------------------------------------------------------------------------


@dataclass(frozen=True)
class Detector:
    """A trained network, its calibration and its thresholds by class of length; and what it reached on findings held out."""

    network: Network
    slope: float
    offset: float
    thresholds: tuple[float, ...]
    held_out: dict[str, float]

    def probabilities(self, views: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.network.logits(views).astype(np.float64) + self.offset, -500, 500)))

    def judge(self, candidates: Candidates, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of some candidates, the greatest of their views, and whether it reaches the threshold of their length."""
        if not len(which):
            return np.zeros(0), np.zeros(0, dtype=bool)
        views, owner = candidates.views(which)
        best = np.maximum.reduceat(self.probabilities(views), np.flatnonzero(np.diff(owner, prepend=-1)))
        return best, best >= np.array(self.thresholds)[_class(candidates.end[which] - candidates.start[which])]


def _class(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(CLASSES), sizes, side="right") - 1


def fit(views: np.ndarray, labels: np.ndarray, sizes: np.ndarray, recall: float = RECALL, epochs: int = EPOCHS, seed: int = SEED) -> Detector:
    """A detector from labelled views; of every five in a fixed shuffle three train, one calibrates and one is held out."""
    order = np.random.default_rng(seed).permutation(len(views))
    views, labels, sizes = views[order], labels[order], sizes[order]
    fold = np.arange(len(views)) % 5
    network = Network.fresh(seed)
    network.train(views[fold < 3], labels[fold < 3], epochs, seed)
    logits = network.logits(views)
    slope, offset = calibrated(logits[fold == 3], labels[fold == 3])
    p = 1 / (1 + np.exp(-np.clip(slope * logits.astype(np.float64) + offset, -500, 500)))
    kinds = _class(sizes)
    pool = (fold == 3) & (labels == 1)
    thresholds = tuple(threshold(p[own], recall) if (own := pool & (kinds == k)).sum() >= 20 else threshold(p[pool], recall) for k in range(len(CLASSES)))
    said, true = p >= np.array(thresholds)[kinds], labels == 1
    apart = fold == 4
    held_out = {
        "recall": float((said & true & apart).sum() / max((true & apart).sum(), 1)), "false_alarms": float((said & ~true & apart).sum() / max((~true & apart).sum(), 1)),
        "calibration_error": float(abs(p[apart].mean() - true[apart].mean()))}
    return Detector(network, slope, offset, thresholds, held_out)


def train(documents: DataFrame, most: int = LABELLED, each: int = PER_FORMAT) -> Detector:
    """A detector trained on at most ``2 * most`` findings of the corpus and the drawn examples."""
    gathered = written(labelled(documents, most))
    rows = sorted((r["label"], r["key"], bytes(r["view"]), r["size"]) for r in gathered.collect())  # bounded by 2 * most
    drop(gathered)
    own = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(rows), LEFT + INNER + RIGHT).copy()
    bare = np.arange(len(rows)) % 4 == 0
    own[bare, :LEFT], own[bare, LEFT + INNER:] = 0, 0
    views, labels, sizes = drawn(SEED, each)
    return fit(
        np.concatenate([own, views]), np.concatenate([np.array([r[0] for r in rows], dtype=np.int64), labels]),
        np.concatenate([np.array([r[3] for r in rows], dtype=np.int64), sizes]))


def _points(body: bytes, places: list[int]) -> list[int]:
    """Code points before each of some byte places."""
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(body, dtype=np.uint8) & 0xC0) != 0x80)])
    return heads[places].tolist()


def _found(batch: pa.RecordBatch, detector: Detector) -> Iterator[tuple[bytes, list[tuple[str, int, int, float | None]]]]:
    """Body and spans (kind, byte start, byte end, probability; null for the rules) of every row, in order."""
    bodies, candidates, base = _scanned(batch)
    free = np.flatnonzero(~_met(candidates, base))
    p, good = detector.judge(candidates, free)
    added: dict[int, list] = {}
    for k, probability in zip(free[good].tolist(), p[good].tolist()):
        row = int(candidates.row[k])
        begin = int(candidates.offsets[row])
        added.setdefault(row, []).append((int(candidates.start[k]) - begin, "network", int(candidates.end[k]) - begin, probability))
    for row, body in enumerate(bodies):
        spans = [(start, kind, end, None) for start, kind, end, _ in base[row]] + added.get(row, [])
        spans.sort(key=lambda x: (x[0], KINDS.index(x[1])))
        yield body, [(kind, start, end, probability) for start, kind, end, probability in spans]


_DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, n_network long, base_sha256 string, spans string"


def scan(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Counts and spans (code points) of every document, one row each; the detector is trained on the table if none is given."""
    detector = detector or train(documents)

    def joined(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            rows = []
            for doc, (body, found) in zip(batch.column("doc_id").to_pylist(), _found(batch, detector)):
                places = _points(body, [x for _, start, end, _ in found for x in (start, end)]) if found else []
                spans = [(kind, places[2 * k], places[2 * k + 1]) for k, (kind, *_) in enumerate(found)]
                base = joined([s for s in spans if s[0] != "network"])
                rows.append((doc, *[sum(s[0] == kind for s in spans) for kind in KINDS], hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _DIGEST.split(", ")])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return texts.mapInArrow(run, _DIGEST)


def redact(documents: DataFrame, detector: Detector | None = None, mark: str = "<SECRET>") -> DataFrame:
    """The documents with every span replaced by ``mark``; n_chars follows the text, a null text stays null."""
    detector = detector or train(documents)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], ["body"])
        done = []
        for part in slices(iter([batch]), "body"):
            for body, found in _found(part, detector):
                out, at = [], 0
                for _, start, end, _ in found:
                    if end > at:
                        out += [body[at:max(start, at)], mark.encode()] if start >= at else []
                        at = end
                done.append(b"".join([*out, body[at:]]).decode())
        return pd.Series(done, dtype=object)

    text = F.when(F.col("text").isNotNull(), run(F.coalesce("text", F.lit(""))))
    cut = documents.withColumn("text", text)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else cut
