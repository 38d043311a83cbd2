"""Fill-in-the-middle transformation with cuts found in Fenwick trees over text blocks.

A text is a sequence of units, words with the white space before them; white space at its end is a
unit of its own. A text is divided into blocks of ``BLOCK`` bytes, and a Fenwick tree holds how many units end
and how many code points start in each. A cut after ``k`` units is found by descending the tree in powers
of two to the block in which the ``k``-th unit ends; the place inside is looked up in that block alone.
No part of a text is matched or decoded for a cut outside these two blocks.

Prefix, middle and suffix come in one of two orders: psm, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, or
spm, ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. Whether a text is transformed, its order and its cuts
follow from a hash of the seed and its doc_id.

Defined cases: null and empty texts, and texts that hold one of the marks, stay plain; a text of
white space only is one unit; a null doc_id is hashed as no digits at all; rows with equal doc_id are cut
by the same draws; a text of any length is one tree; an empty table gives no rows; further columns
are ignored by ``digest`` and kept by ``transform``, which adds its own behind them and
refuses a table that has columns of these names already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytework import IS_SPACE, buffer_of
from .common import slices

BLOCK = 256
SEED = 42
MIDDLE_PERCENT = 50
SPM_PERCENT = 80
MARKS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = MARKS


class Fenwick:
    """Sums of several counts over the first blocks; row 0 of ``sums`` is empty, as usual for such trees."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        self.sums = np.zeros((n + 1, counts.shape[1]), dtype=np.int64)
        self.sums[1:] = counts
        step = 1
        while step < n:  # nodes of one size at a time
            parents = np.arange(2 * step, n + 1, 2 * step)
            self.sums[parents] += self.sums[parents - step]
            step *= 2
        self.top = 1 << max(n.bit_length() - 1, 0)

    def descend(self, target: int) -> tuple[int, np.ndarray]:
        """The block in which the ``target``-th (from 1) of the first count lies, and the sums before it."""
        place, before, step = 0, np.zeros(self.sums.shape[1], dtype=np.int64), self.top
        while step:
            ahead = place + step
            if ahead < len(self.sums) and before[0] + self.sums[ahead, 0] < target:
                place, before = ahead, before + self.sums[ahead]
            step //= 2
        return place, before


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the last bytes of units: the last byte of a word, and that of a text."""
    word = ~IS_SPACE[data]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = True
    return ends


class Cuts:
    """Units and code points of one text, and the places of cuts in it."""

    def __init__(self, ends: np.ndarray, heads: np.ndarray):
        self.ends, self.heads = ends, heads
        starts = np.arange(0, len(ends), BLOCK)
        counts = np.stack([np.add.reduceat(x, starts, dtype=np.int64) for x in (ends, heads)], axis=1) if len(ends) else np.zeros((0, 2), dtype=np.int64)
        self.tree = Fenwick(counts)
        self.units, self.points = (int(x) for x in counts.sum(axis=0))

    def after(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if units == 0:
            return 0, 0
        block, before = self.tree.descend(units)
        start = block * BLOCK
        inside = np.flatnonzero(self.ends[start:start + BLOCK])[units - int(before[0]) - 1] + 1
        return start + int(inside), int(before[1]) + int(np.count_nonzero(self.heads[start:start + inside]))


@dataclass(frozen=True)
class Draws:
    """The four numbers of a document."""

    first: int
    second: int
    form: int
    order: int

    @staticmethod
    def of(seed: int, doc_id: int | None) -> Draws:
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return Draws(*[int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)])


def arrange(body: bytes, form: str, first: int, second: int) -> bytes:
    """The text in the order of its form, cut at two byte places."""
    prefix, middle, suffix = body[:first], body[first:second], body[second:]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    if form == "spm":
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return body


def restore(output: bytes, form: str) -> bytes:
    """The text again, from an output and its form; the first mark of a kind is the one that was put there."""
    if form == "plain":
        return output
    rest, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = rest[len(PREFIX):].partition(SUFFIX)
    else:
        suffix, _, prefix = rest[len(SUFFIX):].partition(PREFIX)
    return b"".join((prefix, middle, suffix))


def _transformed(batch: pa.RecordBatch, seed: int, percent: int, spm: int) -> Iterator[tuple]:
    """n, form, bytes of the cuts, code points of prefix and middle, and the text, for every row."""
    data, offsets = buffer_of(batch.column("body"))
    ends = unit_ends(data, offsets) if len(data) else np.zeros(0, dtype=bool)
    heads = (data & 0xC0) != 0x80
    for row, (doc, body) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist())):
        here = slice(int(offsets[row]), int(offsets[row + 1]))
        draws = Draws.of(seed, doc)
        if not body or draws.form % 100 >= percent or any(mark in body for mark in MARKS):
            yield int(np.count_nonzero(ends[here])), "plain", (0, len(body)), (None, None), body
            continue
        cuts = Cuts(ends[here], heads[here])
        low, high = sorted((draws.first % (cuts.units + 1), draws.second % (cuts.units + 1)))
        (start, before), (end, upto) = cuts.after(low), cuts.after(high)
        yield cuts.units, "spm" if draws.order % 100 < spm else "psm", (start, end), (before, upto - before), body


_DIGEST = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digest(documents: DataFrame, seed: int = SEED, percent: int = MIDDLE_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """Units, form, sizes and the hashes of the output and of the text rebuilt from it, one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            rows = []
            for doc, (n, form, cut, sizes, body) in zip(batch.column("doc_id").to_pylist(), _transformed(batch, seed, percent, spm)):
                output = arrange(body, form, *cut)
                rows.append((doc, n, form, *sizes, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _DIGEST.split(", ")])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return texts.mapInArrow(run, _DIGEST)


def transform(documents: DataFrame, seed: int = SEED, percent: int = MIDDLE_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """The documents with ``form`` and ``output``, the text to train on; null texts have an empty one."""
    taken = {"form", "output"} & set(documents.columns)
    if taken:
        raise ValueError(f"columns there already: {sorted(taken)}")

    @F.pandas_udf("form string, output string")
    def run(docs: pd.Series, texts: pd.Series) -> pd.DataFrame:
        ids = pa.array([None if pd.isna(d) else int(d) for d in docs], pa.int64())
        batch = pa.RecordBatch.from_arrays([ids, pa.array([t.encode() for t in texts], pa.binary())], ["doc_id", "body"])
        done = [(form, arrange(body, form, *cut).decode()) for part in slices(iter([batch]), "body") for _, form, cut, _, body in _transformed(part, seed, percent, spm)]
        return pd.DataFrame(done, columns=["form", "output"])

    made = documents.withColumn("__made", run(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))
    return made.select(*documents.columns, F.col("__made.form").alias("form"), F.col("__made.output").alias("output"))


def restored(transformed: DataFrame) -> DataFrame:
    """The table of ``transform`` with its column ``text`` rebuilt from form and output alone."""
    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o.encode(), f).decode() for o, f in zip(outputs, forms)], dtype=object)

    return transformed.withColumn("text", run("output", "form"))


ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
  ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM texts),
cuts AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {MIDDLE_PERCENT} THEN 'plain'
    WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""
