"""Exact dedup with Patricia tries that own the texts.

Each task inserts the normalised bytes of its texts into a compressed radix trie whose
terminal nodes hold the best row (most code points, then smallest doc_id) and a count, and
passes on one row per terminal. When the trie holds more than ``SPILL_BYTES`` of labels, its
largest subtree is written out and starts anew; what it passes on are partial owners, so
nothing is lost. Terminals are partitioned by byte length and content hash and sorted; the
tries of one length and hash are built from whole strings again and give the owners. A group
with a third of all rows thus reaches the shuffle as one row per task.

Texts are equal when equal after deleting ASCII white space; null counts as empty. The row
with most code points stays, then the smallest doc_id (null ids last). Repeated rows count
one by one; a text of any length is one string of its trie; an empty table gives an empty result; extra columns are ignored by ``owners``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SPILL_BYTES = 32 << 20
_LAST = (1 << 63) - 1
_OWNER = "n_bytes long, content_hash long, body binary, chars long, doc long, has_id boolean, n long"


@dataclass
class Node:
    """``label`` leads here from the parent; ``best`` is (-code points, doc_id) of the owner, if a text ends here."""

    label: bytes
    children: dict[int, Node] = field(default_factory=dict)
    best: tuple[int, int] | None = None
    count: int = 0
    tag: tuple | None = None


class Trie:
    """A radix trie of byte strings whose edges are compressed."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def insert(self, text: bytes, best: tuple[int, int], count: int = 1, tag: tuple | None = None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(text) - at
                node = child
                break
            label = child.label
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            cut = _common(label, text, at)
            upper = Node(label[:cut], {label[cut]: child})
            child.label, node.children[text[at]] = label[cut:], upper
            node, at = upper, at + cut
        node.best = best if node.best is None else min(node.best, best)
        node.count, node.tag = node.count + count, tag

    def terminals(self, top: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        stack = [(top or self.root, prefix)]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.best is not None:
                yield text, node
            stack += [(child, text) for child in node.children.values()]

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """Writes out the subtree below the root with the most bytes and forgets it."""
        weights = {}
        for first, child in self.root.children.items():
            total, stack = 0, [child]
            while stack:
                node = stack.pop()
                total += len(node.label)
                stack += node.children.values()
            weights[first] = total
        first = max(weights, key=weights.get)
        child = self.root.children.pop(first)
        self.size -= weights[first]
        yield from self.terminals(child)


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def _row(text: bytes, node: Node) -> tuple:
    chars, doc = node.best
    return (*node.tag, text, -chars, doc, doc != _LAST, node.count)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = ("n_bytes", "content_hash", "body", "chars", "doc", "has_id", "n")
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], list(names))


def _flushed(rows: Iterator[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size > limit:
            yield _table(held)
            held, size = [], 0
    if held:
        yield _table(held)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        trie = Trie()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for doc, body, chars, length, hashed in zip(*columns):
                trie.insert(body, (-chars, _LAST if doc is None else doc), 1, (length, hashed))
                while trie.size > SPILL_BYTES:
                    yield from (_row(*x) for x in trie.spill())
        yield from (_row(*x) for x in trie.terminals())

    return _flushed(rows())


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        trie, current = Trie(), None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for length, hashed, body, chars, doc, has_id, n in zip(*columns):
                if (length, hashed) != current:
                    yield from owners_of(trie)
                    trie, current = Trie(), (length, hashed)
                trie.insert(body, (-chars, doc if has_id else _LAST), n, current)
        yield from owners_of(trie)

    def owners_of(trie: Trie) -> Iterator[tuple]:
        for text, node in trie.terminals():
            yield (*node.tag, hashlib.sha256(text).digest(), -node.best[0], node.best[1], node.best[1] != _LAST, node.count)

    return _flushed(rows())


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def owners(documents: DataFrame) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size."""
    bare = normalised(F.col("text"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), bare.cast("binary").alias("body"),
                             F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")).select(
        "doc_id", "body", "chars", F.length("body").cast("long").alias("n_bytes"), F.xxhash64("body").alias("content_hash"))
    partial = texts.mapInArrow(_partial, _OWNER)
    dealt = partial.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return dealt.mapInArrow(_final, _OWNER).select(
        F.lower(F.hex("body")).alias("text_sha256"), F.when(F.col("has_id"), F.col("doc")).alias("keep_id"), F.col("n").alias("group_size"))


def assign(documents: DataFrame) -> DataFrame:
    """Every row with the row that stays for its text; owners have one row per text, so AQE can split hot ones."""
    members = documents.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    return members.join(owners(documents), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(documents: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns (equal rows with the kept id stay together)."""
    keyed = documents.withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    kept = owners(documents).select(F.col("text_sha256").alias("__own"), F.col("keep_id").alias("__keep"))
    on = (keyed["__sha"] == kept["__own"]) & keyed["doc_id"].eqNullSafe(kept["__keep"])
    return keyed.join(kept, on, "left_semi").select(*documents.columns)


ORACLE = r"""
WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
best AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM bare GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM bare JOIN best USING (text_sha256)
"""
