"""Plain versions of the operators, in memory, to hold results against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(texts: dict, size: int, part: int) -> dict:
    """(number of shingles, smallest linked key) by key."""
    sets = {}
    for key, text in texts.items():
        w = WORD.findall((text or "").translate(SMALL))
        runs = [tuple(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []
        sets[key] = frozenset(runs)
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for a in sorted(sets):
        for b in {b for s in sets[a] for b in holders[s]}:
            common = len(sets[a] & sets[b])
            if 100 * common >= part * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        for s in sets[a]:
            holders[s].append(a)
    return {k: (len(sets[k]), find(k)) for k in sets}


def repeated_strings(bodies: list[bytes], span: int = 400) -> list[tuple[int, int, bytes]]:
    """Bytes removed, runs removed and what is left, for each body."""
    seen = Counter(b[i:i + span] for b in bodies for i in range(len(b) - span + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def line_dedup(texts: list[tuple], run: int = 2, lone: int = 100) -> dict:
    """Remaining lines by key, for (key, text) in order."""
    seen, gone = set(), defaultdict(set)
    for key, text in texts:
        lines = text.split("\n") if text is not None else []
        for size in (run, 1):
            for i in range(len(lines) - size + 1):
                part = tuple(lines[i:i + size])
                if sum(len("".join(WORD.findall(x))) for x in part) < (1 if size == run else lone):
                    continue
                if part in seen:
                    gone[key].update(range(i, i + size))
                seen.add(part)
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in texts}


def pieces(texts: dict, tokenizer, capacity: int = 2048) -> dict:
    """(start, length, crc) by (key, piece)."""
    out = {}
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out[key, piece] = (at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    return out


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
