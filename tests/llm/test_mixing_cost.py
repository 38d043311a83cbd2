"""What learning the mix costs, and that what is tabulated for it is what counting gives."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from partlens.llm import mixing


def _model(texts):
    batch = pa.RecordBatch.from_pydict({"body": pa.array([t.encode() for t in texts], pa.binary())})
    tokens = mixing._tokens(batch.column("body"))
    kinds, counts = np.unique(tokens[1], return_counts=True)
    dictionary = mixing.Dictionary(kinds[1:], counts[1:])  # one is outside
    mixing._held["cost"] = dictionary
    parts = [x for b in mixing._merge(mixing._train(type("Share", (), {"key": "cost"}))([batch])) for x in b.to_pylist()]
    return mixing.Model(dictionary, {x["part"]: zlib.decompress(x["counts"]) for x in parts}), batch, tokens


def test_inputs_are_those_of_counts_with_and_without_the_bit_itself():
    model, _, tokens = _model(["a b a b c a b", "c a d", "", "b b b a c d e a b c"] * 3)
    nodes, bit, size, _ = mixing._bits_of(model.dictionary.rank(model.dictionary.find(tokens[1])))
    contexts = mixing._contexts(*tokens[:2])
    slots = [mixing._slots(o, np.repeat(c, size), nodes) for o, c in enumerate(contexts)]
    for learning in (False, True):
        x, seen = mixing._inputs(model, contexts, nodes, bit, size, learning)
        before = 0.0
        for order, slot in enumerate(slots):
            ones, zeros = (np.array([((slot == s) & (bit == v)).sum() for s in slot]) for v in (1, 0))
            ones, zeros = ones - learning * (bit == 1), zeros - learning * (bit == 0)
            logit, kind = np.log((ones + 0.2) / (zeros + 0.2)), np.frexp((ones + zeros).astype(float))[1]
            before = before + mixing._SAY[kind] * (logit - before) if order else logit
            assert x[order] == pytest.approx(before, abs=1e-3)
        assert seen.tolist() == kind.tolist()


def test_learning_reads_no_text_token_by_token(monkeypatch):
    """A text of 9,000 tokens is a few steps of learning, not one for every token."""
    model, batch, _ = _model([" ".join(f"w{i * i % 97}" for i in range(9000))])
    mixing._held["cost"] = model
    laid, steps = mixing._inputs, []
    monkeypatch.setattr(mixing, "_inputs", lambda *a: (steps.append(1), laid(*a))[1])
    monkeypatch.setattr(mixing, "_mixed", None)
    found = next(iter(mixing._learn(type("Share", (), {"key": "cost"}))([batch])))
    assert 1 <= len(steps) <= 3
    sizes = mixing._bits_of(model.dictionary.rank(model.dictionary.find(mixing._tokens(batch.column("body"))[1])))[2]
    cells, n = found["cell"].to_numpy(), found["n"].to_numpy()
    assert n[cells < mixing._GATES].sum() == sizes.sum() == n[cells >= mixing._ORDERS * mixing._GATES].sum()
