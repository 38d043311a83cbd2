"""A small convolutional network over characters, in numpy: training, probabilities, thresholds.

A view is a candidate with its surroundings, as one row of symbols: ``LEFT`` bytes before it,
``INNER`` bytes of it, ``RIGHT`` bytes after it. Symbols are embedded and convolved; every filter is pooled
over the three parts apart (its maximum, and its mean inside the candidate), and one hidden layer
turns the pools into a logit. Everything is seeded, so equal views and labels give equal weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEFT, INNER, RIGHT = 32, 64, 16
WIDTH = 5
_DIMENSIONS, _FILTERS, _HIDDEN = 12, 24, 24
_SYMBOLS = 98  # 0: nothing there, 1: bytes of other alphabets, 2: control characters, then printable ASCII
_PARTS = ((0, LEFT), (LEFT, LEFT + INNER), (LEFT + INNER, LEFT + INNER + RIGHT))

#: Symbol of every byte.
SYMBOL = np.full(256, 1, dtype=np.uint8)
SYMBOL[:0x20] = 2
SYMBOL[0x7F] = 2
SYMBOL[0x20:0x7F] = np.arange(3, 98)


def _pool_bounds() -> list[tuple[int, int]]:
    """Convolved places whose middle lies in each part."""
    half = WIDTH // 2
    last = LEFT + INNER + RIGHT - WIDTH + 1
    return [(max(start - half, 0), min(end - half, last)) for start, end in _PARTS]


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Network:
        r = np.random.default_rng(seed)

        def drawn(rows: int, columns: int) -> np.ndarray:
            return (r.standard_normal((rows, columns)) * np.sqrt(2 / rows)).astype(np.float32)

        channels = _DIMENSIONS + len(_PARTS)
        pools = (len(_PARTS) + 1) * _FILTERS
        zeros = lambda n: np.zeros(n, dtype=np.float32)
        return Network({
            "symbols": (r.standard_normal((_SYMBOLS, _DIMENSIONS)) * 0.5).astype(np.float32), "filters": drawn(channels * WIDTH, _FILTERS), "filters0": zeros(_FILTERS),
            "hidden": drawn(pools, _HIDDEN), "hidden0": zeros(_HIDDEN), "out": drawn(_HIDDEN, 1), "out0": zeros(1)})

    def _forward(self, views: np.ndarray) -> tuple[np.ndarray, dict]:
        w, n = self.weights, len(views)
        parts = np.zeros((views.shape[1], len(_PARTS)), dtype=np.float32)
        for k, (start, end) in enumerate(_PARTS):
            parts[start:end, k] = 1
        x = np.concatenate([w["symbols"][views], np.broadcast_to(parts, (n, *parts.shape))], axis=2)
        columns = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).reshape(-1, w["filters"].shape[0])
        z = (columns @ w["filters"] + w["filters0"]).reshape(n, -1, _FILTERS)
        a = np.maximum(z, 0)
        peaks = [start + a[:, start:end].argmax(axis=1) for start, end in _pool_bounds()]
        inner = slice(*_pool_bounds()[1])
        pooled = np.concatenate([*[np.take_along_axis(a, p[:, None], axis=1)[:, 0] for p in peaks], a[:, inner].mean(axis=1)], axis=1)
        before = pooled @ w["hidden"] + w["hidden0"]
        hidden = np.maximum(before, 0)
        return (hidden @ w["out"] + w["out0"])[:, 0], {"columns": columns, "z": z, "peaks": peaks, "pooled": pooled, "hidden": hidden}

    def logits(self, views: np.ndarray, rows: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(views[k:k + rows])[0] for k in range(0, len(views), rows)] or [np.zeros(0, dtype=np.float32)])

    def gradients(self, views: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss (logistic) and its gradients."""
        w, n = self.weights, len(views)
        logits, kept = self._forward(views)
        loss = float(np.mean(np.logaddexp(0, logits) - labels * logits))
        back = (((1 / (1 + np.exp(-logits))) - labels) / n).astype(np.float32)[:, None]
        g = {"out": kept["hidden"].T @ back, "out0": back.sum(axis=0)}
        back = (back @ w["out"].T) * (kept["hidden"] > 0)
        g |= {"hidden": kept["pooled"].T @ back, "hidden0": back.sum(axis=0)}
        back = back @ w["hidden"].T
        a = np.zeros_like(kept["z"])
        rows, filters = np.arange(n)[:, None], np.arange(_FILTERS)[None]
        for k, peak in enumerate(kept["peaks"]):
            a[rows, peak, filters] += back[:, k * _FILTERS:(k + 1) * _FILTERS]
        start, end = _pool_bounds()[1]
        a[:, start:end] += back[:, None, -_FILTERS:] / (end - start)
        z = (a * (kept["z"] > 0)).reshape(-1, _FILTERS)
        g |= {"filters": kept["columns"].T @ z, "filters0": z.sum(axis=0)}
        columns = (z @ w["filters"].T).reshape(n, -1, _DIMENSIONS + len(_PARTS), WIDTH)
        x = np.zeros((n, views.shape[1], _DIMENSIONS), dtype=np.float32)
        for k in range(WIDTH):
            x[:, k:k + columns.shape[1]] += columns[:, :, :_DIMENSIONS, k]
        flat, spread = views.reshape(-1), x.reshape(-1, _DIMENSIONS)
        g["symbols"] = np.stack([np.bincount(flat, spread[:, d], _SYMBOLS) for d in range(_DIMENSIONS)], axis=1).astype(np.float32)
        return loss, g

    def train(self, views: np.ndarray, labels: np.ndarray, epochs: int, seed: int, size: int = 256, rate: float = 3e-3) -> None:
        """Adam over shuffled batches; both labels weigh the same, whatever their numbers."""
        r, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        by_label = [np.flatnonzero(labels == k) for k in (0, 1)]
        longest = max(len(x) for x in by_label)
        for _ in range(epochs):
            even = np.concatenate([np.resize(r.permutation(x), longest) for x in by_label])
            order = r.permutation(even)
            for start in range(0, len(order), size):
                batch, step = order[start:start + size], step + 1
                _, g = self.gradients(views[batch], labels[batch].astype(np.float32))
                for k, v in g.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def calibrated(logits: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn logits into probabilities: logistic regression with softened labels, by Newton steps."""
    positive, negative = labels.sum(), len(labels) - labels.sum()
    soft = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([logits.astype(np.float64), np.ones(len(logits))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        change = np.linalg.solve(hessian, x.T @ (soft - p))
        at = at + np.clip(change, -1, 1)
        if np.abs(change).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def threshold(probabilities: np.ndarray, recall: float) -> float:
    """The highest threshold that still finds a share of ``recall`` of these positives."""
    ordered = np.sort(probabilities)[::-1]
    return float(ordered[int(np.ceil(recall * len(ordered))) - 1])
