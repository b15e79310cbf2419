"""Gradient-boosted trees for two classes, small enough to be read: fitting, prediction, JSON."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.4, bins: int = 32, least: float = 1.0) -> dict:
    """Logistic boosting with second-order leaf values over quantile cuts; deterministic."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    score, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        tree: list = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(tree)
            tree.append(None)
            value = -g[rows].sum() / (h[rows].sum() + least)
            best = (1e-6, -1, 0.0)
            if level < depth and len(rows) > 1:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + least)
                for j, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    place = np.searchsorted(cut, x[rows, j], "left")
                    gs = np.bincount(place, g[rows], len(cut) + 1).cumsum()
                    hs = np.bincount(place, h[rows], len(cut) + 1).cumsum()
                    gain = gs[:-1] ** 2 / (hs[:-1] + least) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + least) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(cut[k]))
            if best[1] < 0:
                tree[at] = [rate * float(value)]
                score[rows] += rate * value
            else:
                left = x[rows, best[1]] <= best[2]
                tree[at] = [best[1], best[2], grow(rows[left], level + 1), grow(rows[~left], level + 1)]
            return at

        grow(np.arange(len(y)), 0)
        out.append([[round(v, 4) if isinstance(v, float) else v for v in node] for node in tree])
    return {"trees": out}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of class 1 for every row."""
    total = np.zeros(len(x))
    for tree in model["trees"]:
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = tree[at]
            if len(node) == 1:
                total[rows] += node[0]
            elif len(rows):
                left = x[rows, node[0]] <= node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
    return total


def save(model: dict, path: Path) -> None:
    path.write_text(json.dumps(model, separators=(",", ":")) + "\n")


_LOADED: dict[str, dict] = {}


def load(path: str) -> dict:
    if path not in _LOADED:
        _LOADED[path] = json.loads(Path(path).read_text())
    return _LOADED[path]
