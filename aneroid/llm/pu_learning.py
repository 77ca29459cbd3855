"""Quality classifier from positive and unlabelled text: non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>{}[]=_~^@\\/+")] = True
CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "mark": b"!?", "stop": b".,;:", "space": b" \t\n\x0b\f\r",
}


def statistics(text: str | None) -> list[float]:
    """Shares and means that describe how a whole text is written; all 0 for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * 12
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, len(data) - int(counts[list(CLASSES["space"])].sum()))
    share = {k: float(counts[list(v)].sum()) / letters for k, v in CLASSES.items()}
    lines = [x for x in data.split(b"\n") if x.strip()]
    different = len(set(words))
    return [
        np.log1p(len(words)),
        letters / len(words),
        share["upper"],
        share["digit"],
        share["mark"] * 10,
        share["stop"] * 10,
        float(counts[SYMBOLS].sum()) / letters * 4,
        different / len(words),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2),
        1 - len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)),
    ]


@dataclass(frozen=True)
class QualityModel:
    """A linear model over binned statistics, with the class prior it was fitted with."""

    cuts: tuple[tuple[float, ...], ...]
    weights: tuple[float, ...]
    prior: float

    def inputs(self, stats: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(stats), 1))]
        for i, cuts in enumerate(self.cuts):
            # thermometer code: one step up for every threshold passed
            parts.append((stats[:, i : i + 1] > np.array(cuts)[None, :]).astype(float))
        return np.concatenate(parts, axis=1)

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(stats) @ np.array(self.weights))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(
    positive: Sequence[str], unlabelled: Sequence[str], prior: float | None = None, bins: int = 16, steps: int = 600,
    rate: float = 0.05, decay: float = 1e-4,
) -> QualityModel:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) over positives and unlabelled texts.

    R_p(+) and R_p(-) are the mean logistic losses of calling positives good and bad, R_u(-) that of calling
    unlabelled texts bad. The second part is the risk of the negatives, and where it falls below 0 the step
    goes against it, as it only shrinks by overfitting. Without a given ``prior``, it is estimated first. No
    positives give the prior 0.5 to every text, no unlabelled texts the score of the positives.
    """
    if not positive or not unlabelled:
        return QualityModel((), (0.0 if not positive else 3.0,), 0.5 if not positive else 1.0)
    p, u = (np.array([statistics(t) for t in texts]) for texts in (positive, unlabelled))
    at = np.linspace(0, 1, bins + 1)[1:-1]
    both = np.concatenate([p, u])
    cuts = tuple(tuple(np.unique(np.concatenate([np.quantile(both[:, i], at), np.quantile(u[:, i], [0.01, 0.03, 0.97, 0.99])])).tolist()) for i in range(both.shape[1]))
    shape = QualityModel(cuts, (), 0.0)
    xp, xu = shape.inputs(p), shape.inputs(u)
    if prior is None:
        prior = estimate_prior(xp, xu)
    w = _descend(xp, xu, prior, steps, rate, decay)
    return QualityModel(cuts, tuple(w.tolist()), float(prior))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, rate: float, decay: float) -> np.ndarray:
    """Full-batch Adam on the non-negative risk."""
    w, m, v = (np.zeros(xp.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        gp, gu = _sigmoid(xp @ w), _sigmoid(xu @ w)
        negative = np.mean(-np.log(1 - gu + 1e-12)) - prior * np.mean(-np.log(1 - gp + 1e-12))
        plus = prior * (xp.T @ (gp - 1)) / len(xp)
        minus = (xu.T @ gu) / len(xu) - prior * (xp.T @ gp) / len(xp)
        g = plus + minus if negative >= 0 else -minus
        g = g + decay * np.concatenate([[0.0], w[1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(xp: np.ndarray, xu: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of their shares in sets that favour positives.

    Any set holds at least prior * (its share of positives) of the unlabelled. The sets are the upper parts of
    the scores of a classifier between both samples, fitted on one half and counted on the other.
    """
    half = (xp[::2], xu[::2]), (xp[1::2], xu[1::2])
    (ap, au), (bp, bu) = half
    if not len(bp) or not len(bu):
        return 0.5
    x, y = np.concatenate([ap, au]), np.repeat([1.0, 0.0], [len(ap), len(au)])
    weight = np.where(y > 0, 0.5 / len(ap), 0.5 / len(au))
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, 201):
        g = x.T @ (weight * (_sigmoid(x @ w) - y)) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    sp, su = np.sort(bp @ w), np.sort(bu @ w)
    ratios = []
    for q in np.linspace(0.0, 0.5, 21):  # higher cuts leave few texts and noisy ratios
        cut = np.quantile(sp, q)
        ratios.append(np.mean(su >= cut) / np.mean(sp >= cut))
    return float(np.clip(min(ratios), 0.01, 0.99))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> Column:
    """A column with the probability that the whole text is good. NULL counts as empty. Nothing is shuffled."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            # a few texts at a time: only their statistics are held
            stats = np.array([statistics(t) for t in texts]).reshape(len(texts), 12)
            yield pd.Series(model.probability(stats), dtype=float)

    return of(docs[text_col])
