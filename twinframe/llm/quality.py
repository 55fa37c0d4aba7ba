"""Quality scores learned by Bradley-Terry ranking.

Documents are described by rates of characters, words and lines. Preference pairs of a good and a bad labelled document give feature
differences, on which a logistic loss is minimised by Newton steps; the score of a document is the quantile of its strength among the labelled
ones, bent so that the quantile which parts the labels best comes to THRESHOLD.

Training reads at most LABELLED rows with their texts and uses PAIRS pairs; only their features reach the driver. Scoring is one scan without a shuffle.

Cases: null and empty texts have features of 0 and a score like any other; without labels of both kinds every score is
THRESHOLD; a label of null is none; of rows with one id, one text is learned; repeated rows get equal scores; an empty table gives no rows; columns of the results' names are replaced.
"""

from __future__ import annotations

import operator
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, sampled, utf8

LABELLED, PAIRS, THRESHOLD = 4000, 20_000, 0.3
LETTERS = string.ascii_letters.encode() + bytes(range(0x80, 0x100))
UPPER, DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
SYMBOLS = b"#$%&*!|<>{}[]=+^~_@/\\"
FEATURES = 16


def features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * FEATURES
    data = utf8(text)
    n = len(data)
    words = data.split()
    w = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters, symbols = n - len(data.translate(None, LETTERS)), n - len(data.translate(None, SYMBOLS))
    upper, digits = n - len(data.translate(None, UPPER)), n - len(data.translate(None, DIGITS))
    repeats = sum(map(operator.eq, words, words[1:]))
    same_line = 1 - len(set(lines)) / max(len(lines), 1)
    marked = sum(data.count(m) for m in (b"!!", b"***", b"###", b"$$$", b"%%%", b"&&&", b" | "))
    ended = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines) / max(len(lines), 1)
    rate = lambda x, of: x / max(of, 1)
    log = lambda x: np.log(x + 1e-3)
    return [
        np.log1p(w), rate(letters, n), rate(upper, letters), log(rate(upper, letters)), rate(symbols, n), log(rate(symbols, n)), rate(digits, n), log(rate(digits, n)),
        rate(letters, w) / 10, len(set(words)) / w, rate(repeats, w), log(rate(repeats, w)), same_line, rate(marked, w), log(rate(marked, w)), ended,
    ]


def strengths(good: np.ndarray, bad: np.ndarray, seed: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Weights under which the good one of a pair wins, by the logistic loss of strength differences."""
    rng = np.random.default_rng(seed)
    diff = good[rng.integers(len(good), size=PAIRS)] - bad[rng.integers(len(bad), size=PAIRS)]
    weights = np.zeros(diff.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ weights, -30, 30)))
        gradient = diff.T @ (1 - p) - ridge * weights
        curve = (diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


class Model:
    """Plain arrays of a learned scorer."""

    @staticmethod
    def learn(x: np.ndarray, label: np.ndarray) -> dict | None:
        if not len(x) or label.all() or not label.any():
            return None
        mean, spread = x.mean(0), x.std(0) + 1e-9
        z = (x - mean) / spread
        weights = strengths(z[label], z[~label])
        order = np.argsort(z @ weights)
        s, good = (z @ weights)[order], label[order]
        # below the cut stand the rejected: all bad ones there and no good one would be best
        balance = np.concatenate([[0.0], np.cumsum(~good) / (~good).sum() - np.cumsum(good) / good.sum()])
        at = int(balance.argmax())
        cut = s[0] if at == 0 else s[-1] if at == len(s) else (s[at - 1] + s[at]) / 2
        low, high = s[s < cut], s[s >= cut]
        knots = np.concatenate([[s[0] - 1], np.quantile(low, np.linspace(0, 1, 100)) if len(low) else [], [cut], np.quantile(high, np.linspace(0, 1, 100)) if len(high) else [], [s[-1] + 1]])
        levels = np.concatenate([[0.0], np.linspace(0.01, 0.29, 100) if len(low) else [], [THRESHOLD], np.linspace(0.31, 0.99, 100) if len(high) else [], [1.0]])
        return {"mean": mean, "spread": spread, "weights": weights, "knots": np.maximum.accumulate(knots), "levels": levels}

    @staticmethod
    def score(model: dict | None, x: np.ndarray) -> np.ndarray:
        if model is None:
            return np.full(len(x), THRESHOLD)
        return np.interp(((x - model["mean"]) / model["spread"]) @ model["weights"], model["knots"], model["levels"])


def score_quality(df: DataFrame, documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """df with `score` and `predicted`, learned from labels (id, label 0 or 1) and the texts that documents has for them."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").distinct()
    share = min(1.0, LABELLED / max(known.count(), 1))
    # about LABELLED rows by their hash; of more, the first in its order
    known = known.filter(sampled("id", share)).orderBy(F.xxhash64("id"), "id", "label").limit(2 * LABELLED)
    read = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    described = add_columns(read, [("x", "array<double>", pa.list_(pa.float64()))], lambda texts: [[features(t) for t in texts]], "text").groupBy("id", "label").agg(F.min("x").alias("x"))
    rows = sorted(described.collect(), key=lambda r: (r["id"], r["x"], r["label"]))
    model = df.sparkSession.sparkContext.broadcast(Model.learn(np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([r["label"] == 1 for r in rows], bool)))

    def work(texts):
        return [Model.score(model.value, np.array([features(t) for t in texts]).reshape(-1, FEATURES))]

    return add_columns(df, [("score", "double", pa.float64())], work, text_col).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
