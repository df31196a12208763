"""A network of one hidden layer, trained by gradients that are summed over the cluster.

ReLU units with dropout, focal loss with class weights, Adam. Every step is one Spark job: the rows of the step, chosen by
a seeded hash, give their gradient where they lie, and the gradients are added up in a tree. The driver holds parameters
and sums of their size, never rows. The weights with the best validation loss are kept; training stops once that has not
improved for ``patience`` epochs. Dropout depends on the row, the step and the unit alone, not on how rows are spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.prefs import confidence, prediction, split
from shelfmark.scratch import staged

#: Gradients that one task adds up.
FAN_IN = 32
_SUMS = "gradient binary, loss double, weight double, validation double, validation_weight double"


@dataclass(frozen=True)
class Settings:
    hidden: int = 256
    dropout: float = 0.3
    gamma: float = 2.0
    rate: float = 5e-3
    epochs: int = 50
    steps: int = 2
    patience: int = 5
    seed: int = 42


@dataclass(frozen=True)
class Network:
    """Weights as one vector: hidden weights and biases, output weights and bias."""

    width: int
    settings: Settings
    weights: np.ndarray

    @classmethod
    def start(cls, width: int, settings: Settings) -> Network:
        draw, h = np.random.default_rng(settings.seed), settings.hidden
        w = [draw.normal(0, math.sqrt(2 / width), width * h), np.zeros(h), draw.normal(0, math.sqrt(1 / h), h), np.zeros(1)]
        return cls(width, settings, np.concatenate(w))

    def parts(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, h = self.width, self.settings.hidden
        return vector[: d * h].reshape(d, h), vector[d * h : d * h + h], vector[d * h + h : d * h + 2 * h], vector[-1:]

    def logits(self, x: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits and hidden units; ``kept`` are the factors of dropout."""
        w1, b1, w2, b2 = self.parts(self.weights)
        hidden = np.maximum(x @ w1 + b1, 0)
        if kept is not None:
            hidden = hidden * kept
        return hidden @ w2 + b2[0], hidden

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Sums over the rows of the weighted loss and of its gradient."""
        z, hidden = self.logits(x, kept)
        loss, slope = focal(z, y, self.settings.gamma)
        slope = slope * weight
        w2 = self.parts(self.weights)[2]
        back = slope[:, None] * w2 * (hidden > 0) * (1 if kept is None else kept)
        return float(loss @ weight), np.concatenate([(x.T @ back).ravel(), back.sum(0), hidden.T @ slope, [slope.sum()]])


def focal(z: np.ndarray, y: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Focal loss of logits and its slope; ``gamma`` 0 is cross-entropy."""
    sign = 2.0 * y - 1
    log_p = -np.logaddexp(0, -sign * z)  # of the true class
    p, q = np.exp(log_p), np.exp(-np.logaddexp(0, sign * z))
    return -(q**gamma) * log_p, sign * (gamma * p * q**gamma * log_p - q ** (gamma + 1))


def keeps(rows: np.ndarray, units: int, dropout: float, step: int) -> np.ndarray | None:
    """0 or 1 / (1 - dropout) for each row and unit, by hashes of the row's number, the unit and the step."""
    if not dropout:
        return None
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(units, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(step)
        for shift in (30, 27):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >= np.uint64(int(dropout * 2**63) * 2)) / (1 - dropout)


def _sums(net: Network, step: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, out = np.zeros(len(net.weights)), np.zeros(4)
        for rows in batches:
            for held, r in rows.groupby("is_validation"):
                x, y, w = np.array(r["features"].tolist(), float), r["label"].to_numpy(float), r["weight"].to_numpy(float)
                if held:
                    out[2:] += focal(net.logits(x)[0], y, net.settings.gamma)[0] @ w, w.sum()
                else:
                    loss, g = net.gradient(x, y, w, keeps(r["draw"].to_numpy(np.int64), net.settings.hidden, net.settings.dropout, step))
                    total += g
                    out[:2] += loss, w.sum()
        yield pd.DataFrame({"gradient": [total.tobytes()], **{c: [v] for c, v in zip(("loss", "weight", "validation", "validation_weight"), out, strict=True)}})

    return of


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, out = None, np.zeros(4)
    for rows in batches:
        for g in rows["gradient"]:
            total = np.frombuffer(g) + (0 if total is None else total)
        out += rows[["loss", "weight", "validation", "validation_weight"]].sum().to_numpy()
    if total is not None:
        yield pd.DataFrame({"gradient": [total.tobytes()], **{c: [v] for c, v in zip(("loss", "weight", "validation", "validation_weight"), out, strict=True)}})


def _step(rows: DataFrame, net: Network, step: int, parts: int) -> pd.Series:
    """Sums of the gradient and the losses of rows in ``parts`` partitions; the driver adds at most ``FAN_IN`` of them."""
    sums = rows.mapInPandas(_sums(net, step), _SUMS)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInPandas(_added, _SUMS)
    return next(_added(iter([sums.toPandas()]))).iloc[0]


def train_network(rows: DataFrame, settings: Settings = Settings()) -> tuple[Network, list[float]]:
    """The network with the best validation loss, and that loss of every epoch, from ``file_id, features, label``."""
    parted = split(rows, settings.seed)
    counts = parted.filter("not is_validation").groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))  # a row a class, and one row
    draw = F.xxhash64("file_id", F.lit(settings.seed + 1)).alias("draw")
    weight = F.coalesce(F.col("t") / (F.col("k") * F.col("n")), F.lit(1.0)).alias("weight")
    data = parted.join(F.broadcast(counts), "label", "left").join(F.broadcast(total)).select("features", "label", "is_validation", draw, weight)
    data = staged(data.filter("features is not null"), "network-rows")
    width, parts = len(data.first()["features"]), data.rdd.getNumPartitions()
    net, best = Network.start(width, settings), None
    first, second, step, losses, worse = np.zeros(len(net.weights)), np.zeros(len(net.weights)), 0, [], 0
    for epoch in range(settings.epochs + 1):  # the last only measures
        turn = F.pmod(F.xxhash64("draw", F.lit(epoch)), F.lit(settings.steps))
        for part in range(settings.steps):
            sums = _step(data.filter((turn == part) & ~F.col("is_validation") | F.col("is_validation") & F.lit(part == 0)), net, step, parts)
            if part == 0:
                losses.append(float(sums["validation"] / max(sums["validation_weight"], 1e-9)))
                worse = 0 if losses[-1] == min(losses) else worse + 1
                best = net if not worse else best
                if worse >= settings.patience or epoch == settings.epochs:
                    return best, losses
            if sums["weight"]:
                g = np.frombuffer(sums["gradient"]) / sums["weight"]
                step += 1
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                net = replace(net, weights=net.weights - settings.rate * move)
    return best, losses


def score_network(net: Network, features: DataFrame, version: int) -> DataFrame:
    """``file_id, ai_raw_score, ai_prediction, ai_confidence, model_version`` for every row with a feature."""

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            z = net.logits(np.array(rows["embedding"].tolist(), float).reshape(len(rows), -1))[0] if len(rows) else np.zeros(0)
            yield pd.DataFrame({"file_id": rows["file_id"], "ai_raw_score": 1 / (1 + np.exp(-z))})

    p = F.col("ai_raw_score")
    rows = features.filter("embedding is not null").select("file_id", "embedding")
    out = rows.mapInPandas(scores, f"file_id {rows.schema['file_id'].dataType.simpleString()}, ai_raw_score double")
    return out.select("file_id", "ai_raw_score", prediction(p).alias("ai_prediction"), confidence(p).alias("ai_confidence"), F.lit(version).alias("model_version"))
