"""Language identification with error-correcting output codes over hashed byte trigrams.

Every language gets a codeword; a binary logistic classifier per bit predicts it from the text's trigram profile. The
loss-weighted decoding sums, per language, the logistic losses of the bits against its codeword, each weighted by how
well that bit was learned for that language, and takes the least. Where the two best are close, the answer is marked
ambiguous. Classifiers are fitted on at most ``per_language`` labelled rows of each language (the fixed bound of the
training sample, rows with the smallest identifier hash); whole texts are used in fitting and prediction.

Defined results: a null text or one without any letter gives ``und`` with score 0; with no labelled rows all are
``und``; repeated rows get equal answers; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 2048
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def profiles(texts: list[str]) -> np.ndarray:
    """Unit-length square-rooted trigram frequencies; all that is not a letter counts as one blank."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
        b = _FOLD[raw]
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
        if len(b) >= 3:
            code = (b[:-2] * np.uint32(961) + b[1:-1] * np.uint32(31) + b[2:]) * np.uint32(2654435761)
            out[i] = np.sqrt(np.bincount(code >> np.uint32(32 - 11), minlength=DIM))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Up to 7 languages all distinct splits, beyond that the best of seeded random codes."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 7:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, np.float32).T
    length, best, code = int(np.ceil(10 * np.log2(k))), -1, None
    for seed in range(50):
        c = np.random.default_rng(seed).choice(np.array([1, -1], np.float32), (k, length))
        gap = min(int((c[i] != c[j]).sum()) for i in range(k) for j in range(i))
        varied = bool((np.abs(c.sum(0)) < k).all())
        if varied and gap > best:
            best, code = gap, c
    return code


class Model:
    def __init__(self, x: np.ndarray, langs: list[str], rounds: int = 120, rate: float = 0.05, decay: float = 1e-4) -> None:
        self.names = sorted(set(langs))
        y = np.array([self.names.index(v) for v in langs])
        self.code = codewords(len(self.names))
        share = np.bincount(y, minlength=len(self.names))[y]
        weight = (len(y) / share / len(self.names)).astype(np.float32)[:, None]
        want, bits = self.code[y], self.code.shape[1]
        self.w, self.b = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32)
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.b), np.zeros_like(self.b)]
        for t in range(1, rounds + 1):
            f = x @ self.w + self.b
            g = -want * weight / (1 + np.exp(np.clip(want * f, -30, 30))) / len(y)
            for p, grad, i in ((self.w, x.T @ g + decay * self.w, 0), (self.b, g.sum(0), 2)):
                moments[i] += 0.1 * (grad - moments[i])
                moments[i + 1] += 0.001 * (grad * grad - moments[i + 1])
                p -= rate * (moments[i] / (1 - 0.9**t)) / (np.sqrt(moments[i + 1] / (1 - 0.999**t)) + 1e-8)
        right = (np.sign(x @ self.w + self.b) == want).astype(np.float32)
        trust = np.array([right[y == i].mean(0) for i in range(len(self.names))])
        self.trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share among all, and the lead over the second."""
        f = x @ self.w + self.b
        loss = np.stack([(np.log1p(np.exp(-np.clip(c * f, -30, 30))) * t).sum(1) for c, t in zip(self.code, self.trust, strict=True)], 1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return p.argmax(1), order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def fit(labelled: DataFrame, per_language: int = 500) -> Model | None:
    """Fits on columns ``doc_id, text, lang``; rows without a language or a text are left out."""
    labelled = labelled.select("doc_id", "text", "lang")
    known = labelled.filter("lang is not null and text is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("own"), F.xxhash64("doc_id").alias("draw"))
    counts = known.groupBy("own").agg(F.count("*").alias("all"))
    share = (F.shiftrightunsigned(F.col("draw"), 11) / F.lit(float(1 << 53))) * F.col("all") <= 4 * per_language  # some four times as many rows as are taken, at any size
    few = known.join(F.broadcast(counts), "own").filter(share | (F.col("all") <= 4 * per_language))
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.shiftrightunsigned("draw", 11), "id"))
    chosen = F.broadcast(few.withColumn("n", rank).filter(F.col("n") <= per_language).select("id", "own"))  # per_language rows of each language
    rows = labelled.join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("own")))

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = profiles(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "x": [r.astype(np.float16).tobytes() for r in x]})

    got = rows.select("doc_id", "lang", "text").mapInPandas(shape, "doc_id long, lang string, x binary").toPandas()
    got = got.sort_values(["lang", "doc_id"], kind="stable")
    if not len(got):
        return None
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32)
    return Model(x, got["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, close: float = 0.2) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x bits weights

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                known = np.array([bool(_LETTER.search(t)) for t in texts], bool)
                if m is None:
                    known[:] = False
                lang, score, lead = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts))
                if known.any():
                    best, p, gap = m.decode(profiles([t for t, k in zip(texts, known, strict=True) if k]))
                    lang[known], score[known], lead[known] = np.array(m.names, object)[best], p, gap
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": lang, "score": score.clip(0, 1), "ambiguous": known & (lead < close)})

    return docs.select("doc_id", "text").mapInPandas(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
