"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its hashed word vector and the mean vector of its hashed character trigrams. The network reads windows
of ``WINDOW`` words that overlap by a quarter, covering the whole text; a text's score is the calibrated score of its
most toxic window. It is fitted on all windows of at most ``per_class`` labelled rows of each class (those with the
smallest identifier hash); that is the bound of the training sample. In fitting, each text is represented by its highest
windows, as only some windows of a toxic text are toxic. For the calibration the sample is divided into ``FOLDS`` parts,
each scored by a network fitted on the others in a third of the steps; the logit that parts the classes best (by F1, with
the classes as frequent as among all labels) becomes a score of ``CUT``. The network itself is then fitted on all.

Defined results: null and empty texts are scored as one empty window; without labels of both classes every score is 0;
repeated rows get equal scores; labels without a document or with null are ignored; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.scratch import staged

WINDOW, STRIDE = 32, 24
#: Words and windows of which what is made on the way is held at once.
BLOCK = 8192
BUCKETS, EMBED, HIDDEN = 4096, 16, 16
#: Parts of the sample scored by networks fitted without them, and the score of the logit that parts the classes best.
FOLDS, CUT = 3, 0.7
_BLANKS = {i: " " for i in range(128) if not chr(i).isalpha()}


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().translate(_BLANKS).split()


class Vocabulary:
    """Distinct words of some texts with their word bucket and character trigram buckets; what is made on the way is of ``BLOCK`` words at most."""

    def __init__(self, words: list[str]) -> None:
        parts = [_buckets(words[i : i + BLOCK]) for i in range(0, len(words), BLOCK)] or [_buckets([])]
        self.size, self.grams, self.word = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first = np.cumsum(self.size) - self.size

    def inputs(self, net: "Network") -> np.ndarray:
        out = np.empty((len(self.size), 2 * EMBED), np.float32)
        for i in range(0, len(out), BLOCK):
            first, size = self.first[i : i + BLOCK], self.size[i : i + BLOCK]
            sums = np.add.reduceat(net.p["chars"][self.grams[first[0] : first[-1] + size[-1]]], first - first[0], axis=0)
            out[i : i + BLOCK, :EMBED] = net.p["words"][self.word[i : i + BLOCK]]
            out[i : i + BLOCK, EMBED:] = sums / size[:, None]
        return out


def _buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the number of its trigrams, their buckets and its own bucket."""
    raw = np.frombuffer(("".join(f" {w} " for w in words) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    blanks = np.flatnonzero(raw == 32)[: 2 * len(words)]
    before, after = blanks[::2], blanks[1::2]
    size = after - before  # trigrams start at the blank before a word and at each of its bytes
    own = np.ones(max(0, len(raw) - 2), bool)
    own[after[:-1]] = False  # those that start behind a word depend on the next one
    code = ((raw[:-2] * np.uint32(65599) + raw[1:-1] * np.uint32(257) + raw[2:]) * np.uint32(2654435761))[own]
    mixed = code * (2 * _ranges(size).astype(np.uint32) * np.uint32(40503) + np.uint32(1))
    whole = np.add.reduceat(mixed, np.cumsum(size) - size).astype(np.uint32) if words else np.zeros(0, np.uint32)
    return size, (code >> np.uint32(20)).astype(np.int32), (whole * np.uint32(2246822519) >> np.uint32(20)).astype(np.int32)


def windows_of(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, an index matrix of all windows (-1 beyond a text's end), and each window's text."""
    seen: dict[str, int] = {}
    flat = np.array([seen.setdefault(w, len(seen)) for t in texts for w in t], np.int32)
    return list(seen), *_windows(flat, np.array([len(t) for t in texts]))


def _windows(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, int)
    counts = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.full((len(owner), WINDOW), -1, np.int32)
    for i in range(0, len(owner), BLOCK):
        at, who = nth[i : i + BLOCK, None] * STRIDE + np.arange(WINDOW), owner[i : i + BLOCK]
        inside = at < sizes[who][:, None]
        out[i : i + BLOCK][inside] = flat[(at + begins[who][:, None])[inside]]
    return out, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) * 0.25 / np.sqrt(s[0] / 16)).astype(np.float32)
        self.p = {"words": init(BUCKETS, EMBED) * 2, "chars": init(BUCKETS, EMBED) * 4, "att": init(2 * HIDDEN, HIDDEN), "v": init(HIDDEN), "u": init(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"x" + d: init(2 * EMBED, 3 * HIDDEN), "h" + d: init(HIDDEN, 3 * HIDDEN), "i" + d: np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = np.float32(1), np.float32(0)

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (steps, windows, HIDDEN) of one direction; gates: (steps, windows, 3 HIDDEN)."""
        h, w = np.zeros((gates.shape[1], HIDDEN), np.float32), self.p["h" + d]
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        steps = range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1)
        for t in steps:
            g, rec, m = gates[t], h @ w, mask[t][:, None]
            zr = _sigmoid(g[:, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, rec[:, 2 * HIDDEN :], m))
            h = out[t] = new
        return out

    def _pool(self, both: np.ndarray, mask: np.ndarray) -> tuple:
        e = np.tanh(both @ self.p["att"])
        s = np.where(mask > 0, e @ self.p["v"], -30)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tw,twh->wh", a, both)
        return e, a, pooled, pooled @ self.p["u"] + self.p["c"]

    def logits(self, inputs: np.ndarray, index: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """One logit per row of ``index``, whose entries are rows of ``inputs`` or -1."""
        out, place = np.empty(len(index), np.float32), np.zeros(len(inputs) + 1, np.int32)
        for i in range(0, len(index), chunk):
            part = index[i : i + chunk].T
            mask = (part >= 0).astype(np.float32)
            met = np.zeros(len(place), bool)
            met[part] = True  # the last entry stands for -1
            used = np.flatnonzero(met[:-1])
            place[used], place[-1] = np.arange(len(used)), len(used)
            ready = {d: np.vstack([inputs[used] @ self.p["x" + d] + self.p["i" + d], self.p["i" + d][None]]) for d in "fb"}
            part = place[part]
            states = [self._run(ready[d][part], mask, d, None) for d in "fb"]
            out[i : i + chunk] = self._pool(np.concatenate(states, 2), mask)[3]
        return out

    def gradients(self, vocabulary: Vocabulary, index: np.ndarray, want: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        inputs = vocabulary.inputs(self)
        part, g = index.T, {k: np.zeros_like(v) for k, v in self.p.items()}
        mask, x = (part >= 0).astype(np.float32), np.vstack([inputs, np.zeros((1, 2 * EMBED), np.float32)])[part]
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(x @ self.p["x" + d] + self.p["i" + d], mask, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], 2)
        e, a, pooled, logit = self._pool(both, mask)
        p = _sigmoid(logit)
        loss = float((-weight * np.log(np.where(want > 0, p, 1 - p) + 1e-7)).mean())
        dl = (weight * (p - want) / len(want)).astype(np.float32)
        g["u"], g["c"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * self.p["u"]
        da = np.einsum("wh,twh->tw", dpool, both)
        ds = a * (da - (a * da).sum(0)) * mask
        g["v"] = np.einsum("tw,twh->h", ds, e)
        de = ds[..., None] * self.p["v"] * (1 - e * e)
        g["att"] = np.einsum("twi,twj->ij", both, de, optimize=True)
        dboth = a[..., None] * dpool + de @ self.p["att"].T
        dx = np.zeros_like(x)
        for j, d in enumerate("fb"):
            w, dh = self.p["h" + d], np.zeros((part.shape[1], HIDDEN), np.float32)
            for t, h, z, r, n, rec, m in reversed(kept[d]):
                dh = dh + dboth[t][:, j * HIDDEN : (j + 1) * HIDDEN]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (h - n) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                drec = np.concatenate([dz, dr, dn * r], 1)
                dg = np.concatenate([dz, dr, dn], 1)
                g["h" + d] += h.T @ drec
                g["x" + d] += x[t].T @ dg
                g["i" + d] += dg.sum(0)
                dx[t] += dg @ self.p["x" + d].T
                dh = dh * (1 - m * (1 - z)) + drec @ w.T
        per_word = _summed(part.ravel() + 1, dx.reshape(-1, 2 * EMBED), len(inputs) + 1)[1:]
        g["words"] = _summed(vocabulary.word, per_word[:, :EMBED], BUCKETS)
        share = per_word[:, EMBED:] / vocabulary.size[:, None]
        g["chars"] = _summed(vocabulary.grams, np.repeat(share, vocabulary.size, axis=0), BUCKETS)
        return g, loss

    def score(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(self.scale * logit + self.shift, -30, 30))


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values that fall on each row."""
    return np.stack([np.bincount(rows, v, minlength=size) for v in values.T], 1).astype(np.float32)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def text_logits(net: Network, texts: list[list[str]]) -> np.ndarray:
    """The highest window's logit of each text."""
    words, index, owner = windows_of(texts)
    logits = net.logits(Vocabulary(words).inputs(net), index)
    out = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(out, owner, logits)
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Labels, distinct words, the number of each text's words and all words by number, whatever the order in which the texts come."""
    seen: dict[str, int] = {}
    rows = []
    for b in batches:
        for toxic, id_, text in zip(b.column("toxic"), b.column("id"), b.column("text"), strict=True):
            text = text.as_py()
            own = np.array([seen.setdefault(w, len(seen)) for w in words_of(text)], np.int32)
            rows.append((toxic.as_py(), id_.as_py(), hashlib.sha256(text.encode()).digest(), own))
    rows.sort(key=lambda r: r[:3])
    flat = np.concatenate([r[3] for r in rows])
    first = np.full(len(seen), len(flat))
    np.minimum.at(first, flat, np.arange(len(flat)))
    order, known = np.argsort(first), list(seen)  # words are numbered as they are met in the sorted texts
    number = np.empty(len(seen), np.int32)
    number[order] = np.arange(len(seen))
    return np.array([r[0] for r in rows]), [known[w] for w in order], np.array([len(r[3]) for r in rows]), number[flat]


def _part(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One fit on the sample: without fold ``key``, with the highest logit of each text in it, or on all for ``FOLDS``."""
    part = key[0].as_py()
    toxic, words, sizes, flat = _words(batches)
    index, owner = _windows(flat, sizes)
    del flat
    pa.default_memory_pool().release_unused()  # of the texts
    fold, top = np.zeros(len(toxic), int), np.full(len(toxic), -np.inf)
    for label in (0, 1):
        fold[toxic == label] = np.arange((toxic == label).sum()) % FOLDS
    held = fold == part if part < FOLDS else np.ones(len(toxic), bool)
    used = ~held if part < FOLDS else held
    if len(set(toxic[used])) < 2:
        return
    net = _fitted(words, index[used[owner]], owner[used[owner]], toxic, *((200,) if part < FOLDS else ()), seed=3 + (part + 1) % (FOLDS + 1))
    np.maximum.at(top, owner[held[owner]], net.logits(Vocabulary(words).inputs(net), index[held[owner]]))
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "network": [pickle.dumps(net)], "fold": pa.array([fold[held]], pa.list_(pa.int32())), "toxic": pa.array([toxic[held]], pa.list_(pa.int32())), "top": pa.array([top[held]], pa.list_(pa.float64()))})


def _fitted(words: list[str], index: np.ndarray, owner: np.ndarray, toxic: np.ndarray, steps: int = 600, batch: int = 96, rate: float = 0.01, drop: float = 0.15, decay: float = 0.02, seed: int = 3) -> Network:
    """Multiple-instance training: at first some windows of each text have its label, then its highest ones."""
    net, r = Network(), np.random.default_rng(seed)
    texts, owner = np.unique(owner, return_inverse=True)
    toxic = toxic[texts]
    vocabulary = Vocabulary(words)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    weight_of = np.where(toxic > 0, len(toxic) / (2 * max(1, toxic.sum())), len(toxic) / (2 * max(1, (1 - toxic).sum()))).astype(np.float32)
    starts = np.searchsorted(owner, np.arange(len(texts)))
    step, rounds = 0, 12
    for n in range(rounds):
        if n < rounds // 2:
            order = np.lexsort((r.random(len(owner)), owner))
            most = 8
        else:
            order = np.lexsort((-net.logits(vocabulary.inputs(net), index), owner))
            most = 2
        rank = np.empty(len(owner), int)
        rank[order] = np.arange(len(owner)) - starts[owner[order]]
        chosen = np.flatnonzero(rank < most)
        passes = max(1, -(-steps * batch // (rounds * len(chosen))))
        chosen = np.concatenate([r.permutation(chosen) for _ in range(passes)])[: max(steps * batch // rounds, min(len(chosen), 2 * steps * batch // rounds))]
        for i in range(0, len(chosen), batch):
            rows = chosen[i : i + batch]
            used, local = np.unique(index[rows], return_inverse=True)
            local = local.reshape(len(rows), WINDOW).astype(np.int32)
            if used[0] == -1:
                used, local = used[1:], local - 1
            local = np.where(r.random(local.shape) < drop, -1, local)
            some = Vocabulary([words[w] for w in used])
            who = owner[rows]
            g, _ = net.gradients(some, local, toxic[who].astype(np.float32), weight_of[who])
            step += 1
            pace = rate * min(1, step / 20) * (0.3 if n >= rounds * 3 // 4 else 1)
            for k, v in net.p.items():
                a, b = moments[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                v *= 1 - pace * decay * (k in ("words", "chars"))
                v -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _best_cut(top: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit with the best weighted F1, amid the range of those as good."""
    order = np.argsort(-top, kind="stable")
    hit, false = np.cumsum((weight * toxic)[order]), np.cumsum((weight * (1 - toxic))[order])
    last = np.append(np.diff(top[order]) != 0, True)  # a cut lies between different logits
    f1 = np.where(last, 2 * hit / (hit + false + (weight * toxic).sum()), -1)
    at = int(np.argmax(f1))
    return float(top[order[at]] + top[order[min(at + 1, len(top) - 1)]]) / 2


def _calibrate(net: Network, top: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
    """Scale of the highest window's logit, by damped Newton steps of a logistic fit; the shift puts the best cut at ``CUT``."""
    x = np.stack([top, np.ones_like(top)], 1)
    beta = np.array([0.5, 0.0])
    for _ in range(50):
        p = _sigmoid(np.clip(x @ beta, -30, 30))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-3)[:, None]).T @ x + np.diag([1.0, 0.05]), x.T @ (toxic - p) - np.array([1.0, 0.05]) * beta)
        beta += step / max(1.0, np.abs(step).max())
    net.scale = np.float32(max(beta[0], 0.05))
    net.shift = np.float32(np.log(CUT / (1 - CUT)) - net.scale * _best_cut(top, toxic, weight))


def sample(labels: DataFrame, per_class: int) -> DataFrame:
    """``id, toxic``: at most ``per_class`` labels of each class, those with the smallest identifier hash."""
    known = labels.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    one = lambda c: known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
    return one(0).unionByName(one(1))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_bytes: int = 48_000_000) -> Network | None:
    """Fits on the documents of a sample of ``labels(doc_id, toxic)``, toxic being 0 or 1.

    At most ``per_class`` labels of each class, and of their texts as many as ``most_bytes`` hold, in the order of hashes.
    The network and those without a fold are fitted side by side in tasks; the driver sees no text.
    """
    chosen = F.broadcast(sample(labels, per_class))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id"))
    before = Window.orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, 0)  # over the sample alone
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("bytes", F.sum(F.octet_length("text")).over(before))
    rows = staged(rows.filter(F.col("bytes") <= most_bytes).select("toxic", "id", "text"), "toxicity-sample")
    counts = dict(labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("toxic").cast("int")).count().collect())
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).groupBy("part")
    fits = {r["part"]: r for r in parts.applyInArrow(_part, "part int, network binary, fold array<int>, toxic array<int>, top array<double>").collect()}
    if FOLDS not in fits:
        return None
    net, whole = pickle.loads(fits[FOLDS]["network"]), fits[FOLDS]
    apart = [(t, x) for f in range(FOLDS) if f in fits for t, x in zip(fits[f]["toxic"], fits[f]["top"], strict=True)]
    apart += [(t, x) for f, t, x in zip(whole["fold"], whole["toxic"], whole["top"], strict=True) if f not in fits]  # too few to fit without them
    toxic, top = np.array([t for t, _ in apart]), np.array([x for _, x in apart])
    _calibrate(net, top, toxic, np.array([counts[0], counts[1]])[toxic] / np.bincount(toxic)[toxic])
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, score`` per document, over all windows of the whole text."""
    return score_rows(docs.select("doc_id", "text"), net).select("doc_id", F.col("toxicity").alias("score"))


def score_rows(docs: DataFrame, net: Network | None, name: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each row's ``text`` in a column of this name, which they must not have yet."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already")
    return docs.withColumn(name, scorer(docs.sparkSession, net)("text"))


def scorer(spark: SparkSession, net: Network | None, most_bytes: int = 1_000_000) -> Callable[[str], Column]:
    """A function of a column of texts that gives their scores; texts of ``most_bytes`` are scored at once, or a longer one."""
    shared = spark.sparkContext.broadcast(net)  # about 0.6 MB, fixed by BUCKETS, EMBED and HIDDEN

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for b in batches:
            out, i = np.zeros(len(b)), 0
            sizes = pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False)
            while i < len(b) and net is not None:
                j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), most_bytes)))
                out[i:j] = net.score(text_logits(net, [words_of(t) for t in b.slice(i, j - i).to_pylist()]))
                i = j
            yield pa.array(out)
            pa.default_memory_pool().release_unused()  # else each worker keeps the largest batches that it met

    return run
