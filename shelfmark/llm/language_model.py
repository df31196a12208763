"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is lower-cased (A-Z) and read as its words joined by single blanks and closed by one line feed. Symbols are bytes;
contexts are the up to ``DEPTH`` bytes before a symbol. A context stays in the tree if its next-symbol distribution
diverges from that of its next shorter suffix: twice the count times the Kullback-Leibler divergence must reach
``least_gain``; no gram is left out for being rare. Distributions are smoothed by mixing with the suffix's distribution,
weighted by the number of distinct followers, down to the uniform one. Scoring takes, at each symbol, the longest suffix
that is a state.

1. The texts are cut into chunks, each staged as one compressed row with its distinct words (as 64-bit hashes) and grams,
   and how often the training documents among them have each. All that follows works on these rows, so that a lost
   executor's work is done again from the same chunks.
2. Words fall into buckets by their hash, grams by the last two bytes of their context. Grams of one bucket share all
   suffixes longer than one byte, so the tree falls into independent parts. The counts of a bucket are merged, first over
   groups of chunks, then in all; the tree grows with the input and is never in one place.
3. Each bucket's counts, or its part of the tree (with the counts of the one- and two-byte grams, at most 65,536), meet
   the distinct words or grams of the chunks; large buckets are met by several tasks. Only counts and scores travel back
   to the chunks, where they are summed for each document.

Defined results: null and empty texts are the line feed alone; without training rows the tree is uniform; repeated rows
are scored alike; a null identifier is held out of no fold and trains; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.rolling import folded, word_hashes
from shelfmark.scratch import staged

DEPTH = 5
#: Weight of the shorter suffix's distribution, for each distinct follower.
PRIOR = 3.0
END = b"\n"
#: The closing token's place among the hashes of words.
_END_HASH = np.uint64(0x5DEECE66D1234567)
#: Bytes of text in a chunk, and at a time in work on one.
CHUNK, PART = 16_000_000, 1_000_000
#: Distinct words or grams of chunks that one task meets with a bucket.
MEET = 500_000
TEXTS, WORDS, GRAMS = 0, 1, 2
_WORD_BITS = 10


def stream_of(text: str | None) -> bytes:
    """Words between white space of ``[\\x20\\x09-\\x0D]``, lower-cased and joined by single blanks, and the closing line feed."""
    raw = folded(text).strip(b" ")
    return (b" ".join(raw.split()) if b"  " in raw else raw) + END


def grams_of(texts: list[bytes], length: int = DEPTH + 1) -> np.ndarray:
    """The code of the last ``length`` bytes up to each byte of each text, that byte in the lowest; before a text all is 0."""
    raw = np.frombuffer(b"".join(bytes(DEPTH) + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.zeros(len(raw), np.uint64)
    for k in range(length):
        code[k:] |= raw[: len(raw) - k].astype(np.uint64) << np.uint64(8 * k)
    symbol = np.ones(len(raw), bool)
    at = np.cumsum(sizes + DEPTH) - sizes
    for k in range(1, DEPTH + 1):
        symbol[at - k] = False
    return code[symbol]


def _parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In runs of about ``PART`` bytes: the gram codes of the texts, which texts, and how many codes each has there."""
    own, who, size = [], [], 0
    for i, t in enumerate(texts):
        if own and size + len(t) > PART:
            yield grams_of(own), np.array(who), np.array([len(x) for x in own])
            own, who, size = [], [], 0
        if len(t) > 2 * PART:
            for a in range(0, len(t), PART):  # cut with the bytes before as context
                lead = t[max(0, a - DEPTH) : a]
                codes = grams_of([lead + t[a : a + PART]])[len(lead) :]
                yield codes, np.array([i]), np.array([len(codes)])
        else:
            own.append(t)
            who.append(i)
            size += len(t)
    if own:
        yield grams_of(own), np.array(who), np.array([len(x) for x in own])


def turned(codes: np.ndarray) -> np.ndarray:
    """Codes with the last two bytes of the context on top, so that sorted ones lie bucket by bucket."""
    last = (codes >> np.uint64(8)) & np.uint64(65535)
    return (last << np.uint64(32)) | ((codes >> np.uint64(24)) << np.uint64(8)) | (codes & np.uint64(255))


def unturned(keys: np.ndarray) -> np.ndarray:
    far = (keys >> np.uint64(8)) & np.uint64(0xFFFFFF)
    return (far << np.uint64(24)) | ((keys >> np.uint64(32)) << np.uint64(8)) | (keys & np.uint64(255))


class Table:
    """A hash table from 64-bit codes to numbers, probed in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, np.uint64(2**64 - 1)), np.zeros(size, values.dtype)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[free], return_index=True)
            rows = left[free][first]
            self.keys[slots], self.values[slots] = keys[rows], values[rows]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left, at = left[stay], (at[stay] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where a key is missing."""
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], self.values.dtype.type(np.nan))
        left = np.flatnonzero((got != keys) & (got != np.uint64(2**64 - 1)))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            got, want = self.keys[at], keys[left]
            hit = got == want
            out[left[hit]] = self.values[at[hit]]
            stay = ~hit & (got != np.uint64(2**64 - 1))
            left, at = left[stay], at[stay]
        return out


class Tree:
    """Built from the counts of all grams of each length (symbol in the lowest byte)."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], least_gain: float, least_count: int) -> None:
        self.root = np.full(256, np.log10(1 / 256), np.float32)
        self.symbols: list[Table] = []
        self.states: list[Table] = []
        self.sizes: list[int] = []
        for depth, (codes, counts) in enumerate(levels):
            if depth == 0:
                total, kinds = counts.sum(), len(codes)
                p = np.full(256, kinds / 256.0)
                p[codes.astype(int)] += counts
                self.root = np.log10(p / max(total + kinds, 1e-9)).astype(np.float32) if kinds else self.root
                continue
            context = codes >> np.uint64(8)
            order = np.argsort(context, kind="stable")
            codes, counts, context = codes[order], counts[order].astype(float), context[order]
            starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, int)
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
            total = np.add.reduceat(counts, starts) if len(starts) else np.zeros(0)
            kinds = np.bincount(which, minlength=len(starts)).astype(float)
            short = 10.0 ** self.log10(codes & np.uint64((1 << (8 * depth)) - 1), depth)
            share = (counts + PRIOR * kinds[which] * short) / (total + PRIOR * kinds)[which]
            gain = 2 * np.bincount(which, counts * np.log(share / short), minlength=len(starts))
            keep = (gain >= least_gain) & (total >= least_count)
            self.symbols.append(Table(codes[keep[which]], np.log10(share[keep[which]]).astype(np.float32)))
            self.states.append(Table(context[starts][keep], np.log10(PRIOR * kinds / (total + PRIOR * kinds))[keep].astype(np.float32)))
            self.sizes.append(int(keep.sum()))
        known = np.unique(levels[DEPTH][0] >> np.uint64(8))
        depth_of = np.zeros(len(known), np.float32)
        for depth in range(1, DEPTH + 1):
            found = ~np.isnan(self.states[depth - 1].find(known & np.uint64((1 << (8 * depth)) - 1)))
            depth_of[found] = depth
        self.longest = Table(known, depth_of)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each symbol after its longest suffix; for contexts seen in training that is one look-up."""
        depth, out = self.longest.find(codes >> np.uint64(8)), np.empty(len(codes))
        for d in range(DEPTH + 1):
            rows = np.flatnonzero(depth == d)
            out[rows] = self.log10(codes[rows], d + 1)
        rows = np.flatnonzero(np.isnan(depth))
        out[rows] = self.log10(codes[rows])
        return out

    def log10(self, codes: np.ndarray, length: int | None = None) -> np.ndarray:
        """Log probability of the lowest byte after the bytes above it, of which the ``length - 1`` nearest count."""
        out, left = np.zeros(len(codes), np.float64), np.arange(len(codes))
        for depth in range((length or DEPTH + 1) - 1, 0, -1):
            if not len(left):
                return out
            mask = np.uint64((1 << (8 * (depth + 1))) - 1)
            own = codes[left] & mask
            p = self.symbols[depth - 1].find(own)
            hit = ~np.isnan(p)
            out[left[hit]] += p[hit]
            left, own = left[~hit], own[~hit]
            out[left] += np.nan_to_num(self.states[depth - 1].find(own >> np.uint64(8)))
        out[left] += self.root[(codes[left] & np.uint64(255)).astype(int)]
        return out


def _levels(codes: np.ndarray, n: np.ndarray, first: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The grams of every length with their counts; ``first`` are the shortest ones, counted elsewhere."""
    out = list(first)
    for depth in range(len(first), DEPTH + 1):
        level, at = np.unique(codes & np.uint64((1 << (8 * (depth + 1))) - 1), return_inverse=True)
        known = (level >> np.uint64(8 * depth)) > 0 if depth else np.ones(len(level), bool)  # else the text had begun: such contexts are shorter ones
        out.append((level[known], np.bincount(at, n, len(level)).astype(np.int64)[known]))
    return out


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[new], np.add.reduceat(n[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)


def _distinct(*parts: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))]


def _words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the streams, and how many each has, the closing token left out."""
    found = list(word_hashes([t[:-1] for t in texts]))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *(h for h, _ in found)]), np.concatenate([none.astype(np.int64), *(n for _, n in found)])


def _counted(texts: list[bytes], weight: int) -> tuple[tuple, tuple]:
    """Distinct words and turned grams with their counts times ``weight``."""
    key, n = np.unique(_words_in(texts)[0], return_counts=True)
    if texts:
        key, n = merged([key, np.array([_END_HASH])], [n, np.array([len(texts)])])
    grams, held = [], 0
    for codes, _, _ in _parts(texts):
        grams.append(np.unique(turned(codes), return_counts=True))
        held += len(grams[-1][0])
        if held > PART:  # most are met again: merging now keeps memory small
            grams = [merged([k for k, _ in grams], [c for _, c in grams])]
            held = 0
    gram, m = merged([k for k, _ in grams], [c for _, c in grams])
    return (key, n * weight), (gram, m * weight)


_ROWS = {"chunk": pa.int64(), "kind": pa.int32(), "bucket": pa.int64(), "ids": pa.list_(pa.int64()), "keys": pa.binary(), "counts": pa.binary()}


def chunks(docs: DataFrame) -> DataFrame:
    """``chunk, kind, bucket, ids, keys, counts`` from ``doc_id, text, trains``.

    One row of ``TEXTS`` for each chunk: its doc_ids, compressed streams and their sizes. Rows of ``WORDS`` (hashes) and
    ``GRAMS`` (the lower halves of turned codes): the sorted keys of a bucket, and their counts in training texts.
    """

    def rows(chunk: int, ids: list, texts: list[bytes], trains: list[bool]) -> pa.RecordBatch:
        out = [(chunk, TEXTS, 0, ids, zstandard.ZstdCompressor(level=1).compress(b"".join(texts)), np.array([len(t) for t in texts], "<i8").tobytes())]
        parts = [_counted([t for t, own in zip(texts, trains, strict=True) if own == flag], flag) for flag in (1, 0)]
        for kind, shift, width in ((WORDS, 64 - _WORD_BITS, "<u8"), (GRAMS, 32, "<u4")):
            own = [p[kind - 1] for p in parts]
            key, n = merged([k for k, _ in own], [c for _, c in own])
            bucket = key >> np.uint64(shift)
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                out.append((chunk, kind, int(bucket[a]), None, key[a:z].astype(width).tobytes(), n[a:z].astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ROWS.values(), strict=True)], list(_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, texts, trains, held = [], [], [], 0
        for b in batches:
            for i in range(0, b.num_rows, 200):
                some = b.slice(i, 200)
                ids += some.column("doc_id").to_pylist()
                trains += [int(bool(t)) for t in some.column("trains").to_pylist()]
                new = [stream_of(t) for t in some.column("text").to_pylist()]
                texts += new
                held += sum(map(len, new))
                if held > CHUNK:
                    yield rows(chunk, ids, texts, trains)
                    ids, texts, trains, held, chunk = [], [], [], 0, chunk + 1
        if texts:
            yield rows(chunk, ids, texts, trains)

    schema = "chunk long, kind int, bucket long, ids array<long>, keys binary, counts binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "trains").mapInArrow(run, schema)


def _keys(rows: pa.Table) -> list[np.ndarray]:
    """Of each row of ``chunks``, as 64-bit numbers."""
    out = []
    for kind, bucket, raw in zip(rows["kind"].to_pylist(), rows["bucket"].to_pylist(), rows["keys"].to_pylist(), strict=True):
        out.append(np.frombuffer(raw, "<u8") if kind == WORDS else np.frombuffer(raw, "<u4").astype(np.uint64) | np.uint64(bucket << 32))
    return out


def _blobs(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def parted(rows: DataFrame) -> DataFrame:
    """Adds ``part`` and ``salt, salts``: small buckets share a part, a large one is met by several tasks, chunk by chunk."""
    sizes = rows.groupBy("kind", "bucket").agg(F.sum(F.octet_length("counts") / 4).alias("n")).collect()  # at most 65,536 and 1,024 rows
    plan, held, part, last = [], 0, 0, None
    for kind, bucket, n in sorted(map(tuple, sizes)):
        if kind != last or held + n > MEET:
            part, held = part + 1, 0
        held, last = held + n, kind
        plan.append((kind, bucket, part, max(1, round(n / MEET))))
    plan = rows.sparkSession.createDataFrame(plan, "kind int, bucket long, part int, salts int")
    salts = plan.groupBy("part").agg(F.max("salts").alias("salts"))
    plan = plan.drop("salts").join(salts, "part")
    return rows.join(F.broadcast(plan), ["kind", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("chunk"), F.col("salts")).cast("int"))


def totals(rows: DataFrame) -> DataFrame:
    """``kind, part, salts, keys, counts, n, distinct, pairs`` over all chunks; what only untrained texts have is left out."""

    def first(rows: pa.Table) -> pa.Table:
        return merge(rows, _keys(rows), _blobs(rows["counts"], "<u4"))

    def second(rows: pa.Table) -> pa.Table:
        return merge(rows, _blobs(rows["keys"], "<u8"), _blobs(rows["counts"], "<i8"))

    def merge(rows: pa.Table, keys: list, counts: list) -> pa.Table:
        key, n = merged(keys, counts)
        key, n = key[n > 0], n[n > 0]
        pairs = []
        if (kind := rows["kind"][0].as_py()) == GRAMS:
            code, m = merged([unturned(key) & np.uint64(65535)], [n])
            pairs = list(zip(code.tolist(), m.tolist(), strict=True))
        one = [[kind], [rows["part"][0].as_py()], [rows["salts"][0].as_py()], [key.astype("<u8").tobytes()], [n.astype("<i8").tobytes()], [int(n.sum())], [len(n)], [[{"code": c, "n": m} for c, m in pairs]]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(one, kinds.values(), strict=True)], list(kinds))

    pair = pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())]))
    kinds = {"kind": pa.int32(), "part": pa.int32(), "salts": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "n": pa.int64(), "distinct": pa.int64(), "pairs": pair}
    schema = "kind int, part int, salts int, keys binary, counts binary, n long, distinct long, pairs array<struct<code: bigint, n: bigint>>"
    rows = rows.select("kind", "bucket", "part", "salt", "salts", "keys", "counts")
    return rows.groupBy("part", "salt").applyInArrow(first, schema).groupBy("part").applyInArrow(second, schema)


def values(rows: DataFrame, total: DataFrame, pairs: list, least_gain: float) -> DataFrame:
    """``chunk, kind, bucket, found`` for each row of words or grams: the total counts or the log probabilities of its keys."""
    code, n = np.array([c for c, _ in pairs], np.uint64), np.array([m for _, m in pairs], np.int64)
    single, at = np.unique(code & np.uint64(255), return_inverse=True)
    order = np.argsort(code)
    order = order[code[order] > 255]
    first = [(single, np.bincount(at, n, len(single)).astype(np.int64)), (code[order], n[order])]

    def run(wanted: pa.Table, total: pa.Table) -> pa.Table:
        keys = _keys(wanted)
        out = []
        if keys:
            known, n = merged(_blobs(total["keys"], "<u8"), _blobs(total["counts"], "<i8"))
            if wanted["kind"][0].as_py() == WORDS:
                known, n = np.append(known, np.uint64(2**64 - 1)), np.append(n, 0)
                for k in keys:
                    at = np.searchsorted(known, k)
                    out.append(np.where(known[at] == k, n[at], 0).astype("<i8").tobytes())
            else:
                codes = unturned(known)
                order = np.argsort(codes)
                tree = Tree(_levels(codes[order], n[order], first), least_gain, 1)
                i = 0
                while i < len(keys):  # many short rows at a time
                    j, size = i, 0
                    while j < len(keys) and (j == i or size + len(keys[j]) < MEET):
                        size, j = size + len(keys[j]), j + 1
                    scores = tree.score(unturned(np.concatenate(keys[i:j]))).astype("<f4")
                    out += [s.tobytes() for s in np.split(scores, np.cumsum([len(k) for k in keys[i:j]])[:-1])]
                    i = j
        return wanted.select(["chunk", "kind", "bucket"]).append_column("found", pa.array(out, pa.binary()))

    spread = total.select("part", "keys", "counts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = rows.select("chunk", "kind", "bucket", "part", "salt", "keys")
    return rows.groupBy("part", "salt").cogroup(spread.groupBy("part", "salt")).applyInArrow(run, "chunk long, kind int, bucket long, found binary")


def score(docs: DataFrame, trains: Column, least_gain: float = 20.0) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every document; those for which ``trains`` holds are learned from."""
    found = staged(chunks(docs.select("doc_id", "text", trains.alias("trains"))), "chunks")
    rows = parted(found.filter(F.col("kind") != TEXTS))
    total = staged(totals(rows), "totals")
    words = total.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)))
    n_all, distinct = words.first()
    pairs = total.select(F.explode("pairs").alias("p")).groupBy("p.code").agg(F.sum("p.n").alias("n")).collect()  # at most 65,536 rows
    looked_up = values(rows, total, [tuple(p) for p in pairs], least_gain)

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        lines = defaultdict(list)
        for kind, bucket, raw in zip(found["kind"].to_pylist(), found["bucket"].to_pylist(), found["found"].to_pylist(), strict=True):
            lines[kind].append((bucket, raw))
        line = lambda kind, dtype: np.frombuffer(b"".join(raw for _, raw in sorted(lines[kind])), dtype)  # noqa: E731  in the order of sorted keys
        ids, tokens, known, base, scores = [], [], [], [], []
        for doc_ids, blob, sizes in zip(own["ids"].to_pylist(), own["keys"].to_pylist(), own["counts"].to_pylist(), strict=True):
            raw, ends = zstandard.ZstdDecompressor().decompress(blob), np.cumsum(np.frombuffer(sizes, "<i8"))
            texts = [raw[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            hashes, counts = _words_in(texts)
            c = Table(_distinct(hashes, np.array([_END_HASH])), line(WORDS, "<i8").astype(np.float64)).find(np.insert(hashes, np.cumsum(counts), _END_HASH))
            starts = np.cumsum(counts + 1) - counts - 1
            tokens.append(counts + 1)
            known.append(np.add.reduceat((c > 0).astype(np.int64), starts))
            base.append(np.add.reduceat(np.log10(c + 1) - np.log10(n_all + distinct + 1), starts))
            grams = _distinct(*(_distinct(turned(codes)) for codes, _, _ in _parts(texts)))
            p, own_score = Table(grams, line(GRAMS, "<f4")), np.zeros(len(texts))
            for codes, who, size in _parts(texts):
                own_score[who] += np.add.reduceat(p.find(turned(codes)).astype(np.float64), np.cumsum(size) - size)
            scores.append(own_score)
            ids += doc_ids
        columns = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x) if x else []) for x in (tokens, known, base, scores))]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    texts = found.filter(F.col("kind") == TEXTS).select("chunk", "ids", "keys", "counts")
    scored = texts.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(run, schema)
    return scored.withColumn("train_tokens", F.lit(int(n_all)).cast("long"))
