"""Removal of repeated substrings by prefix-free parsing (after Boucher et al., 2019).

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (in an earlier row by doc_id, or earlier in
the same row) is removed; strings are judged on the input and never cross documents.

1. Parse. A rolling hash of ``GRAM`` bytes triggers where it is the least of some string of ``LENGTH`` bytes. Every such
   string has exactly one trigger, its leftmost least gram, and equal strings have the same one at the same offset. The
   phrase of a trigger is what its strings cover, so phrases overlap and none needs its neighbours to be compared.
2. Dictionary. Equal phrases collapse to one entry, first inside each task, then in sorted ranges of the corpus; every
   later occurrence in the parse repeats its whole phrase. Only entries that share a trigger with others go on.
3. Suffix arrays. What follows a trigger in its entries is sorted forwards and what precedes it backwards, to a depth of
   ``LENGTH`` bytes, with the common prefixes of neighbours. A string that starts ``s`` bytes before its trigger is thus
   a class of endings of ``s`` bytes, from the dictionary's array, combined with a class of continuations of
   ``LENGTH - s`` bytes, from the parse's: its place in the order of all suffixes of the corpus to that depth. In each
   place all but the earliest are repeats. These are comparisons of bytes, not of hashes.

The arrays are built for whole triggers, many of them in a task. A trigger of more than ``UNIT`` entries is divided: into the
strings that start in the farther half of the places before it and those that start in the nearer half. The former also
share the bytes of the nearer half that precede it, the latter more of those that follow, so either half falls into units
of equal such bytes, and entries alone in a unit have no repeats there. Halves that are still too large are divided
again, down to single strings, of which the earliest is a minimum over the cluster. Units gather entries by 64-bit hashes;
what repeats in them is settled by bytes.

Dictionary entries are equal by 64-bit hashes of the trigger and of the phrase.

Each row is a document of its own. Where all identifiers differ they are its number; else the rows are numbered in their
order and staged with their texts, at the price of one sort of the texts. The result is the same.

Defined results: null and empty texts have no bytes; rows with one doc_id are ordered by the SHA-256 of their texts; a
null doc_id comes after all others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.rolling import Hashed, mix
from shelfmark.scratch import staged

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
#: Entries that are compared in one go.
UNIT = 10_000


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def triggers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each gram that is the leftmost least of some strings of ``LENGTH`` bytes, and the first and last start of these."""
    place = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = (_sliding(place, REACH + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))  # it only moves to the right
    return least[first], first, np.append(first[1:], len(least)) - 1


def parse(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger hash, phrase hash and packed place (position, reach to the left and right) of each phrase."""
    raw = np.frombuffer(text, np.uint8)
    h = Hashed(raw)
    grams = h.all(GRAM)
    at, start, last = triggers(grams)
    end = last + LENGTH
    left, right = (at - start).astype(np.uint64), (end - at).astype(np.uint64)
    phrase = mix(h.of(start, end) + left * np.uint64(1000003) + right * np.uint64(7919))
    return grams[at], phrase, (at << 16) | ((at - start) << 8) | (end - at)


def _spans(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = place >> 16
    return at - ((place >> 8) & 255), at + (place & 255)


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the same positions."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]


def _phrases(docs: DataFrame) -> DataFrame:
    """First occurrences within each task, ``trigger`` null for what is a repeat already: ``trigger, phrase, doc, place, hi``."""

    def settle(parts: list) -> Iterator[pd.DataFrame]:
        if not parts:
            return
        trigger, phrase, place, doc = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((place, doc, phrase, trigger))
        trigger, phrase, place, doc = trigger[order], phrase[order], place[order], doc[order]
        new = np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (doc != doc[head]) | (place != place[head])
        first = pd.DataFrame({"trigger": trigger[new].astype(np.int64), "phrase": phrase[new].astype(np.int64), "doc": doc[new], "place": place[new], "hi": np.int64(0)})
        yield first.astype({"trigger": "Int64"})
        lo, hi = _spans(place[again])
        own = doc[again]
        order = np.lexsort((lo, own))
        own, lo, hi = own[order], lo[order], hi[order]
        for some in np.split(np.arange(len(own)), np.flatnonzero(own[1:] != own[:-1]) + 1) if len(own) else []:
            a, b = union(lo[some], hi[some])
            yield pd.DataFrame({"trigger": pd.array([None] * len(a), "Int64"), "phrase": np.int64(0), "doc": own[some[0]], "place": a, "hi": b})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for b in batches:
            for doc, text in zip(b["doc"], b["text"], strict=True):
                raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
                if len(raw) < LENGTH:
                    continue
                trigger, phrase, place = parse(raw)
                parts.append((trigger, phrase, place, np.full(len(place), doc, np.int64)))
                held += len(place)
            if held > 4_000_000:
                yield from settle(parts)
                parts, held = [], 0
        yield from settle(parts)

    return docs.mapInPandas(run, "trigger long, phrase long, doc long, place long, hi long")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted phrases' bytes: ``trigger, doc, place, bytes``."""
    per = wanted.groupBy("doc").agg(F.collect_list(F.struct("trigger", "place")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, found in zip(b["doc"], b["text"], b["wanted"], strict=True):
                raw = text.encode("utf-8", "replace")
                for f in found:
                    at, left, right = f["place"] >> 16, (f["place"] >> 8) & 255, f["place"] & 255
                    out.append((f["trigger"], doc, f["place"], raw[at - left : at + right]))
            yield pd.DataFrame(out, columns=["trigger", "doc", "place", "bytes"])

    return docs.join(per, "doc").select("doc", "text", "wanted").mapInPandas(run, "trigger long, doc long, place long, bytes binary")


def _dictionary(parsed: DataFrame) -> DataFrame:
    """``trigger, doc, place, again``: later occurrences of phrases, and first ones whose trigger others may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            trigger, phrase = b.column("trigger").to_numpy(), b.column("phrase").to_numpy()
            step = trigger[1:] != trigger[:-1]
            again = np.concatenate(([last == (trigger[0], phrase[0])], ~step & (phrase[1:] == phrase[:-1])))
            last = trigger[-1], phrase[-1]
            starts = np.flatnonzero(np.concatenate(([True], step)))
            sizes = np.diff(np.append(starts, len(trigger)))
            several = phrase[starts] != phrase[starts + sizes - 1]
            several[[0, -1]] = True  # it may go on in another batch or range
            keep = pa.array(again | np.repeat(several, sizes))
            yield b.select(["trigger", "doc", "place"]).append_column("again", pa.array(again)).filter(keep)

    ranges = parsed.select("trigger", "phrase", "doc", "place").repartitionByRange("trigger", "phrase")
    return ranges.sortWithinPartitions("trigger", "phrase", "doc", "place").mapInArrow(run, "trigger long, doc long, place long, again boolean")


def suffix_array(strings: np.ndarray, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes within their triggers, and what each has in common with the one before, -1 with none."""
    padded = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    padded[:, : strings.shape[1]] = strings
    order = np.lexsort((*padded.view(">u8").astype(np.uint64).T[::-1], trigger))
    differ = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
    common[trigger[order[1:]] != trigger[order[:-1]]] = -1
    return order, np.append(-1, common)


def _classes(array: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """For each row the number of its class of those equal to ``depth`` bytes."""
    order, common = array
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def settled(b: pd.DataFrame) -> pd.DataFrame:
    """The ranges of repeats (``doc, lo, hi``) among the entries of some whole units, of strings that start ``start`` to ``stop - 1`` bytes before the trigger."""
    b = b.sort_values(["doc", "place"])
    n, doc, unit, place = len(b), b["doc"].to_numpy(np.int64), b["unit"].to_numpy(np.int64), b["place"].to_numpy(np.int64)
    start, stop = b["start"].to_numpy(np.int64), b["stop"].to_numpy(np.int64)
    at, left, right = place >> 16, (place >> 8) & 255, place & 255
    raw = np.frombuffer(b"".join(b["bytes"]), np.uint8)
    middle = np.cumsum(left + right) - right
    step = np.arange(LENGTH)
    after = np.where(step < right[:, None], raw[np.minimum(middle[:, None] + step, len(raw) - 1)], 0).astype(np.uint8)
    before = np.where(step[:REACH] < left[:, None], raw[np.maximum(middle[:, None] - 1 - step[:REACH], 0)], 0).astype(np.uint8)
    forwards, backwards = suffix_array(after, unit), suffix_array(before, unit)
    low, high = np.full(n, -1), np.full(n, -1)
    for s in range(int(start.min()), int(stop.max())):
        rows = np.flatnonzero((left >= s) & (right >= LENGTH - s) & (start <= s) & (s < stop))
        suffix = _classes(forwards, LENGTH - s)[rows] * (n + 1) + _classes(backwards, s)[rows]
        again = np.ones(len(rows), bool)
        again[np.unique(suffix, return_index=True)[1]] = False  # rows are in the order of the parse
        again = rows[again]
        low[again] = np.where(low[again] < 0, s, low[again])
        high[again] = s
    again = np.flatnonzero(high >= 0)
    return pd.DataFrame({"doc": doc[again], "lo": (at - high)[again], "hi": (at - low)[again] + LENGTH})


def _halves(rows: DataFrame) -> DataFrame:
    """The entries of units that are too large, in units of either half of their strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for start, stop, doc, place, raw in zip(b["start"], b["stop"], b["doc"], b["place"], b["bytes"], strict=True):
                left, right, middle = (place >> 8) & 255, place & 255, (start + stop) // 2
                for first, end in ((start, middle), (middle, stop)):
                    if left >= first and right > LENGTH - end:
                        shared = raw[left - first : left + LENGTH - end + 1]
                        out.append((xxhash.xxh3_64_intdigest(shared, first) - (1 << 63), first, end, doc, place, raw))
            yield pd.DataFrame(out, columns=["unit", "start", "stop", "doc", "place", "bytes"])

    return rows.select("start", "stop", "doc", "place", "bytes").mapInPandas(run, _UNITS)


_UNITS = "unit long, start long, stop long, doc long, place long, bytes binary"


def _settle(rows: DataFrame) -> DataFrame:
    """``doc, lo, hi``: what repeats in units of at most ``UNIT`` entries, each whole in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            whole = held["unit"].to_numpy() != held["unit"].iloc[-1] if len(held) else np.zeros(0, bool)
            if whole.any():
                yield settled(held[whole])
                held = held[~whole]  # it may go on in the next batch
        if held is not None and len(held):
            yield settled(held)

    return rows.repartition("unit").sortWithinPartitions("unit").mapInPandas(run, "doc long, lo long, hi long")


def _equal(rows: DataFrame) -> DataFrame:
    """``doc, lo, hi``: all but the earliest of each string, in units of one start."""
    at, left = F.expr("place >> 16"), F.expr("(place >> 8) & 255")
    string = F.col("bytes").substr((left - F.col("start") + 1).cast("int"), F.lit(LENGTH))
    rows = rows.select(F.col("doc"), (at - F.col("start")).alias("lo"), string.alias("string"))
    first = rows.groupBy("string").agg(F.min(F.struct("doc", "lo")).alias("first"))
    return rows.join(first, "string").filter("not (doc = first.doc and lo = first.lo)").select("doc", "lo", (F.col("lo") + LENGTH).alias("hi"))


def _repeats(contexts: DataFrame) -> DataFrame:
    """``doc, lo, hi``: strings of first phrases that occur in an earlier phrase with the same trigger."""
    rows, out = contexts.select(F.col("trigger").alias("unit"), F.lit(0).cast("long").alias("start"), F.lit(REACH + 1).cast("long").alias("stop"), "doc", "place", "bytes"), None
    while True:
        sizes = rows.groupBy("unit").agg(F.count("*").alias("n"))
        hot = staged(sizes.filter(F.col("n") > UNIT).select("unit"), "hot-units")  # one for every ``UNIT`` entries at most
        found = _settle(rows.join(hot, "unit", "left_anti"))
        out = found if out is None else out.unionByName(found)
        if hot.isEmpty():
            return out
        rows = rows.join(hot, "unit", "left_semi")
        out = out.unionByName(_equal(rows.filter("stop = start + 1")))
        rows = staged(_halves(rows.filter("stop > start + 1")), "halves")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc, lo, hi``: byte ranges to remove, overlapping and in no order; ``docs`` has ``doc`` (no nulls) and ``text``."""
    parsed = staged(_phrases(docs), "phrases")
    local = parsed.filter("trigger is null").select("doc", F.col("place").alias("lo"), "hi")
    found = staged(_dictionary(parsed.filter("trigger is not null")), "dictionary")
    lo, hi = F.expr("(place >> 16) - ((place >> 8) & 255)"), F.expr("(place >> 16) + (place & 255)")
    again = found.filter("again").select("doc", lo.alias("lo"), hi.alias("hi"))
    contexts = staged(_contexts(docs, found.filter("not again").select("trigger", "doc", "place")), "contexts")
    return local.unionByName(again).unionByName(_repeats(contexts))


def numbered(docs: DataFrame) -> DataFrame:
    """``doc, doc_id, text`` with a ``doc`` of its own for each row, in the order of doc_id, nulls last."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1")
    if shared.isEmpty():
        return docs.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.sha2("text", 256))
    return staged(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) per document."""
    docs = numbered(docs)
    spans = staged(repeated_spans(docs.select("doc", "text")), "spans")
    per = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for own, none, text, spans in zip(b["own"], b["none"], b["text"], b["spans"], strict=True):
                raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
                if spans is None or not len(spans):
                    out.append((own, none, len(raw), 0, 0, raw))
                    continue
                lo, hi = union(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
                keep = np.concatenate(([0], hi)), np.concatenate((lo, [len(raw)]))
                kept = b"".join(raw[a:z] for a, z in zip(*keep, strict=True))
                out.append((own, none, len(raw), len(raw) - len(kept), len(lo), kept))
            yield pd.DataFrame(out, columns=["own", "none", "n_bytes", "n_removed", "n_spans", "kept"])

    own = F.coalesce("doc_id", F.lit(0)).alias("own"), F.col("doc_id").isNull().alias("none")  # nulls would turn identifiers into floats
    out = docs.join(per, "doc", "left").select(*own, "text", "spans").mapInPandas(cut, "own long, none boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(~F.col("none"), F.col("own")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
