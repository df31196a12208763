"""Spelling variants by dynamic programming over sorted lists.

Words within one edit of each other are found by scanning sorted vocabulary. For one word the rows of the edit matrix
against the next are kept, three cells wide, as no more can matter; the rows that two neighbours of the list share, as
many as their common prefix is long, are not computed again, and when all cells of a row exceed one edit, every following
word with that prefix is skipped.

A vocabulary is scanned in lists, not as a whole. Of two words within one edit, the shorter of m code points, either the
first half of m is equal, or the rest of it at the end is, so each word is in a list by its first half and one by its
last, for m its length and one less. In a list by ends, only pairs are reported whose beginnings differ: every pair is
met once. Lists above ``LIST`` words are divided in the same way between their equal ends, until none is above it or one
position alone is free. So no task holds more than such a list, whatever the vocabulary. Of a word, a list gives only the
number of near words and the best of them.

Defined results: a null text has no runs; a null identifier reads as an empty one in the hash of a run; repeated rows
count as texts each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.scratch import staged

#: Words of a list that one task scans, and words that a task gathers before it passes their counts on.
LIST, GATHERED = 50_000, 500_000
#: Words of lists that one partition scans, on average; scanning is slow for what it reads.
SCANNED = 50_000
#: One in so many runs of a document loses a code point.
DAMAGED = 199
#: Latin-1: letters with A-Z in lower case, all else a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_LIST_KEY = ["m", "a", "b", "differ", "head", "tail"]


def damaged(prefix: int, run: bytes) -> bytes:
    """A lower-cased run (Latin-1), by its hash after that of ``<doc_id>:``, without one code point or as it is."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(shortest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(b"%s:" % (doc_id or "").encode())
                runs = text.as_py().decode().encode("latin-1", "replace").translate(_LETTERS).split()
                for run, n in Counter(runs).items():
                    word = damaged(prefix, run)
                    if len(word) >= shortest:
                        found[word] = found.get(word, 0) + n
                if len(found) >= GATHERED:
                    yield _batch(found)
                    found = {}
        yield _batch(found)

    return count


def _batch(found: dict[bytes, int]) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array([w.decode("latin-1") for w in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def vocabulary(docs: DataFrame, least: int, shortest: int) -> DataFrame:
    """``word, n`` of words with at least ``shortest`` code points and ``least`` occurrences."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(_counter(shortest), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _lists(lists: Column, words: DataFrame) -> DataFrame:
    """Words with the keys of the lists they are in: class, lengths of the equal beginning and end, and these themselves."""
    rows = words.withColumn("x", F.explode(lists)).select("word", "n", "x.*")
    return rows.withColumns({"head": F.expr("substring(word, 1, a)"), "tail": F.expr("right(word, b)")})


def _list(m: Column, a: Column, b: Column, differ: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"), differ.cast("int").alias("differ"))


def listed(words: DataFrame, shortest: int, most: int = LIST) -> DataFrame:
    """``word, n`` and the key of each list a word is in; no list is above ``most`` words while it can be divided."""
    nothing, both = F.lit(0), []
    for m in (F.length("word"), F.length("word") - 1):
        half = F.floor(m / 2)
        both += [_list(m, half, nothing, F.lit(None)), _list(m, nothing, m - half, half)]
    rows, done = staged(_lists(F.array(*both), words).filter(F.col("m") >= shortest), "spelling-lists"), None
    while True:
        free = F.col("m") - F.col("a") - F.col("b")
        long = rows.filter(free >= 2).groupBy(_LIST_KEY).agg(F.count("*").alias("k")).filter(F.col("k") > most).drop("k")
        long = staged(long, "spelling-long").withColumnsRenamed({c: f"_{c}" for c in _LIST_KEY})
        if long.isEmpty():
            return rows if done is None else done.unionByName(rows)
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _LIST_KEY]
        fits, over = rows.join(long, on, "left_anti"), rows.join(long, on, "left_semi")
        done = fits if done is None else done.unionByName(fits)
        a = F.col("a") + F.floor(free / 2)
        halves = F.array(_list(F.col("m"), a, F.col("b"), F.col("differ")), _list(F.col("m"), F.col("a"), F.col("m") - a, F.least("differ", a)))
        rows = staged(_lists(F.col("halves"), over.select("word", "n", halves.alias("halves"))), "spelling-lists")


def near_in_list(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs of places, the lesser first, of words exactly one edit apart in a sorted list."""
    n = len(words)
    lcp = [0] * (n + 1)  # with the word before
    for j in range(1, n):
        lcp[j] = len(os.path.commonprefix((words[j - 1], words[j])))
    lower, stack = [n] * (n + 1), []  # the next place with a shorter common prefix
    for j in range(n + 1):
        while stack and lcp[j] < lcp[stack[-1]]:
            lower[stack.pop()] = j
        stack.append(j)
    for i in range(n - 1):
        q, size, j = words[i], len(words[i]), i + 1
        depth = lcp[j]
        rows = [(2, 0, 1)] + [(1, 0, 1)] * depth  # cells one before, on and one after the diagonal, so far against its own beginning
        while j < n:
            v = words[j]
            x, y, z = rows[depth]
            dead = False
            for r in range(depth + 1, len(v) + 1):
                c = v[r - 1]
                before = x + (r < 2 or r - 2 >= size or q[r - 2] != c)
                x = before if before <= y else y + 1
                y = min(y + (r > size or q[r - 1] != c), z + 1, x + 1)
                z = min(z + (r >= size or q[r] != c), y + 1)
                del rows[r:]
                rows.append((x, y, z))
                if x > 1 and y > 1 and z > 1:
                    dead = True
                    break
            if not dead:
                r = len(v)
                at = size - r + 1
                if 0 <= at <= 2 and rows[r][at] == 1:
                    yield i, j
            j += 1
            if dead:
                while j < n and lcp[j] >= r:
                    j = lower[j]
            depth = min(lcp[j], len(rows) - 1)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every word with near words in a list: how many, and the most frequent, then first of them."""
    columns = ("key", "m", "differ", "word", "n")
    rows = itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in columns), strict=True) for b in batches)
    out: list[tuple] = []
    for _, group in itertools.groupby(rows, lambda row: row[0]):
        group = list(group)
        if len(group) < 2:
            continue
        m, differ = group[0][1] + 1, group[0][2]
        words, best, near = [row[3] for row in group], {}, Counter()
        for i, j in near_in_list([w.encode("latin-1") for w in words]):
            if len(words[i]) == m == len(words[j]) or differ and words[i][:differ] == words[j][:differ]:
                continue
            for one, other in ((i, j), (j, i)):
                near[one] += 1
                best[one] = min(best.get(one, (1, "")), (-group[other][4], words[other]))
        out += [(words[i], k, -best[i][0], best[i][1]) for i, k in near.items()]
        if len(out) >= 10_000:
            yield _near_batch(out)
            out = []
    yield _near_batch(out)


def _near_batch(out: list[tuple]) -> pa.RecordBatch:
    word, near, n, form = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.record_batch({"word": pa.array(word, pa.string()), "n_near": pa.array(near, pa.int64()), "best_n": pa.array(n, pa.int64()), "best": pa.array(form, pa.string())})


def near_words(words: DataFrame, shortest: int, most: int = LIST) -> DataFrame:
    """``word, n_near, best`` (a struct of the negated count and the word) of words that have near ones."""
    key = F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _LIST_KEY)).alias("key")
    rows = listed(words, shortest, most).select(key, "m", "differ", "word", "n")
    found = rows.repartition(max(1, -(-rows.count() // SCANNED)), "key").sortWithinPartitions("key", "word").mapInArrow(_scanned, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("form"))).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the last form that is reached; each round doubles the steps taken."""
    at = staged(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, least: int = 5, shortest: int = 6, times: int = 5, most: int = LIST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words; a form is ``times`` as frequent as the word, so chains end."""
    words = staged(vocabulary(docs, least, shortest), "spelling-words")
    near = words.join(near_words(words, shortest, most), "word", "left")
    better = -F.col("best.n") >= times * F.col("n")
    near = near.withColumns({"form": F.when(better, F.col("best.form")), "form_n": F.when(better, -F.col("best.n"))})
    near = staged(near.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "spelling-near")
    root = roots(near.filter("form is not null"))
    return near.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
