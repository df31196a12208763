"""Hamming similarity self-join by bands and its connected components.

General pigeonhole principle: give every band of bits a threshold, -1 to leave it out, such that the thresholds plus one
add up to t plus one; two hashes at a distance of at most t then differ on some band by no more than its threshold. Every
hash stores each band with some of these bits flipped and probes with the others flipped. The number of bands is chosen
for the number of hashes. How often two hashes agree on each band is then measured, and the thresholds are those that
make the fewest rows and meetings: a band on which hashes crowd gets few flips or none, one on which they are spread gets
more. Equal hashes collapse to one row first, so bursts of equal images never meet as pairs, and the task is part of the
key. All candidates are verified.

What is made of each hash by chance alone, as chosen here (rows, meetings):

| hashes | t = 4 | t = 8 | t = 12 |
|---|---|---|---|
| 10^5 | 10, 73 | 134, 59 | 308, 3857 |
| 10^6 | 48, 21 | 134, 588 | 1112, 16907 |
| 10^7 | 49, 165 | 512, 3474 | 12236, 36614 |

Wide thresholds over very many hashes are dear by their nature: no choice of bands makes both figures small there. Where
comparing a hash with all others costs less than its rows and meetings, all are compared: in rounds against a part of the
hashes that is broadcast, so of bounded size, with nothing exploded and every pair met once.

Groups need no list of the pairs, which grow with the square of a crowd: hashes of texts in one language are close to each
other. For them each hash is dealt to a run for each of t plus one bands, one of which two near hashes share; where bands
tell hashes apart too rarely, all are in one run. Of the pairs found in a run those are kept that join what was apart, so
fewer than its hashes. A crowd is dealt into blocks of about ``RUN`` hashes: each block is a run, and what they link is
merged; then each two blocks are a run, whose hashes begin in their components.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.fingerprint import hex_to_bits
from shelfmark.operators.components import connected_components
from shelfmark.operators.near_links import links_of_runs
from shelfmark.scratch import staged

LEVELS = {"loose": 4, "standard": 8, "strict": 12}


def threshold(level: str) -> int:
    return LEVELS.get(level, 8)


#: What a row that is made and shuffled costs in meetings, and the most flips listed for a side of a band.
ROW_COST, MOST_MASKS = 5, 20_000
#: Beside comparing all: what a hash to compare with and a row cost in meetings, as measured; how many hashes are broadcast at a time, and the comparisons of a task.
PAIR_COST, DEAR_ROW, BLOCK, TASK_PAIRS = 0.1, 30, 65_536, 100_000_000
#: For groups: hashes of a run and rows of a task, about, and the share of all pairs that may agree on some band, above which all are compared.
RUN, TASK_ROWS, MOST_AGREEMENT = 16_384, 50_000, 0.5


def bands_for(t: int, size: int, agree: list[float] | None = None, bands: int | None = None) -> list[tuple[int, int, int, int]]:
    """(shift, width, flips stored, flips probed) of each band in use, for ``size`` hashes.

    ``agree``: how often two hashes have the same bits on each band; by chance alone, if it is not given.
    """
    return _cheapest(t, size, agree, bands)[1]


def _cheapest(t: int, size: int, agree: list[float] | None = None, bands: int | None = None) -> tuple[float, list[tuple[int, int, int, int]]]:
    return min((_thresholds(t, size, n, agree) for n in ([bands] if bands else range(1, min(t + 1, 64) + 1))), key=lambda x: x[0])


def _layout(bands: int) -> list[tuple[int, int]]:
    """(shift, width) of bands of equal width."""
    widths = [64 // bands + (i < 64 % bands) for i in range(bands)]
    return list(zip(itertools.accumulate([0, *widths[:-1]]), widths, strict=True))


def _thresholds(t: int, size: int, bands: int, agree: list[float] | None) -> tuple[float, list[tuple[int, int, int, int]]]:
    """The cheapest thresholds of so many bands: for every sum of thresholds plus one, the best choice of the bands so far."""
    best = {0: (0.0, [])}
    for k, (shift, width) in enumerate(_layout(bands)):
        same, further = max(agree[k] if agree else 0.0, 2.0**-width), {}
        choices = [(0, 0.0, None)]
        for flips in range(min(t, width) + 1):
            ways = []
            for stored in range(flips // 2 + 1):
                a, b = (sum(math.comb(width, i) for i in range(f + 1)) for f in (stored, flips - stored))
                ways.append((ROW_COST * (a + b) + size * a * b * same + (math.inf if max(a, b) > MOST_MASKS else 0), (shift, width, stored, flips - stored)))
            choices.append((flips + 1, *min(ways)))
        for used, (cost, chosen) in best.items():
            for more, extra, band in choices:
                total = (cost + extra, chosen + [band] * (band is not None))
                if used + more <= t + 1 and total < further.get(used + more, (math.inf, [])):
                    further[used + more] = total
        best = further
    return best.get(t + 1, (math.inf, []))


def _layout_for(t: int, size: int) -> list[tuple[int, int]]:
    """The bands that are cheapest by chance alone."""
    return _layout(min(range(1, min(t + 1, 64) + 1), key=lambda n: _thresholds(t, size, n, None)[0]))


def agreement(values: DataFrame, bands: int) -> tuple[int, list[float]]:
    """The number of hashes, and for every band how often two of one task agree on it; counts are combined before the shuffle."""
    parts = F.posexplode(F.array(*(_band(shift, width) for shift, width in _layout(bands)))).alias("k", "part")
    counts = values.select("task_id", parts).groupBy("task_id", "k", "part").agg(F.count("*").cast("double").alias("c"))
    found = {r["k"]: r for r in counts.groupBy("k").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs")).collect()}  # a row a band
    n = int(found[0]["n"]) if found else 0
    return n, [found[k]["pairs"] / max(1, n * (n - 1)) if found else 0.0 for k in range(bands)]


def _band(shift: int, width: int) -> Column:
    return F.shiftrightunsigned("h", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)).cast("long")


def _masks(width: int, flips: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(flips + 1) for c in itertools.combinations(range(width), k)]


def hamming_pairs(hashes: DataFrame, t: int, *carried: str) -> DataFrame:
    """``task_id, a, b, distance`` for distinct hash values ``h`` of one ``task_id`` (all, if there is no such column) with a < b at a distance of at most t.

    Of ``carried`` columns, which must depend on the task and the value, there is one for each side: ``a_name, b_name``.
    """
    if "task_id" not in hashes.columns:
        hashes = hashes.withColumn("task_id", F.lit(0))
    values = staged(hashes.filter("h is not null").select("task_id", "h", *carried).distinct(), "hamming-values")
    guess, found = len(_layout_for(t, values.count())), []
    for n in range(max(1, guess - 2), guess + 1):  # hashes that agree more than by chance want fewer, wider bands
        size, agree = agreement(values, n)
        found.append(_cheapest(t, size, agree, n))
    cost, bands = min(found, key=lambda x: x[0])
    rows = sum(math.comb(width, i) for _, width, *flips in bands for f in flips for i in range(f + 1))
    if cost + (DEAR_ROW - ROW_COST) * rows > size * PAIR_COST:
        return _all_pairs(values, t, size, carried)
    return _banded(values, t, bands, carried)


def _all_pairs(values: DataFrame, t: int, size: int, carried: tuple[str, ...]) -> DataFrame:
    """Every hash compared with every other: parts of about ``BLOCK`` hashes are broadcast in turn and meet the parts up to them."""
    rounds = max(1, -(-size // BLOCK))
    tasks = max(1, -(-size * min(size, BLOCK) // TASK_PAIRS))
    rows = values.select("task_id", "h", F.struct("h", *carried).alias("x"), F.pmod(F.xxhash64("h"), F.lit(rounds)).alias("part"))
    out = None
    for k in range(rounds):
        # xxhash64 of 64-bit values deals evenly, so a part holds BLOCK rows but for a few hundredths
        part = F.broadcast(rows.filter(F.col("part") == k).select(F.col("task_id").alias("task"), F.col("h").alias("g"), F.col("x").alias("y")))
        near = F.bit_count(F.col("h").bitwiseXOR(F.col("g")))
        once = (F.col("part") < k) | (F.col("h") < F.col("g"))
        # equal, but no key of the join: that would gather all hashes of a task under it
        same = F.col("task_id").between(F.col("task"), F.col("task"))
        met = rows.filter(F.col("part") <= k).repartition(tasks).join(part, (near <= t) & once & same)
        a, b = F.least("x", "y"), F.greatest("x", "y")
        both = [side[c].alias(f"{name}_{c}") for c in carried for name, side in (("a", a), ("b", b))]
        pairs = met.select("task_id", a["h"].alias("a"), b["h"].alias("b"), *both, near.cast("int").alias("distance"))
        pairs = staged(pairs, "hamming-pairs") if rounds > 1 else pairs  # one part at a time is held
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _banded(values: DataFrame, t: int, bands: list[tuple[int, int, int, int]], carried: tuple[str, ...]) -> DataFrame:
    side = {"a": None, "b": None}
    for k, (shift, width, *flips) in enumerate(bands):
        part = _band(shift, width)
        for name, most in zip(side, flips, strict=True):
            masks = [m - (1 << 64) * (m >= 1 << 63) for m in _masks(width, most)]
            own = [F.col("h").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in carried)]
            rows = values.select("task_id", F.lit(k).alias("k"), part.alias("part"), *own)
            if most:
                rows = rows.withColumn("m", F.explode(F.array(*map(F.lit, masks)).cast("array<bigint>"))).withColumn("part", F.col("part").bitwiseXOR(F.col("m"))).drop("m")
            side[name] = rows if side[name] is None else side[name].unionByName(rows)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # rows that flips make are not in Spark's estimate of a side, so either may look small enough to be broadcast
    found = side["a"].hint("merge").join(side["b"], ["task_id", "k", "part"]).filter((F.col("a") < F.col("b")) & (near <= t))
    both = [f"{name}_{c}" for c in carried for name in side]
    return found.select("task_id", "a", "b", *both, near.cast("int").alias("distance")).distinct()


def simhashes(texts: DataFrame) -> DataFrame:
    """``task_id, file_id, h`` from ``task_id, file_id, text``: 64 bits, each 1 where more tokens' hashes have it than not.

    Tokens are the lower-cased words between blanks, tabs and line ends, their hashes the first half of their MD5. A file
    without tokens has no bit set. The bits are summed per file, combined before the shuffle.
    """
    tokens = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \n\t\r]+")
    rows = texts.select("task_id", "file_id", F.explode(tokens).alias("t"))
    rows = rows.withColumn("v", F.when(F.col("t") != "", hex_to_bits(F.substring(F.md5("t"), 1, 16))))
    ones = [F.sum(F.shiftrightunsigned("v", i).bitwiseAND(F.lit(1 + (1 << 32)))).alias(f"b{i}") for i in range(32)]  # bits i and i + 32
    sums = rows.groupBy("task_id", "file_id").agg(F.count("v").alias("n"), *ones)
    halves = [(i, F.col(f"b{i}").bitwiseAND(F.lit((1 << 32) - 1))) for i in range(32)] + [(i + 32, F.shiftrightunsigned(f"b{i}", 32)) for i in range(32)]
    bits = [F.shiftleft((2 * count > F.col("n")).cast("long"), i) for i, count in halves]
    return sums.select("task_id", "file_id", functools.reduce(lambda a, b: a.bitwiseOR(b), (F.coalesce(b, F.lit(0)) for b in bits)).alias("h"))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """``task_id, h, rep``: the smallest file of each hash value within a task."""
    return hashes.filter("h is not null").groupBy("task_id", "h").agg(F.min("file_id").alias("rep"))


def edges(hashes: DataFrame, t: int) -> DataFrame:
    """``task_id, src, dst, distance`` between class representatives of one task; equal hashes are one class."""
    pairs = hamming_pairs(hash_classes(hashes), t, "rep")
    return pairs.select("task_id", F.least("a_rep", "b_rep").alias("src"), F.greatest("a_rep", "b_rep").alias("dst"), "distance")


def near_components(classes: DataFrame, t: int) -> DataFrame:
    """``node, component`` of representatives at a distance of at most t, chained links included; those without a neighbour may be missing."""
    values = staged(classes.filter("task_id is not null and rep is not null").select("task_id", "h", "rep"), "hamming-values")
    layout = _layout(min(t + 1, 64))
    size, agree = agreement(values, len(layout))
    layout = layout if t < 64 and sum(agree) < MOST_AGREEMENT else [(0, 0)]
    bands = F.array(*(F.struct(F.lit(k).alias("k"), _band(shift, width).alias("part")) for k, (shift, width) in enumerate(layout)))
    key, run = ["task_id", "k", "part"], ["task_id", "k", "part", "lo", "hi"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select("task_id", F.explode(bands).alias("band"), "h", "label").select("task_id", "band.*", "h", "label")

    def linked(rows: DataFrame, count: int) -> DataFrame:
        sorted_ = rows.repartition(max(8, -(-count // TASK_ROWS)), *run).sortWithinPartitions(*run, "side").select(*run, "side", "h", "label")
        kind = rows.schema["label"].dataType.simpleString()
        return staged(sorted_.mapInArrow(lambda batches: links_of_runs(batches, t), f"src {kind}, dst {kind}"), "near-links")

    own = dealt(values.withColumnRenamed("rep", "label"))
    crowds = own.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > RUN).withColumn("blocks", F.ceil(F.col("n") / RUN))
    crowds = staged(crowds, "crowds")  # fewer rows than one for RUN hashes of a band, so broadcast
    sent = crowds.agg(F.sum(F.col("n") * (F.col("blocks") - 1))).first()[0]
    block, crowds = F.pmod(F.xxhash64("h"), F.col("blocks")), F.broadcast(crowds.drop("n"))
    own = own.join(crowds, key, "left").withColumn("lo", F.coalesce(block, F.lit(0)))
    links = linked(own.withColumns({"hi": F.col("lo"), "side": F.lit(0)}), size * len(layout))
    component = connected_components(links)
    if not sent:
        return component
    component = staged(component, "near-components")
    known = values.join(component, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep"))
    two = dealt(known).join(crowds, key).withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    two = two.filter("own != other").withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    return connected_components(linked(two, sent).unionByName(component.select(F.col("node").alias("src"), F.col("component").alias("dst"))))


def groups_at(hashes: DataFrame, links: DataFrame, t: int) -> DataFrame:
    """``task_id, group_id, file_id`` of components of at least two files, chained links included."""
    return _grouped(hashes, connected_components(links.filter(F.col("distance") <= t)))


def _grouped(hashes: DataFrame, component: DataFrame) -> DataFrame:
    classes = hash_classes(hashes).join(component, F.col("rep") == F.col("node"), "left")
    classes = classes.select("task_id", "h", F.coalesce("component", "rep").alias("group_id"))
    rows = hashes.select("task_id", "file_id", "h").join(classes, ["task_id", "h"]).select("task_id", "group_id", "file_id")
    many = rows.groupBy("task_id", "group_id").agg(F.count("*").alias("n")).filter("n >= 2").drop("n")
    return rows.join(many, ["task_id", "group_id"], "left_semi")


def similar_groups(hashes: DataFrame, t: int) -> DataFrame:
    hashes = staged(hashes.select("task_id", "file_id", "h"), "hashes")  # read several times below
    return _grouped(hashes, near_components(hash_classes(hashes), t))


def sweep(hashes: DataFrame, levels: dict[str, int]) -> DataFrame:
    """Group and file counts at several thresholds; the pairs are found once, at the widest."""
    hashes = staged(hashes.select("task_id", "file_id", "h"), "hashes")  # read several times at each level
    links, out = staged(edges(hashes, max(levels.values())), "hamming-edges"), None
    for name, t in levels.items():
        row = groups_at(hashes, links, t).agg(F.count_distinct("task_id", "group_id").alias("groups"), F.count("*").alias("files"))
        row = row.select(F.lit(name).alias("level"), F.lit(t).alias("threshold"), "groups", "files")
        out = row if out is None else out.unionByName(row)
    return out
