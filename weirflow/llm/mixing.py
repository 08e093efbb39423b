"""Mixing sources to target weights by fitting a token budget as a subset sum.

Documents are counted by source and exact length. A source whose target covers it
takes every document once; the rest of its budget is first spread over all lengths
in proportion, then long documents fill what is left down to ``WINDOW``, and a
bounded-knapsack dynamic program over the remaining counts by length picks the
final sum; a larger remainder, as sources of few very long documents leave it, is
covered in units of several words first. Documents are then selected by length
count, in a seeded order.

Tables by length are as large as the longest text, and one row a source reaches the
driver; rows of documents stay in narrow distributed tables. A crowded length of a
source is dealt into buckets by the seeded order, so that no task ranks more than
about ``BUCKET`` rows, however many documents have one length.

Edge cases: a null text has size 0; a null source is a source of its own, the last;
repeated rows are documents of their own; documents of size 0 follow their source's
share and add nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.storage import as_scan, located, small_or_plain, whole_rows, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, BUDGET, REPEATS, SEED = (5, 2, 1), 1.5, 2, 17
#: Largest sum the dynamic program covers, and rows ranked together.
WINDOW, BUCKET = 1 << 16, 10_000
#: Documents of each length that the proportional share leaves to the dynamic program.
SLACK = 2


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> dict[str | None, float]:
    """Each source's share of ``budget`` times all sizes; a share over ``repeats`` times the source is cut and reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, cut = list(order), {}
    while open_:
        rest = budget * sum(sizes.values()) - sum(cut.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not above:
            return cut | share
        cut |= {s: float(repeats * sizes[s]) for s in above}
        open_ = [s for s in open_ if s not in cut]
    return cut


def subset_sum(items: list[tuple[int, int]], goal: int) -> dict[int, int]:
    """How many of each size to take so that the sum comes as near to ``goal`` as it can.

    ``items`` are (size, count); the sums reached so far are the bits of one integer.
    """
    mask, reached, trail = (1 << (2 * goal + 1)) - 1, 1, []
    for size, count in items:
        part = 1
        while count and not reached >> goal & 1 and size * min(part, count) <= 2 * goal:
            part = min(part, count)
            trail.append((size, part, reached))
            reached |= (reached << size * part) & mask
            part, count = part * 2, count - part
    above, below = reached >> goal, (reached & ((1 << (goal + 1)) - 1)).bit_length() - 1
    over = goal + (above & -above).bit_length() - 1 if above else None
    left, taken = over if over is not None and over - goal < goal - below else below, {}
    for size, part, before in reversed(trail):
        if not before >> left & 1:
            left -= size * part
            taken[size] = taken.get(size, 0) + part
    return taken


def filled(counts: dict[int, int], extra: dict[int, int], rest: int) -> tuple[int, dict[int, int]]:
    """How far ``extra`` with further documents comes from ``rest`` words, and the number of each size.

    A remainder that the dynamic program can't cover word by word is first covered in larger units.
    """
    extra = dict(extra)
    while (left := rest - sum(size * n for size, n in extra.items())) > 0:
        unit = -(-left // (2 * WINDOW))
        spare: dict[int, list[int]] = {}
        for size in sorted(counts, reverse=True):
            if 0 < size <= 2 * left and counts[size] > extra[size] and (units := (size + unit // 2) // unit):
                spare.setdefault(units, []).append(size)
        taken = subset_sum([(u, sum(counts[s] - extra[s] for s in of)) for u, of in spare.items()], left // unit)
        tried = dict(extra)
        for units, n in taken.items():
            for size in spare[units]:
                more = min(n, counts[size] - tried[size])
                tried[size] += more
                n -= more
        if abs(rest - sum(size * n for size, n in tried.items())) >= left:
            break
        extra = tried
    return abs(left), extra


def fit(counts: dict[int, int], target: float) -> tuple[int, dict[int, int]]:
    """Copies that every document gets, and how many of each size get one more."""
    total = sum(size * n for size, n in counts.items())
    whole = int(target >= total)
    rest = math.floor(target) - whole * total
    if not total or not rest:
        return whole, {}
    extra = {size: max(0, n * rest // total - SLACK) for size, n in counts.items()}
    left = rest - sum(size * n for size, n in extra.items())
    for size in sorted(counts, reverse=True):
        if size:
            more = min(counts[size] - extra[size], max(0, left - WINDOW) // size)
            extra[size] += more
            left -= more * size
    off, extra = filled(counts, extra, rest)
    if off > 1:  # few documents but long ones: all of them are open again
        other = filled(counts, dict.fromkeys(counts, 0), rest)
        if other[0] < off:
            extra = other[1]
    return whole, extra


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken, __file, __row."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11)  # rows without an id are spread by their texts
    sized = written(located(docs, "doc_id", "source", "text").select("doc_id", "source", words.alias("size"), draw.alias("draw"), "__file", "__row"), "mix-sizes")
    cells = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    sizes = {r.source: int(r.words) for r in cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    wanted = targets(sizes)
    rows = [(s, sizes[s], float(t)) for s, t in wanted.items()]
    goals = spark.createDataFrame(rows, "src string, source_size long, target double")

    def plan(cell: pd.DataFrame) -> pd.DataFrame:
        whole, extra = fit(dict(zip(cell["size"].tolist(), cell["n"].tolist())), float(cell["target"].iloc[0]))
        return cell.assign(whole=whole, extra=[extra.get(x, 0) for x in cell["size"].tolist()])

    cells = cells.join(goals, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    cells = cells.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, whole long, extra long")
    cells = written(cells.withColumnsRenamed({"source": "src", "size": "len"}), "mix-plan")

    dealt = sized.join(small_or_plain(cells), F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("len")))
    dealt = dealt.withColumn("bucket", F.floor(F.col("draw") / F.lit(float(1 << 53)) * F.ceil(F.col("n") / BUCKET)))
    buckets = dealt.groupBy("src", "len", "bucket").agg(F.count("*").alias("held"), F.first("extra").alias("quota"))
    before = Window.partitionBy("src", "len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("quota", F.col("quota") - F.coalesce(F.sum("held").over(before), F.lit(0)))
    buckets = written(buckets.select(F.col("src").alias("b_src"), F.col("len").alias("b_len"), F.col("bucket").alias("b"), "quota"), "mix-buckets")
    same = F.col("src").eqNullSafe(F.col("b_src")) & (F.col("len") == F.col("b_len")) & (F.col("bucket") == F.col("b"))
    ranked = Window.partitionBy("src", "len", "bucket").orderBy("draw", "doc_id", "__file", "__row")
    picked = dealt.join(small_or_plain(buckets), same).withColumn("rank", F.row_number().over(ranked))
    copies = F.col("whole") + (F.col("rank") <= F.col("quota")).cast("long")
    return picked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "__file", "__row")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them."""
    docs = as_scan(docs)
    changed = mixture(docs, seed).where("copies <> 1").select("__file", "__row", F.col("copies").cast("int").alias("__copies"))
    changed = written(changed, "mix-copies")
    rows = whole_rows(docs).join(small_or_plain(changed), ["__file", "__row"], "left")
    times = F.explode(F.array_repeat(F.lit(1), F.coalesce("__copies", F.lit(1))))
    return rows.select("whole", times.alias("__copy")).select("whole.*")
