"""Operator 7: mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target
stops at twice its source's size and the excess is shared again by weight until none is above.  A source's
target is met by whole passes over it and a remaining budget.  For the budget the documents are counted by
exact length.  A proportional part of every length is taken first, then, while the rest exceeds WINDOW,
single lengths by largest remainder, and a bounded-knapsack dynamic program over the leftover counts (a
bit set of reachable sums, counts split in powers of two) fills the rest exactly or as nearly as can be.
Of each length the needed number of documents is chosen in a seeded order, dealt in SALTS parts so that no
(source, length) is ranked in one task.

What reaches the driver is two sums per round of sharing.  Per source, one task holds a row for each
distinct length.

Rows are told apart by no key, so null and repeated ids are rows like others.  They are ordered by hashes of
their id and text, so reruns agree: rows that are equal in both, and only those, may change places.

Cases: a null source is a source of its own, last; null or empty texts have size 0, take 0 and do not
count; repeated rows are documents of their own; other columns are kept where asked for, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloupe.llm.common import WORD, mix, stored, table

WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2  # times a document may be taken
WINDOW = 1 << 16
SALTS = 64
SEED = 2024


def fit(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to the budget, or nearest below it."""
    length, count = length.astype(object), count.astype(object)  # exact integers of any size
    total = int((length * count).sum())
    if budget >= total:
        return count.astype(np.int64)
    share = budget if budget > WINDOW else 0  # a small budget is all for the dynamic program
    take = np.array([int(c) * share // total if n else 0 for n, c in zip(length, count, strict=True)], object)
    rest = budget - int((take * length).sum())
    spare = count - take
    part = [-(int(c) * budget % total) for c in count]
    for k in sorted(range(len(length)), key=lambda k: (part[k], -int(length[k]))):
        if rest <= WINDOW:
            break
        n = int(length[k])
        m = min(int(spare[k]), (rest - WINDOW) // n + 1, rest // n) if n else 0
        take[k] += m
        spare[k] -= m
        rest -= m * n
    # bounded knapsack: bit s of `reach` is set when s words can be filled
    reach, steps = 1, []
    full = (1 << (rest + 1)) - 1
    mixed = np.argsort(mix(length.astype(np.int64).view(np.uint64), 12), kind="stable")  # no kind of length goes first
    for k in mixed.tolist():
        n = int(length[k])
        if not 0 < n <= rest:
            continue
        left, size = min(int(spare[k]), rest // n), 1
        while left and not reach >> rest & 1:
            m = min(size, left)
            steps.append((k, m, reach))
            reach |= (reach << (m * n)) & full
            left -= m
            size *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for k, m, before in reversed(steps):
        if not before >> at & 1:
            take[k] += m
            at -= m * int(length[k])
    return take.astype(np.int64)


def size_of(text: Column) -> Column:
    """The number of words: one letter is left of each, and of what stands around it."""
    space = r"[\x20\x09-\x0D]*"
    return F.when(F.rlike(text, F.lit(WORD)), F.length(F.regexp_replace(text, f"{space}{WORD}{space}", "w"))).otherwise(0).cast("long")


def ranked(totals: DataFrame) -> DataFrame:
    """Adds rank, from 0, by code point of source, null last; sorted in ranges, so no task holds all sources."""
    rows = stored(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mixing-order")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, start = [], 0
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each range
        before.append((r.part, start))
        start += r.n
    ranges = totals.sparkSession.createDataFrame(before, "part long, before long")
    return rows.withColumn("part", part).join(ranges, "part").withColumn("rank", F.col("before") + place).drop("at", "part", "before")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of a table (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    totals = stored(ranked(totals).withColumn("weight", pick.cast("long")).drop("rank"), "mixing-sources")
    cap = F.col("source_size") * MOST
    share = 0.0
    while True:
        open_ = cap > share * F.col("weight")
        whole, fixed, weight = totals.agg(F.sum("source_size"), F.sum(F.when(~open_, cap)), F.sum(F.when(open_, F.col("weight")))).first()
        new = (PERCENT * (whole or 0) - 100 * (fixed or 0)) / (100 * weight) if weight else share
        if new <= share:
            break
        share = new
    return totals.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(share)).alias("target"))


def mix_sources(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """(row, size, source_size, target, taken, copies) of docs(doc_id, source, text); row: a struct of the columns to keep."""
    found = docs.select(F.struct(*keep).alias("row"), "source", size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("h"), "doc_id", F.xxhash64("text").alias("t"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("h", "t"), F.lit(SALTS)))
    hist = stored(found.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mixing-sizes")
    lengths = hist.groupBy("source", "size").agg(F.sum("n").alias("n"))
    target = targets(lengths.select("source", (F.col("size") * F.col("n")).alias("size")))

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        whole, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        passes = min(MOST, int(target // whole)) if whole else 0
        budget = min(max(0, round(target) - passes * whole), whole) if passes < MOST else 0
        frame["need"] = fit(frame["size"].to_numpy(), frame["n"].to_numpy(), budget) if budget else 0
        frame["passes"] = passes
        return frame[["source", "size", "passes", "need", "source_size", "target"]]

    known = lengths.join(target, lengths["source"].eqNullSafe(target["source"])).drop(target["source"])
    need = known.groupBy("source").applyInPandas(plan, "source string, size long, passes long, need long, source_size long, target double")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = hist["source"].eqNullSafe(need["source"]) & (hist["size"] == need["size"])
    dealt = hist.withColumn("before", before).join(need, same).drop(need["source"], need["size"])
    dealt = dealt.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("a"), "passes", "source_size", "target", F.greatest(F.lit(0), F.col("need") - F.col("before")).alias("here"))
    rows = found.join(dealt, found["source"].eqNullSafe(dealt["s"]) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("a")))
    order = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("h", "doc_id", "t"))
    times = F.col("passes") + (order <= F.col("here")).cast("long")
    return rows.select("row", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("copies"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("row.*", "size", "source_size", "target", "taken", "copies")
