"""Operators over diffs, snapshots and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


def added_lines(hunks: DataFrame) -> DataFrame:
    """(file, line) of the lines that hunk headers (file, header) add; a count of 0 adds none, no count is 1."""
    start = F.regexp_extract("header", HUNK, 1)
    count = F.regexp_extract("header", HUNK, 2)
    rows = hunks.select("file", F.try_to_number(start, F.lit("999999999")).cast("int").alias("s"), F.when(count == "", 1).otherwise(F.when(count != "", count.try_cast("int"))).alias("n"))
    rows = rows.where(F.col("s").isNotNull() & (F.col("n") > 0))
    return rows.select("file", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("line")).distinct()


def null_absorbing_sum(column: str) -> Column:
    """A sum that is unknown as soon as one value is."""
    return F.when(F.count_if(F.col(column).isNull()) > 0, None).otherwise(F.coalesce(F.sum(column), F.lit(0)))


def growth(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, before, after, delta) of two snapshots with a row per file; null means unknown, never zero."""

    def totals(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*(null_absorbing_sum(m).alias(m) for m in metrics))
        return one.unpivot([], metrics, "metric", name)

    both = totals(before, "before").join(totals(after, "after"), "metric")
    return both.withColumn("delta", F.col("after") - F.col("before"))


def churn(numstat: DataFrame) -> DataFrame:
    """(scope, added, deleted, binary_files) of rows (scope, added, deleted) as text, where `-` marks a binary file."""
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    return numstat.groupBy("scope").agg(F.sum(number("added")).alias("added"), F.sum(number("deleted")).alias("deleted"), F.count_if(F.col("added") == "-").alias("binary_files"))


def changed_content(base: DataFrame, head: DataFrame, key: list[str], digest: str = "digest") -> DataFrame:
    """Rows of head that are new or differ from base by digest."""
    old = base.select(*key, F.col(digest).alias("_old"))
    return head.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col(digest))).drop("_old")


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, prefix) with the longest prefix of each path, null where none fits.

    Every leading part of a path (cut at `/`) is looked up by equality, so no pair of path and prefix is tried.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tried = paths.select("path").distinct().select("path", F.explode(heads).alias("prefix"))
    best = tried.join(prefixes.select("prefix").distinct(), "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.join(best, "path", "left")


def below(paths: DataFrame, prefixes: DataFrame, keep: bool = True) -> DataFrame:
    """Paths that lie below (keep) or outside any prefix; compared by whole parts."""
    found = longest_prefix(paths.select("path").distinct(), prefixes).where("prefix IS NOT NULL").select("path")
    return paths.join(found, "path", "left_semi" if keep else "left_anti")


def unselected(paths: DataFrame, prefixes: DataFrame, targets: DataFrame) -> DataFrame:
    """Paths below the prefixes that are no targets (path): what a mutation run has to leave alone."""
    return below(paths, prefixes).join(targets.select("path"), "path", "left_anti")


def test_roots(paths: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path, tests) by the longest mapped prefix (prefix, tests); any path without one leaves tests null for all,
    as only the whole suite then covers the change."""
    matched = longest_prefix(paths, mapping.select("prefix")).join(mapping, "prefix", "left").select("path", "tests")
    open_ = matched.agg(F.bool_or(F.col("tests").isNull()).alias("_open"))
    return matched.crossJoin(F.broadcast(open_)).select("path", F.when(~F.col("_open"), F.col("tests")).alias("tests"))


def kill_rate(killed: Column, survived: Column) -> Column:
    return F.when(killed + survived == 0, F.lit(1.0)).otherwise(killed / (killed + survived))


#: Statuses of which a single mutant fails the gate.
INTOLERABLE = ("no_tests", "timeout", "suspicious", "not_checked", "check_was_interrupted_by_user", "segfault")


def mutation_gate(mutants: DataFrame, by: list[str], floor: float = 0.70) -> DataFrame:
    """(by..., killed, survived, total, failed) of rows (by..., status).

    Fails below the floor, with any intolerable status, and when nothing was measured.
    """
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    rows = mutants.groupBy(*by).agg(n("killed").alias("killed"), n("survived").alias("survived"), n(*INTOLERABLE).alias("intolerable"), F.count("*").alias("total"))
    measured = F.col("killed") + F.col("survived")
    failed = (kill_rate(F.col("killed"), F.col("survived")) < floor) | (F.col("intolerable") > 0) | ((F.col("total") > 0) & (measured == 0))
    return rows.withColumn("failed", failed)


def last_records(history: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The last n records in ingestion order (ordinal); n below 1 keeps all."""
    if n <= 0:
        return history
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ordinal")))
    return history.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
