"""Operators over findings: (file_path, engine, rule, severity, line, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the health score.
PENALTY = {"error": 3.0, "warning": 1.0, "info": 0.25}
WEIGHT = {"ai-slop": 2.5, "security": 1.5, "code-quality": 0.8, "reachability": 0.8, "redundancy": 0.8, "lint": 0.6, "format": 0.3}
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}
SMOOTHING = 20
HEALTHY, NEEDS_WORK = 75, 50


def mapped(column: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def override_severity(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replaces severities by rule; `off` drops the finding.  overrides: (rule, override), a row per configured rule."""
    joined = findings.join(overrides, "rule", "left")
    kept = joined.where(F.coalesce("override", F.lit("")) != "off")
    return kept.withColumn("severity", F.coalesce("override", "severity")).drop("override")


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Drops findings that a directive covers.

    directives: (file, scope, line, codes); scope `file` or `line`; null codes cover every rule, a code is
    a whole rule or its last segment.  Parse errors cannot be suppressed.
    """
    d, f = directives.alias("d"), findings.alias("f")
    covers = F.col("d.codes").isNull() | F.array_contains(F.col("d.codes"), F.col("f.rule")) | F.array_contains(F.col("d.codes"), F.element_at(F.split(F.col("f.rule"), "/"), -1))
    here = (F.col("d.scope") == "file") | (F.col("d.line") == F.col("f.line"))
    fixed = F.col("f.rule").endswith("/parse-error")
    return f.join(d, (F.col("f.file_path") == F.col("d.file")) & here & covers & ~fixed, "left_anti")


def on_changed_lines(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Findings on added lines; added: (file, line)."""
    return findings.join(added, (findings["file_path"] == added["file"]) & (findings["line"] == added["line"]), "left_semi")


def once_per_line(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["file_path", "rule", "line"])


def engine_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("engine").agg(F.count("*").alias("n"))


def summary(findings: DataFrame) -> DataFrame:
    by = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(by("error").alias("errors"), by("warning").alias("warnings"), by("info").alias("info"), F.count("*").alias("total"), F.countDistinct("file_path").alias("files"))


def gate_failed(findings: DataFrame) -> bool:
    return not findings.where(F.col("severity") == "error").limit(1).isEmpty()


def label(score: Column, healthy: int = HEALTHY, needs_work: int = NEEDS_WORK) -> Column:
    return F.when(score >= healthy, "Healthy").when(score >= needs_work, "Needs Work").otherwise("Critical")


def health_score(findings: DataFrame, files: DataFrame, by: list[str], weights: dict[str, float] | None = None, smoothing: int = SMOOTHING) -> DataFrame:
    """(by..., score, label) of every row of files (by..., n_files); findings need severity, engine and style.

    Given weights replace the whole default table, and engines they do not name weigh 1.
    """
    cost = mapped(F.col("severity"), PENALTY, 0.0) * mapped(F.col("engine"), WEIGHT if weights is None else weights, 1.0) * F.when(F.col("style"), 0.5).otherwise(1.0)
    sums = findings.groupBy(*by).agg(F.sum(cost).alias("_cost"), F.count("*").alias("_n"))
    rows = files.join(sums, by, "left") if by else files.crossJoin(F.broadcast(sums))
    n = F.coalesce("_n", F.lit(0))
    scaled = F.coalesce("_cost", F.lit(0.0)) * F.sqrt(F.least(F.lit(1.0), n / (F.col("n_files") + smoothing)))
    raw = F.bround(F.lit(100.0) - F.lit(100.0) * F.log1p(scaled) / F.log1p(F.lit(100.0) + scaled), 0)
    score = F.when(n == 0, 100).otherwise(F.greatest(F.lit(0), raw).cast("int"))
    return rows.select(*by, score.alias("score")).withColumn("label", label(F.col("score")))


def split_by_confidence(findings: DataFrame, block: int = 80) -> DataFrame:
    """Adds verdict: block or advisory."""
    return findings.withColumn("verdict", F.when(F.col("confidence") >= block, "block").otherwise("advisory"))


def rule_index(findings: DataFrame) -> DataFrame:
    """(rule, rule_index) by first appearance; findings carry their ordinal."""
    first = findings.groupBy("rule").agg(F.min("ordinal").alias("first"))
    return first.select("rule", (F.row_number().over(Window.orderBy("first")) - 1).alias("rule_index"))


def report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file_path", "line", "rule")


def capped_noise(rows: DataFrame, top: int, actionable: int = 1) -> DataFrame:
    """All rows of actionable rank and the first `top` others by (rank, file, line); top below 1 keeps all."""
    if top <= 0:
        return rows
    noise = rows.where(F.col("rank") > actionable).orderBy("rank", "file", "line", "symbol").limit(top)
    return rows.where(F.col("rank") <= actionable).unionByName(noise)
