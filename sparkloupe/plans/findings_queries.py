"""Queries over findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloupe.functions import text
from sparkloupe.operators import findings as ops
from sparkloupe.plans.common import EVENT_FINDINGS_SQL as FINDINGS
from sparkloupe.plans.common import event_findings, table

_RULES = (("text/licence", "warning"), ("text/email", "error"), ("text/separator", "info"), ("text/todo", "info"))


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, source, line, engine, rule, severity, style) of the text rules over every line of documents."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").cast("string").alias("file_path"), "source", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    body = F.col("body")
    tests = (F.rlike(body, F.lit(text.LICENCE)), F.rlike(body, F.lit(text.EMAIL)), text.is_separator(body), text.is_untracked_todo(body))
    hits = F.filter(F.array(*(F.when(t, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for t, (r, s) in zip(tests, _RULES, strict=True))), lambda x: x.isNotNull())
    found = lines.select("file_path", "source", (F.col("pos") + 1).alias("line"), F.explode(hits).alias("hit"))
    return found.select("file_path", "source", "line", F.lit("code-quality").alias("engine"), "hit.rule", "hit.severity", (F.col("hit.severity") == "info").alias("style"))


def diag_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.once_per_line(line_findings(spark, sf_dir))
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.min("line").alias("first_line"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each document source by the text rules: rules, severity policy, density-normalised score."""
    policy = spark.createDataFrame([("text/separator", "off"), ("text/licence", "error")], "rule string, override string")
    found = ops.override_severity(line_findings(spark, sf_dir), policy)  # a rule finds a line once already
    files = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"))
    return ops.health_score(found, files, ["source"])


def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame([("app/click", "off"), ("app/view", "error"), ("app/signup", "info"), ("app/none", "off")], "rule string, override string")
    found = ops.override_severity(event_findings(spark, sf_dir), policy)
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def suppress_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("toxic = 1 OR doc_id % 3 = 0")
    codes = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("click"), F.lit("app/view"))).otherwise(F.lit(None).cast("array<string>"))
    users = F.concat(F.lit("u"), (F.col("doc_id") % 150).cast("string"))
    directives = labels.select(users.alias("file"), F.when(F.col("toxic") == 1, "file").otherwise("line").alias("scope"), (F.col("doc_id") % 97 + 1).cast("int").alias("line"), codes.alias("codes"))
    return ops.suppress(event_findings(spark, sf_dir), directives).select("ordinal", "file_path", "rule", "line")


def rule_engine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.engine_counts(event_findings(spark, sf_dir))


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(event_findings(spark, sf_dir))


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_findings(spark, sf_dir)
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path")).distinct().withColumn("n_files", F.lit(4000))
    return ops.health_score(found, files, ["file_path"])


def exclude_fnmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(~F.coalesce(text.matches_any_glob(F.col("url"), ["*spam-farm*", "https://blog.*/en/*", "*[0-9].html", "*?ref=[xy]"]), F.lit(False)))


def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.blank_quoted(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"), F.length(masked).alias("n_masked"), F.md5(masked).alias("digest"))


def block_advisory_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_findings(spark, sf_dir).withColumn("confidence", F.floor("value").cast("int"))
    return ops.split_by_confidence(found.where("confidence >= 60")).groupBy("rule", "verdict").agg(F.count("*").alias("n"))


def sarif_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rule_index(event_findings(spark, sf_dir).withColumn("rule", F.concat_ws("/", "engine", "rule")))


def changed_line_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    found = items.select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line"), "l_partkey")
    added = items.where("l_quantity > 45").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    return ops.on_changed_lines(found, added).groupBy("line").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparkline of the last 12 days' scores of each event type, in ingestion order."""
    from sparkloupe.operators.diff import last_records

    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label"), F.dayofmonth("ts").alias("ordinal")).agg((F.sum(F.floor(F.col("value"))) % 120 - 10).cast("int").alias("score"))
    rows = last_records(days, 12, ["label"]).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("ordinal", "score"))).alias("rows"))
    scores = F.transform("rows", lambda r: r["score"])
    return rows.select("label", F.element_at(scores, -1).alias("last"), text.sparkline(scores).alias("trend"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each finding in the machine report: by file, line, rule."""
    order = F.row_number().over(Window.partitionBy("file_path").orderBy("line", "rule", "ordinal"))
    return event_findings(spark, sf_dir).select("file_path", "ordinal", order.alias("position"))


QUERIES = {
    "diag_text_rules": diag_text_rules, "flagship": flagship, "severity_override": severity_override, "suppress_antijoin": suppress_antijoin,
    "rule_engine_counts": rule_engine_counts, "summary_counts": summary_counts, "health_score": health_score, "exclude_fnmatch": exclude_fnmatch,
    "masked_text": masked_text, "block_advisory_split": block_advisory_split, "sarif_rule_index": sarif_rule_index,
    "changed_line_semijoin": changed_line_semijoin, "score_trend": score_trend, "report_rows": report_rows,
}

_LINES = r"""
l AS (SELECT doc_id::VARCHAR AS file_path, p AS line, body, source FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)),
g AS (SELECT DISTINCT file_path, line, source, rule, severity FROM (
  SELECT *, 'text/licence' AS rule, 'warning' AS severity FROM l WHERE regexp_matches(body, '(?i)all rights reserved|licen[cs]ed? under')
  UNION ALL SELECT *, 'text/email', 'error' FROM l WHERE regexp_matches(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')
  UNION ALL SELECT *, 'text/separator', 'info' FROM l WHERE regexp_matches(body, '^\s*[-=*#_~]{6,}\s*$')
  UNION ALL SELECT *, 'text/todo', 'info' FROM l WHERE regexp_matches(body, '(?i)^(?:[-*]\s+|[0-9]+[.)]\s+|[A-Za-z][.)]\s+)?(?:TODO|FIXME|HACK|XXX)\b') AND NOT regexp_matches(body, '#[0-9]+|\b[A-Z][A-Z0-9]+-[0-9]+\b|https?://\S+')))
"""
_SCORE = """CASE WHEN coalesce(n, 0) = 0 THEN 100 ELSE greatest(0, round_even(100.0 - 100.0 * ln(1 + scaled) / ln(1 + 100.0 + scaled), 0))::INT END AS score"""
_COST = """CASE severity WHEN 'error' THEN 3.0 WHEN 'warning' THEN 1.0 WHEN 'info' THEN 0.25 ELSE 0 END *
CASE engine WHEN 'ai-slop' THEN 2.5 WHEN 'security' THEN 1.5 WHEN 'lint' THEN 0.6 WHEN 'format' THEN 0.3 ELSE 0.8 END * CASE WHEN style THEN 0.5 ELSE 1 END"""
_LABEL = "CASE WHEN score >= 75 THEN 'Healthy' WHEN score >= 50 THEN 'Needs Work' ELSE 'Critical' END AS label"
_TICKS = "▁▂▃▄▅▆▇█"

SQL = {
    "diag_text_rules": f"WITH {_LINES} SELECT rule, severity, count(*) AS n, count(DISTINCT file_path) AS files, min(line) AS first_line FROM g GROUP BY ALL",
    "flagship": f"""WITH {_LINES},
h AS (SELECT source, 'code-quality' AS engine, CASE rule WHEN 'text/licence' THEN 'error' ELSE severity END AS severity, severity = 'info' AS style FROM g WHERE rule <> 'text/separator'),
s AS (SELECT source, sum({_COST})::DOUBLE AS cost, count(*) AS n FROM h GROUP BY source),
d AS (SELECT source, count(*) AS n_files FROM documents GROUP BY source),
j AS (SELECT source, n, coalesce(cost, 0) * sqrt(least(1.0::DOUBLE, coalesce(n, 0)::DOUBLE / (n_files + 20))) AS scaled FROM d LEFT JOIN s USING (source)),
k AS (SELECT source, {_SCORE} FROM j) SELECT source, score, {_LABEL} FROM k""",
    "severity_override": f"""WITH {FINDINGS}, o AS (SELECT * FROM (VALUES ('app/click','off'),('app/view','error'),('app/signup','info'),('app/none','off')) t(rule, override))
SELECT rule, coalesce(override, severity) AS severity, count(*) AS n FROM f LEFT JOIN o USING (rule) WHERE coalesce(override, '') <> 'off' GROUP BY ALL""",
    "suppress_antijoin": f"""WITH {FINDINGS}, d AS (SELECT 'u' || (doc_id % 150) AS file, CASE WHEN toxic = 1 THEN 'file' ELSE 'line' END AS scope, doc_id % 97 + 1 AS line,
  CASE WHEN doc_id % 3 = 0 THEN ['click', 'app/view'] END AS codes FROM labels WHERE toxic = 1 OR doc_id % 3 = 0)
SELECT ordinal, file_path, rule, line FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.file = f.file_path AND (scope = 'file' OR d.line = f.line)
  AND (codes IS NULL OR list_contains(codes, f.rule) OR list_contains(codes, string_split(f.rule, '/')[-1])))""",
    "rule_engine_counts": f"WITH {FINDINGS} SELECT engine, count(*) AS n FROM f GROUP BY engine",
    "summary_counts": f"WITH {FINDINGS} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info, count(*) AS total, count(DISTINCT file_path) AS files FROM f",
    "health_score": f"""WITH {FINDINGS}, s AS (SELECT file_path, sum({_COST})::DOUBLE AS cost, count(*) AS n FROM f GROUP BY file_path),
d AS (SELECT DISTINCT file_path FROM f), j AS (SELECT file_path, n, coalesce(cost, 0) * sqrt(least(1.0::DOUBLE, coalesce(n, 0)::DOUBLE / 4020)) AS scaled FROM d LEFT JOIN s USING (file_path)),
k AS (SELECT file_path, {_SCORE} FROM j) SELECT file_path, score, {_LABEL} FROM k""",
    "exclude_fnmatch": "SELECT page_id, url FROM pages WHERE NOT coalesce(url GLOB '*spam-farm*' OR url GLOB 'https://blog.*/en/*' OR url GLOB '*[0-9].html' OR url GLOB '*?ref=[xy]', false)",
    "masked_text": """WITH p AS (SELECT page_id, html, string_split(html, '"') AS s FROM pages),
q AS (SELECT page_id, html, array_to_string(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i % 2 = 0 THEN regexp_replace(s[i], '[^\\n]', 'x', 'g') ELSE s[i] END), '"') AS m FROM p)
SELECT page_id, length(html) AS n, length(m) AS n_masked, md5(m) AS digest FROM q""".replace("\\\\", "\\"),
    "block_advisory_split": f"WITH {FINDINGS} SELECT rule, CASE WHEN floor(value) >= 80 THEN 'block' ELSE 'advisory' END AS verdict, count(*) AS n FROM f WHERE floor(value) >= 60 GROUP BY ALL",
    "sarif_rule_index": f"WITH {FINDINGS}, r AS (SELECT engine || '/' || rule AS rule, min(ordinal) AS o FROM f GROUP BY 1) SELECT rule, row_number() OVER (ORDER BY o) - 1 AS rule_index FROM r",
    "changed_line_semijoin": "SELECT l_linenumber AS line, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem i WHERE EXISTS (SELECT 1 FROM lineitem a WHERE a.l_quantity > 45 AND a.l_orderkey = i.l_orderkey AND a.l_linenumber = i.l_linenumber) GROUP BY 1",
    "score_trend": f"""WITH d AS (SELECT event_type AS label, day(ts) AS o, (sum(floor(value)::BIGINT) % 120 - 10)::INT AS score FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o DESC) AS k FROM d)
SELECT label, max_by(score, o) AS last, string_agg(substr('{_TICKS}', least(7, greatest(0, score) * 7 // 100)::INT + 1, 1), '' ORDER BY o) AS trend FROM r WHERE k <= 12 GROUP BY label""",
    "report_rows": f"WITH {FINDINGS} SELECT file_path, ordinal, row_number() OVER (PARTITION BY file_path ORDER BY line, rule, ordinal) AS position FROM f",
}
