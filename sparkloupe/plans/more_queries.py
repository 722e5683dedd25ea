"""Queries of operators that no other registered query runs, with their SQL or, over literal rows, the expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloupe.operators import diff, findings, pysources, similarity
from sparkloupe.operators.rules import MAX_FILE_LINES, MAX_FUNCTION_LINES
from sparkloupe.plans import fixture
from sparkloupe.plans.common import EVENT_FINDINGS_SQL, event_findings, table
from sparkloupe.plans.tree_queries import _rows
from sparkloupe.sources import reports

_LOOP = """
def {name}({arg}):
    {total} = 0
    for {item} in {arg}:
        if {item}.price > 10 and {item}.active:
            {total} += {item}.price * {item}.count
        elif {item}.fallback:
            {total} -= {item}.discount
    return round({total}, 2)
"""
CLONE_FILES = {
    "src/a.py": _LOOP.format(name="alpha", arg="rows", total="total", item="row"),
    "src/b.py": _LOOP.format(name="beta", arg="lines", total="acc", item="line"),
    "src/c.py": _LOOP.format(name="gamma", arg="xs", total="t", item="x").replace("price", "weight").replace("discount", "tare"),
    "src/d.py": "def plain(a):\n    return [a, 1, 2, 3]  # short\n",
}


def _functions(spark: SparkSession) -> DataFrame:
    return pysources.functions(pysources.parse(spark.createDataFrame(list(CLONE_FILES.items()), "path string, source string")))


def py_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar functions: a renamed copy is equal, one with other attributes only alike."""
    found = similarity.overlaps(_functions(spark), min_tokens=20, api_gate=0.2, threshold=0.5)
    return found.select("a_symbol", "b_symbol", (F.col("struct") == 1).alias("same_struct"), (F.col("api") == 1).alias("same_api"))


def py_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([("src/b.py", 2), ("src/c.py", 2), ("src/d.py", 1)], "file string, line int")
    return pysources.clones(_functions(spark), added, min_tokens=20).select("a_file", "a_symbol", "b_file", "b_symbol")


def py_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pysources.by_language(_functions(spark), 20)


def py_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings and comments blanked, offsets kept."""
    files = spark.createDataFrame([("m.py", "x = 'ab'  # note\ny = 1\n"), ("n.py", "def f(:\n 'x\n"), ("o.py", None)], "path string, source string")
    return pysources.masked(files).select("path", F.length("masked").alias("n"), F.contains("masked", F.lit("ab")).alias("text_left"), F.contains("masked", F.lit("y = 1")).alias("code_left"))


def py_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("m.py", "# one\nx = 1  # two\ny = '# no'\n")], "path string, source string")
    return pysources.comments(pysources.parse(files)).select("line", "col", "inline")


def path_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls below some hosts and sections, compared by whole parts."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    hosts = pages.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("prefix"), "page_id").where("page_id < 40").select("prefix")
    return diff.below(pages, hosts).select("page_id", "path")


def unselected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls below the hosts of some pages, without the urls of these pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    some = pages.where("page_id < 40")
    return diff.unselected(pages, some.select(F.substring_index("path", "/", 1).alias("prefix")), some).select("page_id", "path")


def mapped_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests by the longest mapped prefix; here every path has one."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src/"), F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)).alias("path"))
    mapping = spark.createDataFrame([("src", "all"), ("src/en", "english"), ("src/de", "german")], "prefix string, tests string")
    found = diff.test_roots(pages.select("path").distinct(), mapping)
    return pages.join(found, "path").select("page_id", "tests")


def dead_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dead-code report of text lines made of suppliers; lines of another form do not count."""
    s = table(spark, sf_dir, "supplier")
    line = F.concat(F.lit("src/n"), "s_nationkey", F.lit(".py:"), F.col("s_suppkey") % 90 + 1, F.lit(": unused function '"), "s_name", F.lit("' ("), F.col("s_suppkey") % 41 + 60, F.lit("% confidence)"))
    broken = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("note: "), "s_name")).otherwise(line)
    return reports.dead_code_report(s.select(broken.alias("value")))


def path_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two sets of nations: of rich customers and of suppliers."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.col("s_nationkey").alias("n"))
    named = lambda df, name: df.select(F.lit(name).alias("op"), "n")
    return named(a.union(b).distinct(), "union").union(named(a.intersect(b), "intersect")).union(named(a.exceptAll(b).distinct().join(b, "n", "left_anti"), "except"))


def terminal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each finding of a file in the terminal report: engine, severity, line."""
    rank = findings.mapped(F.col("severity"), findings.SEVERITY_RANK, 3)
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("engine", rank, "line", "ordinal"))
    return event_findings(spark, sf_dir).select("file_path", "ordinal", place.alias("position"))


def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score of neighbouring documents from the length ceiling and the words that they share."""
    words = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("w"))
    pairs = words.join(words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id")
    ceiling = similarity.ratio_ceiling(F.col("w"), F.col("v"))
    share = F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v"))
    return pairs.select("doc_id", F.round(ceiling, 6).alias("ceiling"), F.round(similarity.combined(ceiling, share), 6).alias("combined"))


def sequence_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of literal sequences; the measure depends on the order of its arguments."""
    rows = [("abcd", "bcde"), ("tide", "diet"), ("diet", "tide"), ("", ""), ("a", ""), ("xaxbxc", "abc"), ("abxcd", "abcd")]
    df = spark.createDataFrame([(x, y, list(x), list(y)) for x, y in rows], "x string, y string, a array<string>, b array<string>")
    return df.withColumn("ratio", F.round(similarity.sequence_ratio("a", "b"), 6)).select("x", "y", "ratio")


def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's encoder over batches of texts: even lengths one way, odd ones the other."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("sha"), F.col("text").alias("source"))
    found = similarity.encode(docs, lambda texts: [[1.0, 0.0] if len(t) % 2 == 0 else [0.0, 1.0] for t in texts])
    return found.select("sha", F.element_at("vec", 1).cast("double").alias("even"))


def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid vector of each text under one identity."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    unit = F.when(F.col("event_id") % 4 == 0, F.array(F.lit(2.0), F.lit(0.0))).when(F.col("event_id") % 4 == 1, F.array(F.lit(0.6), F.lit(0.8))).when(F.col("event_id") % 4 == 2, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0)))
    cache = e.select(F.when(F.col("event_type") == "click", "model").otherwise("other").alias("identity"), F.col("user_id").cast("string").alias("sha"), unit.alias("vec"), F.col("event_id").alias("stored_at"))
    return similarity.cached_vectors(cache, "model", 2).select("sha", F.element_at("vec", 1).alias("x"))


def py_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one fingerprint: renaming does not count, other attributes do."""
    return _functions(spark).groupBy(F.sha2(F.array_join("tokens", " "), 256).alias("h")).agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols")).select("symbols")


def py_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that parse and files that do not."""
    parsed = pysources.parse(fixture.files(spark))
    bad = parsed.where("a = 'deadcode/parse-error'").select("path").distinct()
    files = fixture.files(spark).select("path")
    return files.join(bad.withColumn("failed", F.lit(1)), "path", "left").agg(F.count("*").alias("files"), F.count("failed").alias("failed"))


#: A function of one line more than the limit, one of the limit, a file of one line more than the limit, and two dynamic imports.
SIZE_FILES = {
    "src/long.py": "def wide(a):\n" + "".join(f"    a = a * {k}\n" for k in range(2, MAX_FUNCTION_LINES + 2)) + "    return a\n",
    "src/fits.py": "def fits(a):\n" + "".join(f"    a = a * {k}\n" for k in range(2, MAX_FUNCTION_LINES + 1)) + "    return a\n",
    "src/large.py": "".join(f"V{k} = {k}\n" for k in range(MAX_FILE_LINES + 1)),
    "src/dyn.py": "import importlib\n\nm = importlib.import_module(input())\nn = __import__(m.name)\n",
}
_SIZE_RULES = ("code-quality/function-too-long", "code-quality/file-too-large", "security/dynamic-import")


def py_size_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of functions and files, each on its edge, and dynamic imports."""
    files = spark.createDataFrame(list(SIZE_FILES.items()), "path string, source string")
    return pysources.kept_findings(pysources.parse(files)).where(F.col("rule").isin(*_SIZE_RULES)).select("file_path", "rule", "line")


def py_dead_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead symbols as findings: orphaned and test-only ones."""
    files = fixture.files(spark)
    entries = spark.createDataFrame([("app.util", "run")], "dotted string, symbol string")
    dead = pysources.dead_symbols(files, pysources.parse(files), entries)
    return pysources.dead_findings(dead.where("file = 'src/app/core.py'")).select("rule", "file_path", "detail")


QUERIES = {
    f.__name__: f
    for f in (
        py_overlaps, py_clones, py_by_language, py_masked, py_comments, path_roots, unselected_paths, mapped_tests, dead_report_lines, path_sets, terminal_order, combined_score, sequence_ratios, encoded_texts, cached_vectors, py_fingerprints,
        py_coverage, py_size_rules, py_dead_findings,
    )
}

SQL = {
    "py_size_rules": _rows([("src/long.py", "code-quality/function-too-long", 1), ("src/large.py", "code-quality/file-too-large", 1), ("src/dyn.py", "security/dynamic-import", 3), ("src/dyn.py", "security/dynamic-import", 4)], "file_path, rule, line"),
    "py_dead_findings": _rows([("reachability/dead-symbol", "src/app/core.py", f"{kind} {name}") for name, kind in fixture.DEAD if kind in ("orphaned", "test-only")], "rule, file_path, detail"),
    "py_overlaps": _rows([("alpha", "beta", True, True), ("alpha", "gamma", False, False), ("beta", "gamma", False, False)], "a_symbol, b_symbol, same_struct, same_api"),
    "py_clones": _rows([("src/b.py", "beta", "src/a.py", "alpha")], "a_file, a_symbol, b_file, b_symbol"),
    "py_by_language": _rows([("python", 4, 3)], "language, functions, eligible"),
    "py_masked": "SELECT * FROM (VALUES ('m.py', 23, false, true), ('n.py', NULL, NULL, NULL), ('o.py', NULL, NULL, NULL)) t(path, n, text_left, code_left)",
    "py_comments": _rows([(1, 0, False), (2, 7, True)], "line, col, inline"),
    "path_roots": r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), h AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS prefix FROM p WHERE page_id < 40)
SELECT page_id, path FROM p WHERE EXISTS (SELECT 1 FROM h WHERE path = prefix OR starts_with(path, prefix || '/'))""",
    "unselected_paths": r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM p WHERE string_split(path, '/')[1] IN (SELECT string_split(path, '/')[1] FROM p WHERE page_id < 40) AND path NOT IN (SELECT path FROM p WHERE page_id < 40)""",
    "mapped_tests": r"""SELECT page_id, CASE regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'all' END AS tests FROM pages""",
    "dead_report_lines": """SELECT 'src/n' || s_nationkey || '.py' AS file, (s_suppkey % 90 + 1)::INT AS line, 'unused function ' || chr(39) || s_name || chr(39) AS message, (s_suppkey % 41 + 60)::INT AS confidence FROM supplier WHERE s_suppkey % 7 <> 0""",
    "path_sets": """WITH a AS (SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9000), b AS (SELECT s_nationkey AS n FROM supplier WHERE s_acctbal > 2000)
SELECT 'union' AS op, n FROM (SELECT n FROM a UNION SELECT n FROM b) UNION ALL SELECT 'intersect', n FROM (SELECT n FROM a INTERSECT SELECT n FROM b) UNION ALL SELECT 'except', n FROM (SELECT n FROM a EXCEPT SELECT n FROM b)""",
    "terminal_order": f"""WITH {EVENT_FINDINGS_SQL} SELECT file_path, ordinal, row_number() OVER (PARTITION BY file_path ORDER BY engine, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, line, ordinal) AS position FROM f""",
    "combined_score": """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT a.doc_id, a.w, b.w AS v FROM w a JOIN w b ON b.doc_id = a.doc_id + 1), q AS (SELECT doc_id, 2.0 * least(len(w), len(v)) / (len(w) + len(v)) AS c, len(list_distinct(list_intersect(w, v)))::DOUBLE AS c2, len(list_distinct(list_concat(w, v))) AS whole FROM p)
SELECT doc_id, round(c::DOUBLE, 6) AS ceiling, round(0.6 * c::DOUBLE + 0.4 * c2 / whole, 6) AS combined FROM q""",
    "sequence_ratios": _rows([("abcd", "bcde", 0.75), ("tide", "diet", 0.25), ("diet", "tide", 0.5), ("", "", 1.0), ("a", "", 0.0), ("xaxbxc", "abc", 0.666667), ("abxcd", "abcd", 0.888889)], "x, y, ratio").replace("0.75)", "0.75::DOUBLE)"),
    "encoded_texts": "SELECT doc_id::VARCHAR AS sha, CASE WHEN length(text) % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS even FROM documents WHERE text IS NOT NULL",
    "cached_vectors": """SELECT user_id::VARCHAR AS sha, max_by(CASE event_id % 4 WHEN 1 THEN 0.6 ELSE 1.0 END::DOUBLE, event_id) AS x FROM events WHERE event_type = 'click' AND event_id % 4 IN (1, 2) GROUP BY user_id""",
    "py_fingerprints": _rows([("alpha,beta",), ("gamma",), ("plain",)], "symbols"),
    "py_coverage": f"SELECT {len(fixture.FILES)}::BIGINT AS files, 1::BIGINT AS failed",
}
