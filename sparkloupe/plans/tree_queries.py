"""Queries on syntax trees over the fixture, with the expected rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.operators import diff, graph, pysources
from sparkloupe.plans import fixture


def py_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pysources.kept_findings(pysources.parse(fixture.files(spark))).select("file_path", "rule", "line")


def py_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pysources.redundancies(pysources.parse(fixture.files(spark))).where("file_path = 'src/app/same.py'").select("line", "redundancy")


def py_dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture.files(spark)
    entries = spark.createDataFrame([("app.util", "run")], "dotted string, symbol string")
    dead = pysources.dead_symbols(files, pysources.parse(files), entries)
    return dead.where("file IN ('src/app/core.py', 'src/app/util.py')").select("symbol", "class")


def py_import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = pysources.parse(fixture.files(spark)).where("path LIKE 'src/%'")
    return graph.cycles(pysources.import_edges(parsed)).select("key")


def py_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions per file, with the bytes that their sources span."""
    funcs = pysources.functions(pysources.parse(fixture.files(spark)))
    whole = F.octet_length("source") == F.col("end_byte") - F.col("start_byte")
    return funcs.groupBy("file").agg(F.count("*").alias("n"), F.min(whole.cast("int")).alias("spans_fit"))


def py_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture.files(spark).where("path <> 'src/app/bad.py'")
    rows = diff.growth(pysources.size_snapshot(files.where("path LIKE '%/core.py'")), pysources.size_snapshot(files.where("path LIKE '%/flow.py' OR path LIKE '%/core.py'")), ["lines", "functions", "classes", "short_functions", "imports"])
    return rows.select("metric", "before", "after", "delta")


def py_mutation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.createDataFrame([("a.py", "x = 1  # old\n"), ("b.py", "def f():\n    return 1\n"), ("c.py", "y = 2\n")], "path string, source string")
    head = spark.createDataFrame([("a.py", "x = 1\n# new\n"), ("b.py", "def f(z=0):\n    return 1\n"), ("c.py", "y = 2\n"), ("d.py", "")], "path string, source string")
    return pysources.mutation_targets(pysources.parse(base), pysources.parse(head))


QUERIES = {f.__name__: f for f in (py_detectors, py_redundancy, py_dead_symbols, py_import_cycles, py_functions, py_growth, py_mutation_targets)}


def _rows(rows, names: str) -> str:
    quoted = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) t({names})"


SQL = {
    "py_detectors": _rows(fixture.FINDINGS, "file_path, rule, line"),
    "py_redundancy": _rows(fixture.REDUNDANCIES, "line, redundancy"),
    "py_dead_symbols": _rows(fixture.DEAD, "symbol, class"),
    "py_import_cycles": _rows([(k,) for k in fixture.CYCLES], "key"),
    "py_functions": _rows([("src/app/core.py", 6, 1), ("src/app/flow.py", 5, 1), ("src/app/forward.py", 6, 1), ("src/app/models.py", 3, 1), ("src/app/util.py", 4, 1), ("tests/test_core.py", 1, 1)], "file, n, spans_fit"),
    "py_growth": _rows([("lines", 29, 83, 54), ("functions", 6, 11, 5), ("classes", 0, 0, 0), ("short_functions", 6, 7, 1), ("imports", 3, 3, 0)], "metric, before, after, delta"),
    "py_mutation_targets": _rows([("b.py",), ("d.py",)], "path"),
}
