"""Findings as reports.  Rows are sorted by Spark; the text is assembled while rows stream to the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sparkloupe.operators import findings as ops

LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def _rows(df: DataFrame) -> Iterator[Row]:
    return df.toLocalIterator()


def _diagnostic(r: Row) -> dict:
    row = r.asDict()
    message = row.get("message") or row.get("detail") or row["rule"]
    return {
        "filePath": row["file_path"], "engine": row["engine"], "rule": row["rule"], "severity": row["severity"], "message": message, "line": row["line"], "column": row.get("col") or 1,
        "help": row.get("help") or "", "category": row.get("category") or "", "fixable": bool(row.get("fixable")), "detail": row.get("detail"),
    }


def to_json(found: DataFrame, score: int, label: str, files_scanned: int | None = None, coverage: dict | None = None) -> str:
    """Versioned envelope: counts by engine, summary and the findings by file, line and rule."""
    engines = {r.engine: r.n for r in ops.engine_counts(found).orderBy("engine").collect()}
    total = ops.summary(found).first().asDict()
    body = {"schemaVersion": "1", "files_scanned": files_scanned, "score": score, "label": label, "engines": engines, "summary": {k: total[k] for k in ("errors", "warnings", "info", "files", "total")}}
    body["diagnostics"] = [_diagnostic(r) for r in _rows(ops.report_order(found))]
    return json.dumps(body | ({"coverage": coverage} if coverage else {}), indent=2, ensure_ascii=False)


def to_sarif(found: DataFrame, name: str = "sparkloupe") -> str:
    """SARIF 2.1.0; rules in order of first appearance (ordinal)."""
    index = {r["rule"]: r["rule_index"] for r in ops.rule_index(found).collect()}
    results = [
        {
            "ruleId": r["rule"], "ruleIndex": index[r["rule"]], "level": LEVELS[r["severity"]], "message": {"text": r["detail"] or r["rule"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file_path"]}, "region": {"startLine": max(1, r["line"]), "startColumn": 1}}}],
        }
        for r in _rows(ops.report_order(found))
    ]
    rules = [{"id": rule, "name": rule, "shortDescription": {"text": rule}} for rule in sorted(index, key=index.get)]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": name, "rules": rules}}, "results": results}]}, indent=2)


def to_terminal(found: DataFrame, score: int, label: str) -> str:
    """Grouped by engine, worst severity first."""
    rank = ops.mapped(F.col("severity"), ops.SEVERITY_RANK, 3)
    out, engine = [], None
    for r in _rows(found.withColumn("_r", rank).orderBy("engine", "_r", "file_path", "line")):
        if r.engine != engine:
            engine = r.engine
            out.append(f"\n[{engine}]")
        out.append(f"  {r.severity:<7} {r.file_path}:{r.line}  {r['rule']}" + (f"  {r.detail}" if r.detail else ""))
    total = ops.summary(found).first()
    return "\n".join([*out, "", f"score {score} ({label}): {total.errors} errors, {total.warnings} warnings, {total.info} notes in {total.files} files"]).lstrip("\n")


def to_prompt(found: DataFrame) -> str:
    """A hand-off list by file and line."""
    lines = [f"- {r.file_path}:{r.line} [{r['rule']}] {r.detail or ''}".rstrip() for r in _rows(found.orderBy("file_path", "line"))]
    return "\n".join(["Fix the following findings, one by one, without changing behaviour:", *lines])


def paths(names: list[str], nul: bool = False) -> str:
    return "".join(n + ("\0" if nul else "\n") for n in names)
