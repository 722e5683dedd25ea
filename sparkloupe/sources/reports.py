"""Reports of other tools, score history and the vector cache as relations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloupe.sources import files

_DEAD_CODE_LINE = r"^(.+?):([0-9]+): (.+?) \(([0-9]+)% confidence(?:, [0-9]+ lines?)?\)\s*$"


def dead_code_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """(file, line, message, confidence) of `path:line: message (n% confidence)` lines; others are ignored."""
    part = lambda k: F.regexp_extract(column, _DEAD_CODE_LINE, k)
    return lines.where(F.rlike(column, F.lit(_DEAD_CODE_LINE))).select(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).alias("message"), part(4).cast("int").alias("confidence"))


#: Codes of the JavaScript linter and our rules; no code means a parse failure.
LINT_RULES = {
    "eslint(no-unused-vars)": ("javascript/unused-variable", "warning"), "eslint(no-unreachable)": ("javascript/unreachable", "error"),
    "eslint(no-empty)": ("javascript/empty-block", "warning"), None: ("javascript/parse-error", "error"),
}


class ReportError(ValueError):
    """A report that does not keep to its protocol; no row of it is used."""


def _strict(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ReportError("a key occurs twice")
    return out


def lint_report(spark: SparkSession, reply: str, files: list[str], sources: dict[str, bytes] | None = None) -> DataFrame:
    """Findings of one linter reply over a batch of files; the whole reply is validated before any row is used."""
    try:
        data = json.loads(reply, object_pairs_hook=_strict)
    except json.JSONDecodeError as error:
        raise ReportError(f"not JSON: {error}") from error
    if not isinstance(data, dict) or not isinstance(data.get("diagnostics"), list) or data.get("number_of_files") != len(files):
        raise ReportError("diagnostics or number_of_files is wrong")
    rows = []
    for item in data["diagnostics"]:
        if not isinstance(item, dict) or item.get("filename") not in files or item.get("code") not in LINT_RULES or not isinstance(item.get("message"), str):
            raise ReportError("a diagnostic names another file or code")
        spans = item.get("labels")
        where = spans[0].get("span") if isinstance(spans, list) and spans and isinstance(spans[0], dict) else None
        numbers = [where.get(k) for k in ("line", "column", "offset", "length")] if isinstance(where, dict) else [None]
        if not all(type(n) is int and n >= 0 for n in numbers) or numbers[0] < 1 or numbers[1] < 1:
            raise ReportError("a span is wrong")
        if sources is not None and numbers[2] + numbers[3] > len(sources[item["filename"]]):
            raise ReportError("a span lies outside its file")
        rule, severity = LINT_RULES[item.get("code")]
        rows.append((item["filename"], "code-quality", rule, severity, item["message"], numbers[0], numbers[1]))
    return spark.createDataFrame(rows, "file_path string, engine string, rule string, severity string, message string, line int, col int")


#: What the exit codes of a mutation run stand for; others are suspicious, no code is a mutant not checked.
EXIT_STATUS = {
    0: "survived", 1: "killed", 2: "check_was_interrupted_by_user", 3: "killed", 5: "no_tests", 24: "timeout", 33: "no_tests", 34: "skipped", 35: "suspicious", 36: "timeout", 152: "timeout", 255: "timeout",
    -24: "timeout", -11: "segfault", -9: "segfault",
}


def mutation_metadata(spark: SparkSession, root: str, statuses: dict[int, str] | None = None) -> DataFrame:
    """(path, mutant, status) of the metadata files (`*.meta`, JSON with exit_code_by_key) below a mutation run's folder.

    A file that is no JSON, or without mutants, has no rows.
    """
    metas = files.tree(spark, root, ["."], (".meta",))
    codes = F.from_json("source", "exit_code_by_key map<string,int>")["exit_code_by_key"]
    rows = metas.select(F.regexp_replace("path", r"\.meta$", "").alias("path"), F.explode(codes).alias("mutant", "code"))
    known = F.create_map(*(F.lit(x) for pair in (statuses or EXIT_STATUS).items() for x in pair))
    status = F.when(F.col("code").isNull(), "not_checked").otherwise(F.coalesce(F.try_element_at(known, "code"), F.lit("suspicious")))
    return rows.select("path", "mutant", status.alias("status"))


HISTORY = T.StructType([T.StructField(n, t) for n, t in (("timestamp", T.StringType()), ("score", T.LongType()), ("label", T.StringType()), ("errors", T.LongType()), ("warnings", T.LongType()), ("info", T.LongType()), ("files", T.LongType()), ("_broken", T.StringType()))])


def history(spark: SparkSession, path: str) -> DataFrame:
    """Score records of JSON lines in file order (ordinal); blank and broken lines are left out, missing counts are 0."""
    place = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("k"))
    lines = spark.read.text(path, wholetext=False).select("value", place.alias("ordinal"))  # the splits of a file in order, the files by their time
    parsed = lines.where(F.trim("value") != "").select("ordinal", F.from_json("value", HISTORY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    good = parsed.where(F.col("r._broken").isNull() & F.col("r.score").isNotNull() & F.col("r.timestamp").isNotNull())
    zero = lambda c: F.coalesce(F.col("r." + c), F.lit(0)).alias(c)
    return good.select("ordinal", "r.timestamp", F.try_to_timestamp("r.timestamp").alias("at"), "r.score", "r.label", *map(zero, ("errors", "warnings", "info", "files")))


def append_history(record: DataFrame, path: str) -> None:
    record.select("timestamp", "score", "label", "errors", "warnings", "info", "files").coalesce(1).write.mode("append").json(path)


def store_vectors(vectors: DataFrame, identity: str, path: str) -> None:
    """Appends unit vectors as (identity, sha, vec, stored_at) to the cache, each source once; similarity.cached_vectors reads the last."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    good = vectors.where(F.abs(norm - 1) <= 1e-3).dropDuplicates(["sha"])
    good.select(F.lit(identity).alias("identity"), "sha", "vec", F.unix_micros(F.current_timestamp()).alias("stored_at")).write.mode("append").partitionBy("identity").parquet(path)
