"""Python sources as relations: one parse per file on the executors, everything after it is relational."""

from __future__ import annotations

import ast
import hashlib
import tokenize
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloupe.functions import jssource, pysource, text
from sparkloupe.functions.pysource import Source
from sparkloupe.operators import diff, findings, graph, reach, rules, similarity

_FIELDS = (("path", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("ordinal", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("d", pa.string()), ("x", pa.list_(pa.string())), ("y", pa.list_(pa.string())), ("m", pa.int64()), ("n", pa.int64()))
_SCHEMA = pa.schema(_FIELDS)
PARSED = "path string, kind string, line int, ordinal int, a string, b string, c string, d string, x array<string>, y array<string>, m bigint, n bigint"


def _function(f: dict) -> dict:
    return {"kind": "function", "a": f["symbol"], "line": f["line"], "b": f["source"], "x": f["tokens"], "y": f["semantic"], "m": f["start_byte"], "n": f["end_byte"]}


def _facts(path: str, source: str, dotted: str, is_test: bool) -> Iterator[dict]:
    """Tagged rows of one file; of JavaScript and TypeScript files only the functions."""
    if path.endswith(jssource.SUFFIXES):
        try:
            yield from map(_function, jssource.functions(source))
        except (jssource.JsError, KeyError, IndexError) as error:
            yield {"kind": "finding", "a": "javascript/parse-error", "line": 1, "b": str(error)}
        return
    try:
        parsed = Source(path, source, is_test)
        parsed.tokens  # noqa: B018 - tokenizing fails on what cannot be analysed
    except pysource.PARSE_FAILURES as error:
        yield {"kind": "finding", "a": "deadcode/parse-error", "line": getattr(error, "lineno", None) or 1, "b": str(getattr(error, "msg", error))}
        return
    except Exception as error:  # noqa: BLE001 - tokenizer errors have no common base
        yield {"kind": "finding", "a": "deadcode/parse-error", "line": 1, "b": str(error)}
        return
    for rule, line, detail in rules.check(parsed):
        yield {"kind": "finding", "a": rule, "line": line, "b": detail}
    for line, kind in rules.redundancies(parsed):
        yield {"kind": "redundancy", "a": kind, "line": line}
    for c in parsed.comments:
        yield {"kind": "comment", "a": c.body, "line": c.line, "m": c.column, "n": int(c.inline)}
    for scope, line, codes in pysource.suppressions(parsed):
        yield {"kind": "suppression", "a": scope, "line": line, "x": codes}
    yield from map(_function, pysource.functions(parsed))
    for kind, a, b, c in pysource.module_facts(parsed, dotted):
        yield {"kind": kind, "a": a, "b": b, "c": c, "d": dotted}
    yield {"kind": "digest", "a": hashlib.sha256(ast.dump(parsed.tree).encode()).hexdigest()}


def parse(files: DataFrame, import_roots: tuple[str, ...] = ("src",), test_roots: tuple[str, ...] = ("tests",)) -> DataFrame:
    """Tagged facts of files(path, source).  Persist it when more than one view is taken."""
    rows = files.select("path", F.coalesce("source", F.lit("")).alias("source"), text.dotted_name(F.col("path"), import_roots).alias("dotted"), text.is_test_path(F.col("path"), test_roots).alias("test"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = [{"path": row["path"], "ordinal": k, **fact} for k, fact in enumerate(_facts(row["path"], row["source"], row["dotted"], row["test"]))]
                out += own
            yield pa.RecordBatch.from_pylist([{name: r.get(name) for name, _ in _FIELDS} for r in out], _SCHEMA)

    return rows.mapInArrow(run, PARSED)


def rule_dimension(parsed: DataFrame) -> DataFrame:
    return parsed.sparkSession.createDataFrame([*rules.RULES], "rule string, engine string, severity string, category string, style boolean")


def raw_findings(parsed: DataFrame) -> DataFrame:
    """Findings with their rule's facts, before suppression."""
    hits = parsed.where("kind = 'finding'").select(F.col("path").alias("file_path"), F.col("a").alias("rule"), "line", F.col("b").alias("detail"), "ordinal")
    return hits.join(F.broadcast(rule_dimension(parsed)), "rule")


def directives(parsed: DataFrame) -> DataFrame:
    """Suppressions; of several on one line the last counts."""
    rows = parsed.where("kind = 'suppression'").select(F.col("path").alias("file"), F.col("a").alias("scope"), "line", F.col("x").alias("codes"), "ordinal")
    lines = rows.where("scope = 'line'").groupBy("file", "scope", "line").agg(F.max_by("codes", "ordinal").alias("codes"))
    return lines.unionByName(rows.where("scope = 'file'").drop("ordinal"))


def kept_findings(parsed: DataFrame) -> DataFrame:
    return findings.suppress(raw_findings(parsed), directives(parsed))


def comments(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'comment'").select("path", "line", F.col("m").cast("int").alias("col"), F.col("a").alias("body"), (F.col("n") == 1).alias("inline"))


def masked(files: DataFrame) -> DataFrame:
    """files(path, source) with strings and comments blanked, offsets kept; null where a file has no tokens to tell."""

    @F.pandas_udf("string")
    def blank(sources: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else pysource.masked(text)
            except (*pysource.PARSE_FAILURES, tokenize.TokenError):
                return None

        return sources.map(one)

    return files.select("path", blank("source").alias("masked"))


def by_language(funcs: DataFrame, min_tokens: int = 40) -> DataFrame:
    """(language, functions, eligible) of functions."""
    return funcs.groupBy("language").agg(F.count("*").alias("functions"), F.count_if(F.size("tokens") >= min_tokens).alias("eligible"))


def redundancies(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'redundancy'").select(F.col("path").alias("file_path"), "line", F.col("a").alias("redundancy"))


def functions(parsed: DataFrame) -> DataFrame:
    """Fingerprints; ordinal follows file and breadth-first place."""
    rows = parsed.where("kind = 'function'").select(
        F.col("path").alias("file"), "line", F.col("a").alias("symbol"), F.col("x").alias("tokens"), F.col("y").alias("semantic"), F.col("m").alias("start_byte"), F.col("n").alias("end_byte"),
        F.col("b").alias("source"), F.sha2("b", 256).alias("source_sha256"), F.when(F.rlike("path", F.lit(r"\.([cm]?[jt]s|[jt]sx)$")), "javascript").otherwise("python").alias("language"), F.col("ordinal").alias("place"),
    )
    # path and place as one text that sorts as the two do: corpus order without a sort, and never the same for two functions
    return rows.withColumn("ordinal", F.concat("file", F.lit("\x01"), F.lpad(F.col("place").cast("string"), 9, "0")))


def modules(parsed: DataFrame) -> dict[str, DataFrame]:
    """The relations that reach.resolved reads."""
    of = lambda kind: parsed.where(F.col("kind") == kind)
    dotted = F.col("d").alias("dotted")
    package = F.col("path").endswith("__init__.py").alias("is_package")
    return {
        "names": of("name").select(dotted, F.col("a").alias("name")),
        "attributes": of("attr").select(dotted, F.col("a").alias("base"), F.col("b").alias("attr")),
        "from_imports": of("from").select(dotted, package, F.col("a").alias("module"), F.col("b").alias("name"), F.col("c").alias("asname")),
        "stars": of("star").select(dotted, F.col("a").alias("module")),
        "imports": of("import").select(dotted, F.col("a").alias("module"), F.col("b").alias("asname")),
    }


def symbols(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("kind = 'def'")
    return rows.select(F.col("d").alias("dotted"), F.col("path").alias("file"), F.col("a").alias("symbol"), F.col("b").cast("int").alias("line"), (F.col("c") == "true").alias("decorated"))


def dead_symbols(files: DataFrame, parsed: DataFrame, entry_points: DataFrame, orphans_block: bool = False, test_roots: tuple[str, ...] = ("tests",)) -> DataFrame:
    """Classes of the definitions in runtime files that nothing resolves to; files: (path, source)."""
    test = text.is_test_path(F.col("path"), test_roots)
    runtime = parsed.where(~test)
    defined = symbols(runtime)
    linked = reach.resolved(modules(runtime), defined)
    open_ = defined.join(linked, ["dotted", "symbol"], "left_anti").select(F.col("symbol").alias("name")).distinct()
    texts = files.select(F.col("path").alias("file"), F.col("source").alias("text"), test.alias("test"))
    seen = reach.occurrence_index(open_, texts.where("NOT test"))
    tested = reach.occurrence_index(open_, texts.where("test"))
    return reach.classify(defined, linked, seen, tested, entry_points, orphans_block)


def dead_findings(classes: DataFrame) -> DataFrame:
    """Findings of the actionable classes."""
    rows = classes.where("rank <= 1")
    return rows.select(F.lit("reachability/dead-symbol").alias("rule"), F.col("file").alias("file_path"), "line", F.concat_ws(" ", "class", "symbol").alias("detail"))


def import_edges(parsed: DataFrame) -> DataFrame:
    """(src, dst) between the modules of the parsed files."""
    nodes = parsed.where("kind = 'digest'").select(text.dotted_name(F.col("path")).alias("dotted")).distinct()
    named = parsed.where("kind = 'from'").select(F.col("d").alias("src"), F.col("a").alias("module"), F.col("b").alias("name"))
    whole = parsed.where("kind IN ('import', 'star')").select(F.col("d").alias("src"), F.col("a").alias("module"), F.lit(None).cast("string").alias("name"))
    return graph.resolve_edges(named.union(whole), nodes)


def clones(funcs: DataFrame, added: DataFrame, *, threshold: float = 0.95, api_gate: float = 0.6, min_tokens: int = 40) -> DataFrame:
    """(i, j, struct, a_file, a_line, a_symbol, b_...): best near copy of each function whose def line was added, in corpus order
    on ties; symmetric pairs once.  added: (file, line)."""
    asks = funcs.join(added, (funcs["file"] == added["file"]) & (funcs["line"] == added["line"]), "left_semi").select(F.col("ordinal").alias("i"))
    found = similarity.clone_matches(funcs, asks, threshold=threshold, api_gate=api_gate, min_tokens=min_tokens)
    best = similarity.collapse_symmetric(similarity.best_match(found, "i", "struct", ["j"]), "i", "j", ["i"])
    side = lambda key, p: funcs.select(F.col("ordinal").alias(key), *(F.col(c).alias(p + c) for c in ("file", "line", "symbol")))
    return best.join(side("i", "a_"), "i").join(side("j", "b_"), "j")


def size_snapshot(files: DataFrame) -> DataFrame:
    """Size counts of files(path, source), unknown where a file does not parse."""
    names = ("lines", "functions", "classes", "short_functions", "imports")
    schema = T.StructType([T.StructField("path", T.StringType())] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [pysource.size_counts(s or "") for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[n] for c in counts], pa.int64()) for n in names)], names=["path", *names])

    return files.select("path", "source").mapInArrow(run, schema)


def mutation_targets(base: DataFrame, head: DataFrame) -> DataFrame:
    """Paths whose syntax tree is new or changed; both parsed."""
    digest = lambda p: p.where("kind = 'digest'").select("path", F.col("a").alias("digest"))
    return diff.changed_content(digest(base), digest(head), ["path"]).select("path")
