"""Command line: python -m sparkloupe.cli COMMAND.  Exit 0: fine or advisory, 1: a gate failed, 2: an operational error."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.functions import jssource, text
from sparkloupe.operators import diff, findings, graph, pysources, rules, similarity
from sparkloupe.session import local_session, release
from sparkloupe.sinks import reports as sinks
from sparkloupe.sources import config, files, reports

HISTORY = "quality-history.jsonl"


class Run:
    """One invocation: root, configuration, session and the parsed tree."""

    def __init__(self, args: argparse.Namespace, plain: bool = False) -> None:
        self.args, self.root = args, os.path.abspath(args.root)
        own = config.load(os.path.join(self.root, args.config))
        self.config = config.Config(source_roots=own.source_roots, import_roots=own.import_roots, test_roots=own.test_roots) if plain else own
        self.spark: SparkSession = local_session(app="sparkloupe-cli")
        self.spark.sparkContext.setLogLevel("ERROR")

    def tree(self, paths: list[str] | None = None, tests: bool = False, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
        roots = paths or [r for r in self.config.source_roots if os.path.exists(os.path.join(self.root, r))] + ([r for r in self.config.test_roots if os.path.exists(os.path.join(self.root, r))] if tests else [])
        if not roots:
            raise FileNotFoundError("no source root exists")
        found = files.tree(self.spark, self.root, roots, suffixes, keep_tests=bool(paths) or tests, test_roots=tuple(self.config.test_roots), explicit=bool(paths))
        return files.without(found, self.config.exclude)

    def parse(self, tree: DataFrame) -> DataFrame:
        return pysources.parse(tree, tuple(self.config.import_roots), tuple(self.config.test_roots)).persist()

    def dead(self, orphans_block: bool = False) -> DataFrame:
        whole = self.tree(tests=True).persist()
        entries = self.spark.createDataFrame(config.entry_points(os.path.join(self.root, "pyproject.toml")), "dotted string, symbol string")
        return pysources.dead_symbols(whole, self.parse(whole), entries, orphans_block, tuple(self.config.test_roots))

    def sources(self, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
        """The files of a scan: targets, else changed runtime files below the source roots, else these roots."""
        args = self.args
        if not args.changed:
            return self.tree(args.paths, suffixes=suffixes)
        roots = [r.rstrip("/") for r in self.config.source_roots]
        names = [p for p in files.changed_files(self.root, args.compare_branch, suffixes) if any(r == "." or p == r or p.startswith(r + "/") for r in roots)]
        found = files.without(files.tree(self.spark, self.root, names, suffixes, explicit=True), self.config.exclude)
        return found.where(~text.is_test_path(F.col("path"), tuple(self.config.test_roots)))

    def scan(self) -> tuple[DataFrame, int, int, str, dict[str, int] | None]:
        """Findings, number of files, score, label, and the files of each language where a linter's report covers more than one."""
        args = self.args
        tree = self.sources().persist()
        n, coverage = tree.count(), None
        if args.lint_report:
            scripts = sorted(r.path for r in self.sources(jssource.SUFFIXES).select("path").collect())
            with open(args.lint_report, encoding="utf-8") as f:
                lint = reports.lint_report(self.spark, f.read(), scripts)
            coverage = {"python": n, "javascript_typescript": len(scripts)} if scripts else None
            n += len(scripts)
        if not n and not args.changed:
            raise ValueError("no source files found; check the paths and source roots")
        parsed = self.parse(tree)
        found = pysources.kept_findings(parsed).select("file_path", "rule", "line", "detail", "engine", "severity", "category", "style", "ordinal")
        place = F.concat(F.col("place"), F.lit("\x01"), F.lpad(F.col("ordinal").cast("string"), 9, "0"))  # the order of files, then in each
        found = found.join(tree.select(F.col("path").alias("file_path"), F.col("ordinal").alias("place")), "file_path").withColumn("ordinal", place).drop("place")
        dead = pysources.dead_findings(self.dead()).join(tree.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        dead = dead.join(F.broadcast(pysources.rule_dimension(parsed)), "rule").withColumn("ordinal", F.lit("\uffff"))
        found = found.unionByName(dead)
        if args.lint_report:
            late = F.concat(F.lit("\uffff"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
            found = found.unionByName(lint.select("file_path", "rule", "line", F.col("message").alias("detail"), "engine", "severity", F.lit("JavaScript quality").alias("category"), F.lit(False).alias("style"), late.alias("ordinal")))
        found = findings.override_severity(found, self.config.overrides(self.spark)).persist()
        total = self.spark.createDataFrame([(n,)], "n_files int")
        row = findings.health_score(found, total, [], self.config.weights, self.config.smoothing).first()
        label = "Healthy" if found.isEmpty() else "Healthy" if row.score >= self.config.healthy else "Needs Work" if row.score >= self.config.needs_work else "Critical"
        return found, n, row.score, label, coverage


def scan(args: argparse.Namespace) -> int:
    run = Run(args)
    found, n, score, label, coverage = run.scan()
    if args.json:
        print(sinks.to_json(found, score, label, n, coverage))
    elif args.sarif:
        print(sinks.to_sarif(found))
    elif args.prompt:
        print(sinks.to_prompt(found))
    else:
        print(sinks.to_terminal(found, score, label))
        if not args.no_history:
            total = findings.summary(found).first()
            record = {"timestamp": datetime.now(UTC).isoformat(timespec="seconds"), "score": score, "label": label, "errors": total.errors, "warnings": total.warnings, "info": total.info, "files": n}
            with open(os.path.join(run.root, HISTORY), "a", encoding="utf-8") as f:
                f.write(json.dumps(record) + "\n")
    return 0


def ci(args: argparse.Namespace) -> int:
    run = Run(args)
    found, n, score, label, coverage = run.scan()
    print(sinks.to_json(found, score, label, n, coverage) if args.json else sinks.to_terminal(found, score, label))
    floor = args.fail_below if args.fail_below is not None else run.config.fail_below or 0
    return int(findings.gate_failed(found) or score < floor)


def list_rules(args: argparse.Namespace) -> int:
    for rule, engine, severity, category, style in sorted(rules.RULES):
        print(f"{rule:<34} {engine:<13} {severity:<8} {category}{' [style]' if style else ''}")
    return 0


def security(args: argparse.Namespace) -> int:
    """Security rules and swallowed errors, whatever the configuration says about severities."""
    run = Run(args, plain=True)
    if any(not os.path.exists(os.path.join(run.root, p)) for p in args.paths):
        print("the target does not exist", file=sys.stderr)
        return 1
    tree = run.tree(args.paths).where(F.col("path").endswith(".py")).persist()
    if tree.isEmpty():
        print("no Python files", file=sys.stderr)
        return 1
    own = F.col("rule").startswith("security/") | F.col("rule").isin("ai-slop/swallowed-exception", "ai-slop/redundant-try-catch") | F.col("rule").startswith("deadcode/")
    found = pysources.kept_findings(run.parse(tree)).where(own).persist()
    row = findings.health_score(found, run.spark.createDataFrame([(tree.count(),)], "n_files int"), []).first()
    print(sinks.to_terminal(found, row.score, row.label))
    return int(findings.gate_failed(found))


def trend(args: argparse.Namespace) -> int:
    run = Run(args)
    path = os.path.join(run.root, HISTORY)
    if not os.path.exists(path):
        print("no score history yet")
        return 0
    records = reports.history(run.spark, path).withColumn("all", F.lit(1))
    rows = sorted(diff.last_records(records, args.limit, ["all"]).collect(), key=lambda r: r.ordinal)
    line = run.spark.range(1).select(text.sparkline(F.array(*(F.lit(r.score) for r in rows)))).first()[0] if rows else ""
    print(f"score trend (last {len(rows)}):  {line}")
    for r in rows:
        print(f"  {r.timestamp}  {r.score:>3}/100  {r.label:<11} (E{r.errors} W{r.warnings} I{r.info}, {r.files} files)")
    return 0


def overlaps(args: argparse.Namespace) -> int:
    run = Run(args)
    funcs = pysources.functions(run.parse(run.tree(args.paths, suffixes=(".py", *jssource.SUFFIXES)))).persist()
    n, eligible = funcs.count(), funcs.where(F.size("tokens") >= args.min_tokens).count()
    if not eligible:
        raise ValueError("no functions to compare")
    pairs = similarity.overlaps(funcs, min_tokens=args.min_tokens, threshold=args.threshold).persist()
    ordered = pairs.withColumns({c: F.bround(c, 3) for c in ("combined", "struct", "api")}).orderBy(F.desc("combined"), "a_file", "a_symbol", "b_file", "b_symbol")
    rows = (ordered.limit(args.top) if args.top > 0 else ordered).collect()
    second = []
    if args.vectors:
        near = second_pass(run.spark, funcs, pairs, args.vectors, args.min_tokens, args.identity).orderBy(F.desc("embed"), "a_file", "a_symbol", "b_file", "b_symbol")
        second = (near.limit(args.top) if args.top > 0 else near).collect()
    if args.json:
        print(json.dumps({"threshold": args.threshold, "count": len(rows), "pairs": [{k: v for k, v in r.asDict().items() if k not in ("i", "j")} for r in rows], "functions_scanned": n, "functions_compared": eligible, "pairs_above_threshold": pairs.count(), "min_tokens": args.min_tokens, "embed_active": bool(args.vectors), "embed_count": len(second), "embed_pairs": [r.asDict() for r in second]}, indent=2))
    else:
        print(f"{len(rows)} pairs at {args.threshold} or more")
        for r in rows:
            print(f"  {r.combined:<6} {r.a_file} '{r.a_symbol}'  <->  {r.b_file} '{r.b_symbol}'   [struct {r.struct} api {r.api}]")
        for r in second:
            print(f"  {r.embed:<6} {r.a_file} '{r.a_symbol}'  <->  {r.b_file} '{r.b_symbol}'   [vectors only]")
    return 0


def second_pass(spark: SparkSession, funcs: DataFrame, known: DataFrame, path: str, min_tokens: int, identity: str | None = None) -> DataFrame:
    """Nearest functions by vector that the first pass did not report.

    The cache at path holds (sha, vec) and perhaps identity and stored_at: the last valid vector of the identity counts, and
    one must be named where the cache holds several.
    """
    cache = spark.read.parquet(path)
    names = [r.identity for r in cache.select("identity").distinct().limit(2).collect()] if "identity" in cache.columns else [None]
    if identity is None and len(names) > 1:
        raise ValueError("the vector cache holds several identities; name one with --identity")
    if None in names or "identity" not in cache.columns:
        cache = cache.withColumn("identity", F.lit(identity or ""))
        names = [identity or ""]
    if "stored_at" not in cache.columns:
        cache = cache.withColumn("stored_at", F.lit(0).cast("long"))
    first = cache.where(F.col("identity") == (identity or names[0])).first()
    dim = len(first.vec) if first else 0
    cache = similarity.cached_vectors(cache, identity or names[0], dim).withColumnRenamed("sha", "source_sha256") if names else cache
    own = funcs.where((F.size("tokens") >= min_tokens) & (F.trim("source") != "")).join(cache, "source_sha256")
    near = similarity.nearest(own.select(F.col("ordinal").alias("i"), "vec", "language", "file", "start_byte", "end_byte"))
    pairs = near.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("score").alias("score"))
    fresh = similarity.new_pairs(pairs, known.select(F.col("i").alias("a"), F.col("j").alias("b")))
    side = lambda p: own.select(F.col("ordinal").alias(p), F.col("file").alias(f"{p}_file"), F.col("symbol").alias(f"{p}_symbol"))
    return fresh.join(side("a"), "a").join(side("b"), "b").select("a_file", "a_symbol", "b_file", "b_symbol", F.bround("score", 3).alias("embed"))


def reachability_scan(args: argparse.Namespace) -> int:
    dead = Run(args).dead().persist()
    shown = dead if args.json else findings.capped_noise(dead, args.top)
    rows = shown.orderBy("rank", "file", "line").collect()
    if args.json:
        print(json.dumps({"count": len(rows), "symbols": [{"file": r.file, "line": r.line, "symbol": r.symbol, "reason": r["class"]} for r in rows]}, indent=2))
        return 0
    for r in dead.groupBy("rank", "class").count().orderBy("rank").collect():
        print(f"  [{r['count']:>3}] {r['class']}")
    for r in rows:
        print(f"  {r.file}:{r.line} {r.symbol} -> {r['class']}")
    return 0


def runtime_consumer_check(args: argparse.Namespace) -> int:
    run = Run(args)
    names = [p for p in files.changed_files(run.root, args.compare_branch) if "tests" not in p.split("/")]
    rows = run.dead(orphans_block=True).where(F.col("file").isin(names)).orderBy("rank", "file", "line").collect() if names else []
    for r in rows:
        print(f"[{'block' if r['class'] == 'block' else 'advisory'}] {r.file}:{r.line} {r.symbol} -> {r['class']}")
    return int(any(r["class"] == "block" for r in rows))


def cycles(args: argparse.Namespace) -> int:
    run = Run(args)
    found = graph.cycles(pysources.import_edges(run.parse(run.tree())))
    allowed = run.spark.createDataFrame([(k,) for k in run.config.allowed_cycles], "key string")
    rows = graph.ratchet(found, allowed).orderBy("key").collect()
    shown = rows if args.advisory else [r for r in rows if r.blocking]
    if args.json:
        print(json.dumps({"advisory": args.advisory, "count": len(shown), "cycles": [{"key": r.key, "members": r.members, "allowed": not r.blocking} for r in shown]}, indent=2))
    else:
        print("\n".join(f"cycle: {' -> '.join([*r.members, r.members[0]])}{'' if r.blocking else '  [allowed]'}" for r in shown) or "no circular imports")
    return int(not args.advisory and any(r.blocking for r in rows))


def growth(args: argparse.Namespace) -> int:
    run = Run(args)
    base, head = (files.git(run.root, "rev-parse", "--verify", f"{r}^{{commit}}").strip() for r in (args.base, args.head))
    changed = [p for p in files.git(run.root, "diff", "--name-only", "-z", "--no-renames", base, head).split("\0") if p.endswith(".py")]
    names = [p for p in changed if not ("tests" in p.split("/") or p.rsplit("/", 1)[-1].startswith("test_")) and (not args.paths or p in args.paths)]
    metrics = ["lines", "functions", "classes", "short_functions", "imports"]
    sizes = [pysources.size_snapshot(files.snapshot(run.spark, run.root, rev, names)) for rev in (base, head)]
    rows = {r.metric: r for r in diff.growth(*sizes, metrics).collect()}
    moved = {r.scope: r.asDict() for r in diff.churn(files.numstat(run.spark, run.root, base, head, {"python": names, "all": None})).collect()}
    zero = {"added": 0, "deleted": 0, "binary_files": 0}
    churn = {s: {k: moved.get(s, zero)[k] for k in zero} for s in ("python", "all")}
    if args.json:
        sides = {side: {m: getattr(rows[m], side) for m in metrics} for side in ("before", "after", "delta")}
        print(json.dumps({"base": base, "head": head, "files": names, "excluded": [p for p in changed if p not in names], **sides, "churn": churn}, indent=2))
    else:
        print("; ".join(f"{m}: unknown" if rows[m].delta is None else f"{m} {rows[m].before} -> {rows[m].after} ({rows[m].delta:+d})" for m in metrics))
        print("churn: " + "; ".join(f"{s} +{c['added']}/-{c['deleted']} (binary files: {c['binary_files']})" for s, c in churn.items()))
    return 0


def redundancy(args: argparse.Namespace) -> int:
    run = Run(args)
    if args.paths:
        names = [p for p in args.paths if p.endswith(".py") and os.path.exists(os.path.join(run.root, p))]
        rows = pysources.redundancies(run.parse(run.tree(names))).orderBy("file_path", "line").collect() if names else []
    else:
        added = diff.added_lines(files.hunk_headers(run.spark, run.root, args.compare_branch)).persist()
        parsed = run.parse(run.tree())
        for r in pysources.clones(pysources.functions(parsed), added, threshold=args.clone_threshold, min_tokens=args.min_tokens).collect():
            print(f"[advisory] {r.a_file}:{r.a_line} {r.a_symbol} resembles {r.b_file}:{r.b_line} {r.b_symbol} ({r.struct:.3f})")
        rows = findings.on_changed_lines(pysources.redundancies(parsed), added).orderBy("file_path", "line").collect()
    for r in rows:
        print(f"[block] {r.file_path}:{r.line}: {r.redundancy}")
    return int(bool(rows))


def dead_code_changed(args: argparse.Namespace) -> int:
    """Gates another tool's dead-code report, read from a file, by changed lines and confidence."""
    run = Run(args)
    added = diff.added_lines(files.hunk_headers(run.spark, run.root, args.compare_branch))
    found = reports.dead_code_report(run.spark.read.text(args.report)).withColumnRenamed("file", "file_path")
    rows = findings.split_by_confidence(findings.on_changed_lines(found, added)).orderBy("file_path", "line").collect()
    for r in rows:
        print(f"[{r.verdict}] {r.file_path}:{r.line}: {r.message} ({r.confidence}% confidence)")
    return int(any(r.verdict == "block" for r in rows))


def changed_python_files(args: argparse.Namespace) -> int:
    sys.stdout.write(sinks.paths(files.changed_files(os.path.abspath(args.root), args.compare_branch), args.null))
    return 0


def mutation_targets(args: argparse.Namespace) -> int:
    """Changed runtime files whose syntax tree differs from the merge base."""
    run = Run(args)
    names = [p for p in files.changed_files(run.root, args.compare_branch) if "tests" not in p.split("/")]
    base = files.git(run.root, "merge-base", files.compare_ref(run.root, args.compare_branch), "HEAD").strip()
    kept = []
    if names:
        old, new = run.parse(files.snapshot(run.spark, run.root, base, names)), run.parse(run.tree(names))
        if (bad := new.where("a = 'deadcode/parse-error'").first()) is not None:
            raise ValueError(f"{bad.path} does not parse")
        kept = [r.path for r in pysources.mutation_targets(old, new).orderBy("path").collect()]
    sys.stdout.write(sinks.paths(kept, args.null))
    return 0


def mutation_gate(args: argparse.Namespace) -> int:
    """Gates the results of a mutation run: its metadata files, or a report of JSON lines of (mutant, status)."""
    run = Run(args)
    rows = run.spark.read.schema("mutant string, status string").json(args.report) if args.report else reports.mutation_metadata(run.spark, os.path.join(run.root, "mutants"))
    rows = rows.withColumn("all", F.lit(1))
    for r in diff.mutation_gate(rows, ["all"], args.floor).collect():
        print(f"killed {r.killed}, survived {r.survived}, other {r.intolerable} of {r.total}: {'FAILED' if r.failed else 'passed'}")
        return int(r.failed)
    print("nothing was measured: FAILED")
    return 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloupe", description=__doc__)
    top.add_argument("--root", default=".")
    top.add_argument("--config", default=".quality.yml")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, function, *options: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=(function.__doc__ or "").split("\n")[0] or None)
        p.set_defaults(function=function)
        if "paths" in options:
            p.add_argument("paths", nargs="*", default=[])
        if "branch" in options:
            p.add_argument("--compare-branch", default="main")
        for flag in ("changed", "json", "null"):
            if flag in options:
                p.add_argument(f"--{flag}", action="store_true")
        return p

    for name, function in (("changed-python-files", changed_python_files), ("mypy-targets", changed_python_files), ("mutation-targets", mutation_targets)):
        add(name, function, "branch", "null")
    p = add("run-mutmut-changed", mutation_gate, "branch")
    p.add_argument("--report", default=None, help="JSON lines; else the metadata below mutants/")
    p.add_argument("--floor", type=float, default=0.70)
    add("runtime-consumer-check", runtime_consumer_check, "branch")
    add("vulture-changed", dead_code_changed, "branch").add_argument("--report", required=True)
    p = add("redundancy", redundancy, "paths", "branch")
    p.add_argument("--clone-threshold", type=float, default=0.95)
    p.add_argument("--min-tokens", type=int, default=40)
    p = add("scan", scan, "paths", "branch", "changed", "json")
    for flag in ("sarif", "prompt", "no-history"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--lint-report", default=None, help="a JavaScript linter's reply over the same files")
    p = add("ci", ci, "paths", "branch", "changed", "json")
    p.add_argument("--fail-below", type=int, default=None)
    p.add_argument("--lint-report", default=None, help="a JavaScript linter's reply over the same files")
    add("rules", list_rules)
    add("security", security, "paths")
    add("trend", trend).add_argument("--limit", type=int, default=20)
    p = add("overlaps", overlaps, "paths", "json")
    p.add_argument("--threshold", type=float, default=0.55)
    p.add_argument("--top", type=int, default=50)
    p.add_argument("--min-tokens", type=int, default=40)
    p.add_argument("--identity", default=None, help="whose vectors of the cache count")
    p.add_argument("--vectors", default=None, help="parquet of (sha, vec) for the second pass")
    add("reachability-scan", reachability_scan, "json").add_argument("--top", type=int, default=50)
    add("cycles", cycles, "json").add_argument("--advisory", action="store_true")
    p = add("growth", growth, "paths", "json")
    p.add_argument("--base", required=True)
    p.add_argument("--head", default="HEAD")
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        return args.function(args)
    except (OSError, ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    finally:
        if (spark := SparkSession.getActiveSession()) is not None:
            release(spark)


if __name__ == "__main__":
    sys.exit(main())
