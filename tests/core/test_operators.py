"""Relational operators on small literal inputs, and equivalence with brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparkloupe.functions import text
from sparkloupe.operators import diff, findings, graph, reach, similarity
from sparkloupe.sources import reports


def test_score_properties(spark):
    def score(rows, n):
        df = spark.createDataFrame(rows, "severity string, engine string, style boolean")
        return findings.health_score(df, spark.createDataFrame([(n,)], "n_files int"), []).first()

    one = [("error", "ai-slop", False)]
    assert score([], 3)[:2] == (100, "Healthy")
    assert score(one, 500).score > score(one, 1).score > score(one * 8, 1).score
    assert score([("error", "ai-slop", True)], 1).score >= score(one, 1).score


def test_suppress(spark):
    rows = [("a.py", "ai-slop/x", 1), ("a.py", "ai-slop/y", 1), ("a.py", "ai-slop/x", 2), ("b.py", "security/z", 5), ("b.py", "deadcode/parse-error", 1)]
    found = spark.createDataFrame(rows, "file_path string, rule string, line int")
    orders = spark.createDataFrame([("a.py", "line", 1, ["x"]), ("b.py", "file", None, None)], "file string, scope string, line int, codes array<string>")
    assert sorted(map(tuple, findings.suppress(found, orders).collect())) == [("a.py", "ai-slop/x", 2), ("a.py", "ai-slop/y", 1), ("b.py", "deadcode/parse-error", 1)]


def test_hunks(spark):
    rows = [("f", h) for h in ("@@ -1 +1 @@", "@@ -3,2 +5,3 @@ x", "@@ -9 +12,0 @@", "@@ -8,0 +18,2 @@", "noise")]
    got = diff.added_lines(spark.createDataFrame(rows, "file string, header string")).collect()
    assert sorted(r.line for r in got) == [1, 5, 6, 7, 18, 19]


def test_unknown_is_not_zero(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", 2, 5)], "path string, lines long, functions long")
    b = spark.createDataFrame([], "path string, lines long, functions long")
    rows = {r.metric: (r.before, r.after, r.delta) for r in diff.growth(a, b, ["lines", "functions"]).collect()}
    assert rows == {"lines": (3, 0, -3), "functions": (None, 0, None)}


@pytest.mark.parametrize(("statuses", "failed"), [(["killed"] * 3, False), (["killed", "survived"], True), (["killed"] * 7 + ["survived"] * 3, False), (["skipped"], True), (["killed"] * 9 + ["timeout"], True)])
def test_mutation_gate(spark, statuses, failed):
    df = spark.createDataFrame([(s, 1) for s in statuses], "status string, all int")
    assert diff.mutation_gate(df, ["all"]).first().failed is failed


def test_strong_components(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "g"), ("h", "h")]
    assert graph.strong_components(edges) == [["a", "b"], ["c", "d", "e"]]
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 9)
        edges = list({(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(rng.randint(0, 14))})
        reach_ = {(a, b) for a, b in edges}
        for k in map(str, range(n)):
            reach_ |= {(a, b) for a, x in list(reach_) if x == k for y, b in list(reach_) if y == k}
        want = {tuple(sorted({b for b in map(str, range(n)) if (a, b) in reach_ and (b, a) in reach_} | {a})) for a in map(str, range(n))}
        assert [tuple(x) for x in graph.strong_components([e for e in edges if e[0] != e[1]])] == sorted(x for x in want if len(x) > 1)
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "a"), ("b", "y"), ("y", "z"), ("z", None), ("z", "z"), ("a", "b")], "src string, dst string")
    assert [r.key for r in graph.cycles(df, driver_edges=3).collect()] == ["a <-> b"]
    assert graph.cycles(df.where("src = dst")).isEmpty() and graph.cycles(df.where("src = dst"), driver_edges=0).isEmpty()


def test_components_beyond_the_driver(spark):
    """More edges than the driver takes, the last few within its bound: many small graphs, two rings and a chain into one."""
    rng = random.Random(5)
    edges = {(f"g{k}-{rng.randrange(7)}", f"g{k}-{rng.randrange(7)}") for k in range(60) for _ in range(9)}
    ring = [f"r{k:03d}" for k in range(40)]
    edges |= set(zip(ring, ring[1:] + ring[:1], strict=True)) | {(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)} | {("c000", "r000")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = sorted(list(r.members) for r in graph.cycles(df, driver_edges=20).collect())
    assert got == graph.strong_components([e for e in edges if e[0] != e[1]])


def test_classify_truth_table(spark):
    rows = [(d, o, t, n) for d in (False, True) for o in (False, True) for t in (False, True) for n in ("f", "f_for_tests")]
    df = spark.createDataFrame(rows, "d boolean, o boolean, t boolean, n string")
    from pyspark.sql import functions as F

    cols = [F.col(c) for c in "dotn"]
    for r in df.select("*", reach.verdict(*cols).alias("a"), reach.verdict(*cols, True).alias("b")).collect():
        quiet = not r.o and not r.d
        want = ("test-support" if r.n != "f" else "test-only") if quiet and r.t else "orphaned" if quiet else "decorated" if r.d else "unresolved"
        assert (r.a, r.b) == (want, "block" if want == "orphaned" else want)


def test_jaccard_pairs_are_complete(spark):
    rng = random.Random(8)
    sets = {k: sorted({rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 9))}) for k in range(80)}
    df = spark.createDataFrame([*sets.items()], "i int, tokens array<string>")
    for t in (0.3, 0.6, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= t * len(set(sets[a]) | set(sets[b])) - 1e-12}
        assert {(r.i, r.j) for r in similarity.jaccard_pairs(df, t).collect()} == want


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_blocks(spark, block):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "i long, vec array<double>")
    s = v @ v.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(40) for j in np.argsort(-s[i], kind="stable")[:3]}
    assert {(r.i, r.j) for r in similarity.nearest(df, 3, block).collect()} == want


def test_nearest_masks(spark):
    rows = [(1, [1.0, 0.0], "py", "a", 0, 90), (2, [1.0, 0.0], "py", "a", 10, 80), (3, [0.8, 0.6], "py", "b", 0, 9), (4, [1.0, 0.0], "js", "c", 0, 9)]
    df = spark.createDataFrame(rows, "i long, vec array<double>, language string, file string, start_byte long, end_byte long")
    assert {(r.i, r.j) for r in similarity.nearest(df).collect()} == {(1, 3), (2, 3), (3, 1), (3, 2)}


def test_overlaps(spark):
    same = [f"T{k % 7}" for k in range(60)]
    rows = [
        (1, "a.py", "f", "python", [*same, "#load", ".size"], ["#load", ".size"], 0, 90), (2, "b.py", "g", "python", [*same, "#load", ".size"], ["#load", ".size"], 0, 90),
        (3, "c.py", "h", "python", [*same, "#save", ".name"], ["#save", ".name"], 0, 90), (4, "a.py", "inner", "python", [*same, "#load", ".size"], ["#load", ".size"], 10, 80),
        (5, "d.js", "f", "javascript", [*same, "#load", ".size"], ["#load", ".size"], 0, 90), (6, "e.py", "bare", "python", same, [], 0, 9), (7, "g.py", "bare2", "python", same, [], 0, 9),
    ]
    df = spark.createDataFrame(rows, "ordinal long, file string, symbol string, language string, tokens array<string>, semantic array<string>, start_byte long, end_byte long")
    got = {(r.i, r.j): round(r.combined, 3) for r in similarity.overlaps(df).collect()}
    assert got == {(1, 2): 1.0, (2, 4): 1.0, (6, 7): 1.0}


def test_vector_cache(spark):
    sources = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c"), ("s1", "a")], "sha string, source string")
    cache = spark.createDataFrame([("m", "s1", [1.0, 0.0]), ("m", "s2", [2.0, 0.0]), ("other", "s3", [1.0, 0.0])], "identity string, sha string, vec array<float>")
    missing = similarity.cache_misses(sources, cache, "m", 2)
    assert sorted(r.sha for r in missing.collect()) == ["s2", "s3"]
    got = similarity.encode(missing, lambda texts: np.array([[ord(t[0]), 0.0] for t in texts])).collect()
    assert {r.sha: r.vec for r in got} == {"s2": [98.0, 0.0], "s3": [99.0, 0.0]}


def test_globs_names_and_sparklines(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("src/a/__init__.py",), ("src/a/b.py",), ("tests/x.py",), ("src/test_y.py",)], "p string")
    p = F.col("p")
    rows = df.select(text.dotted_name(p).alias("d"), text.is_test_path(p).alias("t"), text.matches_any_glob(p, ["src/*.py"]).alias("g"), text.matches_any_glob(p, ["*[!b].py"]).alias("h")).collect()
    assert [tuple(r) for r in rows] == [("a", False, True, True), ("a.b", False, True, False), ("tests.x", True, False, True), ("test_y", True, True, True)]
    assert spark.range(1).select(text.sparkline(F.array(*map(F.lit, (-5, 0, 15, 50, 99, 100, 150))))).first()[0] == "▁▁▂▄▇██"


def test_reports(spark, tmp_path):
    lines = spark.createDataFrame([("a.py:3: unused function 'f' (60% confidence)",), ("b.py:9: unused import 'x' (90% confidence, 2 lines)",), ("noise",)], "value string")
    assert [tuple(r) for r in reports.dead_code_report(lines).collect()] == [("a.py", 3, "unused function 'f'", 60), ("b.py", 9, "unused import 'x'", 90)]
    good = '{"diagnostics": [{"filename": "a.js", "code": "eslint(no-empty)", "severity": "warning", "message": "m", "labels": [{"span": {"line": 1, "column": 1, "offset": 0, "length": 2}}]}], "number_of_files": 1}'
    assert reports.lint_report(spark, good, ["a.js"], {"a.js": b"{}"}).first()["rule"] == "javascript/empty-block"
    for bad in ("{", "[]", good.replace("a.js", "b.js"), good.replace("no-empty", "no-x"), good.replace('"line": 1', '"line": "1"'), good.replace('"length": 2', '"length": 99'), good.replace('_files": 1', '_files": 2'), good.replace('"number', '"diagnostics": [], "number')):
        with pytest.raises(reports.ReportError):
            reports.lint_report(spark, bad, ["a.js"], {"a.js": b"{}"})
    path = tmp_path / "h.jsonl"
    path.write_text('{"timestamp": "2026-01-01T00:00:00+00:00", "score": 80, "label": "Healthy", "errors": 1}\n\nbroken\n{"timestamp": "2025-01-01T00:00:00+00:00", "score": 70, "label": "Needs Work"}\n')
    rows = sorted(reports.history(spark, str(path)).collect(), key=lambda r: r.ordinal)
    assert [(r.score, r.errors, r.files) for r in rows] == [(80, 1, 0), (70, 0, 0)]


def test_prefixes(spark):
    paths = spark.createDataFrame([("src/a/x.py",), ("src/ab/y.py",), ("lib/z.py",)], "path string")
    mapping = spark.createDataFrame([("src/a", ["t1"]), ("src", ["t2"]), ("lib/q", ["t3"])], "prefix string, tests array<string>")
    assert {r.path: r.prefix for r in diff.longest_prefix(paths, mapping.select("prefix")).collect()} == {"src/a/x.py": "src/a", "src/ab/y.py": "src", "lib/z.py": None}
    assert [r.path for r in diff.below(paths, mapping.select("prefix"), keep=False).collect()] == ["lib/z.py"]
    assert {r.tests for r in diff.test_roots(paths, mapping).collect()} == {None}
    assert sorted(r.tests for r in diff.test_roots(paths.where("path like 'src%'"), mapping).collect()) == [["t1"], ["t2"]]


def _shuffled(spark, run, what="shuffleWriteRecords"):
    """Rows, or bytes, that the stages of run() exchange."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    known = spark._jvm.java.util.ArrayList()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(known, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), known)
        return sum(getattr(stages.apply(k), what)() for k in range(stages.size()))

    before = total()
    found = run()
    return found, total() - before


def _near_copies():
    rng = random.Random(8)
    texts = []
    for k in range(60):
        base = [f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(rng.choice([1, 3, 40, 150, 700]))]
        texts += [[w if rng.random() > 0.15 else f"x{rng.randrange(500)}" for w in base] for _ in range(3)] + [base] * (25 if k == 7 else 2)
    return texts + [[], ["a", None], ["a", None], ["a"]]


def _brute(texts, t):
    want = {}
    for i, a in enumerate(texts):
        for j in range(i):
            x, y = set(texts[j]), set(a)
            both = len((x & y) - {None})
            if x and y and both >= t * (len(x) + len(y) - both) - 1e-9:
                want[j, i] = (both, len(x), len(y))
    return want


@pytest.mark.parametrize("t", [0.6, 0.9])
def test_jaccard_pairs_in_many_parts(spark, monkeypatch, t):
    """Long and short sets, classes of copies, nulls; slices, groups and pieces of clusters are small."""
    for name, most in (("HELD", 40), ("VERIFIED", 30), ("AT_ONCE", 300)):
        monkeypatch.setattr(similarity, name, most, raising=False)
    texts = _near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, tokens array<string>")
    assert {(r.i, r.j): (r.common, r.n_i, r.n_j) for r in similarity.jaccard_pairs(df, t).collect()} == _brute(texts, t)
    asks = spark.range(0, len(texts), 7).withColumnRenamed("id", "i")
    want = {(a, b) for i, j in _brute(texts, t) for a, b in ((i, j), (j, i)) if a % 7 == 0}
    assert {(r.i, r.j) for r in similarity.jaccard_pairs(df, t, asks=asks).collect()} == want


def test_jaccard_pairs_exchange_no_row_for_each_token(spark):
    texts = _near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, tokens array<string>")
    found, rows = _shuffled(spark, lambda: similarity.jaccard_pairs(df, 0.6).collect())
    assert found and rows < sum(len(set(x)) for x in texts) / 2


def test_overlap_ratio_sends_a_text_once_to_its_cluster(spark, tmp_path):
    """30 near copies make 435 pairs; their texts are not sent with each of them."""
    from difflib import SequenceMatcher

    import __spark_entry__ as driver

    rng = random.Random(5)
    base = [f"{rng.getrandbits(64):x}" for _ in range(600)]
    texts = [" ".join(w for w in base if rng.random() > 0.02) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    found, sent = _shuffled(spark, lambda: driver.queries()["overlap_ratio"](spark, str(tmp_path)).collect(), "shuffleWriteBytes")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    words = [t.split(" ") for t in texts]
    want = {(i, j): SequenceMatcher(None, words[i], words[j], autojunk=False).ratio() for j in range(30) for i in range(j)}
    assert {(r.i, r.j): r.ratio for r in found} == pytest.approx({k: round(v, 3) for k, v in want.items() if v >= 0.95}, abs=1e-3)
    assert len(found) > 300 and sent < 8 * sum(map(len, texts))


def test_resolved_repeats_are_not_exchanged(spark):
    """20,000 references, 40 different ones of each kind: no join meets the repeats."""
    n = spark.range(20_000).selectExpr("concat('m', id % 5) as dotted", "concat('s', id % 8) as name", "concat('m', id % 8) as module", "concat('a', id % 5) as alias", "id % 3 = 0 as is_package")
    modules = {
        "names": n.select("dotted", "name"), "attributes": n.selectExpr("dotted", "alias as base", "name as attr"), "from_imports": n.selectExpr("dotted", "is_package", "module", "name", "name as asname"),
        "stars": n.select("dotted", "module"), "imports": n.selectExpr("dotted", "module", "alias as asname"),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found, rows = _shuffled(spark, lambda: reach.resolved(modules, n.selectExpr("dotted", "name as symbol").union(spark.createDataFrame([("m9", "s99"), ("m6", "s2")], "dotted string, symbol string"))).collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(f"m{a}", f"s{b}") for a in range(5) for b in range(8)} | {("m6", "s2")}
    assert {tuple(r) for r in found} == want and len(found) == len(want) and rows < 20_000


def test_nearest_sends_a_vector_to_few_parts(spark):
    """Copies and ties over many blocks: as by brute force, with at most SIDES copies of a vector on each side."""
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (600, 3)).astype(float)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "i long, vec array<double>")
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j), r + 1) for i in range(600) for r, j in enumerate(np.argsort(-s[i], kind="stable")[:3])}
    found, rows = _shuffled(spark, lambda: similarity.nearest(df, 3, 7).collect())
    assert {(r.i, r.j, r["rank"]) for r in found} == want
    assert rows < 600 * (2 * 16 + 3 * 16) + 100
