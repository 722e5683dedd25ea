"""Queries over diffs, snapshots, references, graphs and similarity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.functions import text
from sparkloupe.operators import diff, graph, reach, similarity
from sparkloupe.plans.common import table

_HUNKS = (
    ("a.py", "@@ -1 +1 @@"), ("a.py", "@@ -3,2 +5,3 @@ def f():"), ("a.py", "@@ -9,4 +12,0 @@"), ("b.py", "@@ -0,0 +1,4 @@"),
    ("b.py", "@@ -7,2 +18,2 @@"), ("b.py", "not a hunk"), ("b.py", "@@ -20 +19,1 @@"), ("c.py", "@@@ -1 -1 +1 @@@"),
)


def hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.added_lines(spark.createDataFrame(_HUNKS, "file string, header string"))


def snapshot_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two years as snapshots; a file's lines are its total price, unknown for a few."""
    o = table(spark, sf_dir, "orders")

    def year(y: int, unknown: int) -> DataFrame:
        lines = F.when(F.col("o_orderkey") % 1000 == unknown, None).otherwise(F.floor("o_totalprice"))
        return o.where((F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast("timestamp"))).select(F.lit(1).cast("bigint").alias("files"), lines.cast("bigint").alias("lines"), (F.col("o_orderkey") % 7).cast("bigint").alias("functions"))

    return diff.growth(year(1995, -1), year(1996, 3), ["files", "lines", "functions"]).select("metric", *(F.col(c).cast("string").alias(c) for c in ("before", "after", "delta")))


def null_absorbing_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_custkey") % 500 == 7, None).otherwise(F.floor("c_acctbal").cast("bigint")))
    return c.groupBy("c_nationkey").agg(diff.null_absorbing_sum("v").cast("string").alias("total"))


def numstat_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    binary = F.col("l_orderkey") % 13 == 0
    number = lambda c: F.when(binary, "-").otherwise(F.col(c).cast("bigint").cast("string"))
    return diff.churn(li.select(F.col("l_returnflag").alias("scope"), number("l_quantity").alias("added"), number("l_linenumber").alias("deleted")))


def ast_equivalent_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose normalised text differs from the turn before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.lower(F.regexp_replace("text", r"[ \t\n\r]+", " "))).alias("digest"))
    base = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), "digest")
    return diff.changed_content(base, turns, ["conv_id", "turn"]).select("conv_id", "turn")


def longest_prefix_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://", "")
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("path"))
    prefixes = pages.select(F.regexp_extract("path", "^[^/]*", 0).alias("prefix")).where(F.col("page_id") % 3 == 0)
    prefixes = prefixes.union(pages.where(F.col("page_id") % 4 == 0).select(F.regexp_extract("path", "^[^/]*/[^/]*", 0)))
    return diff.longest_prefix(pages, prefixes).select("page_id", "prefix")


def mutation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "killed").when(F.col("o_orderstatus") == "O", "survived").when(F.col("o_orderkey") % 5000 == 1, "timeout").otherwise("skipped")
    rows = table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", F.year("o_orderdate")).alias("path"), status.alias("status"))
    return diff.mutation_gate(rows, ["path"], 0.5)


def orphan_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions at twice the parts' keys, half of which lie above all parts: those that no order line refers to, other than
    the one at the definition's own place."""
    parts = table(spark, sf_dir, "part").select((2 * F.col("p_partkey")).alias("symbol"), (F.col("p_partkey") % 50).alias("file"), (F.col("p_partkey") % 7 + 1).cast("int").alias("line"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), (F.col("l_orderkey") % 50).alias("file"), F.col("l_linenumber").alias("line"))
    return reach.unreferenced(parts, used)


def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("theble",), ("ability",), ("über",), ("année",), ("thand",), ("der",), ("qui",)], "name string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    return reach.occurrence_index(names, docs).groupBy("name").agg(F.count("*").alias("lines"), F.countDistinct("file").alias("files"), F.max("line").alias("last_line"))


def _customer_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as definitions: orders are runtime uses, suppliers' nations the tests."""
    c = table(spark, sf_dir, "customer")
    symbols = c.select(F.col("c_nationkey").cast("string").alias("dotted"), F.col("c_nationkey").cast("string").alias("file"), F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 9 == 0, "_for_tests").otherwise("")).alias("symbol"), F.col("c_custkey").cast("int").alias("line"), (F.col("c_acctbal") < 0).alias("decorated"), "c_custkey")
    orders = table(spark, sf_dir, "orders")
    settled = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    used = symbols.join(orders.where("o_totalprice > 440000").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey").select(F.col("symbol").alias("name"), F.lit("elsewhere").alias("file"), F.lit(1).alias("line"))
    tests = symbols.join(table(spark, sf_dir, "supplier").where("s_acctbal > 9500").select(F.col("s_nationkey").cast("string").alias("dotted")).distinct(), "dotted").select(F.col("symbol").alias("name"))
    resolved = symbols.join(settled.distinct(), "c_custkey").select("dotted", "symbol")
    entries = symbols.where("c_custkey % 100 = 5").select("dotted", "symbol")
    return reach.classify(symbols.drop("c_custkey"), resolved, used, tests, entries)


def reachability_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_symbols(spark, sf_dir).groupBy("class", "rank").agg(F.count("*").alias("n"), F.min("symbol").alias("first"))


def actionable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloupe.operators.findings import capped_noise

    return capped_noise(_customer_symbols(spark, sf_dir), 20).select("rank", "file", "line", "symbol")


def or_exists_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols of their size's module; order lines give the four kinds of reference."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg.m"), F.col("p_size").cast("string")).alias("dotted"), F.concat(F.lit("s"), (F.col("p_partkey") % 400).cast("string")).alias("symbol"))
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 48")
    user = F.concat(F.lit("pkg.m"), (F.col("l_suppkey") % 60).cast("string"))
    symbol = F.concat(F.lit("s"), (F.col("l_partkey") % 400).cast("string"))
    target = F.concat(F.lit("pkg.m"), (F.col("l_orderkey") % 60).cast("string"))
    alias = F.concat(F.lit("a"), (F.col("l_orderkey") % 60).cast("string"))
    kind = F.col("l_orderkey") % 5
    modules = {
        "names": li.where((kind == 0) | (kind == 3)).select(user.alias("dotted"), symbol.alias("name")),
        "attributes": li.where(kind == 1).select(user.alias("dotted"), F.concat(F.lit("a"), (F.col("l_suppkey") % 60).cast("string")).alias("base"), symbol.alias("attr")),
        "from_imports": li.where(kind == 2).select(user.alias("dotted"), (F.col("l_linenumber") == 1).alias("is_package"), target.alias("module"), symbol.alias("name"), symbol.alias("asname")),
        "stars": li.where((kind == 3) & (F.col("l_linenumber") == 2)).select(user.alias("dotted"), target.alias("module")),
        "imports": li.where(kind == 4).select(user.alias("dotted"), target.alias("module"), alias.alias("asname")),
    }
    return reach.resolved(modules, p)


def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as imports: host.section is a node of its own if a page stands there, else the host."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*/([a-z]+)", 1).alias("section"))
    nodes = pages.where("page_id % 2 = 0").select(F.concat_ws(".", "host", "section").alias("dotted")).union(pages.where("page_id % 3 = 0").select("host")).distinct()
    imports = pages.select(F.concat_ws(".", "host", "section").alias("src"), F.regexp_replace("host", "^(m|www|blog)[.]", "").alias("module"), F.col("section").alias("name"))
    return graph.resolve_edges(imports.union(pages.select(F.col("host"), F.col("host"), F.col("section"))), nodes)


def _trade(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Each customer nation's k largest supplier nations by lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = lines.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey"))
    return n.withColumn("r", rank).where(F.col("r") <= k).select(F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("src"), F.concat(F.lit("n"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("dst"))


def cycles_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_trade(spark, sf_dir, 2)).select("key", F.size("members").alias("n"))


def cycles_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.cycles(_trade(spark, sf_dir, 3))
    return graph.ratchet(found, spark.createDataFrame([("n00 <-> n01",), ("n02 <-> n03",)], "key string")).select("key", "blocking")


def _word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.array_distinct(F.filter(F.split("text", " "), lambda w: w != "")).alias("tokens"))


def jaccard_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_pairs(_word_sets(spark, sf_dir), 0.6)


def best_clone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best earlier or later match of each document, one row for a symmetric pair."""
    pairs = similarity.jaccard_pairs(_word_sets(spark, sf_dir), 0.6)
    score = F.col("common") / (F.col("n_i") + F.col("n_j") - F.col("common"))
    best = similarity.best_match(similarity.both_ways(pairs, score), "i", "score", ["j"])
    return similarity.collapse_symmetric(best, "i", "j", ["i"]).select("i", "j")


def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events of one user whose spans (seconds of the day, value long) nest strictly."""
    start = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("day"), "event_id", start.alias("s"), (start + F.floor(F.col("value") * 60)).alias("e"))
    a, b = e.alias("a"), e.alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.day") == F.col("b.day"))
    nested = similarity.contains_strictly((F.col("a.s"), F.col("a.e")), (F.col("b.s"), F.col("b.e")))
    return a.join(b, same & nested).select(F.col("a.event_id").alias("outer_id"), F.col("b.event_id").alias("inner_id"))


def containment_skip_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_containment(spark, sf_dir).agg(F.count("*").alias("skipped"), F.countDistinct("outer_id").alias("outers"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("vec"))


def knn_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest(_vectors(spark, sf_dir)).select("i", "j", "rank")


def knn_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similarity.nearest(_vectors(spark, sf_dir)).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    known = near.join(labels.withColumnsRenamed({"vec_id": "a", "label": "x"}), "a").join(labels.withColumnsRenamed({"vec_id": "b", "label": "y"}), "b").where("x = y").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return similarity.new_pairs(near, known)


def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence ratio of the words of the most similar document pairs."""
    pairs = similarity.jaccard_pairs(_word_sets(spark, sf_dir), 0.6).select("i", "j")
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.split("text", " ").alias("tokens"))
    return similarity.close_sequences(pairs, words, 0.95).select("i", "j", F.bround("ratio", 3).alias("ratio"))


def vector_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").alias("source"))
    unit = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0.6), F.lit(0.8))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(1.0), F.lit(0.5)))
    cache = docs.where("doc_id % 2 = 0").select(F.when(F.col("doc_id") % 10 == 0, "other").otherwise("model").alias("identity"), "sha", unit.alias("vec"))
    return similarity.cache_misses(docs.where("source is not null"), cache, "model", 2).select("sha")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("bytes"))
    return docs.groupBy("sha", "bytes").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/$", "/__init__"), F.lit(".py"))
    paths = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return paths.select("page_id", text.dotted_name(F.col("path")).alias("dotted"), text.is_test_path(F.col("path")).alias("test"), text.is_skipped(F.col("path")).alias("skipped"))


QUERIES = {
    f.__name__: f
    for f in (
        hunk_lines, snapshot_growth, null_absorbing_delta, numstat_churn, ast_equivalent_skip, longest_prefix_map, mutation_gate, orphan_symbols, occurrence_index, reachability_classes,
        actionable_topk, or_exists_resolver, edge_resolution, cycles_scc, cycles_ratchet, jaccard_overlap_pairs, best_clone_match, span_containment, containment_skip_count, knn_top3, knn_new_only,
        overlap_ratio, vector_cache_misses, exact_duplicates, module_names,
    )
}

_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _HUNKS)
_CUSTOMERS = """
c AS (SELECT c_nationkey::VARCHAR AS file, c_name || CASE WHEN c_custkey % 9 = 0 THEN '_for_tests' ELSE '' END AS symbol, c_custkey::INT AS line, c_acctbal < 0 AS decorated, c_custkey, c_nationkey FROM customer),
k AS (SELECT c.*, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 440000) AS occurs,
      EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s_acctbal > 9500) AS tested
      FROM c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AND c_custkey % 100 <> 5),
v AS (SELECT *, CASE WHEN NOT occurs AND NOT decorated AND tested AND ends_with(symbol, '_for_tests') THEN 4 WHEN NOT occurs AND NOT decorated AND tested THEN 1
      WHEN NOT occurs AND NOT decorated THEN 0 WHEN decorated THEN 3 ELSE 2 END AS rank FROM k)
"""
_TRADE = """
t AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
e AS (SELECT 'n' || lpad(a::VARCHAR, 2, '0') AS src, 'n' || lpad(b::VARCHAR, 2, '0') AS dst FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM t) WHERE r <= {k} AND a <> b),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
m AS (SELECT x.src AS node, min(x.dst) AS low FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src GROUP BY 1),
g AS (SELECT low, string_agg(node, ' <-> ' ORDER BY node) AS key, count(*) AS n FROM m GROUP BY low HAVING count(*) > 1)
"""
_SETS = """
w AS (SELECT doc_id AS i, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS t FROM documents WHERE text IS NOT NULL),
z AS (SELECT i, len(t) AS n, unnest(t) AS x FROM w),
q AS (SELECT a.i, b.i AS j, a.n AS n_i, b.n AS n_j, count(*) AS common FROM z a JOIN z b ON a.x = b.x AND a.i < b.i AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) - 1e-9 GROUP BY ALL),
p AS (SELECT * FROM q WHERE common >= 0.6 * (n_i + n_j - common) - 1e-9)
"""
_SPANS = """
e AS (SELECT event_id, user_id, day(ts) AS d, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s, hour(ts) * 3600 + minute(ts) * 60 + second(ts) + floor(value * 60)::BIGINT AS f FROM events),
n AS (SELECT a.event_id AS outer_id, b.event_id AS inner_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.d = b.d AND a.s <= b.s AND b.f <= a.f AND (a.s < b.s OR b.f < a.f) AND a.s < a.f AND b.s < b.f)
"""
_KNN = """
d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
t AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM d),
k AS (SELECT * FROM t WHERE rank <= 3)
"""
_PAGES = r"pg AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([a-z]+)', 1) AS section FROM pages)"
_SNAP = "SELECT 1 AS files, CASE WHEN o_orderkey % 1000 = {u} THEN NULL ELSE floor(o_totalprice)::BIGINT END AS lines, o_orderkey % 7 AS functions FROM orders WHERE year(o_orderdate) = {y}"
_TOTAL = "SELECT sum(files)::BIGINT AS files, CASE WHEN count(*) = count(lines) THEN sum(lines)::BIGINT END AS lines, sum(functions)::BIGINT AS functions FROM ({s})"

SQL = {
    "hunk_lines": rf"""WITH h AS (SELECT file, regexp_extract(header, '^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@', ['s', 'n']) AS m FROM (VALUES {_VALUES}) t(file, header))
SELECT DISTINCT file, unnest(range(try_cast(m.s AS INT), try_cast(m.s AS INT) + coalesce(try_cast(m.n AS INT), 1)))::INT AS line FROM h WHERE m.s <> ''""",
    "snapshot_growth": f"""WITH b AS ({_TOTAL.format(s=_SNAP.format(u=-1, y=1995))}), a AS ({_TOTAL.format(s=_SNAP.format(u=3, y=1996))})
SELECT 'files' AS metric, b.files::VARCHAR AS before, a.files::VARCHAR AS after, (a.files - b.files)::VARCHAR AS delta FROM a, b UNION ALL SELECT 'lines', b.lines::VARCHAR, a.lines::VARCHAR, (a.lines - b.lines)::VARCHAR FROM a, b UNION ALL SELECT 'functions', b.functions::VARCHAR, a.functions::VARCHAR, (a.functions - b.functions)::VARCHAR FROM a, b""",
    "null_absorbing_delta": "SELECT c_nationkey, CASE WHEN count(*) FILTER (c_custkey % 500 = 7) > 0 THEN NULL ELSE sum(floor(c_acctbal)::BIGINT)::VARCHAR END AS total FROM customer GROUP BY 1",
    "numstat_churn": "SELECT l_returnflag AS scope, sum(CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE l_quantity::BIGINT END)::BIGINT AS added, sum(CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE l_linenumber END)::BIGINT AS deleted, count(*) FILTER (l_orderkey % 13 = 0) AS binary_files FROM lineitem GROUP BY 1",
    "ast_equivalent_skip": r"""WITH t AS (SELECT conv_id, turn, lower(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS x FROM conversations)
SELECT b.conv_id, b.turn FROM t b LEFT JOIN t a ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.x IS NULL OR a.x <> b.x""",
    "longest_prefix_map": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages),
x AS (SELECT DISTINCT regexp_extract(path, '^[^/]*') AS prefix FROM p WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*') FROM p WHERE page_id % 4 = 0)
SELECT page_id, (SELECT max_by(prefix, length(prefix)) FROM x WHERE p.path = prefix OR starts_with(p.path, prefix || '/')) AS prefix FROM p""",
    "mutation_gate": """WITH s AS (SELECT o_orderpriority || '/' || year(o_orderdate) AS path, CASE WHEN o_orderstatus = 'F' THEN 'k' WHEN o_orderstatus = 'O' THEN 's' WHEN o_orderkey % 5000 = 1 THEN 't' ELSE 'x' END AS s FROM orders),
g AS (SELECT path, count(*) FILTER (s = 'k') AS killed, count(*) FILTER (s = 's') AS survived, count(*) FILTER (s = 't') AS intolerable, count(*) AS total FROM s GROUP BY path)
SELECT *, (CASE WHEN killed + survived = 0 THEN 1.0 ELSE killed / (killed + survived) END < 0.5) OR intolerable > 0 OR killed + survived = 0 AS failed FROM g""",
    "orphan_symbols": """SELECT 2 * p_partkey AS symbol, p_partkey % 50 AS file, (p_partkey % 7 + 1)::INT AS line FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE
l_partkey = 2 * p_partkey AND (l_orderkey % 50 <> p_partkey % 50 OR l_linenumber <> p_partkey % 7 + 1))""",
    "occurrence_index": r"""WITH n AS (SELECT unnest(['theble','ability','über','année','thand','der','qui']) AS name),
l AS (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents)),
l2 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
w AS (SELECT doc_id, line, unnest(list_distinct(regexp_extract_all(body, '[\p{L}\p{N}_]+'))) AS name FROM l2)
SELECT name, count(*) AS lines, count(DISTINCT doc_id) AS files, max(line)::INT AS last_line FROM w JOIN n USING (name) GROUP BY name""",
    "reachability_classes": f"WITH {_CUSTOMERS} SELECT ['orphaned','test-only','unresolved','decorated','test-support'][rank + 1] AS class, rank, count(*) AS n, min(symbol) AS first FROM v GROUP BY rank",
    "actionable_topk": f"WITH {_CUSTOMERS} SELECT rank, file, line, symbol FROM (SELECT *, row_number() OVER (PARTITION BY rank > 1 ORDER BY rank, file, line, symbol) AS q FROM v) WHERE rank <= 1 OR q <= 20",
    "or_exists_resolver": """WITH d AS (SELECT DISTINCT 'pkg.m' || p_size AS dotted, 's' || (p_partkey % 400) AS symbol FROM part),
u AS (SELECT 'pkg.m' || (l_suppkey % 60) AS usr, 's' || (l_partkey % 400) AS symbol, 'pkg.m' || (l_orderkey % 60) AS target, 'a' || (l_orderkey % 60) AS alias, 'a' || (l_suppkey % 60) AS base, l_orderkey % 5 AS kind, l_linenumber AS n FROM lineitem WHERE l_quantity > 48)
SELECT dotted, symbol FROM d WHERE
  EXISTS (SELECT 1 FROM u WHERE usr = dotted AND u.symbol = d.symbol AND kind IN (0, 1, 3))
  OR EXISTS (SELECT 1 FROM u WHERE kind = 2 AND usr <> dotted AND u.symbol = d.symbol AND (target = dotted OR target IN (SELECT usr FROM u x WHERE x.kind = 2 AND x.n = 1 AND x.symbol = d.symbol)))
  OR EXISTS (SELECT 1 FROM u i JOIN u a ON a.kind = 1 AND i.usr = a.usr AND a.base = i.alias WHERE i.kind = 4 AND i.target = dotted AND a.symbol = d.symbol AND i.usr <> dotted)
  OR EXISTS (SELECT 1 FROM u i JOIN u a ON a.kind = 1 AND i.usr = a.usr AND a.base = i.symbol WHERE i.kind = 2 AND i.target = 'pkg' AND 'pkg.' || i.symbol = dotted AND a.symbol = d.symbol AND i.usr <> dotted)
  OR EXISTS (SELECT 1 FROM u s JOIN u n ON s.usr = n.usr AND n.kind IN (0, 3) WHERE s.kind = 3 AND s.n = 2 AND s.target = dotted AND s.usr <> dotted AND n.symbol = d.symbol)""",
    "edge_resolution": rf"""WITH {_PAGES}, nd AS (SELECT DISTINCT host || '.' || section AS dotted FROM pg WHERE page_id % 2 = 0 UNION SELECT DISTINCT host FROM pg WHERE page_id % 3 = 0),
im AS (SELECT host || '.' || section AS src, regexp_replace(host, '^(m|www|blog)[.]', '') AS module, section AS name FROM pg UNION ALL SELECT host, host, section FROM pg),
ed AS (SELECT src, coalesce((SELECT dotted FROM nd WHERE dotted = module || '.' || name), (SELECT dotted FROM nd WHERE dotted = module)) AS dst FROM im)
SELECT DISTINCT src, dst FROM ed WHERE dst IS NOT NULL AND src <> dst""",
    "cycles_scc": f"WITH RECURSIVE {_TRADE.format(k=2)} SELECT key, n::INT AS n FROM g",
    "cycles_ratchet": f"WITH RECURSIVE {_TRADE.format(k=3)} SELECT key, key <> 'n00 <-> n01' AS blocking FROM g",
    "jaccard_overlap_pairs": f"WITH {_SETS} SELECT i, j, common::INT AS common, n_i::INT AS n_i, n_j::INT AS n_j FROM p",
    "best_clone_match": f"""WITH {_SETS}, b AS (SELECT i, j, common / (n_i + n_j - common) AS s FROM p UNION ALL SELECT j, i, common / (n_i + n_j - common) FROM p),
t AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM b), o AS (SELECT i, j, row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY i) AS k FROM t WHERE r = 1)
SELECT i, j FROM o WHERE k = 1""",
    "span_containment": f"WITH {_SPANS} SELECT outer_id, inner_id FROM n",
    "containment_skip_count": f"WITH {_SPANS} SELECT count(*) AS skipped, count(DISTINCT outer_id) AS outers FROM n",
    "knn_top3": f"WITH {_KNN} SELECT i, j, rank::INT AS rank FROM k",
    "knn_new_only": f"""WITH {_KNN} SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM k JOIN embeddings x ON x.vec_id = i JOIN embeddings y ON y.vec_id = j WHERE x.label <> y.label""",
    "vector_cache_misses": """SELECT DISTINCT sha256(text) AS sha FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 AND doc_id % 10 <> 0 AND doc_id % 3 = 0)""",
    "exact_duplicates": "SELECT sha256(text) AS sha, octet_length(encode(text))::INT AS bytes, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "module_names": r"""WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '/__init__') AS p FROM pages)
SELECT page_id, replace(regexp_replace(p, '/__init__$', ''), '/', '.') AS dotted, list_contains(string_split(p, '/'), 'tests') OR starts_with(string_split(p, '/')[-1], 'test_') AS test, false AS skipped FROM u""",
}
