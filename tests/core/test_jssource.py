"""The token-based JavaScript frontend."""

from __future__ import annotations

import pytest

from sparkloupe.functions import jssource
from sparkloupe.operators import pysources, similarity

SOURCE = """// é
export async function load(path, options = {}) {
  const text = await read(path);
  return text.split(/[/"]+/).map((line) => line.trim() + `a ${line.length} ${ `b` }`);
}
const twice = x => x * 2;
class Store extends Base {
  static async save(item) { try { this.items.push(item) } catch (e) { log(e) } }
  get size() { return this.items.length; }
}
const table = { key: function () { return 1 / 2 / 3 }, short(a) { return a } };
if (twice(1)) { other(); }
"""


def test_functions():
    found = {f["symbol"]: f for f in jssource.functions(SOURCE)}
    assert set(found) == {"load", "<anonymous>", "twice", "Store.save", "Store.size", "key", "short"}
    load = found["load"]
    assert load["line"] == 2 and load["tokens"][0] == "MODE:async" and {"#read", ".split", ".map"} <= set(load["semantic"]) and "#text" not in load["semantic"] and "#line" not in load["semantic"]
    raw = SOURCE.encode()
    for f in found.values():
        assert raw[f["start_byte"] : f["end_byte"]].decode() == f["source"]
    assert load["source"].startswith("async function load") and load["source"].endswith("}") and found["twice"]["source"] == "x => x * 2"
    assert found["Store.save"]["semantic"] == sorted([".items", ".push", "#log"]) and found["key"]["tokens"] == ["return", "<number>", "/", "<number>", "/", "<number>"]


def test_renamed_copies_agree():
    a = "function f(a, b) { let c = a.get(b); for (const d of c) { use(d); } return c }"
    b = "function g(x, y) { let z = x.get(y); for (const w of z) { use(w); } return z }"
    (p,), (q,) = jssource.functions(a), jssource.functions(b)
    assert p["tokens"] == q["tokens"]


@pytest.mark.parametrize("text", ["function f( {", "}", "`${", "a = `x", "f(]"])
def test_broken_sources(text):
    with pytest.raises(jssource.JsError):
        jssource.functions(text)


def test_pools(spark):
    body = "{ const c = a.load(b); if (c) { return c.size + a.load(c).size } else { return a.save(c, b).size } }"
    files = [("src/a.js", f"function f(a, b) {body}"), ("src/b.ts", f"const g = (a, b) => {body}"), ("src/c.py", "def f(a, b):\n    return a.load(b).size\n"), ("src/d.js", "function (")]
    parsed = pysources.parse(spark.createDataFrame(files, "path string, source string"))
    funcs = pysources.functions(parsed)
    assert sorted((r.language, r.n) for r in funcs.groupBy("language").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()) == [("javascript", 2), ("python", 1)]
    pairs = similarity.overlaps(funcs, min_tokens=4).collect()
    assert len(pairs) == 1 and {pairs[0].a_file, pairs[0].b_file} == {"src/a.js", "src/b.ts"}
    assert [r["rule"] for r in pysources.raw_findings(parsed).collect()] == ["javascript/parse-error"]


def test_views(spark):
    parsed = pysources.parse(spark.createDataFrame([("a.py", "x = 'a'  # note\n# alone\n")], "path string, source string"))
    assert [tuple(r)[1:] for r in pysources.comments(parsed).orderBy("line").collect()] == [(1, 9, "note", True), (2, 0, "alone", False)]
    masked = pysources.masked(spark.createDataFrame([("a.py", "x = 'a'  # note\n"), ("b.py", None)], "path string, source string"))
    assert {r.path: r.masked for r in masked.collect()} == {"a.py": "x = xxx  xxxxxx\n", "b.py": None}
    assert pysources.by_language(pysources.functions(parsed)).collect() == []
