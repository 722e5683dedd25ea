"""Source trees, explicit targets, mutation metadata and linter reports read from files."""

from __future__ import annotations

import json

import pytest

from sparkloupe import cli
from sparkloupe.sources import files, reports


@pytest.fixture
def root(tmp_path):
    for name in ("src/pkg/__init__.py", "src/pkg/_part.py", "src/pkg/a.py", "src/pkg/a-b.py", "src/_own/b.py", "src/pkg/.runtime/c.py", "src/venv/d.py", "src/pkg/notes.txt", "src/test_e.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n", encoding="utf-8-sig" if name.endswith("a.py") else "utf-8")
    return tmp_path


def listed(spark, root, paths, **options):
    return [r.path.removeprefix("src/") for r in files.tree(spark, str(root), paths, **options).orderBy("ordinal").collect()]


def test_names_with_underscores_are_read(spark, root):
    assert listed(spark, root, ["src"]) == ["_own/b.py", "pkg/__init__.py", "pkg/_part.py", "pkg/a-b.py", "pkg/a.py", "test_e.py"]
    assert "test_e.py" not in listed(spark, root, ["src"], keep_tests=False)
    rows = {r.path: r.source for r in files.tree(spark, str(root), ["."]).collect()}
    assert len(rows) == 6 and all(source == f"# {path}\n" for path, source in rows.items())


def test_explicit_targets_keep_their_order(spark, root):
    got = listed(spark, root, ["src/pkg/a.py", "./src", str(root / "src/pkg"), "src/pkg/notes.txt"], explicit=True)
    assert got == ["pkg/a.py", "_own/b.py", "pkg/.runtime/c.py", "pkg/__init__.py", "pkg/_part.py", "pkg/a-b.py", "test_e.py"]
    assert listed(spark, root, ["src/venv/d.py", "src/_own"], explicit=True) == ["venv/d.py", "_own/b.py"]
    assert listed(spark, root, ["src/pkg/notes.txt"], explicit=True) == [] == listed(spark, root, [], explicit=True)
    with pytest.raises(ValueError, match="outside"):
        files.tree(spark, str(root), ["../x"], explicit=True)
    with pytest.raises(FileNotFoundError):
        files.tree(spark, str(root), ["src/none"])


def test_mutation_metadata(spark, tmp_path, capsys):
    def meta(name, text):
        (tmp_path / "mutants" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "mutants" / name).write_text(text)

    meta("src/a.py.meta", json.dumps({"exit_code_by_key": {"a.x": 1, "a.y": 0, "a.z": None}, "more": 1}))
    meta("src/__init__.py.meta", json.dumps({"exit_code_by_key": {"i.x": 36, "i.y": 77}}))
    meta("src/b.py.meta", "no json")
    got = reports.mutation_metadata(spark, str(tmp_path / "mutants"))
    want = {("src/a.py", "a.x", "killed"), ("src/a.py", "a.y", "survived"), ("src/a.py", "a.z", "not_checked"), ("src/__init__.py", "i.x", "timeout"), ("src/__init__.py", "i.y", "suspicious")}
    assert {tuple(r) for r in got.collect()} == want
    assert cli.main(["--root", str(tmp_path), "run-mutmut-changed"]) == 1 and "killed 1, survived 1, other 3 of 5: FAILED" in capsys.readouterr().out
    (tmp_path / "mutants/src/a.py.meta").write_text(json.dumps({"exit_code_by_key": {"a.x": 1, "a.y": 3}}))
    (tmp_path / "mutants/src/__init__.py.meta").unlink()
    assert cli.main(["--root", str(tmp_path), "run-mutmut-changed"]) == 0


def test_scan_with_a_linter_report(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/z.py").write_text("def f(x):\n    assert x\n    return eval(x)\n")
    (tmp_path / "src/b.py").write_text("try:\n    x = 1\nexcept Exception:\n    pass\n")
    (tmp_path / "src/_w.js").write_text("let unused = 1;\n")
    reply = {"diagnostics": [{"filename": "src/_w.js", "code": "eslint(no-unused-vars)", "message": "unused", "labels": [{"span": {"line": 1, "column": 5, "offset": 4, "length": 6}}]}], "number_of_files": 1}
    (tmp_path / "lint.json").write_text(json.dumps(reply))
    scan = lambda *a: (cli.main(["--root", str(tmp_path), "scan", *a]), capsys.readouterr().out)
    code, out = scan("--json", "--lint-report", str(tmp_path / "lint.json"))
    body = json.loads(out)
    assert code == 0 and body["coverage"] == {"python": 2, "javascript_typescript": 1} and body["files_scanned"] == 3
    assert [d["message"] for d in body["diagnostics"] if d["rule"] == "javascript/unused-variable"] == ["unused"]
    assert "coverage" not in json.loads(scan("--json")[1])
    rules = [r["id"] for r in json.loads(scan("--sarif", "--lint-report", str(tmp_path / "lint.json"), "src/z.py", "src")[1])["runs"][0]["tool"]["driver"]["rules"]]
    assert rules.index("security/eval") < rules.index("ai-slop/swallowed-exception") < rules.index("javascript/unused-variable") == len(rules) - 1
    (tmp_path / "lint.json").write_text(json.dumps(reply | {"number_of_files": 2}))
    assert scan("--lint-report", str(tmp_path / "lint.json"))[0] == 2
