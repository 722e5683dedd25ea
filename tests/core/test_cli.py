"""The command line on a small git tree, and strict configuration."""

from __future__ import annotations

import hashlib
import json
import subprocess

import pytest

from sparkloupe import cli
from sparkloupe.plans.fixture import FILES
from sparkloupe.sources import config


@pytest.fixture
def tree(tmp_path, spark):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "pyproject.toml").write_text('[project.scripts]\nrun = "app.util:run"\n')
    git("add", "-A")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "work")
    (tmp_path / "src/app/new.py").write_text("def fresh_thing():\n    return sorted(sorted([1]))\n")
    (tmp_path / "src/app/core.py").write_text(FILES["src/app/core.py"] + "# only a comment\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    return tmp_path


def run(tree, capsys, *arguments):
    code = cli.main(["--root", str(tree), *arguments])
    return code, capsys.readouterr().out


def test_commands(tree, capsys, spark):
    code, out = run(tree, capsys, "scan", "--json")
    body = json.loads(out)
    assert code == 0 and body["schemaVersion"] == "1" and body["summary"]["total"] == len(body["diagnostics"]) > 30
    assert any(d["rule"] == "reachability/dead-symbol" for d in body["diagnostics"]) and body["engines"]["security"] >= 5
    assert not (tree / cli.HISTORY).exists()
    code, out = run(tree, capsys, "scan")
    assert code == 0 and "[security]" in out and (tree / cli.HISTORY).read_text().count("\n") == 1
    code, out = run(tree, capsys, "trend")
    assert code == 0 and "last 1" in out
    sarif = json.loads(run(tree, capsys, "scan", "--sarif")[1])
    assert sarif["version"] == "2.1.0" and sarif["runs"][0]["results"]
    assert run(tree, capsys, "ci")[0] == 1 and run(tree, capsys, "rules")[1].count("\n") == 31
    assert run(tree, capsys, "security", "src/app/util.py")[0] == 1 and run(tree, capsys, "security", "src/app/new.py")[0] == 0 and run(tree, capsys, "security", "none.py")[0] == 1
    assert run(tree, capsys, "changed-python-files") == (0, "src/app/core.py\nsrc/app/new.py\n")
    assert run(tree, capsys, "mutation-targets", "--null") == (0, "src/app/new.py\0")
    code, out = run(tree, capsys, "redundancy")
    assert code == 1 and "new.py:2" in out
    code, out = run(tree, capsys, "runtime-consumer-check")
    assert code == 1 and "fresh_thing -> block" in out
    code, out = run(tree, capsys, "cycles", "--json")
    assert code == 1 and json.loads(out)["cycles"][0]["key"] == "app.core <-> app.models <-> app.util"
    (tree / ".quality.yml").write_text("allowed_cycles: ['app.core <-> app.models <-> app.util']\n")
    assert run(tree, capsys, "cycles")[0] == 0 and "[allowed]" in run(tree, capsys, "cycles", "--advisory")[1]
    code, out = run(tree, capsys, "growth", "--base", "main", "--json")
    body = json.loads(out)
    assert code == 0 and body["delta"]["functions"] == 1 and body["churn"]["all"]["added"] == 3
    code, out = run(tree, capsys, "reachability-scan", "--json")
    assert {"_orphan", "only_tested"} <= {s["symbol"] for s in json.loads(out)["symbols"]}
    code, out = run(tree, capsys, "overlaps", "--min-tokens", "10", "--json")
    assert code == 0 and json.loads(out)["functions_scanned"] > 10
    spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), [1.0, 0.0]) for t in ("def mentioned():\n    return 3", "def hook_for_tests():\n    return 1")], "sha string, vec array<double>").write.parquet(str(tree / "vectors"))
    body = json.loads(run(tree, capsys, "overlaps", "--min-tokens", "2", "--threshold", "2", "--vectors", str(tree / "vectors"), "--json")[1])
    assert body["count"] == 0 and [{p["a_symbol"], p["b_symbol"]} for p in body["embed_pairs"]] == [{"mentioned", "hook_for_tests"}]
    (tree / "dead.txt").write_text("src/app/new.py:1: unused function 'fresh_thing' (60% confidence)\nsrc/app/util.py:5: unused function 'load' (90% confidence)\n")
    code, out = run(tree, capsys, "vulture-changed", "--report", str(tree / "dead.txt"))
    assert code == 0 and out.startswith("[advisory]") and "util" not in out
    assert run(tree, capsys, "scan", "missing")[0] == 2


@pytest.mark.parametrize("text", ["nope: 1", "rules: {a: loud}", "exclude: x", "scoring: {other: 1}", "roots: {source: src}", "[1]"])
def test_configuration_is_strict(tmp_path, text):
    (tmp_path / "c.yml").write_text(text)
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "c.yml"))


def test_configuration_extends(tmp_path):
    (tmp_path / "base.yml").write_text("rules: {a: off, b: error}\nexclude: ['x/*']\nscoring: {failBelow: 40}\n")
    (tmp_path / "c.yml").write_text("extends: base.yml\nrules: {b: info}\nexclude: ['y/*']\n")
    c = config.load(str(tmp_path / "c.yml"))
    assert (c.rules, c.exclude, c.fail_below) == ({"a": "off", "b": "info"}, ["x/*", "y/*"], 40)
    assert config.load(str(tmp_path / "none.yml")) == config.Config()
