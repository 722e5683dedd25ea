"""Source trees and git as relations."""

from __future__ import annotations

import os
import posixpath
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.functions import text


#: Path parts that the expansion of an explicit target does not enter.
EXPLICIT_SKIPPED = tuple(p for p in text.SKIPPED_PARTS if p != ".runtime")


def _unlisted(name: str) -> bool:
    """Whether Spark's own listing leaves a name out, as it does with __init__.py."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _contents(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of paths below base, read one file at a time."""
    system, at = fs.FileSystem.from_uri(base)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with system.open_input_file(f"{at}/{path}") as f:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])


def _normal(paths: list[str], base: str) -> list[str]:
    """Paths relative to the root, each once, in their order; one outside raises."""
    out = [posixpath.normpath(posixpath.relpath(p, base) if p.startswith("/") else p) for p in paths]
    if outside := [p for p in out if p.split("/")[0] == ".."]:
        raise ValueError(f"outside of the root: {', '.join(outside)}")
    return [*dict.fromkeys(out)]


def tree(spark: SparkSession, root: str, paths: list[str], suffixes: tuple[str, ...] = (".py",), *, keep_tests: bool = True, test_roots: tuple[str, ...] = ("tests",), explicit: bool = False) -> DataFrame:
    """files(path, source, ordinal) below the given paths of a root, each file once; paths are relative to the root.

    A missing path and one outside the root raise.  Files below skipped directories do not appear; a byte-order mark of a Python
    file is dropped.  ordinal sorts by path, part by part.  With explicit, paths are targets: ordinal sorts by the first
    target that holds a file, then by path, .runtime is entered, and a target that is a file appears wherever it lies.
    Names that Spark's listing leaves out (`_` or `.` in front) are listed beside it and read in Arrow batches.
    """
    base = os.path.abspath(root) if "://" not in root else root.rstrip("/")
    targets = _normal(paths, base)
    system, at = fs.FileSystem.from_uri(base)
    kinds = {p: system.get_file_info(f"{at}/{p}").type for p in targets}
    if missing := [p for p in targets if kinds[p] == fs.FileType.NotFound]:
        raise FileNotFoundError(f"no such path: {', '.join(missing)}")
    heads = lambda p: {posixpath.dirname(p), "."} | {p[:k] for k, c in enumerate(p) if c == "/"} if p != "." else set()
    tops = [p for p in targets if not heads(p) & set(targets)]  # no file lies below two of them
    beside = []
    for p in tops:
        if kinds[p] == fs.FileType.Directory:
            inner = (posixpath.relpath(i.path, at) for i in system.get_file_info(fs.FileSelector(f"{at}/{p}", recursive=True)) if i.is_file)
            beside += [n for n in inner if n.endswith(suffixes) and any(map(_unlisted, posixpath.relpath(n, p).split("/")))]
        elif p.endswith(suffixes) and _unlisted(posixpath.basename(p)):
            beside.append(p)
    listed = [p for p in tops if kinds[p] == fs.FileType.Directory or (p.endswith(suffixes) and p not in beside)]
    raw = spark.createDataFrame([(p,) for p in beside], "path string").mapInArrow(lambda batches: _contents(base, batches), "path string, content binary")
    if listed:
        whole = F.regexp_replace("path", "^file:/*", "/") if "://" not in base else F.col("path")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{base}/{p}" for p in listed])
        raw = raw.union(found.select(F.substr(whole, F.lit(len(base) + 2)).alias("path"), "content"))
    path = F.col("path")
    files = [p for p in targets if kinds[p] == fs.FileType.File]
    kept = ~text.is_skipped(path, EXPLICIT_SKIPPED if explicit else text.SKIPPED_PARTS)
    rows = raw.where(F.rlike(path, F.lit("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")) & (kept | path.isin(files) if explicit else kept))
    if not keep_tests:
        rows = rows.where(~text.is_test_path(path, test_roots))
    source = F.decode("content", "UTF-8")
    rows = rows.select("path", F.when(path.endswith(".py"), F.regexp_replace(source, "^\ufeff", "")).otherwise(source).alias("source"))
    parts = F.translate("path", "/", "\x01")
    return rows.withColumn("ordinal", F.concat(F.lpad(_target(targets).cast("string"), 9, "0"), F.lit("\x01"), parts) if explicit and targets else parts)


def _target(targets: list[str]) -> Column:
    """Place of the first target that is a path or one of its directories."""
    places = F.create_map(*(F.lit(x) for k, p in enumerate(targets) for x in (p, k)))
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_min(F.transform(F.concat(F.array(F.lit(".")), heads), lambda h: F.try_element_at(places, h)))


def without(files: DataFrame, globs: list[str]) -> DataFrame:
    """Drops paths that a glob covers; `*` crosses `/`."""
    return files.where(~text.matches_any_glob(F.col("path"), globs)) if globs else files


def git(root: str, *arguments: str, codes: tuple[int, ...] = (0,)) -> str:
    """Output of a git command; another exit code raises."""
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, check=False)
    if done.returncode not in codes:
        raise RuntimeError(f"git {arguments[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def compare_ref(root: str, branch: str) -> str:
    """The branch, else its remote counterpart."""
    for name in (branch, f"origin/{branch}"):
        try:
            return git(root, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}").strip()
        except RuntimeError:
            continue
    raise RuntimeError(f"no such branch: {branch}")


def changed_files(root: str, branch: str = "main", suffixes: tuple[str, ...] = (".py",)) -> list[str]:
    """Paths added, copied, modified or renamed since the merge base that still exist."""
    base = git(root, "merge-base", compare_ref(root, branch), "HEAD").strip()
    names = git(root, "diff", "--name-only", "-z", "--diff-filter=ACMR", base, "HEAD").split("\0")
    return sorted(n for n in names if n.endswith(suffixes) and os.path.exists(os.path.join(root, n)))


def hunk_headers(spark: SparkSession, root: str, branch: str = "main") -> DataFrame:
    """(file, header) of the hunks since the merge base, for diff.added_lines."""
    base = git(root, "merge-base", compare_ref(root, branch), "HEAD").strip()
    rows = []
    for path in changed_files(root, branch):
        rows += [(path, line) for line in git(root, "diff", "--unified=0", base, "HEAD", "--", path).splitlines() if line.startswith("@@ ")]
    return spark.createDataFrame(rows, "file string, header string")


def snapshot(spark: SparkSession, root: str, revision: str, paths: list[str]) -> DataFrame:
    """files(path, source) at a revision; absent paths have no row, unreadable ones a null source."""
    listed = {line.split("\t", 1)[1] for line in git(root, "ls-tree", "-r", "-z", revision).split("\0") if "\t" in line}
    rows: list[tuple[str, str | None]] = []
    for path in paths:
        if path in listed:
            try:
                rows.append((path, git(root, "show", f"{revision}:{path}")))
            except RuntimeError:
                rows.append((path, None))
    return spark.createDataFrame(rows, "path string, source string")


def numstat(spark: SparkSession, root: str, base: str, head: str, scopes: dict[str, list[str] | None]) -> DataFrame:
    """(scope, added, deleted) as text for diff.churn; a scope of None is the whole tree, an empty one has no rows."""
    rows = []
    for scope, paths in scopes.items():
        if paths == []:
            continue
        for line in git(root, "diff", "--numstat", "-z", "--no-renames", base, head, *(["--", *paths] if paths else [])).split("\0"):
            if line.count("\t") == 2:
                added, deleted, _ = line.split("\t")
                rows.append((scope, added, deleted))
    return spark.createDataFrame(rows, "scope string, added string, deleted string")
