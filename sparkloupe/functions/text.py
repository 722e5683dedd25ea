"""String functions as Column expressions; nothing here needs Python on the executors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comment and value patterns of the text rules.
SEPARATOR = r"^\s*[-=*#_~]{6,}\s*$"
TODO_MARKER = r"(?i)^(?:[-*]\s+|[0-9]+[.)]\s+|[A-Za-z][.)]\s+)?(?:TODO|FIXME|HACK|XXX)\b"
TRACKER = r"#[0-9]+|\b[A-Z][A-Z0-9]+-[0-9]+\b|https?://\S+"
GENERIC_NAME = r"(?i)^(?:helper|data|temp|tmp|result|value|val|item|obj|var|arg|param|func|cls|thing|stuff|test)_?[0-9]+$"
SECRET_NAME = r"(?i)password|passwd|secret|api_key|apikey|token|access_key|private_key|aws_secret"
SECRET_SHAPE = r"^AKIA[0-9A-Z]{16}$|^sk-[A-Za-z0-9_-]{20,}$|^eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[baprs]-[A-Za-z0-9-]{10,}$|^-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
LICENCE = r"(?i)all rights reserved|licen[cs]ed? under"

#: Path parts that no source scan enters.
SKIPPED_PARTS = (".git", ".venv", "venv", ".runtime", "node_modules", "__pycache__", "mutants")


def glob_pattern(glob: str) -> str:
    """A shell glob as a Java regular expression over the whole path; `*` crosses `/`."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = end + 1
        else:
            out += re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", c)
    return f"(?s)^{out}$"


def matches_any_glob(path: Column, globs: list[str]) -> Column:
    tests = [F.rlike(path, F.lit(glob_pattern(g))) for g in globs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_skipped(path: Column, parts: tuple[str, ...] = SKIPPED_PARTS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, parts)))


def is_test_path(path: Column, test_roots: tuple[str, ...] = ("tests",)) -> Column:
    """Under a test root, below a directory named tests, or named test_*."""
    parts = F.split(path, "/")
    under = reduce(lambda a, b: a | b, [(path == r) | path.startswith(r + "/") for r in test_roots], F.lit(False))
    return under | F.array_contains(parts, "tests") | F.element_at(parts, -1).startswith("test_")


def is_separator(line: Column) -> Column:
    return F.rlike(line, F.lit(SEPARATOR))


def is_untracked_todo(body: Column) -> Column:
    return F.rlike(body, F.lit(TODO_MARKER)) & ~F.rlike(body, F.lit(TRACKER))


def is_generic_name(name: Column) -> Column:
    return F.rlike(name, F.lit(GENERIC_NAME))


def blank_quoted(text: Column, mark: str = '"') -> Column:
    """Text between pairs of mark, blanked character by character: the length stays."""
    parts = F.split(text, re.escape(mark), -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"[^\n]", "x")).otherwise(p)), mark)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays: both empty is 1, one empty is 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dotted_name(path: Column, roots: tuple[str, ...] = ("src",)) -> Column:
    """Module name of a source path: below the longest matching import root, without suffix or __init__."""
    rest = path
    for root in sorted((r.strip("/") for r in roots if r not in (".", "")), key=len):
        rest = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(rest)
    return F.replace(F.regexp_replace(F.regexp_replace(rest, r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))


def sparkline(scores: Column) -> Column:
    """One tick for each score of an array of 0-100."""
    ticks = "▁▂▃▄▅▆▇█"
    at = lambda s: F.least(F.lit(7), F.floor(F.greatest(F.lit(0), s) * 7 / 100)).cast("int") + 1
    return F.array_join(F.transform(scores, lambda s: F.substr(F.lit(ticks), at(s), F.lit(1))), "")
