"""One parse of a Python source, shared by everything that reads it on an executor."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from dataclasses import dataclass
from functools import cached_property

#: What parsing may raise on malformed, NUL-holding or very deep sources.
PARSE_FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_TRIVIA = {tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT, tokenize.ENCODING, tokenize.ENDMARKER}
_SUFFIXES = ("ements", "ement", "ing", "es", "ed", "s")


@dataclass(frozen=True)
class Comment:
    line: int
    column: int
    body: str
    inline: bool
    text: str


def stem(word: str) -> str:
    """Lower case without the first ending of the list that leaves three letters."""
    low = word.lower()
    end = next((s for s in _SUFFIXES if low.endswith(s) and len(low) - len(s) >= 3), "")
    return low[: len(low) - len(end)]


def is_text(node: ast.AST | None) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, str)


def without_docstring(body: list[ast.stmt]) -> list[ast.stmt]:
    return body[1:] if body and isinstance(body[0], ast.Expr) and is_text(body[0].value) else body


def chain(node: ast.expr) -> list[str] | None:
    """Names of a dotted expression from its root, or None when it is rooted in something else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return [node.id, *names] if isinstance(node, ast.Name) else None


class Source:
    """A parsed file: tree, nodes in breadth-first order, parents, tokens, comments."""

    def __init__(self, path: str, text: str, is_test: bool = False) -> None:
        self.path, self.is_test = path, is_test
        self.text = text.removeprefix("﻿")
        self.tree = ast.parse(self.text)
        self.nodes = list(ast.walk(self.tree))

    @cached_property
    def parent(self) -> dict[ast.AST, ast.AST]:
        return {child: node for node in self.nodes for child in ast.iter_child_nodes(node)}

    def ancestors(self, node: ast.AST) -> list[ast.AST]:
        """From the parent outwards."""
        out = []
        while (node := self.parent.get(node)) is not None:
            out.append(node)
        return out

    @cached_property
    def tokens(self) -> list[tokenize.TokenInfo]:
        return list(tokenize.generate_tokens(io.StringIO(self.text).readline))

    @cached_property
    def code_lines(self) -> set[int]:
        """Lines on which a token of code starts."""
        return {t.start[0] for t in self.tokens if t.type not in _TRIVIA}

    @cached_property
    def comments(self) -> list[Comment]:
        first: dict[int, int] = {}
        for t in self.tokens:
            if t.type not in _TRIVIA:
                first.setdefault(t.start[0], t.start[1])
        return [
            Comment(t.start[0], t.start[1], t.string.lstrip("#").strip(), first.get(t.start[0], t.start[1]) < t.start[1], t.string)
            for t in self.tokens
            if t.type == tokenize.COMMENT
        ]

    @cached_property
    def words(self) -> dict[int, set[str]]:
        """Identifiers and keywords of each line, as they are and stemmed."""
        out: dict[int, set[str]] = {}
        for t in self.tokens:
            if t.type == tokenize.NAME:
                out.setdefault(t.start[0], set()).update((t.string.lower(), stem(t.string)))
        return out

    @cached_property
    def n_lines(self) -> int:
        return len(self.text.splitlines())


_DIRECTIVE = re.compile(r"#\s*ai-slop:\s*(ignore-file|ignore)(?![\w-])(?:\s*\[([^\]]*)\])?", re.I)


def suppressions(source: Source) -> list[tuple[str, int | None, list[str] | None]]:
    """(scope, line, codes) of the directives in comments; an empty code list is no directive."""
    out: list[tuple[str, int | None, list[str] | None]] = []
    for c in source.comments:
        if found := _DIRECTIVE.search(c.text):
            codes = None if found[2] is None else sorted({x for x in re.split(r"[,\s]+", found[2]) if x})
            if codes != []:
                out.append(("file", None, codes) if found[1].lower() == "ignore-file" else ("line", c.line, codes))
    return out


def masked(text: str) -> str:
    """The same text with the characters of strings and comments as x; line breaks stay."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    kinds = {tokenize.STRING, tokenize.COMMENT, getattr(tokenize, "FSTRING_MIDDLE", tokenize.STRING)}
    out = list(text)
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type in kinds:
            a, b = (starts[row - 1] + column for row, column in (t.start, t.end))
            out[a:b] = ["\n" if c == "\n" else "x" for c in out[a:b]]
    return "".join(out)


def size_counts(text: str) -> dict[str, int | None]:
    """Lines, functions, classes, short functions (five body lines at most) and imports; all but lines unknown when it does not parse."""
    lines = len(text.splitlines())
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except SyntaxError:
        return {"lines": lines, "functions": None, "classes": None, "short_functions": None, "imports": None}
    bodies = [without_docstring(n.body) for n in nodes if isinstance(n, FUNCTIONS)]
    short = sum((b[-1].end_lineno - b[0].lineno + 1 if b else 0) <= 5 for b in bodies)
    count = lambda *kinds: sum(isinstance(n, kinds) for n in nodes)
    return {"lines": lines, "functions": len(bodies), "classes": count(ast.ClassDef), "short_functions": short, "imports": count(ast.Import, ast.ImportFrom)}


def bound_names(function: ast.AST) -> set[str]:
    """Names that a function binds: parameters, assigned names, handler names, nested definitions and their parameters."""
    out: set[str] = set()
    for node in ast.walk(function):
        match node:
            case ast.Name(id=name, ctx=ast.Store()) | ast.arg(arg=name) | ast.ExceptHandler(name=str(name)):
                out.add(name)
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name) if node is not function:
                out.add(name)
    return out


def fingerprint(function: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """Structure-only tokens: bound names become placeholders by first use, free names, attributes, operators and literal types stay."""
    bound, places, out = bound_names(function), {}, []
    for statement in without_docstring(function.body):
        for node in ast.walk(statement):
            out.append(type(node).__name__)
            match node:
                case ast.Name(id=name) if name not in bound:
                    out.append("#" + name)
                case ast.Name(id=name) | ast.arg(arg=name):
                    out.append(places.setdefault(name, f"V{len(places)}"))
                case ast.Attribute(attr=name):
                    out.append("." + name)
                case ast.Constant(value=value):
                    out.append(f"<{type(value).__name__}>")
                case ast.BinOp(op=op) | ast.UnaryOp(op=op) | ast.BoolOp(op=op):
                    out.append(type(op).__name__)
                case ast.Compare(ops=ops):
                    out += [type(op).__name__ for op in ops]
    return out


def functions(source: Source) -> list[dict]:
    """Fingerprints, UTF-8 byte spans and texts of all functions, nested ones too, breadth first."""
    raw = source.text.encode()
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", raw))]
    out = []
    for node in source.nodes:
        if isinstance(node, FUNCTIONS):
            tokens = fingerprint(node)
            a, b = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
            semantic = sorted({t for t in tokens if t[0] in "#."})
            out.append({"symbol": node.name, "line": node.lineno, "col": node.col_offset + 1, "tokens": tokens, "semantic": semantic, "start_byte": a, "end_byte": b, "source": raw[a:b].decode("utf-8", "replace")})
    return out


def absolute_module(dotted: str, is_package: bool, level: int, module: str | None) -> str | None:
    """Target of a from-import; level dots climb from the package."""
    if not level:
        return module
    package = dotted.split(".") if dotted else []
    if not is_package:
        package = package[:-1]
    if level - 1 > len(package):
        return None
    return ".".join([*package[: len(package) - level + 1], *([module] if module else [])]) or None


def module_facts(source: Source, dotted: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """(kind, a, b, c): from (module, name, asname), star (module), import (module, asname), name, attr (base, attr), all, def (symbol, line, decorated)."""
    package = source.path.rsplit("/", 1)[-1] == "__init__.py"
    facts: set[tuple[str, str | None, str | None, str | None]] = set()
    for node in source.nodes:
        match node:
            case ast.ImportFrom():
                if target := absolute_module(dotted, package, node.level, node.module):
                    facts |= {("star", target, None, None) if a.name == "*" else ("from", target, a.name, a.asname or a.name) for a in node.names}
            case ast.Import(names=names):
                facts |= {("import", a.name, a.asname or a.name.split(".")[0], None) for a in names}
            case ast.Name(id=name, ctx=ast.Load()):
                facts.add(("name", name, None, None))
            case ast.Attribute(value=ast.Name(id=base), attr=attr):
                facts.add(("attr", base, attr, None))
    for node in source.tree.body:
        match node:
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                if not (name.startswith("__") and name.endswith("__")):
                    facts.add(("def", name, str(node.lineno), str(bool(node.decorator_list)).lower()))
            case ast.Assign(targets=targets, value=ast.List(elts=items) | ast.Tuple(elts=items) | ast.Set(elts=items)):
                if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets):
                    facts |= {("all", x.value, None, None) for x in items if is_text(x)}
    return sorted(facts, key=str)
