"""Functions of JavaScript and TypeScript sources, from tokens and matched brackets.

No grammar is used: names are bound by declarations and parameters found in the token stream of a function,
and type annotations stay in it.  Fingerprints are therefore comparable among JavaScript and TypeScript
files, not with another parser's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

SUFFIXES = (".js", ".cjs", ".mjs", ".jsx", ".ts", ".cts", ".mts", ".tsx")
KEYWORDS = frozenset(
    "async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while with yield".split()
)
_NOT_METHODS = frozenset("if for while switch catch with function return await typeof super".split())
_TOKEN = re.compile(
    r"(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>#?[$_a-zA-Z\u0080-\uffff][\w$]*)|(?P<number>\.?[0-9][\w.]*)"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<mark>\?\.(?![0-9])|=>|\.\.\.|[=!]==?|[-+*/%&|^<>?]{1,3}=?|[{}()\[\];,.:~@`]|\S)",
    re.S,
)
_REGEXP = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}


class JsError(ValueError):
    """Brackets or templates that do not match."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, keyword, number, string, template, regexp, mark
    text: str
    start: int
    end: int


def tokens(source: str) -> list[Token]:
    """All tokens; a template is one token for each piece of its text, with the tokens of its expressions between."""
    out: list[Token] = []
    nesting: list[str] = []
    at, n = 0, len(source)

    def template(start: int) -> int:
        m = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*", re.S).match(source, start)
        end = m.end()
        if end >= n:
            raise JsError("a template has no end")
        more = source[end] == "$"
        out.append(Token("template", "`", start, end))
        if more:
            nesting.append("${")
            return end + 2
        return end + 1

    while at < n:
        last = out[-1] if out else None
        if source[at] == "/" and source[at : at + 2] not in ("//", "/*"):
            operand = last and (last.kind in ("name", "number", "string", "template", "regexp") or last.text in (")", "]", "}") or last.text in ("this", "super", "null", "true", "false"))
            if not operand and (m := _REGEXP.match(source, at)):
                out.append(Token("regexp", m[0], at, m.end()))
                at = m.end()
                continue
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m[0]
        if kind == "gap":
            at = m.end()
            continue
        if text == "`":
            at = template(at + 1)
            continue
        if kind == "mark":
            if text in _OPEN:
                nesting.append(text)
            elif text in _CLOSE:
                if not nesting or _OPEN[nesting[-1]] != text:
                    raise JsError(f"unmatched {text}")
                if nesting.pop() == "${":
                    at = template(m.end())
                    continue
        if kind == "name" and text in KEYWORDS and not (last and last.text in (".", "?.")):
            kind = "keyword"
        out.append(Token(kind, text, at, m.end()))
        at = m.end()
    if nesting:
        raise JsError(f"unmatched {nesting[-1]}")
    return out


def _pairs(ts: list[Token]) -> dict[int, int]:
    """Closing place of each opening bracket and back."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for k, t in enumerate(ts):
        if t.kind == "mark" and t.text in _OPEN:
            stack.append(k)
        elif t.kind == "mark" and t.text in _CLOSE and stack:
            a = stack.pop()
            out[a], out[k] = k, a
    return out


def _expression_end(ts: list[Token], pairs: dict[int, int], k: int) -> int:
    """Place after the expression that starts at k."""
    while k < len(ts):
        t = ts[k]
        if t.kind == "mark":
            if t.text in (",", ";", ")", "]", "}"):
                return k
            k = pairs.get(k, k)
        k += 1
    return k


def _named_by(ts: list[Token], k: int) -> str | None:
    """Name that the value starting at k is given: `name = `, `name: `, `a.name = `."""
    while k > 0 and ts[k - 1].text in ("async", "("):
        k -= 1
    if k > 1 and ts[k - 1].text in ("=", ":") and ts[k - 2].kind in ("name", "string"):
        return ts[k - 2].text.strip("'\"")
    return None


def _classes(ts: list[Token], pairs: dict[int, int]) -> list[tuple[int, int, str]]:
    out = []
    for k, t in enumerate(ts):
        if t.kind == "keyword" and t.text == "class":
            name = ts[k + 1].text if k + 1 < len(ts) and ts[k + 1].kind == "name" else _named_by(ts, k) or "<class>"
            body = next((j for j in range(k + 1, len(ts)) if ts[j].text == "{" and j in pairs), None)
            if body is not None:
                out.append((body, pairs[body], name))
    return out


def _bound(ts: list[Token], pairs: dict[int, int], parameters: range, body: range) -> set[str]:
    """Names that a function binds, with those of the functions inside it."""
    out = {ts[k].text for k in parameters if ts[k].kind == "name" and ts[k - 1].text not in (".", "?.", "=")}
    for k in body:
        t = ts[k]
        if t.kind != "keyword" and t.text != "=>":
            continue
        after = ts[k + 1] if k + 1 < len(ts) else None
        if t.text in ("let", "const", "var") and after:
            j = k + 1
            while j < body.stop:
                if ts[j].text in ("{", "[") and j in pairs:
                    inner = range(j + 1, pairs[j])
                    out |= {ts[x].text for x in inner if ts[x].kind == "name" and ts[x + 1].text in (",", "}", "]", "=")}
                    j = pairs[j] + 1
                elif ts[j].kind == "name":
                    out.add(ts[j].text)
                    j += 1
                if j < body.stop and ts[j].text == "=":
                    j = _expression_end(ts, pairs, j + 1)
                if j < body.stop and ts[j].text == ",":
                    j += 1
                    continue
                break
        elif t.text in ("function", "class") and after and after.kind == "name":
            out.add(after.text)
        elif t.text == "catch" and after and after.text == "(":
            out |= {ts[x].text for x in range(k + 2, pairs[k + 1]) if ts[x].kind == "name"}
        if t.text == "=>":
            inner = range(pairs[k - 1] + 1, k - 1) if ts[k - 1].text == ")" else range(k - 1, k)
            out |= {ts[x].text for x in inner if ts[x].kind == "name" and ts[x - 1].text not in (".", "?.", "=")}
        if t.text == "function" and (open_ := next((j for j in range(k + 1, min(k + 4, len(ts))) if ts[j].text == "("), None)) is not None:
            out |= {ts[x].text for x in range(open_ + 1, pairs[open_]) if ts[x].kind == "name" and ts[x - 1].text not in (".", "?.", "=")}
    return out


def _fingerprint(ts: list[Token], body: range, bound: set[str], flags: list[str]) -> list[str]:
    places: dict[str, str] = {}
    out = [f"MODE:{f}" for f in flags]
    for k in body:
        t, before = ts[k], ts[k - 1].text if k else ""
        after = ts[k + 1].text if k + 1 < len(ts) else ""
        if t.kind == "name":
            if before in (".", "?.") or (after == ":" and before in ("{", ",")):
                out.append("." + t.text)
            elif t.text in bound:
                out.append(places.setdefault(t.text, f"V{len(places)}"))
            else:
                out.append("#" + t.text)
        elif t.kind in ("number", "string", "template", "regexp"):
            out.append(f"<{t.kind}>")
        elif t.text not in (";", ",", ".", "?."):
            out.append(t.text)
    return out


def functions(source: str) -> list[dict]:
    """Functions, arrows and methods in order of their start, with tokens and UTF-8 byte spans; raises JsError."""
    ts = tokens(source)
    pairs = _pairs(ts)
    classes = _classes(ts, pairs)
    found: list[tuple[int, range, range, str | None, list[str]]] = []

    def block(k: int) -> int | None:
        """Opening brace of a body after the parameter list that closes at k, past a return type."""
        for j in range(k + 1, min(k + 12, len(ts))):
            if ts[j].text == "{":
                return j
            if ts[j].text in (";", ",", ")", "=>", "=", "}"):
                return None
        return None

    for k, t in enumerate(ts):
        lead = k - 1 if k and ts[k - 1].text == "async" else k
        flags = ["async"] if lead < k else []
        if t.kind == "keyword" and t.text == "function":
            j = k + 1
            if j < len(ts) and ts[j].text == "*":
                flags.append("generator")
                j += 1
            name = ts[j].text if j < len(ts) and ts[j].kind == "name" else _named_by(ts, lead)
            open_ = next((x for x in range(j, min(j + 3, len(ts))) if ts[x].text == "("), None)
            if open_ is not None and (b := block(pairs[open_])) is not None:
                found.append((lead, range(open_ + 1, pairs[open_]), range(b + 1, pairs[b]), name, flags))
        elif t.text == "=>" and k:
            start = pairs[k - 1] if ts[k - 1].text == ")" else k - 1
            lead = start - 1 if start and ts[start - 1].text == "async" else start
            flags = ["async"] if lead < start else []
            parameters = range(start + 1, k - 1) if ts[k - 1].text == ")" else range(start, k)
            braces = k + 1 < len(ts) and ts[k + 1].text == "{"
            body = range(k + 2, pairs[k + 1]) if braces else range(k + 1, _expression_end(ts, pairs, k + 1))
            found.append((lead, parameters, body, _named_by(ts, lead), flags))
        elif t.kind in ("name", "string") and k + 1 < len(ts) and ts[k + 1].text == "(" and t.text not in _NOT_METHODS and (not k or ts[k - 1].text in ("{", "}", ";", ",", "*", "get", "set", "static", "async")):
            b = block(pairs[k + 1])
            if b is not None:
                owner = next((name for a, z, name in reversed(classes) if a < k < z), None)
                flags = [f for f in ("async", "*") if k and ts[k - 1].text == f]
                name = t.text.strip("'\"")
                found.append((k, range(k + 2, pairs[k + 1]), range(b + 1, pairs[b]), f"{owner}.{name}" if owner else name, ["generator" if f == "*" else f for f in flags]))
    out = []
    for start, parameters, body, name, flags in sorted(found, key=lambda f: (f[0], -f[2].stop)):
        end = body.stop if body.stop < len(ts) and ts[body.stop].text == "}" and ts[body.start - 1].text == "{" else body.stop - 1
        a, z = ts[start].start, ts[max(end, start)].end
        marks = _fingerprint(ts, body, _bound(ts, pairs, parameters, body), flags)
        before = source[:a]
        first = len(before.encode())
        out.append({
            "symbol": name or "<anonymous>", "line": before.count("\n") + 1, "col": a - (before.rfind("\n") + 1) + 1, "tokens": marks, "semantic": sorted({m for m in marks if m[0] in "#." and len(m) > 1}),
            "start_byte": first, "end_byte": first + len(source[a:z].encode()), "source": source[a:z],
        })
    return out
