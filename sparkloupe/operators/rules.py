"""The rule dimension and the rules over one parsed Python source.

Every rule is a function of (source, node) registered for node types, or of the source alone; all run in
one walk over the tree.  A rule yields (rule, line, detail).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

from sparkloupe.functions import text as patterns
from sparkloupe.functions.pysource import FUNCTIONS, Source, chain, is_text, stem, without_docstring

Hit = tuple[str, int, str | None]

#: Rule, engine, severity, category, style.
RULES: tuple[tuple[str, str, str, str, bool], ...] = (
    ("ai-slop/swallowed-exception", "ai-slop", "error", "Error handling", False),
    ("ai-slop/redundant-try-catch", "ai-slop", "warning", "Error handling", True),
    ("ai-slop/thin-wrapper", "ai-slop", "warning", "Indirection", True),
    ("ai-slop/generic-naming", "ai-slop", "info", "Naming", True),
    ("ai-slop/todo-stub", "ai-slop", "info", "AI Slop", False),
    ("ai-slop/trivial-comment", "ai-slop", "info", "AI Slop", True),
    ("ai-slop/narrative-comment", "ai-slop", "info", "AI Slop", True),
    ("ai-slop/constant-condition", "ai-slop", "warning", "Control flow", False),
    ("ai-slop/empty-function", "ai-slop", "info", "Control flow", False),
    ("ai-slop/hardcoded-url", "ai-slop", "warning", "Hard-coded configuration", False),
    ("ai-slop/hardcoded-id", "ai-slop", "warning", "Hard-coded configuration", False),
    ("ai-slop/python-range-len-loop", "ai-slop", "info", "Python idioms", True),
    ("ai-slop/python-chained-dict-get", "ai-slop", "warning", "Python idioms", False),
    ("ai-slop/python-repetitive-dispatch", "ai-slop", "warning", "Python idioms", False),
    ("ai-slop/python-isinstance-ladder", "ai-slop", "warning", "Python idioms", False),
    ("code-quality/function-too-long", "code-quality", "warning", "Complexity", True),
    ("code-quality/file-too-large", "code-quality", "warning", "Complexity", True),
    ("code-quality/deep-nesting", "code-quality", "warning", "Complexity", False),
    ("code-quality/too-many-params", "code-quality", "warning", "Complexity", False),
    ("security/hardcoded-secret", "security", "error", "Secrets", False),
    ("security/eval", "security", "error", "Dynamic code execution", False),
    ("security/shell-injection", "security", "error", "Shell injection", False),
    ("security/assert-usage", "security", "warning", "Runtime validation", False),
    ("security/dynamic-import", "security", "error", "Dynamic imports", False),
    ("deadcode/parse-error", "code-quality", "error", "Parse", False),
    ("deadcode/detector-error", "code-quality", "error", "Parse", False),
    ("reachability/dead-symbol", "reachability", "error", "Reachability", False),
    ("javascript/unused-variable", "code-quality", "warning", "JavaScript quality", False),
    ("javascript/unreachable", "code-quality", "error", "JavaScript quality", False),
    ("javascript/empty-block", "code-quality", "warning", "JavaScript quality", False),
    ("javascript/parse-error", "code-quality", "error", "JavaScript quality", False),
)

#: Limits of the complexity rules.
MAX_FUNCTION_LINES, MAX_FILE_LINES, MAX_NESTING, MAX_PARAMS, MIN_BRANCHES = 80, 500, 5, 6, 4

_BY_NODE: dict[type, list[Callable[[Source, ast.AST], Iterator[Hit]]]] = {}
_BY_FILE: list[Callable[[Source], Iterator[Hit]]] = []


def on(*kinds: type):
    def add(rule):
        for kind in kinds:
            _BY_NODE.setdefault(kind, []).append(rule)
        return rule

    return add


def on_file(rule):
    _BY_FILE.append(rule)
    return rule


def check(source: Source) -> list[Hit]:
    """All hits of a source; a rule that fails is a hit of its own and stops no other."""
    out: list[Hit] = []

    def run(rule, *given) -> None:
        try:
            out.extend(rule(*given))
        except Exception as error:  # noqa: BLE001 - reported as a finding
            hit = ("deadcode/detector-error", 1, f"{rule.__name__}: {type(error).__name__}: {error}")
            if hit not in out:
                out.append(hit)

    for node in source.nodes:
        for rule in _BY_NODE.get(type(node), ()):
            run(rule, source, node)
    for rule in _BY_FILE:
        run(rule, source)
    return out


# error handling


def _only_logs(call: ast.Call) -> bool:
    root = call.func
    if isinstance(root, ast.Name):
        return root.id == "print"
    if chain(root) == ["warnings", "warn"]:
        return True
    while isinstance(root, ast.Attribute | ast.Call):
        root = root.value if isinstance(root, ast.Attribute) else root.func
    return isinstance(call.func, ast.Attribute) and isinstance(root, ast.Name) and root.id in ("logger", "logging", "log")


@on(ast.ExceptHandler)
def exception_handlers(source: Source, node: ast.ExceptHandler) -> Iterator[Hit]:
    sole = node.body[0] if len(node.body) == 1 else None
    if any(isinstance(n, ast.Raise) for s in node.body for n in ast.walk(s)):
        if isinstance(sole, ast.Raise) and sole.exc is None:
            yield "ai-slop/redundant-try-catch", node.lineno, None
        return
    match sole:
        case ast.Pass() | ast.Continue() | ast.Break():
            yield "ai-slop/swallowed-exception", node.lineno, type(sole).__name__.lower()
        case ast.Expr(value=ast.Constant(value=v)) if v is ...:
            yield "ai-slop/swallowed-exception", node.lineno, "..."
        case ast.Expr(value=ast.Call() as call) if _only_logs(call):
            yield "ai-slop/swallowed-exception", node.lineno, "log-and-continue"


# naming and wrappers


@on(ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
def definition_names(source: Source, node) -> Iterator[Hit]:
    if not source.is_test and (re.search(patterns.GENERIC_NAME, node.name) or node.name.lower() in ("foo", "bar", "baz", "qux", "foobar")):
        yield "ai-slop/generic-naming", node.lineno, node.name


@on_file
def module_names(source: Source) -> Iterator[Hit]:
    todo = [] if source.is_test else [t for s in source.tree.body if isinstance(s, ast.Assign | ast.AnnAssign) for t in (s.targets if isinstance(s, ast.Assign) else [s.target])]
    while todo:
        match todo.pop(0):
            case ast.Name(id=name, lineno=line) if re.search(patterns.GENERIC_NAME, name):
                yield "ai-slop/generic-naming", line, name
            case ast.Tuple(elts=parts) | ast.List(elts=parts):
                todo = [*parts, *todo]
            case ast.Starred(value=inner):
                todo.insert(0, inner)


def _forwarded(call: ast.Call) -> tuple[list[str], str | None, list[str | None]] | None:
    """Names passed on: positional, after *, after **; None when anything else is passed."""
    plain = [a.id for a in call.args if isinstance(a, ast.Name)]
    star = [a.value.id for a in call.args[-1:] if isinstance(a, ast.Starred) and isinstance(a.value, ast.Name)]
    double = [k.value.id if isinstance(k.value, ast.Name) else None for k in call.keywords if k.arg is None]
    whole = len(plain) + len(star) == len(call.args) and len(double) == len(call.keywords)
    return (plain, star[0] if star else None, double) if whole else None


@on(ast.FunctionDef, ast.AsyncFunctionDef)
def thin_wrappers(source: Source, node) -> Iterator[Hit]:
    match without_docstring(node.body):
        case [ast.Return(value=ast.Call() as call)] | [ast.Return(value=ast.Await(value=ast.Call() as call))]:
            pass
        case _:
            return
    given, names = node.args, [a.arg for a in node.args.args]
    own = chain(call.func)
    if node.decorator_list or given.kwonlyargs or given.posonlyargs or own == [node.name] or (own and names and own == [names[0], node.name]):
        return
    if own and len(own) == 2 and names and own[0] == names[0]:
        names = names[1:]  # a method of the first parameter
    if _forwarded(call) != (names, given.vararg and given.vararg.arg, [given.kwarg.arg] if given.kwarg else []):
        return
    if own:
        imported = {a.asname or (a.name.split(".")[0] if isinstance(n, ast.Import) else a.name) for n in source.nodes if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names}
        if own[-1][:1].isupper() or (own[0].startswith("_") and len(own) > 1) or own[0] in imported:
            return
    yield "ai-slop/thin-wrapper", node.lineno, ".".join(own or [])


# control flow


@on(ast.If)
def constant_conditions(source: Source, node: ast.If) -> Iterator[Hit]:
    if isinstance(node.test, ast.Constant) and node.test.value is not ...:
        yield "ai-slop/constant-condition", node.lineno, None


def _last_name(node: ast.expr) -> str | None:
    node = node.func if isinstance(node, ast.Call) else node
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


@on(ast.FunctionDef, ast.AsyncFunctionDef)
def empty_functions(source: Source, node) -> Iterator[Hit]:
    match without_docstring(node.body):
        case [ast.Pass()]:
            pass
        case [ast.Expr(value=ast.Constant(value=v))] if v is ...:
            pass
        case _:
            return
    if any(_last_name(d) in ("abstractmethod", "overload", "abstractproperty") for d in node.decorator_list):
        return
    around = source.ancestors(node)
    owner = next((a for a in around if isinstance(a, (*FUNCTIONS, ast.ClassDef))), None)
    if isinstance(owner, ast.ClassDef):
        bases = [_last_name(b.value if isinstance(b, ast.Subscript) else b) or "" for b in owner.bases]
        if any(b in ("ABC", "ABCMeta") or b.endswith("Protocol") for b in bases):
            return
    if any(isinstance(a, ast.If) and (chain(a.test) or [""])[-1] == "TYPE_CHECKING" for a in around):
        return
    yield "ai-slop/empty-function", node.lineno, node.name


def _arms(node: ast.If) -> list[ast.If]:
    out = [node]
    while len(out[-1].orelse) == 1 and isinstance(out[-1].orelse[0], ast.If):
        out.append(out[-1].orelse[0])
    return out


def _case(test: ast.expr) -> tuple[str, str] | None:
    """What an arm compares with a literal."""
    match test:
        case ast.Compare(left=left, ops=[ast.Eq() | ast.In() as op], comparators=[right]):
            items = right.elts if isinstance(right, ast.Tuple | ast.List | ast.Set) else [right]
            if items and all(isinstance(x, ast.Constant) for x in items):
                return ast.dump(left), type(op).__name__
    return None


def _checked_type(test: ast.expr) -> str | None:
    match test:
        case ast.Call(func=ast.Name(id="isinstance"), args=[subject, _], keywords=[]):
            return ast.dump(subject)
    return None


@on(ast.If)
def if_chains(source: Source, node: ast.If) -> Iterator[Hit]:
    above = source.parent.get(node)
    if isinstance(above, ast.If) and above.orelse == [node]:
        return
    tests = [a.test for a in _arms(node)]
    if len(tests) < MIN_BRANCHES:
        return
    for key, rule in ((_case, "repetitive-dispatch"), (_checked_type, "isinstance-ladder")):
        keys = {key(t) for t in tests}
        if len(keys) == 1 and None not in keys:
            yield f"ai-slop/python-{rule}", node.lineno, f"{len(tests)} branches"
            return


@on(ast.For, ast.AsyncFor)
def range_len(source: Source, node) -> Iterator[Hit]:
    match node.iter:
        case ast.Call(func=ast.Name(id="range"), args=[ast.Call(func=ast.Name(id="len"))], keywords=[]):
            yield "ai-slop/python-range-len-loop", node.lineno, None


def _lookup(node: ast.AST) -> int:
    """Number of arguments when a node is a .get() call of one or two, else 0."""
    match node:
        case ast.Call(func=ast.Attribute(attr="get"), args=[_] | [_, _] as given, keywords=[]):
            return len(given)
    return 0


@on_file
def chained_lookups(source: Source) -> Iterator[Hit]:
    told: set[ast.AST] = set()
    for node in source.nodes:
        if _lookup(node) and node not in told and _lookup(node.func.value) == 1:
            yield "ai-slop/python-chained-dict-get", node.lineno, None
            below = node.func.value
            while isinstance(below, ast.Call):
                told.add(below)
                below = below.func.value if isinstance(below.func, ast.Attribute) else None


# comments

_OWNED = re.compile(r"\b(?:type|noqa|pragma|pylint|mypy|ruff|flake8|isort|TODO|FIXME|HACK|XXX)\b", re.I)
#: Words by which a comment gives a reason, words without content, and verbs by operation.
_REASON = re.compile(
    r"\b(?:because|since|so\s+that|otherwise|workaround|caveat|note|warning|important|assume[sd]?|if|when|unless|until|only|except|needs?|must|should|ensure|avoid|prevent|requires?|"
    r"why|reason|e\.g\.|i\.e\.|for\s+example|in\s+order\s+to|to\s+avoid|to\s+prevent|hack\s+for)\b",
    re.I,
)
_EMPTY_WORDS = frozenset("a an the this that these those it its to of for and or in on at by with from into now then here value result all each every we is are be".split())
_VERBS: tuple[tuple[type, str], ...] = (
    (ast.Return, "return"), (ast.Import, "import"), (ast.ImportFrom, "import"), (ast.Raise, "raise throw"), (ast.Assert, "assert check"),
    (ast.Delete, "delete remov del"), (ast.For, "loop iterat"), (ast.While, "loop"), (ast.Yield, "yield"),
)
_CHANGES: tuple[tuple[type, str], ...] = (
    (ast.Add, "increment increas add bump raise grow"), (ast.Sub, "decrement decreas subtract reduc lower drop"),
    (ast.Mult, "multipli scal multiply"), (ast.Div, "divid divide"),
)
_HEADING = re.compile(r"^[-=*#_~]{3,}\s*\S.*?\s*[-=*#_~]{3,}\s*$|^(?:Step|Phase|Part|Section)\s+\d+\s*[:.\-)]", re.I)
_BLOCKS = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.ClassDef, *FUNCTIONS)


def _is_rule_line(body: str) -> bool:
    return bool(re.search(patterns.SEPARATOR, body))


def _is_directive(body: str) -> bool:
    return body.startswith(("!", "-*-")) or bool(_OWNED.search(body))


def _verbs(source: Source) -> dict[int, set[str]]:
    out: dict[int, set[str]] = {}
    for node in source.nodes:
        kinds, subject = (_CHANGES, node.op) if isinstance(node, ast.AugAssign) else (_VERBS, node)
        if words := next((w for kind, w in kinds if isinstance(subject, kind)), ""):
            out.setdefault(node.lineno, set()).update(map(stem, words.split()))
    return out


@on_file
def comment_rules(source: Source) -> Iterator[Hit]:
    alone = {c.line for c in source.comments if not c.inline}
    rules = {c.line for c in source.comments if _is_rule_line(c.body)}
    labels = {c.line for c in source.comments if not c.inline and c.body and c.line not in rules and not _is_directive(c.body) and any(map(str.isalpha, c.body))}
    verbs = opening = None
    for c in source.comments:
        near = {c.line - 1, c.line + 1}
        if re.search(patterns.TODO_MARKER, c.body) and not re.search(patterns.TRACKER, c.body) and (c.inline or not near & alone):
            yield "ai-slop/todo-stub", c.line, c.body
        if not c.body or _is_directive(c.body):
            continue
        if c.line in rules:
            if not near & labels:
                yield "ai-slop/narrative-comment", c.line, c.body
            continue
        if _REASON.search(c.body) or _HEADING.search(c.body) or near & rules:
            continue
        content = {stem(w) for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", c.body)} - _EMPTY_WORDS
        later = [c.line] if c.inline else range(c.line + 1, source.n_lines + 2)
        target = next((n for n in later if n in source.words), None)
        if not content or target is None:
            continue
        if verbs is None:
            verbs, opening = _verbs(source), {n.lineno for n in source.nodes if isinstance(n, _BLOCKS)}
        if (c.inline or target not in opening) and content <= source.words[target] | verbs.get(target, set()):
            yield "ai-slop/trivial-comment", c.line, c.body


# literals

#: Hosts that are documentation or this machine, and vendor prefixes of ids.
_DOC_HOSTS = ("w3.org", "json-schema.org", "xmlns.com", "example.com", "example.org", "example.net", "purl.org", "tools.ietf.org", "rfc-editor.org", "iana.org", "github.com", "githubusercontent.com")
_LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
_ID = re.compile(r"^(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:proj|acct|org|key|sk|pk)_[A-Za-z0-9]{10,}|[0-9a-fA-F]{24,}|(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9-]{24,})$")
_FAKE_ID = re.compile(r"xxxx|<|>|your-|your_|todo|changeme|replace", re.I)


def is_service_url(value: str) -> bool:
    found = re.match(r"\s*https?://([^/\s:?#]+)", value, re.I)
    host = found[1].split("@")[-1].lower() if found else ""
    if "." not in host or host in _LOCAL_HOSTS or host.endswith(".local") or host.startswith(("schemas.", "schema.")):
        return False
    return not any(host == d and d != "githubusercontent.com" or host.endswith("." + d) for d in _DOC_HOSTS)


def is_opaque_id(value: str) -> bool:
    plain = set(re.sub("[^0-9a-z]", "", value.lower()))
    return not _FAKE_ID.search(value) and len(plain) != 1 and bool(_ID.match(value))


def _values(node: ast.expr | None) -> list[ast.Constant]:
    items = node.elts if isinstance(node, ast.List | ast.Tuple | ast.Set) else node.values if isinstance(node, ast.Dict) else [node]
    return [x for x in items if is_text(x)]


@on_file
def literals(source: Source) -> Iterator[Hit]:
    told: set[tuple[str, int]] = set()
    for node in () if source.is_test else source.nodes:
        match node:
            case ast.Assign(value=v) | ast.AnnAssign(value=v) | ast.AugAssign(value=v):
                roots = [v]
            case ast.Call():
                roots = [*node.args, *(k.value for k in node.keywords)]
            case ast.arguments():
                roots = [*node.defaults, *node.kw_defaults]
            case _:
                continue
        for x in (x for r in roots for x in _values(r)):
            rule = "ai-slop/hardcoded-url" if is_service_url(x.value) else "ai-slop/hardcoded-id" if is_opaque_id(x.value) else None
            if rule and (rule, x.lineno) not in told:
                told.add((rule, x.lineno))
                yield rule, x.lineno, None


# complexity


def _nesting(body: list[ast.stmt], depth: int = 1) -> tuple[int, ast.stmt | None]:
    """Depth and first statement of the deepest control flow; an elif chain is one level, nested scopes are apart."""
    best: tuple[int, ast.stmt | None] = (depth, None)
    for statement in body:
        match statement:
            case ast.If():
                arms = [statement]
                while len(arms[-1].orelse) == 1 and isinstance(arms[-1].orelse[0], ast.If) and arms[-1].orelse[0].col_offset == statement.col_offset:
                    arms.append(arms[-1].orelse[0])
                suites = [*(a.body for a in arms), arms[-1].orelse]
            case ast.For() | ast.AsyncFor() | ast.While():
                suites = [statement.body, statement.orelse]
            case ast.With() | ast.AsyncWith():
                suites = [statement.body]
            case ast.Try() | ast.TryStar():
                suites = [statement.body, statement.orelse, statement.finalbody, *(h.body for h in statement.handlers)]
            case ast.Match():
                suites = [c.body for c in statement.cases]
            case _:
                continue
        for suite in filter(None, suites):
            deep, where = _nesting(suite, depth + 1)
            if deep > best[0]:
                best = deep, where or statement
    return best


@on(ast.FunctionDef, ast.AsyncFunctionDef)
def function_size(source: Source, node) -> Iterator[Hit]:
    document = set() if without_docstring(node.body) == node.body else set(range(node.body[0].lineno, node.body[0].end_lineno + 1))
    n = len(source.code_lines & set(range(node.body[0].lineno, node.body[-1].end_lineno + 1)) - document)
    if n > MAX_FUNCTION_LINES:
        yield "code-quality/function-too-long", node.lineno, f"{n} lines"
    depth, where = _nesting(node.body)
    if depth > MAX_NESTING and where:
        yield "code-quality/deep-nesting", where.lineno, f"depth {depth}"
    places = node.args.posonlyargs + node.args.args
    receiver = bool(places) and places[0].arg in ("self", "cls")
    required = max(0, len(places) - receiver - len(node.args.defaults)) + node.args.kw_defaults.count(None)
    if required > MAX_PARAMS:
        yield "code-quality/too-many-params", node.lineno, f"{required} params"


@on_file
def file_size(source: Source) -> Iterator[Hit]:
    if source.n_lines > MAX_FILE_LINES:
        yield "code-quality/file-too-large", 1, f"{source.n_lines} lines"


# security

#: Fillers that are no credential.
_FILLERS = frozenset("changeme redacted dummy test example none null todo fixme fake placeholder secret xxxxxx".split())


def is_filler(value: str) -> bool:
    v = value.strip().lower()
    framed = v.startswith("<") and v.endswith(">")
    return len(set(v)) < 2 or v in _FILLERS or framed or "{{" in v or "${" in v or v.endswith(("-here", "_here")) or v.startswith("your-")


@on(ast.Assign, ast.AnnAssign)
def secrets(source: Source, node) -> Iterator[Hit]:
    if source.is_test or not is_text(node.value) or is_filler(node.value.value):
        return
    value, targets = node.value.value, node.targets if isinstance(node, ast.Assign) else [node.target]
    names = [t.id if isinstance(t, ast.Name) else t.attr for t in targets if isinstance(t, ast.Name | ast.Attribute)]
    shaped = re.match(patterns.SECRET_SHAPE, value)
    plain = value.strip()
    named = any(re.search(patterns.SECRET_NAME, n) for n in names) and len(plain) >= 8 and re.search(r"\d|[^A-Za-z0-9_]", plain)
    if shaped or named:
        yield "security/hardcoded-secret", node.lineno, "shape" if shaped else "name"


@on(ast.Assert)
def asserts(source: Source, node: ast.Assert) -> Iterator[Hit]:
    if not source.is_test:
        yield "security/assert-usage", node.lineno, None


def _is_quoted(node: ast.expr) -> bool:
    match node:
        case ast.BinOp(op=ast.Add(), left=a, right=b):
            return _is_quoted(a) and _is_quoted(b)
        case ast.Call(func=ast.Attribute(value=ast.Name(id="shlex"), attr="quote")):
            return True
    return is_text(node)


def _is_built(node: ast.expr) -> bool:
    """A command put together from something that is not literal."""
    match node:
        case ast.Name() | ast.JoinedStr() | ast.BinOp(op=ast.Mod()):
            return True
        case ast.BinOp(op=ast.Add()):
            return not _is_quoted(node)
        case ast.Call(func=ast.Attribute(attr="format", value=v)):
            return is_text(v)
    return False


@on(ast.Call)
def calls(source: Source, node: ast.Call) -> Iterator[Hit]:
    match node.func:
        case ast.Name(id=name):
            base = None
        case ast.Attribute(attr=name, value=root):
            base = root.id if isinstance(root, ast.Name) else None
        case _:
            return
    if isinstance(node.func, ast.Name) and name in ("eval", "exec"):
        yield "security/eval", node.lineno, name
    if (base, name) == ("importlib", "import_module") or (base is None and name == "__import__"):
        yield "security/dynamic-import", node.lineno, name
    shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
    runs = base in (None, "subprocess") and name in ("run", "call", "check_call", "check_output", "Popen") and shell
    if (runs or (base, name) == ("os", "system")) and node.args and _is_built(node.args[0]):
        yield "security/shell-injection", node.lineno, name


# redundant transformations, reported apart from the rules

#: Calls that change nothing when repeated, and inner calls that an outer one undoes.
_REPEATABLE = frozenset("sorted set frozenset abs round bool str int float list tuple dict".split())
_ABSORBED = {"list": ("tuple",), "tuple": ("list",), "dict": ("list", "tuple"), "set": ("list", "tuple", "sorted"), "frozenset": ("list", "tuple", "sorted"), "sorted": ("list", "tuple")}


def _called(node: ast.AST) -> str | None:
    return node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else None


def _takes_one(node: ast.Call) -> bool:
    return len(node.args) == 1 and not node.keywords and not isinstance(node.args[0], ast.Starred)


def _returns_input(node: ast.AST | None) -> bool:
    match node:
        case ast.Lambda(args=ast.arguments(args=[ast.arg(arg=a)], vararg=None, kwarg=None, kwonlyargs=[]), body=ast.Name(id=b)):
            return a == b
    return False


def redundancies(source: Source) -> list[tuple[int, str]]:
    """(line, kind), sorted."""
    out: list[tuple[int, str]] = []
    for node in source.nodes:
        match node:
            case ast.Call(func=ast.Name(id=outer), args=[first, *_]):
                inner = _called(first)
                same = inner == outer and outer in _REPEATABLE and _takes_one(node) and _takes_one(first)
                if same or inner in _ABSORBED.get(outer, ()):
                    out.append((node.lineno, "collapsible-composition"))
                if inner == "map" and outer in ("list", "set", "tuple") and first.args and _returns_input(first.args[0]):
                    out.append((node.lineno, "identity-map"))
                if outer == "map" and _returns_input(first):
                    out.append((node.lineno, "identity-map"))
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() | ast.Invert() as op, operand=ast.UnaryOp(op=below)) if type(op) is type(below):
                out.append((node.lineno, "involution"))
            case ast.ListComp(elt=ast.Name(id=x), generators=[g]) | ast.SetComp(elt=ast.Name(id=x), generators=[g]) | ast.GeneratorExp(elt=ast.Name(id=x), generators=[g]):
                if isinstance(g.target, ast.Name) and g.target.id == x and not g.ifs and not g.is_async:
                    out.append((node.lineno, "identity-comprehension"))
            case ast.DictComp(key=ast.Name(id=k), value=ast.Name(id=v), generators=[g]):
                match g.target:
                    case ast.Tuple(elts=[ast.Name(id=a), ast.Name(id=b)]) if (a, b) == (k, v) and not g.ifs and not g.is_async:
                        out.append((node.lineno, "identity-comprehension"))
    return sorted(out)
