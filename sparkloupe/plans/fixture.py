"""A small source tree as literal rows, with what is expected of it.

The driver tables hold no source code, so the operators on syntax trees are registered over this tree; its
expectations were derived by hand from the rules' definitions and are a weaker check than an independent
formulation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES: dict[str, str] = {
    "src/app/__init__.py": "from .core import exported\n",
    "src/app/core.py": '''"""Core."""
import os
from app import util
from app.models import Model


def exported(path):
    return util.load(path) or Model()


def _orphan(value):
    return value + 1


def only_tested():
    return os.sep


def hook_for_tests():
    return 1


@register
def decorated_job():
    return 2


def mentioned():
    return 3
''',
    "src/app/util.py": '''import app.core
from app.models import *


def load(path):
    """Loads mentioned things."""
    try:
        return open(path).read()
    except OSError:
        pass


def save(path, text):
    try:
        path.write(text)
    except OSError:
        raise


def run(command, data):
    eval(command)
    os.system("ls " + command)
    subprocess.run(f"ls {command}", shell=True)
    subprocess.run("ls " + shlex.quote(command), shell=True)
    return write(command)


def write(command):
    return run(command)
''',
    "src/app/models.py": '''from app.util import save


class Model:
    api_key = "k9-Zx81-Qw22-Vb"
    password = "changeme"
    url = "https://api.acme.io/v1"
    docs = "https://docs.example.com/"
    ident = "550e8400-e29b-41d4-a716-446655440000"

    def stub(self):
        ...

    def get(self, a, b, c, d, e, f, g):
        assert a
        return save(a, b)


def helper_2(items):
    for i in range(len(items)):
        print(items[i])
    return items.get("a").get("b")


data1 = {}
if True:
    data1 = None
''',
    "src/app/flow.py": '''# TODO write this
# ---------

x = 1  # FIXME later #12
y = 2  # XXX soon


def pick(kind):
    # return kind
    return kind


def choose(kind):
    if kind == "a":
        return 1
    elif kind == "b":
        return 2
    elif kind in ("c", "d"):
        return 3
    elif kind == "e":
        return 4


def table(kind):
    if kind == 1:
        return "a"
    elif kind == 2:
        return "b"
    elif kind == 3:
        return "c"
    elif kind == 4:
        return "d"


def ladder(v):
    if isinstance(v, int):
        return 1
    elif isinstance(v, str):
        return 2
    elif isinstance(v, list):
        return 3
    elif isinstance(v, dict):
        return 4


def deep(a):
    for b in a:
        while b:
            with b:
                if b:
                    try:
                        pass
                    finally:
                        a()
''',
    "src/app/quiet.py": '''# ai-slop: ignore-file[eval]
eval("1")
exec("2")  # ai-slop: ignore
assert x  # ai-slop: ignore[security/assert-usage]
assert y  # ai-slop: ignore[other]
assert z  # ai-slop: ignore[]
text = "# ai-slop: ignore-file"
''',
    "src/app/forward.py": '''def relay(a, *args, **kwargs):
    return target(a, *args, **kwargs)


def partial(a, b):
    return target(a)


def make(a):
    return Thing(a)


@wraps
def adorned(a):
    return target(a)


async def later(a):
    """Doc."""
    return await target(a)


class Proxy:
    def send(self, a):
        return self.inner(a)
''',
    "src/app/same.py": '''a = sorted(sorted(x))
b = sorted(sorted(x, key=f), key=g)
c = list(tuple(x))
d = list(map(lambda v: v, x))
e = [v for v in x]
f = [v for v in x if v]
g = {k: v for k, v in x}
h = --x
i = ~~x
j = -+x
''',
    "src/app/bad.py": "def (:\n",
    "tests/test_core.py": "from app.core import exported\n\n\ndef test_1():\n    assert only_tested() and hook_for_tests() == 1\n",
}

#: (file, rule, line)
FINDINGS = (
    ("src/app/bad.py", "deadcode/parse-error", 1),
    ("src/app/flow.py", "ai-slop/python-repetitive-dispatch", 25),
    ("src/app/flow.py", "ai-slop/python-isinstance-ladder", 36),
    ("src/app/flow.py", "ai-slop/narrative-comment", 2),
    ("src/app/flow.py", "ai-slop/todo-stub", 5),
    ("src/app/flow.py", "ai-slop/trivial-comment", 9),
    ("src/app/flow.py", "code-quality/deep-nesting", 51),
    ("src/app/forward.py", "ai-slop/thin-wrapper", 1),
    ("src/app/forward.py", "ai-slop/thin-wrapper", 18),
    ("src/app/forward.py", "ai-slop/thin-wrapper", 24),
    ("src/app/models.py", "ai-slop/constant-condition", 26),
    ("src/app/models.py", "ai-slop/empty-function", 11),
    ("src/app/models.py", "ai-slop/generic-naming", 19),
    ("src/app/models.py", "ai-slop/generic-naming", 25),
    ("src/app/models.py", "ai-slop/hardcoded-id", 9),
    ("src/app/models.py", "ai-slop/hardcoded-url", 7),
    ("src/app/models.py", "ai-slop/python-chained-dict-get", 22),
    ("src/app/models.py", "ai-slop/python-range-len-loop", 20),
    ("src/app/models.py", "code-quality/too-many-params", 14),
    ("src/app/models.py", "security/assert-usage", 15),
    ("src/app/models.py", "security/hardcoded-secret", 5),
    ("src/app/quiet.py", "security/assert-usage", 5),
    ("src/app/quiet.py", "security/assert-usage", 6),
    ("src/app/util.py", "ai-slop/redundant-try-catch", 16),
    ("src/app/util.py", "ai-slop/swallowed-exception", 9),
    ("src/app/util.py", "ai-slop/thin-wrapper", 28),
    ("src/app/util.py", "security/eval", 21),
    ("src/app/util.py", "security/shell-injection", 22),
    ("src/app/util.py", "security/shell-injection", 23),
)

#: (line, kind) in src/app/same.py
REDUNDANCIES = (
    (1, "collapsible-composition"), (3, "collapsible-composition"), (4, "identity-map"), (4, "identity-map"), (5, "identity-comprehension"),
    (7, "identity-comprehension"), (8, "involution"), (9, "involution"),
)

#: (symbol, class) of src/app/core.py and src/app/util.py
DEAD = (("_orphan", "orphaned"), ("only_tested", "test-only"), ("hook_for_tests", "test-support"), ("decorated_job", "decorated"), ("mentioned", "unresolved"))

CYCLES = ("app.core <-> app.models <-> app.util",)


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*FILES.items()], "path string, source string")
