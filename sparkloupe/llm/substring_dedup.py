"""Operator 3: substring deduplication by recompression.

A round of recompression replaces every run of equal symbols by one run symbol and, with the alphabet split in
two by a hash bit, every adjacent (left, right) pair by one pair symbol; rounds repeat until a document is one
symbol.  A symbol's name is a function of what it was made from, in two lanes of 64 bits, so all documents name
alike; the Spark rounds below gather the names of all documents in one dictionary, which tells for each symbol
the smallest document that holds it.  Equal names mean equal words.

1. Long repeats.  The symbols of at least a window's words, taken every EVERY rounds up to the whole document,
   go to the dictionary.  Where one also stands in a smaller document, all its words are covered: they go, and
   the windows inside it need no further look.  So exact copies and long passages, however many, are settled by
   a few symbols, and only the first holder goes on.
2. Windows.  The symbols of the first rounds span at most four words.  The one over the middle of a window
   depends on that window alone (these rounds only rename the inside of a run, so that nothing beyond the window
   counts), and so does its core, the words common to all windows around it.  A second part of the dictionary
   holds the cores; where one stands in two documents, the windows around it that step 1 did not settle are
   named, and a last Spark round finds the smallest document of each.
3. Words covered by a window that starts in a document with a smaller id are removed.

Documents are dealt to groups of a bounded size; each group sends every different name once, with its smallest
document, packed in arrays.  A name therefore has at most one entry of each group, however many copies there are.

Cases: null and empty texts have no words; a text shorter than a window keeps all; repeated rows of one
doc_id count as one document; a row without doc_id keeps all its words and removes none elsewhere; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.llm.common import STEP_BYTES, U64, Block, blocks, free_shuffles, gram_names, mix, n_groups, stored, table, text_views

WINDOW = 13
#: Rounds after which long symbols are first taken, and then every so many more.
HIGH, EVERY = 8, 4
#: Rounds after which a document that is not yet one symbol is left as it is.
MOST = 64
#: Names that a group holds before it reduces them.
FLUSH = 1 << 20
_RUN, _PAIR = 91, 92
_CORE, _LONG, _WINDOW = 0, 1, 2


class Symbols:
    """The symbols of a block: names in two lanes, document, first word, number of words; fresh: not yet taken."""

    def __init__(self, name: np.ndarray, other: np.ndarray, doc: np.ndarray) -> None:
        self.name, self.other, self.doc = name, other, doc
        self.start, self.size, self.fresh = np.arange(len(name)), np.ones(len(name), np.int64), np.ones(len(name), bool)

    def _keep(self, keep: np.ndarray) -> None:
        for k in ("name", "other", "doc", "start", "size", "fresh"):
            setattr(self, k, getattr(self, k)[keep])

    def _equal(self) -> np.ndarray:
        return (self.doc[1:] == self.doc[:-1]) & (self.name[1:] == self.name[:-1]) & (self.other[1:] == self.other[:-1])

    def runs(self) -> None:
        """Every run of equal symbols becomes one symbol, named by symbol and length."""
        at = np.flatnonzero(np.append(True, ~self._equal()))
        length = np.diff(np.append(at, len(self.name)))
        whole = np.add.reduceat(self.size, at)
        self._keep(at)
        many = length > 1
        n = length[many].astype(U64)
        self.name[many] = mix(mix(self.name[many], _RUN) + n, _RUN)
        self.other[many] = mix(mix(self.other[many], _RUN + 1000) + n, _RUN + 1000)
        self.size, self.fresh[many] = whole, True

    def inner_runs(self) -> np.ndarray:
        """The inside of a run gets the run's name, its ends stay: a symbol then tells nothing of what is further away."""
        equal = self._equal()
        inside = np.append(False, equal) & np.append(equal, False)
        self.name, self.other = np.where(inside, mix(self.name, _RUN), self.name), np.where(inside, mix(self.other, _RUN + 1000), self.other)
        return inside

    def pairs(self, k: int, whole: np.ndarray | None = None) -> None:
        """Every adjacent pair of a left and a right symbol becomes one; whole: symbols that stay."""
        if len(self.name) < 2:
            return
        right = mix(self.name, k + 1) & U64(1) == 1
        pair = np.append((self.doc[1:] == self.doc[:-1]) & ~right[:-1] & right[1:], False)
        if whole is not None:
            pair &= ~whole & ~np.append(whole[1:], False)
        at = np.flatnonzero(pair)
        self.name[at] = mix(mix(self.name[at], _PAIR) + self.name[at + 1], _PAIR)
        self.other[at] = mix(mix(self.other[at], _PAIR + 1000) + self.other[at + 1], _PAIR + 1000)
        self.size[at] += self.size[at + 1]
        self.fresh[at] = True
        keep = np.ones(len(self.name), bool)
        keep[at + 1] = False
        self._keep(keep)


def _documents(block: Block) -> np.ndarray:
    count = np.diff(block.first)
    return np.repeat(np.arange(len(count)), count)


def short_symbols(block: Block, window: int) -> Symbols:
    """The symbols of the rounds whose names depend on no word outside a window around them."""
    middle = (window - 1) // 2
    found = Symbols(block.name.copy(), block.name, _documents(block))
    for k in range(2 if middle >= 6 else 1 if middle >= 2 else 0):
        if len(found.name) > 1:
            found.pairs(k, found.inner_runs())
    return found


def long_symbols(block: Block, other: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, name, other name, first word, number of words) of the symbols of at least a window's words."""
    now = Symbols(block.name.copy(), other.copy(), _documents(block))
    size = np.diff(block.first)
    if size.max(initial=0) < window:
        return tuple(np.empty(0, t) for t in (np.int64, U64, U64, np.int64, np.int64))
    now._keep((size >= window)[now.doc])
    least = int((size >= window).sum())
    out = []
    for k in range(1, MOST + 1):
        now.runs()
        now.pairs(k)
        done = len(now.name) <= least or k == MOST
        if done or (k >= HIGH and (k - HIGH) % EVERY == 0):
            take = now.fresh & (now.size >= window)
            out.append(tuple(getattr(now, c)[take] for c in ("doc", "name", "other", "start", "size")))
            now.fresh[:] = False
        if done:
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cores(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each short symbol with at least one window around it: document, name of its core, first and last window."""
    middle = (window - 1) // 2
    found = short_symbols(block, window)
    own, start, size = found.doc, found.start, found.size
    a, b = start + size - 1 - middle, start - middle + window
    ok = (a >= block.first[own]) & (b <= block.first[own + 1])
    low = np.maximum(start - middle, block.first[own])
    high = np.minimum(a, block.first[own + 1] - window)
    ok &= low <= high  # a text a little shorter than a window can hold a core
    a, own, low, high, size = a[ok], own[ok], low[ok], high[ok], size[ok]
    name = np.empty(len(a), U64)
    if len(a):
        sizes = np.unique(size).tolist()
        grams = gram_names(block.name, [window + 1 - n for n in sizes])
        for n in sizes:
            name[size == n] = grams[window + 1 - n][a[size == n]]
    return own, name, low, high


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers plane by plane, which general compressors shrink."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def _unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel() if data else np.empty(0, dtype)


def _reduced(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each different key once, sorted, with its smallest and its largest document."""
    order = np.lexsort(keys[::-1])
    keys, low, high = [k[order] for k in keys], low[order], high[order]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if len(low) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.minimum.reduceat(low, at) if len(at) else low, np.maximum.reduceat(high, at) if len(at) else high


class _Gathered:
    """The different names of a group with their smallest and largest documents."""

    def __init__(self, lanes: int) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.lanes = 0, lanes

    def add(self, keys: list[np.ndarray], doc: np.ndarray) -> None:
        self.held.append((*keys, doc, doc))
        self.size += len(doc)
        if self.size >= FLUSH:
            self.held = [self.whole()]
            self.size = len(self.held[0][0]) // 2

    def whole(self) -> tuple[np.ndarray, ...]:
        *keys, low, high = map(np.concatenate, zip(*self.held, strict=True)) if self.held else (*[np.empty(0, U64)] * self.lanes, np.empty(0, np.int64), np.empty(0, np.int64))
        keys, low, high = _reduced(keys, low, high)
        return (*keys, low, high)


#: Rows of the dictionary: bucket, part, the group that sends them, packed names in two lanes, smallest documents, and whether they have a second document.
_ENTRY = pa.schema([("g", pa.int32()), ("part", pa.int32()), ("src", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("low", pa.binary()), ("many", pa.binary())])
_ENTRY_SQL = "g int, part int, src int, a binary, b binary, low binary, many binary"
_MARK_SQL = "g int, part int, a binary, b binary, low binary"


def _entries(part: int, src: int, found: tuple[np.ndarray, ...], bits: int) -> list[tuple]:
    """Entries of a group by bucket.  Of a core 32 bits beside the bucket's are sent; shared cores are only candidates."""
    name, *other, low, high = found
    bucket = (name >> U64(64 - bits)).astype(np.int64)
    out = []
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for i, j in zip(edge, [*edge[1:], len(bucket)], strict=True) if len(bucket) else ():
        many = np.packbits(high[i:j] > low[i:j]).tobytes()
        if part == _CORE:
            out.append((int(bucket[i]), part, src, _planes(name[i:j].astype(np.uint32)), None, None, many))
        else:
            out.append((int(bucket[i]), part, src, _planes(name[i:j]), _planes(other[0][i:j]), _planes(low[i:j]), many))
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def looked_up(entries: DataFrame) -> DataFrame:
    """The dictionary's answer to each group: its shared cores, and its names that a smaller document holds, with that document."""
    schema = pa.schema([f for f in _ENTRY if f.name in ("g", "part", "a", "b", "low")])

    def run(rows: pa.Table) -> pa.Table:
        bucket, part = rows.column("g")[0].as_py(), rows.column("part")[0].as_py()
        kind = np.uint32 if part == _CORE else U64
        name = [_unplanes(x.as_py(), kind) for x in rows.column("a")]
        size = [len(x) for x in name]
        src = np.repeat(rows.column("src").to_numpy(), size)
        name = np.concatenate(name)
        many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(rows.column("many"), size, strict=True)]).astype(bool)
        out = []
        if part == _CORE:
            order = np.argsort(name, kind="stable")
            name, src, many = name[order], src[order], many[order]
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            count = np.diff(np.append(first, len(name)))
            shared = np.repeat((count > 1) | np.logical_or.reduceat(many, first), count)
            name, src = name[shared].astype(U64) | U64(bucket) << U64(32), src[shared]
            other = low = None
        else:
            other = np.concatenate([_unplanes(x.as_py(), U64) for x in rows.column("b")])
            low = np.concatenate([_unplanes(x.as_py(), np.int64) for x in rows.column("low")])
            order = np.lexsort((other, name))
            name, other, low, src, many = (x[order] for x in (name, other, low, src, many))
            first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (other[1:] != other[:-1])))
            least = np.repeat(np.minimum.reduceat(low, first), np.diff(np.append(first, len(name))))
            asks = many | (least < low)
            name, other, low, src = name[asks], other[asks], least[asks], src[asks]
        order = np.argsort(src, kind="stable")
        src = src[order]
        edge = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else []
        for i, j in zip(edge, [*edge[1:], len(src)], strict=True) if len(src) else ():
            at = order[i:j]
            out.append((int(src[i]), part, _planes(name[at]), None if other is None else _planes(other[at]), None if low is None else _planes(low[at])))
        return _table(out, schema)

    return entries.groupBy("g", "part").applyInArrow(run, _MARK_SQL)


class _Marks:
    """The dictionary's answers of one part, sorted by name."""

    def __init__(self, rows: pa.Table, part: int) -> None:
        rows = rows.filter(pa.compute.equal(rows.column("part"), part))
        join = lambda c, t: np.concatenate([np.empty(0, t), *(_unplanes(x.as_py(), t) for x in rows.column(c) if x.is_valid)])
        name = join("a", U64)
        order = np.argsort(name, kind="stable")
        self.name = name[order]
        if part != _CORE:
            self.other, self.low = join("b", U64)[order], join("low", np.int64)[order]

    def _at(self, name: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.name, name), len(self.name) - 1)

    def has(self, name: np.ndarray) -> np.ndarray:
        return self.name[self._at(name)] == name if len(self.name) else np.zeros(len(name), bool)

    def earlier(self, name: np.ndarray, other: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a smaller document than doc holds this name."""
        if not len(self.name):
            return np.zeros(len(name), bool)
        at = self._at(name)
        return (self.name[at] == name) & (self.other[at] == other) & (self.low[at] < doc)


_M, _K = 2147483647, 1640531527


def chunk_column(n: int) -> Column:
    """The group of a document."""
    return F.pmod(F.shiftright(F.pmod(F.col("doc_id"), F.lit(_M)) * F.lit(_K).cast("long"), 15), F.lit(n)).cast("int")


def _sha(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def _kept(block: Block, gone: np.ndarray | None, wanted: np.ndarray | None = None) -> list[tuple[int, int, str] | None]:
    """(n_words, n_removed, sha256 of the kept words) of each document of a block, or of those wanted."""
    out: list[tuple[int, int, str] | None] = []
    raw = block.data.tobytes()
    start, stop = block.start.tolist(), block.stop.tolist()
    for i in range(len(block.rows)):
        if wanted is not None and not wanted[i]:
            out.append(None)
            continue
        a, b = int(block.first[i]), int(block.first[i + 1])
        left = range(a, b) if gone is None else (np.flatnonzero(~gone[a:b]) + a).tolist()
        out.append((b - a, b - a - len(left), _sha(b" ".join([raw[start[k] : stop[k]] for k in left]))))
    return out


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the exchange, with their sizes in bytes; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            texts = text_views(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "packed", "size"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary, size long")


def _unpacked(batch: pa.RecordBatch) -> Iterator[Block]:
    """Blocks of the texts of a batch (doc_id, packed, size), unpacked block by block."""
    codec = pa.Codec("zstd")
    size = batch.column(2).to_pylist()
    at = 0
    while at < len(size):
        end, total = at, 0
        while end < len(size) and (end == at or total + size[end] <= STEP_BYTES):
            total += size[end]
            end += 1
        texts = [memoryview(codec.decompress(batch.column(1)[k].as_buffer(), size[k], asbytes=True)) if size[k] else memoryview(b"") for k in range(at, end)]
        yield Block(np.arange(at, end), texts, False)
        at = end


def _texts(rows: pa.Table) -> Iterator[tuple[np.ndarray, Block, pa.RecordBatch]]:
    """(ids of its documents, block, its batch) of packed texts (doc_id, packed, size, ...)."""
    for batch in rows.to_batches():
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for block in _unpacked(batch.select(["doc_id", "packed", "size"])):
            yield ids[block.rows], block, batch


def first_entries(texts: DataFrame, window: int, bits: int) -> DataFrame:
    """The long symbols and the cores of each group."""

    def run(rows: pa.Table) -> pa.Table:
        src = rows.column("g")[0].as_py()
        long_, core = _Gathered(2), _Gathered(1)
        for ids, block, _ in _texts(rows):
            doc, name, other, _, _ = long_symbols(block, block.other_names(), window)
            long_.add([name, other], ids[doc])
            doc, name, _, _ = cores(block, window)
            core.add([_short(name, bits)], ids[doc])
        return _table([*_entries(_LONG, src, long_.whole(), bits), *_entries(_CORE, src, core.whole(), bits)], _ENTRY)

    return texts.groupBy("g").applyInArrow(run, _ENTRY_SQL)


def _short(name: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a core's name that are sent: those of its bucket, and the low 32."""
    return (name >> U64(64 - bits)) << U64(64 - bits) | (name & U64(0xFFFFFFFF))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("packed", pa.binary()), ("size", pa.int64()), ("gone", pa.binary()), *(f for f in _ENTRY)])
_OUT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, packed binary, size long, gone binary, " + _ENTRY_SQL


def _covered(n: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in a span."""
    return np.cumsum((np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1))[:n]) > 0


def _candidates(texts: DataFrame, marks: DataFrame, window: int, bits: int) -> DataFrame:
    """A row for each document, final or with its text and what long symbols removed; and entries of the windows around shared cores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        long_, core, windows = _Marks(right, _LONG), _Marks(right, _CORE), _Gathered(2)
        rows: list[tuple] = []
        nothing = (None,) * len(_ENTRY)
        src = -1
        for ids, block, batch in _texts(left):
            src = batch.column("g")[0].as_py()
            n, other = len(block.name), block.other_names()
            doc, name, second, start, size = long_symbols(block, other, window)
            again = long_.earlier(name, second, ids[doc])
            start, size = start[again], size[again]
            gone = _covered(n, start, size)
            settled = _covered(n, start, size - window + 1)  # windows inside one removed symbol, by their first word
            own, name, low, high = cores(block, window)
            key = _short(name, bits)
            hit = core.has((key >> U64(64 - bits)) << U64(32) | (key & U64(0xFFFFFFFF)))
            size = (high - low + 1)[hit]
            at = np.repeat(low[hit] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
            whose = np.repeat(own[hit], size)
            left_over = ~settled[at]
            at, whose = at[left_over], whose[left_over]
            open_ = np.zeros(len(ids), bool)
            open_[whose] = True
            if len(at):
                windows.add([gram_names(block.name, [window])[window][at], gram_names(other, [window], 1)[window][at]], ids[whose])
            kept = _kept(block, gone, ~open_)
            for i, row in enumerate(block.rows.tolist()):
                if open_[i]:
                    own_gone = gone[block.first[i] : block.first[i + 1]]
                    rows.append((int(ids[i]), None, None, None, batch.column("packed")[row].as_py(), batch.column("size")[row].as_py(), np.packbits(own_gone).tobytes() if own_gone.any() else None, *nothing))
                else:
                    rows.append((int(ids[i]), *kept[i], None, None, None, *nothing))
        rows += [(None,) * 7 + r for r in _entries(_WINDOW, src, windows.whole(), bits)]
        return _table(rows, _OUT)

    return texts.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(run, _OUT_SQL)


def _removed(texts: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = _Marks(right, _WINDOW), []
        for ids, block, batch in _texts(left):
            n, doc = len(block.name), _documents(block)
            gone = np.zeros(n, bool)
            for i, row in enumerate(block.rows.tolist()):
                if (bits := batch.column("gone")[row]).is_valid:
                    a, b = int(block.first[i]), int(block.first[i + 1])
                    gone[a:b] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=b - a)
            at = np.flatnonzero(np.arange(n) + window <= block.first[1:][doc])
            if len(at):
                name, other = gram_names(block.name, [window])[window][at], gram_names(block.other_names(), [window], 1)[window][at]
                gone |= _covered(n, at[known.earlier(name, other, ids[doc[at]])], window)
            out += [(i, *x) for i, x in zip(ids.tolist(), _kept(block, gone), strict=True)]
        return _table(out, pa.schema([*_OUT][:4]))

    return texts.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _untouched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for block in blocks(batch.column(0)) for x in _kept(block, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate([*_OUT][1:4])], names=["n_words", "n_removed", "kept_sha256"])

    return docs.select("text").mapInArrow(run, "n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of docs(doc_id, text)."""
    nameless = docs.where("doc_id is null")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    n = n_groups(docs)
    bits = max(1, (n - 1).bit_length())
    texts = packed(docs).withColumn("g", chunk_column(n)).repartition(n, "g")
    marks = looked_up(first_entries(texts, window, bits))
    found = stored(_candidates(texts, marks, window, bits), "substring-candidates")
    free_shuffles(docs.sparkSession)
    marks = looked_up(found.where("g is not null").select(*(f.name for f in _ENTRY)))
    open_ = found.where("packed is not null").select("doc_id", "packed", "size", "gone").withColumn("g", chunk_column(n))
    closed = found.where("n_removed is not null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return closed.union(_removed(open_, marks, window)).union(_untouched(nameless).select(F.lit(None).cast("long"), "n_words", "n_removed", "kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
win AS (SELECT doc_id, n, x, p, CASE WHEN p + 12 <= n THEN string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS k FROM word),
seen AS (SELECT doc_id, x, p, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS hit FROM win),
mark AS (SELECT doc_id, x, p, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM seen),
agg AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM mark GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
"""
