"""Shared pieces of the training-data operators: words, shared storage, column guards.

Words are runs of bytes other than space and 0x09-0x0D.  Those separators are single UTF-8 bytes, so
words can be found on encoded bytes and no character is ever cut.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled by one vectorised step; bounds the memory of a Python worker.
STEP_BYTES = 1 << 18

U64 = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants), a bijection for each seed."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: The low 0 to 8 bytes of a 64-bit number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of a span from which a cryptographic hash names it.
LONG_SPAN = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of one buffer."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit names of the spans of one buffer, equal for equal bytes wherever they stand.

    A chain of bijections over 8 bytes at a time, begun with the length: spans of up to 8 bytes never share a
    name, longer ones only by the chance of 64 random bits; keyed BLAKE2b for spans of LONG_SPAN bytes and more.
    Two lanes give names that are independent of each other, together 128 bits.
    """
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, 0, (1,))  # the 8 bytes from each place
    name = mix(size.astype(U64), 2 * lane + 101)
    name = mix(name ^ (eight[start] & _LOW[np.minimum(size, 8)]), lane)
    if len(size) and size.max() > 8:
        rest, k = np.flatnonzero((size > 8) & (size < LONG_SPAN)), 8
        while len(rest):
            name[rest] = mix(name[rest] ^ (eight[start[rest] + k] & _LOW[np.minimum(size[rest] - k, 8)]), lane + 2 * k)
            k += 8
            rest = rest[size[rest] > k]
        for i in np.flatnonzero(size >= LONG_SPAN).tolist():
            whole = hashlib.blake2b(data[int(start[i]) : int(end[i])].tobytes(), digest_size=8, key=b"lane %d" % lane)
            name[i] = int.from_bytes(whole.digest(), "little")
    return name


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts a long buffer where a word ends, about every STEP_BYTES."""
    at, n = 0, len(data)
    while n - at > STEP_BYTES + 4096:
        near = np.flatnonzero(_SPACE[data[at + STEP_BYTES : at + STEP_BYTES + 4096]])
        if not len(near):
            near = np.flatnonzero(_SPACE[data[at + STEP_BYTES :]])
            if not len(near):
                break
        cut = at + STEP_BYTES + int(near[0])
        yield at, cut
        at = cut
    yield at, n


def words_of(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, name) of every word of a buffer of UTF-8 bytes."""
    starts, ends, names = [], [], []
    for a, b in _pieces(data):
        part = data[a:b]
        s, e = word_spans(part)
        names.append(span_hashes(_LOWER[part] if lower else part, s, e))
        starts.append(s + a)
        ends.append(e + a)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(names)


def gram_names(names: np.ndarray, sizes: list[int], lane: int = 0) -> dict[int, np.ndarray]:
    """Names of all runs of so many consecutive names, one for each start: grams double, and two that overlap make the rest."""
    out, power = {}, [names]
    for k in range((max(sizes)).bit_length() - 1):
        w = 1 << k
        last = power[-1]
        power.append(mix(mix(last[: max(0, len(last) - w)], 7 + lane) + last[w:], 300 + k + lane))
    for n in sizes:
        whole = power[n.bit_length() - 1]
        at = n - (1 << n.bit_length() - 1)
        out[n] = mix(mix(whole[: max(0, len(whole) - at)], 9 + lane) + whole[at:], 400 + n + lane)
    return out


class Block:
    """Some documents joined by newlines into one buffer, with their words.

    data: the bytes; begin, end: of each document; start, stop, name: of each word; first: index of each
    document's first word, with the number of words at the end.
    """

    __slots__ = ("begin", "data", "end", "first", "lower", "name", "rows", "start", "stop")

    def __init__(self, rows: np.ndarray, texts: list[memoryview], lower: bool) -> None:
        self.rows, self.lower = rows, lower
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.start, self.stop, self.name = words_of(self.data, lower)
        self.first = np.append(np.searchsorted(self.start, self.begin), len(self.start))

    def other_names(self) -> np.ndarray:
        """The words' names in the second lane."""
        return span_hashes(_LOWER[self.data] if self.lower else self.data, self.start, self.stop, 1)


def text_views(column: pa.Array) -> list[memoryview]:
    """UTF-8 bytes of each row of a string column, without copies; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = memoryview(column.buffers()[2] or b"")
    valid = np.asarray(column.is_valid()) if n else np.zeros(0, bool)
    return [raw[a:b] if ok else raw[0:0] for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True)]


def row_groups(texts: list[memoryview], step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about step bytes; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > step:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def blocks(column: pa.Array, lower: bool = False, step: int = STEP_BYTES) -> Iterator[Block]:
    texts = text_views(column)
    for a, b in row_groups(texts, step):
        yield Block(np.arange(a, b), texts[a:b], lower)


def small_batches(spark: SparkSession) -> None:
    """Sends at most 1,000 rows to a Python worker at once where the session still has Spark's default of 10,000:
    texts are long, and Arrow's buffers are outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests, the bench) takes a temporary folder and a cluster its warehouse.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        where = os.path.join(tempfile.gettempdir(), "sparkloupe-checkpoint") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sparkloupe-checkpoint"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._sparkloupe_path = path
    _PATHS.append(path)
    return back


#: Folders that stored() wrote and nothing has deleted yet.
_PATHS: list[str] = []


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for df in tables:
        if (path := getattr(df, "_sparkloupe_path", None)) in _PATHS:
            _delete(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that have ended: it does so when the driver's garbage is collected,
    which a driver with little to do may put off until the executors' disks are full."""
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Deletes all stored tables; for a caller that has written or read its results."""
    for path in [*_PATHS]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _PATHS.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows that one step of tree_sum adds up; three steps cover 256 ** 3 tasks.
FAN_IN = 256


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def tree_sum(parts: DataFrame, dtype: type, finish: Callable[[np.ndarray], np.ndarray] = lambda total: total, sent: type | None = None) -> DataFrame:
    """(k, m) of rows (k, task, m): the arrays m of each k added up, at most about FAN_IN of them in one group.

    finish is applied to each sum in the last step, so that no second Python worker is needed for it.
    sent: the type of the arrays in parts, where it is not dtype.
    """

    def adder(kind: np.dtype):
        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(frame["m"].iloc[0], kind).astype(dtype)
            for m in frame["m"].iloc[1:]:
                total += np.frombuffer(m, kind)
            return pd.DataFrame({"k": [frame["k"].iloc[0]], "task": [frame["task"].iloc[0]], "m": [total.tobytes()]})

        return add

    for kind in (np.dtype(sent or dtype), np.dtype(dtype)):
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("k", "task").applyInPandas(adder(kind), "k int, task int, m binary")

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(adder(np.dtype(dtype))(frame)["m"].iloc[0], dtype)
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "m": [finish(total).tobytes()]})

    return parts.groupBy("k").applyInPandas(last, "k int, m binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """The name, with as many underscores behind it as make it none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Stored bytes of input that one group of a packed exchange stands for at most.
GROUP_BYTES = 16 << 20


def n_groups(df: DataFrame, text_col: str = "text") -> int:
    """Groups that keep a share of the input small enough for a Python worker: the session's shuffle
    partitions, or more where the input's size asks for it, by Spark's statistics or else by a sum over the texts."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # without statistics Spark assumes the largest number
        size = (df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 2
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // GROUP_BYTES))
