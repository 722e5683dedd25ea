"""Operator 2: n-gram Jaccard join with filters under several global token orders.

A document's set holds its distinct shingles.  Two sets whose Jaccard similarity is at least t share l
tokens within their first n - ceil(t * n) + l tokens under ANY global order of the tokens.  Three orders
are used.  Order A puts rare tokens first (a fixed-size count sketch over all documents gives the
frequency class; ties by hash) and proposes candidates, which must share l tokens; orders B and C are two
hash permutations, and a candidate's prefixes under both must agree as far as the similarity demands: up
to the smaller of the two prefixes' last tokens both prefixes are complete, so what they do not share
there belongs to the symmetric difference, which is bounded.  Then the full sets are compared.

How groups stay small work: equal sets form one class at the start and only its smallest id goes on.  A
token shared by few classes gives its pairs directly.  In a larger token group every member is first
compared with one pivot.  Only groups that then still hold several clusters of plausible pairs, and
clusters that hold several linked components, are compared further, inside kernels over blocks of members
that return a spanning forest of what they find and never the pairs.  No link between different sets is lost: a pair with l common prefix tokens has
all of them in small groups, and is counted there, or one in a large group, and is compared there.

Hot keys: texts with an empty set are set aside; classes, and the tokens that the sketch knows to be in very
many documents, are counted in SALTS parts and joined part by part.  Candidates come from 64-bit shingle
names; a link is decided by 96-bit ones (64 and 32 bits of two lanes of word names), a class by a 128-bit digest.

Cases: null, empty and blank texts have an empty set and link with nothing; a text with fewer words than
a shingle has one shingle; ties and repeated rows share a class; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloupe.llm.common import U64, Block, blocks, discard, free_shuffles, mix, stored, table, task_number, tree_sum
from sparkloupe.llm.graph import components

SKETCH_BITS = 23
#: Token groups up to this size give their pairs directly; larger ones use a pivot and kernels.
SMALL = 16
#: Members of one side of a kernel over a large group.
KERNEL = 512
#: Parts in which the members of a class and of a hot token are counted.
SALTS = 64
#: Documents of a sketch cell from which its tokens are counted in parts.
HOT = 512
_HOT_BIT = 0x80


@dataclass(frozen=True)
class JaccardJoin:
    words: int = 4
    percent: int = 85  # 100 * intersection >= percent * union

    def prefix(self, n: int) -> int:
        """Prefix length that must hold a common token."""
        return n - (self.percent * n + 99) // 100 + 1

    def common(self, n: int) -> int:
        """Tokens that a longer prefix, by this number less one, must have in common; grows with n."""
        return 1 + min(7, n // 40)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of linked sets of these sizes."""
        least = -(-self.percent * (x + y) // (100 + self.percent))
        return x + y - 2 * least


PRODUCTION = JaccardJoin()


def shingles(names: np.ndarray, words: int, lane: int = 0) -> np.ndarray:
    """Shingle names at every word of one document's word names."""
    n = len(names)
    if not n:
        return names
    k = min(words, n)
    out = np.full(n - k + 1, k, U64)
    for j in range(k):
        out = mix(out + names[j : n - k + 1 + j], j + 50 * lane)
    return out


def _sets(block: Block, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct shingle names of each document."""
    first = block.first.tolist()
    for i, row in enumerate(block.rows.tolist()):
        yield row, np.unique(shingles(block.name[first[i] : first[i + 1]], words))


def _wide_sets(block: Block, words: int) -> Iterator[tuple[int, bytes]]:
    """The same names, followed by 32 bits of each one's name in the second lane."""
    first, other = block.first.tolist(), block.other_names()
    for i, row in enumerate(block.rows.tolist()):
        own, at = np.unique(shingles(block.name[first[i] : first[i + 1]], words), return_index=True)
        yield row, own.tobytes() + (shingles(other[first[i] : first[i + 1]], words, 1)[at] >> U64(32)).astype(np.uint32).tobytes()


def _wide(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, U64, n), np.frombuffer(data, np.uint32, n, 8 * n)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_classes(docs: DataFrame, rule: JaccardJoin) -> np.ndarray:
    """log2 class of each cell of the count sketch: 2 ** SKETCH_BITS bytes, whatever the input's size.

    A class compares a cell with the mean of its part of the sketch, and a task counts to 255 in a cell;
    any order gives right results, a blunter one only proposes more candidates.
    """
    part = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for block in blocks(batch.column(0), lower=True):
                found = [s for _, s in _sets(block, rule.words) if len(s)]
                if found:
                    cell, n = np.unique(_cell(np.concatenate(found)), return_counts=True)
                    count[cell] += n.astype(np.int32)
        cells = np.minimum(count, 255).astype(np.uint8).reshape(-1, part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array([task_number()] * len(cells), pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary())], names=["k", "task", "m"])

    def classed(count: np.ndarray) -> np.ndarray:
        return np.log2(np.maximum(1, count / max(1.0, count.mean()))).astype(np.uint8) | np.where(count >= hot, _HOT_BIT, 0).astype(np.uint8)

    hot = HOT
    rows = tree_sum(docs.select("text").mapInArrow(run, "k int, task int, m binary"), np.uint32, classed, np.uint8).collect()
    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    for k, c in rows:
        classes[k * part : (k + 1) * part] = np.frombuffer(c, np.uint8)
    return classes


def signatures(docs: DataFrame, rule: JaccardJoin, classes: np.ndarray) -> DataFrame:
    """(doc_id, n, f0, f1, prefix, hot, more): set size, digest, the prefix under A without and with hot tokens' own list,
    and 16-bit names of the prefixes under B and C."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sent.value
        for batch in batches:
            n = batch.num_rows
            size, digest = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
            head: list[np.ndarray] = [np.empty(0, np.int64)] * n
            hot: list[np.ndarray] = [np.empty(0, np.int64)] * n
            more = [b""] * n
            for block in blocks(batch.column(1), lower=True):
                for row, s in _sets(block, rule.words):
                    if not len(s):
                        continue
                    size[row] = len(s)
                    digest[row] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    p = int(rule.prefix(len(s)))
                    # A: class first, then a permutation; both fit into one key
                    a = (rarity[_cell(s)].astype(U64) << U64(56)) | (mix(s, 11) >> U64(8))
                    q = min(len(s), p + rule.common(len(s)) - 1)
                    chosen = np.argpartition(a, q - 1)[:q]
                    many = a[chosen] >> U64(63) == 1
                    head[row], hot[row] = s[chosen[~many]].view(np.int64), s[chosen[many]].view(np.int64)
                    more[row] = b"".join((np.sort(np.partition(mix(s, k), p - 1)[:p]) >> U64(48)).astype(np.uint16).tobytes() for k in (21, 31))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(head), _lists(hot), pa.array(more, pa.binary())], names=["doc_id", "n", "f0", "f1", "prefix", "hot", "more"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f0 long, f1 long, prefix array<long>, hot array<long>, more binary")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def _orders(more: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the prefix tokens under B and under C, ascending, to 16 bits: rounding can only add agreement."""
    both = np.frombuffer(more, np.uint16)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _may_link(x: bytes, y: bytes, n: int, m: int, rule: JaccardJoin) -> bool:
    most = int(rule.differ(n, m))
    for a, b in zip(_orders(x), _orders(y), strict=True):
        last = min(a[-1], b[-1])
        common = np.minimum(np.searchsorted(a, b, "right") - np.searchsorted(a, b, "left"), 1).sum()
        common = max(int(common), int(np.isin(a, b).sum()))
        if not common or int(np.searchsorted(a, last)) + int(np.searchsorted(b, last)) - 2 * common > most:
            return False
    return True


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    """Of two wide sets."""
    (a, p), (b, q) = _wide(x), _wide(y)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(((b[at] == a) & (q[at] == p)).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


#: Bits of the map by which wanted ids are recognised while scanning; past an eighth of it a join is used.
MAP_BITS = 23


def _id_map(wanted: DataFrame) -> np.ndarray | None:
    """A bit map of the wanted ids, of fixed size; None when they are too many for it."""
    if wanted.count() > 1 << (MAP_BITS - 3):
        return None
    part = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            seen[_place(batch.column(0).to_numpy(zero_copy_only=False))] = True
        parts = seen.reshape(-1, part)
        full = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([np.packbits(parts[k]).tobytes() for k in full], pa.binary())], names=["k", "c"])

    def any_of(frame: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(part // 8, np.uint8)
        for c in frame["c"]:
            seen |= np.frombuffer(c, np.uint8)
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "c": [seen.tobytes()]})

    out = np.zeros((1 << MAP_BITS) // part * (part // 8), np.uint8).reshape(-1, part // 8)
    for k, c in wanted.mapInArrow(run, "k int, c binary").groupBy("k").applyInPandas(any_of, "k int, c binary").collect():
        out[k] = np.frombuffer(c, np.uint8)
    return out.ravel()


def _place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64), 14) >> U64(64 - MAP_BITS)).astype(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, rule: JaccardJoin) -> DataFrame:
    """(id, set) of the documents whose id is in wanted(id), and perhaps of some others; sets are wide."""
    bits = _id_map(wanted)
    docs = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
    if bits is None:
        docs = docs.join(wanted, "id", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is not None:
                place = _place(batch.column(0).to_numpy(zero_copy_only=False))
                batch = batch.filter(pa.array((sent.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)))
            out = [b""] * batch.num_rows
            for block in blocks(batch.column(1), lower=True):
                for row, s in _wide_sets(block, rule.words):
                    out[row] = s
            for a in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 500], pa.array(out[a : a + 500], pa.binary())], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def _plausible(pairs: DataFrame, sign: DataFrame, rule: JaccardJoin) -> DataFrame:
    """Those of the pairs (a, b) whose prefixes under B and C agree enough."""

    @F.pandas_udf("boolean")
    def may_link(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([_may_link(a, b, c, d, rule) for a, b, c, d in zip(x, y, n, m, strict=True)], dtype=bool)

    more = sign.select("id", "n", "more")
    near = pairs.join(more.withColumnsRenamed({"id": "a", "more": "x"}), "a").join(more.withColumnsRenamed({"id": "b", "more": "y", "n": "m"}), "b")
    return near.where(may_link("x", "y", "n", "m")).select("a", "b")


def _verify(near: DataFrame, docs: DataFrame, rule: JaccardJoin) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_linked(a, b, rule.percent) for a, b in zip(x, y, strict=True)], dtype=bool)

    wanted = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    full = stored(sets_of(docs, wanted, rule), "ngram-sets")
    both = near.join(full.withColumnsRenamed({"id": "a", "set": "x"}), "a").join(full.withColumnsRenamed({"id": "b", "set": "y"}), "b")
    links = stored(both.where(linked("x", "y")).select("a", "b"), "ngram-links")
    discard(full)
    return links


def _block_pairs(groups: DataFrame) -> DataFrame:
    """Deals the members of each group to pairs of blocks of about KERNEL members: (token, i, j, own, ...).

    Members of a group's largest component only meet the others, never one another.
    """
    sizes = groups.groupBy("token", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / KERNEL)).cast("int")
    own = groups.join(main, "token").withColumns({"nm": parts(F.col("most")), "no": parts(F.col("all") - F.col("most")), "is_main": F.col("label") == F.col("main")})
    place = F.xxhash64("id", F.lit(5))
    own = own.withColumn("own", F.when(F.col("is_main"), F.pmod(place, F.col("nm"))).otherwise(F.col("nm") + F.pmod(place, F.col("no"))).cast("int"))
    other = own.withColumn("o", F.explode(F.sequence(F.when(F.col("is_main"), F.col("nm")).otherwise(0), F.col("nm") + F.col("no") - 1)))
    return other.withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")}).drop("o", "nm", "no", "is_main", "main", "all", "most")


def _numbered(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Numbers for the names of wide sets, equal for equal names."""
    low, high = (np.unique(np.concatenate(lane), return_inverse=True)[1] for lane in zip(*sets, strict=True))
    return np.split((low * (int(high.max(initial=0)) + 1) + high).astype(U64), np.cumsum([len(x) for x, _ in sets])[:-1])


def _kernel(groups: DataFrame, column: str, test: str, rule: JaccardJoin) -> DataFrame:
    """Compares members of different components in each block pair; a spanning forest of what passes, as (token, a, b)."""

    percent = rule.percent

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        ids, label, side = frame["id"].to_numpy(), frame["label"].to_numpy(), frame["own"].to_numpy()
        root = {x: x for x in set(label.tolist())}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found: list[tuple[int, int]] = []
        size = frame["n"].to_numpy()
        halves = [_numbered([_wide(x) for x in frame[column]])] if test == "sets" else [[b[k].astype(U64) for b in map(_orders, frame[column])] for k in (0, 1)]
        lists = []
        for rows in halves:
            length = np.array([len(r) for r in rows])
            owner = np.repeat(np.arange(len(rows)), length)
            values = np.concatenate(rows)
            tokens, back = np.unique(values, return_inverse=True)
            order = np.argsort(back, kind="stable")
            at = np.append(0, np.cumsum(np.bincount(back, minlength=len(tokens))))
            mine = np.append(0, np.cumsum(length))
            lists.append((owner[order], at, back, mine, values, values[mine[1:] - 1]))
        for x in range(len(ids)):
            ok = np.ones(len(ids), bool)
            for owner, at, back, mine, values, last in lists:
                t = back[mine[x] : mine[x + 1]]
                n = at[t + 1] - at[t]
                hit = owner[np.repeat(at[t] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))]
                count = np.bincount(hit, minlength=len(ids))
                if test == "sets":
                    ok &= 100 * count >= percent * (size + size[x] - count)
                else:
                    upto = np.minimum(last, last[x])
                    before = np.searchsorted(values[mine[x] : mine[x + 1]], upto) + np.add.reduceat((values < last[x]) & (values < np.repeat(last, np.diff(mine))), mine[:-1])
                    ok &= (count > 0) & (before - 2 * count <= rule.differ(size, size[x]))
            ok[: x + 1] = False
            ok &= label != label[x]
            if i != j:
                ok &= side != side[x]
            for y in np.flatnonzero(ok).tolist():
                a, b = find(label[x]), find(label[y])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(ids[x]), int(ids[y])))
        return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype="int64")

    return groups.groupBy("token", "i", "j").applyInPandas(run, "a long, b long")


def _shared_tokens(sign: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, token, size, p) of the prefix tokens of several documents: how many they are, and the token's pivot."""
    own = sign.select(F.col("doc_id").alias("id"), "prefix", "hot").join(copies.withColumnRenamed("doc_id", "id"), "id", "left_anti")
    pivot = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("p"))
    rare = own.select("id", F.explode("prefix").alias("token"))
    group = Window.partitionBy("token")
    rare = rare.select("id", "token", F.count("*").over(group).alias("size"), F.min(pivot).over(group).alias("pivot")).where("size > 1")
    hot = own.select("id", F.explode("hot").alias("token")).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(SALTS)))
    parts = hot.groupBy("token", "salt").agg(F.count("*").alias("size"), F.min(pivot).alias("pivot"))
    whole = parts.groupBy("token").agg(F.sum("size").alias("size"), F.min("pivot").alias("pivot")).where("size > 1")
    hot = hot.join(parts.select("token", "salt").join(whole, "token"), ["token", "salt"]).select("id", "token", "size", "pivot")
    return rare.union(hot).select("id", "token", "size", F.col("pivot.p").alias("p"))


def _stars(labels: DataFrame) -> DataFrame:
    """Links (a, b) that join the same vertices as the ones that the components (id, label) were found from."""
    return labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))


def jaccard_components(docs: DataFrame, rule: JaccardJoin = PRODUCTION) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sign = stored(signatures(docs, rule, frequency_classes(docs, rule)).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(SALTS))), "ngram-signatures")
    # classes of equal sets, counted and joined in parts; id: the smallest of the class, c: its size
    key = ["f0", "f1", "n"]
    parts = sign.where("n > 0").groupBy(*key, "salt").agg(F.min("doc_id").alias("id"), F.count("*").alias("c"))
    whole = parts.groupBy(*key).agg(F.min("id").alias("id"), F.sum("c").alias("c"))
    classes = stored(parts.select(*key, "salt").join(whole, key), "ngram-classes")
    copies = sign.join(classes.where("c > 1").drop("c"), [*key, "salt"]).where("doc_id > id").select("doc_id")
    spark = docs.sparkSession
    free_shuffles(spark)
    sizes = sign.select(F.col("doc_id").alias("id"), "n")
    shared = stored(_shared_tokens(sign.where("n > 0 AND doc_id IS NOT NULL"), copies).join(sizes, "id").select("token", "id", "size", "p", "n"), "ngram-shared")
    free_shuffles(spark)
    reps = sign.select(F.col("doc_id").alias("id"), "n", "more")
    fits = lambda x, y: 100 * F.least(x, y) >= rule.percent * F.greatest(x, y)
    small = shared.where(F.col("size") <= SMALL)
    right = small.select("token", F.col("id").alias("b"), F.col("n").alias("m"))
    pairs = small.join(right, "token").where((F.col("id") < F.col("b")) & fits(F.col("n"), F.col("m"))).select(F.col("id").alias("a"), "b", F.least("n", "m").alias("least"))
    need = 1 + F.least(F.lit(7), F.floor(F.col("least") / 40))  # JaccardJoin.common
    pairs = pairs.groupBy("a", "b", "least").agg(F.count("*").alias("common")).where(F.col("common") >= need).select("a", "b")
    stars = shared.where((F.col("size") > SMALL) & (F.col("id") != F.col("p"))).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    near = stored(_plausible(pairs.union(stars).distinct(), reps, rule), "ngram-near")
    free_shuffles(spark)
    links = _verify(near, docs, rule)
    free_shuffles(spark)
    merged = components(links, "ngram-components")
    large = shared.where(F.col("size") > SMALL).select("token", "id", "size", "n")
    if not large.isEmpty():
        # plausible pairs across the clusters that a large group still holds; groups of the same members count once
        plausible = components(near, "ngram-clusters")
        own = large.join(plausible, "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.sum(F.xxhash64("id", F.lit(3)).cast("decimal(38,0)")).alias("y"))
        once = mixed.where("lo < hi").groupBy("x", "y").agg(F.min("token").alias("token"))
        across = _kernel(_block_pairs(own.join(once.select("token"), "token", "left_semi").join(reps.drop("n"), "id")), "more", "orders", rule)
        across = stored(across.distinct(), "ngram-across")
        free_shuffles(spark)
        clusters = components(_stars(plausible).union(across), "ngram-clusters").withColumnRenamed("label", "token")
        # within a cluster, all members of large groups whose components still differ
        members = large.select("id", "n").distinct().join(clusters, "id").join(merged, "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_ = members.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        members = stored(members.join(open_.select("token"), "token"), "ngram-members")
        found = _kernel(_block_pairs(members.join(sets_of(docs, members.select("id"), rule), "id")), "set", "sets", rule)
        merged = components(_stars(merged).union(found), "ngram-components")
        discard(across, members)
    discard(shared, near, links)
    free_shuffles(spark)
    label = classes.drop("c").join(merged.withColumnRenamed("label", "c"), "id", "left").select(*key, "salt", F.coalesce("c", "id").alias("c"))
    own = sign.select("doc_id", "n", "f0", "f1", "salt")
    out = own.where("n > 0").join(label, [*key, "salt"], "left").select("doc_id", "n", F.coalesce("c", "doc_id").alias("component_id"))
    out = out.union(own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
gram AS (SELECT doc_id, n, p, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM word),
sh AS (SELECT DISTINCT doc_id, s FROM gram WHERE p + 3 <= n OR (n < 4 AND p = 1)),
cnt AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair JOIN cnt x ON x.doc_id = a JOIN cnt y ON y.doc_id = b WHERE 100 * pair.c >= 85 * (x.c + y.c - pair.c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT DISTINCT a, a FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
label AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(cnt.c, 0)::BIGINT AS n_shingles, coalesce(label.c, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN cnt USING (doc_id) LEFT JOIN label USING (doc_id)
"""
