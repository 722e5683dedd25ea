"""Operator 10: benchmark decontamination by latent semantic retrieval.

1. Weights.  Words (lower case, punctuation off) are hashed to CELLS cells; one pass over all documents counts the
   documents of each cell.  Cells of more than STOP of the documents weigh nothing, unless an item needs them.
2. Decomposition.  The randomised singular value decomposition (Halko, Martinsson, Tropp 2011) of the TF-IDF matrix
   of passages, SPAN words at every other UNIT: every task multiplies its passages with a random matrix and back,
   the sums are added and made orthonormal (the range), and Nyström's method (their section 5.4) takes singular
   values and vectors in it from the same sums.  It is fitted on every passage of every document, in one pass, and
   on the items themselves as rows that carry ITEM_SHARE of its energy.
3. Search.  Items are cut into pieces of at most PIECE words.  One pass over the documents projects every passage,
   of about a piece's length, and takes as candidates the pieces whose cosine in the latent space is at least
   CANDIDATE; of these only the ones that hold SHARED of the piece's weight go on.  Items of fewer than LEAST words
   are candidates wherever their rarest word stands.
4. Verification, in the words and for whole items: the longest common subsequence of the item and some stretch,
   half as long again, of the passage's neighbourhood must cover SIMILAR of the item, and half of the item's answer
   (what follows its last question mark, else its last quarter) must be in it, which also accepts paraphrases that
   change some words.

Weights, basis and BLOCK pieces of items are of a fixed size; documents are never exchanged, only one best match
per document and block of items.

Cases: null and empty texts match nothing; null or empty items are ignored, items shorter than LEAST words
must be matched whole; equal scores go to the smallest item_id; repeated documents get equal rows; empty
tables give no matches; other columns are ignored; a very long text is handled as one block of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.llm.common import STEP_BYTES, mix, row_groups, span_hashes, table, task_number, text_views, tree_sum, word_spans

#: Pieces of items that are searched in one pass; their vectors take 192 floats each.
BLOCK = 1 << 16
CELL_BITS = 13
CELLS = 1 << CELL_BITS
COMPONENTS = 192
#: Tasks that make the decomposition, at most, unless these would have more documents than FIT; each sends one matrix.
FIT_TASKS = 16
FIT = 20_000
#: Part of the fitted matrix's energy that the items' own rows have.
ITEM_SHARE = 0.1
#: Words of a unit; passages begin at every second unit.
UNIT = 8
SPAN = 4 * UNIT
#: Pieces of fewer words are looked for in passages of half the length.
SHORT = 24
PIECE = 48
STOP = 0.10
CANDIDATE = 0.3
SHARED = 0.25
SIMILAR = 0.6
LEAST = 8
_PART = 256
_MANY = 64
#: Cosines held at once.
_SCORES = 1 << 22

_CLEAN = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def _clean(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").lower().encode().translate(_CLEAN), np.uint8)


def word_names(data: bytes) -> np.ndarray:
    """Hashes of the normalised words of one text."""
    clean = _clean(data)
    return span_hashes(clean, *word_spans(clean))


class Words:
    """Normalised words of some documents: name, document, place in the document."""

    def __init__(self, texts: list[memoryview]) -> None:
        parts = [_clean(bytes(t)) for t in texts]
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size + 1) - size - 1
        data = np.full(int((size + 1).sum()), 32, np.uint8)
        for b, p in zip(begin.tolist(), parts, strict=True):
            data[b : b + len(p)] = p
        start, end = word_spans(data)
        self.name = span_hashes(data, start, end)
        self.doc = np.searchsorted(begin, start, "right") - 1
        self.first = np.append(np.searchsorted(self.doc, np.arange(len(texts))), len(start))
        self.place = np.arange(len(start)) - self.first[self.doc]


def _word_blocks(column: pa.Array) -> Iterator[tuple[int, Words]]:
    texts = text_views(column)
    for a, b in row_groups(texts, STEP_BYTES):
        yield a, Words(texts[a:b])


def cells(names: np.ndarray) -> np.ndarray:
    return (mix(names, 77) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Items:
    """Benchmark items: words, answers, and pieces of at most PIECE words."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [word_names(r[1].encode()) for r in rows]
        asked = [re.split(r"[?？]", r[1])[-1] if re.search(r"[?？]", r[1]) else "" for r in rows]
        self.answer = [min(len(w), max(1, len(word_names(a.encode())) or -(-len(w) // 4))) for a, w in zip(asked, self.words, strict=True)]
        self.pieces = [(k, w) for k, whole in enumerate(self.words) if len(whole) >= LEAST for w in np.array_split(whole, max(1, -(-len(whole) // PIECE)))]

    def ready(self, weight: np.ndarray, basis: np.ndarray) -> None:
        """Vectors of the pieces in the latent space, and for each piece its words and their weights."""
        self.owner = np.array([k for k, _ in self.pieces], np.int64)
        self.short = np.array([len(w) < SHORT for _, w in self.pieces], bool)
        vectors = np.array([(weight[c := cells(w), None] * basis[c]).sum(0) for _, w in self.pieces], np.float32).reshape(-1, basis.shape[1])
        self.vectors = vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
        own = [np.unique(w) for _, w in self.pieces]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *own]))
        #: piece * words + word of every word of every piece, ascending
        self.holds = np.concatenate([np.empty(0, np.int64), *(k * len(self.vocabulary) + np.searchsorted(self.vocabulary, w) for k, w in enumerate(own))])
        self.total = np.array([weight[cells(w)].sum() for w in own])
        #: the rarest word of each item that is too short for a passage
        self.tiny: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w) < LEAST:
                self.tiny.setdefault(int(w[np.argmax(weight[cells(w)])]), []).append(k)
        self.tiny_words = np.array(sorted(self.tiny), np.uint64)


def weights(held: np.ndarray, documents: int, items: list[Items]) -> np.ndarray:
    """The weight of each cell, from how many documents hold it."""
    weight = np.log((documents + 1) / (held + 1)) + 1e-6
    common = held > STOP * documents
    for block in items:
        for _, w in block.pieces:  # a piece needs some words to be found by
            at = np.unique(cells(w))
            if (~common[at]).sum() < min(5, len(at)):
                common[at[np.argsort(held[at], kind="stable")[:5]]] = False
    return np.where(common, 0, np.maximum(weight, 1e-6)).astype(np.float32)


def _unit_sums(basis: np.ndarray, cell: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
    """Sums of the basis' rows of each unit's cells; unit: ascending.  One step for the n-th cells of all units."""
    out = np.zeros((units, basis.shape[1]), np.float32)
    if not len(unit):
        return out
    first = np.append(True, unit[1:] != unit[:-1])
    nth = np.arange(len(unit)) - np.maximum.accumulate(np.where(first, np.arange(len(unit)), 0))
    place = np.full((UNIT, units), -1)
    place[nth, unit] = cell
    for own in place:
        have = np.flatnonzero(own >= 0)
        if len(have) > units // 2:
            rows = np.take(basis, own, axis=0, mode="wrap")
            rows[own < 0] = 0
            out += rows
        elif len(have):
            out[have] += basis[own[have]]
    return out


def _cell_sums(image: np.ndarray, at: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells, and for each the sum of the image's rows at its places.  One step for the n-th places of all cells."""
    order = np.argsort(cell, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
    size = np.diff(np.append(edge, len(order)))
    by = np.argsort(-size, kind="stable")
    at, edge, size = at[order], edge[by], size[by]
    out = np.zeros((len(edge), image.shape[1]), np.float32)
    many = int(np.searchsorted(-size, -_MANY))  # cells of more places are summed one by one
    for k in range(many):
        out[k] = image[at[edge[k] : edge[k] + size[k]]].sum(0)
    for n in range(int(size[many]) if many < len(size) else 0):
        k = int(np.searchsorted(-size, -n))
        out[many:k] += image[at[edge[many:k] + n]]
    return cell[order][edge], out


class Passages:
    """The units of some documents in a space of so many dimensions, and the passages made of them."""

    def __init__(self, words: Words, weight: np.ndarray, basis: np.ndarray) -> None:
        """basis: a row for each cell, already weighted."""
        count = -(-np.diff(words.first) // UNIT)
        first = np.cumsum(count + 3) - count - 3  # three empty units follow each document
        self.cell = cells(words.name)
        self.heavy = np.flatnonzero(weight[self.cell] > 0)
        unit = (first[words.doc] + words.place // UNIT)[self.heavy]
        self.unit = unit
        self.sums = _unit_sums(basis, self.cell[self.heavy], unit, int((count + 3).sum()))
        doc = np.repeat(np.arange(len(count)), -(-count // 2))
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(-(-count // 2)) - -(-count // 2), -(-count // 2))
        #: first unit, document and first word in the document of each passage that begins at every second unit
        self.start, self.doc, self.place = first[doc] + 2 * nth, doc, 2 * nth * UNIT
        self.first, self.count = first, count

    def long(self) -> np.ndarray:
        s = self.start
        return self.sums[s] + self.sums[s + 1] + self.sums[s + 2] + self.sums[s + 3]

    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums, documents and places of the passages of half the length, at every unit."""
        doc = np.repeat(np.arange(len(self.count)), self.count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        s = self.first[doc] + nth
        return self.sums[s] + self.sums[s + 1], doc, nth * UNIT


def _summed(found: DataFrame, shape: tuple[int, int], run) -> np.ndarray:
    """Adds up a matrix that every task makes, in parts of _PART rows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = run(batches).astype(np.float32)
        ks = [k for k in range(0, shape[0], _PART) if made[k : k + _PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array([task_number()] * len(ks), pa.int32()), pa.array([made[k : k + _PART].tobytes() for k in ks], pa.binary())], names=["k", "task", "m"])

    out = np.zeros(shape)
    for k, m in tree_sum(found.mapInArrow(parts, "k int, task int, m binary"), np.float64, sent=np.float32).collect():
        out[k : k + _PART] = np.frombuffer(m, np.float64).reshape(-1, shape[1])
    return out


def document_counts(docs: DataFrame) -> np.ndarray:
    """How many documents hold each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        found = np.zeros(CELLS)
        for batch in batches:
            for _, words in _word_blocks(batch.column(0)):
                at = cells(words.name)
                for a in range(0, len(words.first) - 1, 256):  # some documents at once, which bounds the table
                    some = slice(words.first[a], words.first[min(a + 256, len(words.first) - 1)])
                    has = np.zeros((min(256, len(words.first) - 1 - a), CELLS), bool)
                    has[words.doc[some] - a, at[some]] = True
                    found += has.sum(0)
        return found[:, None]

    return _summed(docs.select("text"), (CELLS, 1), run)[:, 0]


def latent_basis(docs: DataFrame, items: list[Items], weight: np.ndarray, documents: int, components: int = COMPONENTS) -> np.ndarray:
    """The right singular vectors of the passages' weighted matrix, a row for each cell."""
    texts = docs.select("text").coalesce(max(FIT_TASKS, -(-documents // FIT)))

    def random() -> np.ndarray:
        return np.random.default_rng(7).standard_normal((CELLS, components)).astype(np.float32)

    def ranged(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """The matrix times a random one and back; the last row begins with the matrix's energy."""
        start = random() * weight[:, None]
        out = np.zeros((CELLS + 1, components), np.float32)
        for batch in batches:
            for _, words in _word_blocks(batch.column(0)):
                p = Passages(words, weight, start)
                if not len(p.heavy):
                    continue
                # a word is in the passage that begins at its unit or just before it, and in the one before that
                image = p.long()
                inner = np.flatnonzero(p.place)
                both = image.copy()
                both[inner] += image[inner - 1]
                doc, cell = words.doc[p.heavy], p.cell[p.heavy]
                nth = words.place[p.heavy] // (2 * UNIT)
                own, sums = _cell_sums(both, np.searchsorted(p.doc, np.arange(len(p.count)))[doc] + nth, cell)
                out[own] += sums
                out[CELLS, 0] += float(((1 + (nth > 0)) * weight[cell] ** 2).sum())
        out[:CELLS] *= weight[:, None]
        return out

    def rows(matrix: np.ndarray) -> np.ndarray:
        """The items' rows times a matrix."""
        return np.array([(weight[c := cells(w), None] * matrix[c]).sum(0) for block in items for _, w in block.pieces]).reshape(-1, matrix.shape[1])

    found = _summed(texts, (CELLS + 1, components), ranged)
    spread, energy = found[:CELLS], found[CELLS, 0]
    own = sum(float((weight[cells(w)] ** 2).sum()) for block in items for _, w in block.pieces)
    scale = ITEM_SHARE * energy / own if own and energy else 1.0
    start = random()
    image = rows(start)
    at = 0
    for block in items:
        for _, w in block.pieces:
            c = cells(w)
            np.add.at(spread, c, scale * weight[c, None] * image[at])
            at += 1
    # the small matrix is the random matrix times the range: no second pass
    base, rest = np.linalg.qr(spread)
    values, vectors = np.linalg.eigh(start.T @ spread)
    kept = values > 1e-7 * max(1e-30, values[-1])
    half = rest @ (vectors[:, kept] / np.sqrt(values[kept]))
    values, vectors = np.linalg.eigh(half @ half.T)
    kept = values[::-1] > 1e-9 * max(1e-30, values[-1])
    return (base @ vectors[:, ::-1][:, kept]).astype(np.float32)


def common_subsequence(item: np.ndarray, passage: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the longest common subsequence, and for each prefix of the item the length with it (bit-parallel)."""
    n = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << n) - 1
    v = full
    for w in passage.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    hits = np.array([not v >> k & 1 for k in range(n)], np.int64)
    return int(hits.sum()), hits


def _verified(items: Items, k: int, near: np.ndarray) -> float:
    """Share of item k found in order within half as many words again, somewhere near; 0 when not similar enough."""
    item, tail = items.words[k], items.answer[k]
    least = SIMILAR if len(item) >= LEAST else 1.0
    if common_subsequence(item, near)[0] < least * len(item):
        return 0.0
    size, best = -(-3 * len(item) // 2) if len(item) >= LEAST else len(item), 0.0
    for a in range(0, max(1, len(near) - size + len(item) // 4 + 1), max(1, len(item) // 4) if len(item) >= LEAST else 1):
        span = near[a : a + size]
        share = common_subsequence(item, span)[0] / len(item)
        if share >= least and share > best and 2 * common_subsequence(item[len(item) - tail :], span)[0] >= tail:
            best = share
    return best


def _near(places: list[int], length: int) -> Iterator[tuple[int, int]]:
    """Words of a document around the passages that hold a piece of an item of this length; what overlaps is taken together."""
    around = length if length <= PIECE else -(-3 * length // 2)  # the piece may be the first or last of a loose copy
    a = b = -1
    for p in places:
        start, end = max(0, p - around), p + SPAN + around
        if start > b:
            if b >= 0:
                yield a, b
            a = start
        b = end
    if b >= 0:
        yield a, b


def _candidates(items: Items, words: Words, weight: np.ndarray, basis: np.ndarray) -> dict[tuple[int, int], set[int]]:
    """(document, item) with the places of the passages by which they may match."""
    hits: dict[tuple[int, int], set[int]] = {}
    if len(items.tiny_words) and len(words.name):
        at = np.minimum(np.searchsorted(items.tiny_words, words.name), len(items.tiny_words) - 1)
        for w in np.flatnonzero(items.tiny_words[at] == words.name).tolist():
            for k in items.tiny[int(words.name[w])]:
                hits.setdefault((int(words.doc[w]), k), set()).add(int(words.place[w]))
    if not len(items.pieces):
        return hits
    p = Passages(words, weight, basis)
    in_items = np.minimum(np.searchsorted(items.vocabulary, words.name), len(items.vocabulary) - 1)
    in_items = np.where(items.vocabulary[in_items] == words.name, in_items, -1)
    for short in (False, True):
        pieces = np.flatnonzero(items.short == short)
        if not len(pieces):
            continue
        sums, doc, place = p.short() if short else (p.long(), p.doc, p.place)
        span = SPAN // 2 if short else SPAN
        norm = np.linalg.norm(sums, axis=1)
        full = np.flatnonzero(norm > 0)
        vectors = np.ascontiguousarray(items.vectors[pieces].T)
        step = max(1, _SCORES // len(pieces))
        for a in range(0, len(full), step):
            rows = full[a : a + step]
            row, col = np.nonzero(sums[rows] @ vectors >= CANDIDATE * norm[rows, None])
            if not len(row):
                continue
            passage, piece = rows[row], pieces[col]
            begin = words.first[doc[passage]] + place[passage]
            size = np.minimum(span, words.first[doc[passage] + 1] - begin)
            # the weight of the piece's words that the passage holds
            pair = np.repeat(np.arange(len(passage)), size)
            word = in_items[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            pair, word = pair[word >= 0], word[word >= 0]
            wanted = piece[pair] * len(items.vocabulary) + word
            found = items.holds[np.minimum(np.searchsorted(items.holds, wanted), len(items.holds) - 1)] == wanted
            share = np.bincount(pair[found], weight[cells(items.vocabulary[word[found]])], len(passage))
            for i in np.flatnonzero(share >= SHARED * items.total[piece]).tolist():
                hits.setdefault((int(doc[passage[i]]), int(items.owner[piece[i]])), set()).add(int(place[passage[i]]))
    return hits


def _block_matches(docs: DataFrame, items: Items, weight: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(doc_id, item_id, share) of the best item of each document that holds one."""
    items.ready(weight, basis)
    sent = docs.sparkSession.sparkContext.broadcast((items, weight, basis * weight[:, None]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, ready = sent.value
        for batch in batches:
            best: dict[int, tuple[float, int]] = {}
            for base, words in _word_blocks(batch.column(1)):
                for (d, k), places in _candidates(items, words, weight, ready).items():
                    for a, b in _near(sorted(places), len(items.words[k])):
                        share = _verified(items, k, words.name[words.first[d] : words.first[d + 1]][a:b])
                        now = (share, -items.ids[k])
                        if share and now > best.get(base + d, (0.0, 0)):
                            best[base + d] = now
            rows = sorted(best)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([-best[r][1] for r in rows], pa.int64()), pa.array([best[r][0] for r in rows], pa.float64())], names=["doc_id", "item_id", "share"])

    return docs.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, share double")


def _blocks_of(benchmark: DataFrame) -> list[Items]:
    """The items in blocks of about BLOCK pieces."""
    out, held, pieces = [], [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(word_names(r.text.encode()))
        if n:
            held.append((r.item_id, r.text))
            pieces += -(-n // PIECE)
        if pieces >= BLOCK:
            out.append(Items(held))
            held, pieces = [], 0
    return [*out, Items(held)] if held else out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of every document that holds a benchmark item: its best item."""
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, share double")
    if items := _blocks_of(benchmark):
        documents = docs.count()
        weight = weights(document_counts(docs), documents, items)
        basis = latent_basis(docs, items, weight, documents)
        for block in items:
            found = found.union(_block_matches(docs, block, weight, basis))
    best = F.max(F.struct("share", (-F.col("item_id")).alias("k"))).alias("b")
    return found.groupBy("doc_id").agg(best).select("doc_id", (-F.col("b.k")).alias("item_id"), F.col("b.share").alias("share"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id").join(found, "doc_id", "left").withColumn("contaminated", F.col("item_id").isNotNull())
