"""Operator 9: hierarchical language identification with one-versus-one linear support vector machines.

A text's features are the frequencies of its hashed letter n-grams (bytes of the lower-cased text, anything
but letters read as one space).  Languages are grouped into families by their codes; a code in no listed
family is a family of its own.  Linear support vector machines, one for each pair of families, vote for
the family; one for each pair of languages within it vote for the language.  The score multiplies the
logistic values of the winner's weakest margins at both levels.

Training takes SAMPLE texts of each label (those with the smallest hashes of doc_id; for a pair of families SAMPLE of
each family), a bound that does not grow with the input, and only rows that are not held out: crc32 of doc_id as text,
modulo FOLDS, is not 0.  Every pair is trained by a task of its own; only the machines' weights come to the driver.
Only text and lang are learned from.  Every row is predicted from its whole text, in one pass; long texts are counted
in steps of PIECE_BYTES, cut between words.

Cases: null texts and texts without a letter get `und` and score 0, and so does every text when no label
can be learned; with one label all others get it; equal votes go to the larger margin sum, then to the
smaller code; repeated rows are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloupe.llm.common import row_groups, stored, table, text_views, word_spans

FOLDS = 5
SAMPLE = 600
GRAM_BITS = 12
ORDERS = (2, 3)
DIMENSIONS = 256 + (len(ORDERS) << GRAM_BITS)
#: Bytes of a text that are counted in one step, and texts that are.
PIECE_BYTES = 1 << 20
TEXTS = 64
#: Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
    "celtic": ("ga", "cy", "gd", "br"),
    "baltic": ("lt", "lv"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family_of(code: str) -> str:
    return _FAMILY.get(code.lower().split("-")[0].split("_")[0], code)


def _letters(text: memoryview) -> tuple[bytes, bool]:
    """The text's lower-case letters with single spaces, and whether it has a letter."""
    low = bytes(text).decode("utf-8", "replace").lower()
    raw = low.encode("utf-8", "replace").translate(_LETTERS)
    plain = raw.strip(b" ")
    has = bool(plain) and (any(c.isalpha() for c in low[:200]) or any(c.isalpha() for c in low))
    data = np.frombuffer(raw, np.uint8)
    keep = np.append(True, (data[1:] != 32) | (data[:-1] != 32)) if len(data) else np.zeros(0, bool)
    return b" " + data[keep].tobytes() + b" ", has


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams that start at each byte, order by order."""
    yield data.astype(np.int32)
    value = data.astype(np.uint32)
    base = 256
    for n in range(2, max(ORDERS) + 1):
        value = value[:-1] * np.uint32(0x9E3779B1) + data[n - 1 :]
        if n in ORDERS:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA77)
            yield (mixed >> np.uint32(32 - GRAM_BITS)).astype(np.int32) + base
            base += 1 << GRAM_BITS


def _cut(text: memoryview) -> Iterator[memoryview]:
    """A long text in pieces that end where a word does."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        _, ends = word_spans(np.frombuffer(text[at : at + PIECE_BYTES], np.uint8))
        ends = ends[ends < PIECE_BYTES]
        size = int(ends[-1]) if len(ends) else PIECE_BYTES
        while len(text) > at + size and text[at + size] & 0xC0 == 0x80:  # a word of a whole piece is cut at a character
            size += 1
        yield text[at : at + size]
        at += size
    yield text[at:]


def features(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the frequencies of its n-grams, order by order; and whether it has a letter."""
    out, total, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros((len(texts), 1 + len(ORDERS))), np.zeros(len(texts), bool)
    rows, parts = [], []

    def count() -> None:
        size = np.array([len(p) for p in parts])
        owner = np.repeat(np.array(rows), size)
        begin = (np.cumsum(size) - size)[1:]
        base = 0
        for k, gram in enumerate(_grams(np.frombuffer(b"".join(parts), np.uint8))):
            n, width = (1, *ORDERS)[k], 256 if k == 0 else 1 << GRAM_BITS
            own = owner[: len(gram)]
            ok = np.ones(len(gram), bool)
            if n > 1:  # n-grams that run into the next piece do not count
                over = (begin[:, None] - np.arange(1, n)).ravel()
                ok[over[(over >= 0) & (over < len(ok))]] = False
            low = int(owner[0])
            some = int(owner[-1]) + 1 - low
            found = np.bincount((own[ok] - low) * width + gram[ok] - base, minlength=some * width).reshape(some, width)
            out[low : low + some, base : base + width] += found
            total[low : low + some, k] += found.sum(1)
            base += width
        rows.clear()
        parts.clear()

    held = 0
    for i, text in enumerate(texts):
        for piece in _cut(text):
            data, letter = _letters(piece)
            has[i] |= letter
            rows.append(i)
            parts.append(data)
            held += len(data)
            if held >= PIECE_BYTES:
                count()
                held = 0
    if parts:
        count()
    base = 0
    for k in range(1 + len(ORDERS)):
        width = 256 if k == 0 else 1 << GRAM_BITS
        out[:, base : base + width] /= np.maximum(1, total[:, k : k + 1])
        base += width
    return out, has


def _train(x: np.ndarray, sign: np.ndarray, rounds: int = 40, rate: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear SVM by averaged stochastic subgradients of the hinge loss; x is standardised."""
    rng = np.random.default_rng(1)
    weight, bias, mean, mean_bias, step = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    balance = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            eta = 1 / (rate * (step + 1000))
            wrong = (sign[batch] * (x[batch] @ weight + bias) < 1) * balance[batch] * sign[batch]
            weight *= 1 - eta * rate
            weight += eta / len(batch) / x.shape[1] * (wrong @ x[batch])
            bias += eta / len(batch) / x.shape[1] * wrong.sum()
            mean += (weight - mean) / step
            mean_bias += (bias - mean_bias) / step
    margin = sign * (x @ mean + mean_bias)
    unit = max(1e-9, float(np.median(margin[margin > 0]))) if (margin > 0).any() else 1.0
    return mean / unit, mean_bias / unit


class Hierarchy:
    """The trained machines: weights of all pairs side by side, one column each."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = sorted(languages)
        groups: dict[str, list[str]] = {}
        for code in self.languages:
            groups.setdefault(family_of(code), []).append(code)
        self.families = sorted(groups)
        self.members = groups
        names = [("", a, b) for a, b in combinations(self.families, 2)] + [(f, a, b) for f in self.families for a, b in combinations(groups[f], 2)]
        self.pairs: dict[tuple[str, str, str], int] = {p: k for k, p in enumerate(names)}
        self.table = np.zeros((DIMENSIONS, len(names)), np.float32)
        self.bias = np.zeros(len(names))

    def sides(self) -> list[tuple[int, str, bool]]:
        """(pair, language, whether it is on the first side) for every language that a pair's machine learns from."""
        out = []
        for (level, a, b), k in self.pairs.items():
            for side in (a, b):
                out += [(k, code, side == a) for code in (self.members[side] if level == "" else (side,))]
        return out

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's number and its weakest margin, for each row."""
        n = len(margins)
        if len(names) == 1:
            return np.zeros(n, np.int64), np.full(n, np.inf)
        votes, total, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
        for i, j in combinations(range(len(names)), 2):
            m = margins[:, self.pairs[(level, names[i], names[j])]]
            for k, v in ((i, m), (j, -m)):
                votes[:, k] += v > 0
                total[:, k] += v
                least[:, k] = np.minimum(least[:, k], v)
        first = np.argmax(votes + 1e-6 * np.tanh(total), axis=1)
        return first, least[np.arange(n), first]

    def predict(self, texts: list[memoryview]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        found, has = features(texts)
        margins = found @ self.table + self.bias
        family, weakest = self._vote("", self.families, margins)
        out = np.full(len(texts), "und", object)
        score = 1 / (1 + np.exp(-3 * np.clip(weakest, -10, 10)))
        for k, name in enumerate(self.families):
            at = np.flatnonzero((family == k) & has)
            code, least = self._vote(name, self.members[name], margins[at])
            out[at] = np.array(self.members[name], object)[code]
            score[at] *= 1 / (1 + np.exp(-3 * np.clip(least, -10, 10)))
        return out.tolist(), np.where(has, score, 0.0)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Hierarchy:
    """Learns from at most `sample` texts of each label."""
    known = docs.where(~held_out() & F.col("lang").isNotNull())
    h = F.xxhash64("doc_id", F.lit(3))
    # about three samples of each label pass this bound, so that ranking never sees a whole label
    bound = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(3.0 * sample) / F.count("*")).alias("part"))
    rows = known.where(F.rlike("text", F.lit(r"\p{L}"))).select("lang", "text", h.alias("h"), "doc_id")
    # a row per label; the model holds a machine for each pair of labels of a family, so they are few
    near = rows.select("lang", "doc_id", "h").join(F.broadcast(bound), "lang").where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) <= F.col("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "h")
    picked = rows.join(F.broadcast(chosen), ["doc_id", "h"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_views(batch.column(2))
            for a in range(0, len(texts), TEXTS):
                found, _ = features(texts[a : a + TEXTS])
                at = [np.flatnonzero(x).astype(np.uint16) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + TEXTS], batch.column(1)[a : a + TEXTS], pa.array([k.tobytes() for k in at], pa.binary()), pa.array([x[k].tobytes() for x, k in zip(found, at, strict=True)], pa.binary())], names=["lang", "h", "at", "x"])

    found = stored(picked.select("lang", "h", "text").mapInArrow(run, "lang string, h long, at binary, x binary"), "language-features")
    model = Hierarchy([r.lang for r in found.select("lang").distinct().collect()])
    if not model.pairs:
        return model
    sides = docs.sparkSession.createDataFrame(model.sides(), "pair int, lang string, first boolean")
    best = F.row_number().over(Window.partitionBy("pair", "first").orderBy("h", "lang"))
    rows = found.join(sides, "lang").withColumn("n", best).where(F.col("n") <= sample)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first", "h", "lang"]).reset_index(drop=True)
        x = np.zeros((len(frame), DIMENSIONS), np.float32)
        for k, (at, values) in enumerate(zip(frame["at"], frame["x"], strict=True)):
            x[k, np.frombuffer(at, np.uint16)] = np.frombuffer(values, np.float32)
        center, spread = x.mean(0), x.std(0) + 1e-4
        weight, bias = _train((x - center) / spread, np.where(frame["first"], 1.0, -1.0))
        weight = (weight / spread).astype(np.float32)
        return pd.DataFrame({"pair": [frame["pair"].iloc[0]], "weight": [weight.tobytes()], "bias": [bias - float(weight.astype(np.float64) @ center)]})

    # a machine for each pair of families and of languages within one: as many as the model holds
    for pair, weight, bias in rows.groupBy("pair").applyInPandas(fit, "pair int, weight binary, bias double").collect():
        model.table[:, pair], model.bias[pair] = np.frombuffer(weight, np.float32), bias
    return model


def identify(docs: DataFrame, model: Hierarchy, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, scores = text_views(batch.column(1)), [], []
            for a, b in row_groups(texts, 1 << 19):
                for c in range(a, b, TEXTS):
                    name, score = sent.value.predict(texts[c : min(b, c + TEXTS)])
                    names += name
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
