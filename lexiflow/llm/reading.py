"""Reading level by a Rasch-style latent difficulty model.

Every document d has a latent level t[d] and every item (a word, or a shape) an occurrence difficulty b[i]: the log of the
rate at which item i occurs in d is a[i] + t[d] * b[i], less the norm of the document. Items with a positive difficulty
occur the more the more demanding a text is. The parameters are estimated by alternating optimisation:

* document step: given a and b, each document's level is the root of one equation in its own weighted count, with a
  normal prior; this runs where the document is, and needs only the parameters, whose number is bounded;
* item step: given the levels, a Newton step for a[i] and b[i]; what it needs of the documents are the sums of counts
  times level and a histogram of levels, both aggregated in the tasks before they are shuffled.

The first item step uses the graded passages alone, which anchors the scale; the others use passages and documents, until the
passages' levels move by less than ``TOLERANCE`` grades (root mean square) in a round.

The driver holds ``PASSAGES`` graded passages at most, in the order of a hash of their text if there are more, and their
counts as lists of what is there. They fix the item bank: all their words, and shapes (word lengths and sentence lengths),
which any language has. Levels are brought to the passages' grades by the median
latent level of each grade, which errors of single raters don't move; between the medians the scale is linear.

Results: ``basis`` is 'words' for English texts, and for texts without a known language of which three words in ten or
more are in the bank; 'shape' for other texts; null, with a null level, for null texts and texts without any word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import cut_table

WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
SENTENCE_END = re.compile(r"[.!?…]+\s")
PRIOR, RIDGE, PASSAGES = 0.2, 1.0, 20_000
TOLERANCE, ROUNDS = 0.02, 30
GRID = np.linspace(-6.0, 6.0, 2401)
LONGEST_WORD, LONGEST_SENTENCE, SENTENCE_STEP = 16, 60, 4
SHAPES = [f"#{n}" for n in range(1, LONGEST_WORD + 1)] + [f"#s{n}" for n in range(0, LONGEST_SENTENCE + 1, SENTENCE_STEP)]
FEW = 0.3


def shape_counts(text: str, words: list[str]) -> np.ndarray:
    """Counts of the shapes: lengths of words, and of sentences in blanks."""
    size = np.bincount(np.minimum(np.fromiter(map(len, words), np.int64, len(words)), LONGEST_WORD), minlength=LONGEST_WORD + 1)[1:]
    spans = np.fromiter((min(s.count(" "), LONGEST_SENTENCE) // SENTENCE_STEP for s in SENTENCE_END.split(text)), np.int64)
    return np.concatenate([size, np.bincount(spans, minlength=len(SHAPES) - LONGEST_WORD)])


class Family:
    """One family of items and its parameters."""

    def __init__(self, size: int):
        self.a, self.b, self.total = np.full(size, -np.log(max(size, 1))), np.zeros(size), np.zeros(size)
        self._table()

    def _table(self) -> None:
        """Mean difficulty of the items that a document of each level of GRID has."""
        if len(self.a):
            eta = self.a + GRID[:, None] * self.b
            p = np.exp(eta - eta.max(axis=1, keepdims=True))
            self.p = p / p.sum(axis=1, keepdims=True)
        else:
            self.p = np.zeros((len(GRID), 0))
        self.mean = self.p @ self.b

    def levels(self, n: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        """Document step: the root of ``weighted - n * mean(t) - PRIOR * t``, found by bisection on GRID (the mean rises with t)."""
        lo, hi = np.zeros(len(n), np.int64), np.full(len(n), len(GRID) - 1)
        for _ in range(12):
            mid = (lo + hi) // 2
            up = weighted - n * self.mean[mid] - PRIOR * GRID[mid] > 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        f = lambda i: weighted - n * self.mean[i] - PRIOR * GRID[i]
        top, low = f(lo), f(hi)
        share = np.where(top > low, top / np.where(top > low, top - low, 1), 0.0)
        return GRID[lo] + np.clip(share, 0, 1) * (GRID[hi] - GRID[lo])

    def step(self, total: np.ndarray, by_level: np.ndarray, mass: np.ndarray, newtons: int) -> None:
        """Item step from the counts of each item, the counts times level, and the histogram of counts over GRID."""
        for _ in range(newtons):
            m0 = mass @ self.p
            m1, m2 = (mass * GRID) @ self.p, (mass * GRID * GRID) @ self.p
            ga, gb = total - m0, by_level - m1 - RIDGE * self.b
            haa, hbb = m0 + 1e-3, m2 + RIDGE
            det = haa * hbb - m1 * m1
            self.a = np.clip(self.a + np.clip((hbb * ga - m1 * gb) / det, -2, 2), -20, 5)
            self.b = self.b + np.clip((haa * gb - m1 * ga) / det, -2, 2)
            self._table()


class Counts:
    """Counts of items in passages, as lists of (passage, item, count)."""

    def __init__(self, rows: list[Counter], items: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.int64)
        self.item = np.array([i for r in rows for i in r], dtype=np.int64)
        self.n = np.array([n for r in rows for n in r.values()], dtype=float)
        self.rows, self.items = len(rows), items

    def by_item(self, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.item, weights=self.n if weight is None else self.n * weight[self.row], minlength=self.items)

    def by_row(self, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.row, weights=self.n if weight is None else self.n * weight[self.item], minlength=self.rows)


def _on_grid(level: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((level - GRID[0]) / (GRID[1] - GRID[0])), 0, len(GRID) - 1).astype(np.int64)


class Model:
    """Both families and the scale."""

    def __init__(self, passages: list[tuple[str, float]]):
        passages = [(t, float(g)) for t, g in passages if t and g is not None]
        cut_up = [WORDS.findall(t.lower()) for t, _ in passages]
        self.bank = {w: i for i, w in enumerate(sorted({w for ws in cut_up for w in ws}))}
        self.grade = np.array([g for _, g in passages])
        self.start = (self.grade - self.grade.mean()) / (self.grade.std() or 1.0) if len(passages) else self.grade
        self.words, self.shapes = Family(len(self.bank)), Family(len(SHAPES))
        shapes = (dict(enumerate(shape_counts(t, ws).tolist())) for (t, _), ws in zip(passages, cut_up, strict=True))
        self.counts = (
            Counts([Counter(self.bank[w] for w in ws if w in self.bank) for ws in cut_up], len(self.bank)),
            Counts([Counter({i: n for i, n in s.items() if n}) for s in shapes], len(SHAPES)),
        )
        self.at = [self.start, self.start]
        self._items([None, None], 6)

    def families(self) -> tuple[Family, Family]:
        return self.words, self.shapes

    def _items(self, documents: list, newtons: int) -> None:
        """Item step of both families on the passages and, if given, the documents' sums; then the passages' levels."""
        for k, family in enumerate(self.families()):
            if not len(family.a) or not len(self.grade):
                continue
            x = self.counts[k]
            total, by_level, mass = x.by_item(), x.by_item(self.at[k]), np.bincount(_on_grid(self.at[k]), weights=x.by_row(), minlength=len(GRID))
            if documents[k] is not None:
                total, by_level, mass = total + documents[k][0], by_level + documents[k][1], mass + documents[k][2]
            family.step(total, by_level, mass, newtons)
            self.at[k] = family.levels(x.by_row(), x.by_row(family.b))

    def scale(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(latent level, grade): the rising medians of the grades, in a straight line beyond the ends."""
        grades = np.unique(self.grade)
        at = np.maximum.accumulate([np.median(self.at[k][self.grade == g]) for g in grades])
        at = at + np.arange(len(at)) * 1e-9
        if len(at) > 1:
            for i, j, end in ((0, 1, -1), (-1, -2, 1)):
                slope = (grades[i] - grades[j]) / max(abs(at[i] - at[j]), 1e-3)
                far = at[i] + end * 10
                far_grade = grades[i] + end * 10 * abs(slope)
                at, grades = (np.insert(at, 0, far), np.insert(grades, 0, far_grade)) if end < 0 else (np.append(at, far), np.append(grades, far_grade))
        return at, grades

    def graded(self) -> list[np.ndarray]:
        """The passages' levels in grades, by both families."""
        return [np.interp(self.at[k], *self.scale(k)) if len(self.grade) else self.grade for k in range(2)]


def vectors(df: DataFrame, key: str, text: str, lang: str, bank: dict[str, int]) -> DataFrame:
    """(k, basis, n_words, item, n, shape): the counts of the bank's words and of the shapes in each document."""
    shared = df.sparkSession.sparkContext.broadcast(bank)
    kept = "k long, lang string, n_words long, found long, words long, item array<int>, n array<int>, shape array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in batch.column(2).to_pylist():
                words = WORDS.findall(t.lower()) if t else []
                hit = Counter(map(get, words))
                missed = hit.pop(None, 0)
                shape = shape_counts(t, words) if words else np.zeros(0, np.int64)
                for o, v in zip(out, (len(t.split()) if t else 0, len(words) - missed, len(words), list(hit), list(hit.values()), shape), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[i], pa.int64()) for i in range(3)), *(pa.array(out[i], pa.list_(pa.int32())) for i in (3, 4, 5))], ["k", "lang", "n_words", "found", "words", "item", "n", "shape"])

    made = df.select(F.col(key).cast("long").alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(work, kept)
    by_words = (F.col("found") > 0) & ((F.col("lang") == "en") | F.col("lang").isNull() & (F.col("found") >= FEW * F.col("words")))
    basis = F.when(F.col("words") == 0, F.lit(None)).when(F.coalesce(by_words, F.lit(False)), "words").otherwise("shape")
    return made.select("k", basis.alias("basis"), "n_words", F.when(basis == "words", F.col("item")).alias("item"), F.when(basis == "words", F.col("n")).alias("n"), "shape")


def _sparse(batch: pa.RecordBatch, k: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, items and counts of family k in a batch, and each row's sum of counts and of counts times difficulty."""
    rows = batch.num_rows
    if k == 0:
        items, counts = batch.column("item"), batch.column("n")
        size = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        item, n = items.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
    else:
        shape = batch.column("shape")
        size = shape.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = shape.flatten().to_numpy(zero_copy_only=False)
        item = np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.arange(rows), size)
    return row, item, n, np.bincount(row, weights=n, minlength=rows), np.bincount(row, weights=n * b[item], minlength=rows)


def fit(documents: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Alternate over the documents' vectors until the passages' levels stand still, ``rounds`` times at most. A task returns
    sums as long as the bank and the grid, never rows of documents."""
    sc = documents.sparkSession.sparkContext
    for _ in range(rounds):
        before = model.graded()
        shared = sc.broadcast(model)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            out = [[np.zeros(len(f.a)), np.zeros(len(f.a)), np.zeros(len(GRID))] for f in own.families()]
            for batch in batches:
                for k, family in enumerate(own.families()):
                    row, item, n, total, weighted = _sparse(batch, k, family.b)
                    level = family.levels(total, weighted)
                    out[k][0] += np.bincount(item, weights=n, minlength=len(family.a))
                    out[k][1] += np.bincount(item, weights=n * level[row], minlength=len(family.a))
                    out[k][2] += np.bincount(_on_grid(level), weights=total, minlength=len(GRID))
            for k in range(2):
                for what in range(3):
                    v = out[k][what]
                    at = np.flatnonzero(v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 3 * k + what), pa.int32()), pa.array(at, pa.int32()), pa.array(v[at])], ["what", "at", "value"])

        got = documents.where("basis is not null").mapInArrow(sums, "what int, at int, value double").groupBy("what", "at").agg(F.sum("value").alias("value")).collect()
        sizes = [len(model.words.a)] * 2 + [len(GRID)] + [len(model.shapes.a)] * 2 + [len(GRID)]
        full = [np.zeros(s) for s in sizes]
        for what, at, value in sorted(map(tuple, got)):
            full[what][at] = value
        model._items([full[:3], full[3:]], 4)
        shared.unpersist()
        if all(((a - b) ** 2).sum() <= TOLERANCE**2 * len(a) for a, b in zip(before, model.graded(), strict=True)):
            break
    return model


def levels(documents: DataFrame, model: Model, key: str) -> DataFrame:
    """(key, basis, n_words, latent, level): every document, on the scale of the grades."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scales = [own.scale(k) for k in range(2)] if len(own.grade) else None
        for batch in batches:
            at, grade = [], []
            for k, family in enumerate(own.families()):
                _, _, _, total, weighted = _sparse(batch, k, family.b)
                at.append(family.levels(total, weighted))
                grade.append(np.interp(at[k], *scales[k]) if scales else np.full(batch.num_rows, np.nan))
            basis = batch.column("basis").to_pylist()
            pick = np.array([x != "words" for x in basis], dtype=np.int64)
            none = np.array([x is None for x in basis]) | (scales is None)
            rows = np.arange(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("basis"), batch.column("n_words"), *(pa.array(np.array(v).reshape(2, -1)[pick, rows], mask=none) for v in (at, grade))], [key, "basis", "n_words", "latent", "level"])

    return documents.mapInArrow(work, f"`{key}` long, basis string, n_words long, latent double, level double")


def reading_levels(df: DataFrame, key: str, text: str, lang: str, passages: DataFrame, passage_text: str = "text", grade: str = "grade") -> DataFrame:
    """Fit the model on ``passages`` and all rows of ``df``, then give every row its level.

    Documents are cut into words once; their counts are written and read again by each round.
    """
    graded = passages.where(F.col(passage_text).isNotNull() & F.col(grade).isNotNull()).select(passage_text, grade)
    graded = graded.orderBy(F.xxhash64(passage_text), passage_text, grade).limit(PASSAGES).collect()
    model = Model([(r[0], r[1]) for r in graded])
    documents = cut_table(vectors(df, key, text, lang, model.bank))
    return levels(documents, fit(documents, model), key)
