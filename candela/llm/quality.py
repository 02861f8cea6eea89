"""Document quality by co-training on two views.

One classifier sees the text's content (hashed words and what the words and characters are like), the other the page's
metadata (source, language, size and layout: numbers and lengths of lines). Both start from the labelled rows. In each
round Spark scores all unlabelled documents of the training part with both views; a histogram of the scores over all of
them gives the cut-offs beyond which a view is surest, of each class in the labels' proportion, and these documents are
pseudo-labels for the other view, which is fitted anew to the labelled rows and a bounded number of them. The share that
is labelled so grows from round to round, and labels are given anew each time, so that mistakes can be taken back. At the
end each view is calibrated on labelled rows (by regressing the label on its score) and a regression on both calibrated
scores combines them to score all documents. The views' numbers are computed once and kept in a table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import logistic

#: Bounds of what the models are fitted to: labelled rows, and pseudo-labelled ones a round and view, each those with the
#: smallest hashes of doc_id. All documents are scored for pseudo-labels.
LABELLED_ROWS = 6_000
FIT_ROWS = 4_000
ROUNDS = 3
#: The share of all unlabelled documents that a view labels in the first round; in the k-th, k times as many.
GROWTH = 0.05
HELD_OUT = (4, 2)
WORD_BUCKETS = 256
SOURCE_BUCKETS = 32
LANGUAGES = ("en", "de", "fr", "es")
#: Scores are counted in steps of STEP up to MOST on both sides.
STEP, MOST = 0.02, 20.0
_UPPER, _DIGIT, _VISIBLE = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[^\w\s.,;:'\"()?-]")
_KEPT_WORDS = 400_000
_buckets: dict[str, int] = {}
SHAPE = 14


def _bucket(word: str) -> int:
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) >= _KEPT_WORDS:
            _buckets.clear()
        found = _buckets[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
    return found


def content_view(text: str) -> list[float]:
    """SHAPE numbers (shares of capitals, digits, symbols and exclamation marks, of repeated words, lines and word pairs,
    word lengths, sentence ends) and the shares of the words in each hash bucket."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lower = [w.lower() for w in words]
    lines = text.split("\n")
    buckets = np.bincount(np.fromiter(map(_bucket, lower), dtype=np.int64, count=len(lower)), minlength=WORD_BUCKETS)
    shape = [
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        len(_VISIBLE.findall(text)) / chars,
        text.count("!") / n,
        text.count(".") / n,
        text.count(",") / n,
        1 - len(set(lower)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(zip(lower, lower[1:]))) / n,
        sum(map(len, words)) / n,
        sum(len(w) <= 3 for w in words) / n,
        sum(w[:1].isupper() for w in words) / n,
        sum(a == b for a, b in zip(lower, lower[1:])) / n,
        float(not words),
    ]
    return shape + (buckets / n).tolist()


def metadata_view(text: str, source: str | None, lang: str | None) -> list[float]:
    """Source (hashed), language, size, and numbers and lengths of lines."""
    lengths = np.array([len(x) for x in text.split("\n")], dtype=float)
    known = np.zeros(SOURCE_BUCKETS)
    known[zlib.crc32((source or "").encode()) % SOURCE_BUCKETS] = 1.0
    layout = [math.log1p(len(text)), math.log1p(len(lengths)), math.log1p(lengths.mean()), math.log1p(lengths.max()), float((lengths < 20).mean()), float((lengths == 0).mean()), float(lengths.std() / (1 + lengths.mean()))]
    return layout + [float(lang == x) for x in LANGUAGES] + known.tolist()


#: How many numbers each view has, and of how many of them (the first) the squares count too.
WIDTHS = (SHAPE + WORD_BUCKETS, 7 + len(LANGUAGES) + SOURCE_BUCKETS)
SQUARED = (SHAPE, WIDTHS[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class View:
    """A standardised linear classifier on numbers and the squares of the first of them; score() is its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    squared: int
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, squared: int) -> View:
        view = View(x.mean(axis=0), x.std(axis=0) + 1e-6, squared, np.zeros(0))
        view.weights = logistic(view._design(x), y, ridge=3e-3, rounds=15)
        return view

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[z, np.minimum(z[:, : self.squared] ** 2, 9.0)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + self._design(x) @ self.weights[1:]


@dataclass
class Model:
    views: tuple[View, View] | None
    calibration: tuple[np.ndarray, np.ndarray]
    combination: np.ndarray  # of the constant and both views' calibrated log odds; without views the constant is all

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        z = np.full(len(views[0]), self.combination[0])
        if self.views:
            for view, x, (a, b), w in zip(self.views, views, self.calibration, self.combination[1:]):
                z = z + w * (a + b * view.score(x))
        return _sigmoid(z)


def constant(y: np.ndarray) -> Model:
    """Without labels of both kinds: the share of label 1, a half without labels."""
    share = float(y.mean()) if len(y) else 0.5
    return Model(None, (np.zeros(2), np.zeros(2)), np.array([math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0]))


def parted(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which labelled rows fit the views and which calibrate them (a third); all do both where a part lacks a class."""
    own = np.arange(len(y)) % 3 != 0
    if y[own].min() == y[own].max() or y[~own].min() == y[~own].max():
        own = np.ones(len(y), dtype=bool)
    return own, ~own if not own.all() else own


def combined(views: tuple[View, View], labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> Model:
    scores = [view.score(x) for view, x in zip(views, labelled)]
    calibration = tuple(logistic(s[:, None], y, ridge=1e-3) for s in scores)
    both = np.c_[tuple(a + b * s for s, (a, b) in zip(scores, calibration))]
    return Model(views, calibration, logistic(both, y, ridge=1e-3))


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -MOST, MOST) / STEP).astype(np.int64)


def cut_offs(counts: dict[int, int], share: float, positive: float) -> tuple[int, int]:
    """The last bin of the surest rows of class 0 and the first of class 1: as many bins from each end as hold at most
    their part of the share of all rows, none on the wrong side of zero."""
    total = sum(counts.values())
    low, high, held = -1 - int(MOST / STEP) - 1, int(MOST / STEP) + 1, 0
    for k in sorted(counts):
        held += counts[k]
        if k >= 0 or held > share * (1 - positive) * total:
            break
        low = k
    held = 0
    for k in sorted(counts, reverse=True):
        held += counts[k]
        if k < 0 or held > share * positive * total:
            break
        high = k
    return low, high


def _columns(docs: DataFrame) -> DataFrame:
    """The columns that the views read, by their names in `documents`; missing ones are null."""
    have = {c.lower() for c in docs.columns}
    of = lambda c: docs[c].cast("string") if c in have else F.lit(None).cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), of("source").alias("source"), of("lang").alias("lang"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, fold (whether it may be learned from) and both views' numbers (a, b: half-precision floats), written."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = list(zip(*(part.column(c).to_pylist() for c in (2, 3, 4))))
                a = [np.array(content_view(t), dtype="<f2").tobytes() for t, _, _ in rows]
                b = [np.array(metadata_view(*r), dtype="<f2").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "fold", "a", "b"])

    fold = common.remainder(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]
    return common.written(_columns(docs).select("doc_id", fold.alias("fold"), "text", "source", "lang").mapInArrow(look, "doc_id long, fold boolean, a binary, b binary"), "quality-views")


def _matrix(column, width: int) -> np.ndarray:
    """The numbers of an Arrow column or list of half-precision floats, a row each."""
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(bytes(x) for x in values), dtype="<f2").astype(np.float64).reshape(len(values), width)


def _scored(batch: pa.RecordBatch, views: tuple[View, View]) -> list[np.ndarray]:
    return [view.score(_matrix(batch.column(c), w)) for c, (view, w) in enumerate(zip(views, WIDTHS), batch.num_columns - 2)]


def histograms(pool: DataFrame, views: tuple[View, View]) -> list[dict[int, int]]:
    """How many of the pool's rows each view scores in each bin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            for v, z in enumerate(_scored(batch, views)):
                for k, n in zip(*np.unique(bins_of(z), return_counts=True)):
                    found[v, int(k)] = found.get((v, int(k)), 0) + int(n)
        keys = list(found)
        yield pa.RecordBatch.from_pydict({"view": pa.array([v for v, _ in keys], pa.int32()), "bin": pa.array([k for _, k in keys], pa.int64()), "n": pa.array([found[x] for x in keys], pa.int64())})

    rows = pool.select("a", "b").mapInArrow(count, "view int, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect()  # at most both views' bins
    return [{r["bin"]: r["n"] for r in rows if r["view"] == v} for v in (0, 1)]


def pseudo_labels(pool: DataFrame, views: tuple[View, View], share: float, positive: float) -> DataFrame:
    """order, doc_id, view (that is given the label), label and that view's numbers, of the rows that the other view is
    surest of; of more than FIT_ROWS for a view, those with the smallest hashes."""
    counts = histograms(pool, views)
    cuts = [cut_offs(c, share, positive) for c in counts]
    sure = [sum(n for k, n in c.items() if k <= low or k >= high) for c, (low, high) in zip(counts, cuts)]
    # what is kept of the surest rows before the exact bound, so that only about that many are ever sorted
    most = [int((1 << 32) * min(1.0, 1.25 * FIT_ROWS / max(1, n))) for n in sure]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column(0).to_numpy()
            for v, z in enumerate(_scored(batch, views)):
                bins = bins_of(z)
                at = np.flatnonzero(((bins <= cuts[v][0]) | (bins >= cuts[v][1])) & (order < most[v]))
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(at), 1 - v, dtype=np.int32)), pa.array((bins[at] >= cuts[v][1]).astype(np.int32)), part.column(3 - v)], ["order", "doc_id", "view", "label", "x"])

    hashed = F.pmod(F.xxhash64("doc_id", "a"), F.lit(1 << 32)).alias("order")
    rows = pool.select(hashed, "doc_id", "a", "b").mapInArrow(choose, "order long, doc_id long, view int, label int, x binary")
    each = [rows.where(F.col("view") == v).orderBy("order", "doc_id", "x").limit(FIT_ROWS) for v in (0, 1)]
    return each[0].unionByName(each[1])


def train(rows: DataFrame, labels: DataFrame, rounds: int = ROUNDS, growth: float = GROWTH) -> Model:
    """A model from at most LABELLED_ROWS labelled rows outside the held-out part (of rows with the same doc_id, the
    least) and the pseudo-labels that the views give each other over all other rows there. rows: as described()."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label")).where("label in (0, 1)")
    fold = common.remainder(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]
    chosen = common.written(known.where(fold).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS), "quality-labels")
    named = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("a", "b")).alias("r")).select("doc_id", "label", "r.a", "r.b").orderBy("doc_id").toPandas()  # at most LABELLED_ROWS
    y = named["label"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return constant(y)
    labelled = tuple(_matrix(named[c], w) for c, w in zip("ab", WIDTHS))
    own, rest = parted(y)
    pool = rows.where("fold").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    views = tuple(View.fit(x[own], y[own], n) for x, n in zip(labelled, SQUARED))
    for turn in range(1, rounds + 1):
        given = common.written(pseudo_labels(pool, views, growth * turn, float(y[own].mean())), "quality-pseudo").orderBy("view", "order", "doc_id", "x").toPandas()  # at most FIT_ROWS a view
        parts = [given[given["view"] == v] for v in (0, 1)]
        views = tuple(View.fit(np.r_[x[own], _matrix(part["x"], w)], np.r_[y[own], part["label"].to_numpy(dtype=float)], n) for x, part, w, n in zip(labelled, parts, WIDTHS, SQUARED))
    return combined(views, tuple(x[rest] for x in labelled), y[rest])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (the probability of label 1) and predicted (score at least 0.5) of every document.

    Null and empty texts are scored like others (no words, one empty line), as are null sources and languages; texts of
    any length are read whole; repeated rows get equal scores, rows with the same doc_id and different texts each their
    own (of them the least is learned from); ties in score fall into one bin and are labelled together or not at all;
    without labels of both kinds every score is the share of label 1 (a half without labels); an empty table gives an
    empty result.
    """
    rows = described(docs)
    model = train(rows, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = tuple(_matrix(batch.column(c), w) for c, w in zip((1, 2), WIDTHS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(views))], ["doc_id", "score"])

    scored = rows.select("doc_id", "a", "b").mapInArrow(score, "doc_id long, score double")
    held = common.remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
