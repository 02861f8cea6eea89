"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage.

The index holds, for each term, the items that contain it with their BM25 weights, each divided by the score that the
item's own text would get; a passage's score for an item is then the share of the item's weight that it covers, and one
threshold serves all items. Search is block-max WAND over blocks of item numbers: the terms' largest weights within a
block bound the scores of its items, which tells at once which blocks are live (mostly none). Then a cursor a term moves
through that term's items in order; the terms' largest weights tell the first item that can reach the threshold at all
(the pivot), and where that lies in a dead block, the cursors skip to the next live one. Everything at or above the
threshold is retrieved and then verified by the overlap of the item's question and answer.

Passages are overlapping windows of the whole text, twice as long as the longest item of the index and half a window
apart, so that any occurrence of an item lies within one of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
THRESHOLD = 0.6
BLOCK = 4
SHINGLE = 5
#: Least shares of an item's shingles, and of the words of its question and of its answer, in a verified passage.
OVERLAP, PART = 0.8, 0.5
#: Most words of test items in one index, which every executor holds; more items make more indexes, searched in turn.
SHARD_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"(?<=[.?!])\s+(?=\S)|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words, parted before its last line or sentence; a single sentence is all question."""
    cut = [m for m in _SENTENCE_END.finditer(text) if text[m.end() :].strip()]
    if not cut:
        return words_of(text), []
    return words_of(text[: cut[-1].start()]), words_of(text[cut[-1].end() :])


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; fewer words: all of them as one run."""
    return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


@dataclass
class Index:
    """Postings by term: numbers of items in ascending order with their weights; and for the blocks of BLOCK items that a
    term occurs in, one list after the other from block_starts[term] on, their numbers and the term's largest weight."""

    items: list[tuple[int | None, list[str], list[str]]]  # id, question, answer
    terms: dict[str, int]
    posted: list[list[int]]
    weights: list[list[float]]
    most: np.ndarray  # each term's largest weight
    block_starts: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray
    window: int


def build(items: list[tuple[int | None, str]], df: dict[str, int], n_items: int, mean_words: float) -> Index:
    """The index of some items, with the document frequencies, number and mean length of all of them."""
    parted = [(item_id, *question_and_answer(text)) for item_id, text in items]
    terms: dict[str, int] = {}
    posted: list[list[int]] = []
    weights: list[list[float]] = []
    for number, (_, question, answer) in enumerate(parted):
        words = question + answer
        tf = Counter(words)
        weight = {t: float(np.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5))) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean_words)) for t, n in tf.items()}
        own = sum(weight.values())
        for t, w in weight.items():
            if t not in terms:
                terms[t] = len(terms)
                posted.append([])
                weights.append([])
            posted[terms[t]].append(number)
            weights[terms[t]].append(w / own)
    n = np.array([len(x) for x in posted])
    term, weight = np.repeat(np.arange(len(n)), n), np.array([w for x in weights for w in x])
    block = np.array([k for x in posted for k in x]) // BLOCK
    at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    most = np.maximum.reduceat(weight, np.r_[0, np.cumsum(n)[:-1]])
    return Index(parted, terms, posted, weights, most, np.searchsorted(term[at], np.arange(len(n) + 1)), block[at], np.maximum.reduceat(weight, at), 2 * max(len(q) + len(a) for _, q, a in parted))


_SLACK = 1e-9  # sums are rounded by their order


def live_blocks(index: Index, terms: np.ndarray, goal: float) -> list[int]:
    """The blocks whose bound for a passage of these terms reaches the goal."""
    first, n = index.block_starts[terms], index.block_starts[terms + 1] - index.block_starts[terms]
    ends = np.cumsum(n)
    at = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
    return np.flatnonzero(np.bincount(index.blocks[at], index.block_most[at]) >= goal).tolist()


def retrieve(index: Index, terms: np.ndarray, threshold: float, told: Counter | None = None) -> list[tuple[int, float]]:
    """All items whose score for a passage of these distinct terms is at least the threshold. told: gets how many items
    were scored, and how often the cursors skipped to the next live block."""
    goal, found = threshold - _SLACK, []
    if not len(terms) or index.most[terms].sum() < goal or not (live := live_blocks(index, terms, goal)):
        return found
    told = Counter() if told is None else told
    # a cursor: item, place in the postings, term
    cursors = [[0, 0, t] for t in terms.tolist()]
    bound = dict(zip(terms.tolist(), index.most[terms].tolist()))
    moved, goes = cursors, live[0] * BLOCK
    while True:
        for cursor in moved:
            items = index.posted[cursor[2]]
            cursor[1] = bisect_left(items, goes, cursor[1])
            cursor[0] = items[cursor[1]] if cursor[1] < len(items) else -1
        cursors = sorted(c for c in cursors if c[0] >= 0)
        total, last = 0.0, -1
        for k, (_, _, t) in enumerate(cursors):
            total += bound[t]
            if total >= goal:
                last = k
                break
        if last < 0:
            return found
        pivot = cursors[last][0]
        while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
            last += 1
        next_live = bisect_left(live, pivot // BLOCK)
        moved = cursors[: last + 1]
        if next_live == len(live):
            return found
        if live[next_live] != pivot // BLOCK:
            told["skipped"] += 1
            goes = live[next_live] * BLOCK
        elif cursors[0][0] == pivot:
            told["scored"] += 1
            score = sum(index.weights[t][at] for _, at, t in moved)
            if score >= threshold:
                found.append((pivot, score))
            goes = pivot + 1
        else:
            goes = pivot


def verify(item: tuple[int | None, list[str], list[str]], words: list[str]) -> tuple[float, float, float]:
    """The shares that these words hold of an item's shingles (across question and answer), of its question's words and
    of its answer's; without an answer, the last is 1."""
    _, question, answer = item
    wanted, there, held = shingles(question + answer), shingles(words), set(words)
    of = lambda part: sum(w in held for w in part) / len(part) if part else 1.0
    return len(wanted & there) / len(wanted) if wanted else 1.0, of(question), of(answer)


def search(index: Index, words: list[str], threshold: float = THRESHOLD) -> dict[int, tuple[float, float, float]]:
    """Verified items of one text: number in the index to the best score and question and answer overlaps."""
    found: dict[int, tuple[float, float, float]] = {}
    ids = np.array([index.terms.get(w, -1) for w in words], dtype=np.int64)
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return found
    bound = np.r_[0.0, np.cumsum(np.where(ids >= 0, index.most[ids], 0.0))]
    step = index.window // 2
    for first in range(0, max(1, len(words) - step), step):
        stop = min(first + index.window, len(words))
        if bound[stop] - bound[first] < threshold - 1e-9:
            continue
        terms = np.unique(ids[first:stop])
        for number, score in retrieve(index, terms[terms >= 0], threshold):
            whole, question, answer = verify(index.items[number], words[first:stop])
            if whole >= OVERLAP and min(question, answer) >= PART and score > found.get(number, (0.0,))[0]:
                found[number] = (score, question, answer)
    return found


def _postings_stats(items: DataFrame) -> DataFrame:
    """Distinct terms of each item (document frequencies are counted from them) and its number of words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"item": batch.column(0), "n_words": pa.array([len(w) for w in words], pa.int64()), "terms": pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))})

    return items.select("item", "text").mapInArrow(split, "item long, n_words long, terms array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every verified match of a document and an item.

    Null and empty texts, documents or items, match nothing; repeated documents match alike, each row by itself;
    repeated items are items of their own; null ids are kept; empty tables give an empty result. Long texts are
    searched whole, window by window.
    """
    spark = docs.sparkSession
    items = common.written(benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"], F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()), "bench-items")
    stats = common.written(_postings_stats(items), "bench-stats").where("n_words > 0")
    n_items, words = stats.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    shards = max(1, -(-words // SHARD_WORDS))
    df = stats.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts, result = common.documents(docs), None
    for shard in range(shards if n_items else 0):
        own = stats.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        rows = items.join(own.select("item"), "item").select("item_id", "text").orderBy("item_id", "text").collect()  # about SHARD_WORDS
        if not rows:
            continue
        frequencies = {r["term"]: r["df"] for r in own.select(F.explode("terms").alias("term")).distinct().join(df, "term").collect()}
        index = spark.sparkContext.broadcast(build([(r["item_id"], r["text"]) for r in rows], frequencies, n_items, words / n_items))

        def look(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for k, text in enumerate(batch.column(1)):
                    for number, told in search(index.value, words_of(text.as_py()), threshold).items():
                        found.append((k, index.value.items[number][0], *told))
                if found:
                    k, item, score, question, answer = zip(*found)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(k, pa.int64())), "item_id": pa.array(item, pa.int64()), "score": score, "question_overlap": question, "answer_overlap": answer})

        part = texts.mapInArrow(look, schema)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result
