"""Packing documents into fixed-length sequences by minimum bin slack.

Lengths are at most the capacity, so the whole packing problem is a histogram of that many counts, whatever the number
of documents. Bin after bin, the longest remaining length is fixed and a bitset subset-sum dynamic program over the
available lengths finds the fullest feasible combination with it; the combination is removed as often as the counts
allow. The resulting combinations (some thousands at most) give each rank within a length its bin and place; documents
find theirs by their rank, which is counted per written block and summed over blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 1024
END_ID = 2


def fullest(counts: list[int], first: int, capacity: int) -> dict[int, int]:
    """The fullest combination that holds one piece of length `first`: how many of each length. counts: available."""
    room = capacity - first
    goal, reach, steps = 1 << room, 1, []
    mask = (goal << 1) - 1
    for length in range(min(first, room), 0, -1):
        most = min(counts[length] - (length == first), room // length)
        if most <= 0:
            continue
        before, step = reach, 1
        while most:  # binary splitting: up to `most` copies in about log2(most) shifts
            step = min(step, most)
            reach |= (reach << (step * length)) & mask
            most -= step
            step *= 2
        steps.append((length, before))
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, {first: 1}
    for length, before in reversed(steps):
        while not before >> at & 1:
            at -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Combinations and how often each is used, for all pieces of the histogram."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    made = []
    for first in range(capacity, 0, -1):
        while counts[first]:
            chosen = fullest(counts, first, capacity)
            times = min(counts[length] // n for length, n in chosen.items())
            for length, n in chosen.items():
                counts[length] -= n * times
            made.append((times, chosen))
    return made


def _places(made: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length the intervals of ranks that a combination takes, in one sorted array: key = length * 2**42 + rank."""
    taken, sequence, rows = [0] * (capacity + 1), 0, []
    for times, chosen in made:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append(((length << 42) + taken[length], n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("key", "each", "sequence", "offset"), table.T))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, kept: int | None = None) -> DataFrame:
    """One row per piece: block (of the task that made it), nth (among the block's pieces of this length), doc_id,
    piece, start, length, ids_crc32. The first piece of a longer document takes what the full ones leave. kept: see
    tokens.encoder()."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        block, seen, encoder = uuid.uuid4().hex, np.zeros(capacity + 1, dtype=np.int64), tokens.encoder(path, kept=kept)
        for batch in batches:
            ids = batch.column(0)
            for part in tokens.groups(batch.column(1)):
                rows = []
                for (k, _), raw in zip(part, encoder.encode([text for _, text in part])):
                    raw += end
                    n = len(raw) // 4
                    first = (n - 1) % capacity + 1
                    stops = range(first, n + 1, capacity)
                    for piece, stop in enumerate(stops):
                        start = stop - first if not piece else stop - capacity
                        rows.append((k, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                k, piece, start, length, crc = np.array(rows, dtype=np.int64).T
                nth = np.empty(len(rows), dtype=np.int64)
                for size in np.unique(length):
                    at = np.flatnonzero(length == size)
                    nth[at] = seen[size] + np.arange(len(at))
                    seen[size] += len(at)
                yield pa.RecordBatch.from_pydict({"block": [block] * len(rows), "nth": nth, "doc_id": ids.take(pa.array(k)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc})

    return common.documents(docs).mapInArrow(cut, "block string, nth long, doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, kept: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document. kept: how many
    pieces of words each worker's encoder stores (None: tokens.KEPT_PIECES); the ids don't depend on it.

    A null text is empty: its document is the end id alone. Repeated rows and null doc_ids are packed like others;
    documents of any length are cut into pieces; an empty table gives an empty result.
    """
    made = common.written(pieces(docs, path, capacity, end_id, kept), "pack-pieces")
    counted = common.written(made.groupBy("block", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan(histogram, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("earlier").to_numpy()
            key = (length << 42) + rank
            at = np.searchsorted(places["key"], key, side="right") - 1
            use, nth = np.divmod(key - places["key"][at], places["each"][at])
            columns = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": places["sequence"][at] + use, "offset": places["offset"][at] + nth * length})

    # merged, not broadcast: the offsets grow with the blocks
    return made.join(offsets.hint("merge"), ["block", "length"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
