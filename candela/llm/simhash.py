"""SimHash near-duplicate detection with pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to fixed reference fingerprints (pivots). The zero pivot and
the block pivots (fingerprints with one two-bit block set) place it in a table: the difference of two of its distances
moves only if a bit of that block differs, so fingerprints at most `bits` apart agree on all distances of at least
`groups - bits` of the `groups` groups of block pivots. Rows are matched on those agreeing distances, pairs whose
largest coordinate difference over all pivots exceeds `bits` are discarded, and the survivors are verified.

A cell of the table with more members than `dense` isn't expanded into pairs: its members are linked exactly through
their one-bit neighbours instead (two fingerprints are at most two bits apart just if they share a neighbour at most one
bit from each), which costs 65 rows a member, whatever the size of the cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 3
BITS = 2
BLOCK_BITS = 2
GROUPS = 6
RANDOM_PIVOTS = 16
DENSE = 48
#: Shingles hashed at once, so that a very long text needs no more memory than this many hashes and their bits.
CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted; 0 without words."""
    words = common.words_of(text)
    if not words:
        return 0
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return int(hashes[0])
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts, stops = [0, *(ends[: len(words) - size]).tolist()], (ends[size - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed long; null texts count as empty."""
    return common.documents(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def pivots(random: int = RANDOM_PIVOTS) -> list[int]:
    """Zero, the block pivots, and some fingerprints hashed from their numbers."""
    blocks = [((1 << BLOCK_BITS) - 1) << k for k in range(0, 64, BLOCK_BITS)]
    return [0, *blocks, *(xxhash.xxh64_intdigest(str(k).encode(), SEED) for k in range(random))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(fps: np.ndarray, references: list[int]) -> np.ndarray:
    """The pivot distance table: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ np.array(references, dtype=np.uint64)[None, :]).astype(np.int16)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each choice of the groups of block pivots that may agree: the distances that it holds, as one number."""
    blocks = 64 // BLOCK_BITS
    references = pivots(0)
    choices = list(combinations(range(GROUPS), GROUPS - BITS))
    held = [[k for g in choice for k in range(g * blocks // GROUPS, (g + 1) * blocks // GROUPS)] for choice in choices]
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        d = distances(fps, references)
        at = ((d[:, 1:] - d[:, :1] + BLOCK_BITS) // 2).astype(np.int64)  # 0 to BLOCK_BITS
        cells = [at[:, ks] @ ((BLOCK_BITS + 1) ** np.arange(len(ks), dtype=np.int64)) for ks in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(fps, len(held))), pa.array(np.repeat(np.arange(len(held), dtype=np.int32), len(fps))), pa.array(np.concatenate(cells))], ["fp", "choice", "cell"])


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside small cells: the pairs that the pivot distances can't rule out, verified."""
    references = pivots()
    for frame in frames:
        a, b = [], []
        for members in frame["fps"]:
            x = np.asarray(members, dtype=np.int64).view(np.uint64)
            table = distances(x, references)
            i, j = np.triu_indices(len(x), 1)
            near = np.abs(table[i] - table[j]).max(axis=1) <= BITS
            i, j = i[near], j[near]
            near = np.bitwise_count(x[i] ^ x[j]) <= BITS
            a.append(x[i[near]].view(np.int64))
            b.append(x[j[near]].view(np.int64))
        yield pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []}).astype("int64")


def links(marks: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most BITS apart, enough of them to connect every class: all within
    small cells, and one to the smallest sharer of each one-bit neighbour within dense ones. marks: one row per fp."""
    rows = marks.select("fp").mapInArrow(_cells, "fp long, choice int, cell long")
    # from a table, so that both sides of the join are shuffled for it and a hot cell's rows can be split
    sizes = common.written(rows.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    shared = common.written(rows.join(sizes.hint("merge"), ["choice", "cell"]), "simhash-cells")  # both grow with the documents
    small = shared.where(F.col("n") <= dense).groupBy("choice", "cell").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select("fps").mapInPandas(_pairs, "a long, b long")
    masks = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)).cast("long") for k in range(64)))
    around = shared.where(F.col("n") > dense).select("fp").distinct().select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    least = around.groupBy("at").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("at", "least")
    stars = around.join(least, "at").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def classes(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, for all nodes of the edges (a, b): alternating large and small
    stars, each round written to the shared folder, until nothing changes."""
    spark, path = edges.sparkSession, common.scratch(edges.sparkSession, "stars")
    now = common.written_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), path)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        before, path = path, common.scratch(spark, "stars")
        after = common.written_at(small, path)
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        common.dropped(spark, before)
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that is reached over links of
    at most BITS differing bits.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows stay, each with its class;
    a null doc_id takes no part in the minimum (a class of null ids only has a null component_id); an empty table gives
    an empty result.
    """
    marks = common.written(fingerprints(docs), "simhash-marks")
    distinct = common.written(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    roots = classes(links(distinct.select("fp")))
    reached = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("least").alias("reached"))
    linked = roots.join(reached, "root").select(F.col("node").alias("fp"), "reached")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"), "rows")
    return _named(marks, common.written(named, "simhash-named")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A fingerprint of more than one in so many rows is hot; there are at most so many of them.
HOT = 1000


def _named(marks: DataFrame, named: DataFrame) -> DataFrame:
    """marks with the class of their fingerprint: hot fingerprints' rows stay where they are, the others are shuffled."""
    total = named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = named.where(F.col("rows") * HOT > total).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    told = marks.join(F.broadcast(hot), "fp", "left")  # at most HOT rows
    rest = told.where("hot IS NULL").select("doc_id", "fp").join(named.where(F.col("rows") * HOT <= total).select("fp", "component_id").hint("merge"), "fp")
    return told.where("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest.select("doc_id", "fp", "component_id"))
