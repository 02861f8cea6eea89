"""Token counts of documents in flat token files that have no index, by scanning for the end-of-document id.

Files are read in blocks of a fixed number of ids, each block on its own. A vectorised search finds the separators of a
block; documents that end inside it are counted but for the first, whose beginning lies in earlier blocks. A prefix scan
over the blocks' last separators gives that beginning, and one over their numbers of separators the place of every
document in its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, files, tokens

END_ID = 50256
BLOCK_IDS = 1 << 20
#: Pieces that a worker's encoder keeps: fewer than elsewhere, since time is less scarce here than memory.
KEPT_PIECES = 100_000


def narrow(raw: bytes) -> np.ndarray:
    """32-bit ids as 16-bit ones; an id that doesn't fit is an error."""
    ids = np.frombuffer(raw, dtype="<u4")
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} doesn't fit 16 bits")
    return ids.astype("<u2")


def write_flat(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write every document's ids and the end id as little-endian unsigned 16-bit integers, one file a task. Rows: file,
    ids (in the file) and the doc_ids in the file's order, in lists of up to some thousand with the place of the first."""
    end = narrow(np.array([end_id], dtype="<u4").tobytes()).tobytes()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, total, place = tokens.encoder(path, plain=True, kept=KEPT_PIECES), [], 0, 0
        with files.created(folder, "flat") as (name, out):
            for batch in batches:
                for part in tokens.groups(batch.column(1)):
                    for raw in encoder.encode([text for _, text in part]):
                        ids = narrow(raw)
                        out.write(ids.tobytes() + end)
                        total += len(ids) + 1
                rows.append((place, batch.column(0).to_pylist()))
                place += batch.num_rows
        schema = pa.schema([("file", pa.string()), ("ids", pa.int64()), ("place", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        if rows:
            yield pa.RecordBatch.from_pydict({"file": [name] * len(rows), "ids": [total] * len(rows), "place": [x for x, _ in rows], "doc_ids": [x for _, x in rows]}, schema=schema)

    return common.documents(docs).mapInArrow(store, "file string, ids long, place long, doc_ids array<long>")


def blocks_of(names: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, block and the range of ids [first, stop) of every block; names: file and ids."""
    return names.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block_ids)))).select("file", "block", (F.col("block") * block_ids).alias("first"), F.least("ids", (F.col("block") + 1) * block_ids).alias("stop"))


def scan(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Each block's separators: how many, the last of them, and in `found` their positions in the file (end) with those of
    the ids after the one before (start; null for the first, whose document may begin in an earlier block)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, first, stop in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = np.frombuffer(files.read(name, 2 * first, 2 * (stop - first)), dtype="<u2")
                ends = np.flatnonzero(ids == end_id) + first
                starts = pa.array(np.concatenate([[0], ends[:-1] + 1])[: len(ends)], pa.int64(), mask=np.arange(len(ends)) == 0)
                found = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.StructArray.from_arrays([starts, pa.array(ends, pa.int64())], ["start", "end"]))
                yield pa.RecordBatch.from_pydict({"file": [name], "block": [block], "n": pa.array([len(ends)], pa.int64()), "last": pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), "found": found})

    return blocks.mapInArrow(search, "file string, block long, n long, last long, found array<struct<start: long, end: long>>")


def counted(scanned: DataFrame) -> DataFrame:
    """file, place (of the document in its file), start (its first id's position there) and n_tokens (with the end). The
    prefix scan sees two numbers a block; the blocks' separators stay where they are until its results are joined."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = scanned.select("file", "block", (F.coalesce(F.max("last").over(earlier), F.lit(-1)) + 1).alias("open"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    carried = scanned.select("file", "block", "found").join(scan.hint("merge"), ["file", "block"])
    placed = carried.select("file", "before", "open", F.posexplode("found").alias("k", "at")).withColumn("start", F.coalesce("at.start", "open"))
    return placed.select("file", (F.col("before") + F.col("k")).alias("place"), "start", (F.col("at.end") - F.col("start") + 1).alias("n_tokens"))


def counts(docs: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, file, place, start and n_tokens of every document, from flat files written for it and scanned.

    A null text is empty: one separator. Repeated rows and null doc_ids keep their places; a document of any length may
    span any number of blocks; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    written = common.written(write_flat(docs, path, common.scratch(spark, "flat-files"), end_id), "flat-manifest")
    names = written.select("file", "ids").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = counted(common.written(scan(blocks_of(names, block_ids).repartition(parts, "file", "block"), end_id), "flat-scanned"))
    named = written.select("file", "place", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("place") + F.col("k")).alias("place"), "doc_id")
    # both grow with the documents
    return named.join(found.hint("merge"), ["file", "place"]).select("doc_id", "file", "place", "start", "n_tokens")
