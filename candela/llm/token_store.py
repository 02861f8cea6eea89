"""Token-id files with one shared zstandard dictionary.

A dictionary is trained on the serialized ids of a bounded sample of documents. Each file holds documents in ascending
doc_id order, every one compressed on its own with that dictionary, then an index of offsets and the dictionary's hash,
so that a short document is read by one seek and cannot be decoded with another dictionary.

File: MAGIC, 32 bytes SHA-256 of the dictionary, the frames, the index (frame lengths, little-endian u64), the number of
frames (u64) and the index's offset (u64).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, files, tokens

MAGIC = b"TOKZ0001"
END_ID = 2
#: Bounds of the dictionary and of what it is trained on.
SAMPLE_DOCUMENTS = 600
SAMPLE_CHARS = 4000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: A file is closed when it has so many bytes; a task goes on in another.
FILE_BYTES = 64 << 20


def train(docs: DataFrame, path: str, end_id: int = END_ID) -> bytes:
    """A dictionary from the first characters of the documents with the smallest hashes of doc_id (of rows with the
    same doc_id, one); with too little to train on, some fixed content."""
    least = (F.xxhash64("doc_id"), "doc_id")
    ids = common.documents(docs).select("doc_id").distinct().orderBy(*least).limit(SAMPLE_DOCUMENTS)  # ids alone: little is sent
    chosen = common.documents(docs).join(F.broadcast(ids), "doc_id")
    rows = chosen.groupBy("doc_id").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).orderBy(*least).collect()  # at most SAMPLE_DOCUMENTS
    end = end_id.to_bytes(4, "little")
    samples = [x + end for x in tokens.encoder(path).encode([r.text for r in rows])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return np.arange(1024, dtype="<u4").tobytes()


def write(docs: DataFrame, path: str, dictionary: bytes, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the files, in ascending doc_id order over all partitions; one manifest row each: file, bytes, part and nth (its
    place in the order), documents, ids. There are at least as many partitions as the input has splits, and files are
    closed at FILE_BYTES, so neither tasks nor indexes grow with the input."""
    digest = hashlib.sha256(dictionary).digest()
    end = end_id.to_bytes(4, "little")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
        encoder, part, nth = tokens.encoder(path), TaskContext.get().partitionId(), 0
        rows = _encoded(batches, encoder, end)
        row = next(rows, None)
        while row is not None:
            lengths, known, ids, size = [], [], 0, 0
            with files.created(folder, "tokens") as (name, out):
                out.write(MAGIC + digest)
                while row is not None and size < FILE_BYTES:
                    doc_id, raw = row
                    frame = squeeze(raw)
                    out.write(frame)
                    lengths.append(len(frame))
                    known.append(doc_id)
                    size += len(frame)
                    ids += len(raw) // 4
                    row = next(rows, None)
                at = len(MAGIC) + len(digest) + size
                null = np.array([x is None for x in known], dtype=np.uint8)
                named = np.array([x or 0 for x in known], dtype="<i8").tobytes() + null.tobytes()
                out.write(np.array(lengths, dtype="<u8").tobytes() + named + struct.pack("<QQ", len(lengths), at))
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([at + 17 * len(lengths) + 16], pa.int64()), "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "documents": pa.array([len(lengths)], pa.int64()), "ids": pa.array([ids], pa.int64())})
            nth += 1

    spark = docs.sparkSession
    rows = common.documents(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions(), 1)
    # of the texts only openings, which have the same order, are sampled for the ranges' ends
    ordered = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(store, "file string, bytes long, part int, nth int, documents long, ids long")


def _encoded(batches: Iterator[pa.RecordBatch], encoder: tokens.Encoder, end: bytes) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and the ids of each document."""
    for batch in batches:
        known = batch.column(0).to_pylist()
        for part in tokens.groups(batch.column(1)):
            for (k, _), raw in zip(part, encoder.encode([text for _, text in part])):
                yield known[k], raw + end


def read(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; manifest with `before`, the ids of all
    earlier files."""
    digest = hashlib.sha256(dictionary).digest()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress
        for batch in batches:
            for name, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if files.read(name, 0, len(MAGIC) + 32) != MAGIC + digest:
                    raise ValueError(f"{name} was written with another dictionary")
                n, at = struct.unpack("<QQ", files.read(name, size - 16, 16))
                index = files.read(name, at, 17 * n)
                lengths = np.frombuffer(index, dtype="<u8", count=n)
                ids, null = np.frombuffer(index, dtype="<i8", count=n, offset=8 * n), np.frombuffer(index, dtype=np.uint8, offset=16 * n)
                ends = np.cumsum(lengths, dtype=np.int64) + len(MAGIC) + 32
                begins = ends - lengths.astype(np.int64)
                k = 0
                while k < n:  # a few megabytes of frames at a time
                    j = max(k + 1, int(np.searchsorted(ends, begins[k] + (4 << 20), side="right")))
                    block = files.read(name, int(begins[k]), int(ends[j - 1] - begins[k]))
                    raws = (expand(block[a:b]) for a, b in zip((begins[k:j] - begins[k]).tolist(), (ends[k:j] - begins[k]).tolist()))
                    counted = [(len(raw) // 4, zlib.crc32(raw)) for raw in raws]
                    counts = np.array([x for x, _ in counted], dtype=np.int64)
                    starts = start + np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[k:j], pa.int64(), mask=null[k:j].astype(bool)), "start": starts, "n_tokens": counts, "ids_crc32": pa.array([x for _, x in counted], pa.int64())})
                    start += int(counts.sum())
                    k = j

    return manifest.select("file", "bytes", "before").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids and read them back: doc_id, start (ids of all documents before it), n_tokens (with the
    end id) and ids_crc32.

    A null text is empty (just the end id); null doc_ids come first; rows with equal doc_id are ordered by text; an
    empty table gives an empty result. Texts of any length are one frame each.
    """
    spark = docs.sparkSession
    dictionary = train(docs, path, end_id)
    manifest = common.written(write(docs, path, dictionary, common.scratch(spark, "token-files"), end_id), "token-manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = manifest.withColumn("before", before)  # a row a file
    return read(spread.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), dictionary)
