"""Katz back-off language model over words, for corpora whose n-grams no single machine holds.

The model, of order three: a count is discounted by Good-Turing (counts up to K; more are trusted), and what a context's
discounts free is shared among the words not seen after it, in proportion to their probability after the shorter
context: P(w|h) is the discounted relative frequency if hw was seen in training, however seldom, else alpha(h) P(w|h'),
where h' is h without its first word and alpha(h) is exactly what makes the sum over all words (and one unknown word,
which has what the unigram discounts free) one. A text's first word has the text's start as its only context.

The discounts are Katz's, of smoothed counts of counts (Gale and Sampson's Simple Good-Turing): numbers of types by their
count are averaged over the gaps between counts, and a line fitted to their logarithms stands for them, so copied
texts, which make many types with one count and few with the next, move no single discount.

The work: texts become files of word numbers, one a block. Blocks ask for the corpus counts of their words, then of their
word pairs, then of those triples whose both pairs were seen (others can't have been) and whose context isn't the
block's own (one that was seen once and occurs in no other block: its one next word stands in the block's file, which is
its part of the model), in packed arrays that are
dealt by hash of the context to buckets of bounded size, as a sorted run for each bucket; the runs of triples, which are
the most, go to one file a block, of which only the places are shuffled, and which is deleted when they are answered. A
bucket merges its runs, sums what blocks have counted in training documents,
keeps its part of the model (counts, and for each context whole numbers that tell the sum of the shorter probabilities,
from which its back-off weight follows exactly) as a row of a partitioned table, and replies to each block in a file, of which only the place is shuffled, since
a block reads its replies in every later step. Contexts of more than one in HOT training tokens (so
at most HOT of them) are spread over all buckets by their next word; their sums come back to the driver. So no task or
row holds more than a block, a bucket or its share, however often a run of words occurs.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

K = 5
HOT = 2000
BLOCK_BYTES = 6 << 20
BUCKET_WORDS = 400_000
BUCKET_PAIRS = 2_000_000
HELD_OUT = (7, 2)
END = 0  # the number of the end token, which is also the context at a text's start
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW, _SHIFT = np.uint64(0xFFFFFFFF), np.uint64(32)


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned integers, byte by byte in planes, compressed; rising: sorted ones, kept as differences."""
    values = np.ascontiguousarray(values, dtype="<u8")
    if rising and len(values):
        values = np.r_[values[:1], np.diff(values)]
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width, rising]) + _press().compress(planes)


@functools.cache
def _press() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@functools.cache
def _open() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def unpacked(data: bytes) -> np.ndarray:
    width, rising = data[0], data[1]
    planes = np.frombuffer(_open().decompress(data[2:]), dtype=np.uint8).reshape(width, -1)
    values = planes[0].astype(np.uint64)
    for k in range(1, width):
        values |= planes[k].astype(np.uint64) << np.uint64(8 * k)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def _text(words: list[bytes]) -> bytes:
    return _press().compress(b" ".join(words))


def _words(data: bytes) -> list[bytes]:
    joined = _open().decompress(data)
    return joined.split(b" ") if joined else []


#: Classes of counts: each count up to eleven, then eight classes for each doubling. Class k is from BINS[k] to BINS[k + 1] - 1.
BINS = np.unique(np.floor(2.0 ** (np.arange(62 * 8 + 1) / 8)).astype(np.int64))


def histogram(counts: np.ndarray) -> np.ndarray:
    """The number of types in each class of counts; types that weren't seen are in none."""
    return np.bincount(np.searchsorted(BINS, counts[counts > 0].astype(np.int64), side="right") - 1, minlength=len(BINS) - 1)


def slope(types: np.ndarray) -> float:
    """The slope of the line through log(types with a count) by log(count): a class's types are averaged over half the
    way to the next class with types on either side, and each such class is a point. -1 where there is no line."""
    there = np.flatnonzero(types)
    if len(there) < 2:
        return -1.0
    middle = (BINS[there] + BINS[there + 1] - 1) / 2
    below, above = np.r_[0.0, middle[:-1]], np.r_[middle[1:], 2 * middle[-1] - middle[-2]]
    return float(np.polyfit(np.log(middle), np.log(types[there] / ((above - below) / 2)), 1)[0])


def discounts(slope: float) -> np.ndarray:
    """Factor d_r for r = 0 to K (d_0 unused) where the number of types seen r times goes as r to the power of the slope.
    Katz's condition is that what counts up to K lose is what Good-Turing gives to lower ones: (1 - d_r) is in proportion
    to 1 - r*/r, and sums to the mass of types seen once. Then r*/r is (1 + 1/r) ** (slope + 1), and all factors are
    between 0 and 1 for any slope (at -1: by their limit)."""
    r, e = np.arange(1, K + 1), slope + 1
    if abs(e) < 1e-9:
        return np.r_[1.0, 1 - np.log1p(1 / r) / np.log(K + 1)]
    most = (K + 1.0) ** e
    return np.r_[1.0, ((1 + 1 / r) ** e - most) / (1 - most)]


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    counts = counts.astype(float)
    return counts * d[np.minimum(counts, K + 1).astype(int).clip(0, K)] * (counts <= K) + counts * (counts > K)


class Unigram:
    """P(w) by the training count of w; count 0 is the unknown word, all of them one type."""

    def __init__(self, total: int, types: np.ndarray) -> None:
        self.total, self.d = total, discounts(slope(types))
        freed = types[:K] @ _lost(self.d)
        self.unknown = freed / total if total and freed > 0 else 1.0 if not total else 1.0 / (total + 1)
        self.scale = 1.0 if not total or freed > 0 else total / (total + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.scale * _discounted(counts, self.d) / max(1, self.total), self.unknown)

    def mass(self, sums: np.ndarray) -> np.ndarray:
        """The probability of the words whose counts these columns of _by_count tell."""
        return self.scale * _total(sums, self.d) / max(1, self.total)


_KEPT = ("lengths", "held", "tokens", "words", "counts")


def _blocks(folder: str):
    """Files of texts as numbers of the block's own words: 0 is the end, others by their place in the words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        ids, texts, size, made = [], [], 0, 0

        def block() -> pa.RecordBatch:
            split = [common.words_of(t) for t in texts]
            lengths = np.array([len(s) + 1 for s in split], dtype=np.int64)
            coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
            held = np.array([common.remainder_of(i, HELD_OUT[0]) == HELD_OUT[1] for i in ids])
            tokens = np.zeros(int(lengths.sum()), dtype=np.int64)
            ends = np.cumsum(lengths) - 1
            inner = np.ones(len(tokens), dtype=bool)
            inner[ends] = False
            tokens[inner] = coded.indices.to_numpy() + 1
            words = coded.dictionary.to_pylist()
            trained = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(words) + 1)
            row = {"ids": pa.array([ids], pa.list_(pa.int64()))} | dict(zip(_KEPT, ([packed(lengths)], [np.packbits(held).tobytes()], [packed(tokens)], [_text(words)], [packed(trained[1:])])))
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_pydict(row)
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            data = sink.getvalue()
            with files.created(folder, "block") as (name, out):
                out.write(data)
            told = {"block": first + made, "bytes": data.size, "n_words": len(words), "n_tokens": len(tokens), "trained": int(trained.sum()), "trained_texts": int((~held).sum())}
            return pa.RecordBatch.from_pydict({"file": [name]} | {k: pa.array([v], pa.int64()) for k, v in told.items()})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if texts and size + len(text) > BLOCK_BYTES:
                    yield block()
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    return make


_MANIFEST = "file string, block long, bytes long, n_words long, n_tokens long, trained long, trained_texts long"


def _block(file: str, size: int) -> dict:
    """A block's row; its ids stay an Arrow array."""
    table = pa.ipc.open_stream(files.read(file, 0, size)).read_all()
    return {c: table.column(c)[0].as_py() for c in _KEPT} | {"ids": table.column("ids").chunk(0).values}


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values are among a few sorted ones."""
    if not len(few):
        return np.zeros(len(values), dtype=bool)
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values


def _distinct(*digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of whole numbers (the first array counts the most): their order (rows that are equal by their place), where
    each different one begins in it, and each row's place among the different ones. Numbers and places that fit 64 bits
    together are sorted as such, without an index beside them, which takes a fraction of the time."""
    size = len(digits[0])
    if not size:
        return (np.zeros(0, dtype=np.int64),) * 3
    index = np.int32 if size < 1 << 31 else np.int64
    width = [int(x.max()).bit_length() for x in digits]
    last = (size - 1).bit_length()
    if sum(width) + last <= 64:
        code = np.zeros(size, dtype=np.uint64)
        for x, bits in zip(digits, width):
            code = (code << np.uint64(bits)) | x.astype(np.uint64)
        code = np.sort((code << np.uint64(last)) | np.arange(size, dtype=np.uint64))
        order, code = (code & np.uint64((1 << last) - 1)).astype(index), code >> np.uint64(last)
        new = np.r_[True, code[1:] != code[:-1]]
    else:
        order = np.lexsort(digits[::-1])
        new = np.zeros(size, dtype=bool)
        new[0] = True
        for x in digits:
            told = x[order]
            new[1:] |= told[1:] != told[:-1]
    place = np.empty(size, dtype=index)
    place[order] = np.cumsum(new, dtype=index) - 1
    return order, np.flatnonzero(new), place


def _parts(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket (stable) and where each bucket's part of it begins; those under none (below 0) come first."""
    least = min(0, int(bucket.min())) if len(bucket) else 0
    order = _distinct(bucket - least)[0]
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _word_buckets(words: list[bytes], n: int) -> np.ndarray:
    return (pd.util.hash_array(np.array(words, dtype=object)) % np.uint64(n)).astype(np.int64) if words else np.zeros(0, dtype=np.int64)


def _dealt(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys ^ (keys >> _SHIFT)) * _MIX >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _by_rank(numbers: np.ndarray, n: int) -> np.ndarray:
    """The order of word numbers by bucket (of n), then rank: in it, each bucket's counts only fall."""
    return np.lexsort((numbers, (numbers - np.uint64(1)) % np.uint64(n)))


def _told_counts(keys: np.ndarray, counts: np.ndarray, n: int) -> bytes:
    """The counts of the pairs' next words, once a word and as falls, which are nearly all zero."""
    words, first = np.unique(keys & _LOW, return_index=True)
    falling = counts[first][_by_rank(words, n)].astype(np.int64)
    steps = np.r_[falling[:1], falling[:-1] - falling[1:]]  # below zero where a bucket begins
    return packed((steps << 1) ^ (steps >> 63))


def _untold_counts(keys: np.ndarray, data: bytes, n: int) -> np.ndarray:
    """A pair's count of its next word, from _told_counts."""
    words, index = np.unique(keys & _LOW, return_inverse=True)
    told = unpacked(data)
    steps = (told >> np.uint64(1)).astype(np.int64) ^ -(told & np.uint64(1)).astype(np.int64)
    steps[1:] *= -1
    counts = np.empty(len(words), dtype=np.int64)
    counts[_by_rank(words, n)] = np.cumsum(steps)
    return counts[index]


def _put(out, at: int, parts: list[bytes]) -> tuple[int, int]:
    """Write the parts to a file that is at `at`; where they are."""
    data = struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)
    out.write(data)
    return at, len(data)


def _got(file: str, at: int, size: int, n: int) -> list[bytes]:
    """The n parts that _put wrote there."""
    data = files.read(file, at, size)
    ends = np.cumsum((8 * n, *struct.unpack_from(f"<{n}Q", data))).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


_BINARY = pa.binary()
_WORD_ASK = {"bucket": pa.int32(), "block": pa.int64(), "words": _BINARY, "counts": _BINARY}
_PAIR_ASK = {"bucket": pa.int32(), "block": pa.int64(), "keys": _BINARY, "counts": _BINARY, "nexts": _BINARY}
_TRIPLE_ASK = {"bucket": pa.int32(), "block": pa.int64(), "file": pa.string(), "at": pa.int64(), "bytes": pa.int64()}


def _runs_filed(folder: str, block: int, runs: Iterator[tuple]) -> list[tuple]:
    """Rows of _TRIPLE_ASK of a block's runs (bucket and parts, by bucket), which go to one file."""
    rows, end = [], 0
    with files.created(folder, "runs") as (name, out):
        for bucket, *parts in runs:
            at, size = _put(out, end, parts)
            rows.append((bucket, block, name, at, size))
            end += size
    return rows


def _of_runs(answer, *names: str):
    """The answer to rows of _TRIPLE_ASK, given the parts of their runs as columns of these names."""

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_got(f, at, size, len(names)) for f, at, size in zip(frame["file"], frame["at"], frame["bytes"])]
        return answer(frame[["bucket", "block"]].assign(**{name: pd.Series(x, dtype=object, index=frame.index) for name, x in zip(names, zip(*parts))}))

    return told


def _ask_words(n: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, file, size in zip(*(batch.column(c).to_pylist() for c in range(3))):
                row = _block(file, size)
                words, counts = _words(row["words"]), unpacked(row["counts"])
                order, at = _parts(_word_buckets(words, n), n)
                runs = [(k, block, _text([words[j] for j in own.tolist()]), packed(counts[own])) for k in range(n) if len(own := order[at[k] : at[k + 1]])]
                yield from _table(runs, _WORD_ASK).to_batches()

    return ask


_ANSWER = "kind string, block long, bucket int, a binary, b binary, c binary, stats array<long>, file string, at long, bytes long"
_COLUMNS = ["kind", "block", "bucket", "a", "b", "c", "stats"]


def _filed(answer, folder: str):
    """The answer's rows; what it replies is put into one file of the bucket, and the rows say where."""

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        rows = answer(frame)
        where, end = [(None, None, None)] * len(rows), 0
        with files.created(folder, "replies") as (name, out):
            for k in np.flatnonzero(rows["kind"] == "reply").tolist():
                where[k] = name, *_put(out, end, [x or b"" for x in rows.loc[k, ["a", "b", "c"]]])
                end += where[k][2]
        rows.loc[rows["kind"] == "reply", ["a", "b", "c"]] = None
        return rows.assign(**{c: pd.Series(x, dtype=object) for c, x in zip(("file", "at", "bytes"), zip(*where))})

    return told


def _reply(row: dict) -> dict:
    """The bucket of a reply and its parts, from its file."""
    return {"bucket": row["bucket"]} | dict(zip("abc", _got(row["file"], row["at"], row["bytes"], 3)))


def _answer_words(n: int, hot_count: float):
    """kind: model (words and counts, the most frequent first), reply (numbers and counts for a block), hot."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [_words(x) for x in frame["words"]]
        codes, known = pd.factorize(np.array([w for ws in asked for w in ws], dtype=object))
        counts = np.bincount(codes, np.concatenate([unpacked(x) for x in frame["counts"]]).astype(float), len(known)).astype(np.int64)
        order = np.lexsort((np.asarray(pd.util.hash_array(known)), -counts))
        rank = np.empty(len(known), dtype=np.int64)
        rank[order] = np.arange(len(known))
        bucket = int(frame["bucket"].iloc[0])
        number = 1 + rank * n + bucket
        if len(number) and number.max() >= 1 << 32:
            raise ValueError("more than 2**32 different words")
        rows, at = [("model", None, bucket, _text([known[k] for k in order.tolist()]), packed(counts[order]), None, histogram(counts).tolist())], 0
        for block, ws in zip(frame["block"], asked):
            own = codes[at : at + len(ws)]
            at += len(ws)
            rows.append(("reply", block, bucket, packed(number[own]), packed(counts[own]), None, None))
        hot = np.flatnonzero(counts >= hot_count)
        rows.append(("hot", None, bucket, None, None, None, number[hot].tolist()))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return answer


#: Numbers that tell a context's sums at either order: by its next words' counts after it, and after the shorter context.
WIDE = 2 * (K + 1)


def _by_count(at: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """For each of `size` groups (at: that of each count): how many counts are 1, ..., K (a column each), and the sum of
    the larger ones."""
    few = counts <= K
    told = np.bincount(at[few].astype(np.int64) * (K + 1) + counts[few] - 1, minlength=size * (K + 1)).reshape(size, K + 1)
    told[:, -1] = np.bincount(at[~few], counts[~few].astype(float), size)
    return told


def _runs(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a sorted array begins, and each one's place among the different ones."""
    new = np.r_[True, rising[1:] != rising[:-1]][: len(rising)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _total(sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The sum of discounted counts that these columns of _by_count stand for."""
    return sums[..., :-1] @ (np.arange(1, K + 1) * d[1:]) + sums[..., -1]


class _Pairs:
    """A block's word pairs, from its file and the replies about its words. A pair's key is both numbers in one."""

    def __init__(self, row: dict, replies: list[dict], n_words: int, n_pairs: int, texts: int, hot: np.ndarray) -> None:
        words = _words(row["words"])
        order, at = _parts(_word_buckets(words, n_words), n_words)
        number, count = np.zeros(len(words) + 1, dtype=np.uint64), np.full(len(words) + 1, texts, dtype=np.int64)
        for r in replies:
            own = order[at[r["bucket"]] : at[r["bucket"] + 1]] + 1
            number[own], count[own] = unpacked(r["a"]), unpacked(r["b"])
        self.ids = row["ids"]
        self.lengths = unpacked(row["lengths"]).astype(np.int64)
        self.held = np.unpackbits(np.frombuffer(row["held"], dtype=np.uint8))[: len(self.lengths)].astype(bool)
        now = unpacked(row["tokens"]).astype(np.int64)
        before = np.r_[0, now[:-1]]  # the end of a text comes before the next one's first word
        self.firsts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.trained = np.repeat(~self.held, self.lengths)
        self.count_now = count[now]
        keys = (number[before] << _SHIFT) | number[now]
        by_number = np.argsort(number)  # the block's words by number, whose places take fewer bits
        place = np.empty(len(number), dtype=np.int32)
        place[by_number] = np.arange(len(number), dtype=np.int32)
        self.now = place[now]
        order, begins, self.inverse = _distinct(place[before], self.now)
        first = order[begins]
        self.keys = keys[first]
        self.count_before, self.count_next = count[before[first]], self.count_now[first]
        self.context = self.keys >> _SHIFT
        self.hot = _among(self.context, hot)
        self.bucket = _dealt(np.where(self.hot, self.keys & _LOW, self.context), n_pairs)

    def answered(self, answers: list[dict], n_pairs: int, unigram: Unigram, d: np.ndarray, hot: np.ndarray, hot_sums: np.ndarray) -> None:
        """joint: the pairs' counts; rank: their places among their bucket's pairs; alone: whether they are this block's own;
        divisor: their context's; p: their probability."""
        order, at = _parts(self.bucket, n_pairs)
        size = len(self.keys)
        self.joint, self.rank, self.alone, self.divisor, alpha = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=bool), np.ones(size), np.ones(size)

        def weigh(own: np.ndarray, k: np.ndarray, sums: np.ndarray, count: np.ndarray) -> None:
            """The weights of these pairs' contexts, of which k tells the row in sums and count."""
            counted, followed = sums[:, : K + 1], sums[:, K + 1 :]
            weight, divisor = _alpha(count - _total(counted, d), unigram.mass(followed), count)
            alpha[own], self.divisor[own] = np.where(counted.any(axis=1), weight, 1.0)[k], divisor[k]

        for r in answers:
            own = order[at[r["bucket"]] : at[r["bucket"] + 1]]
            told = unpacked(r["a"]).astype(np.int64)
            self.joint[own], self.alone[own], self.rank[own] = told - (told > 1), told == 1, unpacked(r["c"])
            own = own[~self.hot[own]]
            if len(own):
                first, k = _runs(self.context[own])
                weigh(own, k, unpacked(r["b"]).reshape(WIDE, len(first)).T.astype(np.int64), self.count_before[own[first]])
        own = np.flatnonzero(self.hot)
        if len(own):
            first, k = _runs(self.context[own])
            weigh(own, k, hot_sums[np.searchsorted(hot, self.context[own[first]])], self.count_before[own[first]])
        self.p = np.where(self.joint > 0, _discounted(self.joint, d) / np.maximum(self.divisor, 1), alpha * unigram(self.count_next))


#: Contexts of triples are told by their place among their bucket's seen pairs; hot ones by this and their place among those.
HOT_CONTEXT = np.uint64(1 << 40)
#: In the place of a bucket: contexts that are the block's own, and hot ones.
ALONE, SPREAD = -2, -1


class _Triples:
    """A block's runs of three words that may have been seen, and their contexts, the pairs that were."""

    def __init__(self, pairs: _Pairs, n: int, hot: np.ndarray) -> None:
        later = np.ones(len(pairs.inverse), dtype=bool)
        later[pairs.firsts] = False
        at = np.flatnonzero(later)
        at = at[pairs.joint[pairs.inverse[at - 1]] > 0]
        self.at = at  # the tokens with such a context
        # contexts in the order of their buckets and names, so that what a bucket gets rises; the block's own come first
        of = pairs.inverse[at - 1]
        there = np.zeros(len(pairs.keys), dtype=bool)
        there[of] = True
        there = np.flatnonzero(there)
        is_hot, is_alone = _among(pairs.keys[there], hot), pairs.alone[there]
        names = np.where(is_hot, HOT_CONTEXT + np.searchsorted(hot, pairs.keys[there]).astype(np.uint64), pairs.rank[there])
        bucket = np.where(is_alone, ALONE, np.where(is_hot, SPREAD, pairs.bucket[there]))
        order = _distinct(bucket - ALONE)[0]  # names rise with the keys
        place = np.empty(len(pairs.keys), dtype=np.int32)
        place[there[order]] = np.arange(len(there), dtype=np.int32)
        contexts, self.context = there[order], place[of]
        self.contexts, self.hot, self.context_bucket, self.count = names[order], is_hot[order], bucket[order], pairs.joint[contexts]
        now = pairs.inverse[at]
        seen = np.flatnonzero(pairs.joint[now] > 0)
        by_key, begins, index = _distinct(self.context[seen], pairs.now[at[seen]])
        first = by_key[begins]
        self.own = np.full(len(at), -1, dtype=np.int32)
        self.own[seen] = index
        self.words, self.of = pairs.keys[now[seen[first]]] & _LOW, self.context[seen[first]]
        self.trained = np.bincount(index, pairs.trained[at[seen]].astype(float), len(first)).astype(np.int64)
        last = now[seen[first]]  # the pair that ends each triple
        self.last, self.divisor = pairs.joint[last], np.ones(len(contexts))
        self.divisor[self.context] = pairs.divisor[now]  # of the shorter context, which all pairs that end it share
        self.bucket = np.where(self.hot[self.of], _dealt(self.words, n), self.context_bucket[self.of])
        self.n = n

    def alone(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts that are the block's own, their sums and all triples after them."""
        contexts, own = np.flatnonzero(self.context_bucket == ALONE), np.flatnonzero(self.bucket == ALONE)  # the first ones
        there = own[self.trained[own] > 0]
        return contexts, np.c_[_by_count(self.of[there], self.trained[there], len(contexts)), _by_count(self.of[there], self.last[there], len(contexts))], own

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """bucket, contexts and triples of each bucket that is asked."""
        order, at = _parts(self.bucket, self.n)
        begins = np.searchsorted(self.context_bucket, np.arange(self.n + 1))
        for k in range(self.n):
            own, contexts = order[at[k] : at[k + 1]], np.arange(begins[k], begins[k + 1])
            spread = self.of[own]
            spread = spread[self.hot[spread]]
            if len(spread):
                contexts = np.r_[np.unique(spread), contexts]  # hot ones come before all buckets'
            if len(contexts):
                yield k, contexts, own


def _answer_pairs(n_words: int, hot: np.ndarray, hot_count: float):
    """kind: model (seen pairs, counts and their contexts' sums), reply (a: counts of the asked pairs; b: sums for their
    contexts that aren't hot, in order; c: places among the seen pairs that aren't a block's own), hot (sums of a hot
    context in this bucket), often (frequent pairs), once (how many triples have a context of a block's own). Counts are
    told as 1 for a block's own pair, as one more than they are for others that were seen. The sums are _by_count of the seen pairs and of their next words: whole numbers, from which
    what a context frees and its words' shorter probabilities follow exactly."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        asked = [unpacked(x) for x in frame["keys"]]
        keys = np.concatenate(asked)
        order, begins, index = _distinct(keys >> _SHIFT, keys & _LOW)
        first = order[begins]
        keys = keys[first]
        joint = np.bincount(index, np.concatenate([unpacked(x) for x in frame["counts"]]).astype(float), len(keys)).astype(np.int64)
        nexts = np.concatenate([_untold_counts(own, x, n_words) for own, x in zip(asked, frame["nexts"])])[first]
        begins, of = _runs(keys >> _SHIFT)
        there, seen = keys[begins] >> _SHIFT, joint > 0
        sums = np.c_[_by_count(of[seen], joint[seen], len(there)), _by_count(of[seen], nexts[seen], len(there))]
        own = (joint == 1) & (np.bincount(index, minlength=len(keys)) == 1) & (hot_count > 1)
        coded, named = joint + (seen & ~own), seen & ~own
        rank = np.cumsum(named) - named
        is_hot, kept = _among(there, hot), sums.any(axis=1)
        bucket = int(frame["bucket"].iloc[0])
        rows, at = [("model", None, bucket, packed(keys[seen], rising=True), packed(coded[seen]), packed(sums[kept].T.reshape(-1)), histogram(joint).tolist())], 0
        for block, told in zip(frame["block"], asked):
            mine = index[at : at + len(told)]
            at += len(told)
            k = of[mine][_runs(told >> _SHIFT)[0]]
            rows.append(("reply", block, bucket, packed(coded[mine]), packed(sums[k[~is_hot[k]]].T.reshape(-1)), packed(rank[mine], rising=True), None))
        for k in np.flatnonzero(is_hot):
            rows.append(("hot", int(there[k]), bucket, None, None, None, sums[k].tolist()))
        rows.append(("often", None, bucket, None, None, None, keys[joint >= hot_count].view(np.int64).tolist()))
        rows.append(("once", None, bucket, None, None, None, [int((own & (keys & _LOW != END)).sum())]))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return answer


def _answer_triples(frame: pd.DataFrame) -> pd.DataFrame:
    """kind: model (contexts with the numbers of their next words; words and counts; sums), reply (a: counts of the asked
    triples; b: sums for the contexts that aren't hot), hot (sums of a hot context in this bucket; its block is its place
    among them). The sums are _by_count of the seen triples and of the pairs that end them."""
    contexts = [unpacked(x) for x in frame["contexts"]]
    sizes = [unpacked(x).astype(np.int64) for x in frame["sizes"]]
    there = np.concatenate(contexts)
    order, begins, where = _distinct(there)
    there = there[order[begins]]
    of = np.repeat(where, np.concatenate(sizes))
    words = np.concatenate([unpacked(x) for x in frame["words"]])
    order, begins, index = _distinct(of, words)
    first = order[begins]
    of, words = of[first], words[first]
    joint = np.bincount(index, np.concatenate([unpacked(x) for x in frame["counts"]]).astype(float), len(first)).astype(np.int64)
    last = np.concatenate([unpacked(x) for x in frame["lasts"]])[first].astype(np.int64)
    seen = joint > 0
    at = of[seen]
    sums = np.c_[_by_count(at, joint[seen], len(there)), _by_count(at, last[seen], len(there))]
    is_hot, bucket = there >= HOT_CONTEXT, int(frame["bucket"].iloc[0])
    kept, told = np.unique(at, return_counts=True)
    body = _press().compress(b"".join(len(x).to_bytes(8, "little") + x for x in (packed(words[seen]), packed(joint[seen]), packed(sums[kept].T.reshape(-1)))))
    rows, start, begin = [("model", None, bucket, packed(there[kept], rising=True), packed(told), body, histogram(joint).tolist())], 0, 0
    for block, own, size in zip(frame["block"], contexts, sizes):
        total = int(size.sum())
        k = where[begin : begin + len(own)]
        rows.append(("reply", block, bucket, packed(joint[index[start : start + total]]), packed(sums[k[~is_hot[k]]].T.reshape(-1)), None, None))
        begin, start = begin + len(own), start + total
    for k in np.flatnonzero(is_hot):
        rows.append(("hot", int(there[k] - HOT_CONTEXT), bucket, None, None, None, sums[k].tolist()))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _lost(d: np.ndarray) -> np.ndarray:
    """What each word seen 1 to K times loses of its count."""
    return np.arange(1, K + 1) * (1 - d[1:])


def _alpha(freed: np.ndarray, mass: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Back-off weight and divisor of contexts that were seen `count` times: what is freed of that, over the probability
    (after the shorter context) of the words not seen next. A context that frees nothing is divided by one more than its
    count instead, which frees that one."""
    divisor = np.where(freed > 0, count, count + 1).astype(float)
    freed = np.where(freed > 0, freed, 1.0)
    return freed / np.maximum(divisor, 1) / np.maximum(1 - mass, 1e-300), divisor


def _sums(rows: DataFrame, names: list[int]) -> np.ndarray:
    """The sums of the hot contexts of these names over all buckets, in their order."""
    told = rows.where("kind = 'hot'").groupBy("block").agg(*(F.sum(F.col("stats")[k]).alias(f"n{k}") for k in range(WIDE))).collect()  # at most HOT + 1
    of = {r["block"]: [r[f"n{k}"] for k in range(WIDE)] for r in told}
    return np.array([of.get(x, [0] * WIDE) for x in names], dtype=np.int64).reshape(len(names), WIDE)


def _types(rows: DataFrame) -> np.ndarray:
    """The histogram of counts over all buckets."""
    told = rows.where("kind = 'model'").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # one for each class
    types = np.zeros(len(BINS) - 1, dtype=np.int64)
    for r in told:
        types[r["pos"]] = r["n"]
    return types


def _table(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


_SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
_SQL = {pa.int32(): "int", pa.int64(): "long", _BINARY: "binary", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}


def _schema(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {_SQL[t]}" for c, t in columns.items())


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text, learned from the
    documents that aren't held out.

    Null and empty texts are their end token alone; a null doc_id counts as the empty text in the fold's hash; repeated
    rows are texts of their own, in training and scoring; without training documents every token is the unknown word,
    of probability one; an empty table gives an empty result. A text of any length is read whole.
    """
    spark = docs.sparkSession
    blocks = common.written(common.documents(docs).mapInArrow(_blocks(common.scratch(spark, "lm-files")), _MANIFEST), "lm-blocks")
    size = blocks.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "trained", "trained_texts"))).first()
    total, texts = size["trained"], size["trained_texts"]
    n_words = 1 + size["n_words"] // BUCKET_WORDS
    n_pairs = 1 + size["n_tokens"] // BUCKET_PAIRS
    hot_count = max(1.0, total / HOT)

    spread = blocks.select("block", "file", "bytes").repartition(max(1, size["n"]), "block")
    replies, runs = common.scratch(spark, "lm-replies"), common.scratch(spark, "lm-runs")
    asked = spread.mapInArrow(_ask_words(n_words), _schema(_WORD_ASK))
    answers = lambda asked, answer: asked.groupBy("bucket").applyInPandas(_filed(answer, replies), _ANSWER)
    answered = _by_kind(answers(asked, _answer_words(n_words, hot_count)), "lm-words")
    types = _types(answered) + histogram(np.array([texts]))  # the end token's
    kinds = int(types.sum())
    hot = np.array(sorted({END, *(x for r in answered.where("kind = 'hot'").select("stats").collect() for x in r["stats"])}), dtype=np.uint64)  # at most HOT + 1
    unigram = Unigram(total, types)

    # where a block and the replies to it are; small rows, so the number of tasks is given
    marks = blocks.select("block", F.lit("block").alias("kind"), F.lit(0).alias("bucket"), "file", F.lit(0).cast("long").alias("at"), "bytes")
    replied = lambda rows, kind: rows.where("kind = 'reply'").select("block", F.lit(kind).alias("kind"), "bucket", "file", "at", "bytes")
    dealt = lambda *rows: functools.reduce(DataFrame.unionByName, rows, marks).repartition(max(1, size["n"]), "block").groupBy("block")

    def pairs_of(table: pa.Table) -> tuple[int, _Pairs, dict[str, list[dict]]]:
        rows: dict[str, list[dict]] = {"block": [], "words": [], "pairs": [], "triples": []}
        for r in table.to_pylist():
            rows[r["kind"]].append(r if r["kind"] == "block" else _reply(r))
        mark = rows["block"][0]
        return mark["block"], _Pairs(_block(mark["file"], mark["bytes"]), rows["words"], n_words, n_pairs, texts, hot), rows

    def ask_pairs(table: pa.Table) -> pa.Table:
        block, pairs, _ = pairs_of(table)
        trained = np.bincount(pairs.inverse, pairs.trained.astype(float), len(pairs.keys)).astype(np.int64)
        order, at = _parts(pairs.bucket, n_pairs)
        owned = ((int(k), order[at[k] : at[k + 1]]) for k in np.flatnonzero(np.diff(at)))
        return _table([(k, block, packed(pairs.keys[own], rising=True), packed(trained[own]), _told_counts(pairs.keys[own], pairs.count_next[own], n_words)) for k, own in owned], _PAIR_ASK)

    to_words = replied(answered, "words")
    pair_rows = dealt(to_words).applyInArrow(ask_pairs, _schema(_PAIR_ASK))
    pair_answers = _by_kind(answers(pair_rows, _answer_pairs(n_words, hot, hot_count)), "lm-pairs")
    d2 = discounts(slope(_types(pair_answers)))
    hot_sums = _sums(pair_answers, hot.tolist())
    often = np.array(sorted(x % (1 << 64) for r in pair_answers.where("kind = 'often'").select("stats").collect() for x in r["stats"]), dtype=np.uint64)  # at most HOT

    def triples_of(table: pa.Table) -> tuple[int, _Pairs, _Triples, list[dict]]:
        block, pairs, rows = pairs_of(table)
        pairs.answered(rows["pairs"], n_pairs, unigram, d2, hot, hot_sums)
        return block, pairs, _Triples(pairs, n_pairs, often), rows["triples"]

    def ask_triples(table: pa.Table) -> pa.Table:
        block, _, triples, _ = triples_of(table)

        def parts() -> Iterator[tuple]:
            for k, contexts, own in triples.parts():
                sizes = np.bincount(np.searchsorted(contexts, triples.of[own]), minlength=len(contexts))
                yield k, packed(triples.contexts[contexts], rising=True), packed(sizes), packed(triples.words[own]), packed(triples.trained[own]), packed(triples.last[own])

        return _table(_runs_filed(runs, block, parts()), _TRIPLE_ASK)

    to_pairs = replied(pair_answers, "pairs")
    triple_rows = dealt(to_words, to_pairs).applyInArrow(ask_triples, _schema(_TRIPLE_ASK))
    triple_rows = triple_rows.repartition(n_pairs, "bucket")  # small rows, much work
    triple_answers = _by_kind(answers(triple_rows, _of_runs(_answer_triples, "contexts", "sizes", "words", "counts", "lasts")), "lm-triples")
    common.dropped(spark, runs)
    once = pair_answers.where("kind = 'once'").agg(F.coalesce(F.sum(F.col("stats")[0]), F.lit(0))).first()[0]
    d3 = discounts(slope(_types(triple_answers) + once * histogram(np.array([1]))))
    often_sums = _sums(triple_answers, list(range(len(often))))

    def score(table: pa.Table) -> pa.Table:
        _, pairs, triples, answers = triples_of(table)
        answer = {r["bucket"]: r for r in answers}
        joint, alpha, divisor = np.zeros(len(triples.words), dtype=np.int64), np.ones(len(triples.contexts)), np.ones(len(triples.contexts))

        def weigh(contexts: np.ndarray, sums: np.ndarray) -> None:
            counted, ended = sums[:, : K + 1], sums[:, K + 1 :]
            weight, divisor[contexts] = _alpha(triples.count[contexts] - _total(counted, d3), _total(ended, d2) / np.maximum(triples.divisor[contexts], 1), triples.count[contexts])
            alpha[contexts] = np.where(counted.any(axis=1), weight, 1.0)  # 1: no word was seen after it

        for k, contexts, own in triples.parts():
            joint[own] = unpacked(answer[k]["a"])
            cold = contexts[~triples.hot[contexts]]
            if len(cold):
                weigh(cold, unpacked(answer[k]["b"]).reshape(WIDE, len(cold)).T.astype(np.int64))
        if triples.hot.any():
            weigh(np.flatnonzero(triples.hot), often_sums[(triples.contexts[triples.hot] - HOT_CONTEXT).astype(np.int64)])
        contexts, sums, own = triples.alone()
        if len(contexts):
            joint[own] = triples.trained[own]
            weigh(contexts, sums)
        p = pairs.p[pairs.inverse]
        seen = (triples.own >= 0) & (joint[triples.own] > 0) if len(joint) else np.zeros(len(triples.at), dtype=bool)
        p[triples.at] *= alpha[triples.context]
        at, own = triples.at[seen], triples.own[seen]
        p[at] = _discounted(joint[own], d3) / divisor[triples.of[own]]
        base = np.log10((pairs.count_now + 1) / (total + 1 * (kinds + 1)))
        known = np.add.reduceat((pairs.count_now > 0).astype(np.int64), pairs.firsts)
        columns = (pairs.ids, pairs.held, pairs.lengths, known, np.full(len(known), total), np.add.reduceat(base, pairs.firsts), np.add.reduceat(np.log10(p), pairs.firsts))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCORES.values())], names=list(_SCORES))

    return dealt(to_words, to_pairs, replied(triple_answers, "triples")).applyInArrow(score, _schema(_SCORES))


def _by_kind(df: DataFrame, name: str) -> DataFrame:
    """The rows, from a table partitioned by kind: model, reply, hot, often."""
    spark = df.sparkSession
    path = common.scratch(spark, name)
    df.write.option("compression", "uncompressed").partitionBy("kind").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
