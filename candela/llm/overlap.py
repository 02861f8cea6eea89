"""SimHash classes joined by verified overlap: near copies that differ in more bits than SimHash's own links allow.

Texts of which four fifths of the five-word shingles are the same often differ by three to eleven bits. All such pairs
of different texts end in one class. That takes two steps, which work on a text for each set of shingles.

The first is cheap and leaves some out: texts that share a band of least hashes of their shingles are compared with two
representatives of that band only, the one that shares most keys with others (an original with its copies, which may be
less like each other) and one by hash, another for each key. It puts large groups into one class by rows in proportion
to their members.

The second finds what is left exactly: in any order of all shingles, such a pair shares one of its first, as many as may
miss and one more (the prefix). Frequent shingles come last in the order, which a bounded sample of texts decides; so the
sample moves the work, never the result. Of the others those with the least hashes come first, a few more than a prefix
needs, and these are counted exactly: shingles of one class come before those of several, and rarer ones before others.
Pairs of one class already are discarded, as are pairs that share too little of
their prefixes or differ too much in size, and the rest are verified by the exact overlap of their shingles. A frequent
shingle's texts are dealt to groups by pairs of blocks, and none is left out; each has the parities of its shingles'
hashes with it, of which two texts differ in no more than they differ in shingles, so pairs that are too far apart (those
of a large group's outliers, and texts that share a frequent line) are told where they meet and never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Shingles whose hashes are mixed at once.
CHUNK = 1 << 15
#: Texts whose shingles are counted for the order, about; a shingle of so many of them is frequent, if it is among so many.
SAMPLE, FREQUENT, KEPT = 1 << 13, 3, 1 << 17
#: Texts of a shingle that are paired in one group.
BLOCK = 512
#: Texts of a shingle that are paired without their marks: at most half as many rows each.
FEW = 8
#: Bits of the longest mark; longer texts have no more, by which fewer pairs can be told apart.
MARKED = 1 << 14
#: Rows of sets that a task holds at once.
HELD = 512
#: Pairs that a task holds at once, besides those of one group.
PAIRS = 1 << 16
#: Shingles that are counted exactly, as a multiple of those that may miss.
COUNTED = 1.75
#: Roundings of a share of a size are smaller.
SLACK = 1e-9


def shingles(text: str | None) -> np.ndarray:
    """The different hashes of a text's runs of five words (fewer words: all of them; none: nothing), in order."""
    words = common.words_of(text)
    runs = [b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in runs], dtype=np.uint64)).view(np.int64)


def _mixers() -> np.ndarray:
    """Odd numbers, by which a hash is multiplied to give another one."""
    return np.random.default_rng(simhash.SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys(hashes: np.ndarray, mixers: np.ndarray) -> list[int]:
    """A key for each band of these hashes' least mixed values; none without hashes."""
    if not len(hashes):
        return []
    least = np.full(len(mixers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), CHUNK):
        mixed = hashes[k : k + CHUNK].view(np.uint64)[:, None] * mixers[None, :]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return [simhash._signed(xxhash.xxh64_intdigest(band.tobytes(), number)) for number, band in enumerate(least.reshape(BANDS, ROWS))]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(1):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()))], ["token"])


def frequent(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's frequent shingles, ascending, and their numbers of texts; rows: how many docs has."""
    some = common.documents(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE))) == 0)
    counts = common.written(some.mapInArrow(_tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT), "overlap-frequent")
    total, least = 0, 1 << 62
    for n, tokens in counts.groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).limit(KEPT).collect():
        total += tokens
        if total > KEPT:
            break
        least = n
    table = counts.where(F.col("n") >= least).toArrow().sort_by("token")  # at most KEPT rows
    return table["token"].to_numpy(), table["n"].to_numpy()


def prefix(hashes: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, int]:
    """The first hashes (those that are counted, then others, frequent ones last) of which a set that is so similar shares
    one, and how many of them may be left out, if those are counted."""
    tokens, counts = order
    weights = np.zeros(len(hashes), dtype=np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
        weights = np.where(tokens[at] == hashes, counts[at], 0)
    counted = int(((weights == 0) & (hashes < int(min(1.0, COUNTED * (1 - similarity)) * (1 << 63)) * 2 - (1 << 63))).sum())
    wanted = int(spared(len(hashes), similarity))
    return hashes[np.lexsort((hashes, weights))[: max(wanted, counted)]], max(0, counted - wanted)


def mark(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of hashes (at least 1) with the same last bits, at least as many as hashes: two sets' marks
    differ in no more bits than the sets in hashes."""
    width = min(MARKED, max(64, 1 << (len(hashes) - 1).bit_length()))
    parities = np.bincount((hashes.view(np.uint64) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(parities.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A mark as it would be with so many bytes, as 64-bit words."""
    words = np.frombuffer(bits, dtype="<u8")
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def differing(marks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the marks of each pair differ, the longer one folded."""
    sizes = np.array([len(x) for x in marks], dtype=np.int64)
    both, told = np.minimum(sizes[i], sizes[j]), np.zeros(len(i), dtype=np.int64)
    for size in np.unique(both):
        pairs = np.flatnonzero(both == size)
        asked, at = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        table = np.stack([folded(x, size) for x in marks[asked]])
        left, right, step = at[: len(pairs)], at[len(pairs) :], max(1, 8 * PAIRS // int(size))
        for k in range(0, len(pairs), step):
            told[pairs[k : k + step]] = np.bitwise_count(table[left[k : k + step]] ^ table[right[k : k + step]]).sum(axis=1, dtype=np.int64)
    return told


def spared(size: int | np.ndarray, similarity: float) -> int | np.ndarray:
    """How long the prefix of a set of this size (at least 1) is."""
    return size - np.ceil(similarity * size - SLACK).astype(np.int64) + 1


def keyed(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """doc_id, the digest and size of its set of shingles, its bands' keys, its prefix, how many of that
    may be left out, and its mark; no row without shingles."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers()
        for part in (batch.slice(k, HELD) for batch in batches for k in range(0, batch.num_rows, HELD)):
            found = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                hashes = shingles(text.as_py())
                if len(hashes):
                    digest = simhash._signed(xxhash.xxh64_intdigest(hashes.tobytes()))
                    found.append((doc_id, digest, len(hashes), keys(hashes, mixers), *prefix(hashes, held.value, similarity), mark(hashes)))
            columns = list(zip(*found)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["doc_id", "digest", "size", "keys", "prefix", "spare", "mark"])

    return common.documents(docs).mapInArrow(rows, "doc_id long, digest long, size int, keys array<long>, prefix array<long>, spare int, mark binary")


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b (a < b): texts of different classes that share a band's key with one of them as a representative of it. nodes:
    doc_id (each once), component_id and keys."""
    dealt = common.written(nodes.select("doc_id", "component_id", F.explode("keys").alias("key")), "overlap-keys")
    # from tables, so that both sides of the joins are shuffled for them and a hot key's rows can be split
    sizes = common.written(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "overlap-sizes")
    shared = common.written(dealt.join(sizes.hint("merge"), "key"), "overlap-shared")
    degrees = common.written(shared.groupBy("doc_id").agg(F.sum("n").alias("degree")), "overlap-degrees")
    one, at = F.struct("doc_id", "component_id"), F.xxhash64("doc_id", "key")
    firsts = shared.join(degrees, "doc_id").groupBy("key").agg(F.max_by(one, F.struct("degree", at)).alias("hub"), F.min_by(one, at).alias("some"))
    told = shared.join(common.written(firsts, "overlap-firsts").hint("merge"), "key").select("doc_id", "component_id", F.explode(F.array("hub", "some")).alias("other"))
    apart = told.where(F.col("component_id") != F.col("other.component_id"))
    return apart.select(F.least("doc_id", "other.doc_id").alias("a"), F.greatest("doc_id", "other.doc_id").alias("b")).distinct()


def _met(similarity: float):
    """Pairs of a group's members that may be so similar (by their sizes and, if they have them, marks), and how many
    shingles their prefixes have to share for that."""

    def told(out: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["a", "b", "least"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out, held = batch.column(1), ([], [], []), 0
            doc_ids, classes, sizes, blocks, *marks = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
            ends = np.cumsum([0, *column.value_lengths().to_pylist()])
            for within, k, stop in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                i, j = np.triu_indices(stop - k, 1)
                i, j = i + k, j + k
                kept = (classes[i] != classes[j]) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - SLACK)
                if not within:
                    kept &= blocks[i] != blocks[j]
                i, j = i[kept], j[kept]
                a, b = sizes[i].astype(np.int64), sizes[j].astype(np.int64)
                wanted = np.ceil(similarity / (1 + similarity) * (a + b) - SLACK).astype(np.int64)
                if marks:
                    near = differing(marks[0][k:stop], i - k, j - k) <= a + b - 2 * wanted
                    i, j, a, b, wanted = i[near], j[near], a[near], b[near], wanted[near]
                rest = np.maximum(a - spared(a, similarity), b - spared(b, similarity))  # one of them holds all else they may share
                for x, y in zip(out, (np.minimum(doc_ids[i], doc_ids[j]), np.maximum(doc_ids[i], doc_ids[j]), wanted - rest)):
                    x.append(y)
                held += len(i)
                if held >= PAIRS:
                    yield told(out)
                    out, held = ([], [], []), 0
            yield told(out)

    return met


def remaining(nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): all pairs of texts of different classes that may be so similar. nodes: doc_id (each once),
    component_id, size, prefix, spare and mark.

    Rows grow with the texts of a shingle, and with those pairs of different classes whose marks are near enough. Pairs of
    texts of a frequent shingle are compared inside its groups' tasks, by marks only.
    """
    rows = nodes.select("doc_id", "component_id", F.explode("prefix").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component_id").alias("low"), F.max("component_id").alias("high"))
    sizes = common.written(sizes.where("low <> high").select("key", "n"), "overlap-counts")
    told = rows.select("doc_id", "key").join(sizes.hint("merge"), "key").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("told"))
    # what no other class has comes first, then the rarest: the last ones aren't in the prefix
    asked = told.join(nodes.select("doc_id", "component_id", "size", "spare"), "doc_id").where(F.size("told") > F.col("spare"))
    shared = asked.select("doc_id", "component_id", "size", F.explode(F.slice("told", F.lit(1), F.size("told") - F.col("spare"))).alias("at"))
    shared = common.written(shared.select("doc_id", "component_id", "size", "at.key", "at.n"), "overlap-met")
    member = ["doc_id", "component_id", "size", "block"]
    few = shared.where(F.col("n") <= FEW).withColumn("block", F.lit(0).cast("long")).select("key", F.struct(*member).alias("member"))
    few = few.groupBy("key").agg(F.collect_list("member").alias("members")).select(F.lit(True).alias("within"), "members")
    blocks = F.ceil(F.col("n") / BLOCK)
    many = shared.where(F.col("n") > FEW).join(nodes.select("doc_id", "mark"), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), blocks))
    others = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    many = many.withColumn("other", others).select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.struct(*member, "mark").alias("member"))
    many = many.groupBy("key", "low", "high").agg(F.collect_list("member").alias("members")).select((F.col("low") == F.col("high")).alias("within"), "members")
    pairs = [x.mapInArrow(_met(similarity), "a long, b long, least long") for x in (few, many)]
    return pairs[0].unionByName(pairs[1]).groupBy("a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([shingles(text.as_py())], pa.list_(pa.int64()))], ["doc_id", "hashes"])


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts share so much of all their shingles. Only texts of pairs are hashed."""
    asked = common.written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "overlap-asked")
    texts = common.documents(docs).join(asked, "doc_id").select("doc_id", "text")
    sets = common.written(texts.mapInArrow(_hashed, "doc_id long, hashes array<long>"), "overlap-shingles")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"{x}_hashes"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.size(F.array_intersect("a_hashes", "b_hashes"))
    return both.where((same > 0) & (same >= similarity * (F.size("a_hashes") + F.size("b_hashes") - same))).select("a", "b")


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes of pairs of texts, as links."""
    named = lambda x: nodes.select(F.col("doc_id").alias(x), F.col("component_id").alias(f"{x}_id"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _joined(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows with component_id by the links of classes."""
    roots = common.written(simhash.classes(edges), "overlap-roots").select(F.col("node").alias("component_id"), "root")
    return rows.join(roots, "component_id", "left").withColumn("component_id", F.coalesce("root", "component_id")).drop("root")


def components(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that is reached over SimHash's links and all overlaps of at least
    this similarity.

    doc_ids have to be different and not null (rows are told apart by numbers of their own in the pipeline). Null and
    empty texts have no shingles and are linked by their fingerprint alone; texts with the same set of shingles are
    linked; an empty table gives an empty result; other columns are left behind.
    """
    spark, path, before = docs.sparkSession, common.scratch(docs.sparkSession, "overlap-sets"), common.scratch(docs.sparkSession, "overlap-nodes")
    marked = common.written(simhash.components(docs).select("doc_id", "component_id"), "overlap-marks")
    sets = common.written_at(keyed(docs, frequent(docs, marked.count()), similarity), path)
    equal = common.written(sets.select("doc_id", "digest", "size").join(marked, "doc_id"), "overlap-equal")
    first = common.written(equal.groupBy("digest", "size").agg(F.min("doc_id").alias("first"), F.min("component_id").alias("to")), "overlap-first")
    edges = equal.join(first.hint("merge"), ["digest", "size"]).where("component_id <> to").select(F.col("component_id").alias("a"), F.col("to").alias("b")).distinct()
    named = first.select(F.col("first").alias("doc_id"), F.col("to").alias("component_id"))
    nodes = common.written_at(named.join(sets.select("doc_id", "size", "keys", "prefix", "spare", "mark"), "doc_id"), before)
    common.dropped(spark, path)
    edges = common.written(edges.unionByName(_linked(verified(common.written(candidates(nodes), "overlap-pairs"), docs, similarity), nodes)), "overlap-edges")
    nodes = common.written(_joined(nodes.drop("keys"), edges), "overlap-apart")
    common.dropped(spark, before)
    more = _linked(verified(common.written(remaining(nodes, similarity), "overlap-remaining"), docs, similarity), nodes)
    return _joined(marked, common.written(edges.unionByName(more), "overlap-more")).select("doc_id", "component_id")
