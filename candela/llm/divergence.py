"""Source divergence audit: how far each source's vocabulary is from each other source's of its language, and by which
terms it differs from the language as a whole.

Two passes over the texts. The first cuts them into blocks of bounded size and counts, exactly, the documents of each
language that hold a term; terms of at least LEAST documents are kept. The second builds, for each block and language,
an Aho-Corasick automaton of the kept terms that the block holds, each padded with delimiters, and counts their
occurrences a source in the block's texts. So an automaton is no larger than its block, however large the vocabulary.

Counts are sparse postings (language, term, source). A group's smoothed share p of a term is the same for all terms that
it doesn't hold, so a pair's sum over all kept terms is the sum over terms that neither holds, corrected for those
that one holds (a histogram of shares a source) and for those that both hold (products within a term's postings).

A term is a maximal run of ASCII letters and non-ASCII characters; only A-Z are lower-cased. All arithmetic is on whole
numbers.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST, SCALE, RANKS = 3, 1_000_000_000, 200
#: Counts under this, times SCALE, are longs.
LONG_COUNTS = 9_000_000_000
#: Bounds of a block: bytes of text, and bytes of terms and counts, summed over the texts that are counted at once.
BLOCK_BYTES, BLOCK_TERMS, COUNTED_BYTES = 32 << 20, 32 << 20, 4 << 20
#: Postings that are multiplied at once, and different pairs of sources held before they are passed on.
PAIRED_ROWS, HELD_PAIRS = 1 << 16, 1 << 18
_LETTER = [c >= 0x80 or chr(c).isalpha() for c in range(256)]
#: Bytes of UTF-8: A-Z lower-cased, other letters and all bytes of non-ASCII characters kept, the rest a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _LETTER[c] else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    """A text's UTF-8 with its terms between blanks."""
    return text.translate(_FOLD)


def frequencies(texts: list[bytes]) -> pa.Table:
    """term and n: how many of these folded texts hold each term."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    coded = split.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(split.offsets.to_numpy()))
    held = np.unique((text << 32) | coded.indices.to_numpy())
    found = pa.table({"term": coded.dictionary, "n": np.bincount(held & 0xFFFFFFFF, minlength=len(coded.dictionary))})
    return found.filter(pc.not_equal(found.column("term"), ""))  # what is before a first blank


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a block's folded texts of a language and source (body), and a block's number of documents of
    a language that hold a term (df)."""
    rows = docs.select(*(F.coalesce(docs[x].cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")))
    schema = "block string, lang string, source string, body binary, term binary, df long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1).compress

        def batch(block, lang, n, source=None, body=None, term=None, df=None) -> pa.RecordBatch:
            none = lambda t: pa.nulls(n, t)
            columns = [pa.array([block] * n, pa.string()), pa.array([lang] * n, pa.string()), source, body, term, df]
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([none(t) if c is None else c for c, t in zip(columns, kinds)], names=["block", "lang", "source", "body", "term", "df"])

        def made(texts: dict[tuple[str, str], list[bytes]], df: dict[str, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
            block = uuid.uuid4().hex
            for (lang, source), parts in texts.items():
                yield batch(block, lang, 1, source=pa.array([source], pa.string()), body=pa.array([press(b" ".join(parts))], pa.binary()))
            for lang, tables in df.items():
                whole = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum")]).combine_chunks()
                for k in range(0, whole.num_rows, 50_000):
                    some = whole.slice(k, 50_000).combine_chunks()
                    yield batch(block, lang, some.num_rows, term=some.column("term").combine_chunks().cast(pa.binary()), df=some.column("n_sum").combine_chunks())

        texts, df, waiting, size, late, named = defaultdict(list), defaultdict(list), defaultdict(list), 0, 0, 0

        def counted() -> int:
            """Count the terms of the texts that wait; the bytes of those terms."""
            found = {lang: frequencies(raws) for lang, raws in waiting.items()}
            for lang, table in found.items():
                df[lang].append(table)
            waiting.clear()
            return sum(table.nbytes for table in found.values())

        for rows_ in batches:
            for lang, source, text in zip(rows_.column(0).to_pylist(), rows_.column(1).to_pylist(), rows_.column(2).cast(pa.binary()).to_pylist()):
                raw = folded(text)
                texts[lang, source].append(raw)
                waiting[lang].append(raw)
                size, late = size + len(raw), late + len(raw)
                if late >= COUNTED_BYTES or size >= BLOCK_BYTES:
                    named, late = named + counted(), 0
                if size >= BLOCK_BYTES or named >= BLOCK_TERMS:
                    yield from made(texts, df)
                    texts, size, named = defaultdict(list), 0, 0
                    df.clear()
        if texts:
            counted()
            yield from made(texts, df)

    return common.written(rows.mapInArrow(cut, schema), "divergence-blocks")


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """The machine that finds each term between blanks and tells its place in the list."""
    machine = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        machine.add_word(f" {term} ", k)
    machine.make_automaton()
    return machine


def occurrences(machine: ahocorasick.Automaton, body: bytes) -> Counter:
    """Occurrences by the term's place. Bytes are read as characters, so no character is split."""
    return Counter(map(itemgetter(1), machine.iter(f" {body.decode('latin-1')} ")))


def kept_terms(cut: DataFrame) -> DataFrame:
    """block, lang, term and first: the terms of enough documents in each block that holds them; first is true in one."""
    own = Window.partitionBy("term", "lang")  # one row a block; terms first, since their first bytes tell more in a sort
    seen = cut.where("term IS NOT NULL").select("block", "lang", "term", F.sum("df").over(own).alias("df"), (F.col("block") == F.min("block").over(own)).alias("first"))
    return common.written(seen.where(F.col("df") >= LEAST).drop("df"), "divergence-kept")


def counts(cut: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term and n: occurrences of the kept terms, by an automaton for each block and language."""
    here = kept.select("block", "lang", "term")
    texts = cut.where("body IS NOT NULL").select("block", "lang", "source", "body").toDF("of_block", "lang", "source", "body")

    def recount(terms: pa.Table, bodies: pa.Table) -> pa.Table:
        by_lang = defaultdict(list)
        for lang, term in zip(terms.column("lang").to_pylist(), terms.column("term").to_pylist()):
            by_lang[lang].append(term)
        of = defaultdict(list)
        for k, lang in enumerate(bodies.column("lang").to_pylist()):
            of[lang].append(k)
        open_ = zstandard.ZstdDecompressor().decompress
        parts = []
        for lang, held in by_lang.items():
            machine, names = automaton([t.decode("latin-1") for t in held]), pa.array(held, pa.binary())
            for k in of[lang]:
                found = occurrences(machine, open_(bodies.column("body")[k].as_py()))
                n = len(found)
                parts.append(
                    pa.table(
                        {
                            "lang": pa.array([lang] * n, pa.string()),
                            "source": pa.array([bodies.column("source")[k].as_py()] * n, pa.string()),
                            "term": names.take(pa.array(list(found), pa.int64())),
                            "n": pa.array(list(found.values()), pa.int64()),
                        }
                    )
                )
        empty = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())])
        return pa.concat_tables(parts) if parts else empty.empty_table()

    found = here.groupBy("block").cogroup(texts.groupBy("of_block")).applyInArrow(recount, "lang string, source string, term binary, n long")
    return common.written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "divergence-counts")


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exactly (in decimals where a long doesn't hold the product); without a total,
    null."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    exact = F.call_function("div", wide, F.nullif(total, F.lit(0)).cast("decimal(20,0)"))
    return F.when(n < LONG_COUNTS, F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), F.nullif(total, F.lit(0)))).otherwise(exact) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): with shares of at most SCALE + 1, a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def both_held(postings: DataFrame) -> DataFrame:
    """lang, source, item, value: for the ordered pairs of sources that share terms, what these add to the sums over
    each source's own terms. postings have a term's rows next to each other in one partition."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        sums: dict[tuple[int, int], int] = {}

        def told() -> pa.RecordBatch:
            names = list(numbers)
            rows = [(names[a][0], names[a][1], names[b][1], v) for (a, b), v in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

        def add(group: np.ndarray, at: np.ndarray, p: np.ndarray, none: np.ndarray) -> None:
            """group: the term's number of each row, in ascending order."""
            step, n = 1, len(group)
            while step < n and len(i := np.flatnonzero(group[step:] == group[:-step])):
                for a, b in ((i, i + step), (i + step, i)):
                    value = _apart(p[a], p[b]) - _apart(p[a], none[b]) - _apart(none[a], p[b]) + _apart(none[a], none[b])
                    pair = at[a] * len(numbers) + at[b]
                    order = np.argsort(pair, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
                    for code, v in zip(pair[order][starts].tolist(), np.add.reduceat(value[order], starts).tolist()):
                        key = divmod(code, len(numbers))
                        sums[key] = sums.get(key, 0) + v
                step += 1

        rest: pa.Table | None = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest.num_rows >= PAIRED_ROWS:
                rest = _complete(rest, numbers, add, last=False)
                if len(sums) >= HELD_PAIRS:
                    yield told()
                    sums.clear()
        if rest is not None:
            _complete(rest, numbers, add, last=True)
        if sums:
            yield told()

    return postings.select("lang", "term", "source", "p", "none").mapInArrow(multiply, "lang string, source string, item string, value long")


def _complete(rows: pa.Table, numbers: dict, add, last: bool) -> pa.Table:
    """Pass the rows of all terms on (but for the last one's, which may go on) and return the others."""
    lang, term, source = (rows.column(x).to_pylist() for x in ("lang", "term", "source"))
    group = np.cumsum([0] + [a != b for a, b in zip(zip(lang[1:], term[1:]), zip(lang, term))])
    end = len(group) if last else int(np.searchsorted(group, group[-1]))
    if end:
        at = np.array([numbers.setdefault(key, len(numbers)) for key in zip(lang[:end], source[:end])])
        add(group[:end], at, rows.column("p").to_numpy()[:end], rows.column("none").to_numpy()[:end])
    return rows.slice(end).combine_chunks()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank. Part `pair`: every other source of the language, with the sum over all
    kept terms; part `term`: kept terms that the group holds with a greater share than its language, the first RANKS.

    Null texts, languages and sources are empty strings, and an empty string is a language or source like any other;
    repeated rows are documents of their own; groups without terms have pairs (0 each if their language keeps no term)
    and no terms; ties are ranked by the item's UTF-8 bytes; an empty table gives no rows; further columns are left
    behind. A text of any length is one text of its block.
    """
    cut = blocks(docs)
    kept = kept_terms(cut)
    counted = counts(cut, kept)
    groups = cut.where("body IS NOT NULL").select("lang", "source").distinct()
    words = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"))
    held = counted.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    totals = groups.join(words, "lang", "left").join(held, ["lang", "source"], "left").fillna(0, ["v", "held"])
    totals = common.written(totals.select("lang", "source", "v", (F.col("held") + F.col("v")).alias("total")).withColumn("none", F.coalesce(share(F.lit(0), F.col("total")), F.lit(1))), "divergence-totals")

    by_term = Window.partitionBy("term", "lang")
    of_lang = totals.groupBy("lang").agg((F.sum("total") - F.sum("v") + F.max("v")).alias("lang_total"))
    told = counted.withColumn("n_lang", F.sum("n").over(by_term)).join(totals.join(of_lang, "lang"), ["lang", "source"])
    postings = common.written(
        told.select("lang", "term", "source", share(F.col("n"), F.col("total")).alias("p"), share(F.col("n_lang"), F.col("lang_total")).alias("q"), "none"), "divergence-postings"
    )

    value = F.when(F.col("p") > F.col("q"), apart(F.col("p"), F.col("q")))
    terms = postings.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), value.alias("value")).where("value IS NOT NULL")

    left, right = totals.alias("left"), totals.alias("right")
    neither = left.join(right, F.expr("left.lang = right.lang AND left.source <> right.source")).select("left.lang", "left.source", F.col("right.source").alias("item"), (F.col("left.v") * apart(F.col("left.none"), F.col("right.none"))).alias("value"))
    other = totals.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    shares = postings.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("times")).join(other, "lang").where("source <> other")
    p, none, none_other = F.col("p"), F.col("none"), F.col("other_none")
    one = F.explode(
        F.array(
            F.struct(F.col("source"), F.col("other").alias("item"), (F.col("times") * (apart(p, none_other) - apart(none, none_other))).alias("value")),
            F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (F.col("times") * (apart(none_other, p) - apart(none_other, none))).alias("value")),
        )
    )
    either = shares.select("lang", one.alias("x")).select("lang", "x.source", "x.item", "x.value")
    both = both_held(postings.repartition("term", "lang").sortWithinPartitions("term", "lang"))
    pairs = neither.unionByName(either).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    ranking = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= RANKS)
    return pairs.withColumn("rank", F.row_number().over(ranking)).unionByName(first)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT i, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM full_ JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM full_ GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
