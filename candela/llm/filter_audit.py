"""Filter interaction audit: what each of five filters removes, in every order in which they could be applied.

A document's failures are a mask of five bits, and what an order of filters does to a document follows from its mask
alone. So documents are counted once, by part and mask (all of them, the good ones, the toxic ones: three rows of 32
numbers a part), and these histograms, stacked as rows, are multiplied by integer matrices of 32 masks by 600 columns
(120 orders of five steps), one each for kept, removed, redundant and unique outcomes.

Failing conditions: A: under 100 words; B: 100 x distinct words < 80 x words; C: over a tenth of the characters are A-Z;
D: one of `#$%&*|` occurs; E: the text is that of a smaller doc_id, in the whole table. Words are maximal runs
without ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def matrices() -> dict[str, np.ndarray]:
    """Matrices of 32 masks by 600 (order, step) columns: 1 where the step's filter meets a document of that mask with
    this outcome."""
    masks = np.arange(MASKS)[:, None]
    now = np.array([1 << FILTERS.index(f) for order in ORDERS for f in order])
    upto = np.array([sum(1 << FILTERS.index(f) for f in order[: k + 1]) for order in ORDERS for k in range(STEPS)])
    fails, earlier = masks & now != 0, masks & (upto - now) != 0
    found = {"kept": masks & upto == 0, "removed": fails & ~earlier, "redundant": fails & earlier, "unique": masks == now}
    return {name: m.astype(np.int64) for name, m in found.items()}


def content_mask(text: Column) -> Column:
    """The bits of A to D, which the text alone decides."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    conditions = (n < 100, distinct * 100 < n * 80, capitals * 100 > F.length(text) * 10, text.rlike(r"[#$%&*|]"))
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and the numbers of documents (n), of good and of toxic ones.

    Only digests of the texts are shuffled, by doc_id (to meet the labels), then by digest and kind of document. A
    group of copies arrives there as sums made before the shuffle, so its size doesn't matter.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("id"),
        # rows without an id meet no label; they are dealt by their numbers instead
        F.coalesce(docs["doc_id"].cast("long"), F.monotonically_increasing_id()).alias("deal"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        content_mask(text).alias("mask"),
    )
    is_one = lambda column: F.coalesce(F.max(labels[column] == 1), F.lit(False))
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("deal")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    marked = rows.join(marks.withColumn("known", F.lit(True)), "deal", "left")
    labelled = F.col("known") & F.col("id").isNotNull()
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = (
        marked.withColumns({x: F.coalesce(labelled & F.col(x), F.lit(False)) for x in ("good", "toxic")})
        .groupBy("deal", "id", *kind)
        .agg(F.count("*").alias("n"))
    )
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    copies = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min(named).alias("first"))
    least = copies.groupBy("digest").agg(F.min("first.id").alias("least"))
    first = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    told = copies.join(least, "digest").withColumn("again", F.col("named") - first)
    outcomes = F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("again")).alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), F.col("again").alias("n"))))
    counted = told.select("part", "good", "toxic", outcomes.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def outcomes(histogram: DataFrame) -> DataFrame:
    """The histograms of each part times the matrices: a row for each part, order and step."""
    stacked = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = matrices()
        letters = np.array([FILTERS.index(f) for order in ORDERS for f in order])
        for batch in batches:
            for part, masks in zip(batch.column("part"), batch.column("masks").to_pylist()):
                rows = np.zeros((3, MASKS), np.int64)
                for x in masks:
                    rows[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                removed = rows @ by["removed"]
                each = np.zeros(len(FILTERS), np.int64)
                np.add.at(each, letters, removed[0])
                n = len(letters)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part.as_py()] * n, pa.string()),
                        "filter_order": pa.array(np.repeat(ORDERS, STEPS).tolist()),
                        "step": pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))),
                        "kept": rows[0] @ by["kept"],
                        "removed": removed[0],
                        "redundant": rows[0] @ by["redundant"],
                        "unique_fails": rows[0] @ by["unique"],
                        "good_lost": removed[1],
                        "toxic_lost": removed[2],
                        "shapley": each[letters],
                    }
                )

    return stacked.mapInArrow(multiply, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang; null: the empty string), order and step, counts within the part.

    Null texts are empty (no words: only A fails). Rows of one doc_id are documents of their own: equal texts of the
    least doc_id don't fail E, and each row has the id's labels; of several label rows one 1 is enough. A null doc_id is
    neither smaller nor greater than any: such a row fails no E, makes none fail and has no label. Empty tables give no
    rows; further columns are left behind.
    """
    return outcomes(histograms(docs, labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT part, doc_id,
  CAST(len(words) < 100 AS INTEGER) AS a,
  CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER) AS b,
  CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INTEGER) AS c,
  CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d,
  CAST(coalesce(least < doc_id, false) AS INTEGER) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(x) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [p.x, q.x, r.x, s.x, t.x] AS fs, substr('ABCDE', p.x, 1) || substr('ABCDE', q.x, 1) || substr('ABCDE', r.x, 1) || substr('ABCDE', s.x, 1) || substr('ABCDE', t.x, 1) AS filter_order
  FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT o.*, f.x AS step, fs[f.x] AS letter FROM o, f),
g AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS now,
  len(list_filter(fs[:step - 1], lambda z: fails[z] = 1)) AS earlier, list_sum(fails) AS all_fails FROM k, h),
s AS (SELECT part, filter_order, step, letter,
  sum(CASE WHEN now = 0 AND earlier = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN now = 1 AND earlier = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN now = 1 AND earlier > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN now = 1 AND all_fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN now = 1 AND earlier = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN now = 1 AND earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""
