"""The corpus operators against brute force, round trips and held-out labels, with edge cases."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candela.llm import common, decontam, katz, ogg, overlap, packing, pii, quality, separators, simhash, token_store, tokens, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, length long, block string, sequence_id int"  # with names that operators use


@pytest.fixture(scope="module")
def path():
    return tokens.vocabulary()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    made = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for k in range(40)]
    made += [(100, None), (101, ""), (102, "Ünïcode  zwei\n\nLines\t end "), (103, " ".join(words) * 150), (104, made[3][1]), (3, made[3][1]), (None, "no id"), (105, "one"), (106, "<|endoftext|> special")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, -1, "x", 7) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _encoded(path, text, end, plain=False):
    return tokens.Encoder(path, plain)._whole(text or "") + end.to_bytes(4, "little")


def test_encoder_pieces_are_whole_texts(path, rows):
    encoder = tokens.Encoder(path)
    texts = [t or "" for _, t in rows]
    assert encoder.encode(texts) == [encoder._whole(t) for t in texts]


def test_encoder_words_are_whole_texts(path):
    encoder = tokens.Encoder(path)
    assert encoder.by_word
    words = ["plain", "Été", "straße", "ñandú,", "end.", "what?!", "don't", "it's,", "ſhort", "ǅ", "ªº", "Żółć;", "слово", "ʰmark", "a1", "x%%%", "#tag", "&&", "naïve…", "e\u0301a", "日本", "well-known", "A" * 300, "I'll.", "µm"]
    rng = random.Random(5)
    texts = [rng.choice((" ", "\n")).join(rng.choice(words) for _ in range(40)).replace(" ", "\n", k % 4) for k in range(60)] + words
    assert encoder.encode(texts) == [encoder._whole(t) for t in texts]
    assert encoder.encode(texts[::-1]) == [encoder._whole(t) for t in texts[::-1]]


def test_packing_plan_uses_every_piece_once():
    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 50) for _ in range(500))
    made = packing.plan(dict(histogram), 50)
    used = Counter()
    for times, chosen in made:
        assert sum(n * k for n, k in chosen.items()) <= 50
        for n, k in chosen.items():
            used[n] += k * times
    assert used == histogram
    assert sum(times for times, _ in made) <= -(-sum(n * k for n, k in histogram.items()) // 50) + 2


def test_fullest_is_the_best_combination():
    rng = random.Random(2)
    for _ in range(50):
        counts = [0] + [rng.randint(0, 2) for _ in range(12)]
        first = max(k for k in range(13) if counts[k] or k == 0)
        if not first:
            continue
        rest = [n for n in range(1, 13) for _ in range(counts[n] - (n == first))]
        reach = {first}
        for n in rest:
            reach |= {x + n for x in reach if x + n <= 20}
        assert sum(n * k for n, k in packing.fullest(counts, first, 20).items()) == max(reach)


def test_packing(spark, docs, rows, nothing, path):
    got = packing.packed(docs, path, 64).collect()
    by_sequence, pieces = defaultdict(list), Counter()
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    wanted = Counter()
    for i, t in rows:
        raw = _encoded(path, t, 2)
        n = len(raw) // 4
        first, start, piece = (n - 1) % 64 + 1, 0, 0
        while start < n:
            length = first if not piece else 64
            wanted[i, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])] += 1
            start, piece = start + length, piece + 1
    assert pieces == wanted
    assert packing.packed(nothing, path).count() == 0


def test_token_store(docs, rows, nothing, path):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_store.stored(docs, path).collect()), key=lambda x: x[2])
    at, wanted = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = _encoded(path, t, 2)
        wanted.append((i is not None, i or 0, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert got == wanted
    assert token_store.stored(nothing, path).count() == 0


def test_token_files_are_closed_at_their_size(docs, rows, path, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_BYTES", 500)
    made = token_store.write(docs, path, token_store.train(docs, path), common.scratch(docs.sparkSession, "small-files")).collect()
    assert len(made) > 6 and sum(r.documents for r in made) == len(rows) and max(r.nth for r in made) > 0


def test_separators_keep_few_pieces(path):
    """The store of op4's encoder stays at its own bound, and ids don't depend on it."""
    assert separators.KEPT_PIECES < tokens.KEPT_PIECES
    small = tokens.Encoder(path, plain=True, kept=50)
    for k in range(20):
        texts = [" ".join(f"word{k}x{i % 7} {chr(97 + i)}{chr(97 + k)}bc," for i in range(12))]
        assert small.encode(texts) == [small._whole(x) for x in texts]
        assert len(small.known) <= 50 and len(small.older) <= 50
    assert tokens.encoder(path, True, 50) is not tokens.encoder(path, True)


def test_pipeline_packs_with_few_pieces(spark, docs, path, monkeypatch):
    """The packing stage's encoder has its own bound, and ids don't depend on it."""
    asked = []
    monkeypatch.setattr(packing, "packed", lambda *x, f=packing.packed, **named: asked.append(named) or f(*x, **named))
    corpus_pipeline.pack(spark, docs, SF)
    assert 0 < asked[0]["kept"] < tokens.KEPT_PIECES
    told = lambda made: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made.collect())
    assert told(packing.packed(docs, path, 64, kept=20)) == told(packing.packed(docs, path, 64))


def test_separators(docs, rows, nothing, path):
    got = Counter((r.doc_id, r.n_tokens) for r in separators.counts(docs, path, block_ids=37).collect())
    assert got == Counter((i, len(_encoded(path, t, 2, True)) // 4) for i, t in rows)
    assert separators.counts(nothing, path).count() == 0


def test_ids_over_16_bits_are_refused():
    assert separators.narrow(np.array([0, 65_535], dtype="<u4").tobytes()).tolist() == [0, 65_535]
    with pytest.raises(ValueError):
        separators.narrow(np.array([1, 65_536], dtype="<u4").tobytes())


def test_ogg_checksum_is_the_plain_crc():
    def plain(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"a", bytes(range(256)), b"OggS" * 50):
        assert ogg.checksum(data) == plain(data)


def test_ogg_round_trip_and_damage():
    samples = np.random.default_rng(0).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    data = ogg.encode(samples)
    media = ogg.decode(data)
    assert ogg.samples_of(media) == samples and not media.bad_pages and not media.lost_packets
    assert all(s.ended for s in media.streams.values())
    assert max(t for s in media.streams.values() for t in s.times if t is not None) == len(samples) / ogg.RATE
    for stream in media.streams.values():
        assert all(t is not None for t in stream.times[1:])  # every packet but the header
    ends = sorted(t for s in media.streams.values() for t in s.times[1:])
    assert ends == pytest.approx([min(k * ogg.PACKET, len(samples)) / ogg.RATE for k in range(1, len(ends) + 1)])
    starts = [k for k in range(len(data)) if data[k : k + 4] == b"OggS"]
    lost = ogg.decode(data[: starts[4]] + data[starts[5] :])
    assert lost.missing_pages == 1 and not lost.bad_pages and lost.lost_packets and len(ogg.samples_of(lost)) < len(samples)
    hurt = bytearray(data)
    hurt[len(data) // 2] ^= 1
    media = ogg.decode(bytes(hurt))
    assert media.bad_pages and len(ogg.samples_of(media)) < len(samples)


def test_ogg_stored(docs, rows, nothing):
    got = {(r.doc_id, r.payload_sha256, r.payload_bytes, r.n_bytes, r.tail_crc32) for r in ogg.stored(docs).collect()}
    wanted = set()
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        wanted.add((i, hashlib.sha256(padded).hexdigest(), len(padded), len(raw), zlib.crc32(padded[-32:])))
    assert got == wanted
    assert ogg.stored(nothing).count() == 0


def _plain_katz(rows):
    """The same model with dictionaries, evaluated recursively."""
    texts = [(i, [w.decode() for w in common.words_of(t)] + [None]) for i, t in rows]
    trained = [ws for i, ws in texts if common.remainder_of(i, 7) != 2]
    one, two, three = Counter(w for ws in trained for w in ws), Counter(), Counter()
    for ws in trained:
        two.update(zip([None, *ws[:-1]], ws))
        three.update(zip([None, *ws[:-2]], ws[:-1], ws[1:]))
    total = sum(one.values())
    types = lambda c: katz.histogram(np.array(list(c.values()), dtype=np.int64))
    unigram, d2, d3 = katz.Unigram(total, types(one)), katz.discounts(katz.slope(types(two))), katz.discounts(katz.slope(types(three)))
    follow = {2: defaultdict(dict), 3: defaultdict(dict)}
    for (h, w), c in two.items():
        follow[2][h,][w] = c
    for (u, v, w), c in three.items():
        follow[3][u, v][w] = c
    d = {2: d2, 3: d3}
    cut = lambda c, n: c * (d[n][c] if c <= katz.K else 1.0)
    memo = {}

    def weight(h):
        """alpha and divisor of a context, or None where nothing follows it."""
        if h not in memo:
            n, seen = len(h) + 1, follow[len(h) + 1].get(h, {})
            memo[h] = None
            if seen:
                count = one[h[0]] if n == 2 else two[h]
                freed = count - sum(cut(c, n) for c in seen.values())
                divisor, freed = (count, freed) if freed > 1e-12 else (count + 1, 1.0)
                memo[h] = freed / divisor / (1 - sum(p(h[1:], w) for w in seen)), divisor
        return memo[h]

    def p(h, w):
        if not h:
            return float(unigram(np.array([one[w]]))[0])
        found = weight(h)
        if not found:
            return p(h[1:], w)
        seen = follow[len(h) + 1][h]
        return cut(seen[w], len(h) + 1) / found[1] if w in seen else found[0] * p(h[1:], w)

    return texts, one, total, p


def _wanted_katz(rows):
    texts, one, total, p = _plain_katz(rows)
    wanted = []
    for i, ws in texts:
        base = sum(math.log10((one[w] + 1) / (total + 1 * (len(one) + 1))) for w in ws)
        told = sum(math.log10(p((None,) if not k else (ws[k - 2] if k > 1 else None, ws[k - 1]), w)) for k, w in enumerate(ws))
        wanted.append((i is None, i or 0, len(ws), sum(one[w] > 0 for w in ws), base, told))
    return sorted(wanted)


def _same_scores(docs, rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in katz.scores(docs).collect())
    for a, b in zip(got, _wanted_katz(rows), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)


def test_katz(docs, rows, nothing):
    _same_scores(docs, rows)
    assert katz.scores(nothing).count() == 0


@pytest.mark.parametrize(("hot", "size"), [(3, 40), (10**9, 40), (50, 1000)])
def test_katz_with_hot_contexts_blocks_and_buckets(spark, monkeypatch, hot, size):
    """Whatever is spread, on skewed words, with ids beyond doubles beside null ones."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 20 * size)
    monkeypatch.setattr(katz, "BUCKET_WORDS", 7)
    monkeypatch.setattr(katz, "BUCKET_PAIRS", size * 3)
    rng = random.Random(13)
    words = ["the", "of"] * 12 + [f"w{k}" for k in range(12)]
    made = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(30)]
    made += [(2**60 + 1, "the of the of"), (None, "the of w1"), (2**60 + 3, made[1][1]), (40, made[1][1]), (41, None), (42, "the of the unheard of")]
    _same_scores(spark.createDataFrame(made, "doc_id long, text string").repartition(2), made)


def test_katz_is_normalised(rows):
    texts, one, _, p = _plain_katz(rows)
    contexts = {(None,), ("w1",), ("never seen",), ("never", "seen"), *((ws[k], ws[k + 1]) for _, ws in texts[:6] for k in range(min(6, len(ws) - 2)))}
    for h in contexts:
        assert sum(p(h, w) for w in one) + p(h, "unknown word") == pytest.approx(1.0, abs=1e-9)


def test_discounts_come_from_the_fit():
    """Counts of counts that go as a power of the count give that power, and Katz's factors of it; those of copied texts
    (nearly all types seen twice) or of a single count give factors between 0 and 1 too, rising with the count."""
    for power in (-1.2, -2.0, -2.7):
        counts = np.repeat(np.arange(1, 400), np.rint(4e6 * np.arange(1.0, 400) ** power).astype(int))
        assert katz.slope(katz.histogram(counts)) == pytest.approx(power, abs=0.05)
        d, ratio = katz.discounts(power), lambda r: (1 + 1 / r) ** (power + 1)  # r*/r
        k = katz.K
        for r in range(1, k + 1):
            assert d[r] == pytest.approx((ratio(r) - (k + 1) ** (power + 1)) / (1 - (k + 1) ** (power + 1)))
    for counts in ([2] * 1000 + [1] * 3 + [4] * 50, [7], [1, 1, 2, 3, 9, 9], []):
        d = katz.discounts(katz.slope(katz.histogram(np.array(counts))))[1:]
        assert ((d > 0) & (d < 1)).all() and (np.diff(d) > 0).all()
    assert katz.discounts(-1.0)[1:] == pytest.approx(katz.discounts(-1.0 + 1e-6)[1:], abs=1e-5)


def test_distinct_is_unique():
    """With numbers that fit 64 bits with their places, and with such that don't."""
    rng = np.random.default_rng(5)
    for most in (1, 50, 1 << 20, 1 << 40, (1 << 62) + 1):
        a, b = rng.integers(0, most, 3000), rng.integers(0, 7, 3000)
        order, begins, place = katz._distinct(a, b)
        keys, first, inverse = np.unique(np.c_[a, b], axis=0, return_index=True, return_inverse=True)
        assert (np.c_[a, b][order[begins]] == keys).all() and (order[begins] == first).all() and (place == inverse.reshape(-1)).all()
    assert all(len(x) == 0 for x in katz._distinct(np.zeros(0, dtype=np.int64)))


def test_classes_of_counts_cover_all():
    assert katz.BINS[:11].tolist() == list(range(1, 12)) and (np.diff(katz.BINS) > 0).all()
    counts = np.array([0, 1, 5, 11, 12, 13, 1000, 2**61])
    assert katz.histogram(counts).sum() == 7 and katz.histogram(counts)[[0, 4, 10]].tolist() == [1, 1, 1]


def test_katz_tells_doubles_apart(spark):
    """A text that occurs twice is likelier, word for word, than one like it that occurs once."""
    rng = random.Random(17)
    text = lambda: " ".join(rng.choice([f"w{k}" for k in range(300)]) for _ in range(50))
    made = [(k, text()) for k in range(400)]
    made += [(1000 + k, made[k][1]) for k in range(0, 400, 20)]
    got = {r.doc_id: r.score / r.n_tokens for r in katz.scores(spark.createDataFrame(made, "doc_id long, text string")).where("NOT held_out").collect()}
    twice = [got[k] for k in range(0, 400, 20) if k in got and 1000 + k in got]
    assert min(twice) > np.quantile([v for k, v in got.items() if k < 1000 and k % 20], 0.95)


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {})
    score = lambda text: toxicity.features(text, lexicon)
    assert score("you are an idiot.")[0] > score("an idiot.")[0] > score("he said an idiot.")[0] > 0
    assert score("you are not an idiot.")[0] < score("you are an idiot.")[0]
    assert score("i will kill you.")[3] == 1.0 and score("i will kill time.")[3] == 0.0
    assert score(None) == score("") == score("all is well.")
    assert score("he killed you.")[3] == 1.0 == score("ich erschieße dich")[3]
    assert len(toxicity.compose(toxicity.grammar()).next) == 1 * 2 * 4 * 4 * 2


def test_lexicon_shares_entries():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {})
    assert lexicon["table"] is lexicon["chair"] and lexicon["idiot"] is lexicon["idiot,"]
    assert lexicon["table."] == (toxicity.OTHER, 0.0, True) and lexicon["idiot"] == (toxicity.INSULT, 5.0, False)


def test_overlap_pairs_come_in_parts(monkeypatch):
    """A batch's groups aren't all held at once, and none of their pairs is lost."""
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("component_id", pa.int64()), ("size", pa.int32()), ("block", pa.int64())]))
    groups = [[{"doc_id": 10 * g + k, "component_id": 10 * g + k, "size": 20, "block": k % 2} for k in range(4)] for g in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array([True, True, False, True, False]), pa.array(groups, kind)], ["within", "members"])
    pairs = lambda parts: sorted(zip(*(sum((x.column(k).to_pylist() for x in parts), []) for k in range(3))))
    whole = list(overlap._met(0.8)(iter([batch])))
    monkeypatch.setattr(overlap, "PAIRS", 5)
    parts = list(overlap._met(0.8)(iter([batch])))
    assert len(parts) > 3 and pairs(parts) == pairs(whole) and len(pairs(whole)) == 3 * 6 + 2 * 4


def test_composition_runs_all_machines_at_once():
    """Against the machines stepped one by one."""
    rng = random.Random(9)
    machines = toxicity.grammar(toxicity.Factors(1.5, 0.3, 0.7))
    whole = toxicity.compose(machines)
    for _ in range(200):
        clause = [(a, rng.random() * (a == toxicity.INSULT), False) for a in (rng.randrange(6) for _ in range(rng.randint(0, 12)))]
        states, insult, threat = [0] * len(machines), 0.0, 0.0
        for symbol, weight, _ in clause:
            insult += weight * math.prod(m.factor[s][symbol] for m, s in zip(machines, states))
            threat += sum(m.emits[s][symbol] for m, s in zip(machines, states))
            states = [m.next[s][symbol] for m, s in zip(machines, states)]
        assert toxicity.run(whole, clause) == pytest.approx((insult, threat))


@pytest.fixture(scope="module")
def abuse(spark):
    """Texts whose labels depend on the patterns: insults are toxic unless negated or reported, threats need a target."""
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice([f"f{k}" for k in range(80)]) for _ in range(12))
    made = [(filler(), 0) for _ in range(700)] + [(f"{filler()}. you are a blorf. {filler()}", 1) for _ in range(160)]
    made += [(f"{filler()}. this is not a blorf. {filler()}", 0) for _ in range(8)] + [(f"{filler()}. she said: blorf. {filler()}", 0) for _ in range(8)]
    made += [(f"{filler()}. i will kill you. {filler()}", 1) for _ in range(60)] + [(f"{filler()}. i will kill time. {filler()}", 0) for _ in range(60)]
    rng.shuffle(made)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(made)], "doc_id long, toxic int"), dict(enumerate(made))


def test_each_transducer_moves_held_out_scores(abuse):
    docs, labels, made = abuse
    model = toxicity.train(docs, labels)
    assert model.weights[4] > 0  # threats
    held = {k: t for k, (t, _) in made.items() if common.remainder_of(k, 4) == 2}
    whole = {k: model.score(t) for k, t in held.items()}
    neutral = toxicity._machine(1, lambda s, a: (0, 1.0, 0.0))
    for k, kind in enumerate(("insult", "target", "threat", "negation", "reported")):
        machines = toxicity.grammar(toxicity.Factors(1.6, 0.1, 0.2))
        full = toxicity.compose(machines)
        machines[k] = neutral if kind != "insult" else toxicity._machine(1, lambda s, a: (0, 0.0, 0.0))
        part = toxicity.compose(machines)
        assert any(toxicity.features(t, model.lexicon, full) != toxicity.features(t, model.lexicon, part) for t in held.values()), kind
    assert np.mean([(whole[k] >= toxicity.THRESHOLD) == (made[k][1] == 1) for k in held]) > 0.95


def test_training_is_the_plain_one(abuse):
    """Lexicon, factors and weights by loops over the rows."""
    docs, labels, made = abuse
    seen = {}
    for k, (t, y) in made.items():
        if common.remainder_of(k, 4) != 2:
            seen[t, y] = min(k, seen.get((t, y), k))
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("h")).collect()}
    rows = [(t, y, half[k]) for (t, y), k in seen.items()]
    total, counts = Counter((h, y) for _, y, h in rows), defaultdict(lambda: [0, 0, 0, 0])
    for t, y, h in rows:
        words = {w.strip(toxicity._EDGE) for w in t.lower().split()}
        for x in words | {w[:n] + "*" for w in words for n in toxicity.PREFIXES if len(w) >= n}:
            counts[x][2 * h + y] += 1
    found = [{"x": x, **{f"n{j}": n for j, n in enumerate(c)}} for x, c in counts.items()]
    crossed = {h: toxicity._lexicon(found, (1 - h,), total) for h in (0, 1)}
    best = None
    for k, values in enumerate((a, b, c) for a in toxicity.GRID[0] for b in toxicity.GRID[1] for c in toxicity.GRID[2]):
        machine = toxicity.compose(toxicity.grammar(toxicity.Factors(*values)))
        x = np.array([toxicity.features(t, crossed[h], machine) for t, _, h in rows])
        y = np.array([float(y) for _, y, _ in rows])
        w = toxicity.logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -40, 40)))
        away = sum(a != b for a, b in zip(values, (1.25, 0.4, 0.6)))
        worth = (round(float(np.log(np.where(y > 0, p, 1 - p)).sum()) - toxicity.WORTH * away, 6), -away, -k)
        best = max(best or (worth, w, values), (worth, w, values), key=lambda x: x[0])
    model = toxicity.train(docs, labels)
    assert (model.factors.target, model.factors.negation, model.factors.reported) == best[2]
    assert model.weights == pytest.approx(best[1], rel=1e-4, abs=1e-4)
    whole = toxicity._lexicon(found, (0, 1), total)
    assert model.lexicon.words == whole.words and model.lexicon.stems == whole.stems


def test_training_keeps_texts_with_equal_openings(spark):
    head = "one header of more than ten words that all of these documents share here: "
    docs = spark.createDataFrame([(k, head + f"tail {k % 20}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k in range(40)], "doc_id long, toxic int")
    kept = {k % 20 for k in range(40) if common.remainder_of(k, 4) != 2}
    assert toxicity.training_rows(docs, labels).count() == len(kept)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have too few toxic labels to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    print(len(toxic), len(clean), np.mean([s >= toxicity.THRESHOLD for s in toxic]), np.mean([s < toxicity.THRESHOLD for s in clean]))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.9
    assert np.mean([s < toxicity.THRESHOLD for s in clean]) > 0.95


def test_toxicity_edges(spark, docs, nothing, rows):
    none = spark.createDataFrame([(0, None), (None, 1), (1, 5)], "doc_id long, toxic int")
    assert all(r.score == pytest.approx(0.0, abs=1e-9) for r in toxicity.scores(docs, none).collect())
    assert toxicity.scores(docs, none).count() == len(rows)
    assert toxicity.scores(nothing, none).count() == 0


def test_quality_on_held_out_labels(spark, nothing):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.75
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scores(nothing, none).count() == 0


def test_co_training_is_the_plain_one(spark):
    """Against the same rounds with arrays, all rows at once; with repeated rows and ids, nulls, a long text, ids beyond
    doubles and clashing columns."""
    rng = random.Random(21)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "The", "end."]) for _ in range(rng.randint(20, 60)))
    bad = lambda: "\n".join(rng.choice(["CLICK!!!", "win $$$ 777", "zz zz zz"]) for _ in range(rng.randint(2, 30)))
    made = [(k, good() if k % 2 else bad(), f"src{k % 2 * 3}", "en") for k in range(600)]
    made += [(2**60 + 1, good(), "src3", None), (None, bad(), None, None), (None, None, "src0", "de"), (4, good(), "src9", "fr"), made[5], (2**60 + 3, "word " * 60_000, "src1", "en")]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in made], "doc_id long, text string, source string, lang string, label string, score double").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 240)] + [(None, 1), (7, None), (9, 4)], "doc_id long, quality int")
    got = quality.scores(docs, labels).collect()

    half = lambda rows: np.array(rows, dtype="<f2")
    content, meta = half([quality.content_view(t or "") for _, t, _, _ in made]), half([quality.metadata_view(t or "", s, x) for _, t, s, x in made])
    fold = np.array([common.remainder_of(i, 4) != 2 for i, *_ in made])
    first = {}
    for k, (i, *_) in enumerate(made):
        if i is not None and i < 240 and fold[k] and (i not in first or (content[k].tobytes(), meta[k].tobytes()) < (content[first[i]].tobytes(), meta[first[i]].tobytes())):
            first[i] = k
    at = [first[i] for i in sorted(first)]
    y = np.array([float(i % 2) for i in sorted(first)])
    own, rest = quality.parted(y)
    x = (content.astype(float), meta.astype(float))
    labelled = [v[at] for v in x]
    pool = [k for k, (i, *_) in enumerate(made) if fold[k] and i not in first]
    views = [quality.View.fit(v[own], y[own], n) for v, n in zip(labelled, quality.SQUARED)]
    for turn in range(1, quality.ROUNDS + 1):
        extra = [None, None]
        for v in (0, 1):
            bins = np.floor(np.clip(views[v].score(x[v][pool]), -quality.MOST, quality.MOST) / quality.STEP).astype(int)
            low, high = quality.cut_offs(dict(Counter(bins.tolist())), quality.GROWTH * turn, float(y[own].mean()))
            sure = np.flatnonzero((bins <= low) | (bins >= high))
            extra[1 - v] = (np.array(pool)[sure], (bins[sure] >= high).astype(float))
        views = [quality.View.fit(np.r_[v[own], w[k]], np.r_[y[own], z], n) for v, w, (k, z), n in zip(labelled, x, extra, quality.SQUARED)]
        assert all(len(k) for k, _ in extra)
    model = quality.combined(tuple(views), tuple(v[rest] for v in labelled), y[rest])
    wanted = sorted((i is None, i or 0, s) for (i, *_), s in zip(made, model.score(x)))
    told = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got)
    assert [t[:2] for t in told] == [w[:2] for w in wanted] and [t[2] for t in told] == pytest.approx([w[2] for w in wanted], abs=1e-5)


def test_cut_offs():
    assert quality.cut_offs({-5: 10, -3: 10, 0: 60, 4: 15, 6: 5}, 0.3, 0.5) == (-5, 6)
    assert quality.cut_offs({-5: 10, -3: 10, 0: 60, 4: 15, 6: 5}, 1.0, 0.5) == (-3, 4)
    assert quality.cut_offs({-1: 100}, 0.5, 0.5)[1] > 1000 > -1000 > quality.cut_offs({-1: 100}, 0.5, 0.5)[0]


KEY = "a test's key"


def _plain_feistel_text(text, own, letters=26):
    """The network on the halves of a text, with loops and hashlib."""
    half = len(text) // 2
    a, b = text[:half], text[half:]
    for k in range(1, pii.ROUNDS + 1):
        stream = hashlib.sha256(f"{own}:{k}:{b}".encode()).digest()
        moved = ""
        for j, c in enumerate(a):
            for first, n in (("0", 10), ("a", letters), ("A", 26)):
                last = {"0": "9", "a": "z", "A": "Z"}[first]
                if first <= c <= last:
                    c = chr(ord(first) + (ord(c) - ord(first) + stream[j % 32]) % n)
                    break
            moved += c
        a, b = b, moved
    return a + b


def _plain_feistel_number(x, radices, own):
    left, right = divmod(x, radices[1])
    f = lambda k, value, radix: int(hashlib.sha256(f"{own}:{k}:{value}".encode()).hexdigest()[:14], 16) % radix
    for k in range(1, pii.ROUNDS + 1):
        if k % 2:
            left = (left + f(k, right, radices[0])) % radices[0]
        else:
            right = (right + f(k, left, radices[1])) % radices[1]
    return left * radices[1] + right


def test_pseudonyms_are_the_plain_networks(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcXYZ0189-. ") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    own = pii.subkey(KEY, "test")
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", pii.permuted_text(F.col("w"), own).alias("p")).collect()
    assert all(r.p == _plain_feistel_text(r.w, own) for r in got)
    numbers = spark.range(0, 73_049, 97).select("id", pii.permuted_number(F.col("id"), pii.DAY_RADICES, own).alias("p")).collect()
    assert all(r.p == _plain_feistel_number(r.id, pii.DAY_RADICES, own) for r in numbers)
    docs = spark.createDataFrame([("mail jo.doe@mail.example.org, API_KEY: 'Ab9_xyz-77', my-Password=Tr0ub4dor! born 1999-02-28",)], "text string")
    day = _plain_feistel_number((datetime.date(1999, 2, 28) - datetime.date(1900, 1, 1)).days, pii.DAY_RADICES, pii.subkey(KEY, "date"))
    secret = lambda x: _plain_feistel_text(x, pii.subkey(KEY, "secret"))
    wanted = f"mail {_plain_feistel_text('jo.doe@mail.example', pii.subkey(KEY, 'email'))}.org, API_KEY: '{secret('Ab9_xyz-77')}', my-Password={secret('Tr0ub4dor!')} born {datetime.date(1900, 1, 1) + datetime.timedelta(days=day)}"
    assert pii.with_pseudonyms(docs, KEY).first().text == wanted
    assert pii.with_pseudonyms(docs, "another").first().text != wanted
    with pytest.raises(ValueError):
        pii.key_of(spark)
    assert pii.key_of(spark, "named") == "named"


def test_pseudonyms_edges(spark):
    long = "x" * 300_000 + " 4111 1111 1111 1111 " + "y " * 100_000
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (None, None, None), (2, "", "b")], "doc_id long, text string, key string")
    got = pii.with_pseudonyms(docs, KEY).collect()
    assert docs.columns == list(got[0].asDict()) and got[0] == got[1] and got[0].text != long and len(got[0].text) == len(long)
    assert got[0].text.startswith("x" * 300_000 + " ") and (got[2].text, got[3].text) == (None, "")
    assert pii.with_pseudonyms(docs.limit(0), KEY).count() == 0


def test_pseudonyms(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    texts = [f"a {card} b", f"again {card}.", "not a card 4111 1111 1111 1112", f"account {iban} end", "mail jo.doe@mail.example.org now", "born 1999-02-28 or 31.12.2020, not 2020-02-30", "host 10.0.0.1 and 999.1.1.1", "call +49 170 1234567", None, "", "plain words"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, m int")
    got = [r.text for r in pii.with_pseudonyms(docs, KEY).orderBy("doc_id").collect()]
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda ds: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(ds[::-1])) % 10 == 0
    assert got[0][2:-2] != card and got[0][2:-2] == got[1][6:-1] and luhn(digits(got[0])) and [c.isdigit() for c in got[0][2:-2]] == [c.isdigit() for c in card]
    assert got[2] == texts[2]
    plain = got[3][8:-4].replace(" ", "")
    assert plain != iban.replace(" ", "") and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[4] != texts[4] and got[4].endswith(".org now") and [c.isalpha() for c in got[4]] == [c.isalpha() for c in texts[4]]
    assert got[5] != texts[5] and got[5].endswith("not 2020-02-30")
    assert "10.0.0.1" not in got[6] and got[6].endswith("999.1.1.1")
    assert got[7].startswith("call +49 ") and got[7] != texts[7]
    assert got[8:] == [None, "", "plain words"]
    assert "PythonUDF" not in pii.with_pseudonyms(docs, KEY)._jdf.queryExecution().toString()


def test_pseudonyms_are_permutations(spark):
    numbers = spark.range(17 * 23).select(pii.permuted_number(F.col("id"), (17, 23), "test").alias("p"))
    assert sorted(r.p for r in numbers.collect()) == list(range(17 * 23))
    texts = spark.range(1000).select(pii.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), "test").alias("p"))
    assert sorted(r.p for r in texts.collect()) == [f"{k:03d}" for k in range(1000)]


def _plain_fingerprint(text):
    import xxhash

    words = common.words_of(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_overlap(a, b):
    """Whether four fifths of all different runs of five words are in both texts."""
    runs = lambda t: {tuple(ws[k : k + 5]) for ws in [t.lower().split()] if ws for k in range(max(1, len(ws) - 4))}
    a, b = runs(a or ""), runs(b or "")
    return len(a & b) >= 0.8 * len(a | b) > 0


@pytest.fixture(scope="module")
def families():
    """Texts, some with copies in which a few words are changed, and one large family."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for family in range(60):
        text = [rng.choice(words) for _ in range(rng.choice((60, 200, 500)))]
        copies = 80 if family == 0 else rng.choice((0, 1, 1, 3))
        rows.append(" ".join(text))
        for _ in range(copies):
            changed = list(text)
            for k in rng.sample(range(len(text)), max(1, len(text) // 60)):
                changed[k] = rng.choice(words)
            rows.append(" ".join(changed))
    rows += ["a b", "a b", "", "common words " * 200, "common words " * 201]
    return list(enumerate(rows))


def test_overlap_joins_classes(spark, families):
    """Every verified link is one by brute force, and nearly all near copies are in the class that brute force gives."""
    root = {i: i for i, _ in families}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = {i: _plain_fingerprint(t) for i, t in families}
    links = []
    for i, a in families:
        for j, b in families:
            if i < j and ((fps[i] ^ fps[j]).bit_count() <= simhash.BITS or _plain_overlap(a, b)):
                links.append((i, j))
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame([(i, t, 1, "x", 7) for i, t in families], SCHEMA).repartition(3)
    got = {r.doc_id: r.component_id for r in overlap.components(docs).collect()}
    assert got.keys() == root.keys()
    for i in got:
        assert find(got[i]) == find(i)  # nothing is linked that brute force doesn't link
    copies = [i for i in got if find(i) != i]
    assert sum(got[i] == find(i) for i in copies) >= 0.95 * len(copies)
    simple = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    assert sum(simple[i] == find(i) for i in copies) < 0.9 * len(copies)  # what the bits alone link


def test_overlap_edges(spark, nothing):
    assert overlap.components(nothing).count() == 0
    docs = spark.createDataFrame([(1, None, 1, "x", 1), (2, "", 1, "x", 1), (3, "one", 1, "x", 1), (4, "ONE", 1, "x", 1), (5, "two words", 1, "x", 1)], SCHEMA)
    assert {r.doc_id: r.component_id for r in overlap.components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


@pytest.mark.parametrize("block, sample", [(512, 1 << 15), (7, 40)])
def test_overlap_joins_all_pairs_under_hot_keys(spark, monkeypatch, block, sample):
    """300 texts that share keys, though each is like one other only: no pair is left out for want of a representative."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "SAMPLE", sample)
    rng = random.Random(31)
    base = [f"w{k}" for k in range(200)]

    def changed(text, n):
        text = list(text)
        for k in rng.sample(range(10, 190), n):
            text[k] = f"x{rng.randrange(10**9)}"
        return text

    pairs = [(a, changed(a, 3)) for a in (changed(base, 5) for _ in range(150))]
    texts = [" ".join(x) for pair in pairs for x in pair]
    runs = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in map(str.split, texts)]
    fps, root = [_plain_fingerprint(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(runs):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.BITS or len(a & runs[j]) >= 0.8 * len(a | runs[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert len({find(i) for i in root}) > 100  # most pairs are classes of their own
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in overlap.components(docs).collect()} == {i: find(i) for i in range(len(texts))}


def test_overlap_knows_all_texts_of_a_fingerprint(spark):
    """Repeats give two texts one fingerprint; what is like the second of them only is in their class, too."""
    tails = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    texts = ["w " * 400 + tails[0], "w " * 400 + tails[1], tails[1], "other words"]
    assert _plain_fingerprint(texts[0]) == _plain_fingerprint(texts[1]) and _plain_overlap(texts[1], texts[2])
    assert not _plain_overlap(texts[0], texts[2]) and (_plain_fingerprint(texts[1]) ^ _plain_fingerprint(texts[2])).bit_count() > simhash.BITS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in overlap.components(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


@pytest.mark.parametrize("few", [8, 0])
def test_overlap_rows_grow_with_a_groups_texts(spark, monkeypatch, few):
    """An original's near copies beside its outliers, of classes of their own: rows in proportion to the texts, though
    nearly all pairs meet under many shingles, and the classes of brute force."""
    rng, base = random.Random(8), [f"w{k}" for k in range(150)]

    def changed(n):
        text = list(base)
        for k in rng.sample(range(30), n // 2) + rng.sample(range(30, 150), n - n // 2):
            text[k] = f"x{rng.randrange(10**9)}"
        return text

    texts = [changed(2) for _ in range(120)] + [changed(16) for _ in range(120)]
    texts += [[*x[:60], "y", *x[61:]] for x in texts[-4:]] + [[f"z{k}" for k in range(40)], ["one"]]
    runs = [{tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} for ws in texts]
    root, fps = list(range(len(texts))), [_plain_fingerprint(" ".join(x)) for x in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(runs):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.BITS or len(a & runs[j]) >= 0.8 * len(a | runs[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert 100 < len({find(i) for i in root}) < 130
    made, met = spark.sparkContext.accumulator(0), overlap._met

    def counted(similarity):
        def rows(batches, told=met(similarity)):
            for batch in told(batches):
                made.add(batch.num_rows)
                yield batch

        return rows

    monkeypatch.setattr(overlap, "_met", counted)
    monkeypatch.setattr(overlap, "FEW", few, raising=False)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in overlap.components(docs).collect()} == {i: find(i) for i in range(len(texts))}
    assert made.value <= 10 * len(texts)


def test_marks_differ_no_more_than_sets():
    """Whatever their sizes; and far more in sets that share little."""
    rng = np.random.default_rng(5)
    made = lambda n: np.unique(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
    for n, m, same in [(1, 1, 0), (1, 1, 1), (60, 70, 50), (64, 80, 64), (140, 130, 120), (300, 250, 0), (500, 520, 450), (17_000, 20_000, 16_000)]:
        both = made(same)
        a, b = (np.sort(np.concatenate([both, made(x - same)])) for x in (n, m))
        marks = np.array([overlap.mark(a), overlap.mark(b), overlap.mark(a)], dtype=object)
        apart = overlap.differing(marks, np.array([0, 0, 1]), np.array([1, 2, 2])).tolist()
        assert apart[1] == 0 and apart[0] == apart[2] <= n + m - 2 * same
        odd = Counter(x % 64 for x in a.tolist())
        assert overlap.folded(overlap.mark(a), 8).tolist() == [sum((odd[k] & 1) << k for k in range(64))]
        if same == 0 and n > 1:
            assert apart[0] > (n + m) / 9
    assert overlap.differing(marks, np.array([], dtype=int), np.array([], dtype=int)).tolist() == []


def test_keys_meet_their_promise(monkeypatch):
    """Sets that share four fifths of their hashes nearly always share a key, sets that share a tenth hardly ever; keys
    don't depend on how many hashes are mixed at once."""
    rng, mixers = np.random.default_rng(1), overlap._mixers()
    made = lambda n: np.unique(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
    met = {0.8: 0, 0.1: 0}
    for share in met:
        for _ in range(150):
            both, rest = made(int(300 * share)), [made(int(300 * (1 - share) / 2)) for _ in range(2)]
            a, b = (set(overlap.keys(np.concatenate([both, x]), mixers)) for x in rest)
            met[share] += bool(a & b)
    assert met[0.8] >= 148 and met[0.1] <= 5
    some = made(1000)
    whole = overlap.keys(some, mixers)
    monkeypatch.setattr(overlap, "CHUNK", 7)
    assert overlap.keys(some, mixers) == whole and len(whole) == overlap.BANDS and overlap.keys(some[:0], mixers) == []


def _plain_classes(marks):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in marks:
        for b in marks:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {m: find(m) for m in marks}


@pytest.mark.parametrize("dense", [1, 48])
def test_simhash_links(spark, dense):
    rng = random.Random(5)
    marks = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(200):
        m = rng.choice(sorted(marks))
        for _ in range(rng.randint(1, 4)):
            m ^= 1 << rng.randrange(64)
        marks.add(m)
    wanted = _plain_classes(marks)
    table = spark.createDataFrame([(simhash._signed(m),) for m in marks], "fp long")
    got = {r.node % (1 << 64): r.root for r in simhash.classes(simhash.links(table, dense)).collect()}
    groups, other = defaultdict(set), defaultdict(set)
    for m in marks:
        groups[wanted[m]].add(m)
        other[got.get(m, ("alone", m))].add(m)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_simhash_components(docs, rows, nothing):
    marks = {t: _plain_fingerprint(t) for _, t in rows}
    of = _plain_classes(set(marks.values()))
    least = defaultdict(list)
    for i, t in rows:
        if i is not None:
            least[of[marks[t]]].append(i)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.components(docs).collect())
    assert got == Counter((i, f"{marks[t]:016x}", min(least[of[marks[t]]], default=None)) for i, t in rows)
    assert simhash.components(nothing).count() == 0


def test_decontamination_finds_all(spark):
    rng = random.Random(8)
    words = [f"t{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 25))) + "?\n" + " ".join(rng.choice(words) for _ in range(3))) for k in range(60)]
    parted = [(i, *decontam.question_and_answer(t)) for i, t in items]
    df = Counter(w for _, q, a in parted for w in set(q + a))
    index = decontam.build(items, df, len(items), sum(len(q) + len(a) for _, q, a in parted) / len(items))
    told = Counter()
    for _ in range(60):
        passage = [rng.choice(words) for _ in range(30)] + decontam.words_of(rng.choice(items)[1])[: rng.randint(2, 25)]
        terms = np.array(sorted({index.terms[w] for w in passage if w in index.terms}))
        scores = np.zeros(len(items))  # exhaustively
        for t in terms:
            for k, w in zip(index.posted[t], index.weights[t]):
                scores[k] += w
        assert dict(decontam.retrieve(index, terms, 0.4, told)) == pytest.approx({k: s for k, s in enumerate(scores) if s >= 0.4})
        told["all"] += int((scores > 0).sum())
    assert 0 < told["scored"] < told["all"] / 2 and told["skipped"] > 0  # most items with a term of the passage are never scored
    filler = [rng.choice(words) for _ in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(filler[:1500]) + " " + items[7][1] + " " + " ".join(filler[1500:])), (2, " ".join(filler)), (3, None), (4, ""), (5, items[9][1].upper()), (5, items[9][1])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, None), (99, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()) == [(1, 7), (5, 9), (5, 9)]
    assert decontam.matches(docs, bench.limit(0)).count() == 0 == decontam.matches(docs.limit(0), bench).count()


def test_decontamination_needs_question_and_answer(spark):
    question, answer = " ".join(f"q{k}" for k in range(30)) + "?", " ".join(f"a{k}" for k in range(4))
    bench = spark.createDataFrame([(1, f"{question}\n{answer}", "clash")], "item_id long, text string, doc_id string")
    texts = [f"x {question} {answer} y", f"x {question} y", f"x {answer} y", f"{' '.join(question.split()[:15])} {answer}"]
    docs = spark.createDataFrame([(k, t, "clash", None) for k, t in enumerate(texts)], "doc_id long, text string, item_id string, score double")
    assert [r.doc_id for r in decontam.matches(docs, bench).collect()] == [0]


def test_pipeline_keeps_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id: r.text for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD}
    ids = sorted(kept)
    fps, root = {i: _plain_fingerprint(kept[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= simhash.BITS or _plain_overlap(kept[i], kept[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {find(i): find(i) for i in ids}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = [decontam.shingles(sum(decontam.question_and_answer(t), [])) for _, t in items]
    clean = set()
    for i in first.values():
        there = decontam.shingles(decontam.words_of(kept[i]))
        if not any(len(w & there) >= decontam.OVERLAP * len(w) for w in wanted):
            clean.add(i)
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == clean
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_tells_rows_apart_without_ids(spark, tmp_path):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    item = " ".join(f"t{k}" for k in range(20)) + "?\nthe answer is here"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, copied = [text() for _ in range(6)], text()
    rows = [*((None, t) for t in clean[:4]), (7, clean[4]), (7, clean[5]), (None, copied), (9, copied), (8, copied), (None, f"{text()} {item}"), (7, f"{text()} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    wanted = Counter(r for r in rows if r not in ((None, copied), (9, copied)))
    assert Counter((r.doc_id, r.text) for r in once.collect()) == wanted
    left = corpus_pipeline.drop_leaks(spark, once, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(r for r in wanted.elements() if item not in r[1])


def test_pipeline_with_nulls_clashing_names_and_nothing(spark, tmp_path):
    """A column named like the rows' numbers stays what it is; null texts are one document; empty tables run through."""
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    rows = [(k, text(), 7, None) for k in range(5)] + [(10, None, 7, "x"), (11, None, 7, "x"), (None, "", 7, "x")]
    schema = "doc_id long, text string, __row long, block string"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    once = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in once.collect()) == [0, 1, 2, 3, 4, 10] and {r["__row"] for r in once.collect()} == {7}
    left = corpus_pipeline.drop_leaks(spark, common.written(once, "again"), str(tmp_path))
    assert left.columns == docs.columns and left.count() == 6
    for name, given in (("some", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        given.write.parquet(f"{folder}/documents.parquet")
        for table in ("benchmark", "labels"):
            spark.read.parquet(f"{tmp_path}/{table}.parquet").write.parquet(f"{folder}/{table}.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
        assert got == ({0, 1, 2, 3, 4, 10} if name == "some" else set())
