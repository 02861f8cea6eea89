"""Filter audit, source divergence and chat formatting against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from candela.llm import chat, divergence, filter_audit

DOCS = "doc_id long, text string, lang string, source string, part string, mask int, block string"  # with names that operators use
LABELS = "doc_id long, quality int, toxic int, digest string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [f"word{chr(97 + k)}" for k in range(26)] + ["LOUD", "ÉTÉ", "a#b", "don't"]
    made = []
    for k in range(60):
        some = words[: rng.choice((4, 20, 30))]
        text = rng.choice((" ", "\t\n", "  ")).join(rng.choice(some) for _ in range(rng.choice((0, 20, 99, 100, 101, 150))))
        made.append((k, text, rng.choice(("en", "de", None, "")), rng.choice(("s1", "s2", "s3", None))))
    distinct = [" ".join(f"{a}{b}" for b in "abcdefghijk") for a in "klmnopqrstuv"]
    made += [(100, " ".join(distinct), "en", "s1"), (101, None, "en", "s9"), (102, "", "xx", "s1"), (103, " ".join(distinct) * 30, "en", "s2"), (103, " ".join(distinct) * 30, "en", "s2")]
    made += [(200 + k, made[7][1], "en", "hot") for k in range(40)] + [(3, made[7][1], "en", "s1"), (None, made[7][1], "en", "s1"), (None, made[7][1], "en", "s1"), (None, "alone", "de", "s1")]
    return made


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 99, "y") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(8)
    return [(rng.randint(0, 250), rng.choice((0, 1, None)), rng.choice((0, 1, 1, None))) for _ in range(200)] + [(None, 1, 1)]


def _plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    found = defaultdict(Counter)
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i,
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                counts = found[lang or "", order, step]
                counts["kept"] += not gone and not fails[f]
                counts["redundant"] += gone and fails[f]
                counts["unique_fails"] += fails[f] and sum(fails.values()) == 1
                if fails[f] and not gone:
                    gone = True
                    counts["removed"] += 1
                    counts["good_lost"] += i in good
                    counts["toxic_lost"] += i in toxic
    shapley = Counter()
    for (part, order, step), counts in found.items():
        shapley[part, order[step - 1]] += counts["removed"]
    return sorted((*key, *(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[key[0], key[1][key[2] - 1]]) for key, c in found.items())


def test_filter_audit(spark, rows, labels):
    got = filter_audit.audit(_docs(spark, rows), spark.createDataFrame([(*x, "z") for x in labels], LABELS))
    assert sorted(map(tuple, got.collect())) == _plain_audit(rows, labels)


def test_filter_audit_of_nothing(spark, rows, labels):
    nobody, unlabelled = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(nobody, spark.createDataFrame([(*x, "z") for x in labels], LABELS)).count() == 0
    assert filter_audit.audit(_docs(spark, rows[:30]), unlabelled).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_outcomes_of_a_mask_add_up():
    by = filter_audit.matrices()
    removed = by["removed"].reshape(32, 120, 5)
    assert (removed.sum(axis=2).T == [mask > 0 for mask in range(32)]).all()  # once in each order, if it fails at all
    assert (by["unique"].reshape(32, 120, 5).sum(axis=2)[[1, 2, 4, 8, 16]] == 1).all()


def _plain_divergence(rows):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    df, n = Counter((lang, w) for lang, _, words in docs for w in set(words)), Counter((lang, source, w) for lang, source, words in docs for w in words)
    groups = sorted({(lang, source) for lang, source, _ in docs})
    result = []
    for lang in sorted({g[0] for g in groups}):
        kept = [w for (x, w), k in df.items() if x == lang and k >= 3]
        sources = [s for x, s in groups if x == lang]
        held = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        held[None] = {w: sum(held[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 10**9 * (c + 1) // (sum(of.values()) + len(kept)) for w, c in of.items()} for s, of in held.items()}
        for s in sources:
            pairs = [(sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept), t) for t in sources if t != s]
            terms = [((p[s][w] - p[None][w]) ** 2 // p[None][w], w) for w in kept if held[s][w] and p[s][w] > p[None][w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                result += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(result)


@pytest.mark.parametrize(("size", "paired"), [(1 << 20, 1 << 16), (300, 5)])
def test_divergence(spark, rows, monkeypatch, size, paired):
    """Whatever the blocks' bounds and the rows that are paired at once."""
    monkeypatch.setattr(divergence, "BLOCK_BYTES", size)
    monkeypatch.setattr(divergence, "COUNTED_BYTES", size // 3)
    monkeypatch.setattr(divergence, "PAIRED_ROWS", paired)
    monkeypatch.setattr(divergence, "HELD_PAIRS", paired)
    got = divergence.audit(_docs(spark, rows)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == _plain_divergence(rows)


def test_divergence_ranks_all_sources_and_200_terms(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé") for _ in range(5)) for _ in range(900)]
    rows = [(k, " ".join(rng.choices(words, range(900, 0, -1), k=150)), "en", f"s{k % 7}") for k in range(150)]
    got = sorted(map(tuple, divergence.audit(_docs(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == _plain_divergence(rows)
    assert max(r[5] for r in got if r[2] == "term") == 200


def test_shares_are_exact_beyond_longs(spark):
    counts = [(0, 7), (8_999_999_999, 10**10), (9_000_000_001, 3 * 10**10 + 1), (10**12, 10**13 + 7), (5, 0)]
    got = spark.createDataFrame(counts, "n long, total long").select(divergence.share(F.col("n"), F.col("total"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 1) // total if total else None for n, total in counts]


def test_divergence_edges(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    lonely = [(1, "one two", "en", "a"), (2, None, "en", "b"), (3, "x " * 50_000, "de", "a"), (4, "123 456", "de", "a")]
    got = sorted(map(tuple, divergence.audit(_docs(spark, lonely)).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == _plain_divergence(lonely) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_automaton_counts_neighbours_that_share_a_blank():
    machine = divergence.automaton(["ab", "b", "ÿé".encode().decode("latin-1")])
    assert divergence.occurrences(machine, divergence.folded("AB b,ab-b abb 1b2 ÿé".encode())) == {0: 2, 1: 3, 2: 1}
    assert divergence.occurrences(machine, "ÿé ÿé".encode()) == {2: 2}


CONVERSATIONS = "conv_id long, turn long, role string, text string, place int, segment string, allowed int"
CONTROLS = chat.INSTRUCTIONS.controls


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    bits = [*CONTROLS, "\\", "\\\\", "<", ">", "[", "]", "/", "s>", "INST]", " ", "\n", "$0", "héé", "😀", "word", "<\\/s>", "{}"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    made = []
    for c in range(60):
        roles = rng.choice((["user", "assistant"] * 3, ["system", "user", "assistant"], ["user", "user"], ["assistant"], ["tool", "user", None], ["user", "assistant", "system"], ["[ROLE] ", "a [/ROLE] b", "\\"]))
        made += [(c, turn, role, text()) for turn, role in enumerate(roles)]
    made += [(70, 1, "user", None), (70, 1, "assistant", "tie"), (70, None, "system", "null turn"), (None, 1, "user", "no id"), (None, 2, "assistant", "no id")]
    made += [(71, 0, "user", "same"), (71, 0, "user", "same"), (72, 0, "user", "long " * 100_000 + "</s>"), (72, 1, "assistant", "[INST]" * 50_000)]
    return made


def _by_conversation(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        of[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in of.items()}


def _in_order(turns):
    state = None
    for role, _ in turns:
        if role not in chat.INSTRUCTIONS.follows.get(state, ()):
            return False
        state = role
    return state in chat.INSTRUCTIONS.ends


def test_chat_is_read_back(spark, talks):
    formatted = chat.segments(spark.createDataFrame([(*t, 5, "x", 0) for t in talks], CONVERSATIONS).repartition(3))
    wanted, got = _by_conversation(talks), {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert got.keys() == wanted.keys()
    for c, turns in wanted.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert list(got[c].learned) == [text for role, text in turns if role == "assistant"]
        assert got[c].in_order == _in_order(turns)
    texts = [r.text for r in formatted.where("segment = 1").select("text").collect()]
    assert not any(control in t for t in texts for control in CONTROLS)


def test_chat_digests(spark, talks):
    got = {r.conv_id: r for r in chat.digests(chat.stored(chat.with_probe(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")))).collect()}
    wanted = _by_conversation([*talks, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert got.keys() == wanted.keys()
    for c, turns in wanted.items():
        learned = "".join(text for role, text in turns if role == "assistant")
        told = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == told
    assert got[-7].formatted_chars == len("[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]<s> <\\/s>[\\INST] ok [\\/INST] </s>")
    assert chat.segments(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_chat_segments_and_states(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "assistant", "a")]
    got = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place", "segment").collect()
    assert [(r.text, r.loss) for r in got[:6]] == [("[INST] ", False), ("q", False), (" [/INST]", False), ("<s> ", False), ("a", True), (" </s>", False)]
    assert [r.allowed for r in got[::3]] == [True, True, True, False]


@pytest.mark.parametrize("change", [{"controls": ("<a>", "a>b")}, {"controls": ("\\x", "<s>")}, {"turns": {"user": chat.Turn("<", "<s>")}}, {"turns": {"user": chat.Turn("<s> ", "x")}}])
def test_templates_that_could_be_misread_are_refused(change):
    made = {"turns": {"user": chat.Turn("<s> ", " </s>")}, "other": ("[R] ", " [/R] ", " [/T]"), "controls": ("<s>", "</s>", "[R]", "[/R]", "[/T]"), "follows": {None: ("user",)}}
    chat.Template(**made)
    with pytest.raises(ValueError):
        chat.Template(**made | change)
