"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols (insult, threat, target, negation, reported speech, anything else). Insults and the stems
they are formed with are learned from labelled rows; the small closed classes are fixed words of four languages, verbs
with their regular endings. A transducer for each of these reads the symbols of a clause; their composition is one
machine whose step multiplies what each says about the weight of an insult (a target changes it, as do a negation before
it and reported speech) and adds what each emits (a threat with its target). How much each of them changes it is chosen
from a grid by the likelihood of the labelled rows, and stays at its default where they don't tell. A document's matched
clauses give five features that a logistic regression, fitted on other labelled rows than the lexicon, turns into a
probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: At most so many labelled rows are learned from, those with the smallest hashes of doc_id.
TRAINING_ROWS = 24_000
THRESHOLD = 0.3
HELD_OUT = (4, 2)
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCUMENTS = 4
LEAST_WEIGHT = 3.0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED = range(6)


def _inflected(stems: str, endings: str) -> str:
    """The stems with each of the endings ("-" is none)."""
    return " ".join(stem + end.replace("-", "") for stem in stems.split() for end in endings.split())


# Fixed closed-class words (English, German, French, Spanish).
FIXED = {
    THREAT: " ".join(
        (
            _inflected("kill beat destroy burn shoot punch strangle hurt", "- s ed ing"),
            _inflected("destroy burn punch", "er es"),
            "shot destroyed strangling strangled murder murders murdered murdering",
            _inflected("töt schlag verbrenn erschieß vernicht", "e st t en et te ten end"),
            "umbringen umbringe umbringt bringe um",
            _inflected("tu frapp brûl détrui égorg", "er e es ent ez ons ais ait ai era erai é"),
            _inflected("mat golpe quem destru dispar", "ar o a as an amos aré ará aba ando é ó"),
        )
    ),
    TARGET: "you your yours u they them their he she is are du dich dir dein ihr euch sie ist sind bist tu toi te vous votre ils est es sont êtes tú ti usted ustedes eres son él ella",
    NEGATION: "not no never isn't aren't nicht kein keine nie niemals ne pas jamais aucun non nunca jamás ningún",
    REPORTED: "said says say called quoted wrote claimed sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió",
}
_EDGE = "\"'“”„«»()[]{}*_,.;:!?…-"
_CLAUSE_END = (".", "!", "?", ";", "…")


@dataclass(frozen=True)
class Factors:
    """What a target, a negation and reported speech make of an insult's weight."""

    target: float = 1.25
    negation: float = 0.4
    reported: float = 0.6


#: What is tried for each factor; a factor that isn't the default must be worth this much log likelihood.
GRID = ((1.0, 1.25, 1.6), (0.1, 0.4, 0.7, 1.0), (0.2, 0.6, 1.0))
WORTH = 2.0


@dataclass
class Transducer:
    """next[state][symbol]; factor[state][symbol] on an insult's weight; emits[state][symbol]. It starts in state 0."""

    next: list[list[int]]
    factor: list[list[float]]
    emits: list[list[float]]


def _machine(states: int, step) -> Transducer:
    rows = [[step(s, a) for a in range(6)] for s in range(states)]
    return Transducer(*([[cell[k] for cell in row] for row in rows] for k in range(3)))


def grammar(factors: Factors = Factors()) -> list[Transducer]:
    """The transducers of the five pattern kinds; their steps are (next state, factor, emission)."""
    insult = _machine(1, lambda s, a: (0, 1.0 if a == INSULT else 0.0, 0.0))
    target = _machine(2, lambda s, a: (1 if a == TARGET else s, factors.target if s else 1.0, 0.0))
    threat = _machine(4, lambda s, a: (s | (a == TARGET) | 2 * (a == THREAT), 1.0, 1.0 if (s | (a == TARGET) | 2 * (a == THREAT)) == 3 != s else 0.0))
    negation = _machine(4, lambda s, a: (3 if a == NEGATION else max(0, s - 1), factors.negation if s else 1.0, 0.0))
    reported = _machine(2, lambda s, a: (1 if a == REPORTED else s, factors.reported if s else 1.0, 0.0))
    return [insult, target, threat, negation, reported]


def compose(machines: list[Transducer]) -> Transducer:
    """The machine that runs all of them at once: factors multiply, emissions add."""
    tuples = list(product(*(range(len(m.next)) for m in machines)))
    number = {t: k for k, t in enumerate(tuples)}
    return Transducer(
        [[number[tuple(m.next[s][a] for m, s in zip(machines, t))] for a in range(6)] for t in tuples],
        [[math.prod(m.factor[s][a] for m, s in zip(machines, t)) for a in range(6)] for t in tuples],
        [[sum(m.emits[s][a] for m, s in zip(machines, t)) for a in range(6)] for t in tuples],
    )


class Lexicon(dict):
    """Word to (symbol, weight, ends a clause); words are looked up in the closed classes and the learned words and stems
    when first met. Words with the same entry share it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], most: int = 400_000) -> None:
        super().__init__()
        self.words, self.stems, self.most = words, stems, most
        self.fixed = {w: symbol for symbol, ws in FIXED.items() for w in ws.split()}
        self.entries: dict[tuple[int, float, bool], tuple[int, float, bool]] = {}

    def __reduce__(self):
        return (Lexicon, (self.words, self.stems, self.most))

    def __missing__(self, token: str) -> tuple[int, float, bool]:
        if len(self) >= self.most:
            self.clear()
        word = token.strip(_EDGE)
        weight = max(self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n), 0.0)
        symbol = self.fixed.get(word, INSULT if weight else OTHER)
        found = (symbol, weight, token.rstrip("\"'“”»)]}").endswith(_CLAUSE_END))
        self[token] = found = self.entries.setdefault(found, found)
        return found


def clauses(text: str, lexicon: Lexicon) -> list[tuple[list[tuple[int, float, bool]], set[str]]]:
    """The clauses with an insult or a threat: what their words are (symbol, weight, whether it ends the clause), and
    which insults they hold."""
    tokens = text.lower().split()
    read = [lexicon[w] for w in tokens]
    hits = [k for k, x in enumerate(read) if x[0] in (INSULT, THREAT)]
    found, done = [], -1
    for hit in hits:
        if hit <= done:
            continue
        first = done = hit
        while first > 0 and not read[first - 1][2]:
            first -= 1
        while done + 1 < len(read) and not read[done][2]:
            done += 1
        found.append((read[first : done + 1], {tokens[j].strip(_EDGE) for j in range(first, done + 1) if read[j][0] == INSULT}))
    return found


def run(machine: Transducer, clause: list[tuple[int, float, bool]]) -> tuple[float, float]:
    """A clause's insult and threat scores."""
    state, insult, threat = 0, 0.0, 0.0
    for symbol, weight, _ in clause:
        insult += weight * machine.factor[state][symbol]
        threat += machine.emits[state][symbol]
        state = machine.next[state][symbol]
    return insult, threat


def described(found: list, machine: Transducer) -> tuple[float, ...]:
    """Of a document's clauses: the largest score, log of one more than their sum and than the number of different
    insults, the largest threat, and whether there is one insult only."""
    scores, different = [], set()
    for clause, insults in found:
        score = run(machine, clause)
        if any(score):
            scores.append(score)
            different |= insults
    return max((x for x, _ in scores), default=0.0), math.log1p(sum(x for x, _ in scores)), math.log1p(len(different)), max((x for _, x in scores), default=0.0), float(len(different) == 1)


DEFAULT = compose(grammar())


def features(text: str | None, lexicon: Lexicon, machine: Transducer = DEFAULT) -> tuple[float, ...]:
    return described(clauses(text or "", lexicon), machine)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of the constant and the features
    factors: Factors = Factors()

    def __post_init__(self) -> None:
        self.machine = compose(grammar(self.factors))

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], features(text, self.lexicon, self.machine)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 40, times: np.ndarray | None = None) -> np.ndarray:
    """Weights (the constant first) of a ridge logistic regression, by Newton steps; times: how often each row counts."""
    x = np.c_[np.ones(len(x)), x]
    times = np.ones(len(x)) if times is None else times
    w, n = np.zeros(x.shape[1]), max(1.0, float(times.sum()))
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (times * p * (1 - p))[:, None]) + penalty * n, x.T @ (times * (y - p)) - penalty @ w * n)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """text, label and half (0 or 1) of at most TRAINING_ROWS labelled rows outside the held-out part, one for each text
    and label, so that exact copies count once."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("label in (0, 1)").where(common.remainder(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    texts = common.documents(docs).join(F.broadcast(chosen), "doc_id")  # at most TRAINING_ROWS ids
    once = texts.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id"))
    return once.select("label", "text", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("half"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None, int]]:
    """label, text and half of a batch's rows; only one text at a time is a string of Python's."""
    for label, text, half in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
        yield label, text.as_py(), half


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems (with a star) of documents: in how many of each half and label of this task they occur."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for label, text, half in _rows(batch):
            words = {w.strip(_EDGE) for w in (text or "").lower().split()}
            for x in words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}:
                counts.setdefault(x, [0, 0, 0, 0])[2 * half + label] += 1
    names = list(counts)
    yield pa.RecordBatch.from_pydict({"x": pa.array(names, pa.string()), **{f"n{k}": pa.array([counts[x][k] for x in names], pa.int64()) for k in range(4)}})


def _lexicon(found: list, halves: tuple[int, ...], total: dict[tuple[int, int], int]) -> Lexicon:
    """The words and stems of these halves: log odds of documents with them, for those seen in enough toxic ones."""
    of = [sum(total.get((h, label), 0) for h in halves) for label in (0, 1)]
    least = min(LEAST_DOCUMENTS, max(1, of[1] // 4))
    words, stems = {}, {}
    for r in found:
        clean, toxic = (sum(r[f"n{2 * h + label}"] for h in halves) for label in (0, 1))
        w = math.log((toxic + 0.5) / (of[1] + 1)) - math.log((clean + 0.5) / (of[0] + 1))
        if toxic >= least and w >= LEAST_WEIGHT:
            if r["x"].endswith("*"):
                stems[r["x"][:-1]] = w
            else:
                words[r["x"]] = w
    return Lexicon(words, stems)


def _fitted(rows: pd.DataFrame) -> tuple[np.ndarray, float]:
    """The regression on rows of features (a to e) that occur n times, and its log likelihood."""
    x, y, n = rows[list("abcde")].to_numpy(), rows["label"].to_numpy(dtype=float), rows["n"].to_numpy(dtype=float)
    w = logistic(x, y, times=n)
    z = np.clip(w[0] + x @ w[1:], -40, 40)
    return w, float(-(n * np.logaddexp(0, np.where(y > 0, -z, z))).sum())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon from all training rows; factors and regression from each half's features under the other half's lexicon.
    Without labels of both kinds the score is the share of toxic labels, 0 if there are none."""
    rows = common.written(training_rows(docs, labels), "tox-training")
    total = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    seen = rows.select("label", "text", "half").mapInArrow(_vocabulary, "x string, n0 long, n1 long, n2 long, n3 long")
    found = seen.groupBy("x").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4))).where(F.col("n1") + F.col("n3") >= min(LEAST_DOCUMENTS, 2)).where((F.col("n1") + F.col("n3")) * 4 > F.col("n0") + F.col("n2")).collect()  # from TRAINING_ROWS texts
    crossed = {0: _lexicon(found, (1,), total), 1: _lexicon(found, (0,), total)}
    settings = [Factors(*values) for values in product(*GRID)]
    machines = [compose(grammar(x)) for x in settings]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in batches:
            for label, text, half in _rows(batch):
                read = clauses(text or "", crossed[half])
                for k, machine in enumerate(machines):
                    counted[k, label, *described(read, machine)] += 1
        columns = list(zip(*((*key, n) for key, n in counted.items()))) or [[]] * 8
        kinds = (pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["setting", "label", *"abcde", "n"])

    told = rows.select("label", "text", "half").mapInArrow(look, "setting int, label int, a double, b double, c double, d double, e double, n long")
    counted = told.groupBy("setting", "label", *"abcde").agg(F.sum("n").alias("n")).toPandas().sort_values(["setting", "label", *"abcde"])  # from TRAINING_ROWS texts
    lexicon = _lexicon(found, (0, 1), total)
    first = counted[counted["setting"] == 0]
    toxic, n = float(first.loc[first["label"] == 1, "n"].sum()), float(first["n"].sum())
    if not 0 < toxic < n:
        share = toxic / n if n else 0.0
        return Model(lexicon, np.array([math.log(max(share, 1e-17) / max(1 - share, 1e-17)), 0, 0, 0, 0, 0]))
    best = None
    for k, part in counted.groupby("setting"):
        weights, likelihood = _fitted(part)
        away = sum(a != b for a, b in zip(astuple(settings[k]), astuple(Factors())))
        worth = (round(likelihood - WORTH * away, 6), -away, -k)
        if best is None or worth > best[0]:
            best = (worth, Model(lexicon, weights, settings[k]))
    return best[1]


def score(model: Model, text: Column) -> Column:
    """The probability that a text is toxic. A batch's texts stay in Arrow and are read one at a time."""

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array((model.score(x.as_py()) for x in part), pa.float64())

    return scored(text)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts are scored as texts without a match; repeated rows get equal scores; labels that are null or
    neither 0 nor 1, or without a document, aren't learned from; an empty table gives an empty result. Texts of any
    length are read whole.
    """
    model = train(docs, labels)
    scored = common.documents(docs).select("doc_id", (common.remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
