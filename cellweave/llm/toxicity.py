"""Toxicity by a weighted finite-state pattern grammar over clauses.

Texts are cut into clauses at stops and line ends. Words are read as classes: insult (a learned stem with a weight),
threat, target, negation, reported speech, other. Five small transducers run over a clause: insult and threat emit
their weight, target remembers that someone is addressed or named, negation shields the next words, reported speech
shields the rest of the clause. Composed, they form one machine whose state is the tuple of their states; a matched
clause has the weight of its insults and threats under one of four kinds: plain, targeted, threat, shielded. A text is
scored by a logistic function of the sums per kind, so isolated words count only through the clauses they stand in.

Training uses labelled rows whose crc32 of the id, modulo 5, is not 0: a hash sample of at most ``SAMPLE_DOCS`` expected
documents (a bound of the fit, not of the scoring). Stems are prefixes of words that occur far more often in toxic
texts; they are counted inside tasks and summed by a map-side combined aggregation, and the ``MAX_STEMS`` best are
kept. Near copies would count a chance word many times, so of texts of one label with the same rarest-hash word only one is used;
unrelated texts that share this word leave the fit as well.

Defined results: a null or empty text has no clause and gets the score of a text without matches; an id that is labelled
twice counts as toxic if one label says so; without labelled rows the fixed word lists and default weights are used;
repeated rows are scored one by one; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import free_name, load, text_of, values_of, words_of
from cellweave.session import cut_lineage

FOLDS = 5
SAMPLE_DOCS = 20_000
MAX_STEMS = 2_000
STEM = range(3, 9)
SHIELDED_WORDS = 4
THRESHOLD = 0.5
MEMORY = 200_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
INSULTS = ("asshole", "bastard", "clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid",
           "trash", "vermin", "worthless", "abschaum", "arschloch", "dummkopf", "idiota", "imbécil", "connard", "crétin", "salaud")
THREATS = ("kill", "murder", "shoot", "stab", "strangle", "umbringen", "erschießen", "tuer", "tuerai", "matar", "mataré")
TARGETS = ("you", "your", "yours", "yourself", "they", "them", "their", "he", "him", "she", "her", "du", "dich", "dir", "dein",
           "ihr", "euch", "tu", "toi", "te", "ton", "vous", "votre", "ti", "usted", "ustedes", "vosotros")
NEGATIONS = ("not", "no", "never", "isn", "aren", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "called", "calls", "wrote", "quoted", "claimed", "sagte", "nannte", "schrieb", "dit", "appelé", "dijo", "llamó")
_FIXED = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
_PLAIN = (OTHER, 0.0)
_STOPS = dict.fromkeys(".!?;:\n", (STOP, 0.0))
_LISTED = {w: (k, 3.0 if k == THREAT else 0.0) for w, k in _FIXED.items()} | _STOPS
_TOKEN = re.compile(r"\w+|[.!?;:\n]")
_WORD = re.compile(r"\w+")
KINDS = ("plain", "targeted", "threat", "shielded")

# -- transducers ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over word classes: ``moves[state, class]`` gives the next state.

    ``emits`` are the classes whose weight it passes on. A class without a move leaves the state as it is, unless
    ``fades`` says that every word moves the state one down.
    """

    start: int
    moves: dict[tuple[int, int], int]
    emits: frozenset[int] = frozenset()
    fades: bool = False

    def step(self, state: int, klass: int) -> int:
        return self.moves.get((state, klass), max(0, state - 1) if self.fades else state)


class Composed:
    """The product of transducers: one step moves all of them; states met before are looked up."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.start = tuple(p.start for p in parts)
        self.emits = frozenset().union(*(p.emits for p in parts))
        self.table: dict[tuple[tuple, int], tuple] = {}

    def step(self, state: tuple, klass: int) -> tuple:
        key = (state, klass)
        if key not in self.table:
            self.table[key] = tuple(p.step(s, klass) for p, s in zip(self.parts, state))
        return self.table[key]


INSULT_FST = Transducer(0, {(0, INSULT): 1}, emits=frozenset([INSULT]))
THREAT_FST = Transducer(0, {(0, THREAT): 1}, emits=frozenset([THREAT]))
TARGET_FST = Transducer(0, {(0, TARGET): 1})
NEGATION_FST = Transducer(0, {(s, NEGATION): SHIELDED_WORDS for s in range(SHIELDED_WORDS + 1)}, fades=True)
REPORT_FST = Transducer(0, {(0, REPORT): 1})
GRAMMAR = Composed(INSULT_FST, THREAT_FST, TARGET_FST, NEGATION_FST, REPORT_FST)


def clause_weights(classes: list[int], weights: list[float]) -> tuple[float, float, float, float]:
    """Weights of one clause by kind. A threat needs a target; without one it weighs half."""
    state = GRAMMAR.start
    open_insults = shielded = threats = 0.0
    for k, w in zip(classes, weights):
        before = state
        state = GRAMMAR.step(state, k)
        if k in GRAMMAR.emits:
            if before[3] > 0 or before[4] > 0:
                shielded += w
            elif k == INSULT:
                open_insults += w
            else:
                threats += w
    targeted = state[2] > 0
    return (0.0 if targeted else open_insults), (open_insults if targeted else 0.0), threats * (1.0 if targeted else 0.5), shielded


# -- lexicon --------------------------------------------------------------------------------------------------------


class Lexicon(dict):
    """Word to (class, weight); words met are kept, up to a bounded number per worker process.

    Every entry, clause stops included, is a function of the word and the stems, so forgetting changes no result.
    """

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> tuple[int, float]:
        found = _LISTED.get(word, _PLAIN)
        for n in range(min(len(word), STEM[-1]), STEM[0] - 1, -1):
            if word[:n] in self.stems:
                found = (INSULT, self.stems[word[:n]])
                break
        if len(self) > MEMORY:
            self.clear()
        self[word] = found
        return found


_LEXICONS: dict[frozenset, Lexicon] = {}


def lexicon_of(stems: dict[str, float]) -> Lexicon:
    """One lexicon per worker process and set of stems."""
    key = frozenset(stems.items())
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(stems)
    return _LEXICONS[key]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Sums of the clause weights by kind, and the number of words in thousands."""
    read = list(map(lexicon.__getitem__, _TOKEN.findall((text or "").lower())))
    sums = [0.0, 0.0, 0.0, 0.0]
    n = len(read)
    hits = [i for i, (k, _) in enumerate(read) if k in (INSULT, THREAT)]
    stops = [i for i, (k, _) in enumerate(read) if k == STOP] if hits else []
    done = -1
    for i in hits:
        if i < done:
            continue
        at = int(np.searchsorted(stops, i))
        begin = stops[at - 1] + 1 if at else 0
        done = stops[at] if at < len(stops) else n
        clause = read[begin:done]
        for j, w in enumerate(clause_weights([k for k, _ in clause], [w for _, w in clause])):
            sums[j] += w
    return [*sums, n / 1000.0]


# -- training -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    weights: tuple[float, ...]
    bias: float

    def score(self, x: list[float]) -> float:
        z = self.bias + sum(w * v for w, v in zip(self.weights, _scaled(x)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


DEFAULT = Model({w[: STEM[-1]]: 4.0 for w in INSULTS}, (4.0, 6.0, 6.0, 0.5, 0.0, 2.0), -3.5)


def _scaled(x: list[float]) -> list[float]:
    """Sums as they are in tens, the number of words, and whether any clause matched."""
    *sums, n = x
    return [*(min(s, 200.0) / 10.0 for s in sums), min(n, 20.0), float(any(sums))]


def in_training(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, modulo the folds, is not 0. A null id is never trained on."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) != 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic): texts of a hash sample of the labelled training rows, one for each rarest-hash word."""
    known = (
        labels.where(in_training(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    long_words = F.filter(words_of(F.col("text")), lambda w: F.char_length(w) >= 8)
    key = F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    sampled = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # bounded by ``rows``
    return cut_lineage(sampled.select("text", "toxic", key.alias("key")).groupBy("key", "toxic").agg(F.min("text").alias("text")))


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic_docs, counts, words = Counter(), (Counter(), Counter()), [0, 0]
    for b in batches:
        for text, toxic in zip(values_of(b, "text"), values_of(b, "toxic")):
            found = Counter(_WORD.findall(text.lower()))
            words[toxic] += sum(found.values())
            stems: dict[str, int] = defaultdict(int)
            for w, c in found.items():
                for n in STEM:
                    if n <= len(w):
                        stems[w[:n]] += c
            for s, c in stems.items():
                counts[toxic][s] += c
            if toxic:
                toxic_docs.update(stems.keys())
    # a stem that no toxic text of this task holds still counts against the others
    keys = list(dict.fromkeys([*counts[1], *counts[0]]))
    for lo in range(0, len(keys), 50_000):
        part = keys[lo : lo + 50_000]
        columns = [
            pa.array(part, pa.string()),
            pa.array([toxic_docs[k] for k in part], pa.int64()),
            pa.array([counts[1][k] for k in part], pa.int64()),
            pa.array([counts[0][k] for k in part], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["stem", "docs", "toxic", "clean"])
    total = [pa.array([v], t) for v, t in (("", pa.string()), (0, pa.int64()), (words[1], pa.int64()), (words[0], pa.int64()))]
    yield pa.RecordBatch.from_arrays(total, names=["stem", "docs", "toxic", "clean"])


def learn_stems(sample: DataFrame, least_docs: int = 5, least_weight: float = 2.0) -> dict[str, float]:
    """Stems with the logarithm of how much more often they stand in toxic texts, longest of equal ones first."""
    counted = sample.mapInArrow(_count_stems, "stem string, docs bigint, toxic bigint, clean bigint")
    sums = cut_lineage(
        counted.groupBy("stem").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    total = sums.where("stem = ''").first()
    if total is None or not total.toxic or not total.clean:
        return {}
    ratio = F.log((F.col("toxic") + 0.5) / float(total.toxic)) - F.log((F.col("clean") + 0.5) / float(total.clean))
    found = (
        sums.where((F.col("stem") != "") & (F.col("docs") >= least_docs))
        .withColumn("weight", ratio)
        .where(F.col("weight") >= least_weight)
        .orderBy((F.col("weight") * F.col("toxic")).desc(), F.char_length("stem").desc(), "stem")
        .limit(10 * MAX_STEMS)
        .collect()
    )
    chosen: dict[str, float] = {}
    for r in found:
        if len(chosen) == MAX_STEMS:
            break
        shorter = [chosen[r.stem[:n]] for n in STEM if r.stem[:n] in chosen]
        # a longer stem stays only if it says clearly more than the one it begins with
        if any(r.weight < w + 1.0 for w in shorter) or any(c.startswith(r.stem) for c in chosen):
            continue
        chosen[r.stem] = min(float(r.weight), 6.0)
    return chosen


def _features(batches: Iterator[pa.RecordBatch], stems: dict[str, float]) -> Iterator[pa.RecordBatch]:
    lexicon = lexicon_of(stems)
    for b in batches:
        x = [features(t, lexicon) for t in values_of(b, "text")]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps; the bias is not penalised."""
    design = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], ridge * len(x) / 100.0 + 1e-6), 1e-6]
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (p - y) + penalty * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> Model:
    """Stems and weights from the labelled training rows."""
    sample = training_sample(docs.select("doc_id", text_of("text").alias("text")), labels, rows)
    learned = learn_stems(sample)
    if not learned:
        return DEFAULT
    # the fixed words stay known where the labelled texts hold too few of them to learn from
    stems = {s: w for s, w in DEFAULT.stems.items() if not any(s.startswith(k) for k in learned)} | learned
    measured = sample.mapInArrow(partial(_features, stems=stems), "x array<double>, toxic int").collect()  # bounded by ``rows``
    measured.sort(key=lambda r: (r.toxic, r.x))
    x = np.array([_scaled(r.x) for r in measured])
    weights, bias = fit_logistic(x, np.array([r.toxic for r in measured], dtype=float))
    return Model(stems, tuple(map(float, weights)), bias)


# -- scoring --------------------------------------------------------------------------------------------------------


def _score(batches: Iterator[pa.RecordBatch], model: Model, kept: list[str], out: str, text: str) -> Iterator[pa.RecordBatch]:
    lexicon = lexicon_of(model.stems)
    for b in batches:
        scores = [model.score(features(t, lexicon)) for t in values_of(b, text)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, out])
    lexicon.clear()  # the worker process lives on, for other stages


def score_texts(docs: DataFrame, model: Model, out: str = "score", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the score of every text; ``keep`` names the columns to return (all by default)."""
    kept = docs.columns if keep is None else keep
    schema = docs.select(*kept, F.lit(0.0).alias(out)).schema
    return docs.mapInArrow(partial(_score, model=model, kept=kept, out=out, text=text), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold, with their columns."""
    score = free_name(docs, "_score")
    scored = score_texts(docs, train(docs, labels), score)
    return scored.where(F.col(score) < THRESHOLD).drop(score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, load(spark, sf_dir, "labels")), keep=["doc_id"])
    # a null id is never trained on
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
