"""Toxicity by a weighted finite-state pattern grammar.

A text is read as a string of token classes: insult, threat verb, intent, target, negation, report, quote,
conjunction, ends and filler. Four transducers say what a clause does with them: report marks what stands
in reported or quoted speech, negation rewrites a negated insult, target tells insults with a target near
them, and threat accepts intent, verb and target in order. They are composed into one machine, whose states
are tuples of theirs and whose arcs carry an outcome, so each token takes one arc.

A clause weighs what its strongest outcome weighs, and a text is toxic unless none of its clauses is (a noisy or).
Outcomes of the fixed list hold their weights whatever the labels say. Insult stems are learned from the labels;
their clauses are counted by outcome, and a logistic model of their own weighs the counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry_jobs.llm.common import dropped, shingles, text_or_empty, text_slices, written

# Fixed lists: general words of four languages.
INSULTS = """idiot idiots moron morons stupid imbecile dumbass loser losers scum trash pathetic worthless
disgusting clown fool jerk bastard asshole bitch retard retarded cretin scumbag vermin dimwit
idioten dummkopf arschloch trottel abschaum schwachkopf mistkerl wertlos erbärmlich
imbécile connard salope abruti ordure crétin débile minable
imbécil estúpido estúpida gilipollas cabrón pendejo inútil patético escoria""".split()
THREATS = """kill murder hurt destroy beat stab shoot strangle töten umbringen verletzen tuer frapper
matar golpear destruir""".split()
INTENTS = """will gonna shall going must should deserve werde werden sollte vais va vas veux voy vamos debería""".split()
TARGETS = """you your you're youre u he she they them him her his their this that these those all everyone
du dich dir dein deine ihr euch sie er tu toi ton ta vous vos il elle ils te ti eres usted ustedes él ella ellos""".split()
NEGATIONS = """not no never isn't aren't wasn't weren't don't doesn't didn't neither nor nobody without
nicht kein keine nie niemals pas jamais aucun sin nunca jamás tampoco""".split()
REPORTS = """said says say called calls wrote told claimed claims reported quoted quote alleged
sagte sagt nannte schrieb berichtete dit écrit appelé dijo dice llamó escribió""".split()

CONJUNCTIONS = """and but or so und aber oder doch et mais ou donc y e pero o sino""".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]|[\"“”«»]")
END, BREAK, QUOTE, OTHER = ".", "\n", '"', "o"
#: What the machine tells, and what a clause may be by two different insults that have no target.
OUTCOMES = ("bare insult", "targeted insult", "negated insult", "reported insult", "threat", "negated or reported threat", "heaped insults")
BARE, TARGETED, NEGATED, REPORTED, THREATENED, UNMEANT, HEAPED = range(len(OUTCOMES))
#: How surely a clause of the fixed list is toxic, by its outcome: a targeted insult, a threat or heaped insults are by themselves.
CHANCES = np.array([0.35, 0.9, 0.005, 0.005, 0.9, 0.005, 0.7])
#: What a bare insult weighs where its word has been before, in parts of itself.
AGAIN = 0.55
#: Outcomes of learned stems, and weights before any label is seen, bias first. The model stays near them without evidence.
COUNTED = (BARE, HEAPED, TARGETED, NEGATED, REPORTED)
PRIOR = np.array([-5.4, 5.5, 7.0, 6.5, 0.5, 0.5])


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass
class Lexicon:
    """Insult words and stems with weights in (0, 1]; a stem matches longer words that begin with it."""

    words: dict[str, float] = field(default_factory=lambda: {w: 1.0 for w in INSULTS})
    stems: dict[str, float] = field(default_factory=dict)
    lengths: tuple[int, ...] = ()

    def __post_init__(self):
        self.lengths = tuple(sorted({len(s) for s in self.stems}, reverse=True))
        self.classes = {w: k for k, ws in (("C", CONJUNCTIONS), ("N", NEGATIONS), ("R", REPORTS), ("T", TARGETS), ("W", INTENTS), ("K", THREATS)) for w in ws}
        self.classes |= {c: END for c in ".!?;"} | {BREAK: BREAK} | {c: QUOTE for c in '"“”«»'}

    def weight(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return next((self.stems[word[:n]] for n in self.lengths if len(word) > n and word[:n] in self.stems), 0.0)


_LISTED = frozenset(INSULTS)


class _Classes(dict):
    """Class and weight of each word met and whether it is of the fixed list, found once; emptied when large."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[str, float, bool]:
        w = self.lexicon.weight(word)
        found = ("I", w, word in _LISTED) if w > 0 else (self.lexicon.classes.get(word, OTHER), 1.0, True)
        if len(self) > 100_000:
            self.clear()
        self[word] = found
        return found


# Transducers: (state, symbol) -> (state, output). What isn't listed goes by "*"; output None keeps the symbol.
# Reported speech ends with its clause, or with a conjunction that a new subject follows; quoted speech ends
# with its quote, or with the line.
REPORT = {("", "R"): ("r", None), ("", QUOTE): ("q", None), ("q", QUOTE): ("", None), ("r", "C"): ("c", None), ("c", "T"): ("", None), ("c", "*"): ("r", None)}
REPORT |= {(q, QUOTE): ("q", None) for q in "rc"} | {(q, END): ("", None) for q in "rc"} | {(q, BREAK): ("", None) for q in "rcq"}
REPORT |= {(q, s): ("r" if q == "c" else q, out) for q in "rcq" for s, out in (("I", "x"), ("K", "k"))}
NEGATION = {(str(k), "N"): ("3", None) for k in range(4)}
NEGATION |= {(str(k), s): (str(k - 1), s.lower()) for k in (1, 2, 3) for s in "IK"}
NEGATION |= {(str(k), "*"): (str(k - 1), None) for k in (1, 2, 3)}
THREAT = {("", "W"): ("w3", None)}
THREAT |= {(f"w{k}", s): ("v3" if s == "K" else "n3", None) for k in (1, 2, 3) for s in "Kk"}
THREAT |= {(f"{p}{k}", "T"): ("", "V" if p == "v" else "v") for p in "vn" for k in (1, 2, 3)}
THREAT |= {(f"{p}{k}", "*"): (f"{p}{k - 1}" if k > 1 else "", None) for p in "wvn" for k in (1, 2, 3)}
for _machine, _start in ((NEGATION, "0"), (THREAT, "")):
    _machine |= {(q, e): (_start, None) for q in {q for q, _ in _machine} for e in (END, BREAK)}
REACH = 4  # tokens between an insult and its target, at most


def step(machine: dict, state: str, symbol: str) -> tuple[str, str]:
    state, out = machine.get((state, symbol)) or machine.get((state, "*")) or (state, None)
    return state, symbol if out is None else out


def near_target(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, int]:
    """The target machine: ((steps left after a target, the last REACH tokens that are bare insults, as bits), output, the bits now met).

    An insult with a target before it becomes J at once; bare ones before a target are named when it comes.
    """
    if symbol in (END, BREAK):
        return (0, 0), symbol, 0
    left, bare = state
    if symbol == "T":
        return (REACH, 0), symbol, bare
    hit = symbol == "I" and left > 0
    bare = (bare << 1 | (symbol == "I" and not hit)) & ((1 << REACH) - 1)
    return (max(left - 1, 0), bare), "J" if hit else symbol, 0


_COUNTED = {"I": 0, "J": 1, "i": 2, "x": 3, "V": 4, "v": 5}
class Composed(dict):
    """The composition of the four machines: (state number, symbol) -> (state number, outcome or -1, threat outcome or -1, bare insults met).

    States are tuples of the four machines' states, numbered as they are met; arcs are made when first taken.
    """

    def __init__(self):
        super().__init__()
        self.states = [("", "0", (0, 0), "")]
        self.numbers = {self.states[0]: 0}

    def __missing__(self, key: tuple[int, str]) -> tuple[int, int, int, int]:
        (report, negation, target, threat), symbol = self.states[key[0]], key[1]
        report, out = step(REPORT, report, symbol)
        negation, out = step(NEGATION, negation, out)
        target, out, met = near_target(target, out)
        threat, told = step(THREAT, threat, out)
        after = (report, negation, target, threat)
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        self[key] = arc = (self.numbers[after], _COUNTED.get(out, -1), _COUNTED[told] if told != out and told in "Vv" else -1, met)
        return arc


MACHINE = Composed()


def path(symbols: list[str]) -> list[tuple[int, int]]:
    """(token, outcome) of the hits along the machine's path over the symbols."""
    hits: list[tuple[int, int]] = []
    insults: dict[int, int] = {}
    state = 0
    for k, s in enumerate(symbols):
        state, outcome, threat, met = MACHINE[state, s]
        if outcome >= 0:
            insults[k] = len(hits)
            hits.append((k, outcome))
        if threat >= 0:
            hits.append((k, threat))
        back = 1
        while met:  # these insults were bare until their target came
            if met & 1:
                hits[insults[k - back]] = (k - back, TARGETED)
            met, back = met >> 1, back + 1
    return hits


@dataclass
class Evidence:
    """Of a text: how sure it is that no clause of the fixed list is toxic, and damped weights of the learned stems' clauses by outcome."""

    clean: float = 1.0
    stems: np.ndarray = field(default_factory=lambda: np.zeros(len(COUNTED)))

    def numbers(self) -> list[float]:
        return [self.clean, *self.stems.tolist()]


def strongest(hits: list[tuple[str, int, float]], seen: set[str]) -> tuple[int, float] | None:
    """Outcome and weight of the strongest of a clause's hits (word, outcome, weight).

    Two different bare insults are heaped; one that the text has had before weighs AGAIN times as much.
    """
    bare = {w for w, o, _ in hits if o == BARE}
    found = [(HEAPED if o == BARE and len(bare) > 1 else o, x * (AGAIN if o == BARE and len(bare) == 1 and w in seen else 1)) for w, o, x in hits]
    seen |= bare
    return max(found, key=lambda f: CHANCES[f[0]] * f[1]) if found else None


def features(text: str, classes: _Classes) -> Evidence:
    """The evidence of all clauses of the whole text, line by line."""
    out = Evidence()
    words_ = tokens(text)
    got = [classes[t] for t in words_]
    if not any(c == "I" or c == "K" for c, _, _ in got):
        return out
    seen: tuple[set[str], set[str]] = (set(), set())
    begin = 0
    for k, (c, _, _) in enumerate([*got, (BREAK, 0.0, True)]):
        if c != BREAK:
            continue
        part = got[begin:k]
        if any(c == "I" or c == "K" for c, _, _ in part):
            ends = np.cumsum([c == END for c, _, _ in part])
            clauses: dict[tuple[int, bool], list] = {}
            for j, outcome in path([c for c, _, _ in part]):
                clauses.setdefault((int(ends[j]), part[j][2]), []).append((words_[begin + j], outcome, part[j][1]))
            for (_, listed), hits in sorted(clauses.items()):
                best = strongest(hits, seen[listed])
                if best and listed:
                    out.clean *= 1 - CHANCES[best[0]] * best[1]
                elif best:
                    out.stems[COUNTED.index(best[0])] += best[1]
        begin = k + 1
    out.stems = np.log1p(out.stems)
    return out


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic weights by Newton steps, held near the prior."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


STEM_LENGTHS = range(3, 9)


@dataclass(frozen=True)
class Settings:
    """How many times as common in toxic rows a term must be, the odds from which it has full weight, and whether
    a chosen stem rules its own beginnings out. Chosen by cross_validated() on training rows only."""

    least_odds: float = 8.0
    full_odds: float = 20.0
    one_stem: bool = True


def terms(text: str) -> set[str]:
    """Words of at least three letters (=word) and their proper beginnings (stem*)."""
    ws = {w for w in tokens(text) if len(w) > 2}
    return {"=" + w for w in ws} | {w[:n] + "*" for w in ws for n in STEM_LENGTHS if len(w) > n}


def family(texts: pa.Array) -> pa.Array:
    """The smallest shingle hash of each text: near copies mostly share it."""
    out = np.zeros(len(texts), np.uint64)
    for first, data, offsets in text_slices(texts):
        rows, hashes = shingles(data, offsets, 5)
        least = np.full(len(offsets) - 1, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, rows, hashes)
        out[first : first + len(least)] = least
    return pa.array(out.view(np.int64))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, settings: Settings = Settings()) -> Lexicon:
    """The fixed list without words that clean rows use, and terms that explain the toxic rows.

    Terms are taken greedily by how many toxic rows they hold that no earlier term explains, near copies
    counted once, so the other words of a copied toxic text are not learned. A term that comes to the driver
    stands in a hundredth of the toxic rows at least, so there are at most a hundred times the terms of a mean row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(t.keys() | c.keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([t[n] for n in names], pa.int64()), pa.array([c[n] for n in names], pa.int64())], names=["term", "t", "c"])
            t.clear()
            c.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                (t if toxic else c).update(terms(text.as_py()))
                if len(t) + len(c) > 100_000:
                    yield counted()
        yield counted()

    least = max(6, n_toxic // 100)
    rate = (n_toxic + 1) / (n_clean + 1)
    counts = sample.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    seeds = ["=" + w for w in INSULTS]
    odds = (F.col("t") + 0.5) / ((F.col("c") + 0.5) * F.lit(rate))
    counts = written(counts.where((F.col("t") >= least) & (odds >= settings.least_odds) | F.col("term").isin(seeds)))
    used = {r["term"][1:]: (r["t"], r["c"]) for r in counts.where(F.col("term").isin(seeds)).collect()}
    words = {}
    for w in INSULTS:
        t, c = used.get(w, (0, 0))
        p = (t / rate + 2) / (t / rate + c + 2)
        if p > 0.5:
            words[w] = p
    rows = counts.where((F.col("t") >= least) & (odds >= settings.least_odds)).orderBy("term").collect()
    stats = {r["term"]: (r["t"], r["c"]) for r in rows}
    wanted = frozenset(stats) | {"=" + w for w in words}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms(text) & wanted) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), family(batch.column(1))], names=["terms", "family"])

    left = [(set(r["terms"]), r["family"]) for r in sample.where("toxic = 1").mapInArrow(hits, "terms array<string>, family long").collect()]
    strength = {t: min(1.0, math.log((x + 0.5) / ((c + 0.5) * rate)) / math.log(settings.full_odds)) for t, (x, c) in stats.items()}
    left = [(r, kin, 0.0) for r, kin in left if not any(t[0] == "=" and t[1:] in words for t in r)]
    stems: dict[str, float] = {}
    while left:
        gain = Counter(t for t, _ in {(t, kin) for r, kin, _ in left for t in r if t in strength})
        if not gain:
            break
        term = max(gain, key=lambda t: (gain[t] * strength[t], len(t), t))
        if gain[term] < least:
            break
        w = strength.pop(term)
        for n in STEM_LENGTHS if settings.one_stem else ():  # shorter stems of this one say nothing more
            strength.pop(term.strip("=*")[:n] + "*", None)
        (words if term[0] == "=" else stems)[term[1:] if term[0] == "=" else term[:-1]] = w
        left = [x for x in ((r, kin, got + w * (term in r)) for r, kin, got in left) if x[2] < 1]
    dropped(counts)
    return Lexicon(words, stems)


def held_out(id_col) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, x: Evidence) -> float:
        stems = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[0] + x.stems @ self.weights[1:])))))
        return 1 - x.clean * (1 - stems)


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(id, text, toxic) of labelled rows outside the held-out fifth, as a written table of at most sample_rows rows."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    met = texts.join(F.broadcast(chosen), "id")  # at most sample_rows of 12 bytes
    return written(met.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, settings: Settings = Settings()) -> Model:
    """The grammar's lexicon and weights from labelled rows outside the held-out fifth.

    sample_rows bounds the labelled rows used, the first by a hash of their id. An id labelled more than once
    is toxic if any label says so; of several texts of an id one is read, by a hash. Without rows of both
    labels the fixed list and the prior weights are the model.
    """
    sample = labelled(docs, labels, sample_rows)
    model = learn_from(sample, settings)
    dropped(sample)
    return model


def cross_validated(docs: DataFrame, labels: DataFrame, tried: list[Settings], sample_rows: int = 20_000) -> list[tuple[Settings, int, int, int]]:
    """(settings, toxic rows found, missed, clean rows wrong) of each, over the four fifths that aren't held out: each is scored by what the other three teach."""
    sample = labelled(docs, labels, sample_rows)
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    out = []
    for settings in tried:
        found = missed = wrong = 0
        for k in range(1, 5):
            got = score(sample.where(fold == k), learn_from(sample.where(fold != k), settings), "id").join(sample.select(F.col("id").alias("doc_id"), "toxic"), "doc_id")
            r = got.agg(*[F.count(F.when((F.col("toxic") == t) & (F.col("predicted") == p), 1)) for t, p in ((1, 1), (1, 0), (0, 1))]).first()
            found, missed, wrong = found + r[0], missed + r[1], wrong + r[2]
        out.append((settings, found, missed, wrong))
    dropped(sample)
    return out


def learn_from(sample: DataFrame, settings: Settings) -> Model:
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model(Lexicon(), PRIOR)
    lexicon = learn_lexicon(sample.select("id", "text", "toxic"), n[1], n[0], settings)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(lexicon)
        for batch in batches:
            x = [features(t, classes).numbers() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = sample.select("id", "text", "toxic").mapInArrow(rows, "toxic int, x array<double>").collect()  # at most sample_rows of 60 bytes
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], dtype=float)
    left = x[:, 0] > 0.5  # what the fixed list decides teaches nothing about the stems
    return Model(lexicon, fit(x[left, 1:], y[left]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    Null and empty texts have the score of a text without matches. A null id isn't held out; repeated
    rows have equal scores; an empty table gives an empty result; a text of any length is read whole, in memory
    of some ten times its size; other columns are not read. Rows never meet: no shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(model.lexicon)
        for batch in batches:
            s = [model.score(features(t.as_py(), classes)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return docs.mapInArrow(rows, "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """The rows of docs, with their own columns, that are not predicted toxic.

    Null and empty texts stay, repeated rows go or stay together, and an empty table gives an empty one.
    """
    model = learn(docs, labels, sample_rows)

    at = docs.columns.index("text")

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(model.lexicon)
        for batch in batches:
            keep = [model.score(features(t.as_py() or "", classes)) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(toxic, docs.schema)
