"""Toxicity by a weighted finite-state pattern grammar.

Small transducers (insult, threat, target, negation, reported speech) each read the classes of a clause's words, keep a
state, and rewrite an attack's class with a factor. One reads a clause from its end and tells attacks whose target follows;
the others are composed into one machine that reads what it writes, over the clauses in which an attack word stands; what counts is the matched clause, such as an insult at a target, and not the word alone:
a negated or quoted insult matches another pattern. A logistic model over the weights of the matched patterns gives the
score; it learns from labels how much each pattern tells.

Attack words are a short fixed list and entries (words and beginnings of words) learned from labelled rows. Learning uses
a bounded sample of ``fit_rows`` labelled rows, drawn by a hash of the id. The model is fitted on each half with entries
of the other half, so that chance entries do not flatter it; scoring uses the entries of both.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table, text_slices

#: Attack, target, negation and report words of four languages.
INSULTS = {"idiot", "moron", "stupid", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "dummkopf", "vollidiot", "abschaum", "imbécile", "crétin", "ordure", "imbécil", "estúpido", "basura"}
THREATS = {"kill", "hurt", "destroy", "beat", "punish", "töten", "vernichten", "tuer", "frapper", "matar", "golpear"}
TARGETS = {"you", "your", "yours", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "sie", "tu", "toi", "vous", "ils", "tú", "ti", "usted", "ellos"}
NEGATIONS = {"not", "never", "no", "isn't", "aren't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"}
REPORTS = {"said", "says", "called", "calls", "wrote", "claimed", "quoted", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió"}

FEATURES = ("insult", "targeted", "threat", "negated", "reported", "strongest", "density")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")


class Transducer:
    """A deterministic weighted transducer over word classes.

    ``arcs`` maps (state, class) to (next state, class written, factor); any other pair keeps state and class, at 1.
    """

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]]):
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


# A word's class: I insult, H threat, T target, N negation, R report, Q quotation mark, O other. Rewritten attack classes:
# J repeated insult, A insult at a target, B threat at a target, X negated, Y reported.
INSULT = Transducer({(0, "I"): (1, "I", 1.0), (1, "I"): (1, "J", 1.25), (0, "A"): (1, "A", 1.0), (1, "A"): (1, "A", 1.25)})
THREAT = Transducer({(0, "H"): (1, "H", 1.0), (1, "H"): (1, "H", 1.1), (0, "B"): (1, "B", 1.0), (1, "B"): (1, "B", 1.1)})
TARGET = Transducer({(0, "T"): (1, "T", 1.0), (1, "I"): (1, "A", 1.5), (1, "J"): (1, "A", 1.5), (1, "H"): (1, "B", 1.5)})
NEGATION = Transducer({(0, "N"): (3, "N", 1.0)} | {(s, "O"): (s - 1, "O", 1.0) for s in (1, 2, 3)} | {(s, "T"): (s, "T", 1.0) for s in (1, 2, 3)} | {(s, a): (0, "X", 0.5) for s in (1, 2, 3) for a in "IJAHB"})
REPORT = Transducer({(0, "R"): (1, "R", 1.0), (1, "Q"): (2, "Q", 1.0), (0, "Q"): (2, "Q", 1.0), (2, "Q"): (0, "Q", 1.0)} | {(s, a): (s, "Y", 0.5) for s in (1, 2) for a in "IJAHBX"})
CASCADE = (INSULT, THREAT, TARGET, NEGATION, REPORT)


#: Read from the end of a clause: a target within three words after the attack ("idiot, you").
FOLLOWED = Transducer({(s, "T"): (3, "T", 1.0) for s in range(4)} | {(s, c): (s - 1, c, 1.0) for s in (1, 2, 3) for c in "NRQO"} | {(s, a): (s - 1, b, 1.5) for s in (1, 2, 3) for a, b in ("IA", "HB")})


class Composed:
    """The cascade as one machine, its states made when they are first reached."""

    def __init__(self, cascade: tuple[Transducer, ...] = CASCADE):
        self.cascade, self.table = cascade, {}
        self.start = (0,) * len(cascade)

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str, float]:
        if (known := self.table.get((state, symbol))) is None:
            new, out, factor = [], symbol, 1.0
            for s, t in zip(state, self.cascade, strict=True):
                s, out, f = t.step(s, out)
                new.append(s)
                factor *= f
            known = self.table[state, symbol] = (tuple(new), out, factor)
        return known


_MACHINE = Composed()
_PATTERN = {"I": 0, "J": 0, "A": 1, "H": 2, "B": 2, "X": 3, "Y": 4}


class Lexicon:
    """Attack entries with weights: whole words, and beginnings of words (written with a star)."""

    def __init__(self, entries: dict[str, float]):
        import ahocorasick

        self.entries = {w: 4.0 for w in INSULTS} | {w: 2.0 for w in THREATS} | entries
        self.longest = max((len(e) for e in self.entries), default=0)
        self.automaton = ahocorasick.Automaton()
        for entry in self.entries:
            self.automaton.add_word(entry.rstrip("*"), len(entry.rstrip("*")))
        self.automaton.make_automaton()

    @functools.lru_cache(maxsize=200_000)  # noqa: B019  one lexicon for a worker's life
    def weigh(self, word: str) -> tuple[str, float]:
        """Class and weight of a lower-cased word."""
        best = self.entries.get(word, 0.0)
        for n in range(3, min(len(word), self.longest) + 1):
            best = max(best, self.entries.get(word[:n] + "*", 0.0))
        if best:
            return ("H" if word in THREATS else "I"), best
        return ("T" if word in TARGETS else "N" if word in NEGATIONS else "R" if word in REPORTS else "Q" if word in "\"“”«»" else "O"), 0.0


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The weights of the matched patterns in a text, in the order of FEATURES."""
    lowered = (text or "").lower()
    sums, strongest, hits, done = [0.0] * 5, 0.0, 0, -1
    for end, length in lexicon.automaton.iter(lowered):
        start = end - length + 1
        if start < done or (start and (lowered[start - 1].isalnum())):
            continue  # within a clause that has been read, or within a word
        begin = max(done, 0, max(lowered.rfind(c, max(done, 0), start) for c in ".!?;\n") + 1)
        done = stop = m.start() if (m := _CLAUSE_END.search(lowered, end)) else len(lowered)
        clause = _clause(lowered[begin:stop], lexicon)
        for k, w in clause:
            sums[k] += w
            hits += 1
        strongest = max(strongest, sum(w for _, w in clause))
    return [math.log1p(x) for x in sums] + [math.log1p(strongest), math.log1p(1000 * hits / (len(lowered) + 100))]


def _clause(clause: str, lexicon: Lexicon) -> list[tuple[int, float]]:
    """(pattern, weight) of each attack in a clause: one pass from its end, one from its beginning."""
    tagged = [lexicon.weigh(w) for w in _WORD.findall(clause)]
    if not any(w for _, w in tagged):
        return []
    back, after = [], 0
    for symbol, weight in reversed(tagged):
        after, symbol, factor = FOLLOWED.step(after, symbol)
        back.append((symbol, weight * factor))
    state, out = _MACHINE.start, []
    for symbol, weight in reversed(back):
        state, symbol, factor = _MACHINE.step(state, symbol)
        if weight:
            out.append((_PATTERN.get(symbol, 0), weight * factor))
    return out


def _candidates(text: str | None) -> set[str]:
    """The entries that a text could teach: its words, and their beginnings of 4 to 6 letters."""
    words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}


def learn_entries(labelled: DataFrame, most: int = 4096, share_docs: float = 0.006, least_weight: float = 3.0) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Entries from ``text, toxic, half`` rows: those of half 0, of half 1, and of both.

    An entry's weight is the log of how many times likelier a toxic text has it than another; it needs two toxic texts
    and a share ``share_docs`` of them. The rows are a bounded sample, and the entries ``most`` at most.
    """
    kinds = [(half, toxic) for half in (0, 1) for toxic in (0, 1)]
    names = [f"n{half}{toxic}" for half, toxic in kinds]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = {k: Counter() for k in kinds}
        for batch in batches:
            kind = list(zip(batch.column("half").to_pylist(), batch.column("toxic").to_pylist(), strict=True))
            for start, texts in text_slices(batch, "text"):
                for i, text in enumerate(texts, start):
                    seen[kind[i]].update(_candidates(text))
        keys = list(set().union(*seen.values()))
        for s in range(0, len(keys), 50_000):
            part = keys[s : s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[k][x] for x in part], pa.int64()) for k in kinds)], ["entry", *names])

    counts = bounded(labelled).mapInArrow(count, "entry string, " + ", ".join(f"{n} long" for n in names)).groupBy("entry").agg(*(F.sum(n).alias(n) for n in names))
    totals = {(r["half"], r["toxic"]): r["count"] for r in labelled.groupBy("half", "toxic").count().collect()}
    counts = cut(counts.where(F.col("n01") + F.col("n11") >= 2))  # the entries of too few toxic texts go
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n = [sum(totals.get((h, k), 0) for h in halves) for k in (0, 1)]
        good, bad = (sum((F.col(f"n{h}{k}") for h in halves), F.lit(0)) for k in (0, 1))
        weight = F.log((bad + 0.5) / (n[1] + 1.0)) - F.log((good + 0.5) / (n[0] + 1.0))
        best = counts.where(bad >= max(2, math.ceil(share_docs * n[1]))).select("entry", bad.alias("bad"), weight.alias("weight")).where(F.col("weight") >= least_weight)
        out.append({r["entry"]: float(r["weight"]) for r in best.orderBy((F.col("weight") * F.log1p("bad")).desc(), "entry").limit(most).collect()})
    return out[0], out[1], out[2]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (last: constant) by Newton's method with a quadratic penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _feature_rows(rows: DataFrame, entries: dict[str, float], keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(tuple(sorted(entries.items())))
        for batch in batches:
            got = [features(x, lexicon) for _, texts in text_slices(batch, "text") for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(keep).cast(pa.int64()), *(pa.array([g[i] for g in got], pa.float64()) for i in range(len(FEATURES)))], [keep, *FEATURES])

    return bounded(rows).mapInArrow(run, f"{keep} long, " + ", ".join(f"{f} double" for f in FEATURES))


@functools.lru_cache(maxsize=2)
def _lexicon(entries: tuple[tuple[str, float], ...]) -> Lexicon:
    return Lexicon(dict(entries))


def held_out(id_col: str = "doc_id"):
    """Rows that learning never sees: crc32 of the id's text is a multiple of five (also rows without id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the pattern weights for every row of ``docs``.

    Learns from ``labels`` (doc_id, toxic) of rows that are not held out; labels that are null are skipped, and without
    any label of one of the two classes the fixed words alone decide; of rows that repeat an id the smallest text is
    learned from. A null text counts as empty; a row without id is
    scored and counts as held out; repeated rows are scored each; very long texts take time in proportion; an empty
    table gives no rows; other columns do not matter and may have any name.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = F.xxhash64("doc_id", F.lit(11))
    sample = known.withColumn("half", F.pmod(drawn, F.lit(2))).orderBy(drawn, "doc_id").limit(fit_rows)
    drawn_texts = texts.join(F.broadcast(sample), "doc_id")  # fit_rows ids at most; their texts are read once
    labelled = cut(drawn_texts.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("text", "toxic", "half"))))  # a row for each id
    first, second, entries = learn_entries(labelled.select("text", "toxic", "half"))
    crossed = [_feature_rows(labelled.where(F.col("half") == half).select("text", "toxic"), other, "toxic").collect() for half, other in ((1, first), (0, second))]
    fit = np.array([tuple(r) for part in crossed for r in part], dtype=float).reshape(-1, len(FEATURES) + 1)
    if len(set(fit[:, 0].tolist())) == 2:
        w = fit_logistic(fit[:, 1:], fit[:, 0])
    else:
        w = np.array([1.0, 1.0, 1.0, 0.2, 0.2, 1.0, 0.0, -3.0])
    patterns = _feature_rows(texts, entries, "doc_id")
    linear = sum((F.col(f) * float(w[i]) for i, f in enumerate(FEATURES)), F.lit(float(w[-1])))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear))))
    return patterns.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *FEATURES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
