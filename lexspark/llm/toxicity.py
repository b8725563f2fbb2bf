"""Toxicity scores from a learnt lexicon, matched through Levenshtein automata, and the hits' context.

A lexicon of words that go with the label is counted on labelled rows. Its words form a trie; the
automata that accept a word with one edit are intersected with the trie and made deterministic as
words come, so most words fail within a few characters, without a look at the lexicon's size. Hits
count by how they were matched (as spelled, misspelled) and by two scores of their context window:
whether it is inside quotation marks or a quoted line, and the mean weight of the words around the
hit. These weights are learnt too: how much oftener a word stands near hits of toxic texts than near
those of others, so reporting verbs, negations and forms of address tell mention from abuse wherever
the labels show it. A logistic model of these few numbers, fitted on a bounded sample of labelled
rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import checkpoint, table

#: Labelled rows that the lexicon, the context weights and the model are fitted on, at most. What is learnt has no bound of its own.
FIT_ROWS = 30_000
#: Words shorter than this are matched as spelled only.
FUZZY_LENGTH = 5
#: Characters on both sides of a hit that its context is read from.
CONTEXT = 120
#: Words on both sides of a hit that are its context window, and texts that a word must be found in near hits to have a weight.
NEAR_WORDS, NEAR_TEXTS = 6, 8
FEATURES = ("exact", "misspelled", "quoted", "distinct", "weight", "density", "context")
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"“”„«»‹›"


class LexiconAutomaton:
    """The lexicon's trie, crossed with the automata of all words at one edit, as a lazily made DFA.

    A state is the set of (trie node, edits so far) that the characters read can lead to. ``match``
    gives (place in the lexicon, edits), the fewest edits first, then the earlier word, or None.
    """

    def __init__(self, words: list[str], fuzzy: list[bool]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        self.fuzzy_below: list[bool] = [False]
        self.fuzzy = fuzzy
        for i, w in enumerate(words):
            node = 0
            self.fuzzy_below[0] |= fuzzy[i]
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.final.append(-1)
                    self.fuzzy_below.append(False)
                node = self.children[node][c]
                self.fuzzy_below[node] |= fuzzy[i]
            self.final[node] = i
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.root = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        # leaving out a character of the lexicon's word is an edit that reads nothing
        items |= {(n, 1) for node, e in tuple(items) if e == 0 for n in self.children[node].values() if self.fuzzy_below[n]}
        key = frozenset(items)
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.final[n]) for n, e in key if self.final[n] >= 0 and (e == 0 or self.fuzzy[self.final[n]])]
            self.accepts.append(min(ends)[::-1] if ends else None)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                after.add((self.children[node][c], e))
            if e == 0 and self.fuzzy_below[node]:
                after.add((node, 1))  # one character too many
                after |= {(n, 1) for n in self.children[node].values() if self.fuzzy_below[n]}  # another character
        to = self.moves[state][c] = self._state(after)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        state, moves = self.root, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]


class _Matches(dict):
    """Matches of words, emptied when it has grown large."""

    def __init__(self, automaton: LexiconAutomaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, int] | None:
        if len(self) >= 500_000:
            self.clear()
        found = self[word] = self.automaton.match(word)
        return found


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows it inside quotation: between marks, or on a line that begins with ``>``."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    line = before.rpartition("\n")[2]
    if line.lstrip().startswith(">"):
        return True
    marks = sum(c in _QUOTES for c in line)
    return marks % 2 == 1 and any(c in _QUOTES for c in after.partition("\n")[0])


def near_words(words: list[str], hits: list[int], matches: _Matches) -> list[set[str]]:
    """For each hit, given by its place among the words, the other words of its window that are no hits."""
    return [{w for w in words[max(0, i - NEAR_WORDS) : i + NEAR_WORDS + 1] if not matches[w]} for i in hits]


def features(text: str, matches: _Matches, weights: list[float], near: Mapping[str, float] = MappingProxyType({})) -> list[float]:
    """Numbers of a text in the order of ``FEATURES``, all 0 for one without a hit."""
    low = text.lower()
    words = _WORD.findall(low)
    hits = [i for i, m in enumerate(map(matches.__getitem__, words)) if m]
    if not hits:
        return [0.0] * len(FEATURES)
    exact = misspelled = inside = 0
    seen: set[int] = set()
    for m in _WORD.finditer(low):
        hit = matches[m[0]]
        if not hit:
            continue
        if quoted(low, m.start(), m.end()):
            inside += 1
        elif hit[1]:
            misspelled += 1
        else:
            exact += 1
        seen.add(hit[0])
    top = sorted((weights[i] for i in seen), reverse=True)[:3]
    around = [sum(near.get(w, 0.0) for w in own) / (len(own) + 1) for own in near_words(words, hits, matches)]
    return [math.log1p(exact), math.log1p(misspelled), math.log1p(inside), math.log1p(len(seen)), sum(top), 100 * (exact + misspelled) / len(words), sum(around) / len(around)]


def with_features(docs: DataFrame, lexicon: list[tuple[str, float, bool]], near: dict[str, float], text_col: str = "text") -> DataFrame:
    """``docs`` with ``features``, an array in the order of ``FEATURES``; null texts have zeros."""
    words, weights, fuzzy = ([x[i] for x in lexicon] for i in range(3))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(LexiconAutomaton(words, fuzzy))
        for b in batches:
            found = pa.array([features(t.as_py() or "", matches, weights, near) for t in b.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*names, "features"])

    schema = docs.select("*", F.array().cast("array<double>").alias("features")).schema
    return docs.mapInArrow(run, schema)


def learn_context(labelled: DataFrame, lexicon: list[tuple[str, float, bool]]) -> dict[str, float]:
    """Log-odds of words near hits in toxic texts against those near hits in other texts of ``labelled(text, label)``.

    A word counts once a text. Words that fewer than ``NEAR_TEXTS`` texts have near hits weigh
    nothing, the others are drawn towards nothing by one text on each side.
    """
    words, _, fuzzy = ([x[i] for x in lexicon] for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(LexiconAutomaton(words, fuzzy))
        for b in batches:
            rows = []
            for t, label in zip(b.column(0), b.column(1).to_pylist()):
                own = _WORD.findall((t.as_py() or "").lower())
                hits = [i for i, w in enumerate(own) if matches[w]]
                if hits:
                    rows += [(w, label) for w in {"", *set().union(*near_words(own, hits, matches))}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["word", "label"])

    found = labelled.select("text", F.col("label").cast("int")).mapInArrow(run, "word string, label int")
    counts = found.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    kept = {r.word: (r.pos, r.neg) for r in counts.where(F.col("pos") + F.col("neg") >= NEAR_TEXTS).collect()}  # words of the labelled sample's windows
    pos, neg = kept.pop("", (0, 0))  # texts with hits
    return {w: math.log((p + 1) / (pos + 2)) - math.log((n + 1) / (neg + 2)) for w, (p, n) in kept.items()}


def learn_lexicon(labelled: DataFrame) -> list[tuple[str, float, bool]]:
    """(word, log-odds, whether misspellings count) from ``labelled(text, label)``, by significance.

    Words are counted once a text and equal texts once. A word is taken if it is found in three
    toxic texts or more, ten times as often there as in others, with a log-likelihood ratio of 13
    or more. Misspellings of a word count if words one edit away are not found in clean texts more
    than in toxic ones. The lexicon is as large as these rules make it; the rows it is learnt from are bounded.
    """
    texts = labelled.select(F.lower("text").alias("text"), "label").groupBy("text").agg(F.max("label").alias("label"))
    texts = checkpoint(texts.select("label", F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("words")))
    n_pos, n_neg = texts.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n_pos or not n_neg:
        return []
    counts = texts.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    counts = checkpoint(counts)
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    part = lambda o, share: F.when(F.col(o) > 0, F.col(o) * F.log(F.col(o) / (F.lit(share) * (F.col("pos") + F.col("neg"))))).otherwise(0.0)
    ratio = 2 * (part("pos", n_pos / (n_pos + n_neg)) + part("neg", n_neg / (n_pos + n_neg)))
    chosen = counts.where("pos >= 3 and length(word) >= 3").withColumn("odds", odds).withColumn("ratio", ratio)
    chosen = chosen.where((F.col("odds") >= math.log(10)) & (F.col("ratio") >= 13)).orderBy(F.desc("ratio"), "word").select("word", "odds").collect()
    if not chosen:
        return []
    words = [r.word for r in chosen]
    long_enough = [len(w) >= FUZZY_LENGTH for w in words]

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = LexiconAutomaton(words, long_enough).match
        for b in batches:
            rows = [(m[0], p, n) for w, p, n in zip(*(c.to_pylist() for c in b.columns)) if (m := match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["at", "pos", "neg"])

    near = counts.select("word", "pos", "neg").mapInArrow(variants, "at long, pos long, neg long").groupBy("at").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    common = {r["at"] for r in near.where("neg > pos").collect()}  # at most a row a word of the lexicon
    return [(r.word, float(r.odds), long_enough[i] and i not in common) for i, r in enumerate(chosen)]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of an L2-penalised logistic model, by Newton steps."""
    if not len(y) or y.min() == y.max():
        rate = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.5)
        return np.zeros(x.shape[1]), math.log(rate / (1 - rate))
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def held_out() -> Column:
    """Rows whose labels are never learnt from; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, score)`` of every row of ``docs(doc_id, text)``.

    Learns from rows of ``labels(doc_id, toxic)`` that are not held out, from about ``fit_rows`` of
    them by a hash of doc_id if there are more. Null labels are left out; a doc_id labelled twice
    counts as toxic if either row says so. Scores depend on the text alone: null and empty texts,
    and all others without a hit, get the model's base score. Without labels of both kinds that base
    is all there is. Extra columns are not read. No documents: no rows.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = checkpoint(known.where(~held_out()))
    rows = known.count()
    part = min(1.0, fit_rows / rows) if rows else 1.0
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    fit = checkpoint(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "label"))
    lexicon = learn_lexicon(fit)
    near = learn_context(fit, lexicon) if lexicon else {}
    taught = with_features(fit, lexicon, near).select("features", "label").toPandas() if lexicon else None  # fit_rows rows
    if taught is None or not len(taught):
        coefficients, base = np.zeros(len(FEATURES)), math.log(0.01 / 0.99)
    else:
        coefficients, base = fit_logistic(np.array(taught.features.tolist()), taught.label.to_numpy(float))
    total = F.lit(base)
    for i, w in enumerate(coefficients):
        total = total + F.lit(float(w)) * F.get("features", F.lit(i))
    scored = with_features(docs.select("doc_id", "text"), lexicon, near)
    return scored.select("doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-total))).alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
