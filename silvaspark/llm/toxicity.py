"""Toxic language: Levenshtein automata over a lexicon trie, and scores of the context of each hit.

The lexicon is learned from labelled rows: words and word beginnings that stand in toxic texts
and hardly in others, beside a short list of common terms of abuse. All terms form one trie. The
automaton that accepts every string within a few edits of a term runs through the trie in
lockstep: a state is the set of trie nodes reached, each with its least number of edits. States
and their transitions are kept as they are met, so a word costs a look-up for each letter until
its state is empty, mostly after three or four.

A hit counts less if it is misspelled, and apart if it is quoted. Sums over a window of words
around the hits, and their weights from a logistic fit, tell abuse from a quotation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, STAGE_ROWS, Kept, Memo, held_out, map_slices, release, slices, texts_of, word_table

# Common English terms of abuse.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "vermin", "filthy")
QUOTES = "\"“”„«»‹›"
#: ASCII marks that may stand around a word and quote nothing.
MARKS = "!#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words between non-letters, as the lexicon is learned from; each quotation mark is a place of its own.
PLACES = re.compile(rf"[^\W_]+|[{QUOTES}]")
#: Words that make the words after them a report.
REPORTS = frozenset("said says called quoted quote reported term word wrote".split())
#: Words of context on each side of a hit.
WINDOW = 12
#: Labelled rows that the lexicon and its weights are learned from, at most.
FIT_ROWS = 8_000
SHORTEST, LONGEST = 4, 8
MEMO_WORDS, STATES = 600_000, 200_000
#: Words that a stage of a chain keeps, and those with their places, where the executor holds the stages before it.
STAGE_WORDS, STAGE_PLACES = 100_000, 10_000


def edits(length: int) -> int:
    """The edits allowed for a term."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Finds terms, or words that begin with them, within the allowed edits.

    ``terms`` maps a term to whether longer words that begin with it count too.
    """

    def __init__(self, terms: dict[str, bool]):
        self.terms = dict(sorted(terms.items()))
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[str | None] = [None]
        self.bound = [0]
        for term in self.terms:
            node = 0
            self.bound[0] = max(self.bound[0], edits(len(term)))
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.whole.append(None)
                    self.bound.append(0)
                node = self.children[node][letter]
                self.bound[node] = max(self.bound[node], edits(len(term)))
            self.whole[node] = term
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[tuple[int, str] | None, tuple[int, str] | None]] = []
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        """The number of a state; letters that a word lacks are skipped here."""
        todo = list(nodes.items())
        while todo:
            node, cost = todo.pop()
            for child in self.children[node].values():
                if cost + 1 <= self.bound[child] and nodes.get(child, 9) > cost + 1:
                    nodes[child] = cost + 1
                    todo.append((child, cost + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
            hits = sorted((cost, self.whole[node]) for node, cost in key if self.whole[node] and cost <= edits(len(self.whole[node])))
            self.ends.append((next(((c, t) for c, t in hits if self.terms[t]), None), hits[0] if hits else None))
        return self.states[key]

    def step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, cost: int) -> None:
            if cost <= self.bound[node] and nodes.get(node, 9) > cost:
                nodes[node] = cost

        for node, cost in self.members[state]:
            reach(node, cost + 1)
            for of, child in self.children[node].items():
                reach(child, cost + (of != letter))
        found = self.state(nodes)
        self.steps[state][letter] = found
        return found

    def find(self, word: str) -> tuple[int, str] | None:
        """The nearest term of a word in lower case: edits and term."""
        if len(self.members) > STATES:
            self.clear()
        state, best = self.start, None
        steps, ends, members = self.steps, self.ends, self.members
        for letter in word:
            to = steps[state].get(letter)
            state = self.step(state, letter) if to is None else to
            begins = ends[state][0]
            if begins is not None and (best is None or begins < best):
                best = begins
            if not members[state]:
                return best
        end = ends[state][1]
        return end if end is not None and (best is None or end < best) else best


FEATURES = 9


def features(text: str, places_of: Memo) -> list[float]:
    """What a whole text says for the fit: hits by kind, their densest window, different terms."""
    places = [p for w in text.split() for p in places_of[w]]
    at = [i for i, p in enumerate(places) if p[1]]
    if not at:
        return [1.0] + [0.0] * (FEATURES - 1)
    quoted, inside = set(), False
    for i, (word, _, _) in enumerate(places):
        if word in QUOTES:
            inside = not inside
        elif inside:
            quoted.add(i)
    if inside:  # a mark that is never closed quotes nothing
        quoted = {i for i in quoted if places[i][2]}
    count = [0.0, 0.0, 0.0, 0.0]
    weights, terms = [], set()
    for i in at:
        cost, term = places[i][1]
        near = {w for w, _, _ in places[max(0, i - 4) : i]}
        reported = i in quoted or bool(near & REPORTS)
        count[2 * bool(cost) + reported] += 1
        weights.append((10 if cost else 20) * (3 if reported else 10))
        terms.add(term)
    direct = count[0] + count[2]
    return [1.0, *np.log1p(count).tolist(), math.log1p(densest(at, weights) / 200), math.log1p(len(terms)), math.log1p(1000 * direct / len(places)), float(len(terms) > 1)]


def densest(at: list[int], weights: list[int]) -> int:
    """The greatest weight of the hits within ``WINDOW`` places on either side of one of them; whole numbers, so sums are exact."""
    best = total = low = high = 0
    for i in at:
        while high < len(at) and at[high] <= i + WINDOW:
            total += weights[high]
            high += 1
        while at[low] < i - WINDOW:
            total -= weights[low]
            low += 1
        best = max(best, total)
    return best


@dataclass
class Model:
    terms: dict[str, bool]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))

    def hits(self, keep: int = MEMO_WORDS, most: int | None = None) -> Memo:
        automaton = Automaton(self.terms)
        known = Memo(automaton.find, keep)

        def find(word: str) -> tuple[int, str] | None:
            return known[word] if len(word) > 2 else None

        def places(word: str) -> list[tuple[str, tuple[int, str] | None, bool]]:
            """The places of a word between blanks: each with its hit, and whether the word is quoted by itself."""
            word = word.lower()
            core = word.strip(MARKS)
            if core.isalnum():  # marks that are no quotation stand around it, if any
                return [(core, find(core), False)]
            parts = PLACES.findall(word)
            hits, alone = [find(p) for p in parts], sum(map(word.count, QUOTES)) >= 2
            first = next((i for i, p in enumerate(parts) if p not in QUOTES), None)
            if first is not None and not any(hits):  # a mark in place of a letter
                hits[first] = find(word.strip("".join({c for c in word if not c.isalnum()})))
            return [(p, h, alone) for p, h in zip(parts, hits, strict=True)]

        return Memo(places, most or keep)

    def scorer(self, keep: int = MEMO_WORDS) -> Callable[[list[str]], np.ndarray]:
        """Scores of whole texts; only those with a hit are looked at word by word."""
        places = self.hits(keep, None if keep == MEMO_WORDS else STAGE_PLACES)
        hit = Kept(lambda words: [any(p[1] for w in word.split() for p in places.function(w)) for word in words], keep)
        none = [1.0] + [0.0] * (FEATURES - 1)

        def scores(texts: list[str]) -> np.ndarray:
            words, at, first = word_table(texts)
            known = hit(words)
            x = [features(t, places) if any([known[k] for k in at[a:b]]) else none for t, a, b in zip(texts, first, first[1:], strict=False)]
            return self.score(np.array(x, float).reshape(-1, FEATURES))

        return scores

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def _likelihood(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio that a term's share of toxic texts is not that of all texts."""
    total, share = toxic + clean, n_toxic / (n_toxic + n_clean)
    part = lambda k, p: k * math.log(k / total / p) if k else 0.0
    return 2 * (part(toxic, share) + part(clean, 1 - share))


def choose(counts: dict[tuple[str, bool], tuple[int, int]], n_toxic: int, n_clean: int, candidates: int) -> dict[str, bool]:
    """The terms of a lexicon from counts of texts with a word (False) or beginning (True): toxic, clean.

    A term must be rare in clean texts and unlikely to be so by chance among ``candidates``. Of
    beginnings that stand in nearly the same texts the longest stays, or the word itself.
    """
    if not n_toxic or not n_clean:
        return dict.fromkeys(SEEDS, True)
    least = 2 * math.log(max(candidates, 2)) + 4
    good = {k: t for k, (t, c) in counts.items() if t / n_toxic > 20 * c / n_clean and _likelihood(t, c, n_toxic, n_clean) >= least}
    found: dict[str, bool] = {}
    for root in sorted((k[0] for k in good if k[1]), key=lambda p: (len(p), p)):
        if any(root[:i] in found and found[root[:i]] for i in range(SHORTEST, len(root) + 1)) or any(t.startswith(root) for t in found):
            continue
        at = (root, True)
        while more := [k for k in good if k != at and k[0].startswith(at[0]) and (len(k[0]) == len(at[0]) + 1 or not k[1]) and good[k] >= 0.8 * good[at] and at[1]]:
            at = max(more, key=lambda k: (not k[1], good[k], k[0]))
        found[at[0]] = at[1]
    for word, begins in good:
        if not begins and not any(word[:i] in found and (found[word[:i]] or word[:i] == word) for i in range(1, len(word) + 1)):
            found[word] = False
    return {t: found[t] for t in sorted(found)} | {s: True for s in SEEDS if not any(s.startswith(t) for t in found)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    """Weights of a logistic fit with a quadratic penalty, by Newton steps; the constant is not penalised."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> Model:
    """Learn the lexicon and its weights from at most about ``max_rows`` labelled rows of the training split.

    The rows are chosen by a hash of doc_id. Terms have three letters or more, as many as the texts show. Terms are counted by aggregates; equal texts count
    once. For the weights each half of the rows is looked up in the lexicon of the other half, so
    a term that a half has by chance earns no weight. Without toxic or without clean labels the
    list of seeds alone decides.
    """
    train = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    n = train.count()
    spread = 1 << 30
    chosen = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < int(spread * min(1.0, max_rows / max(n, 1))))
    # bounded by max_rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["text"])
    rows = rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))

    words: Column = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    held = rows.select("y", "half", words.alias("words"), "text").persist()
    sizes = {(r["half"], r["y"]): r["n"] for r in held.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    begins = F.array_distinct(F.flatten(F.transform("words", lambda w: F.transform(F.filter(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda k: F.length(w) >= k), lambda k: F.substring(w, F.lit(1), k)))))
    both = F.concat(F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(False).alias("begins"))), F.transform(begins, lambda w: F.struct(w.alias("term"), F.lit(True).alias("begins"))))
    pick = lambda half, y: F.count_if((F.col("half") == half) & (F.col("y") == y)).alias(f"n{half}{y}")
    terms = held.select("y", "half", F.explode(both).alias("t")).groupBy("t.term", "t.begins").agg(*[pick(h, y) for h in (0, 1) for y in (0, 1)])
    terms = terms.filter("n01 + n11 >= 3")
    counted = terms.filter("(n00 + n10) * 5 <= n01 + n11").collect()  # of a bounded sample; the rule of choose() is stricter
    candidates = max(len(counted) * 4, 1_000)

    def lexicon(halves: tuple[int, ...]) -> dict[str, bool]:
        counts = {(r["term"], r["begins"]): (sum(r[f"n{h}1"] for h in halves), sum(r[f"n{h}0"] for h in halves)) for r in counted}
        return choose({k: v for k, v in counts.items() if v[0]}, sum(sizes.get((h, 1), 0) for h in halves), sum(sizes.get((h, 0), 0) for h in halves), candidates)

    crossed = [Model(lexicon((1,))), Model(lexicon((0,)))]  # for the rows of half 0 and 1

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        hits = [m.hits() for m in crossed]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t, hits[h]) for t, h in zip(texts_of(batch), batch.column("half").to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

        return run

    found = map_slices(held.select("y", "half", "text"), make, "y int, x array<double>").collect()
    held.unpersist()
    model = Model(lexicon((0, 1)))
    y = np.array([r["y"] for r in found], float)
    if 0 < y.sum() < len(y):
        model.weights = logistic(np.array([r["x"] for r in found]), y)
    else:
        model.weights = np.array([-3.0, 1, 0.2, 0.5, 0.1, 1, 1, 0, 1])
    return model


def score(docs: DataFrame, labels: DataFrame, toxic_from: float = 0.5, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row: 1 from ``toxic_from`` on.

    One scan without a shuffle after the fit. Null texts are empty and, like texts without a hit,
    get the score of no hits. Rows with equal or null doc_id each give a row. An empty table
    gives no rows. Columns other than doc_id and text are ignored. A text is held whole; memory is
    bounded by a slice of texts (``SLICE_BYTES``) or one longer text, and the kept words.
    """
    model = model or fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scores = model.scorer()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = scores(texts_of(batch))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= toxic_from).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

        return run

    return map_slices(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, toxic_from: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``toxic_from``; one scan, no shuffle after the fit.

    Each row is judged by its own text, whatever other rows of its doc_id hold. Null and empty
    texts have no hits and stay; an empty table stays empty; columns of any other name are kept
    and not read. A text is held whole; memory is bounded by a slice of texts or one longer text.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer(STAGE_WORDS)
        for part in slices(batches, STAGE_ROWS, STAGE_BYTES):
            yield part.filter(pa.array(scores(texts_of(part)) < toxic_from, pa.bool_()))
        del scores
        release()

    return docs.mapInArrow(run, docs.schema)
