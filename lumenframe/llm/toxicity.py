"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is a trie of whole words and stems.  The Levenshtein automata of
all its terms are intersected with the trie as one automaton whose states are
sets of (trie node, errors so far); states are made when first met and then
kept, so a word costs one table step for each character and most words reach
the dead state after a few.  Two neighbouring letters that are swapped count as
one error.  Hits are scored in a window of words around them: quotation marks,
reporting verbs and denials lower a hit, direct address and repetition raise it.

Learning takes a bounded number of labelled documents, whole: counts and
features are made on the executors, and the driver gets those only.

Defined cases: a null or empty text scores as a text without hits; repeated
rows score alike; an empty table gives an empty result; without training rows
the lexicon is empty and every document gets the same low score; texts of any
length are scanned whole; other columns pass by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import logistic, materialize, remove, sampled_labels, sigmoid, tidy

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
QUOTES = "\"“”„«»‘’‹›"
REPORTING = frozenset("said says say called calls quoted quote quotes wrote term word words slur insult dit dijo sagte nannte mot wort palabra".split())
DENYING = frozenset("not never no nicht kein keine nie pas jamais nunca".split())
ADDRESS = frozenset("you your you're u ur du dein ihr euch tu toi vous votre eres usted vos".split())
SCORE_TYPE = "score double, hits int, fuzzy_hits int, quoted_hits int"
#: Documents of either class from which the lexicon and the weights are learned.
TRAIN_DOCS = 2500
#: Positive documents that a term needs, and letters of the stems that are tried.
MIN_SUPPORT, STEM_SIZES = 3, (4, 5, 6, 7)
#: Words looked up so far that a worker keeps, in characters.
KEEP_CHARS = 8_000_000


class LexiconAutomaton:
    """Union of the Levenshtein automata of the terms, walked along their trie.

    ``terms``: term -> (weight, is_stem).  A stem accepts any word that starts
    with it; its name may end in a star, so that an equal word can stand beside
    it.  ``edits(term)`` errors (insert, delete, substitute, swap of neighbours)
    are allowed, none for short terms.  A state's key is a node, or a node and
    the letter that has yet to come when two are swapped before it.
    """

    def __init__(self, terms: dict[str, tuple[float, bool]], min_fuzzy: int = 5, min_fuzzy_stem: int = 8, max_edits: int = 1):
        self.max_edits = max_edits
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int, bool]]] = [[]]  # term, edits allowed, stem
        self.slack: list[int] = [0]  # most edits allowed by a term below the node
        for term, (_, stem) in sorted(terms.items()):
            letters = term.rstrip("*") if stem else term
            allowed = max_edits if len(letters) >= (min_fuzzy_stem if stem else min_fuzzy) else 0
            node = 0
            self.slack[0] = max(self.slack[0], allowed)
            for c in letters:
                nxt = self.kids[node].get(c)
                if nxt is None:
                    nxt = self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                    self.slack.append(0)
                node = nxt
                self.slack[node] = max(self.slack[node], allowed)
            self.ends[node].append((term, allowed, stem))
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[str, int] | None] = []  # at the word's end
        self.stems: list[tuple[str, int] | None] = []  # accepts whatever follows
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, ""): 0}))

    def _closed(self, best: dict[tuple[int, str], int]) -> frozenset:
        """Adds the states that skip a term's character (a deletion)."""
        todo = [k for k in best if not k[1]]
        while todo:
            at = todo.pop()
            e = best[at] + 1
            for kid in self.kids[at[0]].values():
                if e <= self.slack[kid] and e < best.get((kid, ""), 99):
                    best[kid, ""] = e
                    todo.append((kid, ""))
        return frozenset(best.items())

    def _state(self, key: frozenset) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ended = [(e, t) for (n, wait), e in key if not wait for t, allowed, _ in self.ends[n] if e <= allowed]
            stems = [(e, t) for (n, wait), e in key if not wait for t, allowed, stem in self.ends[n] if stem and e <= allowed]
            self.final.append((min(ended)[1], min(ended)[0]) if ended else None)
            self.stems.append((min(stems)[1], min(stems)[0]) if stems else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        best: dict[tuple[int, str], int] = {}

        def reach(node: int, e: int, wait: str = "") -> None:
            if e <= self.slack[node]:
                best[node, wait] = min(best.get((node, wait), 99), e)

        for (node, wait), e in self.sets[state]:
            if wait:
                if c == wait:
                    reach(node, e)
                continue
            kid = self.kids[node].get(c)
            if kid is not None:
                reach(kid, e)
            if e < self.max_edits:
                reach(node, e + 1)  # an extra character in the word
                for first, k in self.kids[node].items():
                    reach(k, e + 1)  # another character in its place
                    swapped = self.kids[k].get(c)
                    if swapped is not None and first != c:
                        reach(swapped, e + 1, first)
        to = self._state(self._closed(best)) if best else self.dead
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that the word matches with fewest errors, and the errors."""
        state, dead, moves = self.start, self.dead, self.moves
        stem = None
        for c in word:
            nxt = moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if state == dead:
                return stem
            found = self.stems[state]
            if found and (stem is None or found[1] < stem[1]):
                stem = found
        end = self.final[state]
        return end if end and (stem is None or end[1] <= stem[1]) else stem


@dataclass
class ToxicityModel:
    terms: dict[str, tuple[float, bool]] = field(default_factory=dict)
    plain: frozenset = frozenset()  # words of their own that lie within the edits of a term
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 1.0]))
    bias: float = -4.0
    window: int = 4
    fuzzy_factor: float = 0.6
    quoted_factor: float = 0.35
    denied_factor: float = 0.6
    address_factor: float = 1.25
    _automaton: LexiconAutomaton | None = None
    _seen: dict[str, tuple[str, int] | None] = field(default_factory=dict)
    _kept: int = 0  # characters of the words seen

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_automaton", "_seen", "_kept")} | {"_automaton": None, "_seen": {}, "_kept": 0}

    def forget(self) -> None:
        self._automaton, self._seen, self._kept = None, {}, 0

    def look(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """The words that match a term; results are kept between documents."""
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.terms)
        seen, match = self._seen, self._automaton.match
        if self._kept > KEEP_CHARS:
            seen.clear()
            self._kept = 0
        fresh = words.difference(seen)
        for w in fresh:
            m = match(w)
            seen[w] = None if m and m[1] and w in self.plain else m
            self._kept += len(w)
        return {w: m for w in words if (m := seen[w]) is not None}

    def features(self, text: str | None) -> tuple[np.ndarray, tuple[int, int, int]]:
        """Strongest hit, sum of hits (root), hits for each word (root); counts of hits."""
        low = (text or "").lower()
        hits = self.look(set(WORD.findall(low))) if self.terms else {}
        if not hits:
            return np.zeros(3), (0, 0, 0)
        spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        words = [s[0] for s in spans]
        scores, n, fuzzy, quoted = [], 0, 0, 0
        for i, (w, a, b) in enumerate(spans):
            found = hits.get(w)
            if found is None:
                continue
            term, errors = found
            value = self.terms[term][0] * (self.fuzzy_factor if errors else 1.0)
            near = words[max(0, i - self.window) : i] + words[i + 1 : i + 1 + self.window]
            left = low[spans[max(0, i - self.window)][1] : a]
            right = low[b : spans[min(len(spans) - 1, i + self.window)][2]]
            in_quotes = any(c in left for c in QUOTES if c != "’") and any(c in right for c in QUOTES if c != "’")
            if in_quotes or (REPORTING.intersection(near) and (low[a - 1 : a] in QUOTES and a > 0)):
                value *= self.quoted_factor
                quoted += 1
            elif DENYING.intersection(words[max(0, i - 2) : i]):
                value *= self.denied_factor
            if ADDRESS.intersection(near) and not in_quotes:
                value *= self.address_factor
            scores.append(value)
            n += 1
            fuzzy += errors > 0
        s = np.array(scores)
        return np.array([s.max(), np.sqrt(s.sum()), np.sqrt(s.sum() / len(spans))]), (n, fuzzy, quoted)

    def near_words(self, text: str) -> set[str]:
        """Words that match a term by errors only."""
        return {w for w, m in self.look(set(WORD.findall(text.lower()))).items() if m[1]}

    def score(self, texts) -> pd.DataFrame:
        x, counts = zip(*map(self.features, texts), strict=True) if len(texts) else ((), ())
        x = np.array(x).reshape(-1, 3)
        c = np.array(counts, dtype=np.int32).reshape(-1, 3)
        return pd.DataFrame({"score": sigmoid(x @ self.weights + self.bias), "hits": c[:, 0], "fuzzy_hits": c[:, 1], "quoted_hits": c[:, 2]})


def grams(text: str, stem_sizes=STEM_SIZES) -> set[str]:
    """The words of a text, and their beginnings with a star."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w)
        for k in stem_sizes:
            if len(w) > k:
                out.add(w[:k] + "*")
    return out


def worth(in_pos: dict[str, int], in_neg: dict[str, int], n_pos: int, n_neg: int, min_support: int = MIN_SUPPORT) -> dict[str, float]:
    """Smoothed log ratios of the words and stems that stand out in the positive documents, by more than chance."""
    kept = {g for g, c in in_pos.items() if c >= min_support}
    if not kept or not n_neg:
        return {}
    ratio, share = n_neg / n_pos, n_pos / (n_pos + n_neg)
    value = {}
    bar = 2 * np.log(1000 * max(1, len(kept)))  # likelihood ratio that chance reaches once in 1000 such searches
    for g in kept:
        a, b = in_pos[g], in_neg.get(g, 0)
        g2 = 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if a * ratio > 10 * b and g2 > bar:
            value[g] = float(np.log((a * ratio + 0.25) / (b + 0.25)))
    return value


def choose_terms(value: dict[str, float], in_neg: dict[str, int], sets: list[set[str]], min_support: int = MIN_SUPPORT, stem_sizes=STEM_SIZES, cover: int = 2) -> dict[str, tuple[float, bool]]:
    """Terms among those of ``value``; ``sets`` holds what each positive document has of them.

    Chosen greedily by how many positives they add that fewer than ``cover`` chosen
    terms cover yet, so a word that only travels with toxic terms isn't taken; a term of
    many positives (one in 20) and no negative always is.  The words that stand
    out behind a chosen stem are terms as well, as a stem of few letters takes
    no error and a word does.
    """
    where: dict[str, set[int]] = {g: set() for g in value}
    for i, s in enumerate(sets):
        for g in s & value.keys():
            where[g].add(i)
    out: dict[str, tuple[float, bool]] = {}
    covered = np.zeros(len(sets), dtype=int)
    # the more documents the sooner; of equal ones the longer stem, then the word, so that the term isn't too wide
    for g in sorted(value, key=lambda g: (-len(where[g]), not g.endswith("*"), -len(g), g)):
        new = sum(covered[i] < cover for i in where[g])
        often = not in_neg.get(g) and len(where[g]) >= max(min_support, 0.05 * len(sets))  # many positives, no negative: not by chance
        if new >= max(min_support, 0.2 * len(where[g])) or often:
            stem = g.endswith("*")
            if any(g.rstrip("*").startswith(x.rstrip("*")) for x, (_, is_stem) in out.items() if is_stem):
                continue
            out[g] = (value[g], stem)
            for i in where[g]:
                covered[i] += 1
    stems = {g.rstrip("*") for g, (_, stem) in out.items() if stem}
    for w in value:
        if not w.endswith("*") and any(w[:k] in stems for k in stem_sizes if len(w) > k):
            out[w] = (value[w], False)
    return out


def plain_words(in_pos: dict[str, int], in_neg: dict[str, int], n_pos: int, n_neg: int, min_support: int = MIN_SUPPORT) -> frozenset:
    """Of words that match a term by errors only, those that negatives hold as often as not: no misspellings."""
    ratio = n_neg / max(1, n_pos)
    return frozenset(w for w, b in in_neg.items() if b >= min_support and in_pos.get(w, 0) * ratio <= 10 * b)


def weighted(model: ToxicityModel, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """The model with weights fitted to features and labels."""
    if not len(y):
        return model
    scale = np.maximum(x.std(axis=0), 1e-6) if model.terms else np.ones(3)
    w, b = logistic(x / scale, y, l2=1e-3, balanced=False)
    if model.terms:
        model.weights, model.bias = np.maximum(w, 0) / scale, float(b)
    else:
        model.weights, model.bias = np.zeros(3), -4.0
    model.forget()
    return model


def fit(docs: list[tuple[str, int]]) -> ToxicityModel:
    """As ``train``, from rows at hand."""
    pos, neg = [grams(t) for t, y in docs if y == 1], [grams(t) for t, y in docs if y == 0]
    in_pos, in_neg = (Counter(g for s in side for g in s) for side in (pos, neg))
    model = ToxicityModel(terms=choose_terms(worth(in_pos, in_neg, len(pos), len(neg)), in_neg, pos))
    if model.terms:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for t, y in docs:
            counts[y].update(model.near_words(t))
        model.plain = plain_words(counts[1], counts[0], len(pos), len(neg))
        model.forget()
    return weighted(model, np.array([model.features(t)[0] for t, _ in docs]), np.array([y for _, y in docs]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Fits on at most ``train_docs`` labelled documents of each class outside the held-out fold.

    Their whole texts stay on the executors.  The driver gets the counts of the words and stems that
    enough positives hold, which positives hold those that stand out, and three features for each document.
    """
    ids = sampled_labels(labels, id_col, label, train_docs)
    rows = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    )
    rows, path = materialize(rows, "toxicity-sample")
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)

    def over(make, out: str, rows: DataFrame = rows) -> DataFrame:
        """One list for each document, made from its text."""

        @F.pandas_udf(out)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from tidy(lambda rest: (pd.Series([make(t) for t in s]) for s in rest))(batches)

        # else the planner, which filters empty lists before explode, makes each list twice, in two workers for each task
        return rows.select("id", "label", run.asNondeterministic()("text").alias("x"))

    def tally(lists: DataFrame, least: int) -> tuple[dict[str, int], dict[str, int]]:
        counts = lists.select("label", F.explode("x").alias("g")).groupBy("g").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
        got = counts.where((F.col("p") >= least) if least else (F.col("n") - F.col("p") >= MIN_SUPPORT)).collect()
        return {r.g: r.p for r in got}, {r.g: r.n - r.p for r in got}

    model = ToxicityModel()
    if n_pos and n_neg:
        in_pos, in_neg = tally(over(lambda t: list(grams(t)), "array<string>"), MIN_SUPPORT)
        value = worth(in_pos, in_neg, n_pos, n_neg)
        held = over(lambda t: [g for g in grams(t) if g in value], "array<string>", rows.where("label = 1")).orderBy("id")
        model.terms = choose_terms(value, in_neg, [set(r.x) for r in held.select("x").collect()])
        if model.terms:
            model.plain = plain_words(*tally(over(lambda t: list(model.near_words(t)), "array<string>"), 0), n_pos, n_neg)
    got = over(lambda t: model.features(t)[0].tolist(), "array<double>").orderBy("id").select("x", "label").collect()
    remove(docs.sparkSession, path)
    return weighted(model, np.array([r.x for r in got]).reshape(-1, 3), np.array([r.label for r in got]))


def scored(text: Column, model: ToxicityModel) -> Column:
    """Struct column of score and counts for a text column."""

    @F.pandas_udf(SCORE_TYPE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(lambda rest: (model.score([None if v is None or v != v else v for v in s]) for s in rest))(batches)
        model.forget()

    return score(text)


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Keeps the rows that score below the threshold, with their columns."""
    return docs.withColumn("__lf_tox", scored(F.col(text_col), model)["score"]).where(F.col("__lf_tox") < threshold).drop("__lf_tox")
