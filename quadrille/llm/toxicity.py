"""Toxicity by a misspelling-tolerant lexicon (operator 8).

The lexicon (a few common insults, and what labelled texts show) is a trie. Levenshtein automata are intersected with it: a state is a set
of (trie node, edits so far), made when first met, so a word runs through the automaton of all terms at once and most words leave it
after two or three letters. Each hit is weighed by its window of words: one in quotation marks or after a reporting word counts for
less, hits that stand close together for more. A logistic model turns these sums into the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, give_back, labelled_sample, ship

FIT_ROWS = 6000
FIT_CHARS = 100_000
THRESHOLD = 0.3
WINDOW = 40
#: Common insults to start from; labelled texts add to them and may clear them.
BASE_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumbass", "imbecile", "vermin", "jerk")
#: Words after which a term is likelier reported than meant.
REPORTING = frozenset(("said", "says", "say", "called", "calls", "calling", "quote", "quoted", "quoting", "wrote", "word", "words", "term", "slur", "insult", "cited", "labelled", "labeled"))
QUOTES = frozenset("\"'“”‘’«»„`")
QUOTED_WEIGHT = 0.3
LOOKALIKES = 3
_WORDS = re.compile(r"\w+")
_OTHER = "\0"
_REMEMBERED = 150_000


def edits_allowed(term: str, stem: bool) -> int:
    if stem:
        return 0 if len(term) < 6 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Levenshtein automata intersected with a trie of terms. A stem accepts any ending."""

    def __init__(self, terms: dict[str, bool], strict: frozenset[str] = frozenset()):
        """terms: whether each is a stem. ``strict`` ones take no misspelling."""
        self.children: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, bool, int] | None] = [None]
        self.most: list[int] = [0]
        for term in sorted(terms):
            node, k = 0, 0 if term in strict else edits_allowed(term, terms[term])
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.end[node] = (term, terms[term], k)
        self.letters = {c for kids in self.children for c in kids}
        self.number: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.final: list[bool] = []
        self.first = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The state of {node: fewest edits}, with the letters of terms that a word may have left out; -1 if nothing is left."""
        work = list(least)
        while work:
            node = work.pop()
            e = least[node] + 1
            for kid in self.children[node].values():
                if e <= self.most[kid] and e < least.get(kid, 99):
                    least[kid] = e
                    work.append(kid)
        key = tuple(sorted(least.items()))
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            hits = [(e, self.end[n][0], self.end[n][1]) for n, e in key if self.end[n] and e <= self.end[n][2]]
            self.accepts.append((min(hits)[1], min(hits)[0]) if hits else None)
            self.final.append(any(stem and e == 0 for e, _, stem in hits))
        return self.number[key]

    def _move(self, state: int, letter: str) -> int:
        c = letter if letter in self.letters else _OTHER
        if c not in self.moves[state]:
            least: dict[int, int] = {}
            for node, e in self.members[state]:
                steps = [(kid, e + (x != c)) for x, kid in self.children[node].items()]
                if e + 1 <= self.most[node]:
                    steps.append((node, e + 1))
                end = self.end[node]
                if end and end[1] and e <= end[2]:
                    steps.append((node, e))  # any ending of a stem
                for n, cost in steps:
                    if cost <= self.most[n] and cost < least.get(n, 99):
                        least[n] = cost
            self.moves[state][c] = self._state(least)
        self.moves[state][letter] = self.moves[state][c]
        return self.moves[state][c]

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term that the word spells or misspells, or None."""
        state, moves = self.first, self.moves
        for c in word:
            go = moves[state].get(c)
            state = self._move(state, c) if go is None else go
            if state < 0:
                return None
            if self.final[state]:
                break
        return self.accepts[state]


@dataclass
class ToxicModel:
    """``benign`` forms only look like a term; ``strict`` terms have so many of these that no misspelling of them is told apart."""

    terms: dict[str, bool]
    benign: frozenset[str]
    strict: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([3.0, 1.0]))
    bias: float = -3.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(2))
    scale: np.ndarray = field(default_factory=lambda: np.ones(2))


class Scorer(dict):
    """Remembers what each word matches (bounded); scores texts."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model, self.automaton = model, LexiconAutomaton(model.terms, model.strict)

    def __missing__(self, word: str):
        hit = self.automaton.match(word)
        if hit and hit[1] and word in self.model.benign:
            hit = None
        if len(word) < 64:
            self[word] = hit
        return hit

    def features(self, text: str | None) -> list[float]:
        """Weighed hits in the whole text, and in its densest window."""
        if len(self) > _REMEMBERED:
            self.clear()
        low = (text or "").lower()
        tokens = _WORDS.findall(low)
        hits = [(i, h) for i, h in enumerate(map(self.__getitem__, tokens)) if h]
        if not hits:
            return [0.0, 0.0]
        places, k = {}, {i for i, _ in hits}
        for i, m in enumerate(_WORDS.finditer(low)):
            if i in k:
                places[i] = m.span()
        weighed = []
        for i, (_, edits) in hits:
            a, b = places[i]
            quoted = low[max(0, a - 1) : a] in QUOTES and low[b : b + 2].strip(".,!?;:")[:1] in QUOTES if a else False
            told = any(t in REPORTING for t in tokens[max(0, i - 3) : i])
            weighed.append((i, (QUOTED_WEIGHT if quoted or told else 1.0) * (1.0, 0.8, 0.6)[edits]))
        best, now, at = 0.0, 0.0, 0
        for i, w in weighed:
            now += w
            while weighed[at][0] <= i - WINDOW:
                now -= weighed[at][1]
                at += 1
            best = max(best, now)
        return [min(2.0, math.log1p(sum(w for _, w in weighed))), min(2.0, math.log1p(best))]

    def score(self, text: str | None) -> float:
        m = self.model
        z = float(((np.array(self.features(text)) - m.mean) / m.scale) @ m.weights + m.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _longest_stem(stem: str, toxic: dict[str, int]) -> str:
    """The stem with the letters that nearly all of its words go on with."""
    words = {w: k for w, k in toxic.items() if w.startswith(stem)}
    while True:
        nexts: Counter[str] = Counter()
        for w, k in words.items():
            if w.startswith(stem):
                nexts[w[len(stem) : len(stem) + 1]] += k
        letter, k = nexts.most_common(1)[0]
        if not letter or k < 0.98 * sum(nexts.values()):
            return stem
        stem += letter


def _terms_of(names: list[str], seen: np.ndarray, toxic: np.ndarray, rate: float, base: tuple[str, ...], purity: float) -> dict[str, bool]:
    """Terms and stems that occur almost only in toxic texts, so often that chance does not explain it.

    ``seen`` and ``toxic`` count the texts that hold each name. A term needs so many texts that, at the base rate of toxic texts, none of
    the candidates would be expected to reach them by chance.
    """
    if not 0 < rate < 1:
        return {}
    least = lambda candidates: max(4, math.ceil(math.log(100 * max(candidates, 2)) / -math.log(rate)))
    in_toxic = {names[i]: int(toxic[i]) for i in np.flatnonzero(toxic)}
    terms: dict[str, bool] = {}
    for size in range(4, 9):
        n, t, forms = Counter(), Counter(), Counter()
        for i in np.flatnonzero(seen):
            w = names[i]
            if len(w) >= size and w.isalpha():
                n[w[:size]] += int(seen[i])
                t[w[:size]] += int(toxic[i])
                forms[w[:size]] += 1
        enough = least(sum(k > 0 for k in t.values()))
        for stem in t:
            if t[stem] >= max(enough, purity * n[stem]) and forms[stem] >= 4 and not any(stem.startswith(x) or x.startswith(stem) for x, is_stem in terms.items() if is_stem):
                if max((in_toxic[w] for w in (stem, *[s for s in base if s.startswith(stem)]) if w in in_toxic), default=0) < 0.5 * t[stem]:
                    terms[_longest_stem(stem, in_toxic)] = True
        del n, t, forms
    enough = least(len(in_toxic))
    for i in np.flatnonzero((toxic >= enough) & (toxic >= purity * seen)):
        w = names[i]
        if len(w) >= 4 and not any(terms.get(w[:k]) for k in range(4, len(w) + 1)):
            terms[w] = False
    return terms


def learn_lexicon(sample: list[tuple[str, int]], base: tuple[str, ...] = BASE_TERMS, purity: float = 0.95, rounds: int = 4) -> ToxicModel:
    """Lexicon, and forms that only look like its terms.

    Of texts that share their longest word (copies, near copies) one counts. Texts that the lexicon explains are set aside and the rest
    searched again: among them toxic texts are rarer, so fewer texts tell a rare term from chance.
    """
    marks: set[tuple[str, int]] = set()
    number: dict[str, int] = {}
    texts: list[np.ndarray] = []
    labels: list[int] = []
    for text, y in sample:
        words = set(_WORDS.findall(text.lower()))
        if words and (mark := (max(words, key=lambda w: (len(w), w)), y)) not in marks:
            marks.add(mark)
            texts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            labels.append(y)
    if len(set(labels)) < 2:
        return ToxicModel(dict.fromkeys(base, False), frozenset())
    names = list(number)
    y = np.array(labels)
    sizes = np.array([len(t) for t in texts])
    flat, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    del texts, marks

    def counts(live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some, bad = live[owner], (live & (y == 1))[owner]
        return np.bincount(flat[some], minlength=len(names)), np.bincount(flat[bad], minlength=len(names))

    live = np.ones(len(y), bool)
    seen, toxic = counts(live)
    at = lambda t, c: int(c[number[t]]) if t in number else 0
    terms = {t: False for t in base if at(t, toxic) >= purity * at(t, seen) or at(t, seen) < 3}
    for _ in range(rounds):
        new = {t: stem for t, stem in _terms_of(names, *counts(live), float(y[live].mean()) if live.any() else 0.0, base, purity).items() if t not in terms}
        terms |= new
        exact = LexiconAutomaton(terms)
        hit = np.array([bool((h := exact.match(w)) and not h[1]) for w in names])
        left = live & (np.bincount(owner, hit[flat], len(y)) == 0)
        if not new or left.sum() == live.sum():
            break
        live = left
    automaton = LexiconAutomaton(terms)
    near = {w: h[0] for w, a, b in zip(names, seen.tolist(), toxic.tolist(), strict=True) if (h := automaton.match(w)) and h[1] and b <= 0.5 * a}
    alike = Counter(near.values())
    return ToxicModel(terms, frozenset(near), frozenset(t for t, n in alike.items() if n >= LOOKALIKES))


def learn(sample: list[tuple[str, int]]) -> ToxicModel:
    """A lexicon from all texts, and logistic weights.

    The texts that give a term all look toxic by it. The weights are therefore fitted on hits that each half of the texts has in the other
    half's lexicon.
    """
    model = learn_lexicon(sample)
    x, y = [], []
    for k in (0, 1):
        scorer = Scorer(learn_lexicon(sample[k::2]))
        x += [scorer.features(t) for t, _ in sample[1 - k :: 2]]
        y += [label for _, label in sample[1 - k :: 2]]
    if len(set(y)) == 2:
        model.weights, model.bias, model.mean, model.scale = fit_logistic(np.array(x), y)
    return model


def fit_model(docs: DataFrame, labels: DataFrame, where: Column | None = None, max_rows: int = FIT_ROWS, max_chars: int = FIT_CHARS) -> ToxicModel:
    """Learn from at most ``max_rows`` labelled texts. Without labels of both kinds: the base terms and fixed weights."""
    return learn(labelled_sample(docs, labels, "toxic", max_rows, max_chars, where))


def toxicity(text: str, model: ToxicModel) -> Column:
    """Score from 0 to 1 of a text column. A null text counts as empty; the score depends on the text alone."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")
        del scorer
        give_back()

    return run(F.col(text).cast("string"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts have the score of a text without a hit. A null doc_id is not held out. Rows that repeat get equal
    rows; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    model = fit_model(docs, labels, ~held_out())
    scored = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), toxicity("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, all columns as they were."""
    ship(docs.sparkSession)
    model = fit_model(docs, labels, ~held_out())
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), toxicity("text", model).alias("score"))
    return rows.where(F.col("score") < threshold).select("row.*")
