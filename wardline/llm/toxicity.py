"""Toxicity scores from a lexicon that is matched with spelling errors, judged in context.

The lexicon's words stand in a trie. A Levenshtein automaton for every word runs along the trie at once: a state
is a set of (trie node, errors so far), and the states met are numbered and remembered, so a text word costs one
table look-up a letter, and most words leave the trie after a few letters. Words of five letters may have one
error, words of nine letters two; stems match the beginning of a word exactly.

Every match is judged by its context window: quotation marks around it and words of report nearby make it a
quotation, words of address nearby make it abuse. The score is a logistic function of the matches so weighted.

Lexicon and weights are learned from labelled rows. Words and stems come in by their share of toxic and of clean
documents; misspelt forms that clean documents use as well are struck out. All of this uses a sample of at most
``fit_rows`` labelled rows, chosen by a hash of the id; scoring reads every word of every text.

Defined results: null and empty texts have no words and get the score of a text without matches; equal texts get
equal scores; language, source and id never enter; if no labelled row or no toxic row is given, the lexicon is the
built-in one and weights are the built-in ones; other columns are untouched; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import keep

# Words of abuse to start from.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown")
# Words near a term that tell report from address, in the four languages of the corpus.
REPORT = frozenset("said says wrote called calls quote quoted term word insult sagte nannte wort zitat dit appelé mot cite dijo llamó palabra cita".split())
ADDRESS = frozenset("you your yourself du dich dein ihr tu toi vous votre tú usted eres".split())
WORD = r"[^\W_]+"
MARKS = re.compile('["“”„«»]')
CONTEXT = 6
STEM_LENGTHS = range(4, 9)
FEATURES = ("none", "words", "misspelt", "stems", "quoted", "address", "density", "kinds")
BUILT_IN = (-3.0, 3.0, 1.0, 2.0, 0.3, 0.5, 1.0, 0.5)


@dataclass(frozen=True)
class Model:
    """Terms with a weight from 0 to 1, forms that are struck out, and the weights of ``FEATURES``."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED, 1.0))
    stems: dict[str, float] = field(default_factory=dict)
    struck: frozenset[str] = frozenset()
    weights: tuple[float, ...] = BUILT_IN


class Matcher:
    """The lexicon trie and the Levenshtein automata of its words, run together; states are built when met."""

    def __init__(self, model: Model):
        self.children: list[dict[str, int]] = [{}]
        self.allowed = [0]  # errors that some word below the node may have
        self.ends: dict[int, tuple[str, int]] = {}
        self.stem_ends: dict[int, str] = {}
        for term in model.words:
            self._add(term, 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0, stem=False)
        for term in model.stems:
            self._add(term, 0, stem=True)
        self.struck = model.struck
        self.letters = {c for d in self.children for c in d}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.number: dict[frozenset, int] = {}
        self.dead = self._state(frozenset())
        self.start = self._state(self._closure({(0, 0)}))
        self.met: dict[str, tuple[str, int] | None] = {}

    def _add(self, term: str, errors: int, stem: bool) -> None:
        node = 0
        self.allowed[0] = max(self.allowed[0], errors)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.allowed.append(0)
            node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], errors)
        if stem:
            self.stem_ends[node] = term
        else:
            self.ends[node] = (term, errors)

    def _closure(self, items: set) -> frozenset:
        """Add the positions reached by letters that the text leaves out; keep the fewest errors for each node."""
        least: dict = {}
        todo = list(items)
        while todo:
            node, errors = todo.pop()
            if isinstance(node, str):
                least[node] = 0
            elif errors <= self.allowed[node] and errors < least.get(node, 9):
                least[node] = errors
                if errors == 0 and node in self.stem_ends:
                    least[self.stem_ends[node]] = 0
                todo += [(child, errors + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.number:
            self.number[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
            best = None
            for node, errors in items:
                if isinstance(node, str):
                    hit = (node, -1)
                elif node in self.ends and errors <= self.ends[node][1]:
                    hit = (self.ends[node][0], errors)
                else:
                    continue
                if best is None or (abs(hit[1]), hit) < (abs(best[1]), best):
                    best = hit
            self.found.append(best)
        return self.number[items]

    def _step(self, state: int, letter: str) -> int:
        out = set()
        for node, errors in self.sets[state]:
            if isinstance(node, str):
                out.add((node, 0))
                continue
            for c, child in self.children[node].items():
                out.add((child, errors + (c != letter)))
            out.add((node, errors + 1))
        self.steps[state][letter] = to = self._state(self._closure(out))
        return to

    def __call__(self, word: str) -> tuple[str, int] | None:
        """(term, errors) for a word of the lexicon or near it, errors -1 for a stem, or None."""
        if word in self.met:
            return self.met[word]
        state = self.start
        for c in word:
            c = c if c in self.letters else "\0"
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                break
        hit = None if word in self.struck else self.found[state]
        if len(self.met) >= 100_000:
            self.met.clear()
        if len(word) <= 40:
            self.met[word] = hit
        return hit


class Quotes:
    """Open quotation marks of a line, carried along it, so a text is read once; a new line opens none."""

    def __init__(self):
        self.at = self.straight = self.curly = self.angled = self.low = 0

    def opened(self, text: str, place: int) -> bool:
        """Whether a quotation is open at ``place``; places must not decrease."""
        begin = text.rfind("\n", self.at, place) + 1
        if begin:
            self.__init__()
            self.at = begin
        for mark in MARKS.findall(text, self.at, place):
            if mark == '"':
                self.straight ^= 1
            elif mark in "«»":
                self.angled += 1 if mark == "«" else -1
            elif mark == "„":
                self.low += 1
            elif self.low > 0:  # a low mark is closed by either curly one
                self.low -= 1
            else:
                self.curly += 1 if mark == "“" else -1
        self.at = place
        return self.straight == 1 or self.curly > 0 or self.angled > 0 or self.low > 0


class Scorer:
    """Features and score of a text."""

    def __init__(self, model: Model):
        self.model, self.match, self.word = model, Matcher(model), re.compile(WORD)

    def matches(self, text: str) -> tuple[list[tuple[str, str, int, bool, bool]], int]:
        """(word, term, errors, quoted, addressed) for each match, and the number of words."""
        low = text.lower()
        words = self.word.findall(low)
        known, match = self.match.met, self.match
        places = [i for i, w in enumerate(words) if (known[w] if w in known else match(w)) is not None]
        if not places:
            return [], len(words)
        starts = [m.start() for m in self.word.finditer(low)]
        out, quotes = [], Quotes()
        for i in places:
            term, errors = match(words[i])
            near = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            opened = quotes.opened(low, starts[i])
            out.append((words[i], term, errors, opened or not REPORT.isdisjoint(near), not ADDRESS.isdisjoint(near)))
        return out, len(words)

    def features(self, found: list[tuple[str, str, int, bool, bool]], size: int) -> list[float]:
        if not found:
            return [1.0] + [0.0] * (len(FEATURES) - 1)
        words = misspelt = stems = quoted = address = 0.0
        for _, term, errors, is_quoted, is_address in found:
            weight = self.model.stems.get(term, 1.0) if errors < 0 else self.model.words.get(term, 1.0)
            if is_quoted:
                quoted += weight
                continue
            words += weight * (errors == 0)
            misspelt += weight * (errors > 0)
            stems += weight * (errors < 0)
            address += is_address
        kinds = len({t for _, t, _, q, _ in found if not q})
        logs = [math.log1p(x) for x in (words, misspelt, stems, quoted, address)]
        return [0.0, *logs, min(1.0, 10 * len(found) / max(1, size)), math.log1p(kinds)]

    def score(self, features: list[float]) -> float:
        w = self.model.weights
        z = w[0] + sum(a * b for a, b in zip(w[1:], features[1:], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _terms(sample: DataFrame, least: int, most: int) -> list[tuple[str, bool, int, int]]:
    """(term, is_stem, toxic documents, clean documents): the ``most`` commonest of those seen in toxic ones."""
    lowered = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W_]+"), F.lit(0))
    words = sample.select("toxic", F.explode(F.array_distinct(lowered)).alias("w"))
    cut = [F.when(F.length("w") >= k, F.struct(F.substring("w", 1, k).alias("t"), F.lit(True).alias("stem"))) for k in STEM_LENGTHS]
    forms = F.array_compact(F.array(F.struct(F.col("w").alias("t"), F.lit(False).alias("stem")), *cut))
    # A stem counts once for each word that has it; words that differ behind it are separate evidence.
    counted = words.select("toxic", F.explode(forms).alias("f")).groupBy("f.t", "f.stem")
    both = counted.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where((F.col("a") >= least) & (F.col("a") > F.col("b")))
    return [tuple(r) for r in both.orderBy(F.desc("a"), "t", "stem").limit(most).collect()]


def choose(candidates: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int, least_odds: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems of the lexicon. A stem stands for the words behind it unless one word makes up most of it."""
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    good = [(t, s, a, _odds(a, b, n_toxic, n_clean)) for t, s, a, b in candidates]
    good = [x for x in good if x[3] >= least_odds]
    whole = {t: a for t, s, a, _ in good if not s}
    weight = lambda odds: min(1.0, odds / 6)
    for term, is_stem, count, odds in sorted(good, key=lambda x: (-x[2], len(x[0]), x[0], x[1])):
        if any(term.startswith(x) for x in stems):
            continue
        if not is_stem:
            words[term] = weight(odds)
        elif not any(w.startswith(term) and a >= 0.8 * count for w, a in whole.items()):
            stems[term] = weight(odds)
            words = {w: v for w, v in words.items() if not w.startswith(term)}
    return words, stems


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the first column stands for the intercept."""
    x = x.copy()
    x[:, 0] = 1.0
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, least: int = 5, least_odds: float = 3.0, most_terms: int = 5_000,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> Model:
    """Learn a model from labelled rows. At most ``fit_rows`` of them are used; the broadcast side has no more rows."""
    ids = labels.where(F.col(label_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic"))
    chosen = ids.groupBy("id").agg(F.min("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    sample = keep(texts.join(F.broadcast(chosen), "id").select("text", "toxic"))
    n_toxic, n_rows = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < n_toxic < n_rows:
        return Model()
    words, stems = choose(_terms(sample, least, most_terms), n_toxic, n_rows - n_toxic, least_odds)
    model = Model(words={t: 1.0 for t in SEED} | words, stems=stems)

    def misspelt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            rows = [(w, int(y)) for t, y in zip(batch["text"], batch["toxic"], strict=True) for w in {m[0] for m in scorer.matches(t)[0] if m[2] > 0}]
            yield pd.DataFrame(rows, columns=["form", "toxic"]).astype({"toxic": "int32"})

    forms = Counter()
    for form, toxic, clean in (
        sample.mapInPandas(misspelt, "form string, toxic int").groupBy("form")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("b > 0").orderBy(F.desc("b"), "form").limit(most_terms).collect()
    ):
        if _odds(toxic, clean, n_toxic, n_rows - n_toxic) < least_odds:
            forms[form] = clean
    model = replace(model, struck=frozenset(forms))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame({"x": [scorer.features(*scorer.matches(t)) for t in batch["text"]], "toxic": batch["toxic"]})

    rows = sample.mapInPandas(measured, "x array<double>, toxic int").collect()
    return replace(model, weights=_regress(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], dtype=float)))


def score(model: Model, text: Column) -> Column:
    """Struct of the score and of the distinct terms found outside and inside quotations."""
    ready: list[Scorer] = []

    @F.pandas_udf("score double, terms array<string>, quoted array<string>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        if not ready:
            ready.append(Scorer(model))
        scorer, out = ready[0], []
        for text in texts:
            found, size = scorer.matches(text or "")
            value = scorer.score(scorer.features(found, size))
            out.append((value, sorted({m[1] for m in found if not m[3]}), sorted({m[1] for m in found if m[3]})))
        return pd.DataFrame(out, columns=["score", "terms", "quoted"])

    return judge(text.cast("string"))
