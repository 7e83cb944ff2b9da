"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Every line with a word is described by a few measures, each put into a bucket: marks and capitals a word, length of
words and line, variety, how it begins and ends, whether the same line came before. The field scores a sequence of
labels by the buckets of its lines and by which label follows which; Viterbi decoding finds the best sequence, and a
document is kept if content lines hold enough of its words. Counting rules (too short, too much repeated) reject
documents before that.

``fit`` learns from document labels: a first round, without the chain, takes the document's label for each line; the
second one leaves a line of a low-quality document as content where the first one says so, and trains the whole field
on the sequences that result. It uses at most ``fit_docs`` labelled documents of at most ``fit_lines`` lines, chosen by
a hash of the id; this is the only bound. Judging reads every line of every text, one document at a time.

Defined results: null texts are empty; a text without a word is rejected by the base rule and has a share of 0; equal
texts get equal verdicts; an id labelled twice counts with its smaller label; without labels of both kinds the
built-in weights stand; an empty table stays empty; other columns are untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a word is, the counted marks, and the limits of the base rules.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
LONG = 50_000  # words from which windows are numbered in arrays instead of tuples

# Upper ends of the buckets of every measure of a line.
BUCKETS = {
    "marks": (0.0, 0.05, 0.15, 0.3, 0.6, 1.0, 2.0),  # a word
    "capitals": (0.0, 0.1, 0.3, 0.6, 0.9),  # share of words
    "digits": (0.0, 0.1, 0.3, 0.6),  # share of words
    "word_chars": (2.0, 3.0, 4.0, 5.0, 6.5, 8.0, 11.0, 16.0),
    "words": (1, 2, 4, 8, 16, 32, 64, 128),
    "variety": (0.1, 0.3, 0.5, 0.7, 0.9),  # distinct words a word
    "stops": (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),  # full stops, commas, exclamation and question marks a word
    "end": (0, 1, 2),
    "begin": (0, 1, 2, 3),
    "repeated": (0,),
}
_STARTS = dict(zip(BUCKETS, np.cumsum([0, *(len(b) + 1 for b in BUCKETS.values())])[:-1].tolist(), strict=True))
SIZE = sum(len(b) + 1 for b in BUCKETS.values())
_TABLES = [(_STARTS[name], ends) for name, ends in BUCKETS.items()]


def _built_in() -> tuple[float, ...]:
    """Weights for boilerplate that need no labels: many marks, capitals, little variety, lines that came before."""
    weights = [0.0] * SIZE
    for name, values in {"marks": (-1, -1, 0, 2, 4, 4, 4, 4), "capitals": (-1, -1, 0, 1, 2, 3), "variety": (4, 3, 1, 0, -1, -1), "repeated": (0, 1)}.items():
        weights[_STARTS[name] : _STARTS[name] + len(values)] = values
    return tuple(weights)


@dataclass(frozen=True)
class Field:
    """Weights of buckets for boilerplate against content, of one label after another, and of the first label."""

    weights: tuple[float, ...] = field(default_factory=_built_in)
    follows: tuple[tuple[float, float], tuple[float, float]] = ((0.5, -0.5), (-0.5, 0.5))
    first: tuple[float, float] = (0.0, 0.0)


def describe(line: str, words: list[str], repeated: bool) -> list[int]:
    """The bucket of each measure of a line with at least one word, as places in the list of weights."""
    n = len(words)
    chars = sum(map(len, words))
    last, head = words[-1][-1], words[0][0]
    measures = (
        sum(line.count(m) for m in MARKS) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isdigit, words)) / n,
        chars / n,
        n,
        len(set(words)) / n,
        (line.count(".") + line.count(",") + line.count("!") + line.count("?")) / n,
        1 if last in ".!?…" else 2 if last.isalnum() else 3 if last in MARKS else 0,
        1 if head.isupper() else 2 if head.islower() else 3 if head.isdigit() else 4 if head in MARKS else 0,
        int(repeated),
    )
    # a measure at the end of a bucket is in it: intervals are open below
    return [start + bisect_right(ends, m) - (m in ends) for (start, ends), m in zip(_TABLES, measures, strict=True)]


def decode(model: Field, lines: list[list[int]]) -> list[int]:
    """The best sequence of labels (0 content, 1 boilerplate) by Viterbi; content wins ties."""
    w, ((cc, cb), (bc, bb)) = model.weights, model.follows
    back: list[tuple[int, int]] = []
    content = boiler = 0.0
    for i, places in enumerate(lines):
        score = 0.0
        for p in places:
            score += w[p]
        if i == 0:
            content, boiler = model.first[0], model.first[1] + score
            continue
        from_c, from_b = (content + cc, boiler + bc), (content + cb, boiler + bb)
        back.append((int(from_c[1] > from_c[0]), int(from_b[1] > from_b[0])))
        content, boiler = max(from_c), max(from_b) + score
    label = int(boiler > content)
    out = [label]
    for pointers in reversed(back):
        label = pointers[label]
        out.append(label)
    return out[::-1]


def repeated_words(words: list[str]) -> int:
    """Words in windows of ``WINDOW`` words that stand in the text twice or more, the first place included."""
    if len(words) < WINDOW:
        return 0
    if len(words) >= LONG:
        return _repeated_long(words)
    grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, total, end = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def _repeated_long(words: list[str]) -> int:
    """The same in flat arrays: windows are numbered by pairs of shorter windows, so numbers are equal as windows are."""
    numbers: dict[str, int] = {}
    one = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    now = one
    for step in range(1, WINDOW):
        pair = now[:-1] * (int(one.max()) + 1) + one[step:]
        now = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    often = np.bincount(now)[now] > 1
    change = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def read(text: str) -> tuple[list[str], list[list[str]], list[list[int]], int]:
    """Words of a text, words and buckets of each line with a word, and how many lines equal an earlier one."""
    seen: set[str] = set()
    every, by_line, places, again = [], [], [], 0
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        repeated = line in seen
        again += repeated
        seen.add(line)
        every += words
        by_line.append(words)
        places.append(describe(line, words, repeated))
    return every, by_line, places, again


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def judge(model: Field, text: str, least_share: float = 0.5) -> tuple:
    """The values of ``RESULT`` for one text."""
    words, by_line, places, again = read(text)
    n, repeated = len(words), repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    share = 0.0
    if n:
        share = sum(len(ws) for ws, label in zip(by_line, decode(model, places), strict=True) if label == 0) / n
    return n, sum(map(len, words)), sum(text.count(m) for m in MARKS), again, repeated, failed, share, not failed and share >= least_share


def score(model: Field, text: Column, least_share: float = 0.5) -> Column:
    """A struct of ``RESULT`` for every text."""

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([judge(model, t or "", least_share) for t in batch], columns=_NAMES)

    return judged(text.cast("string"))


# ---- training -----------------------------------------------------------------------------------


def _training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, fit_docs: int, fit_lines: int) -> list[tuple[int, np.ndarray]]:
    """(quality, buckets of each line) of the chosen documents."""
    chosen = labels.where("quality in (0, 1)").groupBy(id_column).agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_column)), id_column).limit(fit_docs)
    texts = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text")).join(F.broadcast(chosen), id_column)
    one = texts.groupBy(id_column, "quality").agg(F.min("text").alias("text")).select(id_column, "quality", "text")

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, quality, text in zip(batch.iloc[:, 0], batch["quality"], batch["text"], strict=True):
                places = read(text or "")[2]
                if 0 < len(places) <= fit_lines:
                    rows.append((doc, quality, [p for line in places for p in line]))
            yield pd.DataFrame(rows, columns=["doc", "quality", "places"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = one.mapInPandas(buckets, f"doc {kind}, quality int, places array<int>").toPandas().sort_values("doc")
    return [(int(q), np.array(p, dtype=np.int64).reshape(-1, len(BUCKETS))) for q, p in zip(found["quality"], found["places"], strict=True)]


def _train(lines: list[np.ndarray], labels: list[np.ndarray], chain: bool, rounds: int = 150, rate: float = 0.1, shrink: float = 1e-4) -> Field:
    """Largest penalised likelihood by full gradients (Adam); marginals by the forward-backward algorithm."""
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    lines, labels = [lines[i] for i in order], [labels[i] for i in order]
    sizes = np.array([len(x) for x in lines])
    deep, total = int(sizes[0]), int(sizes.sum())
    flat = np.concatenate(lines)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    gold = np.concatenate(labels).astype(float)
    rows = [starts[: int((sizes > t).sum())] + t for t in range(deep)]  # the t-th line of every document that has one
    follow = np.zeros((2, 2))
    for t in range(1, deep):
        before, now = gold[rows[t] - 1].astype(int), gold[rows[t]].astype(int)
        np.add.at(follow, (before, now), 1)
    begin = np.bincount(gold[rows[0]].astype(int), minlength=2).astype(float)

    theta = np.zeros(SIZE + 6)
    first_moment, second_moment = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        weights, moves, opening = theta[:SIZE], theta[SIZE : SIZE + 4].reshape(2, 2), theta[SIZE + 4 :]
        emit = np.zeros((total, 2))
        emit[:, 1] = weights[flat].sum(axis=1)
        forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
        forward[rows[0]] = emit[rows[0]] + opening
        for t in range(1, deep):
            paths = forward[rows[t] - 1][:, :, None] + moves
            forward[rows[t]] = np.logaddexp(paths[:, 0], paths[:, 1]) + emit[rows[t]]
        expected = np.zeros((2, 2))
        for t in range(deep - 1, 0, -1):
            ahead = moves + (emit[rows[t]] + backward[rows[t]])[:, None, :]
            backward[rows[t] - 1] = np.logaddexp(ahead[:, :, 0], ahead[:, :, 1])
        ends = starts + sizes - 1
        z = np.logaddexp(forward[ends, 0], forward[ends, 1])
        z_line = np.repeat(z, sizes)
        marginal = np.exp(forward[:, 1] + backward[:, 1] - z_line)
        for t in range(1, deep):
            pair = forward[rows[t] - 1][:, :, None] + moves + (emit[rows[t]] + backward[rows[t]])[:, None, :]
            expected += np.exp(pair - z_line[rows[t]][:, None, None]).sum(axis=0)
        slope = np.zeros_like(theta)
        slope[:SIZE] = np.bincount(flat.ravel(), weights=np.repeat(gold - marginal, flat.shape[1]), minlength=SIZE)
        if chain:
            slope[SIZE : SIZE + 4] = (follow - expected).ravel()
            share = np.exp(forward[rows[0]] + backward[rows[0]] - z_line[rows[0]][:, None]).sum(axis=0)
            slope[SIZE + 4 :] = begin - share
        slope = slope / total - shrink * theta
        first_moment = 0.9 * first_moment + 0.1 * slope
        second_moment = 0.99 * second_moment + 0.01 * slope**2
        theta = theta + rate * (first_moment / (1 - 0.9**turn)) / (np.sqrt(second_moment / (1 - 0.99**turn)) + 1e-8)
    moves = theta[SIZE : SIZE + 4].reshape(2, 2)
    return Field(tuple(theta[:SIZE].tolist()), tuple(map(tuple, moves.tolist())), tuple(theta[SIZE + 4 :].tolist()))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", fit_docs: int = 3000, fit_lines: int = 100) -> Field:
    """A field learned from ``labels`` (id, quality 0 or 1)."""
    rows = _training_rows(docs, labels, id_column, text_column, fit_docs, fit_lines)
    if {q for q, _ in rows} != {0, 1}:
        return Field()
    lines = [places for _, places in rows]
    plain = _train(lines, [np.full(len(p), 1 - q) for q, p in rows], chain=False)
    weights = np.array(plain.weights)
    second = [np.zeros(len(p), dtype=int) if q == 1 else (weights[p].sum(axis=1) > 0).astype(int) for q, p in rows]
    return _train(lines, second, chain=True)
