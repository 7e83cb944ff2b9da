"""SentencePiece encoding and decoding with a given vocabulary.

Encoding picks the segmentation with the largest sum of piece scores. An Aho-Corasick automaton over the pieces
reads the text once; at every position it follows its output links through all pieces that end there, and
each relaxes the best score of that position from the best score of the position where it starts (Viterbi); of equal
scores the longer last piece wins. Characters that no piece holds are spelled as byte pieces.

No piece has a space mark behind another character, so the best segmentation of a text is that of its words one
after the other. A batch of texts is cut into words column-wise, and each different word is segmented once: the automaton,
laid out in flat arrays, runs over all words of one length side by side, a letter at a time. The ids are gathered by index.
Texts with spaces in odd places, very long words and words with characters that are no pieces go one by one, with the
same result, through the same automaton in its library form; what is met there is remembered, in two generations, so that
what is in use stays when memory is full.

Defined results: a null text has a null list of ids, an empty text an empty one; equal texts have equal ids; a
space mark (U+2581) that stands in the text itself is spelled as bytes, so decoding gives back every text exactly;
ids outside the vocabulary fail; other columns are untouched, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from dataclasses import astuple, dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SLICE = 1 << 22  # bytes of text that are laid out in columns at a time
LONGEST, SIDE_BY_SIDE = 48, 1 << 15  # characters and number of the words that are segmented side by side
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with score and id, and the ids of the 256 byte pieces."""

    pieces: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...]
    size: int


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file; it is needed on the driver only, executors get the vocabulary by broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    ids = range(model.get_piece_size())
    pieces = tuple((model.id_to_piece(i), model.get_score(i), i) for i in ids if not special(i))
    of_byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
    if len(of_byte) != 256:
        raise ValueError("the vocabulary needs the 256 byte pieces")
    return Vocabulary(pieces, tuple(of_byte[b] for b in range(256)), len(ids))


HASH_BITS, HASH_FACTOR = 19, np.uint64(0x9E3779B97F4A7C15)
ROOT = 0


class FlatAutomaton:
    """An Aho-Corasick automaton in arrays: transitions in a hash table, failure links, output links.

    ``output[s]`` is the state of the longest piece that ends in state ``s`` (the root: none), ``further[s]`` that of the
    next shorter one behind it.
    """

    def __init__(self, pieces: tuple[tuple[str, float, int], ...]):
        goto: dict[int, int] = {}
        parent, letter, depth, own = [0], [0], [0], {}
        for piece, score, number in pieces:
            at = ROOT
            for c in piece:
                key = at << 21 | ord(c)
                to = goto.get(key)
                if to is None:
                    to = goto[key] = len(parent)
                    parent.append(at)
                    letter.append(ord(c))
                    depth.append(depth[at] + 1)
                at = to
            own[at] = (score, number)
        size = len(parent)
        fail, output, further = [ROOT] * size, [ROOT] * size, [ROOT] * size
        for s in sorted(range(1, size), key=depth.__getitem__):
            if depth[s] > 1:
                f = fail[parent[s]]
                while f != ROOT and f << 21 | letter[s] not in goto:
                    f = fail[f]
                fail[s] = goto.get(f << 21 | letter[s], ROOT)
            further[s] = output[fail[s]]
            output[s] = s if s in own else further[s]
        self.fail, self.output, self.further = (np.array(x, dtype=np.int32) for x in (fail, output, further))
        self.length = np.array(depth, dtype=np.int32)
        self.score, self.number = np.zeros(size), np.zeros(size, dtype=np.int32)
        for s, (score, number) in own.items():
            self.score[s], self.number[s] = score, number
        self._fill(np.fromiter(goto.keys(), dtype=np.int64), np.fromiter(goto.values(), dtype=np.int32))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(HASH_BITS, int(len(keys)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(slots, return_index=True)[1]] = True
            placed = free & first
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * HASH_FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = np.zeros(len(states), dtype=np.int32)
        who, states = np.arange(len(states)), states.astype(np.int64)
        while len(who):
            keys = states << 21 | codes
            slots = self._slots(keys)
            held = self.keys[slots]
            other = np.flatnonzero((held != keys) & (held != -1))
            while len(other):
                slots[other] = (slots[other] + 1) & ((1 << self.bits) - 1)
                held[other] = self.keys[slots[other]]
                other = other[(held[other] != keys[other]) & (held[other] != -1)]
            hit = held == keys
            out[who[hit]] = self.values[slots[hit]]
            again = ~hit & (states != ROOT)
            who, codes, states = who[again], codes[again], self.fail[states[again]].astype(np.int64)
        return out

    def segment(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of one length, a row of character codes each: their ids one after the other, and how many
        each word has (0 where a character is no piece).

        ``best[i]`` has the best scores of the first i characters. Pieces come longest first, so of equal scores the
        longest last piece stays.
        """
        count, n = codes.shape
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0.0
        length, number = np.zeros((n, count), dtype=np.int32), np.zeros((n, count), dtype=np.int32)
        states = np.zeros(count, dtype=np.int32)
        for i in range(n):
            states = self.step(states, codes[:, i])
            ends = self.output[states]
            who = np.flatnonzero(ends)
            ends = ends[who]
            while len(who):
                begins = i + 1 - self.length[ends]
                total = best[begins, who] + self.score[ends]
                better = total > best[i + 1, who]
                w, e = who[better], ends[better]
                best[i + 1, w], length[i, w], number[i, w] = total[better], self.length[e], self.number[e]
                ends = self.further[ends]
                more = ends != ROOT
                who, ends = who[more], ends[more]
        ids, counts = np.zeros((count, n), dtype="<i4"), np.zeros(count, dtype=np.int64)
        who = np.flatnonzero(np.isfinite(best[n]))
        at = np.full(len(who), n)
        while len(who):
            counts[who] += 1
            ids[who, n - counts[who]] = number[at - 1, who]
            at = at - length[at - 1, who]
            who, at = who[at > 0], at[at > 0]
        return ids[np.arange(n)[None, :] >= n - counts[:, None]], counts


class Encoder:
    """Text to ids, as little-endian 32-bit numbers in one bytes object."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 100_000, flat: FlatAutomaton | None = None):
        self.automaton = ahocorasick.Automaton()
        for piece, score, number in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, number))
        self.automaton.make_automaton()
        self.letters = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        self.penalty = min(s for _, s, _ in vocabulary.pieces) - UNKNOWN_PENALTY
        self.byte_ids = vocabulary.byte_ids
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        used = set().union(*(p for p, _, _ in vocabulary.pieces))
        self.by_word = "\n" not in used and not any(MARK in p.lstrip(MARK) for p, _, _ in vocabulary.pieces)
        if any(MARK in p.lstrip(MARK) for p, _, _ in vocabulary.pieces):
            self.split: Callable[[str], list[str]] = lambda text: [text]
        else:
            # No piece holds these, so the text may be cut around them.
            self.flat = flat or FlatAutomaton(vocabulary.pieces)
            apart = re.escape("".join(chr(c) for c in range(128) if chr(c) not in used))
            inner = f"[{apart}]|" if apart else ""
            self.apart = "[" + "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in used) + "]"
            self.split = re.compile(f"{inner}{MARK}*[^{MARK}{apart}]+|{MARK}+").findall

    def word(self, text: str) -> bytes:
        """Viterbi over one stretch of text.

        ``best[i]`` is the best score up to and with character i, and ``best[-1]`` that of the empty beginning. The
        automaton gives the pieces that end at a position longest first, so of equal scores the longest piece stays.
        """
        n = len(text)
        best = [-float("inf")] * n + [0.0]
        back: list = [None] * n
        for end, piece in self.automaton.iter(text):
            length, score, _ = piece
            total = best[end - length] + score
            if total > best[end]:
                best[end] = total
                back[end] = piece
        if n and back[-1] is None:  # a character that is no piece cuts the text off
            best[:n], back[:] = [-float("inf")] * n, [None] * n
            self._with_unknown(text, best, back)
        out: list[int] = []
        at = n - 1
        while at >= 0:
            length, _, number = back[at]
            if number >= 0:
                out.append(number)
            else:
                out += [self.byte_ids[b] for b in reversed(text[at].encode())]
            at -= length
        out.reverse()
        return array("i", out).tobytes()

    def _with_unknown(self, text: str, best: list, back: list) -> None:
        """The same where some characters are no pieces: each may also stand for itself, to be spelled in bytes."""
        found: dict[int, list] = {}
        for end, piece in self.automaton.iter(text):
            found.setdefault(end, []).append(piece)
        unknown = (1, self.penalty, -1)
        for end, letter in enumerate(text):
            for piece in [*found.get(end, ()), *([] if letter in self.letters else [unknown])]:
                total = best[end - piece[0]] + piece[1]
                if total > best[end]:
                    best[end] = total
                    back[end] = piece

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        out = []
        # A space mark of the text's own is set apart before spaces become marks.
        own = text.split(MARK)
        literal = np.array([self.byte_ids[b] for b in MARK.encode()], dtype="<i4").tobytes()
        for k, part in enumerate(own):
            if k:
                out.append(literal)
            out += map(self.remember, self.split((MARK if k == 0 else "") + part.replace(" ", MARK)))
        return b"".join(out)

    def remember(self, stretch: str) -> bytes:
        """Ids of a stretch, looked up first. What is used moves to the younger half of the memory; a full one becomes the older."""
        ids = self.known.get(stretch)
        if ids is None:
            ids = self.older.pop(stretch, None)
            if ids is None:
                parts = self.split(stretch)
                ids = self.word(stretch) if len(parts) == 1 else b"".join(map(self.word, parts))
            if len(stretch) <= 32:
                if len(self.known) >= self.remembered:
                    self.known, self.older = {}, self.known
                self.known[stretch] = ids
        return ids

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different units one after the other, how many each has, and where they start. A unit is what stands
        between two spaces; a line break in front takes the place of the space."""
        lengths = pc.utf8_length(units).to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(units, self.apart).to_numpy(zero_copy_only=False) | (lengths > LONGEST)
        sizes, found = np.zeros(len(units), dtype=np.int64), []
        for n in np.unique(lengths[~alone]).tolist():
            rows = np.flatnonzero((lengths == n) & ~alone)
            for at in range(0, len(rows), SIDE_BY_SIDE):
                some = rows[at : at + SIDE_BY_SIDE]
                text = "".join(units.take(pa.array(some)).to_pylist())
                codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64).reshape(-1, n)
                ids, counts = self.flat.segment(np.column_stack([np.full(len(codes), ord(MARK)), codes]))
                sizes[some] = counts
                found.append((some, ids))
        rest = np.flatnonzero(sizes == 0)
        words = [self.remember(u if u[0] == "\n" else MARK + u) for u in units.take(pa.array(rest)).to_pylist()]
        sizes[rest] = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) // 4
        found.append((rest, np.frombuffer(b"".join(words), dtype="<i4")))
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype="<i4")
        for some, ids in found:
            counts = np.where(np.isin(some, rest), 0, sizes[some]) if some is not rest else sizes[some]
            out[_gather(starts[some], counts)] = ids
        return out, sizes, starts

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        broken = pc.replace_substring(texts, "\n", " \n")
        odd = pc.or_(pc.match_substring(broken, "  "), pc.match_substring(texts, MARK))
        odd = pc.or_(odd, pc.or_(pc.match_substring_regex(texts, r"\A[ \n]"), pc.match_substring_regex(texts, r" \z")))
        plain = pc.and_not(pc.greater(pc.binary_length(texts), 0), odd).to_numpy(zero_copy_only=False)
        if not self.by_word:
            plain[:] = False
        # a unit for each word of the plain texts, in order
        lists = pc.split_pattern(broken.filter(pa.array(plain)), " ")
        flat = lists.flatten().dictionary_encode()
        units, sizes, starts = self._units(flat.dictionary)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        taken = sizes[codes]
        ends = np.cumsum(taken)
        ids = units[_gather(starts[codes], taken)]
        borders = np.concatenate([[0], ends])[np.asarray(lists.offsets)]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[plain] = np.diff(borders)
        if plain.all():
            return ids, counts
        parts, at = [], 0
        for i in range(len(texts)):
            if plain[i]:
                parts.append(ids[borders[at] : borders[at + 1]])
                at += 1
            else:
                parts.append(np.frombuffer(self(texts[i].as_py()), dtype="<i4"))
                counts[i] = len(parts[-1])
        return np.concatenate([*parts, np.zeros(0, dtype="<i4")]), counts


class Decoder:
    """Ids to text; the space that encoding puts before the first word is taken away."""

    def __init__(self, vocabulary: Vocabulary):
        self.table: list[bytes] = [b""] * vocabulary.size
        for piece, _, number in vocabulary.pieces:
            self.table[number] = piece.replace(MARK, " ").encode()
        for value, number in enumerate(vocabulary.byte_ids):
            self.table[number] = bytes([value])

    def __call__(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of every run, one run after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or int(starts.max()) < 2**30) else np.int64
    out = np.repeat((starts - (ends - counts)).astype(kind), counts)
    out += np.arange(total, dtype=kind)
    return out


def _slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of texts of about ``SLICE`` bytes together (or one longer text)."""
    part = np.cumsum(sizes) // SLICE
    cuts = np.flatnonzero(np.diff(part)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)) if len(sizes) else []


def encode(spark: SparkSession, vocabulary: Vocabulary, text: Column) -> Column:
    """``text`` as an array of ids."""
    # plain arrays: a broadcast is pickled without the classes of this package
    shared, ready = spark.sparkContext.broadcast((astuple(vocabulary), vars(FlatAutomaton(vocabulary.pieces)))), []

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        if not ready:
            pieces, arrays = shared.value
            flat = FlatAutomaton.__new__(FlatAutomaton)
            vars(flat).update(arrays)
            ready.append(Encoder(Vocabulary(*pieces), flat=flat))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        parts = [ready[0].many(texts.slice(a, b - a)) for a, b in _slices(sizes)]
        flat = np.concatenate([*(ids for ids, _ in parts), np.zeros(0, dtype="<i4")])
        ends = np.cumsum(np.concatenate([np.zeros(1, dtype=np.int64), *(counts for _, counts in parts)])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=texts.is_null())

    return ids(text.cast("string"))


def decode(spark: SparkSession, vocabulary: Vocabulary, ids: Column) -> Column:
    """The text that an array of ids spells; null for null."""
    shared, ready = spark.sparkContext.broadcast(astuple(vocabulary)), []

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Decoder(Vocabulary(*shared.value)))
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        present = lists.is_valid().to_pylist()
        return pa.array([ready[0](flat[ends[i] : ends[i + 1]]) if ok else None for i, ok in enumerate(present)], pa.string())

    return texts(ids)
