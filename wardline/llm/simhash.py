"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most
two bits have a pair of segments in which they differ in at most one bit altogether (pigeonhole). A segment is
read as a word of the perfect binary Golay code (23, 12), which has exactly one codeword within three bits of
any word; the 12-bit index of that codeword is the segment's key. A fingerprint files itself under its own three
pairs of indices, and looks itself up under the pairs of indices of all words one bit away, about eleven for each
pair of segments because most one-bit changes decode to the same codeword. Whatever meets under a key is verified
on the full fingerprints.

Defined results: a null or empty text has no words and fingerprint 0, linked like any other; repeated rows and
equal texts share a fingerprint, of which one copy takes part in the search; null ids stay in the result and
do not name a component (a component with null ids only has a null ``component_id``); an empty table gives an
empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import keep
from wardline.llm.components import components

WIDTHS = (22, 21, 21)
CHUNK = 1 << 16

# Fixed value: a generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included; A-Z in lower case.

    A bit is set where more than half the shingle hashes have it. Hashes are counted in chunks, so the memory
    needed beyond the text and its words does not grow with the text.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, CHUNK):
        part = words[start : min(start + CHUNK, count) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [tuple(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), seed) for g in grams), dtype=np.uint64)
        octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return narrow.select("doc_id", signed("text").alias("fp"))


Code = tuple[np.ndarray, np.ndarray]


def code() -> Code:
    """Parity of every 12-bit message, and the error of at most three bits that belongs to every syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    parity = np.array([remainder(m << 11) for m in range(4096)], dtype=np.int32)
    error = np.zeros(2048, dtype=np.int32)
    bits = [1 << i for i in range(23)]
    for a in [0, *bits]:
        for b in [0, *bits]:
            for c in [0, *bits]:
                e = a | b | c
                error[remainder(e)] = e
    return parity, error


def codeword_index(words: np.ndarray, tables: Code) -> np.ndarray:
    """Index (message) of the codeword within three bits of each 23-bit word."""
    parity, error = tables
    syndrome = parity[words >> 11] ^ (words & 0x7FF)
    return (words ^ error[syndrome]) >> 11


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    out, low = [], 0
    for width in WIDTHS:
        out.append(((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int32))
        low += width
    return out


def keys(prints: np.ndarray, tables: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (position, key, own): the keys of each fingerprint, each once; ``own`` marks those of the word itself."""
    segments = _segments(prints)
    own = [codeword_index(s, tables) for s in segments]
    near = [codeword_index(s[:, None] ^ (1 << np.arange(w, dtype=np.int32))[None, :], tables) for s, w in zip(segments, WIDTHS, strict=True)]
    at = np.arange(len(prints))
    rows, values, marks = [], [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        base = (number << 24) | (own[a] << 12) | own[b]
        left = (number << 24) | (near[a] << 12) | own[b][:, None]
        right = (number << 24) | (own[a][:, None] << 12) | near[b]
        every = np.sort(np.concatenate([base[:, None], left, right], axis=1), axis=1)
        fresh = np.ones(every.shape, dtype=bool)
        fresh[:, 1:] = every[:, 1:] != every[:, :-1]
        where = np.repeat(at, every.shape[1])[fresh.ravel()]
        found = every.ravel()[fresh.ravel()]
        rows.append(where)
        values.append(found)
        marks.append(found == base[where])
    return np.concatenate(rows), np.concatenate(values), np.concatenate(marks)


def _key_rows(prints: DataFrame, own_only: bool) -> DataFrame:
    tables = code()

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signed = batch["fp"].to_numpy(dtype=np.int64)
            if len(signed):
                rows, values, own = keys(signed.view(np.uint64), tables)
                if own_only:
                    rows, values = rows[own], values[own]
                yield pd.DataFrame({"fp": signed[rows], "key": values.astype(np.int32)})

    return prints.select("fp").mapInPandas(unfold, "fp long, key int")


def links(prints: DataFrame, crowd: int = 64) -> DataFrame:
    """(a, b): links that connect exactly those distinct fingerprints of ``prints`` which differ in 2 bits or fewer.

    Under a key with up to ``crowd`` members, all that look it up are compared with all members. Members and
    visitors of a more crowded key are linked through shared one-bit neighbours instead: two fingerprints differ
    in two bits or fewer exactly if some word is at most one bit away from both, so 65 rows a fingerprint connect
    the whole crowd without comparing pairs.

    The joins on unfolded rows are sort-merge joins by hint: Spark sizes such rows like the fingerprints they come from, some
    27 or 65 times too low, and would send them to every task through the driver.
    """
    members = keep(_key_rows(prints, own_only=True))
    visitors = _key_rows(prints, own_only=False)
    crowded = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key")
    few = members.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = visitors.select("key", F.col("fp").alias("a")).join(few.hint("merge"), "key").where((F.col("a") != F.col("b")) & near).select("a", "b")

    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    masses = visitors.join(crowded, "key", "left_semi").select("fp").distinct()
    words = masses.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    hubs = words.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("word", "hub")
    through = words.join(hubs.hint("merge"), "word").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(through)


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row; the component is named by its smallest id.

    Texts are read once. The search runs on distinct fingerprints, so a group of equal texts of any size counts
    as one; its rows only meet again in the last, splittable join.
    """
    prints = keep(fingerprints(docs, id_column, text_column, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(distinct), "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
