"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under their commonest form.

The distinct words stand in two tries, one over the words and one over the words read backwards, kept as a
distributed table: a row for every node that has two words or more below it, with its edges. An edge tells how many
words are below it and, where that is one, which; so a lone tail needs no nodes of its own. A frontier of
(word, position, node, edits) states is joined with that table level by level. A state without an edit follows its
own letter and, from the middle of its word on, branches into replaced and deleted letters; a state with its edit
spent follows its own letters only. Where it ends together with a word, the two are near. The nearer half of every
edit is met in one of the two tries at depth, where nodes have few edges; near the root nothing branches. Inserted
letters are the deleted ones of the other word, and a letter is only replaced by a larger one, so each pair is met
from one side and told to both.

Words above ``trie_length`` code points, whose prefixes would take more room than the text, are met by hashes of the
word and of the word without one letter (a few bytes a letter), and every such pair is compared letter by letter.

Counts are partial aggregates. A node's row has at most one edge a letter of the alphabet; a node that very many
words pass is an ordinary, splittable side of the join (adaptive skew join). Every level is written to the shared
folder and the level before it is removed.

Defined results: null texts have no words; a null id counts as the empty text; repeated rows count again; of several
near words with the largest count the smallest in code-point order is the form; a word without a near word is its own
root; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import keep, lower_ascii
from wardline.session import new_folder, remove_folder

# The letters of a run once A-Z are lower-cased, and the alphabet of the trie's edges.
LETTERS = "a-zÀ-ÿ"
FORWARD, BACKWARD = ">", "<"
MODULUS, BASE = 2**61 - 1, 1_000_003


def typo(run: Column, doc_id: Column, every: int = 97) -> Column:
    """``run`` without one letter where ``every`` divides the CRC of ``<doc_id>:<run>``, else ``run`` itself."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (crc % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(crc % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = 5, least_count: int = 3, every: int | None = 97) -> DataFrame:
    """(word, n) of the words with ``least_length`` code points and ``least_count`` occurrences.

    Words are maximal runs of letters in lower case; shorter runs never leave the text. ``every``: see ``typo``
    (None: words as they are).
    """
    text = lower_ascii(F.col(text_column).cast("string"))
    runs = docs.select(
        F.col(id_column).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))).alias("run")
    )
    words = runs.select((typo(F.col("run"), F.col("doc"), every) if every else F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _letters(way: Column, word: Column) -> Column:
    """The word in reading order of a trie."""
    return F.when(way == FORWARD, word).otherwise(F.reverse(word))


def _both_ways(words: DataFrame) -> DataFrame:
    """(word, n, way, start): every word in either trie, and the depth from which edits are taken there.

    Edits from the middle on belong to the forward trie, the ones before it to the other: counted from the end,
    these begin where the rest of the word ends.
    """
    half = F.floor(F.char_length("word") / 2).cast("int")
    ways = F.array(
        F.struct(F.lit(FORWARD).alias("way"), half.alias("start")),
        F.struct(F.lit(BACKWARD).alias("way"), (F.char_length("word") - half).cast("int").alias("start")),
    )
    return words.select("word", "n", F.explode(ways).alias("w")).select("word", "n", "w.way", "w.start")


def trie(both: DataFrame, least_depth: int) -> DataFrame:
    """(node, depth, kids) for nodes from ``least_depth`` letters on with two words or more at or below them.

    ``node`` is the way and the letters down to it. ``kids``: for each edge its letter (empty: a word ends here), the
    number of words below it, and the smallest of these words with its count, which is the word if there is one only.
    """
    letters = _letters(F.col("way"), F.col("word"))
    edges = both.select("word", "n", "way", letters.alias("u"), F.explode(F.sequence(F.lit(least_depth), F.char_length("word"))).alias("depth"))
    edges = edges.select(
        F.concat("way", F.substring("u", F.lit(1), F.col("depth"))).alias("node"),
        F.substring("u", F.col("depth") + 1, F.lit(1)).alias("c"), "depth", "word", "n",
    )
    edges = edges.groupBy("node", "c", "depth").agg(F.count("*").alias("below"), F.min(F.struct("word", "n")).alias("only"))
    nodes = edges.groupBy("node", "depth").agg(F.sum("below").alias("below"), F.collect_list(F.struct("c", "below", "only")).alias("kids"))
    return nodes.where("below > 1").select("node", "depth", "kids")


def _advance(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """One level: ``states`` (word, n, node, pos, edits) joined with the edges of their nodes.

    Gives the states one level deeper, and (word, n, other, other_n) where a word was met with its edit spent.
    """
    way, depth = F.substring("node", 1, 1), F.char_length("node") - 1
    met = states.join(nodes.select("node", "kids"), "node").withColumns(
        {"u": _letters(way, F.col("word")), "next": F.substring(_letters(way, F.col("word")), F.col("pos") + 1, F.lit(1)),
         "after": F.substring(_letters(way, F.col("word")), F.col("pos") + 2, F.lit(1))}
    )
    fits = lambda k: ((F.col("edits") == 0) & (F.col("next") != "")) | (k["c"] == F.col("next"))
    met = met.withColumn("kid", F.explode(F.filter("kids", fits))).drop("kids")
    c, fresh = F.col("kid.c"), (F.col("edits") == 0) & (F.col("next") != "")
    step = lambda by, edits: F.struct((F.col("pos") + by).alias("pos"), F.lit(edits).alias("edits"))
    moves = F.array(
        F.when((F.col("edits") == 1) & (c == F.col("next")), step(1, 1)),
        F.when(fresh & (c == F.col("next")) & (F.col("kid.below") > 1), step(1, 0)),
        F.when(fresh & (c > F.col("next")), step(1, 1)),  # replaced
        F.when(fresh & (F.col("next") != F.col("after")) & (c == F.col("after")), step(2, 1)),  # deleted: the last of equal letters
    )
    moved = met.withColumn("move", F.explode(F.array_compact(moves)))
    alone = (F.col("move.edits") == 1) & ((c == "") | (F.col("kid.below") == 1))
    rest = F.substring("u", F.col("move.pos") + 1, F.char_length("u"))
    tail = F.substring(_letters(way, F.col("kid.only.word")), depth + 2, F.char_length("kid.only.word"))
    moved = moved.where(~alone | (c == "") | (rest == tail))
    return moved.select(
        "word", "n", F.when(~alone, F.concat("node", c)).alias("node"), F.when(~alone, F.col("move.pos")).alias("pos"),
        F.when(~alone, F.col("move.edits")).alias("edits"), F.when(alone, F.col("kid.only.word")).alias("other"),
        F.when(alone, F.col("kid.only.n")).alias("other_n"),
    )


def _trie_pairs(words: DataFrame) -> list[DataFrame]:
    """(word, n, other, other_n), each near pair once or twice, of words that are short enough for the trie."""
    both = keep(_both_ways(words))
    first, last = both.agg(F.min("start"), F.max("start")).first()
    if first is None:
        return []
    spark, nodes = both.sparkSession, keep(trie(both, first))
    found, states, depth = [], None, first
    while depth <= last or states is not None:
        letters = _letters(F.col("way"), F.col("word"))
        here = both.where(F.col("start") == depth).select(
            "word", "n", F.concat("way", F.substring(letters, 1, depth)).alias("node"), F.lit(depth).alias("pos"), F.lit(0).alias("edits")
        )
        if states is not None:
            here = states.unionByName(here)
        now = _advance(here, nodes.where(F.col("depth") == depth)).withColumn("met", F.col("other").isNotNull())
        path = new_folder(spark, "level")
        now.write.partitionBy("met").parquet(path)
        if states is not None:
            remove_folder(spark, old + "/met=false")
        old, now = path, spark.read.schema(now.schema).parquet(path)
        found.append((path, now.schema))
        states = now.where("not met").select("word", "n", "node", "pos", "edits")
        states = None if states.isEmpty() else states
        depth += 1
    # read anew, when what was not met is gone
    return [spark.read.schema(schema).parquet(path).where("met").select("word", "n", "other", "other_n") for path, schema in found]


def _deletes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, place, key, last): the hash of each word (place -1) and of the word without its letter at ``place``.

    ``last``: the letter is another than the next one; of equal letters in a row it does not matter which one goes.
    """
    for batch in batches:
        for number, word in zip(batch["id"], batch["word"], strict=True):
            codes = [ord(c) for c in word]
            before = [0]  # hashes of the beginnings
            for x in codes:
                before.append((before[-1] * BASE + x) % MODULUS)
            keys, last, behind, power = [], [], 0, 1  # hash of the end after the place, and the weight of what stands before it
            for i in range(len(codes) - 1, -1, -1):
                keys.append((before[i] * power + behind) % MODULUS)
                last.append(i + 1 == len(codes) or codes[i] != codes[i + 1])
                behind = (codes[i] * power + behind) % MODULUS
                power = power * BASE % MODULUS
            keys.append(before[-1])
            last.append(False)
            for at in range(0, len(keys), 10_000):
                part = keys[at : at + 10_000]
                places = range(len(codes) - 1 - at, len(codes) - 1 - at - len(part), -1)
                yield pd.DataFrame({"id": number, "place": list(places), "key": part, "last": last[at : at + 10_000]})


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of long words: equal without one letter at the same place, or equal to the whole other."""
    words = keep(words.withColumn("id", F.monotonically_increasing_id()))
    keys = keep(words.select("id", "word").mapInPandas(_deletes, "id long, place int, key long, last boolean"))
    cut, whole = keys.where("place >= 0"), keys.where("place = -1").select(F.col("id").alias("other"), "key")
    same = cut.select(F.col("id").alias("other"), "place", "key")
    met = cut.join(same, ["key", "place"]).where("other > id").select("id", "other")
    met = met.unionByName(cut.where("last").join(whole, "key").select("id", "other")).distinct()
    others = words.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    met = met.join(words, "id").join(others, "other")
    return met.where(F.levenshtein("word", "other_word", 1) == 1).select("word", "n", F.col("other_word").alias("other"), "other_n")


def near_pairs(words: DataFrame, trie_length: int = 40) -> DataFrame:
    """(word, n, other, other_n) for each ordered pair of near words of ``words`` (word, n; distinct words)."""
    size = F.char_length("word")
    parts = _trie_pairs(words.where(size <= trie_length))
    long = words.where(size >= trie_length)  # a pair across the border has its shorter word at it
    if not words.where(size > trie_length).isEmpty():
        parts.append(_long_pairs(long))
    spark = words.sparkSession
    schema = "word string, n long, other string, other_n long"
    if not parts:
        return spark.createDataFrame([], schema)
    met = parts[0]
    for part in parts[1:]:
        met = met.unionByName(part)
    turned = met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return met.unionByName(turned).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by pointer doubling: counts double along a chain, so it is short."""
    now = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        longer = keep(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return now


def group(words: DataFrame, ratio: int = 2, trie_length: int = 40) -> DataFrame:
    """(word, n, form, form_n, root, n_near) for ``words`` (word, n; one row a word).

    ``form``: the near word of the largest count, if it has at least ``ratio`` times the word's own.
    """
    words = keep(words)
    best = near_pairs(words, trie_length).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best")
    )
    best = keep(best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.m")).alias("other_n")))
    judged = words.join(best, "word", "left")
    formed = F.col("other_n") >= ratio * F.col("n")
    judged = judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(formed, F.col("other")).alias("form"), F.when(formed, F.col("other_n")).alias("form_n")
    )
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
