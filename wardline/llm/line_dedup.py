"""Line-level deduplication by prefix doubling over line sequences.

A document is the sequence of its non-blank lines. The suffixes that can matter are those that begin with a line
which occurs more than once; they are numbered in document order. A suffix's rank for prefix length 1 is the
number of the first suffix that begins with the same line. Each doubling round turns ranks for length n into
ranks for length 2n: the pair (rank here, rank n lines further on) is grouped over the whole corpus and named by
the first suffix that has it. Suffixes with one rank form an interval of the suffix array whose longest common
prefix has at least that length, and the rank tells the interval's first member. Ranks therefore order suffixes
by first occurrence instead of alphabetically; equality and the first member are all that deletion needs, so the
rounds group and join, and never sort the corpus.

A run of lines counts if it has ``min_words`` words. Every run that occurs again at a later place, however long,
is the union of its shortest counting windows, taken forward from each line and backward from each line. The rank
of a window of any length is the pair of ranks of its first and last power of two (two overlapping blocks). All
windows whose rank has an earlier member are later copies, and their lines are deleted.

Defined results: a line is compared character by character (by 96 bits of hash), with its white space; words are
runs of characters other than white space; order is by id (null first), then text hash, then line; rows that
agree in id and text are one document and are treated alike; null and empty texts and texts without a counting run
stay as they are; in a document that loses lines the blank lines go too; other columns are kept as they are,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm.common import free_name, keep, keep_partitions, set_apart

DOC = ["__doc", "__hash"]


def lines_of(text: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\S"))


def _repeated(docs: DataFrame) -> DataFrame:
    """(document, seq, place, line, words) of each line that occurs more than once; ``place`` grows in document order."""
    at = docs.select(*DOC, F.posexplode(lines_of(F.col("__text"))).alias("seq", "line"))
    # Hashes and word counts in code generated around the unfolding; the lines themselves are not shuffled.
    marked = at.select(*DOC, "seq", F.xxhash64("line").alias("h"), F.crc32(F.col("line").cast("binary")).alias("c"), F.regexp_count("line", F.lit(r"\S+")).alias("words"))
    often = marked.groupBy("h", "c").agg(F.count("*").alias("n")).where("n > 1").select("h", "c")
    active = marked.join(often, ["h", "c"]).dropDuplicates([*DOC, "seq"])
    dealt = keep_partitions(active.repartitionByRange(*DOC, "seq").sortWithinPartitions(*DOC, "seq"))
    return keep(dealt.withColumn("place", F.monotonically_increasing_id()))


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(document, seq, m): the shortest windows of repeated lines with ``min_words`` words, forward and backward.

    A non-blank line has a word at least, so a window has at most ``min_words`` lines. Gathered are the repeated
    lines of one document at a time.
    """
    item = F.struct("seq", "words")
    lists = rows.groupBy(*DOC).agg(F.array_sort(F.collect_list(item)).alias("up"))
    lists = lists.withColumn("down", F.reverse("up"))

    def shortest(items: str, step: int) -> Column:
        def reach(x: Column, i: Column) -> Column:
            def add(state: Column, y: Column) -> Column:
                on = (state["sum"] < min_words) & (y["seq"] == x["seq"] + step * state["m"])
                more = F.struct((state["sum"] + y["words"]).alias("sum"), (state["m"] + 1).alias("m"))
                return F.when(on, more).otherwise(state)

            start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m"))
            return F.aggregate(
                F.slice(items, i + 1, F.lit(min_words)), start, add,
                lambda s: F.when(s["sum"] >= min_words, F.struct((x["seq"] if step > 0 else x["seq"] - s["m"] + 1).alias("seq"), s["m"].alias("m"))),
            )

        return F.transform(items, reach)

    every = F.array_distinct(F.concat(shortest("up", 1), shortest("down", -1)))
    return lists.select(*DOC, F.explode(every).alias("w")).where("w is not null").select(*DOC, "w.seq", "w.m")


def _named(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Rank of each row: the first place that has the same values in ``by``; rows of their own are left out."""
    first = pairs.groupBy(*by).agg(F.min("place").alias("rank"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.join(first, by)


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(document, seq, m) of every counting window that also occurs at an earlier place."""
    rows = _repeated(docs)
    windows = keep(_windows(rows, min_words))
    ranked = [*DOC, "seq", "place", "rank"]
    level = keep(_named(rows, ["h", "c"]).select(*ranked, F.lit(0).alias("k")))
    levels, k = [level], 0
    while 2 ** (k + 1) <= min_words:
        further = level.select(*DOC, (F.col("seq") - 2**k).alias("seq"), F.col("rank").alias("next"))
        k += 1
        doubled = level.withColumnRenamed("rank", "here").join(further, [*DOC, "seq"])
        level = keep(_named(doubled, ["here", "next"]).select(*ranked, F.lit(k).alias("k")))
        if level.isEmpty():
            break
        levels.append(level)
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)

    sized = windows.withColumn("k", F.floor(F.log2("m")).cast("int"))
    sized = sized.withColumn("last", F.col("seq") + F.col("m") - F.pow(F.lit(2), F.col("k")).cast("int"))
    head = ranks.select(*DOC, "seq", "k", "place", F.col("rank").alias("head"))
    tail = ranks.select(*DOC, F.col("seq").alias("last"), "k", F.col("rank").alias("tail"))
    known = keep(sized.join(head, [*DOC, "seq", "k"]).join(tail, [*DOC, "last", "k"]))
    return _named(known, ["m", "head", "tail"]).where("place > rank").select(*DOC, "seq", "m")


def count_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the two columns that ``dedupe`` adds: ``n_lines`` and ``n_removed``, or free ones like them."""
    return free_name(docs, "n_lines"), free_name(docs, "n_removed")


def dedupe(docs: DataFrame, min_words: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the lines of later copies deleted, and two columns more: ``n_lines`` and ``n_removed``
    (see ``count_names``).

    The text is shuffled once, in the join that brings the line numbers to be deleted. All rounds work on places
    and ranks of repeated lines, and each is written to the shared folder.
    """
    n_lines, n_removed = count_names(docs)
    docs, back = set_apart(docs, [*DOC, "__text", "__gone", "seq"])
    # In a struct a null id equals a null id, so the joins below stay plain equality.
    keyed = docs.withColumns({"__doc": F.struct(F.col(id_column)), "__text": F.col(text_column).cast("string")})
    keyed = keyed.withColumn("__hash", F.xxhash64("__text"))
    marks = repeated_windows(keyed.select(*DOC, "__text"), min_words)
    gone = marks.select(*DOC, F.explode(F.sequence("seq", F.expr("seq + m - 1"))).alias("seq"))
    gone = gone.groupBy(*DOC).agg(F.collect_set("seq").alias("__gone"))
    joined = keyed.join(gone, DOC, "left")
    left_over = F.array_join(F.filter(lines_of(F.col("__text")), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    return joined.withColumns(
        {
            text_column: F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(left_over),
            n_lines: F.size(lines_of(F.col("__text"))),
            n_removed: F.coalesce(F.size("__gone"), F.lit(0)),
        }
    ).drop(*DOC, "__text", "__gone").withColumnsRenamed(back)
