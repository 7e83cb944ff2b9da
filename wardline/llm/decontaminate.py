"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: numbers, names and units are replaced by typed placeholders, the rest
is put in lower case. Windows of five template words are hash-joined between documents and items. Matches of one
document and item are counted by diagonal (place in the document minus place in the item), neighbouring diagonals
are merged, and the windows of the item found there give its coverage. Where both sides have placeholders, the
values they stand for must agree: one value of the item must have one value of the document throughout, the same
or another. A passage that only changes the numbers or names of an item is found, a text that merely shares its
sentence frame is not.

``clean`` also finds items that were edited. A capitalised word that is a name elsewhere in the same text is a slot at the
beginning of a sentence as well. Any matched window makes its diagonal a candidate; on the merged diagonals item and
document are compared word by word, and ``coverage`` of the item's words must agree. One changed word so costs one word
and not five windows; an edited item of fewer than ten words may be left without any matching window. ``hits`` keeps to
the windows, as its SQL does.

A name is a capitalised word behind a letter, a digit, a comma, a semicolon or a colon and one space, so the first
word of a sentence is none. A unit is one of ``UNITS`` behind a number. A window counts if three of its words at
least hold no placeholder.

An item without a counting window (fewer than five words, or placeholders nearly everywhere) cannot be told from chance
by its template: ``clean`` searches for its exact copies, all its words in sequence and the same signs between them (letter
case and white space aside); ``hits`` leaves it out. So an item of one common word removes every text that has the word.

Defined results: null and empty texts hold nothing, nor do items without words; items with equal text are one
item, named by the smallest id; rows that agree in id and text are one document; a passage shared by many
documents gives one row for each, never pairs of documents; empty tables give an empty result; other columns are
ignored by ``hits`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm.common import keep, lower_ascii, set_apart, small_side

WINDOW = 5
PLAIN = 3
# Private-use characters stand for slots; they count as letters of a word.
NAME, NUMBER, UNIT, POINT = "\ue000", "\ue001", "\ue002", "\u00b7"
# Units of measure.
UNITS = "mm cm km m mg kg g ml l mph s min h hours minutes seconds days years usd eur dollars euros meters metres miles feet inches grams pounds percent".split()
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["__doc", "__hash"]


def _marked(text: Column) -> Column:
    """``text`` with numbers as single words and a mark before names."""
    whole = text
    for _ in range(2):  # a digit between two points belongs to both
        whole = F.regexp_replace(whole, "([0-9])[.,]([0-9])", f"$1{POINT}$2")
    return F.regexp_replace(whole, r"([\p{L}\p{N},;:] )(\p{Lu})", f"$1{NAME}$2")


def _template(marked: Column) -> Column:
    """The same words as in ``marked``, slots replaced by placeholders."""
    named = F.regexp_replace(marked, f"{NAME}[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", NAME)
    counted = F.regexp_replace(lower_ascii(named), f"[0-9][0-9{POINT}]*", NUMBER)
    return F.regexp_replace(counted, f"({NUMBER} ?)(?:{'|'.join(UNITS)})([^a-z]|$)", f"$1{UNIT}$2")


def _split(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, c, r): template words and words of the text."""
    marked = rows.select(*keys, _marked(F.coalesce(text.cast("string"), F.lit(""))).alias("m"))
    # A first element that is a separator gives an empty word on both sides.
    return marked.select(*keys, F.array_remove(F.split(_template(F.col("m")), SEPARATORS), "").alias("c"), F.array_remove(F.split("m", SEPARATORS), "").alias("r"))


def _named(split: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c, e, r): ``e`` has slots for names at the beginning of sentences too; ``r`` is without marks."""
    bare = lambda words: F.transform(words, lambda w: F.translate(w, NAME, ""))
    marks = split.withColumn("n", F.array_distinct(bare(F.filter("r", lambda w: w.startswith(NAME)))))
    initial = marks.withColumn("i", F.array_intersect("n", "r"))
    named = F.zip_with("c", "r", lambda c, w: F.when(F.array_contains("i", w), F.lit(NAME)).otherwise(c))
    return initial.select(*keys, "c", F.when(F.size("i") > 0, named).otherwise(F.col("c")).alias("e"), bare(F.col("r")).alias("r"))


def _windows(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, at, c0.., r0.., hash) for every counting window: template words, words of the text, and a hash."""
    return _counting(_split(rows, keys, text), keys)


def _counting(split: DataFrame, keys: list[str]) -> DataFrame:
    shifted = [F.slice(x, i + 1, F.greatest(F.size(x) - i, F.lit(0))).alias(f"{x}{i}") for x in ("c", "r") for i in range(WINDOW)]
    at = split.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("at", "g")).where(f"g.c{WINDOW - 1} is not null")
    template = [F.col(f"g.c{i}") for i in range(WINDOW)]
    plain = sum((F.when(_slot(c), 0).otherwise(1) for c in template), F.lit(0))
    return at.where(plain >= PLAIN).withColumn("hash", F.xxhash64(*template))


def _slot(word: Column) -> Column:
    return word.contains(NAME) | word.contains(NUMBER) | word.contains(UNIT)


def hits(
    docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, band: int = 2, broadcast_rows: int = 1_000_000,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each document and item whose windows cover ``coverage`` of the item with agreeing slots.

    The windows of the items are counted first. Up to ``broadcast_rows`` of them are broadcast, so the documents'
    windows are matched where they are read; more of them are joined by shuffle with the same result.
    """
    return _found(_keyed(docs, id_column, text_column), benchmark, coverage, band, broadcast_rows, item_column, item_text).select(
        F.col("__doc.v").alias("doc_id"), "item_id", "coverage", "start", "end", "slots"
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns and other rows stay as they are."""
    names = {k: options.pop(k) for k in ("id_column", "text_column") if k in options}
    docs, back = set_apart(docs, [*KEY, "__text"])
    keyed = _keyed(docs, names.get("id_column", "doc_id"), names.get("text_column", "text"))
    settings = {"coverage": 0.8, "band": 2, "broadcast_rows": 1_000_000, "item_column": "item_id", "item_text": "text"} | options
    whole = _found(keyed, benchmark, **settings).select(*KEY).unionByName(_edited(keyed, benchmark, **settings))
    copied = _copied(keyed, benchmark, settings["item_column"], settings["item_text"])
    whole = whole if copied is None else whole.unionByName(copied)
    found = keep(whole.distinct())
    return keyed.join(small_side(found), KEY, "left_anti").drop(*KEY, "__text").withColumnsRenamed(back)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    # In a struct a null id equals a null id, so joins on it stay plain equality.
    keyed = docs.withColumns({"__doc": F.struct(F.col(id_column).alias("v")), "__text": F.col(text_column).cast("string")})
    return keyed.withColumn("__hash", F.xxhash64("__text"))


def _items(benchmark: DataFrame, item_column: str, item_text: str) -> DataFrame:
    return benchmark.groupBy(F.col(item_text).alias("t")).agg(F.min(item_column).alias("item_id"))


def _matched(placed: DataFrame, of_items: DataFrame, broadcast_rows: int, *more: str) -> DataFrame:
    """Windows of documents and items that agree: places, diagonal, and the slots with their values."""
    asked = of_items.select("item_id", *more, F.col("at").alias("t_at"), F.col("g").alias("t"), F.col("hash").alias("t_hash"))
    if asked.count() <= broadcast_rows:
        asked = F.broadcast(asked)
    same = F.col("hash") == F.col("t_hash")
    for i in range(WINDOW):
        same &= F.col(f"g.c{i}") == F.col(f"t.c{i}")
    slots = F.array_compact(F.array(*(
        F.when(_slot(F.col(f"t.c{i}")), F.struct((F.col("t_at") + i).alias("at"), F.col(f"t.r{i}").alias("item"), F.col(f"g.r{i}").alias("doc"))) for i in range(WINDOW))))
    return placed.join(asked, same).select(*KEY, "item_id", *more, "at", "t_at", (F.col("at") - F.col("t_at")).alias("diagonal"), slots.alias("slots"))


def _numbered(votes: DataFrame, band: int) -> DataFrame:
    """``votes`` with the number of the ``span`` of neighbouring diagonals."""
    line = W.partitionBy(*KEY, "item_id").orderBy("diagonal")
    opens = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= band, 0).otherwise(1)
    return votes.withColumn("span", F.sum(opens).over(line))


def _agree() -> Column:
    """One value of the item has one value of the document throughout."""
    values = F.size(F.array_distinct(F.transform("slots", lambda s: s["item"])))
    return values == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["item"], s["doc"]))))


def _edited(keyed: DataFrame, benchmark: DataFrame, coverage: float, band: int, broadcast_rows: int, item_column: str, item_text: str) -> DataFrame:
    """Keys of the documents that hold ``coverage`` of the words of an item, on the diagonals of matched windows."""

    def both(named: DataFrame, keys: list[str], *more: str) -> DataFrame:
        kinds = F.when(F.col("c") == F.col("e"), F.array("c")).otherwise(F.array("c", "e"))
        return _counting(named.select(*keys, *more, "r", F.explode(kinds).alias("c")), [*keys, *more])

    items = _named(_split(_items(benchmark, item_column, item_text), ["item_id"], F.col("t")), ["item_id"])
    of_items = both(items.withColumn("words", F.size("c")), ["item_id"], "words").dropDuplicates(["item_id", "at", "hash"])
    matched = _matched(both(_named(_split(keyed, KEY, F.col("__text")), KEY), KEY), of_items, broadcast_rows, "words")
    votes = matched.groupBy(*KEY, "item_id", "words", "diagonal").agg(F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    spans = (
        _numbered(votes, band)
        .groupBy(*KEY, "item_id", "words", "span")
        .agg(F.collect_list("diagonal").alias("diagonals"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    )
    asked = spans.where(_agree()).groupBy(*KEY).agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("asked"))
    texts = keyed.select(*KEY, "__text").join(small_side(keep(asked)), KEY)
    seen = _named(_split(texts, [*KEY, "asked"], F.col("__text")), [*KEY, "asked"]).withColumn("a", F.explode("asked"))
    # Of the document only the words beside the item travel on.
    seen = seen.withColumn("begin", F.greatest(F.array_min("a.diagonals"), F.lit(0)))
    beside = lambda c: F.slice(c, F.col("begin") + 1, F.array_max("a.diagonals") + F.col("a.words") - F.col("begin"))
    seen = seen.select(*KEY, "a.item_id", "a.words", F.transform("a.diagonals", lambda d: d - F.col("begin")).alias("shifts"), beside("c").alias("dc"), beside("e").alias("de"))
    compared = seen.join(items.select("item_id", F.col("c").alias("tc"), F.col("e").alias("te")), "item_id")

    def agrees(at: Column) -> Column:
        here = lambda d: F.coalesce((F.get("dc", at + d) == F.get("tc", at)) | (F.get("de", at + d) == F.get("te", at)), F.lit(False))
        return F.exists("shifts", here)

    held = F.size(F.filter(F.sequence(F.lit(0), F.col("words") - 1), agrees))
    return compared.where(held >= F.col("words") * coverage).select(*KEY)


def _copied(keyed: DataFrame, benchmark: DataFrame, item_column: str, item_text: str) -> DataFrame | None:
    """Keys of the documents that hold an item without a counting window; None if there is no such item."""
    items = _items(benchmark, item_column, item_text)
    words = lambda text: F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")
    solid = lambda text: F.regexp_replace(lower_ascii(text), r"\s+", "")
    counted = _windows(items, ["t"], F.col("t")).select("t").distinct()
    short = items.join(counted, "t", "left_anti").select(words(F.col("t")).alias("w"), solid(F.col("t").cast("string")).alias("item")).where("size(w) > 0")
    short = keep(short.select(F.size("w").alias("n"), F.xxhash64("w").alias("hash"), "item").distinct())
    lengths = sorted(r.n for r in short.select("n").distinct().collect())
    if not lengths:
        return None
    texts = keyed.select(*KEY, words(F.col("__text")).alias("w"))

    def runs(n: int) -> Column:
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n))))

    hashes = F.array_distinct(F.flatten(F.array_compact(F.array(*map(runs, lengths)))))
    met = texts.select(*KEY, F.explode(hashes).alias("hash")).join(small_side(short), "hash").select(*KEY, "item")
    asked = keep(met.groupBy(*KEY).agg(F.collect_set("item").alias("items")))
    seen = keyed.select(*KEY, solid(F.col("__text")).alias("s")).join(small_side(asked), KEY)
    return seen.where(F.exists("items", lambda x: F.contains(F.col("s"), x))).select(*KEY)


def _found(keyed: DataFrame, benchmark: DataFrame, coverage: float, band: int, broadcast_rows: int, item_column: str, item_text: str) -> DataFrame:
    of_items = _windows(_items(benchmark, item_column, item_text), ["item_id"], F.col("t"))
    sizes = of_items.groupBy("item_id").agg(F.count("*").alias("windows"))
    matched = _matched(_windows(keyed, KEY, F.col("__text")), of_items.join(sizes, "item_id"), broadcast_rows, "windows")

    # Sets, not counts: a document that is there twice must not weigh twice.
    votes = matched.groupBy(*KEY, "item_id", "windows", "diagonal").agg(
        F.collect_set("t_at").alias("hit"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        F.min("at").alias("start"), F.max("at").alias("end"),
    )
    spans = (
        _numbered(votes, band)
        .groupBy(*KEY, "item_id", "windows", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("covered"),
            F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
            F.min("start").cast("bigint").alias("start"),
            (F.max("end") + WINDOW).cast("bigint").alias("end"),
        )
    )
    judged = spans.withColumn("coverage", F.col("covered") / F.col("windows")).where((F.col("coverage") >= coverage) & _agree())
    best = F.struct("coverage", (-F.col("start")).alias("place"), F.col("end"), F.size("slots").cast("bigint").alias("slots"))
    top = judged.groupBy(*KEY, "item_id").agg(F.max(best).alias("best"))
    return top.select(*KEY, "item_id", "best.coverage", (-F.col("best.place")).alias("start"), "best.end", "best.slots")
