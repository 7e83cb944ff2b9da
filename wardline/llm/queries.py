"""The operators of this subpackage applied to the given tables, ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm import ann, chat_format, decontaminate, license_scan, line_dedup, prefix_trie, quality_crf, sentencepiece_codec, sharding, simhash, spelling, toxicity, warc_revisit
from wardline.llm.common import table, text_or_empty, values

SHARDS = 16
TOXIC = 0.3


# The conversation that the contract adds.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    added = values(spark, [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.columns)
    return chat_format.read_back(chat_format.format_conversations(rows.union(added)))


def op2_license_scan(spark: SparkSession, d: str) -> DataFrame:
    found = license_scan.scan(table(spark, d, "documents"))
    return found.select("doc_id", F.col("n_words").cast("bigint"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_srs_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def train_rows(labels: DataFrame) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, train_rows(table(spark, d, "labels")))
    judged = docs.select("doc_id", toxicity.score(model, F.col("text")).alias("j"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return judged.select(
        "doc_id", held_out.alias("held_out"), F.col("j.score").alias("score"),
        F.when(F.col("j.score") >= TOXIC, 1).otherwise(0).alias("predicted"), F.array_join("j.terms", ",").alias("terms"),
    )


def op5_jump_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.assign(table(spark, d, "documents"), shards=SHARDS)


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.hits(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = line_dedup.dedupe(table(spark, d, "documents"), min_words=50)
    return found.select("doc_id", "text", F.col("n_lines").cast("bigint"), F.col("n_removed").cast("bigint"))


def op8_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = sentencepiece_codec.load()
    docs = table(spark, d, "documents")
    coded = docs.select("doc_id", "text", sentencepiece_codec.encode(spark, vocabulary, F.col("text")).alias("ids"))
    back = sentencepiece_codec.decode(spark, vocabulary, F.col("ids"))
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), back.eqNullSafe(F.col("text")).alias("round_trip"))


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Archive records from ``pages``, which has pages only: a response for each page, and two later or earlier
    not-modified answers for variants of its URL, with an entity tag that every fifth time is another one."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    tag = F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16)
    minute = F.col("page_id") % 40_000
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    def record(number: int, kind: str, url: Column, minutes: Column, headers: list[Column], payload: Column) -> DataFrame:
        return pages.select(
            (F.col("page_id") * 3 + number).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"),
            F.timestamp_seconds(F.lit(1_700_000_000) + (minute + minutes) * 60).alias("date"), F.array(*headers).alias("headers"), payload.alias("payload"),
        )

    none, plain = F.lit(None).cast("string"), F.regexp_replace("url", "#.*$", "")
    first = [header("Content-Type", F.lit("text/html")), header("Content-Length", F.octet_length("html")), header("ETag", tag), header("Cache-Control", F.lit("max-age=60"))]
    later = [header("etag", F.concat(F.lit("W/"), F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(tag))), header("Cache-Control", F.concat(F.lit("max-age="), F.col("page_id") % 7)), header("Content-Length", F.lit(0))]
    parts = [
        record(0, "response", F.col("url"), F.lit(0), first, F.col("html")),
        record(1, "revisit", F.concat(plain, F.lit("#again")), 1 + F.col("page_id") % 300, later, none),
        record(2, "revisit", F.concat(plain, F.lit("#before")), F.lit(-1), later, none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def op9_warc_revisits(spark: SparkSession, d: str) -> DataFrame:
    records = captures(spark, d)
    full = warc_revisit.with_payload(warc_revisit.resolve(records), records)
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit(""))))
    return full.select(
        "record_id", "url_key", "response_id", "status", F.array_join(lines, "\n").alias("headers"),
        F.md5(F.col("payload").cast("binary")).alias("payload_md5"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
    )


def op10_simhash_golay(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.groups(table(spark, d, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


HEAD_TURNS = 6


def rebuilt_conversations(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, place, role, text): the first turns of another conversation, then a conversation's own later ones.

    A conversation that is left without turns has one row without a place. Lenders hand on fewer than ``HEAD_TURNS``
    turns, so no join grows with the length of a conversation.
    """
    rows = table(spark, d, "conversations").where("conv_id is not null")
    texts = [text_or_empty(c).alias(c) for c in ("role", "text")]
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = rows.select("conv_id", "turn", *texts).withColumn("at", F.row_number().over(order))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int"))
    ids = own.where("at = 1").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % 100).alias("lender"))
    lent = own.where(F.col("at") < HEAD_TURNS).select(F.col("conv_id").alias("lender"), "at", "role", "text")
    place = lambda part: F.struct(F.lit(part).alias("part"), "at").alias("place")
    head = ids.join(lent, "lender").where("at <= h").select("conv_id", place(0), "role", "text")
    rest = own.where("at > h").select("conv_id", place(1), "role", "text")
    none = ids.select("conv_id", F.lit(None).cast(rest.schema["place"].dataType).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"))
    return head.unionByName(rest).unionByName(none)


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.trie(rebuilt_conversations(spark, d))


def op12_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    found = spelling.group(spelling.word_counts(table(spark, d, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality_crf.fit(docs, train_rows(table(spark, d, "labels")))
    return docs.select("doc_id", quality_crf.score(model, F.col("text")).alias("j")).select("doc_id", "j.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
