"""The prefix trie of conversations, found by peeling turns off from the deepest level upwards.

A first pass streams the turns of every conversation in order and names each prefix by a running SHA-256 (of lengths
and contents), so two conversations share a node exactly if they share a name. Equal conversations are merged to one.
Behind the last turn that it shares with another, a conversation is a chain of nodes of its own: these are finished and
stripped at once. From the greatest shared depth on, each level then merges the conversations that end there with
the nodes that survived the level below: rows with one name become one node, whose counts, smallest member, leaves and
saved text are final with that one grouping. Its last turn is stripped: the name of the prefix without it is what the next
level groups by. So a level moves nodes and not conversations.

The number of jobs is the greatest depth that two different conversations share, not the length of the longest one. A
conversation that very many share is counted by partial aggregates; the list of its ids, which has to be digested in
order, is first packed into long pieces by range, so that its task reads a few rows only. One conversation's turns are
hashed in order, so a hot one is one task's stream, at constant memory.

Defined results: null roles and texts are empty; rows without a place stand for a conversation without turns, a member
of the root; rows with a null id are of no conversation; repeated rows are turns of their own; an empty table gives an
empty result (no root); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm.common import keep
from wardline.session import new_folder

NAME_BYTES = 16
ROOT = hashlib.sha256().digest()[:NAME_BYTES]
PIECE = 1 << 16  # characters of an id list in one piece
PREFIXES = "conv_id long, depth int, name binary, parent binary, chars long, last boolean"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in batch.columns), strict=True)


def _frames(rows: Iterator[tuple], names: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, size)):
        yield pd.DataFrame(part, columns=names)


def _name_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for conv_id, turns in groupby(_rows(batches), key=lambda r: r[0]):
            running, name, depth, held = hashlib.sha256(), ROOT, 0, (conv_id, 0, ROOT, None, 0)
            for _, there, role, text in turns:
                if not there:
                    continue
                if depth:
                    yield (*held, False)
                said = [role.encode(), text.encode()]
                running.update(b"%d %d " % (len(said[0]), len(said[1])) + said[0] + said[1])
                depth, parent, name = depth + 1, name, running.digest()[:NAME_BYTES]
                held = (conv_id, depth, name, parent, len(text))
            yield (*held, True)

    yield from _frames(rows(), ["conv_id", "depth", "name", "parent", "chars", "last"])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name, parent, chars, last) for every prefix but the root, and for conversations without turns.

    ``turns``: conv_id, place (a sortable column, null: no turn), role, text.
    """
    narrow = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "place", F.col("place").isNotNull().alias("there"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "place", "role", "text")
    return dealt.select("conv_id", "there", "role", "text").mapInPandas(_name_prefixes, PREFIXES)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (name, conv_id) to (name, first, ids): comma-joined ids in pieces of bounded length."""

    def pieces() -> Iterator[tuple]:
        for name, rows in groupby(_rows(batches), key=lambda r: bytes(r[0])):
            first, parts, size = None, [], 0
            for _, conv_id in rows:
                if size >= PIECE:
                    yield name, first, ",".join(parts)
                    first, parts, size = None, [], 0
                first = conv_id if first is None else first
                parts.append(str(conv_id))
                size += len(parts[-1]) + 1
            yield name, first, ",".join(parts)

    yield from _frames(pieces(), ["name", "first", "ids"], 100)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def digests() -> Iterator[tuple]:
        for name, rows in groupby(_rows(batches), key=lambda r: bytes(r[0])):
            running, between = hashlib.sha256(), b""
            for _, _, ids in rows:
                running.update(between + ids.encode())
                between = b","
            yield name, running.hexdigest()

    yield from _frames(digests(), ["name", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): digest of the ascending ids of each name in ``ends`` (name, conv_id)."""
    ranged = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    packed = ranged.mapInPandas(_pack, "name binary, first long, ids string")
    return packed.repartition("name").sortWithinPartitions("name", "first").mapInPandas(_digest, "name binary, ends_sha256 string")


COUNTS = ("n_convs", "n_children", "n_leaves", "saved")
NODE = "name binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def _long(number: int) -> Column:
    return F.lit(number).cast("long")


def _shared_names(alone: DataFrame) -> DataFrame:
    """(name, depth, parent, chars) of the prefixes that two different conversations have. The root is one always."""
    met = alone.where("depth > 0").groupBy("name").agg(
        F.min("conv_id").alias("a"), F.max("conv_id").alias("b"), *(F.min(c).alias(c) for c in ("depth", "parent", "chars"))
    )
    root = alone.sparkSession.range(1).select(F.lit(ROOT).alias("name"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("parent"), _long(0).alias("chars"))
    return met.where("a <> b").select("name", "depth", "parent", "chars").unionByName(root)


def _chains(alone: DataFrame, units: DataFrame, shared: DataFrame) -> DataFrame:
    """Finished nodes behind the last shared turn of each different conversation, with ``top`` for its first such node."""
    own = alone.where("depth > 0").join(shared.select("name"), "name", "left_anti").join(units.select("conv_id", "n_convs"), "conv_id")
    upward = W.partitionBy("conv_id").orderBy(F.desc("depth"))
    saved = F.sum((F.col("n_convs") - 1) * F.col("chars")).over(upward.rowsBetween(W.unboundedPreceding, W.currentRow))
    return own.select(
        "name", "parent", "depth", "conv_id", "n_convs", F.when(F.col("last"), _long(0)).otherwise(_long(1)).alias("n_children"), _long(1).alias("n_leaves"),
        saved.alias("saved"), F.lead("depth").over(upward).isNull().alias("top"),
    )


def _peel(ended: DataFrame, below: Sequence[DataFrame], names: DataFrame) -> DataFrame:
    """The shared nodes of one level: of the conversations that end there and the nodes one level deeper."""
    rows = ended.select("name", "conv_id", "n_convs", *(_long(0).alias(c) for c in COUNTS[1:]))
    for nodes in below:
        rows = rows.unionByName(nodes.select(F.col("parent").alias("name"), "conv_id", "n_convs", _long(1).alias("n_children"), "n_leaves", "saved"))
    merged = rows.groupBy("name").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in COUNTS)).join(names, "name")
    return merged.select(
        "name", "parent", "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, _long(1)).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )


def trie(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. ``turns``: conv_id, place, role, text; see ``prefixes``.
    """
    spark = turns.sparkSession
    named = keep(prefixes(turns))
    ends = named.where("last")
    units = keep(ends.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth")))
    if units.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    alone = named.join(units.select("conv_id"), "conv_id", "left_semi")
    shared = keep(_shared_names(alone))
    chains = keep(_chains(alone, units, shared))
    tops = chains.where("top")
    ended = units.join(shared.select("name"), "name", "left_semi")
    path = new_folder(spark, "levels")
    depth = shared.agg(F.max("depth")).first()[0]
    below = None
    while depth >= 0:
        deeper = [tops.where(F.col("depth") == depth + 1)] + ([below] if below is not None else [])
        nodes = _peel(ended.where(F.col("depth") == depth), deeper, shared.where(F.col("depth") == depth).select("name", "parent", "chars"))
        nodes.write.parquet(f"{path}/depth={depth}")
        below = spark.read.schema(NODE).parquet(f"{path}/depth={depth}")
        depth -= 1
    root = below.first()["conv_id"]
    levels = spark.read.schema(f"{NODE}, depth int").parquet(path)
    # Only the topmost node of a chain has a parent that is shared; a node under the root needs no look-up.
    inner = levels.where("depth > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = levels.withColumn("top", F.lit(True)).unionByName(chains)
    known = F.when(F.col("depth") == 1, _long(root)).when(~F.col("top"), F.col("conv_id"))
    asked = F.col("top") & (F.col("depth") > 1)
    placed = nodes.where(~asked).withColumn("parent_conv_id", known).unionByName(nodes.where(asked).join(inner, "parent"))
    return placed.join(end_digests(ends), "name", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
