"""Exact duplicates by refinement: length, then the hash of a prefix, then the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, spread_join, written

#: Characters of the prefix that the second step hashes.
PREFIX = 256
#: Bits of the map of surviving groups. It holds 2^22 bits in at most 2^16 rows of 64 bits, at any size of input.
MAP_BITS = 1 << 22


def normalised(text: str | Column = "text") -> Column:
    """The text with every run of blanks as one space; null is the empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), f"[{BLANKS}]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _bit(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(MAP_BITS))


def _marked(rows: DataFrame, groups: DataFrame, *of: str) -> DataFrame:
    """Rows with ``_again``: whether their group may be among ``groups``, by a bit map of bounded size.

    A clear bit is certain, a set one is checked by the next step.
    """
    bits = groups.select(_bit(*of).alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_b % 64 as int)))").alias("_bits"))
    found = rows.withColumn("_w", F.shiftright(_bit(*of), 6)).join(F.broadcast(bits), "_w", "left")
    return found.withColumn("_again", F.coalesce(F.getbit("_bits", (_bit(*of) % 64).cast("int")) == 1, F.lit(False))).drop("_w", "_bits")


def exact_duplicates(docs: DataFrame, all_digests: bool = False) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept; with ``all_digests`` also text_sha256.

    Texts are equal if their normalised texts are. One scan of the texts makes the length and the
    prefix hash of each row; the steps on these work on that narrow table. A second scan hashes
    whole texts, only of rows whose group survived both (of all rows with ``all_digests``). No text
    is shuffled. Counts are summed before they are shuffled; those of the largest groups, of a
    bounded number, come back to their rows by a broadcast, so no group lands in one task.

    Null and empty texts form one group. ``keep_id`` is the least doc_id of a group, null only if
    all are; rows that repeat that doc_id are all kept; a row of a null doc_id is kept only in a
    group without other ids. An empty table gives no rows. Other columns are ignored. Texts are
    compared and hashed whole, one at a time.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("_text"))
    heads = lambda df: df.withColumn("_len", F.length("_text")).withColumn("_head", F.xxhash64(F.substring("_text", 1, PREFIX)))

    first = written(heads(texts).select("_len", "_head"), "dedup-heads")
    by_length = first.groupBy("_len").agg(F.count("*").alias("_n")).filter("_n > 1")
    by_head = _marked(first, by_length, "_len").filter("_again").groupBy("_len", "_head").agg(F.count("*").alias("_n")).filter("_n > 1")

    marked = _marked(heads(texts), by_head, "_len", "_head")
    full = digest(F.col("_text"))
    second = written(marked.select("doc_id", "_len", "_again", (full if all_digests else F.when(F.col("_again"), full)).alias("text_sha256")), "dedup-digests")
    groups = second.filter("_again").groupBy("_len", "text_sha256").agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_size")).filter("_size > 1")
    groups = written(groups.withColumn("_n", F.col("_size")), "dedup-groups")
    alone = F.col("text_sha256").isNull()
    joined = spread_join(second.filter(~alone), groups, ["_len", "text_sha256"], "_n", second.count(), "left")
    if not all_digests:  # rows whose group is surely of one have no digest
        joined = joined.unionByName(second.filter(alone).select("*", F.lit(None).cast("long").alias("_keep"), F.lit(None).cast("long").alias("_size")))
    out = joined.select(
        "doc_id",
        F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        "text_sha256",
    )
    return out if all_digests else out.drop("text_sha256")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_duplicates`` keeps.

    A row goes by its doc_id and the digest of its own text, so other texts of a repeated or null
    doc_id stay. Null and empty texts are one group. An empty table stays empty; columns of
    any other name are kept and not read.
    """
    gone, sha, here = fresh(docs, "_gone_id", "_gone_sha", "_sha")
    found = exact_duplicates(docs, all_digests=True).filter("not kept").select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha)).distinct()
    keyed = docs.withColumn(here, digest(normalised()))
    return keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(gone)) & (F.col(here) == F.col(sha)), "left_anti").drop(here)
