"""Removal of lines that many documents share, as keep bitmaps per document.

Line keys are hashed to 128 bits.  Occurrences shrink to one row per (hash, document), then to one row per
(hash, salt) with a count and the latest document, so a line that a third of all documents hold is a few rows.
These are range-partitioned by hash with a secondary sort by document downwards; one streaming window pass
over each range reads the first row of a hash, its keeper, and the number of documents.  What is dropped comes back
as bitmaps of 64-line words; words without a dropped line are left out, so a clean document has no bitmap at all.
Only built-in functions run; no text is shuffled before the bitmaps are applied.

Cases: a null or empty text is one empty line; lines whose key is shorter than ``min_chars`` always stay; lines of any
length and number work; a repeated row (same id) is the same document, so its lines do not count twice, and each row
is judged by its own text; a row with a null id holds lines for nobody and keeps all of its own; an empty frame
gives an empty result.  Working columns start with ``_ld_``; other columns stay as they are, ``keep`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The white space that keys are stripped of.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 32


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Keys of all lines: stripped and in lower case (A-Z only)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.transform(F.split(lowered, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))


def _occurrences(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    keyed = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_ld_id"), F.xxhash64(text).alias("_ld_t"), F.posexplode(line_keys(F.col(text))).alias("_ld_pos", "_ld_key")
    )
    return keyed.where(F.length("_ld_key") >= min_chars).select(
        "_ld_id", "_ld_t", "_ld_pos", F.xxhash64("_ld_key").alias("_ld_a"), F.xxhash64(F.lit(7), "_ld_key").alias("_ld_b")
    )


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Hashes of keys found in at least ``min_docs`` documents with the document that keeps them (``_ld_keep``)."""
    holders = _occurrences(docs, id_col, text, min_chars).groupBy("_ld_a", "_ld_b", "_ld_id").agg(F.min("_ld_pos").alias("_ld_pos"))
    partial = holders.groupBy("_ld_a", "_ld_b", F.pmod(F.xxhash64("_ld_id"), F.lit(SALTS)).alias("_ld_salt")).agg(
        F.count("*").alias("_ld_n"), F.max(F.struct("_ld_id", "_ld_pos")).alias("_ld_last")
    )
    ranged = partial.repartitionByRange("_ld_a", "_ld_b")
    stream = Window.partitionBy("_ld_a", "_ld_b").orderBy(F.desc("_ld_last"))
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranged.withColumn("_ld_first", F.row_number().over(stream))
        .withColumn("_ld_docs", F.sum("_ld_n").over(whole))
        .where((F.col("_ld_first") == 1) & (F.col("_ld_docs") >= min_docs))
        .select("_ld_a", "_ld_b", F.col("_ld_last._ld_id").alias("_ld_keep"))
    )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Bitmaps of the documents that lose lines: ``_ld_id``, ``_ld_t`` (hash of the text) and ``keep``, a map from word
    number to 64 bits, bit i of word w set where line 64 w + i stays; words with nothing dropped are absent."""
    shared = shared_lines(docs, id_col, text, min_chars, min_docs)
    dropped = _occurrences(docs, id_col, text, min_chars).join(shared, ["_ld_a", "_ld_b"]).where(F.col("_ld_id") != F.col("_ld_keep"))
    word, bit = F.shiftright("_ld_pos", 6), F.expr("shiftleft(1L, _ld_pos & 63)")
    words = dropped.groupBy("_ld_id", "_ld_t", word.alias("_ld_w")).agg(F.bitwise_not(F.bit_or(bit)).alias("_ld_bits"))
    return words.groupBy("_ld_id", "_ld_t").agg(F.map_from_entries(F.collect_list(F.struct("_ld_w", "_ld_bits"))).alias("keep"))


def with_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their bitmap (null where every line stays)."""
    left = docs.drop("keep").withColumn("_ld_t", F.xxhash64(text))
    right = bitmaps.withColumnRenamed("_ld_t", "_ld_u")
    return left.join(right, (F.col(id_col) == F.col("_ld_id")) & (F.col("_ld_t") == F.col("_ld_u")), "left").drop("_ld_id", "_ld_t", "_ld_u")


def n_dropped(keep: Column) -> Column:
    """Number of lines a bitmap drops."""
    return F.coalesce(F.aggregate(F.map_values(keep), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(F.bitwise_not(bits))), F.lit(0).cast("long"))


def kept_text(text: Column, keep: Column) -> Column:
    """Lines that stay, joined by line breaks."""
    whole = F.coalesce(text, F.lit(""))

    def stays(_: Column, i: Column) -> Column:
        bits = F.coalesce(keep[F.shiftright(i, 6)], F.lit(-1).cast("long"))
        return F.getbit(bits, i.bitwiseAND(63)) == 1

    return F.when(keep.isNull(), whole).otherwise(F.array_join(F.filter(lines_of(text), stays), "\n"))
