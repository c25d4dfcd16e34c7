"""Exact dedup by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.llm.shelf import Shelf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text. Pure ASCII takes lower(), which does the same there, faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of their folded text. Where several rows share a hash, their bytes are compared: those
    rows alone are grouped by (hash, text), so map tasks combine the copies of a text before the shuffle and two texts
    that share a hash stay apart. Of a group the row with the largest id stays (`keep="min"`: the smallest). Ids order before null.

    Null and empty texts are one group. Rows that repeat an id and a text count one by one in group_size and are all
    marked kept if theirs is the id that stays. An empty table gives no rows; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "exact")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    body = folded(F.col("text"))
    marks = shelf.put(
        source.select("id", body.alias("body")).select(
            "id", F.unhex(F.md5("body")).alias("hash"), F.sha2("body", 256).alias("text_sha256")
        )
    )
    shared = shelf.put(marks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    alike = shelf.put(marks.join(shared, "hash", "left_semi").select(F.col("id").alias("alike_id")))
    # Only rows of a hash group with several rows send their bytes. Texts of one hash but different bytes part here; the
    # digest names the part from then on.
    texts = source.join(alike, source["id"].eqNullSafe(alike["alike_id"]), "left_semi").select("id", body.alias("body"))
    best = F.max("id") if keep == "max" else F.min("id")
    classes = shelf.put(
        texts.groupBy(F.unhex(F.md5("body")).alias("hash"), "body")
        .agg(best.alias("keep_id"), F.count(F.lit(1)).alias("size"))
        .select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "size")
        .filter("size > 1")
    )
    shelf.keep(marks, classes)
    joined = marks.join(classes, "text_sha256", "left")
    keep_id = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns. Needs distinct ids; a repeated kept id keeps each of its rows."""
    stays = exact_groups(docs, id_col, text_col, keep).filter("kept").select(F.col(id_col).alias("_stay")).distinct()
    return docs.join(stays, docs[id_col].eqNullSafe(stays["_stay"]), "left_semi")
