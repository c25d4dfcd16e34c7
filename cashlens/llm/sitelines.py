"""Boilerplate lines by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.llm.shelf import Shelf

WHITE = " \t\n\x0b\x0c\r"
#: Lines on so many sites are boilerplate.
MIN_SITES = 5
#: Sketches have 2^LOG_REGISTERS registers; their relative standard error is about 1.04 / 2^(LOG_REGISTERS / 2).
LOG_REGISTERS = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
DEVIATIONS = 6


def line_key(line: Column) -> Column:
    """128 bits of a line without outer white space, as two hashes; null for a line without anything else."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b")))


def spread_lines(lines: DataFrame, shelf: Shelf, min_sites: int) -> DataFrame:
    """key, n_sites of the lines on at least `min_sites` sites, from (key, site).

    Map tasks sketch the sites of each line; the sketches of a line are merged by aggregation. Only lines whose estimate
    could be on the wrong side of `min_sites` are brought back to their sites, of which distinct ones are counted.
    """
    lines = lines.filter("key IS NOT NULL AND site IS NOT NULL")
    sketches = lines.groupBy("key").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
    spread = sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
    band = max(1.0, DEVIATIONS * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites)
    spread = shelf.put(spread.filter(F.col("estimate") >= min_sites - band))
    sure = spread.filter(F.col("estimate") > min_sites + band).select("key", F.col("estimate").alias("n_sites"))
    near = spread.filter(F.col("estimate") <= min_sites + band).select("key")
    pairs = lines.join(near, "key", "left_semi").select("key", "site").distinct()
    counted = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_sites"))
    return shelf.put(sure.unionByName(counted.filter(F.col("n_sites") >= min_sites)))


def drop_spread_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """One row per input row: id, text without boilerplate lines, n_lines, n_removed.

    A line is boilerplate if it stands, apart from outer white space, on at least `min_sites` distinct sites; every such
    line goes, wherever it is, with its line break, and all other lines stay as they are and in order. Lines are what
    stands between line feeds. Lines without anything but white space always stay. A null text stays null, with no
    lines; a null site lends no spread to lines, and its lines go like others. Rows may repeat. An empty table gives no
    rows; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "lines")
    source = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site")
    )
    pieces = F.split("text", "\n", -1)
    lines = source.select("site", F.explode(pieces).alias("line")).select("site", line_key(F.col("line")).alias("key"))
    spread = spread_lines(lines, shelf, min_sites)
    # Only (text, key) pairs of boilerplate travel: a text is named by its own hash, so equal texts are settled once.
    name = F.unhex(F.md5("text")).alias("of")
    located = source.select(name, F.explode(F.array_distinct(F.transform(pieces, line_key))).alias("key"))
    hits = located.filter("key IS NOT NULL").join(spread, "key", "left_semi")
    hits = shelf.put(hits.groupBy("of").agg(F.collect_set("key").alias("drop")))
    shelf.keep(hits)
    named = source.withColumn("name", name)
    marked = named.join(hits, F.col("name") == F.col("of"), "left")
    stays = lambda line: ~F.coalesce(F.array_contains("drop", line_key(line)), F.lit(False))
    kept = F.when(F.col("drop").isNull(), pieces).otherwise(F.filter(pieces, stays))
    counted = marked.select("id", "text", pieces.alias("all"), kept.alias("kept"))
    return counted.select(
        F.col("id").alias(id_col),
        F.array_join("kept", "\n").alias(text_col),
        F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("all") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
    )
