"""Spellings of one payer, found by a q-gram set-similarity join inside each application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

APP = "application_id"
GRAM = 3
#: Spellings share at least one of two of their grams, and are at most so many edits apart.
MAX_EDITS = 2

Stage = Callable[[DataFrame, str], DataFrame]


def payer_key(payer: Column) -> Column:
    """The letters of a payer, in upper case, words parted by one space: reference numbers and signs don't count."""
    return F.trim(F.regexp_replace(F.upper(payer), "[^\\p{L}]+", " "))


def key_grams(key: Column) -> Column:
    """Different runs of GRAM characters of the key, which is parted from what surrounds it by a space."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(GRAM))))


def similar_keys(keys: DataFrame) -> DataFrame:
    """application_id, a, b (a < b): keys with at least half of their grams in common and at most MAX_EDITS edits apart.

    `keys` has different (application_id, key). Grams are ordered by how few keys of the application have them. Two keys
    that share half of their grams share one of the first n - ceil(n / 2) + 1 of either, so only those are matched, and
    only where the numbers of grams allow it. A pair counts under the first of the prefix grams that it shares; edits are
    counted for pairs that the grams leave. Only similar pairs leave the join: its candidates are never a table.
    """
    listed = keys.select(APP, "key", F.explode(key_grams(F.col("key"))).alias("gram"))
    counts = listed.groupBy(APP, "gram").agg(F.count("*").alias("keys"))
    ordered = F.sort_array(F.collect_list(F.struct("keys", "gram")))
    grams = listed.join(counts.hint("merge"), [APP, "gram"]).groupBy(APP, "key").agg(ordered.alias("found"))
    n = F.size("found")
    first = F.slice("found", F.lit(1), n - F.ceil(n / 2).cast("int") + 1)
    sets = grams.select(APP, "key", F.transform("found", lambda g: g["gram"]).alias("grams"), F.transform(first, lambda g: g["gram"]).alias("prefix"))
    placed = sets.select(APP, F.explode("prefix").alias("gram"), "key", "grams", "prefix")
    a, b = placed.alias("a"), placed.alias("b")
    size_a, size_b = F.size("a.grams"), F.size("b.grams")
    meet = (F.col(f"a.{APP}") == F.col(f"b.{APP}")) & (F.col("a.gram") == F.col("b.gram")) & (F.col("a.key") < F.col("b.key"))
    close = (size_a <= 2 * size_b) & (size_b <= 2 * size_a)
    first_shared = F.get(F.array_intersect("a.prefix", "b.prefix"), F.lit(0)) == F.col("a.gram")
    enough = 3 * F.size(F.array_intersect("a.grams", "b.grams")) >= size_a + size_b
    edits = F.levenshtein(F.col("a.key"), F.col("b.key"), MAX_EDITS)
    return (
        a.join(b.hint("merge"), meet & close)
        .where(first_shared & enough & (edits >= 0))
        .select(F.col(f"a.{APP}").alias(APP), F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    )


def smallest_linked(links: DataFrame, stage: Stage) -> DataFrame:
    """application_id, key, root: each linked key with the least key that links lead to.

    Alternates between two steps, each a grouping by node: every node gives its larger neighbours, then its smaller
    ones, the least of them all. Stars remain, whose centres are the roots; the rounds grow with the logarithm of the
    size. Each round is written by `stage`, so that no plan grows. Written tables are far smaller than their rows in
    memory, so their joins are sort-merge joins: by its files' size a table of millions of rows would go to the driver to
    be broadcast.
    """

    def least_of(edges: DataFrame) -> DataFrame:
        """edges with each node's least neighbour, itself included."""
        least = edges.groupBy(APP, "u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        return edges.join(least.hint("merge"), [APP, "u"])

    def both_ways(edges: DataFrame) -> DataFrame:
        return edges.unionByName(edges.select(APP, F.col("v").alias("u"), F.col("u").alias("v")))

    edges = stage(links.select(APP, F.col("a").alias("v"), F.col("b").alias("u")).distinct(), "payer_links")
    while True:
        large = least_of(both_ways(edges)).where("v > u").select(APP, F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = least_of(large)
        new = small.select(APP, "u", F.col("least").alias("v")).unionByName(
            small.where("v <> least").select(APP, F.col("v").alias("u"), F.col("least").alias("v"))
        )
        new = stage(new.distinct(), "payer_links")
        if not new.exceptAll(edges).limit(1).count() and not edges.exceptAll(new).limit(1).count():
            break
        edges = new
    centres = new.select(APP, F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    return new.select(APP, F.col("u").alias("key"), F.col("v").alias("root")).unionByName(centres)


def payer_variants(ledger: DataFrame, stage: Stage) -> DataFrame:
    """application_id, payer_or_source, payer_key, payer: each different payer of an application and the name it goes by.

    Payers with one key, or whose keys similar keys connect, are one. It goes by the spelling with most rows (of several,
    the first in order). A payer without letters is one of its own. Null payers have no row.
    """
    rows = ledger.where(F.col("payer_or_source").isNotNull())
    counted = rows.groupBy(APP, "payer_or_source").agg(F.count("*").alias("n"))
    named = stage(counted.withColumn("payer_key", payer_key(F.col("payer_or_source"))), "payers")
    keys = stage(named.where("payer_key <> ''").select(APP, F.col("payer_key").alias("key")).distinct(), "payer_keys")
    roots = smallest_linked(similar_keys(keys), stage)
    group = F.coalesce("root", "payer_key")
    of_payer = named.join(roots.withColumnRenamed("key", "payer_key").hint("merge"), [APP, "payer_key"], "left").withColumn(
        "group", F.when(F.col("payer_key") == "", F.concat(F.lit("="), "payer_or_source")).otherwise(group)
    )
    of_payer = stage(of_payer.select(APP, "payer_or_source", "payer_key", "n", "group"), "payers")
    name = F.min_by("payer_or_source", F.struct(-F.col("n"), "payer_or_source"))
    names = of_payer.groupBy(APP, "group").agg(name.alias("payer"))
    return of_payer.join(names.hint("merge"), [APP, "group"]).select(APP, "payer_or_source", "payer_key", "payer")


def with_one_name(ledger: DataFrame, variants: DataFrame) -> DataFrame:
    """The ledger with each payer under the name it goes by, for summaries and concentration by payer."""
    names = variants.select(F.col(APP).alias("_app"), F.col("payer_or_source").alias("_payer"), F.col("payer").alias("_name"))
    same = (F.col(APP) == F.col("_app")) & (F.col("payer_or_source") == F.col("_payer"))
    joined = ledger.join(names.hint("merge"), same, "left")
    return joined.select(*[F.coalesce("_name", "payer_or_source").alias(c) if c == "payer_or_source" else ledger[c] for c in ledger.columns])
