"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.llm.shelf import Shelf

WORD = r"[^\x20\x09-\x0D]+"
ROWS_IN_BUCKET = 4096
KEY_RANGE = 1 << 60


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(identity: Column, seed: str) -> Column:
    """60 hash bits of the id's text and a seed: uniform, and the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], epochs: int) -> DataFrame:
    """source, rank, source_size, target from one row per source (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn. They share `share` (a fraction) of all sizes by
    weight; none gets over `epochs` times its size, and the excess goes to the others by weight until none is above.
    That is a water level: with sources in order of cap per weight, those below the level are filled, the others get
    level * weight. The one-task windows hold one short row per source, not per document.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(turn) - 1).withColumn("weight", picked.cast("long"))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    capped_before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(capped_before), F.lit(0)).alias("below"),
        F.sum("weight").over(onwards).alias("open_weight"),
    )
    # Times share[1]: whole numbers, so that every engine finds the same level.
    rest = share[0] * F.col("total") - share[1] * epochs * F.col("below")
    open_ = rest * F.col("weight") <= share[1] * epochs * F.col("source_size") * F.col("open_weight")
    # The first source in fill order whose level stays within its cap sets the level of all from there on.
    first = levels.withColumn("fits", open_ & (F.col("source_size") > 0))
    reached = F.max(F.col("fits").cast("int")).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = F.struct(rest.alias("rest"), F.col("open_weight").alias("open_weight"))
    at_level = F.first(F.when(F.col("fits"), level), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return first.select("*", reached.alias("reached"), at_level.alias("at")).select(
        "source",
        "rank",
        "source_size",
        F.when(
            F.col("reached") == 1,
            F.col("at.rest") * F.col("weight") / (F.lit(float(share[1])) * F.col("at.open_weight")),
        )
        .otherwise(F.lit(float(epochs)) * F.col("source_size"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    epochs: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, repeats, taken.

    Every document gets a hash-random key. A source is cut into key ranges of about `ROWS_IN_BUCKET` rows (the keys are
    uniform, so ranges of equal width hold about equally many); sizes are summed per range, the sums accumulated over
    ranges, and inside a range rows are sorted by key and accumulated from there. A source gives all its documents once
    per whole epoch in its target; of the next epoch it gives the documents in key order up to the rest of the budget.
    The document at the cut is taken if at least half of it fits, so a source misses its target by half a document.

    taken = repeats * size, and repeats never exceeds `epochs`. Null and empty texts have size 0 and are never taken
    (repeats 0). A null source is a source of its own, last in order; an empty string is another. Equal ids share a key
    and are ordered by size; equal rows are interchangeable. Without any words all targets are 0. An empty table gives
    no rows; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "mix")
    sized = shelf.put(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            random_key(F.col(id_col), seed).alias("key"),
        )
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = shelf.put(totals)
    targets = source_targets(totals.select("source", "source_size"), weights, share, epochs)
    plan = shelf.put(
        targets.join(totals.select(F.col("source").alias("of"), "n"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    )
    # The number of ranges differs by source, so the rows need it before they can be dealt out: width from the row count.
    counts = plan.select(F.col("source").alias("of"), "rank", "n")
    numbered = sized.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ranges = F.ceil(F.col("n") / ROWS_IN_BUCKET)
    placed = shelf.put(
        numbered.select(
            "id", "rank", "size", "key", F.floor(F.col("key") / F.ceil(F.lit(float(KEY_RANGE)) / ranges)).alias("range")
        )
    )
    sums = placed.groupBy("rank", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("start"))
    starts = shelf.put(starts.join(plan.select("rank", "source", "source_size", "target"), "rank"))
    shelf.keep(placed, starts)
    inside = Window.partitionBy("rank", "range").orderBy("key", "id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumn("upto", F.sum("size").over(inside)).join(starts, ["rank", "range"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - whole * F.col("source_size")
    fits = 2 * (F.col("start") + F.col("upto")) - F.col("size") <= 2 * left
    repeats = F.when(F.col("size") > 0, whole + F.when(fits, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        repeats.alias("repeats"),
        (repeats * F.col("size")).alias("taken"),
    )


def draw(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents, with all their columns, in as many rows as the mix takes each. Needs distinct ids.

    Rows that repeat an id are each taken as often as the most taken of them. Documents that the mix leaves out, and
    those without words, give no row.
    """
    mixed = mix(docs, id_col=id_col, **how).filter("repeats > 0")
    mixed = mixed.groupBy(F.col(id_col).alias("_of")).agg(F.max("repeats").cast("int").alias("_repeats"))
    joined = docs.join(mixed, docs[id_col].eqNullSafe(mixed["_of"]))
    time = "_time"
    while time in docs.columns:
        time += "_"
    times = joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), mixed["_repeats"])).alias(time))
    return times.drop(time)
