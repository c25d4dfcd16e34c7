"""Building blocks that keep one huge key from becoming one huge task."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Rows that shrink much in a shuffle get several times the session's shuffle partitions, in a given number: merged by their
#: size in the shuffle they would not fit a task's memory.
PARTS = 4
#: And one more for so much of the files they are read from, so that a task holds no more of a larger input; or for so many
#: of their rows, as files in which values repeat are small beside their rows.
PART_BYTES = 2 << 20
PART_ROWS = 100_000
#: As many as one driver can keep account of, and buckets of a table.
MOST_PARTS = 20_000


def spread_partitions(df: DataFrame) -> int:
    session = PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, min(max(read_bytes(df) // PART_BYTES, read_rows(df) // PART_ROWS), MOST_PARTS))


def _read_paths(df: DataFrame) -> list:
    jvm = df.sparkSession.sparkContext._jvm
    return [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)) for file in df.inputFiles()]


def read_bytes(df: DataFrame) -> int:
    """Size of the files that `df` comes from; 0 where it comes from none."""
    settings = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    return sum(path.getFileSystem(settings).getFileStatus(path).getLen() for path in _read_paths(df))


def read_rows(df: DataFrame) -> int:
    """Rows of the Parquet files that `df` comes from, from the counts that these files state; no column is read."""
    paths = [path.toString() for path in _read_paths(df) if path.getName().endswith(".parquet")]
    if not paths:
        return 0
    names = [re.sub(r"([{}\[\]*?\\])", r"\\\1", path) for path in paths]
    # Folders say nothing here, and the files may have columns of their own each.
    return df.sparkSession.read.option("recursiveFileLookup", True).schema("row long").parquet(*names).count()


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of every key.

    Spark limits each map task to one row per key before the shuffle (window group limit), so
    a key made of many copies never travels or meets in one task as a whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], sequence: str = "seq") -> DataFrame:
    """One row per key: the one with the highest `sequence`, if there is such a column.

    Equal or absent numbers fall back to the other columns' order, so the choice never depends
    on how rows are read.
    """
    first = [F.desc_nulls_last(sequence)] if sequence in df.columns else []
    rest = [F.desc_nulls_last(c) for c in sorted(df.columns) if c not in keys and c != sequence]
    return first_per_key(df, keys, first + rest or [F.lit(1)])


def carry_forward(
    df: DataFrame, keys: list[str], position: str, values: list[str], block_size: int
) -> DataFrame:
    """Last non-null value before each row, in `position` order within `keys`.

    Rows without a key or position are left out. Positions are cut into blocks. Values are carried inside a block, then the last values of
    the earlier blocks (one row per block) fill the gap, so a key is never sorted as a whole.
    Each value comes back as `<name>_before`.
    """
    # Both branches below start from this one exchange, so `df` is computed once. The joins here and later ones infer that
    # keys are not null; said here first, and with a block that can't be null, no branch gets filters that the other lacks.
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, position]])
    block = F.coalesce(F.floor(F.col(position) / block_size), F.lit(0))
    df = df.where(known).withColumn("_block", block).repartition(*keys, "_block")
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.select("*", *[F.last(v, True).over(inside).alias(f"_{v}_in") for v in values])
    across = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = (
        df.groupBy(*keys, "_block")
        .agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(position))).alias(v) for v in values])
        .select(*keys, "_block", *[F.last(v, True).over(across).alias(f"_{v}_out") for v in values])
    )
    carried = [F.coalesce(f"_{v}_in", f"_{v}_out").alias(f"{v}_before") for v in values]
    return local.join(blocks, [*keys, "_block"]).select(*df.drop("_block").columns, *carried)


def as_of(points: DataFrame, events: DataFrame, keys: list[str], day: str, values: list[str], block_days: int = 366) -> DataFrame:
    """`points` with the `values` of the latest event of their keys on their `day` or before; null without any.

    An as-of join without a join of every point with every event: both are put in one order and values are carried
    forward in blocks of days (`carry_forward`), so a key with a long history is never sorted as a whole. `events` hold
    one row per key and day. Points may repeat; points and events without a day or key are left out or have no values.
    """
    place = F.unix_date(day).cast("long") * 2
    known = events.where(F.col(day).isNotNull()).select(
        *keys, place.alias("_at"), F.struct(*values).alias("_value"), F.lit(None).cast("int").alias("_copies")
    )
    asked = points.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(F.count("*").cast("int").alias("_copies"))
    asked = asked.select(*keys, (place + 1).alias("_at"), F.lit(None).cast(known.schema["_value"].dataType).alias("_value"), "_copies")
    carried = carry_forward(known.unionByName(asked), keys, "_at", ["_value"], block_days * 2)
    found = carried.where("_copies is not null").select(
        *keys,
        F.date_from_unix_date(((F.col("_at") - 1) / 2).cast("int")).alias(day),
        *[F.col(f"_value_before.{v}").alias(v) for v in values],
    )
    return points.join(found, [*keys, day], "left").select(*points.columns, *values)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median of a decimal(18,2) column per key, as double.

    Values are counted first, then the middle ranks are located in two steps: over ranges of
    65,536 cents, and inside the one or two ranges that hold them. No task sees all values of
    a key, whatever its size.
    """
    cents = (F.col(value) * 100).cast("long")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, cents.alias("_cents"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_range", F.floor(F.col("_cents") / 65536))
    )
    of_key = Window.partitionBy(*keys)
    ranges = (
        counts.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_range_n"))
        .select(
            *keys,
            "_range",
            "_range_n",
            F.sum("_range_n").over(of_key).alias("_total"),
            F.sum("_range_n").over(of_key.orderBy("_range")).alias("_upto"),
        )
        .withColumn("_start", F.col("_upto") - F.col("_range_n"))
        .withColumn("_low", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_high", F.floor(F.col("_total") / 2))
        .where("_start <= _high and _low < _upto")
        .select(*keys, "_range", "_start", "_low", "_high")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_cents")
    ranked = counts.join(ranges, [*keys, "_range"]).withColumn(
        "_upto", F.col("_start") + F.sum("_n").over(inside)
    )
    holds = (F.col("_upto") - F.col("_n") <= F.col("_high")) & (F.col("_low") < F.col("_upto"))
    # Whatever lies between the two middle ranks is one of them: the outer two are averaged.
    return (
        ranked.where(holds)
        .groupBy(*keys)
        .agg(((F.min("_cents") + F.max("_cents")) / 200).alias(name))
    )
