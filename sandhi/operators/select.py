"""Selection: keep-first, running-sum cut-offs, round robin, caps, shards, chunks, samples.

Orders are explicit (a column, or the SHA-1 of a seed and the key), so results do not depend on
partitioning. Running sums over a whole table go through ``running_before``, which sums ranges of the
order first, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, key: Column) -> Column:
    """Text that orders keys at random, the same for every run."""
    return F.sha1(F.encode(F.concat(F.lit(f"{seed}|"), key.cast("string")), "UTF-8"))


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def running_before(df: DataFrame, order: Column, value: Column, name: str = "before") -> DataFrame:
    """Adds the sum of value over all rows ordered before, order being a hexadecimal text (see seeded), whose
    first three digits cut the order into 4,096 ranges; null values count as 0."""
    d = df.withColumn("_o", order).withColumn("_v", F.coalesce(value, F.lit(0))).withColumn("_r", F.substring("_o", 1, 3))
    ranges = d.groupBy("_r").agg(F.sum("_v").alias("_s"))  # 4,096 rows at most
    offset = ranges.withColumn("_off", F.coalesce(F.sum("_s").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_r").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_in", inside).join(offset, "_r").withColumn(name, F.col("_off") + F.col("_in")).drop("_o", "_v", "_r", "_in", "_off")


def until(df: DataFrame, order: Column, value: Column, target: float) -> DataFrame:
    """Rows in order while the sum before them is below the target: overshoots by one row at most."""
    return running_before(df, order, value, "_b").where(F.col("_b") < target).drop("_b")


def ranked(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """0, 1, ... over the whole table in a seeded order."""
    return running_before(df, order, F.lit(1), name)


def rank_within(df: DataFrame, group: Column, order: Column, name: str = "rank") -> DataFrame:
    """0, 1, ... inside each group in a seeded order (see seeded). A group may hold a third of all rows: ranks
    are counted in the 4,096 ranges of the order, offset by the counts of the group's ranges before."""
    d = df.withColumn("_g", group).withColumn("_o", order).withColumn("_r", F.substring("_o", 1, 3))
    ranges = d.groupBy("_g", "_r").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    offset = ranges.select(F.col("_g").alias("_h"), F.col("_r").alias("_s"), F.coalesce(before, F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_g", "_r").orderBy("_o")) - 1
    j = d.withColumn("_in", inside).join(offset, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_r") == F.col("_s")))
    return j.withColumn(name, F.col("_off") + F.col("_in")).drop("_g", "_o", "_r", "_h", "_s", "_off", "_in")


def round_robin(df: DataFrame, group: Column, key: Column, value: Column, target: float, seed: int = 1234) -> DataFrame:
    """First rows of all groups, then second ones, ..., until the target; groups and rows in seeded order.
    The layer that crosses the target is found by sums of 4,096 layers first."""
    g = F.coalesce(group, F.lit(""))
    d = rank_within(df, g, seeded(seed, key), "_depth")
    per = d.groupBy("_depth").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_sum"))

    def crossing(t: DataFrame, at: str, start: float) -> tuple[int, float] | None:
        """The last of t's rows in the order of ``at`` before which the sum is below the target."""
        above = t.withColumn("_above", F.lit(start) + F.coalesce(F.sum("_sum").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        got = above.where(F.col("_above") < target).orderBy(F.desc(at)).limit(1).select(at, "_above").collect()
        return (got[0][0], got[0][1]) if got else None

    block = F.floor(F.col("_depth") / 4096)
    outer = crossing(per.groupBy(block.alias("_block")).agg(F.sum("_sum").alias("_sum")), "_block", 0)
    last = outer and crossing(per.where(block == outer[0]), "_depth", outer[1])
    if not last:
        return d.drop("_depth").limit(0)
    # whole layers below the target are taken as they are; only the layer that crosses it is ordered inside
    whole = d.where(F.col("_depth") < last[0]).drop("_depth")
    edge = d.where(F.col("_depth") == last[0]).drop("_depth")
    return whole.unionByName(until(edge, seeded(seed, g), value, target - last[1]))


def until_in_order(df: DataFrame, part: Column, place: list[Column], value: Column, target: float) -> DataFrame:
    """Rows of the parts (archives, recordings), in order of part and place, while the sum before them is below
    the target: parts are summed first, so a task sees one part at a time. Null values count as 0."""
    d = df.withColumn("_p", part).withColumn("_v", F.coalesce(value, F.lit(0)))
    parts = d.groupBy("_p").agg(F.sum("_v").alias("_s"))  # one row a part
    offset = parts.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    reached = offset.where(F.col("_off") < target)
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_p").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(reached, "_p").withColumn("_in", inside).where(F.col("_off") + F.col("_in") < target).drop("_p", "_v", "_off", "_in")


def capped(df: DataFrame, key: Column, order: list[Column], cap: int) -> DataFrame:
    """At most cap rows a key; rows with a null or empty key are never capped, a cap of 0 is none."""
    if cap <= 0:
        return df
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    free = key.isNull() | (key == "")
    return df.where(free).unionByName(df.where(~free).withColumn("_n", n).where(F.col("_n") <= cap).drop("_n"))
