"""Row numbers and running sums over a whole table without a task that sees all rows.

Rows are dealt into ranges of the order; each range counts and sums its own rows, and the totals of the ranges before
it (one row a range) are added. The ranges are written once, so the counts and the rows come from the same deal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small, stored


def dealt(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``, the number of the range of ``order`` that a row falls into; equal rows fall together."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def before_each(dealt_rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_part, one column for each of ``sums``): totals of the ranges before each range; one row a range."""
    per = dealt_rows.groupBy("_part").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    return per.select("_part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums))


def numbered(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with its row number (from 0) in ``order``; ties are numbered in any order."""
    rows = dealt(df, order, parts)
    start = before_each(rows, {"_start": F.lit(1)})
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(F.broadcast(start), "_part").withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_part", "_own", "_start")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """``df`` with the sum of each column of ``sums`` (new name: column) over the rows up to and with its ties."""
    rows = dealt(df, order, parts)
    start = before_each(rows, {f"_{name}": F.col(c) for name, c in sums.items()})
    upto = Window.partitionBy("_part").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *(F.sum(c).over(upto).alias(name) for name, c in sums.items()))
    added = {name: F.col(name) + F.col(f"_{name}") for name in sums}
    return own.join(F.broadcast(start), "_part").withColumns(added).drop("_part", *(f"_{name}" for name in sums))


def with_next(df: DataFrame, column: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` of distinct values with the next larger one of ``column``; null for the largest."""
    rows = dealt(df, [F.col(column)], parts)
    later = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    after = rows.groupBy("_part").agg(F.min(column).alias("_least")).select("_part", F.min("_least").over(later).alias("_after"))  # one row a range
    own = F.lead(column).over(Window.partitionBy("_part").orderBy(column))
    return rows.withColumn("_own", own).join(F.broadcast(after), "_part").withColumn(name, F.coalesce("_own", "_after")).drop("_part", "_own", "_after")


def percentiles(df: DataFrame, value: str, by: list[str], points: dict[str, float], rounds: int = 8, bins: int = 256) -> DataFrame:
    """(``by``, n, mean, a column for each of ``points``): exact percentiles with linear interpolation, by selection.

    Each wanted position is narrowed to one of ``bins`` equal parts of its interval in every round, by counts alone, so
    a group of any size holds a few numbers; the values of the last interval, which hold the position, are then sorted
    in part: only those that are left once an interval holds no more than ``bins`` rows or a single value. Nulls are no
    values; a group without values has nulls.
    """
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    groups = v.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    lower = lambda p: F.floor(F.lit(p) * (F.col("n") - 1)).cast("long")
    places = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), F.least(lower(p) + side, F.col("n") - 1).alias("at")) for name, p in points.items() for side in (0, 1)))
    # A target: the place of a value in its group, and an interval of values that holds it, with the rows before it.
    todo = groups.select(*by, F.explode(places).alias("_t"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("n").alias("_inside")).select(*by, "_t.name", "_t.side", F.col("_t.at").alias("_at"), "_lo", "_hi", "_before", "_inside")
    todo = stored(todo, "targets")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by] or [F.lit(True)]
    for _ in range(rounds):
        open_ = todo.where((F.col("_lo") < F.col("_hi")) & (F.col("_inside") > bins))
        if open_.isEmpty():
            break
        width = (F.col("_hi") - F.col("_lo")) / bins
        bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
        cond = [*same("a", "b"), F.col("_v").between(F.col("_lo"), F.col("_hi"))]
        hits = v.alias("a").join(small(open_).alias("b"), cond).select(*(F.col(f"b.{c}") for c in by), "name", "side", "_v", bin_.alias("_bin"))
        counts = hits.groupBy(*by, "name", "side", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        upto = F.sum("_c").over(Window.partitionBy(*by, "name", "side").orderBy("_bin"))
        keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "name", "side")]
        found = counts.withColumn("_upto", upto).alias("a").join(small(open_).alias("b"), keys)
        rest = F.col("_at") - F.col("_before")
        found = found.where((rest < F.col("_upto")) & (rest >= F.col("_upto") - F.col("_c")))
        next_ = found.select(*(F.col(f"b.{c}") for c in by), "b.name", "b.side", "_at", F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"), F.col("_c").alias("_inside"))
        todo = stored(next_.unionByName(todo.where((F.col("_lo") >= F.col("_hi")) | (F.col("_inside") <= bins))), "targets")
    few = v.alias("a").join(small(todo.where("_lo < _hi")).alias("b"), [*same("a", "b"), F.col("_v").between(F.col("_lo"), F.col("_hi"))])
    ordered = few.select(*(F.col(f"b.{c}") for c in by), "name", "side", "_v", (F.row_number().over(Window.partitionBy(*(F.col(f"b.{c}") for c in by), "name", "side").orderBy("_v")) - 1 + F.col("_before")).alias("_place"), "_at")
    picked = ordered.where("_place = _at").select(*by, "name", "side", F.col("_v").alias("_x")).unionByName(todo.where("_lo >= _hi").select(*by, "name", "side", F.col("_lo").alias("_x")))
    wide = picked.groupBy(*by).agg(*(F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_x"))).alias(f"_{name}{side}") for name in points for side in (0, 1)))
    part = lambda p: F.lit(p) * (F.col("n") - 1) - lower(p)
    between = lambda name, p: (1 - part(p)) * F.col(f"_{name}0") + part(p) * F.col(f"_{name}1")
    keys = [F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by] or [F.lit(True)]
    every = df.select(*by).groupBy(*by).agg(F.lit(1).alias("_one")) if by else df.agg(F.lit(1).alias("_one"))
    whole = every.alias("e").join(groups.alias("g"), [F.col(f"e.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by] or [F.lit(True)], "left").join(wide.alias("w"), keys, "left")
    return whole.select(*(F.col(f"e.{c}") for c in by), F.coalesce(F.col("g.n"), F.lit(0)).alias("n"), F.col("g.mean").alias("mean"), *(between(name, p).alias(name) for name, p in points.items()))
