"""Joins that Spark has no operator for: intervals, nearest earlier row, grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.operators.graph import cut


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Pairs of a point and a span of its key with start <= at < end; an open end is null on either side.

    Time is cut into buckets: a span goes to every bucket it meets, a point to its own, and an equi-join on
    (key, bucket) replaces the nested loop. Choose a bucket of about the usual span length. Spans with an open end
    go to a second equi-join on the key alone."""
    cell = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    spans = spans.withColumn("__id", F.monotonically_increasing_id())
    closed = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    closed = closed.withColumn("__cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    fits = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    got = points.withColumn("__cell", cell(F.col(at))).join(closed, [key, "__cell"]).filter(fits).drop("__cell", "__id")
    opened = spans.filter(F.col(start).isNull() | F.col(end).isNull()).drop("__id")
    fits = (F.col(start).isNull() | (F.col(at) >= F.col(start))) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    got = got.unionByName(points.join(opened, key).filter(fits))
    return got


def first_match(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, order: str, value: str, bucket: float) -> DataFrame:
    """points with the value of the span of least `order` that holds the point, null if none does."""
    p = cut(points.withColumn("__row", F.monotonically_increasing_id()))  # both uses must see the same numbers
    got = interval_join(p.select("__row", key, at), spans.select(key, start, end, order, value), key, at, start, end, bucket)
    best = got.groupBy("__row").agg(F.min_by(value, order).alias(value))
    return p.join(best, "__row", "left").drop("__row")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with `values` of the right row of its key with the latest right_at <= left_at, of several the one of greatest values.

    One union, one window: the last right row so far is carried forward, so neither side is multiplied."""
    tagged = left.withColumn("__side", F.lit(1)).withColumn("__at", F.col(left_at)).withColumn("__value", F.lit(None).cast(
        "struct<" + ", ".join(f"`{v}`:{dict(right.dtypes)[v]}" for v in values) + ">"))
    other = right.select(
        key, F.lit(0).alias("__side"), F.col(right_at).alias("__at"), F.struct(*values).alias("__value"))
    w = Window.partitionBy(key).orderBy("__at", "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(other, allowMissingColumns=True)
    got = both.withColumn("__found", F.last("__value", True).over(w)).filter("__side = 1")
    return got.select(*left.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


#: Rows of a cell that are kept together at most, but for chance; pairs of such chunks are dealt over the tasks.
CHUNK = 512


def _chunks(df: DataFrame, x: str, y: str, side: float, by: list[str]) -> DataFrame:
    """The rows of df as arrays (__rows, __n of them, within the box __x0..__y1), each of one cell; rows with null, NaN or infinite coordinates are left out.

    A cell of more than CHUNK rows is cut: into 16 parts, so that the boxes are small, and those by a hash of the whole row."""
    names = df.columns
    at = lambda c, s, k: F.floor(F.col(c) / F.lit(s)).cast("long").alias(f"__{k}")
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    parts = [F.pmod(F.floor(F.col(c) / F.lit(side / 4)).cast("long"), F.lit(4)) for c in (x, y)]
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = df.filter(finite(x) & finite(y)).select(
        *[F.col(f"`{c}`") for c in by], at(x, side, "cx"), at(y, side, "cy"), (parts[0] * 4 + parts[1]).alias("__part"),
        F.xxhash64(*hashed).alias("__hash"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("__row"))
    cell = [*by, "__cx", "__cy"]
    sizes = rows.groupBy(*cell, "__part").agg(F.count("*").alias("__m"))
    large = sizes.groupBy(*cell).agg(F.sum("__m").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__part", "__m"))).alias("__in")).filter(F.col("__all") > CHUNK)
    cut_up = F.col("__all").isNotNull()
    salts = F.ceil(F.col("__in")[F.col("__part")] / F.lit(CHUNK / 2)).cast("long")
    rows = rows.join(large, cell, "left").select(
        *cell, F.when(cut_up, F.col("__part")).otherwise(F.lit(-1)).alias("__part"), F.when(cut_up, F.pmod("__hash", salts)).otherwise(F.lit(0)).alias("__salt"), "__row")
    px, py = (F.col(f"__row.c{names.index(c)}") for c in (x, y))
    got = rows.groupBy(*cell, "__part", "__salt").agg(
        F.collect_list("__row").alias("__all"), F.min(px).alias("__x0"), F.max(px).alias("__x1"), F.min(py).alias("__y0"), F.max(py).alias("__y1"))
    # many equal rows have one hash
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / F.lit(2 * CHUNK)).cast("int")), lambda i: F.slice("__all", i * (2 * CHUNK) + 1, 2 * CHUNK))
    got = got.select(*[c for c in got.columns if c != "__all"], F.posexplode(pieces).alias("__piece", "__rows"))
    return cut(got)


def grid_join(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, distance: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of points (with equal `by` columns) within a planar distance.

    The rows of a cell meet as arrays: an equi-join of chunks' keys and boxes over a cell and its eight neighbours finds the pairs of chunks
    whose boxes are near enough, these are dealt evenly over the tasks, which pair their rows and make the exact test.
    So a cell of many points is no task of its own, and what is shuffled is the output's size over CHUNK at most, or the input's."""
    by = list(by or [])
    # cells are a little wider than the distance: a quotient's rounding never parts neighbours by two cells
    side = abs(distance) * 1.0001 or 1.0
    key = [*by, "__cx", "__cy", "__part", "__salt", "__piece"]
    box = ["__x0", "__x1", "__y0", "__y1"]
    lc, rc = (_chunks(df, x, y, side, by).select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key)], *box, "__rows") for df, x, y in ((left, lx, ly), (right, rx, ry)))
    ids = [f"__k{i}" for i in range(len(key))]
    kx, ky = ids[len(by)], ids[len(by) + 1]
    named = lambda df, tag, extra: df.select(*[F.col(c).alias(f"{tag}{c}") for c in [*ids, *extra]])
    near = F.explode(F.array(*[F.struct((F.col(f"r{kx}") + i).alias("x"), (F.col(f"r{ky}") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a, b = named(lc, "l", box), named(rc, "r", box).withColumn("__near", near)
    meet = [F.col(f"l{i}") == F.col(f"r{i}") for i in ids[: len(by)]] + [F.col(f"l{kx}") == F.col("__near.x"), F.col(f"l{ky}") == F.col("__near.y")]
    gap = lambda c: F.greatest(F.lit(0.0), (F.col(f"r__{c}0") - F.col(f"l__{c}1")).cast("double"), (F.col(f"l__{c}0") - F.col(f"r__{c}1")).cast("double"))
    pairs = a.join(b, meet).filter(gap("x") * gap("x") + gap("y") * gap("y") <= distance * distance * 1.00001).select(*[f"{t}{i}" for t in "lr" for i in ids])
    spark = left.sparkSession
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both = pairs.join(named(lc, "l", ["__rows"]), [f"l{i}" for i in ids]).join(named(rc, "r", ["__rows"]), [f"r{i}" for i in ids])
    both = both.repartition(tasks, *[f"{t}{i}" for t in "lr" for i in ids]).select(F.explode("l__rows").alias("l"), "r__rows").select("l", F.explode("r__rows").alias("r"))
    nth = lambda side, df, c: F.col(f"{side}.c{df.columns.index(c)}")
    dx, dy = nth("l", left, lx) - nth("r", right, rx), nth("l", left, ly) - nth("r", right, ry)
    close: Column = dx * dx + dy * dy <= distance * distance
    keep = [(side, df, c) for side, df in (("l", left), ("r", right)) for c in df.columns if c not in by]
    return both.filter(close).select(*[nth("l", left, c).alias(c) for c in by], *[nth(*k).alias(k[2]) for k in keep])
