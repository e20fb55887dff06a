"""Relational operators that Spark SQL has no syntax for, as DataFrame rewrites."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.sources.storage import new_path


def ordered(*columns: str | Column) -> list[Column]:
    """Ascending with nulls last; a leading '-' means descending with nulls first."""
    out = []
    for c in columns:
        if isinstance(c, str):
            out.append(F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_last())
        else:
            out.append(c)
    return out


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group of equal keys in the given order."""
    w = Window.partitionBy(*keys).orderBy(*ordered(*order))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def lockstep(df: DataFrame, **arrays: Column) -> DataFrame:
    """Several set-returning columns side by side; shorter ones are padded with nulls."""
    zipped = F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))
    out = df.withColumn("_row", F.explode(zipped))
    return out.select(*df.columns, *(F.col("_row").getField(n).alias(n) for n in arrays))


def groups_frame(df: DataFrame, partition: Sequence[str], order: str, before: int, after: int, aggregate: Callable[[], Column], name: str) -> DataFrame:
    """An aggregate over the GROUPS frame from `before` peer groups back to `after` ahead."""
    part = Window.partitionBy(*partition)
    ranked = df.withColumn("_peer", F.dense_rank().over(part.orderBy(*ordered(order))))
    return ranked.withColumn(name, aggregate().over(part.orderBy("_peer").rangeBetween(-before, after))).drop("_peer")


#: Aggregates that excluded() knows, by what two parts of a frame are put together with.
_PARTS: dict[str, Callable[[str], Column]] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _together(kind: str, parts: Sequence[Column]) -> Column:
    if kind == "count":
        return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
    if kind == "sum":
        return reduce(lambda a, b: F.coalesce(a + b, a, b), parts)
    return F.greatest(*parts) if kind == "max" else F.least(*parts)


#: Bytes of a table, as its files hold it, that a task sorts; and the most tasks that an estimate may ask for.
TASK_BYTES, MOST_TASKS = 4 << 20, 20_000


def tasks(df: DataFrame) -> int:
    """How many tasks its size asks for."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(-(-size // TASK_BYTES), MOST_TASKS)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, for costly work on rows: a file of one row group is read by one task, however large it is."""
    return df.repartition(max(tasks(df), 2 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df by its keys over more tasks the larger it is, so that what one task sorts does not grow with it."""
    n = tasks(df)
    return df.repartition(n, *keys) if keys and n > df.sparkSession.sparkContext.defaultParallelism else df


def excluded(df: DataFrame, kind: str, value: str, partition: Sequence[str], order: Sequence[str | Column], start: int, end: int, exclude: str, name: str) -> DataFrame:
    """excluded_all() of one aggregate."""
    return excluded_all(df, {name: kind}, value, partition, order, start, end, exclude)


def excluded_all(df: DataFrame, named: dict[str, str], value: str, partition: Sequence[str], order: Sequence[str | Column], start: int, end: int, exclude: str) -> DataFrame:
    """df with aggregates (sum, count, min, max, avg, by their new names) over a ROWS frame without the current row, its peer group, or its ties.

    The frame must hold the current row. What is left of it stands before and after what
    is left out, so each side is a frame of its own: nothing is subtracted, and a side that runs to the
    partition's end costs one pass. A bounded side is a list no longer than the frame says. All aggregates share the passes.
    """
    if not start <= 0 <= end:
        raise ValueError("the frame must hold the current row")
    part = Window.partitionBy(*partition)
    rows = dealt(df, partition)
    if exclude == "current row":
        rows = rows.withColumn("_at", F.row_number().over(part.orderBy(*ordered(*order))))
    else:
        rows = rows.withColumn("_peer", F.dense_rank().over(part.orderBy(*ordered(*order)))).withColumn("_at", F.row_number().over(part.orderBy("_peer")))
    kinds = sorted({k for kind in named.values() for k in (("sum", "count") if kind == "avg" else (kind,))})
    sides: dict[str, list[Column]] = {k: [] for k in kinds}
    for reach, least, ahead in ((start, start <= Window.unboundedPreceding, False), (end, end >= Window.unboundedFollowing, True)):
        along = "_at" if exclude == "current row" else "_peer"
        turned = part.orderBy(F.col(along).desc() if ahead else F.col(along))
        size = abs(reach)
        for k in kinds:
            if least and exclude == "current row":
                sides[k].append(_PARTS[k](value).over(turned.rowsBetween(Window.unboundedPreceding, -1)))
            elif least:
                sides[k].append(_PARTS[k](value).over(turned.rangeBetween(Window.unboundedPreceding, -1)))
            elif size and exclude == "current row":
                sides[k].append(_PARTS[k](value).over(turned.rowsBetween(-size, -1)))
            elif size:
                frame = part.orderBy(F.col("_at").desc() if ahead else F.col("_at")).rowsBetween(-size, -1)
                near = F.collect_list(F.struct("_peer", F.col(value).alias("v"))).over(frame)
                others = F.transform(F.filter(near, lambda x: x["_peer"] != F.col("_peer")), lambda x: x["v"])
                known = F.filter(others, lambda v: v.isNotNull())
                sides[k].append({"sum": lambda k=known: F.when(F.size(k) > 0, F.aggregate(F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), F.get(k, F.lit(0)), lambda a, v: a + v)), "count": lambda k=known: F.size(k), "min": lambda k=known: F.array_min(k), "max": lambda k=known: F.array_max(k)}[k]())
    if exclude == "ties":
        for k in kinds:
            sides[k].append(F.col(value).isNotNull().cast("int") if k == "count" else F.col(value))
    found = {k: _together(k, own) if len(own) > 1 else own[0] if own else F.lit(0 if k == "count" else None) for k, own in sides.items()}
    made = {name: F.when(found["count"] > 0, found["sum"] / found["count"]) if kind == "avg" else found[kind] for name, kind in named.items()}
    return rows.withColumns(made).drop("_peer", "_at")


def hypothetical_rank(value: Column, at: Column) -> Column:
    """rank(at) within group (order by value)."""
    return F.count_if(value < at) + 1


def hypothetical_dense_rank(value: Column, at: Column) -> Column:
    return F.count_distinct(F.when(value < at, value)) + 1


def hypothetical_percent_rank(value: Column, at: Column) -> Column:
    n = F.count(value)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(value < at) / n)


def hypothetical_cume_dist(value: Column, at: Column) -> Column:
    return (F.count_if(value <= at) + 1) / (F.count(value) + 1)


def array_agg(value: Column, *order: Column) -> Column:
    """A list that keeps nulls, in the order of `order` if given."""
    row = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), value.alias("v"))
    rows = F.collect_list(row)
    return F.transform(F.array_sort(rows) if order else rows, lambda x: x["v"])


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows that were seen do not go on, so cycles end.

    Each round joins only the rows found in the round before. A round's rows are written to the shared
    folder, so plans do not grow and a lost executor costs its tasks only. max_rounds: more rounds are an error.
    """
    spark, path = start.sparkSession, new_path(start.sparkSession, "rounds")
    start.distinct().write.parquet(f"{path}/_r=0")
    schema, i = start.schema, 0
    while True:
        frontier = spark.read.schema(schema).parquet(f"{path}/_r={i}")
        if i and frontier.isEmpty():
            return spark.read.schema(schema).parquet(*(f"{path}/_r={k}" for k in range(i)))
        i += 1
        if max_rounds is not None and i > max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        seen = spark.read.schema(schema).parquet(*(f"{path}/_r={k}" for k in range(i)))
        step(frontier).toDF(*schema.names).select(*(F.col(f.name).cast(f.dataType) for f in schema)).subtract(seen).write.parquet(f"{path}/_r={i}")


#: Comparisons and what quantified() needs of the other side.
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def quantified(df: DataFrame, value: str, sign: str, quantifier: str, other: DataFrame, column: str) -> DataFrame:
    """Rows for which `value sign ANY|ALL (select column from other)` is true.

    The subquery comes down to one row (least, greatest, nulls, rows), but for `= ANY` and `<> ALL`, which are
    a semi and a null-aware anti join. ALL over no rows is true, ANY over none is false; a null on
    either side makes undecided what it could change.
    """
    if sign not in _COMPARE or quantifier not in ("any", "all"):
        raise ValueError(f"no such comparison: {sign} {quantifier}")
    own = F.col(value)
    edge = other.agg(F.min(column).alias("_min"), F.max(column).alias("_max"), F.count_if(F.col(column).isNull()).alias("_nulls"), F.count("*").alias("_n"))
    if (sign, quantifier) in (("=", "any"), ("<>", "all")):
        keys = other.select(F.col(column).alias("_k")).distinct()
        if quantifier == "any":
            return df.join(keys, own == F.col("_k"), "left_semi")
        kept = df.join(keys.dropna(), own == F.col("_k"), "left_anti").crossJoin(F.broadcast(edge))  # one row
        return kept.filter((F.col("_n") == 0) | ((F.col("_nulls") == 0) & own.isNotNull())).select(*df.columns)
    joined = df.crossJoin(F.broadcast(edge))  # one row
    compare, low, high = _COMPARE[sign], F.col("_min"), F.col("_max")
    if sign == "=":
        hit = compare(own, low) & compare(own, high)  # equal to all
    elif sign == "<>":
        hit = compare(own, low) | compare(own, high)  # unequal to any
    else:
        hit = compare(own, high if (sign[0] == ">") == (quantifier == "all") else low)
    if quantifier == "all":
        hit = (F.col("_n") == 0) | ((F.col("_nulls") == 0) & hit)
    return joined.filter(hit).select(*df.columns)


def greater_than_all(df: DataFrame, value: str, other: DataFrame, column: str) -> DataFrame:
    """Rows with value > ALL (select column from other); a null in other rules all out unless other is empty."""
    return quantified(df, value, ">", "all", other, column)


def greater_than_any(df: DataFrame, value: str, other: DataFrame, column: str) -> DataFrame:
    """Rows with value > ANY (select column from other)."""
    return quantified(df, value, ">", "any", other, column)


def row_compare(left: Sequence[Column], sign: str, right: Sequence[Column]) -> Column:
    """(a, b, ...) sign (c, d, ...) in three-valued logic: null where undecided."""
    pairs = list(zip(left, right, strict=True))
    if sign in ("=", "<>"):
        return reduce(lambda x, y: x & y if sign == "=" else x | y, [_COMPARE[sign](a, b) for a, b in pairs])
    out: Column = F.lit(sign.endswith("="))
    for a, b in reversed(pairs):
        out = _COMPARE[sign[0]](a, b) | ((a == b) & out)
    return out


def row_less(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """(a, b, ...) < (c, d, ...)."""
    return row_compare(left, "<", right)


def overlap_join(left: DataFrame, right: DataFrame, width: float, l_low: str, l_high: str, r_low: str, r_high: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of half-open ranges [low, high) that overlap, as an equi-join on bins.

    A range's level is the least at which bins (of width * 2**level) are as wide as the range, so it touches two of them at
    most. It is put there, and into the bins of all wider levels that occur; a pair meets at the larger level of the two,
    in the first bin that both touch. A range makes at most two rows per level, however wide it is.
    """

    def leveled(df: DataFrame, low: str, high: str) -> DataFrame:
        wide = F.greatest((F.col(high).cast("double") - F.col(low).cast("double")) / width, F.lit(1.0))
        return df.filter(F.col(low) < F.col(high)).withColumn("_own", F.ceil(F.log2(wide)).cast("int"))

    a, b = leveled(left, l_low, l_high), leveled(right, r_low, r_high)
    found = a.select("_own").union(b.select("_own")).distinct().collect()  # a row per level: a few dozen
    levels = F.array(*(F.lit(x) for x in sorted(r["_own"] for r in found))) if found else F.array().cast("array<int>")

    def bins(edge: Column) -> Column:
        return F.floor(edge / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))))

    def binned(df: DataFrame, low: str, high: str, own: str) -> DataFrame:
        each = df.withColumn("_level", F.explode(F.filter(levels, lambda x: x >= F.col("_own"))))
        first, last = bins(F.col(low).cast("double")), F.ceil(F.col(high).cast("double") / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level")))) - 1
        return each.withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last)))).withColumnRenamed("_own", own)

    joined = binned(a, l_low, l_high, "_l").join(binned(b, r_low, r_high, "_r"), [*keys, "_level", "_bin"])
    meet = (F.greatest("_l", "_r") == F.col("_level")) & (F.col("_bin") == bins(F.greatest(F.col(l_low).cast("double"), F.col(r_low).cast("double"))))
    return joined.filter((F.col(l_low) < F.col(r_high)) & (F.col(r_low) < F.col(l_high)) & meet).drop("_level", "_bin", "_l", "_r")


def nearest(points: DataFrame, keys: Sequence[str], distance: Column, n: int, *ties: str) -> DataFrame:
    """The n rows of each group with the least distance."""
    w = Window.partitionBy(*keys).orderBy(distance, *ties)
    return points.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l_value: str, r_value: str, n: int, l_id: str, tie: str) -> DataFrame:
    """Each row of left with the n rows of right that have the same keys and the nearest values; ties go to the least `tie`.

    Both sides are sorted together once for each direction, and a row looks n places up and n down: no pairs but these
    are made. Rows with a null value have no neighbours. Other column names must differ between the sides.
    """
    keys = list(keys)
    known = right.filter(F.col(r_value).isNotNull())
    part = Window.partitionBy(*keys)
    both = left.filter(F.col(l_value).isNotNull()).select(*keys, F.col(l_value).cast("double").alias("_v"), F.lit(1).alias("_side"), F.col(l_id).alias("_id")).unionByName(known.select(*keys, F.col(r_value).cast("double").alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema[l_id].dataType).alias("_id")))
    out = None
    for direction in (1, -1):
        value = F.col(r_value).cast("double") * direction
        ranked = known.withColumn("_n", F.row_number().over(part.orderBy(value, tie))).withColumn("_up", F.lit(direction))
        # rows of the right that stand before: below the value going up, at or above it going down
        before = F.count_if(F.col("_side") == 0).over(part.orderBy(F.col("_v") * direction, F.col("_side") * -direction).rowsBetween(Window.unboundedPreceding, -1))
        places = both.withColumn("_before", before).filter("_side = 1").select(*keys, "_id", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + n)).alias("_n"))
        met = places.join(ranked, [*keys, "_n"]).drop("_n", "_up")
        out = met if out is None else out.unionByName(met)
    pairs = left.join(out.drop(*keys), F.col(l_id) == F.col("_id")).drop("_id")
    return nearest(pairs, [l_id], F.abs(F.col(l_value) - F.col(r_value)), n, tie)


def crosstab(df: DataFrame, row: str, category: str, value: str, categories: Sequence[object]) -> DataFrame:
    """One row per `row` value, one column per category: the first value."""
    return df.groupBy(row).pivot(category, list(categories)).agg(F.first(value, ignorenulls=True))


def connect_by(edges: DataFrame, key: str, parent: str, start: object, max_depth: int = 0) -> DataFrame:
    """keys below `start` with level and branch, breadth first, to the bottom or to max_depth (0: no limit).

    A key that comes again in its own branch is an error, unless max_depth ends the walk before. Levels are
    written to the shared folder.
    """
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "levels")
    kind = edges.schema[key].dataType
    first = spark.range(1).select(F.lit(start).cast(kind).alias("key"), F.lit(None).cast(edges.schema[parent].dataType).alias("parent"), F.lit(0).alias("level"), F.lit(str(start)).alias("branch"), F.array(F.lit(start).cast(kind)).alias("_path"))
    own = edges.filter(F.col(key) == F.lit(start)).select(F.col(key).alias("key"), F.col(parent).alias("parent"))
    now = first if own.isEmpty() else own.join(first.drop("parent"), "key").select(*first.columns)
    schema, level = now.schema, 0
    now.write.parquet(f"{path}/{level}")
    while True:
        up = spark.read.schema(schema).parquet(f"{path}/{level}")
        if level and up.isEmpty():
            break
        if level and not up.filter(F.array_position("_path", F.col("key")) < F.size("_path")).isEmpty():
            raise RuntimeError("infinite recursion: a key stands below itself")
        if max_depth and level >= max_depth:
            level += 1
            break
        level += 1
        down = edges.join(up.select(F.col("key").alias("_up"), "branch", "_path"), F.col(parent) == F.col("_up"))
        k = F.col(key)
        down.select(k.alias("key"), F.col(parent).alias("parent"), F.lit(level).alias("level"), F.concat("branch", F.lit("~"), k.cast("string")).alias("branch"), F.concat("_path", F.array(k)).alias("_path")).write.parquet(f"{path}/{level}")
    return spark.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(level))).drop("_path")


def materialized(df: DataFrame) -> DataFrame:
    """WITH ... AS MATERIALIZED: worked out once, in the shared folder, and read as often as it is used."""
    path = new_path(df.sparkSession, "materialized")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
