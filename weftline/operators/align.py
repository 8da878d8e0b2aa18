"""Coordinate matching, slices and hyperslabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.model import FUZZY_ABSOLUTE, FUZZY_RELATIVE
from weftline.operators.ranking import positions


def match_exact(source: DataFrame, requested: DataFrame, value: str = "value", idx: str = "idx", pos: str = "pos") -> DataFrame:
    """``pos, idx``: the first source index of each requested value; values that the source lacks have a null index."""
    first = source.groupBy(value).agg(F.min(idx).alias(idx))
    return requested.join(first, value, "left").select(pos, idx)


def match_fuzzy(source: DataFrame, requested: DataFrame, value: str = "value", idx: str = "idx", pos: str = "pos") -> DataFrame:
    """``pos, idx``: the first source index of each requested value within the tolerance.

    A source value is a candidate if it is close, relative to itself, to some requested value; of the candidates close to a requested
    value, relative to that, the first counts. Values meet by an equi-join on cells of the tolerance's width, each requested value
    looking into its own and both neighbouring cells; the cells grow with the magnitude, as the tolerance does.
    """
    v = F.col(value)
    # of a magnitude 2^k the tolerance is below absolute + relative * 2^(k+1)
    power = lambda x: F.when(F.abs(x) < 1, 0).otherwise(F.floor(F.log2(F.abs(x))) + 1).cast("int")
    width = lambda k: F.lit(FUZZY_ABSOLUTE) + F.lit(FUZZY_RELATIVE) * F.pow(F.lit(2.0), k + 1)
    s = source.select(idx, v.alias("_a")).where(F.col("_a").isNotNull())
    s = s.withColumn("_k", power(F.col("_a"))).withColumn("_cell", F.floor(F.col("_a") / width(F.col("_k"))))
    r = requested.select(pos, v.alias("_b")).withColumn("_k", F.explode(F.sequence(F.greatest(power(F.col("_b")) - 1, F.lit(0)), power(F.col("_b")) + 1)))
    home = F.floor(F.col("_b") / width(F.col("_k")))
    r = r.withColumn("_cell", F.explode(F.sequence(home - 1, home + 1)))
    near = lambda relative: F.abs(F.col("_a") - F.col("_b")) <= FUZZY_ABSOLUTE + FUZZY_RELATIVE * F.abs(F.col(relative))
    pairs = s.join(r, ["_k", "_cell"])
    candidates = pairs.where(near("_a")).select(F.col(idx).alias("_candidate")).distinct()
    found = pairs.where(near("_b")).join(candidates, F.col(idx) == F.col("_candidate"), "left_semi").groupBy(pos).agg(F.min(idx).alias(idx))
    return requested.select(pos).join(found, pos, "left")


def match(source: DataFrame, requested: DataFrame, value: str = "value", idx: str = "idx", pos: str = "pos", strict: bool = True) -> DataFrame:
    """``pos, idx``: exact matches if all requested values have one, else fuzzy ones for all; one value against one always matches.

    A value without a match raises on read, unless not ``strict``. One plan: the switch is a scalar that is broadcast.
    """
    exact = match_exact(source, requested, value, idx, pos).withColumnRenamed(idx, "_exact")
    fuzzy = match_fuzzy(source, requested, value, idx, pos).withColumnRenamed(idx, "_fuzzy")
    sizes = source.agg(F.count("*").alias("_sources"), F.min(idx).alias("_only")).join(exact.agg(F.count("*").alias("_wanted"), F.count_if(F.col("_exact").isNull()).alias("_missing")))
    joined = exact.join(fuzzy, pos).join(F.broadcast(sizes))
    single = (F.col("_sources") == 1) & (F.col("_wanted") == 1)
    found = F.when(single, F.col("_only")).when(F.col("_missing") == 0, F.col("_exact")).otherwise(F.col("_fuzzy"))
    if strict:
        found = F.coalesce(found, F.raise_error(F.lit("a requested coordinate has no match")).cast(source.schema[idx].dataType))
    return joined.select(pos, found.alias(idx))


def to_slices(indices: DataFrame, idx: str = "idx", step: int = 1, bucket: int = 1_000_000, keys: list[str] | None = None) -> DataFrame:
    """``start, stop, step``: the sorted distinct indices as slices, stop exclusive: neighbours in the order that lie ``step`` apart are
    in one slice, so an index whose neighbours lie nearer or farther is a slice of its own. Null indices are left out.

    Runs are found within buckets of the index range, then joined across their edges, so that no window holds all indices.
    """
    keys = keys or []
    i = indices.select(*keys, F.col(idx).cast("long").alias("_i")).where(F.col("_i").isNotNull()).distinct().withColumn("_bucket", F.floor(F.col("_i") / bucket))
    order = Window.partitionBy(*keys, "_bucket").orderBy("_i")
    begins = F.coalesce((F.col("_i") - F.lag("_i").over(order) != step).cast("int"), F.lit(1))
    runs = i.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    local = runs.groupBy(*keys, "_bucket", "_run").agg(F.min("_i").alias("_low"), F.max("_i").alias("_high"))
    # the first and the last run of each bucket may go on in another bucket
    ends = local.groupBy(*keys, "_bucket").agg(F.max("_run").alias("_last"))
    marked = local.join(ends, [*keys, "_bucket"])
    is_end = (F.col("_run") == 1) | (F.col("_run") == F.col("_last"))
    across = Window.partitionBy(*keys).orderBy("_low")
    # two runs of one bucket are never one run; of neighbouring buckets they are if they lie a step apart
    goes_on = (F.col("_low") - F.lag("_high").over(across) == step) & (F.col("_bucket") != F.lag("_bucket").over(across))
    edge = marked.where(is_end).withColumn("_begins", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn("_whole", F.sum("_begins").over(across))
    stitched = edge.groupBy(*keys, "_whole").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    both = marked.where(~is_end).select(*keys, "_low", "_high").unionByName(stitched.select(*keys, "_low", "_high"))
    return both.select(*keys, F.col("_low").alias("start"), (F.col("_high") + 1).alias("stop"), F.lit(step).cast("long").alias("step"))


def optimal_step(indices: DataFrame, idx: str = "idx", bucket: int = 1_000_000) -> DataFrame:
    """``step, slices``: of the distances between neighbours of the sorted distinct indices the one that gives the fewest slices (see
    :func:`to_slices`), the smallest of equals; step 1 for a single index, no row without any.

    A step joins as many neighbours as lie that far apart, so counting the distances counts the slices of every step: one aggregate.
    """
    i = indices.select(F.col(idx).cast("long").alias("_i")).where(F.col("_i").isNotNull()).distinct().withColumn("_bucket", F.floor(F.col("_i") / bucket))
    within = i.withColumn("_d", F.col("_i") - F.lag("_i").over(Window.partitionBy("_bucket").orderBy("_i"))).where("_d is not null").groupBy("_d").agg(F.count("*").alias("_n"))
    # a row per bucket: from the last index of one to the first of the next
    ends = i.groupBy("_bucket").agg(F.min("_i").alias("_low"), F.max("_i").alias("_high"), F.count("*").alias("_n"))
    across = ends.select((F.col("_low") - F.lag("_high").over(Window.orderBy("_bucket"))).alias("_d"), F.lit(1).cast("long").alias("_n")).where("_d is not null")
    total = ends.agg(F.sum("_n").alias("_total"))
    counts = within.unionByName(across).groupBy("_d").agg(F.sum("_n").alias("_n"))
    best = counts.agg(F.min(F.struct((-F.col("_n")).alias("less"), F.col("_d").alias("step"))).alias("b"))
    return best.join(F.broadcast(total)).where("_total > 0").select(F.coalesce("b.step", F.lit(1)).alias("step"), (F.col("_total") - F.coalesce(-F.col("b.less"), F.lit(0))).alias("slices"))


def prepare_indices(indices: DataFrame, idx: str = "idx", pos: str = "pos", bucket: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """What a gather needs: (the sorted indices' slices of the optimal step, ``pos, place``: where in the sorted order each request is).

    ``pos``: the requests' order. Equal indices are requested once; places count distinct indices.
    """
    best = optimal_step(indices, idx, bucket).first()
    slices = to_slices(indices, idx, best["step"] if best else 1, bucket)
    distinct = indices.select(F.col(idx).cast("long").alias("_i")).where(F.col("_i").isNotNull()).distinct()
    placed = positions(distinct, ["_i"], F.floor(F.col("_i") / bucket), name="place")
    return slices, indices.join(placed, F.col(idx) == F.col("_i")).select(pos, "place")


def slice_a_slice(first: Column, second: Column) -> Column:
    """The slice that taking ``second`` of what ``first`` takes amounts to (structs of start, stop, step)."""
    at = lambda n: first["start"] + n * first["step"]
    return F.struct(at(second["start"]).alias("start"), F.least(first["stop"], at(second["stop"])).alias("stop"), (first["step"] * second["step"]).alias("step"))


def slice_indices(s: Column) -> Column:
    """Array of the indices of a slice; empty if it takes none."""
    return F.when(s["stop"] > s["start"], F.sequence(s["start"], s["stop"] - 1, s["step"])).otherwise(F.array().cast("array<bigint>"))


def index_of_slice(s: Column, at: Column) -> Column:
    """The index at place ``at`` of what a slice takes, places below 0 counting from its end; null beyond either end."""
    n = F.greatest(F.lit(0).cast("long"), F.ceil((s["stop"] - s["start"]) / s["step"]))
    place = F.when(at < 0, n + at).otherwise(at)
    return F.when((place >= 0) & (place < n), s["start"] + place * s["step"])


def slice_of_index(indices: Column, s: Column) -> Column:
    """What a slice takes of an array of indices; null entries stay, an empty slice gives an empty array."""
    wanted = slice_indices(F.struct(s["start"].alias("start"), F.least(s["stop"], F.size(indices).cast("long")).alias("stop"), s["step"].alias("step")))
    return F.transform(wanted, lambda k: F.get(indices, k.cast("int")))


def inverse_permutation(df: DataFrame, value: list[str], bucket: Column, name: str = "place") -> DataFrame:
    """Add the place of each row in the sorted order: the permutation that undoes the sort."""
    return positions(df, value, bucket, name=name)


def unique_with_inverse(df: DataFrame, column: str, bucket: Column, name: str = "place") -> tuple[DataFrame, DataFrame]:
    """(``column, place``: the distinct values with their place in the order; the rows with the place of their value). Nulls are left out.
    ``bucket``: a whole number that grows with the value."""
    unique = positions(df.where(F.col(column).isNotNull()).select(column).distinct(), [column], bucket, name=name)
    return unique, df.join(unique, column)


def take(values: Column, indices: Column) -> Column:
    """Values at 0-based positions; null where the position is beyond the array, and for all positions of an empty one."""
    return F.transform(indices, lambda i: F.try_element_at(values, (i + 1).cast("int")))


def gather(values: Column, shape: list[int], indices: list[Column]) -> Column:
    """Cells of an array of any number of dimensions, kept flat in row order: all combinations of the places asked for in each
    dimension, in the order asked for, flat. Places beyond a dimension give null; no places in a dimension give an empty array."""
    if len(shape) != len(indices):
        raise ValueError("as many index arrays as dimensions")
    pairs = F.transform(F.array(F.lit(0).cast("long")), lambda a: F.struct(a.alias("at"), F.lit(True).alias("in")))
    def along(n: int, wanted: Column):
        return lambda p: F.transform(wanted, lambda k: F.struct((p["at"] * n + k).cast("long").alias("at"), (p["in"] & (k >= 0) & (k < n)).alias("in")))

    for n, wanted in zip(shape, indices):
        pairs = F.flatten(F.transform(pairs, along(n, wanted)))
    return F.transform(pairs, lambda p: F.when(p["in"], F.try_element_at(values, (p["at"] + 1).cast("int"))))


def gather_long(cells: DataFrame, dims: list[str], wanted: dict[str, DataFrame]) -> DataFrame:
    """The same over a table of cells, a row each with its place in every dimension ``dims``: ``wanted`` gives, for some of them, ``pos,
    idx``; each such column becomes the requests' ``pos``. One equi-join for each dimension asked for; the other columns stay."""
    for d, requests in wanted.items():
        cells = cells.join(requests.select(F.col("pos").alias("_pos"), F.col("idx").alias(d)), d).withColumn(d, F.col("_pos")).drop("_pos")
    return cells.select(*dims, *(c for c in cells.columns if c not in dims))


def hyperslab(values: Column, width: int, rows: Column, columns: Column) -> Column:
    """Rows x columns of a two-dimensional array of ``width`` columns, kept flat in row order."""
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.when((c >= 0) & (c < width), F.try_element_at(values, (r * width + c + 1).cast("int"))))))


def to_long(df: DataFrame, keys: list[str], values: str = "value") -> DataFrame:
    """``keys, cell, value``: a row for each cell of a dense array."""
    return df.select(*keys, F.posexplode(values).alias("cell", "value"))


def to_dense(df: DataFrame, keys: list[str], cell: str = "cell", value: str = "value") -> DataFrame:
    """``keys, value``: the cells of each key as an array in order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(cell, value))), lambda x: x[value]).alias("value"))


def request_chunks(length: Column, row_elements: Column, limit: int) -> Column:
    """Array of (start, stop) of requests along the first dimension that stay below ``limit`` elements, a row at least."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(row_elements, F.lit(1))))
    cuts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length.cast("long") - 1, step)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(cuts, lambda a: F.struct(a.alias("start"), F.least(a + step, length).alias("stop")))
