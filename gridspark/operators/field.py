"""Field operators on long rows (field_id, j, i, value): NULL is missing, NaN stays NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import finite_or_null

COMBINE_OPS = ("a_minus_b", "b_minus_a", "a_plus_b", "mean", "ratio")


def to_long(fields: DataFrame, values: str = "values", ni: str = "ni") -> DataFrame:
    """Dense arrays (values[j*ni + i]) to long rows."""
    keep = [c for c in fields.columns if c not in (values,)]
    return fields.select(*keep, F.posexplode(values).alias("_p", "value")).withColumns({"j": F.expr(f"cast(_p div {ni} as int)"), "i": (F.col("_p") % F.col(ni)).cast("int")}).drop("_p")


def to_dense(long: DataFrame, *keys: str) -> DataFrame:
    """Long rows to one array per key, in row-major order."""
    pairs = F.array_sort(F.collect_list(F.struct("j", "i", "value")))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda x: x["value"]).alias("values"), (F.max("i") + 1).alias("ni"), (F.max("j") + 1).alias("nj"))


def combine_expr(a: Column, b: Column, op: str) -> Column:
    """One cell of a combination; missing where a side is missing or the result is not finite."""
    if op not in COMBINE_OPS:
        raise ValueError(f"unknown combine operation {op!r}; known: {', '.join(COMBINE_OPS)}")
    return finite_or_null({"a_minus_b": a - b, "b_minus_a": b - a, "a_plus_b": a + b, "mean": (a + b) / 2.0, "ratio": F.try_divide(a, b)}[op])


def combine(a: DataFrame, b: DataFrame, op: str, on: tuple[str, ...] = ("j", "i")) -> DataFrame:
    """a and b cell by cell: an equi-join on position; cells b lacks are missing.

    A field is never sent whole to the driver: the size of one that is decoded from a file is not known beforehand.
    """
    right = b.select(*on, F.col("value").alias("_b")).hint("merge")
    return a.join(right, list(on), "left").withColumn("value", combine_expr(F.col("value"), F.col("_b"), op)).drop("_b")


def same_geometry(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row per pair of messages: whether all geometry columns agree (NULL with NULL; NaN never agrees)."""
    same = F.lit(True)
    for c in columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        both = x.eqNullSafe(y)
        if dict(a.dtypes)[c] in ("double", "float"):
            both = both & ~F.coalesce(F.isnan(x), F.lit(False))
        same = same & both
    return a.alias("a").join(b.alias("b"), F.col("a.pair") == F.col("b.pair")).select(F.col("a.pair"), same.alias("same_grid"))


def value_range(long: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest finite value."""
    v = finite_or_null(F.col("value"))
    return long.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def statistics(long: DataFrame, *keys: str) -> DataFrame:
    """count, missing, min, max and mean of the present values."""
    v = finite_or_null(F.col("value"))
    return long.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"))


def cf_unpack(v: Column, scale: float | None, offset: float | None, valid: tuple[float | None, float | None] = (None, None), fill: list[float] | None = None) -> Column:
    """CF decoding: sentinels and the inclusive valid range act on the packed value, NaN passes the range."""
    ok = F.lit(True)
    for f in fill or []:
        if f == f:
            ok = ok & (v != f)
    nan = F.isnan(v)
    if valid[0] is not None:
        ok = ok & (nan | (v >= valid[0]))
    if valid[1] is not None:
        ok = ok & (nan | (v <= valid[1]))
    return F.when(ok, v * (1.0 if scale is None else scale) + (0.0 if offset is None else offset))


def plane(variable: DataFrame, fixed: dict[str, int], y: str, x: str) -> DataFrame:
    """A 2-D slice of an N-D variable in long form: fixed dimensions by filter, two renamed to j, i."""
    rows = variable
    for dim, at in fixed.items():
        rows = rows.where(F.col(dim) == at)
    return rows.select(F.col(y).alias("j"), F.col(x).alias("i"), "value")


# ---- orders, bitmaps and differences -----------------------------------------------------


def boustrophedon(long: DataFrame, ni: str | int = "ni") -> DataFrame:
    """Every odd row read backwards."""
    n = F.col(ni) if isinstance(ni, str) else F.lit(ni)
    return long.withColumn("i", F.when(F.col("j") % 2 == 1, n - 1 - F.col("i")).otherwise(F.col("i")).cast("int"))


def place_by_bitmap(bits: DataFrame, packed: DataFrame, *keys: str) -> DataFrame:
    """bits (keys, pos, bit), packed (keys, k, value): the k-th set bit takes the k-th value, the rest is missing."""
    ranked = bits.withColumn("k", F.when(F.col("bit") == 1, F.sum("bit").over(W.partitionBy(*keys).orderBy("pos")) - 1))
    return ranked.join(packed.select(*keys, "k", "value"), [*keys, "k"], "left").drop("k")


def group_of_bitmap(bits: DataFrame, *keys: str) -> DataFrame:
    """Group number of each position: a set bit begins a group."""
    return bits.withColumn("grp", (F.sum("bit").over(W.partitionBy(*keys).orderBy("pos")) - 1).cast("long"))


def undo_differences(rows: DataFrame, order: int, *keys: str, bias: int | Column = 0) -> DataFrame:
    """Spatial differences of order 1 to 3 undone: x (k seeds first, then differences less bias) to values.

    rows: keys, pos, x, already ordered without missing points.  An order-k recurrence is k
    nested running sums; the seeds enter through their own differences.
    """
    if order not in (0, 1, 2, 3):
        raise ValueError("spatial differencing has order 0 to 3")
    w = W.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(w) - 1)
    b = F.lit(bias) if not isinstance(bias, Column) else bias
    d = F.when(F.col("_n") >= order, F.col("x") + b)
    lag = lambda k: F.lag("x", k).over(w)
    x = F.col("x")
    heads = {1: [x], 2: [x, x - 2 * lag(1)], 3: [x, x - 3 * lag(1), x - 3 * lag(1) + 3 * lag(2)]}.get(order, [])
    for k, h in enumerate(heads):
        d = F.when(F.col("_n") == k, h).otherwise(d)
    rows = rows.withColumn("value", d if order else x + b)
    run = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    for _ in range(order):
        rows = rows.withColumn("value", F.sum("value").over(run))
    return rows.drop("_n")


def skip_missing_differences(rows: DataFrame, order: int, *keys: str, bias: int = 0) -> DataFrame:
    """As undo_differences, but missing positions (x NULL) are passed over and stay missing."""
    done = undo_differences(rows.where("x is not null"), order, *keys, bias=bias).select(*keys, "pos", "value")
    return rows.join(done, [*keys, "pos"], "left")


def scaled(x: Column, r, e, d) -> Column:
    """(R + X * 2^E) * 10^-D."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return (lit(r) + x * F.pow(F.lit(2.0), lit(e))) * F.pow(F.lit(10.0), -lit(d))


def run_length(codes: DataFrame, max_level: int, bits: int, *keys: str) -> DataFrame:
    """Run-length codes (keys, pos, code) to (keys, pos, level): a level, then digits of its run in base range."""
    base = 2**bits - 1 - max_level
    w = W.partitionBy(*keys).orderBy("pos")
    rows = codes.withColumn("_run", F.sum((F.col("code") <= max_level).cast("int")).over(w))
    digit = F.row_number().over(W.partitionBy(*keys, "_run").orderBy("pos")) - 2
    rows = rows.withColumn("_len", F.when(F.col("code") > max_level, (F.col("code") - max_level - 1) * F.pow(F.lit(float(base)), digit.cast("double"))).otherwise(0.0))
    runs = rows.groupBy(*keys, "_run").agg(F.min_by("code", "pos").alias("level"), (F.sum("_len") + 1).cast("long").alias("_n"))
    runs = runs.withColumn("_end", F.sum("_n").over(W.partitionBy(*keys).orderBy("_run")))
    return runs.select(*keys, F.explode(F.sequence(F.col("_end") - F.col("_n"), F.col("_end") - 1)).alias("pos"), "level")


def expand_reduced(rows: DataFrame, width: Column, *keys: str) -> DataFrame:
    """Rows of unlike length (keys, j, row array) to ``width`` columns: column k takes (k*len + width/2) / width % len."""
    n = F.size("row").cast("long")
    cols = F.explode(F.sequence(F.lit(0).cast("long"), width.cast("long") - 1)).alias("i")
    out = rows.select(*keys, "j", "row", n.alias("_n"), width.cast("long").alias("_w"), cols)
    src = F.expr("((i * _n + _w div 2) div _w) % _n")
    return out.select(*keys, "j", F.col("i").cast("int").alias("i"), F.get("row", src.cast("int")).alias("value"))


def csv_matrix(long: DataFrame, *keys: str) -> DataFrame:
    """One line per row j: cells in i order, an empty cell for a missing value."""
    cells = F.array_sort(F.collect_list(F.struct("i", "value")))
    return long.groupBy(*keys, "j").agg(F.array_join(F.transform(cells, lambda c: F.coalesce(c["value"].cast("string"), F.lit(""))), ",").alias("line"))


LONG_FORMATS = ("latlon", "mercator", "rotated_latlon", "gaussian")


def csv_long(long: DataFrame, grid, grid_type: str) -> DataFrame:
    """lat, lon, value rows; points without coordinates are left out, missing values keep their row."""
    if grid_type not in LONG_FORMATS:
        raise ValueError(f"the long form needs a grid with point coordinates, not {grid_type!r}")
    lat, lon = grid.point(F.col("i"), F.col("j"))
    return long.withColumns({"lat": lat, "lon": lon}).where("lat is not null and lon is not null").select("lat", "lon", "value")


