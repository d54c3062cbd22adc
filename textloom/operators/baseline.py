"""Running baselines, z-scores and dissonance events.

The order of a hot variable is no job for one task: its rows are cut into ranges of the first order column, each range
is aggregated, the aggregates are composed in order (moments merge, a moving average is an affine map of its start), and
each range is finished on its own from what comes before it. The streaming form keeps the same moments as state
(textloom.streaming). The value is absorbed before it is scored; with one value the z-score is the raw value.

Defined results: null values are left out; ties in the order are broken by the given order columns, which must be total. The
first order column must be a number, a date or a time, or the rows of a variable stay in one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

# Smoothing, variance floor, and the pairs of variables that are compared.
ALPHA, FLOOR = 0.1, 1e-9
BRIDGE = [
    ("intensity", "power_control"), ("anxiety", "power_submission"), ("attention", "visibility_exposure"), ("emotion", "resources_abundance"),
    ("agitation", "power_control"), ("complexity", "visibility_concealment"), ("attention", "cognitive_scientific"), ("agitation", "kinetic_aggression"),
    ("emotion", "cognitive_emotional"), ("anxiety", "kinetic_aggression"), ("intensity", "keigo_formal"),
]
#: Rows of one range, about, and the ranges of one variable at most; equal values of the first order column stay together.
RANGE_ROWS, RANGES = 20_000, 1_000
#: Rows of one piece of a range: within it powers of 0.9 neither overflow nor vanish.
PIECE = 64
#: A moving average has forgotten what lies more rows back: 0.9 ** 400 is below double precision.
FORGOTTEN = 400


def _ranged(df: DataFrame, by: list[str], order: list[str], rows: int) -> DataFrame:
    """Adds _r, the range of each row: non-decreasing in the order, about `rows` rows each."""
    kind = df.schema[order[0]].dataType
    if isinstance(kind, T.NumericType):
        at = F.col(order[0]).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("double")
    else:
        return df.withColumn("_r", F.lit(0))
    share = F.greatest(F.lit(1), F.least(F.lit(RANGES), F.ceil(F.col("_n") / rows))).cast("int")
    cuts = df.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(at, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), 10_000).alias("_p"))
    # as many of the cuts are used as a variable's rows need
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGES) / share).cast("int"))
    cuts = cuts.withColumn("_p", F.array_distinct(F.filter("_p", lambda _, k: (k + 1) % step == 0))).drop("_n")
    matched = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = df.alias("a").join(cuts.alias("b"), reduce(lambda x, y: x & y, matched)).select("a.*", "_p")
    return joined.withColumn("_r", F.size(F.filter("_p", lambda c: c < at))).drop("_p")


def running(df: DataFrame, by: list[str], order: list[str], value: str = "value", rows: int = RANGE_ROWS, turn: str | None = None) -> DataFrame:
    """Adds n, mu, sigma and z of the values so far. Rows of a smaller `turn` (from 0) come before all others."""
    df = _ranged(df.filter(F.col(value).isNotNull()), [*by, turn] if turn else by, order, rows)
    if turn:
        df, order = df.withColumn("_r", F.col(turn) * (RANGES + 1) + F.col("_r")), [turn, *order]
    part = df.groupBy(*by, "_r").agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("_v"))
    before = W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    # sums are taken about the first range's mean, so that squares of large means don't cancel
    centre = F.first("_m").over(W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    part = part.withColumn("_d", F.col("_m") - centre)
    moments = {"_n0": F.sum("_n").over(before), "_s0": F.sum(F.col("_n") * F.col("_d")).over(before), "_q0": F.sum(F.col("_n") * (F.col("_v") + F.col("_d") * F.col("_d"))).over(before), "_c": centre}
    part = part.withColumns(moments).select(*by, "_r", *[F.coalesce(c, F.lit(0)).alias(c) for c in moments])
    matched = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_r")]
    df = df.alias("a").join(part.alias("b"), reduce(lambda x, y: x & y, matched)).select("a.*", *moments)
    w = W.partitionBy(*by, "_r").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumns({"_n1": F.count(value).over(w), "_m1": F.avg(value).over(w), "_v1": F.coalesce(F.var_pop(value).over(w), F.lit(0.0))})
    d1 = F.col("_m1") - F.col("_c")
    n = F.col("_n0") + F.col("_n1")
    m0 = F.when(F.col("_n0") > 0, F.col("_s0") / F.col("_n0")).otherwise(0.0)
    m2 = F.col("_q0") - F.col("_n0") * m0 * m0 + F.col("_n1") * F.col("_v1") + (d1 - m0) * (d1 - m0) * F.col("_n0") * F.col("_n1") / n
    out = df.withColumns({"n": n, "mu": F.col("_c") + (F.col("_n0") * m0 + F.col("_n1") * d1) / n, "_m2": m2})
    sigma = F.when(F.col("n") < 2, 1.0).otherwise(F.sqrt(F.greatest(F.col("_m2") / (F.col("n") - 1), F.lit(FLOOR))))
    out = out.withColumn("sigma", sigma).drop("_r", *moments, "_n1", "_m1", "_v1", "_m2")
    return out.withColumn("z", F.when(F.col("n") < 2, F.col(value)).otherwise((F.col(value) - F.col("mu")) / F.col("sigma")))


def _follow(maps: Column, start: Column) -> Column:
    """A moving average carried through maps (n, own): each forgets by its n values and adds its own."""
    return F.aggregate(maps, start.cast("double"), lambda e, m: F.pow(F.lit(1 - ALPHA), m["n"]) * e + m["own"])


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str = "value", rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ema, which starts at 0."""
    keep = 1 - ALPHA
    df = _ranged(df.filter(F.col(value).isNotNull()), by, order, rows)
    k = F.row_number().over(W.partitionBy(*by, "_r").orderBy(*order)) - 1
    df = df.withColumn("_k", k).withColumns({"_p": F.floor(F.col("_k") / PIECE), "_i": F.col("_k") % PIECE})
    w = W.partitionBy(*by, "_r", "_p").orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = ALPHA * F.pow(F.lit(keep), F.col("_i")) * F.sum(F.col(value) * F.pow(F.lit(keep), -F.col("_i"))).over(w)
    df = df.withColumn("_own", own)
    piece = df.groupBy(*by, "_r", "_p").agg(F.count("*").alias("n"), F.max_by("_own", "_i").alias("own"))
    of_range = piece.groupBy(*by, "_r").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("_p", "n", "own"))).alias("pieces"))
    of_range = of_range.select(*by, "_r", "n", "pieces", _follow(F.col("pieces"), F.lit(0.0)).alias("own"))
    # every range has a value at least, so that FORGOTTEN ranges back nothing is left
    back = W.partitionBy(*by).orderBy("_r").rowsBetween(-FORGOTTEN, -1)
    of_range = of_range.withColumn("start", _follow(F.collect_list(F.struct("n", "own")).over(back), F.lit(0.0)))
    pieces = of_range.select(*by, "_r", "start", F.posexplode("pieces").alias("_at", "x"), "pieces")
    few = -(-FORGOTTEN // PIECE)
    first = F.greatest(F.lit(0), F.col("_at") - few)
    begin = _follow(F.slice("pieces", first + 1, F.col("_at") - first), F.when(first == 0, F.col("start")).otherwise(0.0))
    pieces = pieces.select(*by, "_r", F.col("x._p").alias("_p"), begin.alias("_begin"))
    matched = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_r", "_p")]
    df = df.alias("a").join(pieces.alias("b"), reduce(lambda x, y: x & y, matched)).select("a.*", "_begin")
    ema = F.col("_own") + F.pow(F.lit(keep), F.col("_i") + 1) * F.col("_begin")
    return df.withColumn("ema", ema).drop("_r", "_k", "_p", "_i", "_own", "_begin")


def seeded(control: DataFrame, df: DataFrame, by: list[str], order: list[str], value: str = "value", rows: int = RANGE_ROWS) -> DataFrame:
    """As `running` over df, with baselines that have absorbed the control's values before the first of df is scored."""
    both = control.select(*by, *order, value, F.lit(0).alias("_turn")).unionByName(df.select(*by, *order, value, F.lit(1).alias("_turn")))
    return running(both, by, order, value, rows, "_turn").filter("_turn = 1").drop("_turn")


def snapshot(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mu and sigma of each variable after the last value; no order is needed, so partial sums are combined first."""
    sigma = F.when(F.count(value) < 2, 1.0).otherwise(F.sqrt(F.greatest(F.coalesce(F.var_samp(value), F.lit(0.0)), F.lit(FLOOR))))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mu"), sigma.alias("sigma"))


def states(df: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """n, mu, sigma and ema of each variable after its last value."""
    last = moving_average(df, by, order, value).groupBy(*by).agg(F.max_by("ema", F.struct(*order)).alias("ema"))
    return snapshot(df, by, value).join(last, by)


def classify(delta: Column, micro: Column, macro: Column) -> Column:
    return F.when(delta > 4, "fracture").when(macro > micro, "posturing").otherwise("suppressed")


def bridge_events(micro: DataFrame, macro: DataFrame, key: list[str], threshold: float = 2.5) -> DataFrame:
    """Events of the bridge pairs from key, variable, z of both sides: key, micro_var, macro_var, delta, conclusion."""
    spark = micro.sparkSession
    pairs = spark.createDataFrame(BRIDGE, "micro_var string, macro_var string")
    a = micro.select(*key, F.col("variable").alias("micro_var"), F.col("z").alias("z_micro")).join(F.broadcast(pairs), "micro_var")
    b = macro.select(*key, F.col("variable").alias("macro_var"), F.col("z").alias("z_macro"))
    d = F.abs(F.col("z_macro") - F.col("z_micro"))
    return a.join(b, [*key, "macro_var"]).withColumn("delta", d).filter(F.col("delta") > threshold).select(*key, "micro_var", "macro_var", "delta", classify(F.col("delta"), F.col("z_micro"), F.col("z_macro")).alias("conclusion"))


def ranked_events(micro: DataFrame, macro: DataFrame, bridge: DataFrame, key: list[str], threshold: float = 2.5, ranks: int = 3) -> DataFrame:
    """Where no bridge pair gave an event: the strongest deviations of both sides, rank by rank."""

    def top(df: DataFrame, name: str, z: str) -> DataFrame:
        r = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.abs("z")), "variable"))
        return df.withColumn("rank", r).filter(F.col("rank") <= ranks).select(*key, "rank", F.col("variable").alias(name), F.col("z").alias(z))

    both = top(micro, "micro_var", "z_micro").join(top(macro, "macro_var", "z_macro"), [*key, "rank"]).join(bridge.select(*key).distinct(), key, "left_anti")
    d = F.abs(F.col("z_macro") - F.col("z_micro"))
    return both.withColumn("delta", d).filter(F.col("delta") > threshold).select(*key, "micro_var", "macro_var", "delta", classify(F.col("delta"), F.col("z_micro"), F.col("z_macro")).alias("conclusion"))
