"""Aggregates of result rows: totals, metric summaries, statistics, composite scores, histograms, consistency, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.errors import CATEGORIES, category
from ..functions.stats import clamp

#: Weights of the composite score.
WEIGHTS = {"success_rate": 0.30, "performance": 0.35, "efficiency": 0.20, "cost": 0.15}


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def totals(df: DataFrame, *by: str) -> DataFrame:
    """Rows, successes, success rate, mean score and time, total cost; one row of zeros for an empty table without ``by``."""
    hit = F.col("success").cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("total_tasks"), F.count_if("success").alias("successful_tasks"), _or_zero(F.avg(hit)).alias("success_rate"), _or_zero(F.avg("score")).alias("avg_score"), _or_zero(F.avg("execution_time")).alias("avg_execution_time"), _or_zero(F.sum("cost")).alias("total_cost"))


def metric_summary(df: DataFrame, names: list[str], *by: str) -> DataFrame:
    """Mean, least, greatest and population standard deviation of each named metric, absent ones as 0. One row a group and name."""
    value = {n: F.coalesce(F.try_element_at("metrics", F.lit(n)), F.lit(0.0)) for n in names}
    made = [F.struct(F.lit(n).alias("metric"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), _or_zero(F.stddev_pop(v)).alias("std")) for n, v in value.items()]
    return df.groupBy(*by).agg(F.array(*made).alias("m"), F.count("*").alias("n")).where("n > 0").select(*by, F.explode("m").alias("m")).select(*by, "m.*")


def found_metrics(df: DataFrame, *by: str, first: str | None = None) -> DataFrame:
    """``metric_summary`` of the metrics that a group's rows hold: ``by``, ``metric``, ``mean``, ``min``, ``max``, ``std``. A row without one, or with null, counts as 0.

    Metrics become rows and are summed up once, with partial sums; what is absent is the group's size less the rows that have the metric, so no names are gathered. With ``first`` only
    the metrics count that the group's first row in the order of that column has.
    """
    group = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(1))
    sizes = [F.count("*").alias("_n")] + ([F.min_by(F.map_keys("metrics"), first).alias("_names")] if first else [])
    rows = df.groupBy(*group).agg(*sizes)
    x = F.coalesce(F.col("x"), F.lit(0.0))
    held = df.select(*group, F.explode("metrics").alias("metric", "x")).groupBy(*group, "metric").agg(F.count("*").alias("_c"), F.avg(x).alias("_m"), F.min(x).alias("_low"), F.max(x).alias("_high"), F.var_pop(x).alias("_v"))
    h, r = held.alias("h"), rows.alias("r")
    joined = h.join(r, [F.col(f"h.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group])
    if first:
        joined = joined.where(F.array_contains("_names", F.col("metric")))
    n, c, m, absent = F.col("_n"), F.col("_c"), F.col("_m"), F.col("_n") > F.col("_c")
    edge = lambda pick, v: F.when(absent, pick(v, F.lit(0.0))).otherwise(F.col(v))
    # deviations of the rows that have it, and of two means apart
    spread = (c * F.col("_v") + m * m * c * (n - c) / n) / n
    return joined.select(*[F.col(f"h.{g}").alias(g) for g in by], "metric", (m * c / n).alias("mean"), edge(F.least, "_low").alias("min"), edge(F.greatest, "_high").alias("max"), F.sqrt(spread).alias("std"))


def leaderboards(df: DataFrame, within: str, by: str = "model") -> DataFrame:
    """Models over all rows and within each value of ``within``, in one pass: ``level`` (``all`` or the name of ``within``), ``within``, the model and the columns of ``leaderboard``, ranked in each.

    The rows are grouped once by value and model; the level above is summed up from the same partial sums. A window runs over the models of one value.
    """
    sets = df.select(within, by, "success", "score", "execution_time", "cost").rollup(by, within)
    table = sets.agg(F.grouping(within).alias("_all"), F.grouping(by).alias("_none"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("score").alias("avg_score"), F.avg("execution_time").alias("avg_time"), F.avg("cost").alias("cost_per_task")).where("_none = 0")
    order = Window.partitionBy("_all", within).orderBy(F.desc("success_rate"), F.desc("avg_score"), by)
    level = F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.lit(within))
    return table.select(level.alias("level"), within, by, "success_rate", "avg_score", "avg_time", "cost_per_task", F.rank().over(order).cast("long").alias("rank"))


#: Cells of ``exact_percentiles`` a unit of log(1 + |x|).
CELLS = 1024


def _cell(x: Column) -> Column:
    """A number that never falls where x rises: cells of values. NaN is above all, as in sorting."""
    return F.when(F.isnan(x), F.lit(2**63 - 1)).otherwise((F.signum(x) * F.floor(F.log1p(F.abs(x)) * CELLS)).cast("long"))


def exact_percentiles(df: DataFrame, asked: dict[str, tuple[float, ...]], *by: str) -> DataFrame:
    """Percentiles of columns, interpolated between ranks: ``by``, ``item`` (the column), ``q`` and ``value``. Null values are left out.

    No group's values meet in one task. Rows are counted by cells of values first, which tells for each rank the cell that holds
    it. Only the values of these cells are counted each, and summed up within a cell. So the table is read twice, what is
    shuffled are counts, and a task holds the different values of a cell.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("x")) for c in asked]))
    long = df.select(*by, listed.alias("_v")).select(*by, "_v.item", "_v.x").where("x is not null").withColumn("cell", _cell(F.col("x")))
    group = [*by, "item"]
    up = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = long.groupBy(*group, "cell").agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy(*group))})
    place = {c: F.array(*[F.struct(F.lit(float(q)).alias("q"), ((F.col("total") - 1) * q).alias("at")) for q in qs]) for c, qs in asked.items()}
    wanted = F.lit(None)
    for c, places in place.items():
        wanted = F.when(F.col("item") == c, places).otherwise(wanted)
    ranks = cells.withColumn("_w", F.explode(wanted)).select(*group, "cell", "n", "upto", "_w.q", "_w.at")
    # a place between two ranks takes from both by nearness; the two may be in different cells
    near = F.explode(F.array(F.struct(F.floor("at").alias("rank"), (1 - (F.col("at") - F.floor("at"))).alias("share")), F.struct((F.floor("at") + 1).alias("rank"), (F.col("at") - F.floor("at")).alias("share"))))
    ranks = ranks.withColumn("_n", near).select(*group, "cell", "q", "_n.share", (F.col("_n.rank") - F.col("upto") + F.col("n")).alias("rest"), "n").where("rest >= 0 and rest < n and share > 0").drop("n")
    own = [F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "cell")]
    values = long.alias("v").join(ranks.select(*group, "cell").distinct().alias("r"), own, "left_semi").groupBy(*group, "cell", "x").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*group, "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("upto", F.sum("n").over(within))
    hit = ranks.alias("r").join(values.alias("v"), [*own, F.col("rest") < F.col("upto"), F.col("rest") >= F.col("upto") - F.col("n")])
    return hit.groupBy(*[F.col(f"r.{c}").alias(c) for c in group], "q").agg(F.sum(F.col("share") * F.col("x")).alias("value"))


def statistics(df: DataFrame, *by: str) -> DataFrame:
    """The sixteen statistics of scores, times and costs; no row for no rows. Percentiles interpolate between ranks."""
    keys = by or ("_all",)
    df = df if by else df.withColumn("_all", F.lit(1))
    made = df.groupBy(*keys).agg(
        F.count("*").alias("num_tasks"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.avg("execution_time").alias("mean_latency"), F.max("execution_time").alias("max_latency"), F.count_if("success").alias("success_count"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.sum("cost").alias("total_cost"), F.avg("cost").alias("avg_cost"),
    )
    found = exact_percentiles(df, {"score": (0.25, 0.5, 0.75), "execution_time": (0.5, 0.95)}, *keys)
    picked = {"p25_score": ("score", 0.25), "median_score": ("score", 0.5), "p75_score": ("score", 0.75), "median_latency": ("execution_time", 0.5), "p95_latency": ("execution_time", 0.95)}
    ranks = found.groupBy(*keys).agg(*[F.max(F.when((F.col("item") == c) & (F.col("q") == q), F.col("value"))).alias(name) for name, (c, q) in picked.items()])
    names = ["num_tasks", "mean_score", "median_score", "std_score", "min_score", "max_score", "p25_score", "p75_score", "mean_latency", "median_latency", "p95_latency", "max_latency", "success_count", "success_rate", "total_cost", "avg_cost"]
    joined = made.alias("m").join(ranks.alias("r"), [F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left")
    return joined.select(*[F.col(f"m.{k}") for k in by], *names)


def composite(df: DataFrame, *by: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Success rate, mean score, 1 - time / 120 and 1 - cost / 2 (the last two kept within 0 and 1), weighted.

    Without rows the parts are 0, but for the cost part, which is 1.
    """
    w = WEIGHTS | (weights or {})
    time, cost = F.avg("execution_time"), _or_zero(F.sum("cost"))
    parts = df.groupBy(*by).agg(
        _or_zero(F.avg(F.col("success").cast("double"))).alias("success_rate"), _or_zero(F.avg("score")).alias("performance"),
        F.when(time.isNull(), F.lit(0.0)).when(time <= 0, F.lit(1.0)).otherwise(clamp(1 - time / 120)).alias("efficiency"), F.when(cost <= 0, F.lit(1.0)).otherwise(clamp(1 - cost / 2)).alias("cost"),
    )
    return parts.withColumn("composite_score", sum((F.lit(float(w[k])) * F.col(k) for k in WEIGHTS), F.lit(0.0)))


def error_histogram(df: DataFrame, *by: str) -> DataFrame:
    """Rows in each of the six categories, also those with none. One pass; one row a group and category."""
    with_kind = df.withColumn("_kind", category(F.col("success"), F.col("error"), F.col("score")))
    counted = with_kind.groupBy(*by).agg(*[F.count_if(F.col("_kind") == c).alias(c) for c in CATEGORIES])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("count")) for c in CATEGORIES]))
    return counted.select(*by, stacked.alias("x")).select(*by, "x.*")


def consistency(df: DataFrame, order: str, limit: float = 0.1) -> DataFrame:
    """Tasks run several times whose scores deviate by more than ``limit`` (to nine digits, so that a deviation of just that is none): id, runs, deviation, scores in order."""
    runs = df.groupBy("task_id").agg(F.count("*").alias("num_runs"), _or_zero(F.stddev_pop("score")).alias("std"), F.transform(F.array_sort(F.collect_list(F.struct(order, "score"))), lambda x: x["score"]).alias("scores"))
    return runs.where((F.col("num_runs") > 1) & (F.round("std", 9) > limit))


def consistency_summary(df: DataFrame, limit: float = 0.1) -> DataFrame:
    """Tasks, runs, runs a task, and tasks whose scores deviate by more than ``limit``."""
    runs = df.groupBy("task_id").agg(F.count("*").alias("n"), _or_zero(F.stddev_pop("score")).alias("std"))
    out = runs.agg(F.count("*").alias("num_tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_runs"), F.count_if((F.col("n") > 1) & (F.round("std", 9) > limit)).alias("inconsistent_tasks"))
    return out.withColumn("avg_runs_per_task", F.when(F.col("num_tasks") > 0, F.col("total_runs") / F.col("num_tasks")).otherwise(F.lit(0.0)))


def leaderboard(df: DataFrame, by: str = "model") -> DataFrame:
    """Models by success rate, then mean score: rank, rates, mean time and cost a task. The window runs over one row a model."""
    table = df.groupBy(by).agg(F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("score").alias("avg_score"), F.avg("execution_time").alias("avg_time"), F.avg("cost").alias("cost_per_task"))
    return table.withColumn("rank", F.rank().over(Window.orderBy(F.desc("success_rate"), F.desc("avg_score"), by)).cast("long"))


def running_totals(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Add ``running_total`` of a value and ``running_count`` within a group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"running_total": F.sum(value).over(w), "running_count": F.count("*").over(w)})


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], stretch: int = 4096) -> DataFrame:
    """Add running sums of whole numbers within a group, up to and with each row, in the order of a column of whole numbers.

    A group is summed up in stretches of ``stretch`` of that column; what lies before a stretch is a running sum over stretches, one row each. So rows of one group are many tasks' work however
    many they are. Rows with equal places count together; null places come first.
    """
    df = df.withColumn("_stretch", F.floor(F.col(order) / stretch)).withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = df.groupBy(*by, "_stretch").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_stretch", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    within = Window.partitionBy(*by, "_stretch").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(within) for n in sums})
    joined = rows.alias("a").join(starts.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_stretch")])
    kept = [c for c in df.columns if c != "_stretch" and not c.startswith("_v_")]
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in kept], *[(F.col(f"_r_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])


def weighted_score(scores: Column, weights: Column) -> Column:
    """Sum of weight times score over the sum of weights, of two arrays; 0 without weight."""
    add = lambda a, x: a + x
    total = F.aggregate(weights, F.lit(0.0), add)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.aggregate(F.zip_with(scores, weights, lambda s, w: s * w), F.lit(0.0), add) / total)
