"""Seven-day forecasts: past-only features, rolling-origin checks, frozen method policy, publication."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Report
from ..functions.spread import exact_quantiles
from ..sources.stage import pinned
from . import boosting

# The compared methods in order of preference on equal error.
METHODS = ("gradient_boosting", "last_week", "four_week_mean", "exponential_smoothing", "croston_sba")
SIMPLE = METHODS[1:]
HORIZON = 7
FEATURES = [
    "mean7", "mean14", "std28", "nonzero_share", "week_before", "max28",
    "idle", "week_slope", "median_gap", "weekday", "month",
]


@dataclass(frozen=True)
class Plan:
    """Origins (day numbers) of one rolling-origin check over ``n`` calendar days."""

    n: int
    validation: int
    calibration: int

    @staticmethod
    def for_days(n: int) -> Plan:
        validation = min(12, max(1, (n - 56) // 7 - 3))
        calibration = 20 if n >= 56 + (validation + 23) * 7 else 0
        return Plan(n, validation, calibration)

    @property
    def origins(self) -> list[int]:
        return list(range(self.n - (self.validation + self.calibration + 3) * HORIZON, self.n, HORIZON))

    def split(self, origin: Column) -> Column:
        index = (origin - F.lit(self.origins[0])) / HORIZON
        return (
            F.when(index < self.validation, "validation")
            .when(index < self.validation + self.calibration, "calibration")
            .otherwise("test")
        )


def calendar_length(report: Report) -> int:
    first, last = report.calendar_range
    return (last - first).days + 1


def arrays_of(grid: DataFrame) -> DataFrame:
    """One dense series per item (bounded by the calendar); the grid is already laid out by item."""
    pairs = F.array_sort(F.collect_list(F.struct("t", "quantity")))
    series = grid.groupBy("item_id").agg(F.transform(pairs, lambda p: p["quantity"]).alias("values"))
    known = F.array_position(F.transform("values", lambda v: v.isNotNull()), True)
    return series.withColumn("first", F.when(known > 0, known - 1).otherwise(F.size("values")).cast("int"))


def _part(start: Column | int, length: Column | int) -> Column:
    """values[start : start + length] with a 0-based start."""
    to = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.slice("values", to(start).cast("int") + 1, F.greatest(to(length).cast("int"), F.lit(0)))


def _finite(part: Column) -> Column:
    return ~F.exists(part, lambda v: v.isNull())


def _selling(part: Column) -> Column:
    return F.size(F.filter(part, lambda v: v != 0))


def _sum(part: Column) -> Column:
    return F.aggregate(part, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def report_blocker(report: Report, record_kind: str) -> str | None:
    """Why no forecast can be made for the whole report; the first applicable code."""
    if record_kind == "monthly_summary":
        return "monthly_summary"
    if report.check_only:
        return "check_only"
    if not report.complete:
        return "coverage_unconfirmed"
    return None if report.complete_month else "month_incomplete"


def eligibility(arrays: DataFrame, n: int, blocker: str | None = None, cap: int | None = None) -> DataFrame:
    """Per item whether it is tested and published, or the coded reason why not.

    ``cap`` limits the tested items to those that sold most before the first origin; off by default.
    """
    if blocker or n < 90:
        return arrays.select(
            "item_id", F.lit(False).alias("tested"), F.lit(blocker or "history_short").alias("code")
        )
    selection = Plan.for_days(n).origins[0]
    before = _part(selection - 28, 28)
    upto = _part(F.col("first"), F.lit(selection) - F.col("first"))
    early = (
        F.when(F.col("first") > selection - 28, "item_history_short")
        .when(~_finite(upto), "missing_days")
        .when(_selling(before) < 4, "early_sales_sparse")
    )
    last90 = _finite(F.slice("values", -90, 90))
    late = (
        F.when(~last90 & (F.col("first") > n - 90), "recent_history_short")
        .when(~last90, "missing_days")
        .when(_selling(F.slice("values", -28, 28)) < 4, "recent_sales_sparse")
    )
    checked = arrays.select("item_id", early.alias("_early"), late.alias("_late"), _sum(before).alias("_size"))
    checked = checked.withColumn("tested", F.col("_early").isNull())
    if cap is not None:
        top = checked.filter("tested").orderBy(F.col("_size").desc(), "item_id").limit(cap)
        checked = checked.join(top.select("item_id", F.lit(True).alias("_top")), "item_id", "left")
        over = F.col("tested") & F.col("_top").isNull()
        checked = checked.withColumns({
            "_early": F.when(over, "capacity_limit").otherwise(F.col("_early")),
            "tested": F.col("tested") & ~over,
        })
    return checked.select("item_id", "tested", F.coalesce("_early", "_late").alias("code"))


def _smooth(past: Column) -> Column:
    level = F.aggregate(
        F.slice(past, F.lit(2), F.greatest(F.size(past) - 1, F.lit(0))),
        F.element_at(past, 1),
        lambda acc, v: acc + F.lit(0.2) * (v - acc),
    )
    return F.greatest(F.lit(0.0), level * HORIZON)


def _croston(past: Column) -> Column:
    sold = F.filter(
        F.transform(past, lambda v, i: F.struct(v.alias("v"), i.cast("double").alias("i"))), lambda p: p["v"] > 0
    )
    head = F.try_element_at(sold, F.lit(1))
    start = F.struct(head["v"].alias("demand"), (head["i"] + 1).alias("gap"), head["i"].alias("last"))
    state = F.aggregate(
        F.slice(sold, F.lit(2), F.greatest(F.size(sold) - 1, F.lit(0))),
        start,
        lambda s, p: F.struct(
            (s["demand"] + F.lit(0.1) * (p["v"] - s["demand"])).alias("demand"),
            (s["gap"] + F.lit(0.1) * (p["i"] - s["last"] - s["gap"])).alias("gap"),
            p["i"].alias("last"),
        ),
        lambda s: F.lit(0.95) * s["demand"] / s["gap"] * HORIZON,
    )
    return F.when(F.size(sold) > 0, F.greatest(F.lit(0.0), state)).otherwise(0.0)


def _estimates(origin: Column) -> dict[str, Column]:
    past = F.filter(_part(0, origin), lambda v: v.isNotNull())
    return {
        "last_week": _sum(F.slice(past, -7, 7)),
        "four_week_mean": _sum(F.slice(past, -28, 28)) / 4,
        "exponential_smoothing": _smooth(past),
        "croston_sba": _croston(past),
    }


def stratum(origin: Column) -> Column:
    recent = _part(origin - 28, 28)
    kind = F.when(_selling(recent) < 14, "intermittent").otherwise("regular")
    return F.concat(kind, F.when(_sum(recent) / 28 < 5, "_small").otherwise("_large"))


def simple_forecasts(arrays: DataFrame, origins: list[int], need_target: bool = True) -> DataFrame:
    """The four simple estimates at each origin, from days before it only.

    Origins are unfolded inside the item row; the series itself is never copied per origin. A test needs every day from the item's
    start to its target; a figure to publish needs the last four weeks, gaps before them are left out of the estimates.
    """
    def at(o):
        fields = [
            o.alias("origin"),
            stratum(o).alias("stratum"),
            *[c.alias(m) for m, c in _estimates(o).items()],
        ]
        if need_target:
            fields.append(_sum(_part(o, HORIZON)).alias("actual"))
        return F.struct(*fields)

    def known(o):
        return _finite(_part(F.col("first"), o + HORIZON - F.col("first")) if need_target else _part(o - 28, 28))

    usable = F.filter(F.array(*[F.lit(o) for o in origins]), lambda o: (o >= F.col("first") + 28) & known(o))
    return arrays.select("item_id", F.inline(F.transform(usable, at)))


def trailing_features(grid: DataFrame) -> DataFrame:
    """Past-only features of every item day, with the scale and the sum of the following week.

    All windows partition by item, so one layout serves them all.
    """
    by_day = Window.partitionBy("item_id").orderBy("t")
    back = lambda a, b: by_day.rowsBetween(-a, -b)
    q = F.col("quantity")
    sales = Window.partitionBy("item_id", "_sold").orderBy("t")
    marked = grid.withColumn("_sold", F.coalesce(q > 0, F.lit(False)))
    gap = F.when(F.col("_sold"), F.col("t") - F.lag("t").over(sales))
    marked = marked.withColumn("_gap", gap)
    recent_gaps = F.array_sort(F.collect_list("_gap").over(sales.rowsBetween(-18, 0)))
    n = F.size("_gaps")
    middle = (
        F.try_element_at("_gaps", F.greatest(F.floor((n + 1) / 2).cast("int"), F.lit(1)))
        + F.try_element_at("_gaps", F.greatest(F.ceil((n + 1) / 2).cast("int"), F.lit(1)))
    ) / 2
    marked = marked.withColumn("_gaps", F.when(F.col("_sold"), recent_gaps)).withColumn(
        "_median", F.when(n > 0, middle.cast("double"))
    )
    first = F.min(F.when(q.isNotNull(), F.col("t"))).over(Window.partitionBy("item_id"))
    scale = F.greatest(F.avg(q).over(back(28, 1)), F.lit(0.1))
    base = marked.select(
        "item_id", "t", "day",
        first.alias("first"),
        F.count(q).over(back(28, 1)).alias("known28"),
        F.count(q).over(by_day.rowsBetween(0, 6)).alias("known_next"),
        F.sum(q).over(by_day.rowsBetween(0, 6)).alias("next_week"),
        scale.alias("scale"),
        F.avg(q).over(back(7, 1)).alias("_m7"),
        F.avg(q).over(back(14, 1)).alias("_m14"),
        F.stddev_pop(q).over(back(28, 1)).alias("_s28"),
        F.count_if(q != 0).over(back(28, 1)).alias("_nz"),
        F.avg(q).over(back(14, 8)).alias("_mprev"),
        F.max(q).over(back(28, 1)).alias("_max"),
        F.max(F.when(F.col("_sold"), F.col("t"))).over(back(10_000, 1)).alias("_last"),
        F.sum(q).over(back(7, 1)).alias("_w4"),
        F.sum(q).over(back(28, 22)).alias("_w1"),
        F.last("_median", ignorenulls=True).over(back(10_000, 1)).alias("_gap"),
    ).filter("known28 = 28")
    s = F.col("scale")
    idle = F.coalesce(F.col("t") - 1 - F.col("_last"), F.lit(28))
    return base.select(
        "item_id", "t", "day", "first", "scale",
        F.when(F.col("known_next") == 7, F.col("next_week")).alias("next_week"),
        (F.col("_m7") / s).alias("mean7"),
        (F.col("_m14") / s).alias("mean14"),
        (F.col("_s28") / s).alias("std28"),
        (F.col("_nz") / 28).alias("nonzero_share"),
        (F.col("_mprev") / s).alias("week_before"),
        (F.col("_max") / s).alias("max28"),
        (F.least(idle, F.lit(90)) / 28).alias("idle"),
        ((F.col("_w4") - F.col("_w1")) / (s * 7)).alias("week_slope"),
        F.coalesce(F.col("_gap") / 28, F.lit(1.0)).alias("median_gap"),
        (F.weekday("day") / 6).alias("weekday"),
        (F.month("day") / 12).alias("month"),
    )


def with_next_day(grid: DataFrame, n: int) -> DataFrame:
    """The grid with one more, unknown day per item: the origin of the forecast to publish."""
    ahead = grid.groupBy("item_id").agg(F.max("day").alias("_last")).select("item_id", F.lit(n).cast(grid.schema["t"].dataType).alias("t"), F.date_add("_last", 1).alias("day"))
    return grid.select("item_id", "t", "day", "quantity").unionByName(ahead, allowMissingColumns=True)


#: Features of the older rule set.
V2_FEATURES = ["mean7", "mean14", "std28", "nonzero_share", "week", "week_before", "max28", "idle", "weekday", "month"]


def training_windows(features: DataFrame, keys: DataFrame, origins: Sequence[int], names: Sequence[str] = FEATURES) -> DataFrame:
    """Weekly windows of the half year before each origin, all labels ending before it: origin, features, label.

    The label is the next week over (scale · 7). Origins unfold inside the item days they may train on.
    """
    own = features.join(keys.select("item_id"), "item_id", "left_semi").filter(F.col("next_week").isNotNull())

    def trains(o: Column) -> Column:
        start = F.greatest(F.col("first") + 28, o - 180)
        return (F.col("t") >= start) & (F.col("t") < o - 6) & (F.pmod(F.col("t") - start, F.lit(HORIZON)) == 0)

    usable = F.filter(F.array(*[F.lit(int(o)) for o in origins]), trains)
    label = F.col("next_week") / (F.col("scale") * HORIZON)
    return own.select(F.explode(usable).alias("origin"), *names, label.alias("label"))


def boosted_forecasts(features: DataFrame, keys: DataFrame, origins: Sequence[int], trees: int = 80, names: Sequence[str] = FEATURES) -> DataFrame | None:
    """Pooled boosted trees at every origin, a model of its own each, all grown in the same passes.

    Origins with too few windows have no rows; None when there is no model at all.
    """
    settings = boosting.Boosting(trees=trees)
    models = boosting.fit(training_windows(features, keys, origins, names), "origin", names, "label", settings)
    if not models:
        return None
    now = features.join(keys.select("item_id"), "item_id", "left_semi").filter(F.col("t").isin([int(o) for o in models]))
    estimate = F.greatest(F.lit(0.0), F.col("_boosted")) * F.col("scale") * HORIZON
    found = boosting.predicted(now.withColumn("origin", F.col("t")), "origin", names, models, "_boosted")
    return found.select("item_id", "origin", estimate.alias("gradient_boosting"))


def gbt_forecast(features: DataFrame, keys: DataFrame, origin: int, trees: int = 80) -> DataFrame | None:
    """Boosted trees at one origin."""
    return boosted_forecasts(features, keys, [origin], trees)


def backtest(arrays: DataFrame, keys: DataFrame, plan: Plan, boosted: DataFrame | None = None) -> DataFrame:
    """Every tested item at every origin: actual week, estimates, split and stratum."""
    own = arrays.join(keys.select("item_id"), "item_id", "left_semi")
    rows = simple_forecasts(own, plan.origins).withColumn("split", plan.split(F.col("origin")))
    if boosted is None:
        return rows
    joined = rows.join(boosted, ["item_id", "origin"], "left")
    fitted = F.col("gradient_boosting").isNotNull()
    return joined.withColumns({
        "gradient_fitted": fitted,
        "gradient_boosting": F.coalesce("gradient_boosting", "four_week_mean"),
    })


def long_errors(backtest_rows: DataFrame) -> DataFrame:
    """One row per (item, origin, method)."""
    methods = [m for m in METHODS if m in backtest_rows.columns]
    keep = ["item_id", "origin", "split", "stratum", "actual"]
    return backtest_rows.unpivot(keep, methods, "method", "estimate")


def errors(backtest_rows: DataFrame, by=("method", "split")) -> DataFrame:
    """MAE, WAPE (null on a zero total) and bias per method and split."""
    long = long_errors(backtest_rows)
    off = F.col("estimate") - F.col("actual")
    return long.groupBy(*by).agg(
        F.avg(F.abs(off)).alias("mae"),
        F.try_divide(F.sum(F.abs(off)), F.nullif(F.sum("actual"), F.lit(0.0))).alias("wape"),
        F.avg(off).alias("bias"),
        F.count(F.lit(1)).alias("samples"),
    )


def select_policy(backtest_rows: DataFrame, validation_count: int) -> DataFrame:
    """The method per stratum, chosen on validation rows only (at most five rows).

    A candidate must beat the baseline by 5 %, the store-wide one must not be 5 % worse in any large
    stratum, and the whole policy must be 5 % better; else the baseline stays everywhere.
    """
    validation = backtest_rows.filter("split = 'validation'")
    if "gradient_fitted" in validation.columns:
        fitted = validation.groupBy().agg(F.coalesce(F.bool_and("gradient_fitted"), F.lit(False)).alias("gb"))
    else:
        fitted = validation.groupBy().agg(F.lit(False).alias("gb"))
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    one = lambda df: F.broadcast(df.withColumn("_k", F.lit(1)))
    per = long_errors(validation).groupBy("stratum", "origin", "method").agg(
        F.sum(F.abs(F.col("estimate") - F.col("actual"))).alias("off"), F.count(F.lit(1)).alias("n")
    )
    sums = per.groupBy("stratum", "method").agg(
        F.sum("off").alias("off"), F.sum("n").alias("n"), F.count_distinct("origin").alias("origins")
    )
    # From here on the tables hold at most 5 strata x 5 methods.
    sums = sums.withColumn("_k", F.lit(1)).join(one(fitted), "_k").filter(
        (F.col("method") != METHODS[0]) | F.col("gb")
    ).drop("_k", "gb")
    sums = pinned(sums, 25)
    total = sums.groupBy("method").agg(
        F.lit("all").alias("stratum"), F.sum("off").alias("off"), F.sum("n").alias("n"), F.max("origins").alias("origins")
    )
    table = sums.unionByName(total.select(*sums.columns)).withColumns({
        "mae": F.col("off") / F.col("n"), "place": order,
    })
    base = table.filter((F.col("stratum") == "all") & (F.col("place") <= 3)).agg(
        F.min_by("method", F.struct("mae", "place")).alias("baseline"), F.min("mae").alias("all_mae")
    )
    table = table.withColumn("_k", F.lit(1)).join(one(base), "_k").drop("_k")
    allowed = F.col("stratum").startswith("intermittent") | (F.col("stratum") == "all") | (F.col("method") != METHODS[-1])
    large = (F.col("stratum") == "all") | ((F.col("n") >= 30) & (F.col("origins") >= 6))
    rules = table.groupBy("stratum").agg(
        F.max("baseline").alias("baseline"),
        F.max("all_mae").alias("all_mae"),
        F.max("n").alias("n"),
        F.bool_and(large).alias("large"),
        F.min_by("method", F.when(allowed, F.struct("mae", "place"))).alias("candidate"),
        F.min(F.when(allowed, F.col("mae"))).alias("candidate_mae"),
        F.max(F.when(F.col("method") == F.col("baseline"), F.col("mae"))).alias("baseline_mae"),
    )
    better = (
        F.lit(validation_count >= 6)
        & (F.col("baseline_mae") > 0)
        & (F.col("candidate_mae") <= 0.95 * F.col("baseline_mae"))
    )
    store = rules.filter("stratum = 'all'").select(F.col("candidate").alias("store_candidate"))
    harmed = (
        table.filter("stratum <> 'all'").withColumn("_k", F.lit(1)).join(one(store), "_k")
        .groupBy("stratum").agg(
            F.max("n").alias("n"),
            F.max(F.when(F.col("method") == F.col("store_candidate"), F.col("mae"))).alias("c"),
            F.max(F.when(F.col("method") == F.col("baseline"), F.col("mae"))).alias("b"),
        )
        .agg(F.coalesce(F.bool_or((F.col("n") >= 30) & (F.col("c") > 1.05 * F.col("b"))), F.lit(False)).alias("harmed"))
    )
    rules = rules.withColumn("_k", F.lit(1)).join(one(harmed), "_k").drop("_k")
    passed = better & ((F.col("stratum") != "all") | ~F.col("harmed"))
    rules = rules.withColumn("validation_adopted", passed).withColumn(
        "choice", F.when(F.col("validation_adopted"), F.col("candidate")).otherwise(F.col("baseline"))
    )
    fallback = rules.filter("stratum = 'all'").select(F.col("choice").alias("store_choice"))
    used = rules.withColumn("_k", F.lit(1)).join(one(fallback), "_k").drop("_k")
    used = used.withColumn("effective", F.when(F.col("large"), F.col("choice")).otherwise(F.col("store_choice")))
    mixed = (
        used.filter("stratum <> 'all'").select("stratum", "effective")
        .join(table.select("stratum", F.col("method").alias("effective"), "off", "n"), ["stratum", "effective"])
        .agg((F.sum("off") / F.sum("n")).alias("policy_mae"))
    )
    kept = used.filter("large")
    gate = kept.agg(F.bool_or(F.col("choice") != F.col("baseline")).alias("changed"))
    kept = kept.withColumn("_k", F.lit(1)).join(one(mixed), "_k").join(one(gate), "_k").drop("_k")
    adopted = F.col("changed") & (F.col("policy_mae") <= 0.95 * F.col("all_mae"))
    result = kept.select(
        "stratum", "baseline", "candidate", "candidate_mae", "baseline_mae", "validation_adopted",
        F.when(adopted, F.col("choice")).otherwise(F.col("baseline")).alias("selected"),
        adopted.alias("policy_adopted"),
    )
    return pinned(result, 5)


def with_selection(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Backtest rows with the frozen method of their stratum and its estimate."""
    own = F.broadcast(policy.select("stratum", F.col("selected").alias("_own")))
    store = F.broadcast(policy.filter("stratum = 'all'").select(F.col("selected").alias("_store"), F.lit(1).alias("_k")))
    joined = rows.join(own, "stratum", "left").withColumn("_k", F.lit(1)).join(store, "_k").drop("_k")
    joined = joined.withColumn("selected_method", F.coalesce("_own", "_store")).drop("_own", "_store")
    value = F.lit(None).cast("double")
    for method in METHODS:
        if method in rows.columns:
            value = F.when(F.col("selected_method") == method, F.col(method)).otherwise(value)
    return joined.withColumn("selected", value)


def test_support(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Diagnostic only: did the frozen choice hold on the test split. It never revises the choice."""
    chosen = with_selection(rows, policy).filter("split = 'test'")
    base = policy.filter("stratum = 'all'").select(F.col("baseline").alias("_b"), F.lit(1).alias("_k"))
    chosen = chosen.withColumn("_k", F.lit(1)).join(F.broadcast(base), "_k")
    value = F.lit(None).cast("double")
    for method in METHODS:
        if method in rows.columns:
            value = F.when(F.col("_b") == method, F.col(method)).otherwise(value)
    return chosen.groupBy("stratum").agg(
        F.avg(F.abs(F.col("selected") - F.col("actual"))).alias("selected_mae"),
        F.avg(F.abs(value - F.col("actual"))).alias("baseline_mae"),
    ).withColumn("test_supported", F.col("selected_mae") <= F.col("baseline_mae"))


def calibration_ranges(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Per stratum the empirical error radius of the frozen method and its gates (at most five rows)."""
    chosen = with_selection(rows, policy).withColumn("off", F.abs(F.col("selected") - F.col("actual")))
    calibration = chosen.filter("split = 'calibration'")
    blocks = exact_quantiles(calibration, "off", {"median": 0.5}, ["stratum", "origin"])
    recent = Window.partitionBy("stratum").orderBy(F.col("origin").desc())
    early = Window.partitionBy("stratum").orderBy("origin")
    ranked = blocks.withColumns({"_late": F.row_number().over(recent), "_early": F.row_number().over(early)})
    radius = pinned(ranked.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("origins"),
        F.percentile("median", F.lit(0.9)).alias("radius"),  # at most 20 origins
        F.avg(F.when(F.col("_late") <= 5, F.col("median"))).alias("_late"),
        F.avg(F.when(F.col("_early") <= 10, F.col("median"))).alias("_early"),
    ), 4)
    inside = F.avg((F.col("off") <= F.col("radius")).cast("double"))
    covered = calibration.join(F.broadcast(radius), "stratum").groupBy("stratum").agg(inside.alias("coverage"))
    held = (
        chosen.filter("split = 'test'").join(F.broadcast(radius), "stratum").groupBy("stratum")
        .agg(inside.alias("heldout_coverage"))
    )
    steady = F.col("_late") <= F.greatest(F.lit(1.0), 1.5 * F.col("_early"))
    gate = (F.col("origins") >= 20) & (F.col("coverage") >= 0.8) & steady
    return radius.join(covered, "stratum").join(held, "stratum", "left").select(
        "stratum", "origins", "radius", "coverage",
        F.coalesce("heldout_coverage", F.lit(0.0)).alias("heldout_coverage"), gate.alias("range_ok"),
    )


def publish(rows: DataFrame, policy: DataFrame, arrays: DataFrame, eligible: DataFrame, report: Report, boosted: DataFrame | None = None) -> DataFrame:
    """Next week's figure per item, or the coded reason why there is none."""
    first, last = report.calendar_range
    n = (last - first).days + 1
    now = simple_forecasts(arrays, [n], need_target=False)
    if boosted is not None:
        now = now.join(boosted.drop("origin"), "item_id", "left").withColumn(
            "gradient_boosting", F.coalesce("gradient_boosting", "four_week_mean")
        )
    now = with_selection(now, policy).withColumnRenamed("selected", "quantity")
    own_errors = long_errors(rows).filter("split in ('validation', 'test')")
    off = F.abs(F.col("estimate") - F.col("actual"))
    on = lambda s: F.col("split") == s
    history = own_errors.groupBy("item_id", F.col("method").alias("selected_method")).agg(
        F.avg(F.when(on("validation"), off)).alias("validation_mae"),
        F.count_if(on("validation")).alias("validation_origins"),
    )
    tested = with_selection(rows, policy).filter("split = 'test'").groupBy("item_id").agg(
        F.avg(F.abs(F.col("selected") - F.col("actual"))).alias("test_mae"), F.count(F.lit(1)).alias("test_origins")
    )
    joined = (
        eligible.join(now, "item_id", "left")
        .join(history, ["item_id", "selected_method"], "left")
        .join(tested, "item_id", "left")
        .join(F.broadcast(calibration_ranges(rows, policy)), "stratum", "left")
    )
    wrong = F.col("validation_mae") > F.greatest(F.lit(2.0), F.col("four_week_mean") * 0.5)
    code = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.coalesce("validation_origins", F.lit(0)) == 0, "comparison_unavailable")
        .when(wrong, "validation_error")
    )
    joined = joined.withColumn("code", code)
    ok = F.col("code").isNull()
    ranged = ok & F.col("range_ok") & (F.col("radius") <= F.greatest(F.lit(2.0), F.col("quantity")))
    shown = lambda c: F.when(ok, F.round(c, 3))
    return joined.select(
        "item_id", "code", F.when(ok, F.col("selected_method")).alias("method"), "stratum",
        shown(F.col("quantity")).alias("quantity"),
        shown(F.col("validation_mae")).alias("validation_mae"),
        shown(F.col("test_mae")).alias("test_mae"),
        F.when(ranged, F.greatest(F.lit(0.0), F.round(F.col("quantity") - F.col("radius"), 3))).alias("lower"),
        F.when(ranged, F.round(F.col("quantity") + F.col("radius"), 3)).alias("upper"),
        F.lit(last + timedelta(days=1)).alias("start"),
        F.lit(last + timedelta(days=7)).alias("end"),
    )


# The older rule set: a fixed 42-day window, three methods, the last three origins as the test.


def v2_eligibility(arrays: DataFrame, n: int, cap: int | None = None) -> DataFrame:
    """Items with at least eight selling days right before the window and eight earlier ones."""
    selection = n - 42
    before, earlier = _part(selection - 28, 28), _part(0, selection - 28)
    chosen = arrays.filter((_selling(before) >= 8) & (_selling(earlier) >= 8)).select(
        "item_id", _sum(before).alias("recent_quantity")
    )
    return chosen if cap is None else chosen.orderBy(F.col("recent_quantity").desc(), "item_id").limit(cap)


def v2_origins(n: int) -> list[int]:
    return list(range(n - 42, n, HORIZON))


def v2_backtest(arrays: DataFrame, keys: DataFrame, n: int, boosted: DataFrame | None = None) -> DataFrame:
    """Six weekly origins in the last 42 days, the first three for validation; with ``boosted``, only origins that have a model."""
    own = arrays.join(keys.select("item_id"), "item_id", "left_semi")
    rows = simple_forecasts(own, v2_origins(n)).select("item_id", "origin", "stratum", "actual", "last_week", "four_week_mean")
    if boosted is not None:
        rows = rows.join(boosted, ["item_id", "origin"])
    return rows.withColumn("split", F.when(F.col("origin") < n - 21, "validation").otherwise("test"))


def v2_features(grid: DataFrame) -> DataFrame:
    """The older rule set's ten features of every item day, in the columns that boosted models read."""
    by_day = Window.partitionBy("item_id").orderBy("t")
    back = lambda a, b: by_day.rowsBetween(-a, -b)
    q = F.col("quantity")
    base = grid.select(
        "item_id", "t", F.min(F.when(q.isNotNull(), F.col("t"))).over(Window.partitionBy("item_id")).alias("first"),
        F.count(q).over(back(28, 1)).alias("_known"), F.count(q).over(by_day.rowsBetween(0, 6)).alias("_next"),
        F.sum(q).over(by_day.rowsBetween(0, 6)).alias("next_week"), F.greatest(F.avg(q).over(back(28, 1)), F.lit(0.1)).alias("scale"),
        F.avg(q).over(back(7, 1)).alias("_m7"), F.avg(q).over(back(14, 1)).alias("_m14"), F.stddev_pop(q).over(back(28, 1)).alias("_s28"),
        F.count_if(q != 0).over(back(28, 1)).alias("_nz"), F.sum(q).over(back(7, 1)).alias("_w1"), F.sum(q).over(back(14, 8)).alias("_w2"),
        F.max(q).over(back(28, 1)).alias("_max"), F.max(F.when(q > 0, F.col("t"))).over(back(10_000, 1)).alias("_last"), F.col("day"),
    ).filter("_known = 28")
    s = F.col("scale")
    return base.select(
        "item_id", "t", "first", "scale", F.when(F.col("_next") == HORIZON, F.col("next_week")).alias("next_week"),
        *[(F.col(c) / d).alias(name) for c, d, name in (
            ("_m7", s, "mean7"), ("_m14", s, "mean14"), ("_s28", s, "std28"), ("_nz", F.lit(28), "nonzero_share"),
            ("_w1", s * HORIZON, "week"), ("_w2", s * HORIZON, "week_before"), ("_max", s, "max28"),
        )],
        (F.coalesce(F.col("t") - 1 - F.col("_last"), F.lit(28)) / 28).alias("idle"),
        (F.weekday("day") / 6).alias("weekday"), (F.month("day") / 12).alias("month"),
    )


def v2_publish(rows: DataFrame, arrays: DataFrame, report: Report, boosted: DataFrame | None = None) -> DataFrame:
    """Next week's figure of every item that sold enough to its end and was forecast well enough, by the method of least validation error."""
    first, last = report.calendar_range
    n = (last - first).days + 1
    sold = F.array_position(F.transform("values", lambda v: F.coalesce(v != 0, F.lit(False))), True)
    final = arrays.filter((_selling(F.slice("values", -28, 28)) >= 8) & (_selling(_part(0, n - 28)) >= 8) & (F.lit(n) - (sold - 1) >= 90))
    now = final.select(
        "item_id", _sum(F.slice("values", -7, 7)).alias("last_week"), (_sum(F.slice("values", -28, 28)) / 4).alias("four_week_mean")
    )
    if boosted is not None:
        now = now.join(boosted.drop("origin"), "item_id", "left")
    chosen = F.broadcast(best_method(errors(rows)).withColumn("_k", F.lit(1)))
    validation = long_errors(rows).filter("split = 'validation'").groupBy("item_id", "method").agg(F.avg(F.abs(F.col("estimate") - F.col("actual"))).alias("validation_mae"))
    methods = [m for m in METHODS if m in now.columns]
    picked = F.coalesce(*[F.when(F.col("method") == m, F.col(m)) for m in methods])
    joined = now.withColumn("_k", F.lit(1)).join(chosen, "_k").drop("_k").join(validation, ["item_id", "method"])
    kept = joined.filter(F.col("validation_mae") <= F.greatest(F.lit(2.0), F.col("four_week_mean") * 0.5))
    return kept.select(
        "item_id", "method", F.round(picked, 3).alias("quantity"), F.round("validation_mae", 3).alias("validation_mae"),
        F.lit(last + timedelta(days=1)).alias("start"), F.lit(last + timedelta(days=7)).alias("end"),
    )


def best_method(metrics: DataFrame) -> DataFrame:
    """Lowest validation MAE; the method listed first wins a tie (one row)."""
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    return metrics.filter("split = 'validation'").agg(F.min_by("method", F.struct("mae", order)).alias("method"))


def weekly_boosted(long: DataFrame, key: str = "item_id", first: int = 36, last: int = 51, trees: int = 80) -> DataFrame:
    """Boosted trees one week ahead at each origin week, trained on all earlier weeks from the ninth on."""
    by_week = Window.partitionBy(key).orderBy("week")
    back = lambda n: by_week.rowsBetween(-n, -1)
    q = F.col("quantity").cast("double")
    scale = F.greatest(F.avg(q).over(back(4)), F.lit(0.1))
    names = ["lag1", "lag2", "mean8", "std4", "nonzero8"]
    rows = long.select(
        key, "week", q.alias("quantity"), scale.alias("scale"), (F.lag(q).over(by_week) / scale).alias("lag1"), (F.lag(q, 2).over(by_week) / scale).alias("lag2"),
        (F.avg(q).over(back(8)) / scale).alias("mean8"), (F.stddev_pop(q).over(back(4)) / scale).alias("std4"), (F.count_if(q != 0).over(back(8)) / 8).alias("nonzero8"),
    ).filter((F.col("week") >= 8) & (F.col("week") <= last))
    later = F.sequence(F.greatest(F.lit(first), F.col("week") + 1).cast("int"), F.lit(last))
    train = rows.filter(F.col("week") < last).select(F.explode(later).alias("origin"), *names, (F.col("quantity") / F.col("scale")).alias("label"))
    models = boosting.fit(train, "origin", names, "label", boosting.Boosting(trees=trees, least=1))
    found = boosting.predicted(rows.filter(F.col("week") >= first).withColumn("origin", F.col("week")), "origin", names, models, "_boosted")
    return found.select(key, "origin", (F.greatest(F.lit(0.0), F.col("_boosted")) * F.col("scale")).alias("gradient_boosting"))


def weekly_backtest(long: DataFrame, key: str = "item_id", first: int = 36, last: int = 51, validate: int = 8, boosted: DataFrame | None = None) -> DataFrame:
    """One-week-ahead check on weekly series: last week, four-week mean and, if given, boosted trees at each origin week."""
    by_week = Window.partitionBy(key).orderBy("week")
    q = F.col("quantity")
    rows = long.select(
        key,
        F.col("week").alias("origin"),
        q.cast("double").alias("actual"),
        F.lag(q).over(by_week).cast("double").alias("last_week"),
        F.avg(q).over(by_week.rowsBetween(-4, -1)).cast("double").alias("four_week_mean"),
    ).filter(F.col("origin").between(first, last))
    if boosted is not None:
        rows = rows.join(boosted, [key, "origin"])
    split = F.when(F.col("origin") < first + validate, "validation").otherwise("test")
    return rows.withColumns({"split": split, "stratum": F.lit("all")})


def day_of(report: Report, t: int) -> date:
    return report.calendar_range[0] + timedelta(days=t)
