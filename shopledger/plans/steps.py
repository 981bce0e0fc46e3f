"""From one month's report to next steps: the admitted rows' order analyses, their runs, and what to do next."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import asdict
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Analysis, Mapping, Policy, Report, Scope
from ..operators import customers, orders, recommend
from ..sources.readers import fingerprint
from ..sources.stage import staged
from .orders import association, customer_groups

RUNS = (
    "run_id string, kind string, version_id string, mapping_revision string, duplicates string, filtered boolean, publishable boolean, "
    "scope_start date, scope_end date, latest_day date, reference_day date, finished timestamp"
)


def digest(*parts: object) -> str:
    return hashlib.sha256("\u0001".join(map(str, parts)).encode()).hexdigest()[:24]


def signature(rows: DataFrame, mappings: Sequence[Mapping]) -> tuple[str, str]:
    """What the sources hold, whatever their names and the order of their rows, and how they are mapped."""
    content = [c for c in rows.columns if c not in ("source_no", "issues")]
    prints = fingerprint(rows.select(*content)).collect()  # a row per source
    held = sorted((r["rows"], r["hash_xor"], r["hash_sum"]) for r in prints)
    return digest("rows", *held), digest("mapping", *sorted(str(sorted(asdict(m).items())) for m in mappings))


def runs_of(spark: SparkSession, ledger: str) -> DataFrame:
    """The latest run of every kind, content, mapping, policy and scope in the ledger."""
    try:
        rows = spark.read.schema(RUNS).parquet(ledger)
    except AnalysisException:
        return spark.createDataFrame([], RUNS)
    names = [c.split()[0] for c in RUNS.split(", ")]
    key = ["kind", "version_id", "mapping_revision", "duplicates", "filtered", "scope_start", "scope_end"]
    rest = [c for c in names if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("finished", "run_id")).alias("_run"))
    return latest.select(*[c if c in key else F.col(f"_run.{c}").alias(c) for c in names])


def record(spark: SparkSession, ledger: str, runs: Sequence[tuple]) -> None:
    """Append finished runs to the ledger."""
    spark.createDataFrame(list(runs), RUNS).coalesce(1).write.mode("append").parquet(ledger)


def admitted(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Normalised rows that the report admits; members of a conflicting order are of unknown status, duplicates are decided already."""
    return decided(orders.admit(rows, audit))


def decided(kept: DataFrame) -> DataFrame:
    """Admitted rows with issues that follow their status, and no duplicates left to find."""
    clash = F.col("record_status") == "unknown"
    plain = F.array_except("issues", F.array(F.lit("cancelled"), F.lit("returned")))
    issues = F.when(clash, F.array_union(plain, F.array(F.lit("unknown_status")))).otherwise(F.col("issues"))
    return kept.withColumns({"issues": issues, "duplicate_candidate": F.lit(False)})


def next_steps(
    month: dict[str, DataFrame], mappings: Sequence[Mapping], report: Report, ledger: str, at: datetime,
    params: Analysis = Analysis(), stock: DataFrame | None = None, publishable: bool | None = None,
) -> dict[str, DataFrame]:
    """Baskets and customers of the report's rows up to the end of its month, and the steps that follow.

    ``month`` is the result of monthly_report. Both analyses are entered in the ``ledger`` (a folder of run rows); the steps use those of its
    runs that the period guard lets join this report. ``stock`` adds whole packs to order for items with a published forecast. ``publishable`` overrides the customer groups' own gate.
    """
    spark, mapping = month["rows"].sparkSession, mappings[-1]
    version, revision = signature(month["rows"], mappings)
    scope, policy = Scope(date_start=report.coverage_start, date_end=report.month_end), Policy(duplicates=report.duplicates)
    rows = decided(orders.admit_labelled(month["rows"], month["labelled"]))  # read from the stored labels, each time the columns that are asked for
    resolved = staged(orders.resolve_orders(rows, mapping, policy, scope), "orders")
    baskets = staged(orders.basket_items(rows, resolved, policy, scope), "baskets")
    view = staged(orders.order_views(resolved)["rf_orders"], "customer-orders")
    reference = report.month_end + timedelta(days=1)
    pairs = association(baskets, params)
    groups = customer_groups(view, "rf", reference, params)
    late = groups["followups"] if publishable is None else staged(customers.followups(view, reference, publishable), "followups")
    people = view.select("customer_id").distinct().count()
    summary = customers.followup_summary(late, people)
    latest = rows.filter("record_status = 'forward'").agg(F.max(F.when(F.col("day") <= F.lit(report.month_end), F.col("day")))).first()[0]

    def run(kind: str, fine: bool, after: date | None) -> tuple:
        name = digest(kind, version, revision, report.month, at.isoformat())
        return name, kind, version, revision, report.duplicates, False, fine, report.coverage_start, report.month_end, latest, after, at

    record(spark, ledger, [run("association", not pairs["rules"].isEmpty(), None), run("customers", not late.isEmpty(), reference)])
    sources = spark.createDataFrame([(version, revision)], "version_id string, mapping_revision string")
    allowed = recommend.period_guard(runs_of(spark, ledger), report, sources)
    kinds = {r["kind"] for r in allowed.select("kind").distinct().collect()}
    items = month["items"]
    sizes = items.agg(F.bool_and(F.col("amount").isNotNull()).alias("known"), F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity")).first()
    pool = recommend.action_pool(month["actions"], (sizes.amount if sizes.known else sizes.quantity) or 1.0)
    found = recommend.pairings(pairs["shown"], items, params.min_count)
    action = recommend.followup_action(summary, people)
    if "association" in kinds:
        pool = pool.unionByName(recommend.pairing_pool(found))
    if "customers" in kinds:
        pool = pool.unionByName(recommend.followup_pool(action))
    out = {
        "runs": allowed, "admitted": rows, "rules": pairs["rules"], "pairings": found, "followups": late, "followup_summary": summary,
        "steps": recommend.combine(pool),
    }
    if stock is not None and "forecast" in month:
        published = month["forecast"].select("item_id", "quantity", "start", "end")
        out["stock"] = recommend.stock_reference(published, stock, items)
    return out
