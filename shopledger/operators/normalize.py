"""Row normalisation: typed values, issue tags and the single reason a row is kept or left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NUMERIC_FIELDS, Mapping, Policy, Report, Scope
from ..functions.money import PRODUCT, money, multiply, sign_text
from ..functions.times import local_day, parse_time

IDENTIFIERS = ("order_id", "item_id", "customer_id")

# Reasons that exclude a row from every quality view, first match wins.
COMMON_PRIORITY = (
    "order_boundary_unknown", "missing_order", "order_conflict", "cancelled", "returned",
    "unknown_status", "invalid_quantity", "nonpositive_quantity", "duplicate_removed",
)
# Accepted item-type words and their kind.
TYPE_VALUES = {
    "physical": "physical", "实物": "physical", "实物商品": "physical", "fee_service": "fee_service",
    "费用": "fee_service", "服务": "fee_service", "accounting": "accounting", "记账": "accounting",
    "记账项目": "accounting",
}
# Special item codes of one public retail data set.
SPECIAL_CODES = {
    "POST": "fee_service", "DOT": "fee_service", "C2": "fee_service", "BANK CHARGES": "fee_service",
    "M": "accounting", "D": "accounting", "AMAZONFEE": "fee_service", "CRUK": "accounting",
    "S": "accounting",
}
# Names and ids that are bookkeeping, not merchandise (exact match).
NON_MERCHANDISE_NAMES = (
    "MANUAL", "POSTAGE", "DOTCOM POSTAGE", "BANK CHARGES", "DISCOUNT", "MAILOUT", "AMAZON FEE",
    "AMAZONFEE", "运费", "邮费", "手续费", "记账", "折扣",
)
NON_MERCHANDISE_IDS = ("POSTAGE", "BANK CHARGES", "AMAZONFEE", "AMAZON FEE", "MANUAL")


def lookup(values: dict[str, str], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table, key)


def tags(*pairs: tuple[Column, str]) -> Column:
    """Ordered list of the tags (words without commas) whose condition holds; no lambda, so that it runs in generated code."""
    found = F.concat_ws(",", *[F.when(condition, F.lit(tag)) for condition, tag in pairs])
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(found, ","))


def trim_ids(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    if not policy.trim_identifiers:
        return df
    return df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in IDENTIFIERS})


def status(mapping: Mapping) -> Column:
    """Meaning of the record; reads the trimmed order id and the raw status."""
    if mapping.status_rule == "all_forward":
        return F.lit("forward")
    if mapping.status_rule == "uci_cancel_prefix":
        cancelled = F.upper(F.coalesce("order_id", F.lit(""))).startswith("C")
        return F.when(cancelled, F.lit("cancelled")).otherwise(F.lit("forward"))
    if mapping.status_rule == "status_column":
        return F.coalesce(lookup(mapping.status_values, F.col("record_status")), F.lit("unknown"))
    return F.lit("unknown")


def currency(c: Column) -> Column:
    text = F.trim(c)
    code = F.upper(text)
    # most codes are in capitals already
    return F.when(text.rlike("^[A-Z]{3}$"), text).when(code.rlike("^[A-Z]{3}$"), code)


def line_amount(mode: str, quantity: Column, price: Column, declared: Column) -> Column:
    """The amount of one line under the chosen amount mode."""
    return multiply(quantity, price) if mode == "quantity_unit_price" else declared.cast(PRODUCT)


def normalize(canonical: DataFrame, mapping: Mapping, policy: Policy = Policy()) -> DataFrame:
    """Typed rows with ordered issue tags, the UTC instant and the local business day."""
    df = trim_ids(canonical, policy)
    typed = {n: money(F.col(n)) for n in NUMERIC_FIELDS}
    df = df.withColumns({
        **{f"_{n}_given": F.col(n).isNotNull() for n in NUMERIC_FIELDS},
        **{f"{n}_text": F.when(typed[n].isNotNull(), sign_text(F.col(n))) for n in NUMERIC_FIELDS},
        **typed,
        "event_time": parse_time(F.col("event_time"), mapping.time_format or "iso8601", mapping.timezone),
        "record_status": status(mapping),
        "currency": currency(F.col("currency")),
    })
    df = df.withColumn("source_line_amount", F.col("line_amount"))
    derived = multiply(F.col("quantity"), F.col("unit_price"))
    bad = {n: F.col(f"_{n}_given") & F.col(n).isNull() for n in NUMERIC_FIELDS}
    checks = [
        (F.lit(mapping.order_boundary == "unavailable"), "order_boundary_unknown"),
        (F.col("order_id").isNull(), "missing_order"),
        (F.col("item_id").isNull(), "missing_item"),
        (F.col("customer_id").isNull(), "missing_customer"),
        (F.col("event_time").isNull(), "invalid_time"),
        (F.col("record_status") == "cancelled", "cancelled"),
        (F.col("record_status") == "return", "returned"),
        (F.col("record_status") == "unknown", "unknown_status"),
        *[(bad[n], f"invalid_{n}") for n in NUMERIC_FIELDS],
    ]
    if mapping.mapped("quantity"):
        checks += [(F.col("quantity").isNull(), "invalid_quantity"), (F.col("quantity") <= 0, "nonpositive_quantity")]
    if mapping.amount_mode == "quantity_unit_price":
        differs = F.coalesce(F.col("line_amount").cast(PRODUCT) != derived, F.lit(False))
        checks.append((derived.isNotNull() & (differs | bad["line_amount"]), "amount_source_conflict"))
    checks.append((F.col("currency").isNull(), "unknown_currency"))
    issues = F.array_distinct(tags(*checks))
    amount = line_amount(mapping.amount_mode, F.col("quantity"), F.col("unit_price"), F.col("line_amount"))
    df = df.withColumns({"issues": issues, "_amount": amount})
    df = df.withColumn("line_amount", F.col("_amount")).drop("_amount", *[f"_{n}_given" for n in NUMERIC_FIELDS])
    if mapping.record_kind == "monthly_summary":
        day = F.to_date(F.lit(f"{mapping.summary_month}-01"))
    else:
        day = local_day(F.col("event_time"), mapping.timezone)
    return df.withColumn("day", day)


def sales_reason(mapping: Mapping) -> Column:
    """First of missing item, unusable date, status and quantity; else included."""
    zero_is_bad = (F.col("quantity") == 0) if mapping.record_kind == "transactions" else F.lit(False)
    quantity_bad = F.col("quantity").isNull() | (F.col("quantity") < 0) | zero_is_bad
    return (
        F.when(F.col("item_id").isNull(), "missing_item")
        .when(F.col("day").isNull(), "invalid_time")
        .when(F.col("record_status") == "cancelled", "cancelled")
        .when(F.col("record_status") == "return", "returned")
        .when(F.col("record_status") != "forward", "unknown_status")
        .when(quantity_bad, "invalid_quantity")
        .otherwise("included")
    )


def in_scope(scope: Scope) -> Column:
    """True when the row lies in the business scope; an unknown day fails a date scope."""
    ok = F.lit(True)
    if scope.countries:
        ok = ok & F.col("country").isin(*scope.countries)
    if scope.item_ids:
        ok = ok & F.col("item_id").isin(*scope.item_ids)
    if scope.currency:
        ok = ok & (F.col("currency") == scope.currency)
    if scope.date_start:
        ok = ok & (F.col("day") >= F.lit(scope.date_start))
    if scope.date_end:
        ok = ok & (F.col("day") <= F.lit(scope.date_end))
    return F.coalesce(ok, F.lit(False))


def primary_reason(policy: Policy, scope: Scope, conflict: Column) -> Column:
    """First matching common reason by priority, then the scope."""
    tagged = F.concat(
        F.col("issues"),
        tags(
            (F.coalesce(conflict, F.lit(False)), "order_conflict"),
            (F.col("duplicate_candidate") & F.lit(policy.duplicates == "drop_exact"), "duplicate_removed"),
        ),
    )
    first = F.try_element_at(F.array_intersect(F.array(*[F.lit(r) for r in COMMON_PRIORITY]), tagged), F.lit(1))
    return F.coalesce(first, F.when(in_scope(scope), F.lit("included")).otherwise(F.lit("filtered_out")))


def item_types(rows: DataFrame, report: Report, special_codes: bool = False) -> DataFrame:
    """Kind per item: user override, else the one source value, else a special code, else unknown."""
    # kinds travel as numbers: the least and greatest text would sort all rows by item, those of numbers are hashed
    words = sorted(set(TYPE_VALUES.values()))
    place = F.create_map(*[F.lit(x) for text, kind in TYPE_VALUES.items() for x in (text, words.index(kind))])
    kind = F.try_element_at(place, F.trim(F.coalesce("item_type", F.lit(""))))
    kinds = rows.withColumn("_kind", kind).groupBy("item_id").agg(F.min("_kind").alias("_low"), F.max("_kind").alias("_high"))
    word = F.create_map(*[F.lit(x) for pair in enumerate(words) for x in pair])
    kinds = kinds.withColumns({c: F.try_element_at(word, F.col(c)) for c in ("_low", "_high")})
    override = lookup(report.item_types, F.col("item_id"))
    one = F.col("_low").isNotNull() & (F.col("_low") == F.col("_high"))
    coded = F.when(F.lit(special_codes) & F.col("_low").isNull(), lookup(SPECIAL_CODES, F.upper(F.trim("item_id"))))
    return kinds.select(
        "item_id",
        F.coalesce(override, F.when(one, F.col("_low")), coded, F.lit("unknown")).alias("item_type"),
        F.when(override.isNotNull(), "user_mapping")
        .when(one, "mapped_source_field")
        .when(coded.isNotNull(), "special_codes")
        .when(F.col("_low").isNotNull(), "conflicting_types")
        .otherwise("not_provided")
        .alias("type_source"),
    )


def is_merchandise(strict_ids: bool = True) -> Column:
    """Items that sales advice may name. Exact names only: a POSTAGE STAMP SET is merchandise."""
    ok = (
        ~F.coalesce("item_type", F.lit("unknown")).isin("fee_service", "accounting")
        & (F.coalesce("type_source", F.lit("")) != "conflicting_types")
        & ~F.upper(F.trim(F.coalesce("name", F.lit("")))).isin(*NON_MERCHANDISE_NAMES)
        & F.coalesce(F.col("quantity") >= 0, F.lit(False))
    )
    return ok & ~F.upper(F.trim("item_id")).isin(*NON_MERCHANDISE_IDS) if strict_ids else ok


def issue_counts(rows: DataFrame) -> DataFrame:
    """Rows per issue tag; tags may overlap."""
    return rows.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


def missing_counts(rows: DataFrame, fields) -> DataFrame:
    counted = rows.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    return counted.unpivot([], list(fields), "field", "missing")


