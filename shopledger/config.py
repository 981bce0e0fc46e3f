"""Validated settings passed to the operators. Plain values only, no data."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field
from datetime import date, timedelta

# Canonical fields, in contract order.
FIELDS = (
    "order_id", "item_id", "item_name", "customer_id", "event_time", "quantity", "unit_price",
    "line_amount", "order_amount", "currency", "record_status", "country", "category", "item_type",
)
NUMERIC_FIELDS = ("quantity", "unit_price", "line_amount", "order_amount")
LINE_MODES = ("line_amount", "quantity_unit_price")


@dataclass(frozen=True)
class Mapping:
    """How one source's raw columns are to be read."""

    columns: dict[str, str | None] = field(default_factory=lambda: {f: f for f in FIELDS})
    order_boundary: str = "order_id"
    amount_mode: str = "line_amount"
    quantity_unit: str = ""
    currency_constant: str | None = None
    time_format: str = "iso8601"
    timezone: str = "UTC"
    status_rule: str = "all_forward"
    status_values: dict[str, str] = field(default_factory=dict)
    record_kind: str = "transactions"
    summary_month: str | None = None

    def mapped(self, name: str) -> bool:
        return bool(self.columns.get(name))


@dataclass(frozen=True)
class Policy:
    """Cleaning decisions for the quality views."""

    trim_identifiers: bool = True
    duplicates: str = "keep"
    monetary_subset: str = "all_customers"
    accept_selected_amount_source: bool = False


@dataclass(frozen=True)
class Scope:
    """Business filter; an empty value means no restriction."""

    date_start: date | None = None
    date_end: date | None = None
    countries: tuple[str, ...] = ()
    item_ids: tuple[str, ...] = ()
    currency: str | None = None


@dataclass(frozen=True)
class Report:
    """Parameters of one monthly sales report."""

    month: str
    merge_mode: str = "append"
    duplicates: str = "keep"
    coverage_start: date | None = None
    coverage_end: date | None = None
    complete_coverage: bool = False
    closed_dates: tuple[date, ...] = ()
    missing_dates: tuple[date, ...] = ()
    item_start_dates: dict[str, date] = field(default_factory=dict)
    item_types: dict[str, str] = field(default_factory=dict)
    check_only: bool = False
    calendar_days: int | None = None  # days of the dense calendar; None: all that are covered

    @property
    def month_start(self) -> date:
        return date.fromisoformat(self.month + "-01")

    @property
    def month_end(self) -> date:
        start = self.month_start
        return start.replace(day=calendar.monthrange(start.year, start.month)[1])

    @property
    def previous_end(self) -> date:
        return self.month_start - timedelta(days=1)

    @property
    def previous_start(self) -> date:
        return self.previous_end.replace(day=1)

    @property
    def complete(self) -> bool:
        return bool(self.complete_coverage and self.coverage_start and self.coverage_end)

    @property
    def complete_month(self) -> bool:
        return (
            self.complete
            and self.coverage_start <= self.month_start
            and self.coverage_end >= self.month_end
        )

    @property
    def calendar_range(self) -> tuple[date, date]:
        """First and last day of the dense daily calendar: all covered days, or the last ``calendar_days`` of them."""
        end = min(self.coverage_end, self.month_end)
        if self.calendar_days is None:
            return self.coverage_start, end
        return max(self.coverage_start, end - timedelta(days=self.calendar_days - 1)), end

    def comparative(self, gap_days=()) -> bool:
        """Two complete months without a day of unknown records in either of them."""
        unknown = set(self.missing_dates) | set(gap_days)
        return (
            self.complete
            and self.coverage_start <= self.previous_start
            and self.coverage_end >= self.month_end
            and not any(self.previous_start <= d <= self.month_end for d in unknown)
        )


@dataclass(frozen=True)
class Analysis:
    """Parameters of clustering and association runs."""

    k_min: int = 2
    k_max: int = 8
    random_state: int = 42
    n_init: int = 10
    min_support: float = 0.005
    min_count: int = 20
    min_confidence: float = 0.2
    max_length: int = 3

    def __post_init__(self):
        if not 2 <= self.max_length <= 3:
            raise ValueError("max_length must be 2 or 3")
