"""Report outputs: CSV tables, ordered mart CSVs, JSON documents, the summary."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarium import contracts
from bazaarium.contracts import Model
from bazaarium.plans import marts
from bazaarium.sources import files

# Exported marts and their row order.
MART_EXPORTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "monthly_performance": ("mart_executive_monthly", ("purchase_month",)),
    "cohort_retention": ("mart_cohort_retention", ("cohort_month", "cohort_period")),
    "repeat_purchase_windows": ("mart_repeat_windows", ("window_days",)),
    "category_performance": ("mart_category_performance", ("-delivered_gmv_brl", "category")),
    "state_performance": ("mart_state_performance", ("-delivered_gmv_brl", "customer_state")),
    "delivery_experience": ("mart_delivery_experience", ("delivery_group",)),
    "payment_mix": ("mart_payment_mix", ("-payment_value_brl", "payment_type")),
    "rfm_segment_summary": ("mart_rfm_segment_summary", ("-observed_gmv_brl", "segment")),
}


def _text_timestamps(rows: DataFrame) -> DataFrame:
    """Timestamps as plain text with fractions only where there are any."""
    texts = {
        name: F.col(name).cast("string") for name, kind in rows.dtypes if kind.startswith("timestamp")
    }
    return rows.withColumns(texts) if texts else rows


def write_csv(rows: DataFrame, location: str, compression: str = "none") -> None:
    """A directory of part files, each with a header, written in parallel."""
    (
        _text_timestamps(rows)
        .write.mode("overwrite")
        .options(header=True, quote='"', escape='"', encoding="UTF-8", emptyValue="", nullValue="")
        .option("compression", compression)
        .csv(location)
    )


def export_report_tables(model: Model, folder: str, compression: str = "none") -> None:
    for table, ddl in contracts.MODEL.items():
        rows = getattr(model, table).select(*contracts.columns(ddl))
        write_csv(rows, f"{folder.rstrip('/')}/{table}.csv", compression)


def _direction(key: str) -> Column:
    return F.col(key[1:]).desc() if key.startswith("-") else F.col(key).asc()


def export_marts(model: Model, folder: str) -> None:
    """Marts in report order. The sort is range-partitioned, so reading the part files
    by name gives the order; AQE leaves one file for small marts."""
    for name, (mart, order) in MART_EXPORTS.items():
        rows = marts.MARTS[mart](model).orderBy(*[_direction(key) for key in order])
        write_csv(rows, f"{folder.rstrip('/')}/{name}.csv")


def _plain(value: object) -> object:
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (datetime, date)):
        return str(value)
    raise TypeError(f"cannot write {type(value).__name__} to JSON")


def write_json(spark: SparkSession, document: Mapping[str, object], path: str) -> None:
    files.write_text(spark, path, json.dumps(document, indent=2, default=_plain, ensure_ascii=False))


def collect_blocks(blocks: Mapping[str, DataFrame]) -> dict[str, dict[str, object]]:
    """One-row frames as a nested document; an empty frame gives an empty block."""
    document = {}
    for name, frame in blocks.items():
        row = frame.first()
        document[name] = row.asDict() if row else {}
    return document


def _figure(value: object, style: str) -> str:
    return "not available" if value is None else format(float(value), style)


def summary(headline: Mapping[str, Mapping[str, object]]) -> str:
    """The headline figures as a short Markdown text."""
    overall, repeat, growth = headline["overall"], headline["repeat"], headline["growth"]
    delivery, retention = headline["delivery"], headline["retention"]
    risk, geography = headline["rfm_opportunity"], headline["geography"]
    lines = ["# Analysis summary", "", "## Scope", ""]
    lines.append(
        f"- {_figure(overall['delivered_orders'], ',.0f')} delivered orders of "
        f"{_figure(overall['observed_customers'], ',.0f')} customers, purchased "
        f"{str(overall['first_purchase_timestamp'])[:10]} to {str(overall['last_purchase_timestamp'])[:10]}."
    )
    lines += ["", "## Figures", ""]
    lines.append(
        f"- Delivered GMV {_figure(overall['delivered_gmv_brl'], ',.2f')}, "
        f"average order value {_figure(overall['average_order_value_brl'], ',.2f')}."
    )
    lines.append(
        f"- Same months a year apart: GMV growth {_figure(growth.get('gmv_growth'), '.1%')}, "
        f"order growth {_figure(growth.get('orders_growth'), '.1%')}."
    )
    lines.append(
        f"- Repeat customers {_figure(repeat['repeat_customer_rate'], '.2%')}; repeat orders carry "
        f"{_figure(overall['repeat_order_gmv_share'], '.2%')} of GMV."
    )
    lines.extend(f"- {name}: {_figure(value, ',.4g')}" for name, value in retention.items())
    lines.append(
        f"- On time {_figure(overall['on_time_delivery_rate'], '.1%')}; mean review "
        f"{_figure(delivery['late_average_review'], '.2f')} late against "
        f"{_figure(delivery['on_time_average_review'], '.2f')} on time; low reviews "
        f"{_figure(delivery['late_low_review_rate'], '.1%')} against "
        f"{_figure(delivery['on_time_low_review_rate'], '.1%')}."
    )
    lines.append(
        f"- At-risk high-value customers {_figure(risk.get('at_risk_high_value_customers'), ',.0f')}, "
        f"{_figure(risk.get('at_risk_high_value_gmv_share'), '.1%')} of GMV."
    )
    lines.extend(f"- {name}: {_figure(value, '.1%')}" for name, value in geography.items())
    return "\n".join(lines) + "\n"
