"""Whole batch: read, check, build, reconcile, store, export, report.

    python -m bazaarium.job --raw DELIVERY_DIR --out OUTPUT_DIR

Every run writes to a folder of its own, OUTPUT_DIR/runs/RUN: `staged/stg_*`, `model/*`
(parquet), `report_tables/*.csv`, `results/*.csv`, `results/data_quality_report.json`,
`results/headline_metrics.json` and `results/summary.md`. It is published when all of it
is there; a run that fails a check leaves the published one as it was. Run it with
spark-submit on a cluster.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from bazaarium.contracts import Model, Sources
from bazaarium.operators.skew import SkewPolicy
from bazaarium.plans import headline, model as plans, quality
from bazaarium.plans.headline import HeadlineParameters
from bazaarium.plans.marts import register_staged, register_views
from bazaarium.session import configure, fit_partitions, planned_bytes
from bazaarium.sinks import publish, reports, tables
from bazaarium.sources.raw_csv import read_sources


def build(
    sources: Sources,
    out: str,
    policy: SkewPolicy = SkewPolicy(),
    item_spread: Sequence[str] = ("order_item_id",),
) -> Model:
    """Check the sources, then build and store the model under `out`, a run's own folder.

    Each fact is stored once and read back, so later tables and marts scan columns
    of a stored fact instead of repeating its joins, and a lost executor costs no
    more than the table being written.
    """
    spark = sources.orders.sparkSession
    fit_partitions(spark, planned_bytes(rows for _, rows in sources.items()))
    model_root, results = f"{out}/model", f"{out}/results"
    sources = tables.stage_sources(sources, f"{out}/staged")
    register_staged(sources)

    raw = quality.gate(quality.raw_checks(sources))
    quality.require_unique_join_sides(sources)

    orders = tables.write_table(plans.fact_orders(sources, policy), model_root, "fact_orders")
    sales = tables.write_table(
        plans.fact_sales(sources, orders, policy, item_spread), model_root, "fact_sales"
    )
    reconciliation = quality.gmv_reconciliation(orders, sales)
    quality.require_reconciled(reconciliation)
    small = {
        "dim_customer": plans.dim_customer(orders),
        "dim_product": plans.dim_product(sources.products, sources.category_translation),
        "dim_seller": plans.dim_seller(sources.sellers),
        "dim_date": plans.dim_date(orders),
        "mart_customer_rfm": plans.mart_customer_rfm(orders),
        "stg_order_payments": sources.order_payments,
    }
    stored = {name: tables.write_table(rows, model_root, name) for name, rows in small.items()}

    document = quality.report(
        quality.source_row_counts(sources),
        raw,
        quality.model_checks(orders, sales, stored["mart_customer_rfm"]),
        reconciliation,
    )
    reports.write_json(spark, document, f"{results}/data_quality_report.json")
    return Model(fact_orders=orders, fact_sales=sales, **stored)


def analyse(
    spark: SparkSession,
    model: Model,
    out: str,
    parameters: HeadlineParameters = HeadlineParameters(),
) -> dict[str, dict[str, object]]:
    """Export the report tables, the marts and the headline figures of a stored model."""
    results = f"{out}/results"
    register_views(model)
    reports.export_report_tables(model, f"{out}/report_tables")
    reports.export_marts(model, results)
    figures = reports.collect_blocks(headline.blocks(model, parameters))
    reports.write_json(spark, figures, f"{results}/headline_metrics.json")
    reports.files.write_text(spark, f"{results}/summary.md", reports.summary(figures))
    return figures


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--raw", required=True, help="folder of the raw CSV delivery")
    parser.add_argument("--out", required=True, help="folder for all outputs")
    parser.add_argument("--prior-year", type=int, default=HeadlineParameters.prior_year)
    parser.add_argument("--current-year", type=int, default=HeadlineParameters.current_year)
    options = parser.parse_args(arguments)

    spark = configure(SparkSession.builder.appName("bazaarium")).getOrCreate()
    run = publish.new_run(options.out)
    model = build(read_sources(spark, options.raw), run)
    parameters = HeadlineParameters(options.prior_year, options.current_year)
    analyse(spark, model, run, parameters)
    publish.publish(spark, run)


if __name__ == "__main__":
    main()
