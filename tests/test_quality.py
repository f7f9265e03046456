from __future__ import annotations

import pytest
from conftest import Shop, records

from bazaarium.plans import quality
from bazaarium.plans.model import build_model


def test_clean_sources_pass_all_ten_checks(spark, mixed_orders):
    checks = quality.gate(quality.raw_checks(mixed_orders.sources(spark)))
    assert len(checks) == 10
    assert set(checks.values()) == {0.0}


def _fails(spark, shop: Shop, check: str, count: int = 1):
    with pytest.raises(ValueError, match=f"'{check}': {count}"):
        quality.gate(quality.raw_checks(shop.sources(spark)))


@pytest.mark.parametrize(
    "table, check",
    [
        ("customers", "duplicate_customer_ids"),
        ("orders", "duplicate_order_ids"),
        ("products", "duplicate_product_ids"),
        ("sellers", "duplicate_seller_ids"),
        ("order_items", "duplicate_order_item_keys"),
    ],
)
def test_repeated_key_fails_and_names_the_check(spark, mixed_orders, table, check):
    mixed_orders.rows[table].append(mixed_orders.rows[table][0])
    _fails(spark, mixed_orders, check)


@pytest.mark.parametrize(
    "item, check",
    [
        (("nowhere", 9, "lamp", "north", 1), "orphan_item_orders"),
        (("prompt", 9, "nothing", "north", 1), "orphan_item_products"),
        (("slow", 9, "lamp", "nobody", 1), "orphan_item_sellers"),
    ],
)
def test_reference_without_parent_fails(spark, mixed_orders, item, check):
    _fails(spark, mixed_orders.item(*item), check)


def test_negative_amounts_fail(spark, mixed_orders):
    _fails(spark, mixed_orders.item("prompt", 9, "lamp", "north", -1), "negative_item_prices")
    mixed_orders.rows["order_items"].pop()
    _fails(spark, mixed_orders.item("prompt", 9, "lamp", "north", 1, freight=-1), "negative_freight_values")


def test_repeated_null_keys_count_as_duplicates(spark, mixed_orders):
    mixed_orders.rows["sellers"] += [(None, 1, "a", "RN"), (None, 2, "b", "CE"), (None, 3, "c", "RN")]
    _fails(spark, mixed_orders, "duplicate_seller_ids", 2)


def test_translation_must_be_unique(spark, mixed_orders):
    mixed_orders.rows["category_translation"].append(("luzes", "torches"))
    with pytest.raises(ValueError, match="category_translation is not unique.*1 surplus"):
        quality.require_unique_join_sides(mixed_orders.sources(spark))


def test_row_counts_cover_all_nine_sources(spark, mixed_orders):
    counts = dict(records(quality.source_row_counts(mixed_orders.sources(spark))))
    assert len(counts) == 9
    assert (counts["orders"], counts["order_items"], counts["order_reviews"]) == (3, 5, 4)


def test_gmv_reconciles_and_a_gap_raises(spark, mixed_orders):
    model = build_model(mixed_orders.sources(spark))
    same = quality.gmv_reconciliation(model.fact_orders, model.fact_sales)
    assert records(same) == [(140.0, 140.0, 0.0)]
    quality.require_reconciled(same)
    gap = quality.gmv_reconciliation(model.fact_orders, model.fact_sales.filter("price > 10"))
    with pytest.raises(ValueError, match="does not reconcile"):
        quality.require_reconciled(gap)


@pytest.mark.parametrize("lost", ["orders", "sales"])
def test_a_fact_without_rows_does_not_reconcile(spark, mixed_orders, lost):
    model = build_model(mixed_orders.sources(spark))
    facts = {"orders": model.fact_orders, "sales": model.fact_sales}
    facts[lost] = facts[lost].filter("false")
    with pytest.raises(ValueError, match="does not reconcile"):
        quality.require_reconciled(quality.gmv_reconciliation(**facts))


def test_an_unknown_difference_does_not_reconcile(spark):
    with pytest.raises(ValueError, match="does not reconcile"):
        quality.require_reconciled(spark.sql("SELECT CAST(NULL AS DOUBLE) AS reconciliation_difference"))


def test_the_gate_report_marks_what_the_gate_would_raise(spark, mixed_orders):
    mixed_orders.item("prompt", 9, "lamp", "north", -1)
    report = quality.gate_report(quality.raw_checks(mixed_orders.sources(spark)))
    assert records(report.filter("failed"), "check_name", "value") == [("negative_item_prices", 1.0)]


def test_join_cardinality_counts_repeated_keys(spark, mixed_orders):
    mixed_orders.rows["products"] += [mixed_orders.rows["products"][0]] * 2
    found = dict(records(quality.join_cardinality(mixed_orders.sources(spark)), "check_name", "value"))
    assert found.pop("products_product_id") == 2.0 and set(found.values()) == {0.0} and len(found) == 4


def test_descriptive_checks(spark, mixed_orders):
    mixed_orders.order("before", "dora", "2019-04-01 12:00:00", after_days=-1, products=("vase",))
    mixed_orders.rows["products"].append(("vase", None, 5, 5, 5, 5, 5, 5, 5))
    model = build_model(mixed_orders.sources(spark))
    found = {name: value for name, value, _ in records(quality.model_checks(model.fact_orders, model.fact_sales))}
    assert found["fact_order_rows"] == 4
    assert found["fact_sales_rows"] == 6
    assert found["delivered_order_rows"] == 4
    assert found["review_coverage_delivered_orders"] == 0.5
    assert found["unknown_category_item_share"] == pytest.approx(1 / 6)
    assert found["invalid_delivery_before_purchase"] == 1
    assert found["missing_purchase_time"] == 0
    # Customer values 40, 40, 40, 60: rank 2.25 lies between 40 and 60.
    assert found["rfm_high_value_threshold_brl"] == pytest.approx(45)
