from __future__ import annotations

from datetime import date

import pytest
from conftest import Shop, records

from bazaarium import contracts
from bazaarium.plans import model as plans
from bazaarium.plans.model import build_model


def _one(frame, **keys):
    for column, value in keys.items():
        frame = frame.filter(frame[column] == value)
    (row,) = frame.collect()
    return row


def test_tables_have_the_contract_columns(spark, mixed_orders):
    model = build_model(mixed_orders.sources(spark))
    for table, ddl in contracts.MODEL.items():
        assert getattr(model, table).columns == contracts.columns(ddl), table


def test_many_items_payments_and_reviews_do_not_multiply_money(spark, mixed_orders):
    model = build_model(mixed_orders.sources(spark))
    assert model.fact_orders.count() == 3
    assert model.fact_sales.count() == 5
    large = _one(model.fact_orders, order_id="large")
    assert (large.item_gmv, large.freight_value, large.amount_paid) == (60, 9, 69)
    assert (large.item_count, large.seller_count, large.category_count) == (3, 1, 1)
    assert (large.review_count, large.review_score) == (3, pytest.approx(5 / 3))
    assert (large.payment_method_count, large.max_installments) == (2, 3)
    assert large.primary_payment_type == "boleto"
    assert large.freight_to_item_value == pytest.approx(0.15)
    assert (large.delivery_days, large.delay_days) == (15.0, 3.0)
    assert (large.late_flag, large.on_time_flag, large.low_review_flag) == (1, 0, 1)
    assert (large.purchase_date, large.purchase_month) == (date(2019, 3, 4), "2019-03")


def test_missing_review_and_unknown_delivery_stay_null(spark, mixed_orders):
    mixed_orders.order("bare", "dora", "2019-04-04", after_days=None, prices=(), payments=())
    orders = build_model(mixed_orders.sources(spark)).fact_orders
    unreviewed = _one(orders, order_id="slow")
    assert unreviewed.review_score is None and unreviewed.low_review_flag is None
    bare = _one(orders, order_id="bare")
    assert bare.late_flag is None and bare.on_time_flag is None and bare.delivery_days is None
    # Nothing bought is unknown, not zero.
    assert bare.item_gmv is None and bare.freight_to_item_value is None and bare.amount_paid is None


def test_delivery_exactly_as_promised_is_on_time(spark):
    orders = build_model(Shop().order("o", "p", "2019-01-01", after_days=12).sources(spark)).fact_orders
    assert records(orders, "late_flag", "on_time_flag", "delay_days") == [(0, 1, 0.0)]


def test_mean_score_between_two_and_four_is_neither_low_nor_high(spark):
    shop = Shop().order("o", "p", "2018-01-01", scores=(2, 3))
    assert records(build_model(shop.sources(spark)).fact_orders, "review_score", "low_review_flag") == [(2.5, 0)]


def test_free_items_have_no_freight_ratio(spark):
    orders = build_model(Shop().order("o", "p", "2018-01-01", prices=(0,)).sources(spark)).fact_orders
    assert records(orders, "item_gmv", "freight_to_item_value") == [(0.0, None)]


def test_primary_payment_tie_goes_to_the_first_type(spark):
    shop = Shop().order(
        "o", "p", "2018-01-01", payments=(("voucher", 30), ("boleto", 20), ("boleto", 10), (None, 99))
    )
    paid = plans.payment_order(shop.sources(spark).order_payments)
    assert records(paid) == [("o", 159.0, 4, 2, "boleto")]


def test_order_numbers_follow_time_then_id_and_skip_undelivered(spark):
    shop = Shop()
    shop.order("b", "p", "2018-01-02").order("a", "p", "2018-01-02").order("z", "p", "2018-01-01")
    shop.order("x", "p", "2017-01-01", status="canceled").order("n", "p", None).order("o", None, "2018-01-01")
    orders = build_model(shop.sources(spark)).fact_orders
    numbers = records(
        orders, "order_id", "customer_delivered_order_number", "first_observed_delivered_order_flag"
    )
    assert numbers == [("a", 2, 0), ("b", 3, 0), ("n", 4, 0), ("o", None, 0), ("x", None, 0), ("z", 1, 1)]


def test_untranslated_and_missing_products_are_unknown(spark):
    shop = Shop().order("o", "p", "2018-01-01", prices=(1, 2, 3, 4), products=("lamp", "p2", "p3", "gone"))
    shop.rows["products"] += [("p2", "novo", 1, 1, 1, 1, 1, 1, 1), ("p3", None, 1, 1, 1, 1, 1, 1, 1)]
    model = build_model(shop.sources(spark))
    assert records(model.dim_product, "product_id", "product_category_name_english") == [
        ("lamp", "lights"), ("p2", "unknown"), ("p3", "unknown"),
    ]
    assert records(model.fact_sales, "product_category_name_english") == [
        ("lights",), ("unknown",), ("unknown",), ("unknown",),
    ]
    assert records(model.fact_orders, "category_count") == [(2,)]


def test_customer_location_is_that_of_the_latest_order_of_any_status(spark):
    shop = Shop()
    shop.order("o1", "mover", "2018-01-01", state="SP").order("o2", "mover", "2018-02-01", state="RJ", status="shipped")
    shop.order("t1", "tied", "2018-01-01", state="SP").order("t2", "tied", "2018-01-01", state="BA")
    shop.order("n1", "timeless", "2018-01-01", state="SP").order("n2", "timeless", None, state="BA")
    customers = build_model(shop.sources(spark)).dim_customer
    assert records(customers, "customer_unique_id", "customer_state") == [
        ("mover", "RJ"), ("tied", "BA"), ("timeless", "SP"),
    ]


def test_calendar_covers_every_day_of_all_orders(spark):
    shop = Shop().order("a", "p", "2015-12-31 23:59:00").order("b", "p", "2016-03-01", status="canceled")
    days = build_model(shop.sources(spark)).dim_date
    assert days.count() == 62
    assert tuple(_one(days, date_key=20160101)) == (
        date(2016, 1, 1), 20160101, 2016, "Q1", 1, "Jan", "2016-01", 53, "Fri",
    )


def test_segments_on_both_sides_of_every_limit(spark):
    """The last purchase is 2018-12-31 00:00, so recency is days to 2019-01-01."""
    shop = Shop().order("end", "end", "2018-12-31", prices=(1,))
    once = {"at90": "2018-10-03", "at91": "2018-10-02", "at180": "2018-07-05", "at181": "2018-07-04"}
    for name, day in once.items():
        shop.order(f"low-{name}", f"low-{name}", day, prices=(1,))
        shop.order(f"high-{name}", f"high-{name}", day, prices=(500,))
    for name in ("at180", "at181"):
        shop.order(f"twice-{name}-1", f"twice-{name}", "2018-01-01", prices=(1,))
        shop.order(f"twice-{name}-2", f"twice-{name}", once[name], prices=(1,))
    rfm = build_model(shop.sources(spark)).mart_customer_rfm
    segments = dict(records(rfm, "customer_unique_id", "segment"))
    assert records(rfm.select("high_value_threshold_brl").distinct()) == [(500.0,)]
    assert segments == {
        "end": "Recent first-time",
        "low-at90": "Recent first-time",
        "high-at90": "Recent high-value",
        "low-at91": "Mid-cycle one-time",
        "high-at91": "Mid-cycle one-time",
        "low-at180": "Mid-cycle one-time",
        "high-at180": "Mid-cycle one-time",
        "low-at181": "Lapsed one-time",
        "high-at181": "At-risk high-value",
        "twice-at180": "Active repeat",
        "twice-at181": "Lapsed repeat",
    }


def test_customer_without_items_is_worth_zero_in_rfm(spark):
    shop = Shop().order("a", "p", "2018-01-01", prices=())
    rfm = build_model(shop.sources(spark)).mart_customer_rfm
    assert records(rfm, "frequency", "observed_gmv", "recency_days", "high_value_threshold_brl") == [
        (1, 0.0, 1, 0.0)
    ]
