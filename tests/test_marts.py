from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import Shop, records

from bazaarium.plans import headline, marts, questions
from bazaarium.plans.headline import HeadlineParameters
from bazaarium.plans.model import build_model


def _by(frame, key):
    return {row[key]: row for row in frame.collect()}


def test_missing_reviews_leave_both_sides_of_a_rate(spark, mixed_orders):
    model = build_model(mixed_orders.sources(spark))
    (state,) = marts.state_performance(model).collect()
    assert (state.delivered_orders, state.low_review_rate) == (3, 0.5)
    assert state.average_review_score == pytest.approx((5 / 3 + 4) / 2)
    groups = _by(marts.delivery_experience(model), "delivery_group")
    assert (groups["Late"].low_review_rate, groups["Late"].high_review_rate) == (1.0, 0.0)
    assert (groups["On time or early"].low_review_rate, groups["On time or early"].high_review_rate) == (0.0, 1.0)
    assert (groups["Late"].delivered_orders, groups["Late"].average_delivery_days) == (2, 14.5)


def test_without_any_review_rates_are_null(spark, mixed_orders):
    mixed_orders.rows["order_reviews"].clear()
    model = build_model(mixed_orders.sources(spark))
    assert records(marts.state_performance(model), "low_review_rate", "average_review_score") == [(None, None)]


def _returning(first: str, *gaps: timedelta) -> Shop:
    """One customer per gap, who comes once and again after it; the last purchase ends the watch."""
    shop, start = Shop(), datetime.fromisoformat(first)
    for number, gap in enumerate(gaps):
        shop.order(f"{number}-1", f"customer {number}", str(start))
        shop.order(f"{number}-2", f"customer {number}", str(start + gap))
    return shop


MOMENT = timedelta(seconds=1)


def test_month_long_windows_include_their_last_moment_across_a_leap_day(spark):
    # 2020-02-10 plus 30 days is 2020-03-11, as February has 29 days.
    shop = _returning("2020-02-10 23:10:05", *(timedelta(days=30) + d for d in (-MOMENT, 0 * MOMENT, MOMENT)))
    shop.order("void", "customer 2", "2020-02-20", status="unavailable")
    model = build_model(shop.sources(spark))
    assert _by(marts.customer_lifecycle(model), "customer_unique_id")["customer 1"].days_to_second_order == 30.0
    assert str(_by(marts.customer_lifecycle(model), "customer_unique_id")["customer 1"].last_purchase_timestamp) == (
        "2020-03-11 23:10:05"
    )
    assert records(marts.repeat_windows(model, [30])) == [(30, 3, 2, pytest.approx(2 / 3))]


def test_customers_watched_for_less_than_the_window_are_left_out(spark):
    shop = Shop().order("old", "old", "2021-06-01 08:00:00").order("edge", "edge", "2021-07-04 08:00:00")
    shop.order("new", "new", "2021-07-04 08:00:01").order("again", "new", "2021-07-06")
    shop.order("last", "last", "2021-12-31 08:00:00")  # 180 days after "edge"
    model = build_model(shop.sources(spark))
    found = _by(marts.repeat_windows(model), "window_days")
    assert (found[180].eligible_customers, found[180].repeat_customers) == (2, 0)
    assert (found[60].eligible_customers, found[60].repeat_customers) == (3, 1)
    assert found[365].repeat_purchase_rate is None
    assert records(headline.retention(model)) == [(3, 1, pytest.approx(1 / 3))]


def test_nobody_followed_long_enough_gives_a_null_rate(spark, mixed_orders):
    model = build_model(mixed_orders.sources(spark))
    assert records(marts.repeat_windows(model, [60])) == [(60, 0, 0, None)]
    assert records(headline.retention(model)) == [(0, 0, None)]


def test_no_delivered_order_gives_empty_marts(spark):
    model = build_model(Shop().order("o", "p", "2018-01-01", status="shipped").sources(spark))
    for name, mart in marts.MARTS.items():
        assert mart(model).count() == 0, name


def test_monthly_change_skips_missing_months(spark):
    shop = Shop().order("a", "p", "2020-02-29", prices=(64,)).order("b", "q", "2020-06-07", prices=(72,))
    shop.order("c", "p", "2020-06-08", prices=(24,))
    model = build_model(shop.sources(spark))
    months = _by(marts.executive_monthly(model), "purchase_month")
    assert sorted(months) == ["2020-02", "2020-06"]
    june = months["2020-06"]
    assert (june.gmv_mom_rate, june.orders_mom_rate) == (0.5, 1.0)
    assert (june.first_order_gmv_brl, june.repeat_order_gmv_brl) == (72, 24)
    assert june.repeat_order_gmv_share == 0.25
    assert months["2020-02"].gmv_mom_rate is None
    assert records(questions.monthly_gmv_change(model), "purchase_month", "prior_month_gmv_brl") == [
        ("2020-02", None), ("2020-06", 64.0),
    ]


def test_lifecycle_keeps_unknown_value_null(spark):
    model = build_model(Shop().order("a", "p", "2018-01-01", prices=()).sources(spark))
    assert records(marts.customer_lifecycle(model), "delivered_orders", "observed_gmv_brl") == [(1, None)]


def test_cohorts_are_sparse_and_start_complete(spark):
    shop = Shop().order("a", "p", "2017-11-01").order("b", "q", "2017-11-20").order("c", "p", "2018-02-01")
    shop.order("d", "p", "2018-02-20").order("e", "r", "2018-02-01")
    assert records(marts.cohort_retention(build_model(shop.sources(spark)))) == [
        ("2017-11", "2017-11", 0, 2, 2, 1.0),
        ("2017-11", "2018-02", 3, 1, 2, 0.5),
        ("2018-02", "2018-02", 0, 1, 1, 1.0),
    ]


def test_category_rates_count_an_order_once(spark):
    shop = Shop()
    shop.order("many", "p", "2018-01-01", prices=(1, 1, 1), after_days=13, scores=(1,))
    shop.order("one", "q", "2018-01-02", prices=(7,), scores=(5,))
    (lights,) = marts.category_performance(build_model(shop.sources(spark))).collect()
    assert (lights.delivered_orders, lights.delivered_items, lights.delivered_gmv_brl) == (2, 4, 10)
    assert (lights.on_time_delivery_rate, lights.average_review_score) == (0.5, 3.0)
    assert lights.average_order_value_brl == 5.0


def test_payment_mix_counts_records_and_orders_of_delivered_orders(spark):
    shop = Shop().order("a", "p", "2018-01-01", payments=(("voucher", 10), ("voucher", 20), ("boleto", 70)))
    shop.order("b", "p", "2018-01-01", status="canceled", payments=(("voucher", 1000),))
    assert records(marts.payment_mix(build_model(shop.sources(spark)))) == [
        ("boleto", 1, 1, 70.0, 0.7), ("voucher", 2, 1, 30.0, 0.3),
    ]


def test_ties_share_a_place_in_state_ranking(spark):
    shop = Shop()
    products = [("lamp", 5), ("p2", 9), ("p3", 9), ("p4", 7), ("p5", 1)]
    for product, _ in products[1:]:
        shop.rows["products"].append((product, product, 1, 1, 1, 1, 1, 1, 1))
        shop.rows["category_translation"].append((product, product))
    shop.order("o", "p", "2018-01-01", prices=[v for _, v in products], products=[p for p, _ in products])
    ranked = questions.top_categories_by_state(build_model(shop.sources(spark)))
    assert records(ranked, "category_rank", "category") == [(1, "p2"), (1, "p3"), (2, "p4"), (3, "lights")]


def test_seller_rank_counts_only_sellers_with_enough_orders(spark):
    shop = Shop()
    for seller, orders, price in [("north", 2, 10), ("s2", 2, 10), ("s3", 3, 1), ("s4", 1, 999)]:
        if seller != "north":
            shop.rows["sellers"].append((seller, 1, "x", "RN"))
        for number in range(orders):
            order = f"{seller}-{number}"
            shop.order(order, "p", "2018-01-01", prices=(), scores=(number + 1,))
            shop.item(order, 1, "lamp", seller, price).item(order, 2, "lamp", seller, price)
    card = questions.seller_scorecard(build_model(shop.sources(spark)), min_orders=2)
    assert records(card, "seller_id", "gmv_rank", "delivered_orders", "associated_order_review_score") == [
        ("north", 1, 2, 1.5), ("s2", 1, 2, 1.5), ("s3", 2, 3, 2.0),
    ]


def test_delay_bands_in_order_of_delay(spark):
    shop = Shop()
    for name, days in [("far", 20), ("week", 19), ("three", 15), ("early", 1), ("exact", 12)]:
        shop.order(name, name, "2018-01-01", after_days=days, scores=(3,))
    shop.order("unreviewed", "x", "2018-01-01", after_days=30)
    bands = questions.review_by_delay_band(build_model(shop.sources(spark))).collect()
    assert [(b.delivery_band, b.reviewed_orders) for b in bands] == [
        ("On time or early", 2), ("1-3 days late", 1), ("4-7 days late", 1), ("More than 7 days late", 1),
    ]


def test_headline_blocks(spark):
    shop = Shop()
    for number in range(6):  # six customers of 2018 in PE, of whom two come back
        shop.order(f"p{number}", f"pe {number}", f"2018-0{number + 1}-11", state="SP", prices=(25,), scores=(5,))
    shop.order("p0+", "pe 0", "2018-05-20", state="SP", prices=(35,)).order("p1+", "pe 1", "2018-07-20", state="SP", prices=(15,))
    shop.order("r", "rio", "2017-03-03", state="RJ", prices=(50,), after_days=20, scores=(2,))
    blocks = headline.blocks(build_model(shop.sources(spark)))
    found = {name: frame.first() for name, frame in blocks.items()}
    assert found["overall"].delivered_orders == 9
    assert found["overall"].delivered_gmv_brl == 250
    assert found["overall"].repeat_order_gmv_share == pytest.approx(0.2)
    assert found["repeat"].repeat_customers == 2
    assert found["repeat"].repeat_customer_gmv_share == pytest.approx(0.4)
    assert (found["growth"].orders_prior, found["growth"].orders_current) == (1, 8)
    assert found["growth"].gmv_growth == pytest.approx(3.0)
    assert found["growth"].customer_growth == pytest.approx(5.0)
    assert found["delivery"].late_order_rate == pytest.approx(1 / 9)
    assert found["delivery"].late_low_review_rate == 1.0
    assert found["delivery"].low_review_rate_multiple_late_vs_on_time is None
    assert found["geography"].sp_gmv_share == pytest.approx(0.8)
    assert found["geography"].top_3_state_gmv_share == 1.0
    assert found["geography"].rj_on_time_rate == 0.0
    assert found["geography"].ba_on_time_rate is None


def test_growth_without_a_prior_year_is_null(spark):
    model = build_model(Shop().order("a", "p", "2018-02-03").order("b", "q", "2018-03-03").sources(spark))
    row = headline.growth(model, HeadlineParameters()).first()
    assert (row.orders_prior, row.orders_current, row.orders_growth) == (None, 2, None)
