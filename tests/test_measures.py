from __future__ import annotations

from datetime import date

import pytest
from conftest import Shop, records

from bazaarium.operators.skew import SkewPolicy
from bazaarium.plans import measures
from bazaarium.plans.measures import Selection
from bazaarium.plans.model import build_model

MAY = (date(2019, 5, 1), date(2019, 5, 31))
JUNE = (date(2019, 6, 1), date(2019, 6, 30))


@pytest.fixture
def model(spark):
    shop = Shop()
    shop.rows["products"].append(("vase", "vidro", 1, 1, 1, 1, 1, 1, 1))
    shop.rows["category_translation"].append(("vidro", "glass"))
    shop.order("o1", "ann", "2019-05-05", scores=(1,))
    shop.order("o2", "ann", "2019-06-05", prices=(40, 8), products=("lamp", "vase"), after_days=14)
    shop.order("o3", "bob", "2019-06-01", scores=(5,))
    shop.order("o4", "bob", "2019-06-30 23:59:59", state="BA", after_days=None)
    shop.order("o5", "eve", "2019-06-02", status="canceled")
    shop.order("o6", "gil", "2019-05-30", state="CE")
    return build_model(shop.sources(spark))


def test_all_cards_of_one_state_and_month(model):
    row = measures.totals(model, Selection(period=JUNE, states=["PE"])).first()
    assert (row.delivered_orders, row.active_customers, float(row.delivered_gmv)) == (2, 2, 88.0)
    assert row.delivered_aov == 44.0
    assert (row.delivery_evaluable_orders, row.on_time_delivered_orders) == (2, 1)
    assert (row.reviewed_delivered_orders, row.low_review_delivered_orders) == (1, 0)
    assert row.low_review_rate == 0.0
    assert row.freight_to_gmv_ratio == pytest.approx(9 / 88)
    assert (row.average_delivery_days, row.average_review_score) == (10.0, 5.0)


def test_empty_selection_gives_blanks_not_zeros(model):
    row = measures.totals(model, Selection(states=["XX"])).first()
    assert (row.delivered_orders, row.delivered_gmv, row.delivered_aov) == (0, None, None)
    assert (row.on_time_delivery_rate, row.low_review_rate, row.average_review_score) == (None, None, None)
    assert records(measures.first_repeat_gmv(model, Selection(states=["XX"]))) == [(None, None)]


def test_repeat_customers_are_recounted_but_order_numbers_are_not(model):
    assert records(measures.repeat_rate(model)) == [(3, 2, pytest.approx(2 / 3))]
    june = measures.repeat_rate(model, Selection(period=JUNE), by=["purchase_month"])
    assert records(june) == [("2019-06", 2, 1, 0.5)]
    # Ann's June order is her second although May is not selected.
    assert records(measures.first_repeat_gmv(model, Selection(period=JUNE))) == [(40.0, 88.0)]
    assert records(measures.observed_repeat_pct(model)) == [(pytest.approx(2 / 3),)]


def test_item_filters_reach_items_only(model):
    glass = Selection(categories=["glass"])
    assert measures.select_orders(model, glass).count() == 5
    row = measures.totals(model, glass).first()
    assert (row.delivered_orders, float(row.delivered_gmv)) == (5, 8.0)
    assert records(measures.first_repeat_gmv(model, glass)) == [(None, 8.0)]
    assert measures.select_sales(model, Selection(products=["lamp"], sellers=["north"])).count() == 5


def test_home_location_is_the_latest_and_reaches_items_only(model):
    # Bob's latest order is in BA, so both of his orders' items follow.
    home = Selection(home_states=["BA"])
    assert records(measures.select_sales(model, home), "order_id") == [("o3",), ("o4",)]
    assert measures.select_orders(model, home).count() == 5
    assert measures.select_sales(model, Selection(home_cities=["nowhere"])).count() == 0


def test_segment_filter_reaches_orders_and_items(model):
    chosen = Selection(segments=["Active repeat"])
    assert measures.select_orders(model, chosen).count() == 4
    assert measures.select_sales(model, chosen).count() == 5
    assert measures.select_orders(model, Selection(segments=["Lapsed repeat"])).count() == 0


@pytest.mark.parametrize("rows_per_task", [0, 1, 2])
def test_customers_of_any_size_are_selected(model, rows_per_task):
    policy = SkewPolicy(rows_per_task=rows_per_task)
    assert measures.select_sales(model, Selection(segments=["Active repeat"]), policy).count() == 5
    assert measures.select_orders(model, Selection(segments=["Active repeat"]), policy).count() == 4


def test_hot_customers_are_counted_once_for_a_model_and_a_fact(model, monkeypatch):
    counted = []
    monkeypatch.setattr(measures, "hot_keys", lambda rows, key, policy: counted.append(rows.columns))
    for _ in range(2):
        measures.totals(model, Selection(segments=["Active repeat"], home_states=["BA"]))
    assert sorted(map(len, counted)) == sorted([len(model.fact_orders.columns), len(model.fact_sales.columns)])


def test_growth_ignores_the_selected_period_and_counts_a_loss(model):
    states = measures.growth(model, MAY, JUNE, Selection(period=MAY))
    assert records(states) == [
        ("BA", None, None, None, None),  # nothing before
        ("CE", -1.0, -1.0, -1.0, -1.0),  # nothing any more
        ("PE", pytest.approx(1.2), 1.0, 1.0, pytest.approx(0.1)),
    ]
    drivers = measures.growth_drivers(model, MAY, JUNE)
    assert records(drivers) == [
        ("aov_growth", pytest.approx(128 / 3 / 40 - 1)),
        ("customer_growth", 0.0),
        ("gmv_growth", pytest.approx(0.6)),
        ("orders_growth", 0.5),
    ]


def test_benchmark_covers_all_states_of_the_period(model):
    chosen = Selection(period=JUNE, states=["BA"])
    assert records(measures.state_vs_benchmark(model, chosen)) == [("BA", 1, None, 0.5)]


def test_top_lists_do_not_need_that_many_groups(model):
    assert records(measures.top_categories(model)) == [("glass", 8.0), ("lights", 200.0)]
    assert records(measures.top_states(model, places=1)) == [("PE", 128.0)]
