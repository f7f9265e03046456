"""Sketched distinct customers against sets."""

from __future__ import annotations

import random

import pytest
from conftest import Shop, records

from bazaarium.plans import sketches
from bazaarium.plans.model import build_model

MONTHS = ("2018-11", "2018-12", "2019-01", "2019-04")


@pytest.fixture(scope="module")
def shop():
    """600 orders of 150 persons, a third of them of one person; some are not delivered."""
    rng, shop, seen = random.Random(7), Shop(), []
    for number in range(600):
        person = "often" if number % 3 == 0 else f"p{rng.randrange(150)}"
        month, state = rng.choice(MONTHS), rng.choice(["PE", "RN"])
        status = "canceled" if number % 11 == 5 else "delivered"
        shop.order(f"o{number}", person, f"{month}-03 10:00:00", status=status, state=state)
        if status == "delivered":
            seen.append((month, state, person))
    return shop, seen


@pytest.fixture(scope="module")
def model(spark, shop):
    return build_model(shop[0].sources(spark))


def test_small_sets_are_exact_for_every_group(model, shop):
    cells = sketches.monthly(model).cache()
    expected = {(m, s): len({p for a, b, p in shop[1] if (a, b) == (m, s)}) for m, s, _ in shop[1]}
    found = {(r[0], r[1]): r[2] for r in sketches.active(cells, sketches.CELL).collect()}
    assert found == expected
    assert records(sketches.active(cells)) == [(len({p for _, _, p in shop[1]}),)]
    chosen = cells.filter("purchase_month IN ('2018-11', '2019-04')")
    assert records(sketches.active(chosen)) == [(len({p for m, _, p in shop[1] if m in ("2018-11", "2019-04")}),)]


def test_active_in_both_of_any_two_months(model, shop):
    people = {m: {p for a, _, p in shop[1] if a == m} for m in MONTHS}
    found = records(sketches.returning_by_month(model, sketches.monthly(model)))
    expected = {(a, b): len(people[a] & people[b]) for a in MONTHS for b in MONTHS if a < b}
    by_name = sketches.returning_by_month(model, sketches.monthly(model)).collect()
    assert len(found) == 6 and {(r.purchase_month, r.later_month): r.returning_customers for r in by_name} == expected
    assert all(r.estimated_both == r.returning_customers and r.within_bound for r in by_name)


def test_large_sets_stay_within_the_bound(spark):
    """30,000 customers in two half-overlapping months, with sketches far smaller than that."""
    cells = spark.sql("""
        SELECT purchase_month, 'PE' AS customer_state, theta_sketch_agg(id, 9) AS customers
        FROM (SELECT '2019-01' AS purchase_month, id FROM range(20000) UNION ALL
              SELECT '2019-02', id + 10000 FROM range(20000)) GROUP BY ALL""")
    limit = sketches.STANDARD_ERRORS / 510**0.5
    for row in sketches.active(cells, ["purchase_month"], 9).collect():
        assert row.estimated_customers != 20000 and abs(row.estimated_customers - 20000) <= 20000 * limit
    (row,) = sketches.returning(cells, 9).collect()
    assert abs(row.estimated_either - 30000) <= 30000 * limit
    assert abs(row.estimated_both - 10000) <= (10000 * 30000) ** 0.5 * limit


def test_nulls_and_an_empty_fact(model):
    empty = model.fact_orders.filter("false")
    none = type(model)(**{n: empty if n == "fact_orders" else (lambda n=n: getattr(model, n)) for n in model.NAMES})
    cells = sketches.monthly(none)
    assert records(cells) == [] and records(sketches.returning(cells)) == []
    assert records(sketches.active(cells)) == [(0,)] and records(sketches.active_by_state(none, cells)) == []
