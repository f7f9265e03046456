"""The curve of repeat purchases equals counting each window by itself."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import Shop, records

from bazaarium.plans import marts, repeat_curve
from bazaarium.plans.model import build_model
from test_refresh import random_order


def brute_force(histories: dict[str, list[datetime]], days: int) -> tuple[int, int]:
    end, window = max(t for times in histories.values() for t in times), timedelta(days=days)
    followed = [sorted(times) for times in histories.values() if end - min(times) >= window]
    return len(followed), sum(len(times) > 1 and times[1] - times[0] <= window for times in followed)


def random_histories(shop: Shop, seed: int) -> dict[str, list[datetime]]:
    rng, histories = random.Random(seed), {}
    for number in range(60):
        person = f"p{rng.randrange(30)}"
        # Whole days are frequent, so that windows end exactly at a purchase.
        when = datetime(2019, 1, 1) + timedelta(days=rng.randrange(420), seconds=rng.choice([0, 0, 1, 86399]))
        histories.setdefault(person, []).append(when)
        shop.order(f"o{number}", person, str(when))
    return histories


@pytest.mark.parametrize("seed", [1, 2])
def test_every_window_equals_brute_force(spark, seed):
    shop = Shop()
    histories = random_histories(shop, seed)
    found = repeat_curve.repeat_curve(build_model(shop.sources(spark))).collect()
    assert [r.window_days for r in found] == list(range(len(found)))
    for row in found:
        assert (row.eligible_customers, row.repeat_customers) == brute_force(histories, row.window_days)
        assert row.repeat_purchase_rate == pytest.approx(row.repeat_customers / row.eligible_customers)
    assert brute_force(histories, len(found)) == (0, 0)


def test_windows_of_the_curve_equal_the_mart(spark):
    shop, rng = Shop(), random.Random(7)
    for number in range(60):
        random_order(shop, rng, f"o{number}")
    model = build_model(shop.sources(spark))
    chosen = (0, 1, 7, *marts.REPEAT_WINDOWS)
    found = repeat_curve.windows_of(repeat_curve.repeat_curve(model), chosen)
    assert records(found) == records(marts.repeat_windows(model, chosen))


def test_steps_add_up_over_parts(spark):
    """Steps of two stores with the same last purchase are the steps of both together."""
    both, parts = Shop(), [Shop(), Shop()]
    for part, shop in enumerate(parts):
        for number, day in enumerate((3, 9, 20, 31)):
            for target in (both, shop):
                target.order(f"o{part}-{number}", f"p{part}-{number % 2}", f"2019-01-{day:02d} 08:00:00")
    one, two = (repeat_curve.steps(build_model(shop.sources(spark))) for shop in parts)
    summed = one.union(two).groupBy("day").agg({"eligible": "sum", "repeating": "sum"})
    summed = summed.toDF("day", *[c[4:-1] for c in summed.columns[1:]]).select("day", "eligible", "repeating")
    assert records(repeat_curve.curve(summed)) == records(
        repeat_curve.repeat_curve(build_model(both.sources(spark)))
    )


def test_no_orders_give_no_curve(spark):
    model = build_model(Shop().sources(spark))
    found = repeat_curve.repeat_curve(model)
    assert found.count() == 0 and repeat_curve.windows_of(found).count() == 0
