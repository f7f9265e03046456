"""The cube answers like the facts, for any selection, and reads none of them."""

from __future__ import annotations

import random
from datetime import date

import pytest
from conftest import Shop, records

from bazaarium.contracts import Model
from bazaarium.plans import cube, measures
from bazaarium.plans.measures import Selection
from bazaarium.plans.model import build_model
from bazaarium.sinks import tables

SEGMENTS = ("Active repeat", "Lapsed repeat", "Recent high-value", "Recent first-time", "At-risk high-value", "Lapsed one-time")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory) -> tuple[Model, cube.Cube]:
    rng = random.Random(5)
    shop = Shop()
    shop.rows["products"].append(("rug", "tapetes", 1, 1, 1, 1, 1, 1, 1))
    people = [f"p{i}" for i in range(150)] + ["often"] * 40 + [None]
    for i in range(260):
        n = rng.randrange(3)
        shop.order(
            f"o{i}", rng.choice(people), f"2019-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d} 08:00:00",
            status=rng.choice(["delivered"] * 4 + ["shipped"]), after_days=rng.choice([None, 4, 14]),
            prices=[rng.randrange(1, 50) for _ in range(n)], products=[rng.choice(["lamp", "rug"]) for _ in range(n)],
            scores=[rng.randrange(1, 6)] * rng.randrange(2), state=rng.choice(["PE", "RN", "SP"]),
        )
    planned, root = build_model(shop.sources(spark)), str(tmp_path_factory.mktemp("model"))
    for name in Model.NAMES:
        tables.write_table(getattr(planned, name), root, name)
    model = tables.read_model(spark, root)
    cube.build(model, f"{root}/cube")
    return model, cube.read(spark, f"{root}/cube")


def some_selection(rng: random.Random) -> Selection:
    first = rng.randrange(1, 13)
    last = rng.randrange(first, 13)
    ends = (date(2019, first, 1), date(2019, last, {2: 28, 4: 30, 6: 30, 9: 30, 11: 30}.get(last, 31)))
    return Selection(
        period=rng.choice([None, ends]),
        states=rng.choice([None, ["PE"], ["RN", "SP"], ["nowhere"]]),
        segments=rng.choice([None, None, rng.sample(SEGMENTS, 3)]),
        categories=rng.choice([None, ["lights"], ["unknown"]]),
    )


def close(frame, names):
    shown = [[round(float(v), 9) if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in r] for r in frame.select(*names).collect()]
    return sorted(map(tuple, shown), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_facts_for_any_selection(stored, seed):
    model, own = stored
    selection = some_selection(random.Random(seed))
    assert cube.answers(selection)
    wanted = measures.totals(model, selection)
    assert close(cube.totals(own, model, selection), wanted.columns) == close(wanted, wanted.columns)
    by = [(), ("purchase_month",), ("customer_state",)][seed % 3]
    wanted = measures.repeat_rate(model, selection, by)
    assert close(cube.repeat_rate(own, model, selection, by), wanted.columns) == close(wanted, wanted.columns)


def test_repeat_customers_are_recounted_in_the_selection(stored):
    model, own = stored
    (found,) = records(cube.repeat_rate(own, model), "repeat_customers")
    months = sum(n for (n,) in records(cube.repeat_rate(own, model, by=("purchase_month",)), "repeat_customers"))
    assert found[0] > 10 and months != found[0]


def test_the_plan_reads_the_cube_alone(stored):
    model, own = stored

    def plan(selection):
        return cube.totals(own, model, selection)._jdf.queryExecution().executedPlan().toString()

    whole = Selection(period=(date(2019, 1, 1), date(2019, 3, 31)), states=["PE"])
    assert "fact_" not in plan(whole) and "/cube/words" in plan(whole)
    assert "fact_orders" in plan(Selection(period=(date(2019, 1, 2), date(2019, 3, 31))))
    assert "fact_sales" in plan(Selection(sellers=["north"]))
