"""A refreshed model equals one built anew, and months that nothing touched keep their files."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from conftest import Shop, records

from bazaarium.contracts import MODEL, Model
from bazaarium.plans import refresh
from bazaarium.plans.model import build_model
from bazaarium.sinks import tables


def store(spark, shop: Shop, root: str) -> None:
    model = build_model(shop.sources(spark))
    for name in Model.NAMES:
        tables.write_table(getattr(model, name), root, name)


def random_order(shop: Shop, rng: random.Random, name: str) -> None:
    month, day = rng.randrange(1, 9), rng.randrange(1, 28)
    shop.order(
        name,
        rng.choice(["ana", "ben", "cai", "dora", "eva", None]),
        None if rng.random() < 0.05 else f"2019-{month:02d}-{day:02d} 10:00:00",
        status=rng.choice(["delivered", "delivered", "shipped", "canceled"]),
        after_days=rng.choice([None, 3, 15]),
        prices=[rng.randrange(1, 90) for _ in range(rng.randrange(4))],
        payments=[("boleto", rng.randrange(99))] * rng.randrange(3),
        scores=[rng.randrange(1, 6)] * rng.randrange(2),
        state=rng.choice(["PE", "RN"]),
    )


def part(shop: Shop, names: set[str]) -> Shop:
    """The rows of some orders; products and sellers as they are."""
    chosen = Shop()
    for table, rows in shop.rows.items():
        own = {"orders": 0, "order_items": 0, "order_payments": 0, "order_reviews": 1}
        if table in own:
            rows = [r for r in rows if r[own[table]] in names]
        elif table == "customers":
            rows = [r for r in rows if r[0].removeprefix("c-") in names]
        chosen.rows[table] = rows
    return chosen


def both(first: Shop, second: Shop, replaced: set[str]) -> Shop:
    """The first shop with the replaced orders taken from the second."""
    kept, new = part(first, {r[0] for r in first.rows["orders"]} - replaced), part(second, replaced)
    merged = Shop()
    for table in merged.rows:
        same = table in ("products", "sellers", "category_translation", "geolocation")
        merged.rows[table] = kept.rows[table] + ([] if same else new.rows[table])
    return merged


def files_of(root: str) -> dict[str, int]:
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("fact_*/*/*.parquet")}


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_equals_a_full_build_for_any_delivery(spark, tmp_path, seed):
    rng = random.Random(seed)
    shop, later = Shop(), Shop()
    for i in range(25):
        random_order(shop, rng, f"o{i}")
    changed = set(rng.sample([f"o{i}" for i in range(25)], 4)) | {"new-1", "a-first", "new-2"}
    for name in sorted(changed):
        random_order(later, rng, name)
    root, full = str(tmp_path / "model"), str(tmp_path / "full")
    store(spark, shop, root)
    before = files_of(root)
    replaced = refresh.refresh(spark, root, later.sources(spark), str(tmp_path / "scratch"))
    store(spark, both(shop, later, changed), full)
    found, wanted = tables.read_model(spark, root), tables.read_model(spark, full)
    for name in MODEL:
        assert records(getattr(found, name)) == records(getattr(wanted, name)), name
    assert records(found.stg_order_payments) == records(wanted.stg_order_payments)
    folders = {f"{t}/purchase_month={m or '__HIVE_DEFAULT_PARTITION__'}" for t, months in replaced.items() for m in months}
    untouched = {path: at for path, at in before.items() if not any(f in path for f in folders)}
    assert untouched.items() <= files_of(root).items()


def test_only_months_that_change_are_written(spark, tmp_path):
    shop = Shop()
    for month in range(1, 7):
        shop.order(f"o{month}", "ana" if month < 3 else f"p{month}", f"2019-0{month}-05 10:00:00")
    root = str(tmp_path / "model")
    store(spark, shop, root)
    # Before ana's others: those are renumbered in their months; nobody else is touched.
    late = Shop().order("o0", "ana", "2018-12-01 09:00:00")
    replaced = refresh.refresh(spark, root, late.sources(spark), str(tmp_path / "one"))
    assert {t: sorted(m) for t, m in replaced.items()} == {
        "fact_orders": ["2018-12", "2019-01", "2019-02"], "fact_sales": ["2018-12"],
    }
    numbers = records(tables.read_model(spark, root).fact_orders, "order_id", "customer_delivered_order_number")
    assert numbers[:3] == [("o0", 1), ("o1", 2), ("o2", 3)]
    # The same delivery once more changes no order.
    again = refresh.refresh(spark, root, late.sources(spark), str(tmp_path / "two"))
    assert again["fact_orders"] == []
    # An order that moves to another month leaves an empty one behind.
    moved = Shop().order("o6", "p6", "2019-05-05 10:00:00")
    refresh.refresh(spark, root, moved.sources(spark), str(tmp_path / "three"))
    assert not list(Path(root).glob("fact_*/purchase_month=2019-06"))
    assert tables.read_model(spark, root).fact_sales.count() == 7
