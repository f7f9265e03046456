from __future__ import annotations

import sys
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from bazaarium import contracts  # noqa: E402
from bazaarium.contracts import Sources  # noqa: E402
from bazaarium.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").appName("tests")
    session = configure(builder).config("spark.sql.shuffle.partitions", "4").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


class Shop:
    """A tiny marketplace that tests fill order by order.

    By default a delivered order has one lamp for 40 plus 3 freight, paid by slip,
    promised after 12 days and delivered after 6.
    """

    def __init__(self):
        self.rows = {name: [] for name in contracts.SOURCES}
        self.rows["geolocation"] = [(50030,), (59020,)]
        self.rows["products"] = [("lamp", "luzes", 31, 440, 3, 1250, 22, 35, 18)]
        self.rows["sellers"] = [("north", 59020, "natal", "RN")]
        self.rows["category_translation"] = [("luzes", "lights")]

    def order(
        self,
        order_id,
        person,
        purchased,
        *,
        status="delivered",
        after_days=6,
        prices=(40,),
        products=None,
        payments=(("boleto", 43),),
        scores=(),
        state="PE",
        city="recife",
    ):
        when = at(purchased) if purchased else None

        def later(**delta):
            return when + timedelta(**delta) if when else None

        customer = f"c-{order_id}"
        self.rows["customers"].append((customer, person, 50030, city, state))
        delivered = later(days=after_days) if after_days is not None else None
        self.rows["orders"].append(
            (order_id, customer, status, when, later(minutes=20), later(days=3), delivered, later(days=12))
        )
        for number, price in enumerate(prices, start=1):
            product = products[number - 1] if products else "lamp"
            self.item(order_id, number, product, "north", price)
        for number, (kind, value) in enumerate(payments, start=1):
            self.rows["order_payments"].append((order_id, number, kind, number, _money(value)))
        for number, score in enumerate(scores, start=1):
            self.rows["order_reviews"].append((f"r-{order_id}-{number}", order_id, score, when, when))
        return self

    def item(self, order_id, number, product, seller, price, freight=3):
        self.rows["order_items"].append(
            (order_id, number, product, seller, at("2019-06-30"), _money(price), _money(freight))
        )
        return self

    def sources(self, spark) -> Sources:
        return Sources(**{name: frame(spark, rows, contracts.SOURCES[name]) for name, rows in self.rows.items()})


def frame(spark, rows, ddl):
    """A small DataFrame that lives in the JVM, so that tests need no Python workers."""
    schema = contracts.struct(ddl)
    columns = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(columns, to_arrow_schema(schema)), schema)


def _money(value):
    return None if value is None else Decimal(str(value))


@pytest.fixture
def mixed_orders() -> Shop:
    """A large late order with several items, payments and reviews; a prompt one; a late one nobody reviewed."""
    shop = Shop()
    shop.order(
        "large", "ana", "2019-03-04 09:30:00", after_days=15, prices=(30, 20, 10),
        payments=(("boleto", 20), ("voucher", 25), ("boleto", 24)), scores=(2, 1, 2),
    )
    shop.order("prompt", "ben", "2019-03-10 22:00:00", scores=(4,))
    shop.order("slow", "cai", "2019-03-20 07:15:00", after_days=14)
    return shop


@pytest.fixture(scope="session")
def star_folder() -> str:
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("test tables are not present")
    return str(folder)


def records(frame, *columns) -> list[tuple]:
    """Rows as sorted plain tuples."""
    chosen = frame.select(*columns) if columns else frame
    plain = [tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in chosen.collect()]
    return sorted(plain, key=repr)
