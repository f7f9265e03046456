"""Table contracts: ordered columns and types of sources, model tables and loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Source column names (spelling as delivered) with our types.
SOURCES: dict[str, str] = {
    "customers": """
        customer_id string, customer_unique_id string, customer_zip_code_prefix int,
        customer_city string, customer_state string""",
    "geolocation": "geolocation_zip_code_prefix int",
    "order_items": """
        order_id string, order_item_id int, product_id string, seller_id string,
        shipping_limit_date timestamp_ntz, price decimal(18,2), freight_value decimal(18,2)""",
    "order_payments": """
        order_id string, payment_sequential int, payment_type string,
        payment_installments int, payment_value decimal(18,2)""",
    "order_reviews": """
        review_id string, order_id string, review_score int,
        review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz""",
    "orders": """
        order_id string, customer_id string, order_status string,
        order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz,
        order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date timestamp_ntz""",
    "products": """
        product_id string, product_category_name string, product_name_lenght int,
        product_description_lenght int, product_photos_qty int, product_weight_g int,
        product_length_cm int, product_height_cm int, product_width_cm int""",
    "sellers": """
        seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string""",
    "category_translation": """
        product_category_name string, product_category_name_english string""",
}

# File name patterns of a raw delivery.
SOURCE_FILES: dict[str, str] = {
    "customers": "*customers_dataset.csv",
    "geolocation": "*geolocation_dataset.csv",
    "order_items": "*order_items_dataset.csv",
    "order_payments": "*order_payments_dataset.csv",
    "order_reviews": "*order_reviews_dataset.csv",
    "orders": "*orders_dataset.csv",
    "products": "*products_dataset.csv",
    "sellers": "*sellers_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
}

# Sources whose further columns are not under contract; their types are read off the file.
INFERRED_SOURCES = frozenset({"geolocation"})

# Free text with line breaks occurs only here. A multi-line CSV cannot be split
# inside a file, so every other source is read in line mode.
MULTILINE_SOURCES = frozenset({"order_reviews"})

# The seven model tables as the report layer reads them.
MODEL: dict[str, str] = {
    "fact_orders": """
        order_id string, customer_id string, order_status string,
        order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz,
        order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date date, customer_unique_id string,
        customer_zip_code_prefix bigint, customer_city string, customer_state string,
        item_gmv double, freight_value double, item_count bigint, seller_count bigint,
        category_count bigint, amount_paid double, max_installments bigint,
        payment_method_count bigint, primary_payment_type string, review_score double,
        review_count bigint, purchase_date date, purchase_month date, delivery_days double,
        delay_days double, late_flag bigint, on_time_flag bigint, low_review_flag bigint,
        is_delivered bigint, freight_to_item_value double,
        customer_delivered_order_number bigint, first_observed_delivered_order_flag bigint""",
    "fact_sales": """
        order_id string, order_item_id bigint, product_id string, seller_id string,
        shipping_limit_date timestamp_ntz, price double, freight_value double,
        product_category_name_english string, customer_unique_id string, order_status string,
        purchase_date date, purchase_month date, customer_state string, on_time_flag bigint,
        late_flag bigint, review_score double, low_review_flag bigint,
        primary_payment_type string, max_installments bigint""",
    "dim_customer": "customer_unique_id string, customer_city string, customer_state string",
    "dim_product": """
        product_id string, product_category_name_english string, product_name_lenght bigint,
        product_description_lenght bigint, product_photos_qty bigint, product_weight_g bigint,
        product_length_cm bigint, product_height_cm bigint, product_width_cm bigint""",
    "dim_seller": """
        seller_id string, seller_zip_code_prefix bigint, seller_city string, seller_state string""",
    "dim_date": """
        date date, date_key bigint, year bigint, quarter string, month_number bigint,
        month_name string, year_month date, week_of_year bigint, day_of_week string""",
    "mart_customer_rfm": """
        customer_unique_id string, first_purchase timestamp_ntz, last_purchase timestamp_ntz,
        frequency bigint, observed_gmv double, recency_days bigint, segment string,
        high_value_threshold_brl double""",
}

# What tells the rows of a model table apart.
MODEL_KEYS: dict[str, tuple[str, ...]] = {
    "fact_orders": ("order_id",),
    "fact_sales": ("order_id", "order_item_id"),
    "dim_customer": ("customer_unique_id",),
    "dim_product": ("product_id",),
    "dim_seller": ("seller_id",),
    "dim_date": ("date",),
    "mart_customer_rfm": ("customer_unique_id",),
}

# Month keys are text `YYYY-MM` in files and first-of-month dates in reports.
MONTH_KEYS = frozenset({"purchase_month", "year_month"})

# Legacy customer column names that existing reports refer to.
REPORT_RENAMES = {
    "dim_customer": {
        "customer_unique_id": "Column1",
        "customer_city": "Column2",
        "customer_state": "State",
    }
}

MANIFEST = "source_file string, target_schema string, target_table string, load_order int, enabled int"

AUDIT = """
    run_id string, source_file string, started_at timestamp_ntz, ended_at timestamp_ntz,
    source_rows bigint, written_rows bigint, status string, error string"""


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(" ".join(ddl.split()))


def columns(ddl: str) -> list[str]:
    return struct(ddl).names


class _Tables:
    """A fixed set of named DataFrames, reached as attributes.

    A table may be given as a function; it is planned when it is first used, so a
    query pays only for the tables it reads.
    """

    NAMES: tuple[str, ...] = ()

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if set(tables) != set(self.NAMES):
            raise ValueError(f"expected tables {sorted(self.NAMES)}, got {sorted(tables)}")
        self._given = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.NAMES:
            raise AttributeError(name)
        given = self._given[name]
        table = given if isinstance(given, DataFrame) else given()
        setattr(self, name, table)
        return table

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in self.NAMES]


class Sources(_Tables):
    """The nine raw tables."""

    NAMES = tuple(SOURCES)


class Model(_Tables):
    """The seven model tables, and payments at their own grain for the payment mix."""

    NAMES = (*MODEL, "stg_order_payments")

    def fact(self, key: object, find: Callable[[], object]) -> object:
        """A statistic of the model's tables, found when it is first asked for."""
        known = self.__dict__.setdefault("_facts", {})
        if key not in known:
            known[key] = find()
        return known[key]
