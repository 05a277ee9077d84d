import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salesmart.session import configure  # noqa: E402
from salesmart.storage import clear  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = (
        configure(SparkSession.builder.master("local[4]").appName("salesmart-tests"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(warehouse))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear(session)
    session.stop()


RAW_DDL = (
    "order_id string, customer_id string, product string, category string, quantity double, "
    "unit_price double, sales double, profit double, date string, region string, "
    "discount_pct double, line int"
)
GOOD = {
    "order_id": "A", "customer_id": "c1", "product": "pen", "category": "Books", "quantity": 2.0,
    "unit_price": 5.0, "sales": 10.0, "profit": 4.0, "date": "2024-01-05", "region": "North",
    "discount_pct": 0.0, "line": 0,
}


@pytest.fixture
def raw(spark):
    """Raw rows from changes to one good row, numbered in the given order."""

    def make(*changes):
        rows = [{**GOOD, "line": n, **change} for n, change in enumerate(changes)]
        return spark.createDataFrame(
            [tuple(row[name] for name in GOOD) for row in rows], RAW_DDL
        )

    return make
