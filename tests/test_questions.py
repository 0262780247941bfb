from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from askframe.engine import Engine, RegistryEngine
from askframe.functions.dates import find_ranges
from askframe.functions.numbers import parse_number
from askframe.nl.normalize import normalize
from askframe.sources.catalog import Catalog
from askframe.sources.examples import BUSINESS, demo_catalogs, property_schema

TODAY = date(2026, 9, 18)


@pytest.fixture(scope="module")
def business():
    return Engine(Catalog.from_dict(BUSINESS), today=TODAY)


@pytest.fixture(scope="module")
def property_questions():
    return Engine(Catalog.from_dict(property_schema()), today=TODAY)


@pytest.mark.parametrize(
    "text, value",
    [("five", 5), ("twenty one", 21), ("$1,234.5", "1234.5"), ("2.5 million", 2500000), ("one and a half million", 1500000), ("three hundred and five", 305), ("two thousand and twelve", 2012), ("half a million", 500000), ("a hundred", 100)],
)
def test_numbers(text, value):
    assert parse_number(text) == Decimal(value)


@pytest.mark.parametrize("text", ["", "abc", "one hundred and five hundred", "five apples", "and"])
def test_no_numbers(text):
    assert parse_number(text) is None


@given(st.integers(0, 10**12))
def test_digits_stay(n):
    assert parse_number(f"{n:,}") == n


@given(st.text(max_size=60))
def test_any_text_is_normalised(text):
    assert normalize(normalize(text)) is not None


def test_dates():
    only = lambda t: [(r.start, r.end) for r in find_ranges(t, TODAY)]
    assert only("orders from the last 7 days") == [(date(2026, 9, 12), date(2026, 9, 19))]
    assert only("last week") == [(date(2026, 9, 7), date(2026, 9, 14))]
    assert only("this month") == [(date(2026, 9, 1), date(2026, 10, 1))]
    assert only("last year") == [(date(2025, 1, 1), date(2026, 1, 1))]
    assert only("between january 1 2026 and january 31 2026") == [(date(2026, 1, 1), date(2026, 2, 1))]
    assert only("after march 1") == [(date(2026, 3, 2), date.max)]
    assert only("before 2026-01-05") == [(date.min, date(2026, 1, 5))]
    assert only("after february 30 2026") == []


GOLDEN = [
    ("Show customers who spent more than 5 million", "SELECT customer_id, SUM(amount) AS total_purchase FROM orders GROUP BY customer_id HAVING SUM(amount) > ?", (5000000,)),
    ("Show orders between 100 and 500", "SELECT * FROM orders WHERE amount BETWEEN ? AND ?", (100, 500)),
    ("How many customers are there?", "SELECT COUNT(id) AS count FROM customers", ()),
    ("Count orders per customer", "SELECT customer_id, COUNT(id) AS count FROM orders GROUP BY customer_id", ()),
    ("Show the latest 20 orders", "SELECT * FROM orders ORDER BY created_at DESC LIMIT ?", (20,)),
    ("Sort customers by name ascending", "SELECT * FROM customers ORDER BY name ASC", ()),
    ("Sales by month", "SELECT date_trunc('month', created_at) AS created_at, SUM(amount) AS total_amount FROM orders GROUP BY date_trunc('month', created_at)", ()),
    ("Sales per customer", "SELECT customer_id, SUM(amount) AS total_amount FROM orders GROUP BY customer_id", ()),
    ("Show the 5 customers with the highest total spending", "SELECT customer_id, SUM(amount) AS total_purchase FROM orders GROUP BY customer_id ORDER BY SUM(amount) DESC LIMIT ?", (5,)),
]
PROPERTIES = [
    ("show top 5 properties by sale price", "SELECT * FROM housing ORDER BY sale_price DESC LIMIT ?", (5,)),
    ("average sale price", "SELECT AVG(sale_price) AS avg_sale_price FROM housing", ()),
    ("show properties built after 2000", "SELECT * FROM housing WHERE year_built > ?", (2000,)),
    ("show properties where land use is single family", "SELECT * FROM housing WHERE LOWER(land_use) = LOWER(?)", ("single family",)),
    ("show properties with total value between 200000 and 500000", "SELECT * FROM housing WHERE total_value BETWEEN ? AND ?", (200000, 500000)),
    ("show property address and sale price for properties with sale price above 1000000", "SELECT property_address, sale_price FROM housing WHERE sale_price > ?", (1000000,)),
    ("count properties where land use is duplex", "SELECT COUNT(unique_id) AS count FROM housing WHERE LOWER(land_use) = LOWER(?)", ("duplex",)),
    ("maximum total value for properties with bedrooms at least 4", "SELECT MAX(total_value) AS max_total_value FROM housing WHERE bedrooms >= ?", (4,)),
    ("find houses with acreage above 1.5 and full bath at least 2 sort by acreage descending", "SELECT * FROM housing WHERE acreage > ? AND full_bath >= ? ORDER BY acreage DESC", (1.5, 2)),
    ("show properties sold before March 1 2013", "SELECT * FROM housing WHERE (sale_date < ?)", ("2013-03-01",)),
    ("show properties where land use is single family' or 1=1", "SELECT * FROM housing WHERE LOWER(land_use) = LOWER(?)", ("single family",)),
    ("show expensive homes", "SELECT * FROM housing ORDER BY sale_price DESC", ()),
    ("cheap properties", "SELECT * FROM housing ORDER BY sale_price ASC", ()),
    ("homes with many rooms", "SELECT * FROM housing ORDER BY bedrooms DESC", ()),
    ("recent house sales", "SELECT * FROM housing ORDER BY sale_date DESC", ()),
]


@pytest.mark.parametrize("question, sql, parameters", GOLDEN)
def test_business_questions(business, question, sql, parameters):
    answer = business.parse(question)
    assert answer.success and (answer.sql.sql, answer.sql.parameters) == (sql, parameters)


@pytest.mark.parametrize("question, sql, parameters", PROPERTIES)
def test_property_questions(property_questions, question, sql, parameters):
    answer = property_questions.parse(question)
    assert answer.success and (answer.sql.sql, answer.sql.parameters) == (sql, parameters)


def test_refusals_and_clarifications(business):
    assert business.parse("drop customers").error.code == "FORBIDDEN_OPERATION"
    unclear = business.parse("show high-value customers")
    assert unclear.requires_clarification and unclear.error.code == "MISSING_THRESHOLD"
    assert business.parse("what is the weather").error.code == "UNSUPPORTED_QUERY"
    assert business.execute("show all customers").error.code == "NO_EXECUTOR"


def test_equal_questions_get_equal_plans(property_questions):
    plans = {repr(property_questions.parse("top 5 expensive homes").plan) for _ in range(20)}
    assert len(plans) == 1


def test_execution(spark, folder):
    from askframe.sources.tables import star_catalog

    engine = Engine(star_catalog(spark, folder), today=date(1998, 6, 1), timeout=60)
    answer = engine.execute("show top 3 customers by total spending")
    assert answer.success and len(answer.rows) == 3 and answer.execution_plan and answer.to_dict()["rows"]
    again = engine.execute_plan({"source": "orders", "select": [{"name": "o_orderkey"}], "order_by": [{"column": "o_orderkey"}], "limit": 1000}, max_rows=500)
    assert len(again.rows) == 100
    assert engine.execute_plan({"source": "nothing"}).error.code == "UNKNOWN_TABLE"
    assert engine.explain_schema_match("orders of a customer in a region")["candidates"]
    assert engine.retrieval_stats()["searches"] >= 1


def test_planner_payload():
    engine = Engine(Catalog.from_dict(BUSINESS), planner=lambda q, h: {"source": "orders", "select": [{"name": "amount"}], "confidence": 0.9})
    assert engine.parse("anything at all").plan.source == "orders"
    vague = Engine(Catalog.from_dict(BUSINESS), planner=lambda q, h: {"candidates": [{"confidence": 0.5, "plan": {"source": "orders"}}, {"confidence": 0.49, "plan": {"source": "customers"}}]})
    assert "planner" in vague.parse("show all orders").trace["parsers"]


def test_routing(spark):
    registry = RegistryEngine(demo_catalogs(spark), timeout=60)
    found = registry.execute("show all trips")
    assert found.dataset_id == "rides" and len(found.rows) == 3
    assert registry.parse("hello there").error.code == "AMBIGUOUS_DATASET"
    assert registry.execute("show all readings", dataset_id="weather").success


def test_contractions():
    assert normalize("Aren't they new? I can't say") == "are not they new i cannot say"
