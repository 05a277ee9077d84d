import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from salesmart.config import SalesConfig
from salesmart.operators import quality

ORDER = ["line"]


def ids(df):
    return sorted(row.order_id for row in df.collect())


def report(df):
    return {
        row.rule: (row.n, row.message)
        for row in quality.issues(quality.tally(quality.judge(df, ORDER))).collect()
    }


def test_required_columns_are_all_named(raw):
    with pytest.raises(ValueError, match=r"\['product', 'region'\]"):
        quality.validate(raw({}).drop("region", "product"), ORDER)


def test_invalid_first_copy_hides_a_valid_later_one(raw):
    df = raw({"sales": -1.0}, {}, {"order_id": "B"})
    assert ids(quality.validate(df, ORDER)) == ["B"]


def test_missing_ids_equal_one_another(raw):
    df = raw({"order_id": None}, {"order_id": None}, {"order_id": None})
    assert quality.keep_first(df, ORDER).count() == 1
    assert report(df)["duplicate_order_id"] == (2, "Dropped 2 duplicate order_ids")


def test_first_is_by_order_whatever_the_partitions(raw):
    df = raw(*[{"product": f"p{n}"} for n in range(50)]).repartition(7)
    for kept in (quality.keep_first(df, ORDER), quality.keep_first_counted(df, ORDER)):
        assert [row["product"] for row in kept.collect()] == ["p0"]


def test_each_rule(raw):
    df = raw(
        {"order_id": "ok"},
        {"order_id": "null", "customer_id": None},
        {"order_id": "nan", "profit": math.nan},
        {"order_id": "neg", "quantity": 0.0},
        {"order_id": "loss", "profit": -3.0},
        {"order_id": "cat", "category": "books"},
        {"order_id": "reg", "region": "North "},
        {"order_id": "date", "date": "2024-02-30"},
    )
    assert ids(quality.validate(df, ORDER)) == ["loss", "ok"]
    verdicts = {row.order_id: row[quality.VERDICT] for row in quality.judge(df, ORDER).collect()}
    assert verdicts == {
        "ok": "clean", "loss": "clean", "null": "missing_value", "nan": "missing_value",
        "neg": "non_positive", "cat": "unknown_category", "reg": "unknown_region",
        "date": "bad_date",
    }


def test_text_that_is_no_number_counts_as_missing(raw, spark):
    df = raw({"order_id": "x"}, {"order_id": "y"})
    df = df.selectExpr("* EXCEPT (sales)", "IF(order_id = 'x', 'ten', '10') AS sales")
    assert ids(quality.validate(df, ORDER)) == ["y"]


def test_region_count_includes_rows_of_the_category_rule(raw):
    df = raw(
        {"order_id": "both", "category": "Toys", "region": "Moon"},
        {"order_id": "region", "region": "Moon"},
        {"order_id": "early", "region": "Moon", "sales": 0.0},
    )
    got = report(df)
    assert got["unknown_category"][0] == 1
    assert got["unknown_region"] == (2, "Dropped 2 unknown regions")


def test_null_message_and_profile(raw):
    df = raw(
        {"order_id": "a", "customer_id": None, "region": None},
        {"order_id": "b", "customer_id": None},
        {"order_id": "c"},
    )
    assert report(df) == {
        "missing_value": (2, "Nulls found: {'customer_id': 2, 'region': 1}")
    }
    profile = quality.null_profile(quality.keep_first(df, ORDER))
    assert {tuple(row) for row in profile.collect()} == {("customer_id", 2), ("region", 1)}


def test_clean_input_reports_nothing(raw):
    df = raw({"order_id": "a"}, {"order_id": "b"})
    assert report(df) == {}
    totals = quality.row_totals(quality.tally(quality.judge(df, ORDER))).first()
    assert tuple(totals) == (2, 0, 2)


def test_empty_input(raw):
    df = raw({}).limit(0)
    totals = quality.row_totals(quality.tally(quality.judge(df, ORDER))).first()
    assert tuple(totals) == (0, 0, 0)


def test_counted_rows_keep_their_columns_in_order(raw):
    df = raw({}, {}, {"order_id": "B"}).repartition(3)
    once = quality.keep_first_counted(df, ORDER)
    assert once.columns == [*df.columns, quality.COPIES]
    assert {(row.order_id, row[quality.COPIES]) for row in once.collect()} == {("A", 2), ("B", 1)}


def test_extra_columns_pass_through(raw):
    df = raw({}).selectExpr("*", "'note' AS remark")
    assert quality.validate(df, ORDER).first().remark == "note"


def test_duplicates_are_cut_before_the_shuffle(raw):
    plan = quality.keep_first(raw({}), ORDER)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "row_number(), 1, Partial" in plan[exchange:]


choice = st.fixed_dictionaries(
    {
        "order_id": st.sampled_from(["A", "B", "C", "D", None]),
        "customer_id": st.sampled_from(["c1", "c2", None]),
        "sales": st.sampled_from([10.0, 0.0, -2.0, math.nan]),
        "category": st.sampled_from(["Books", "Sports", "Toys"]),
        "region": st.sampled_from(["North", "East", "Moon"]),
        "date": st.sampled_from(["2024-01-05", "2023-12-31", "soon", None]),
    }
)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(choice, min_size=1, max_size=25))
def test_chain_and_report_agree_with_plain_python(raw, rows):
    """Brute force of the same rules over a list."""
    config = SalesConfig()
    df = raw(*rows).repartition(3)
    seen, firsts = set(), []
    for line, row in enumerate(rows):
        if row["order_id"] not in seen:
            seen.add(row["order_id"])
            firsts.append((line, row))

    def missing(row):
        return any(value is None or value != value for value in row.values())

    complete = [(n, row) for n, row in firsts if not missing(row)]
    positive = [(n, row) for n, row in complete if row["sales"] > 0]
    known = [(n, row) for n, row in positive if row["category"] in config.categories]
    placed = [(n, row) for n, row in known if row["region"] in config.regions]
    clean = [(n, row) for n, row in placed if row["date"] != "soon"]
    counts = {
        "duplicate_order_id": len(rows) - len(firsts),
        "missing_value": len(firsts) - len(complete),
        "non_positive": len(complete) - len(positive),
        "unknown_category": len(positive) - len(known),
        "unknown_region": sum(row["region"] not in config.regions for _, row in positive),
        "bad_date": len(placed) - len(clean),
    }
    got = sorted(row.line for row in quality.validate(df, ORDER).collect())
    assert got == [n for n, _ in clean]
    judged = quality.clean_rows(quality.judge(df, ORDER))
    assert sorted(row.line for row in judged.collect()) == got
    assert {rule: n for rule, (n, _) in report(df).items()} == {
        rule: n for rule, n in counts.items() if n
    }
