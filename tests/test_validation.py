import pytest

from clearwell.operators import rules as U
from clearwell.operators import validation as V
from conftest import by_name


def test_by_name_and_by_content(spark):
    df = spark.createDataFrame([
        ("user1@example.com", "john.doe@mail.com"), ("invalid-email", "jane.smith@domain.co.uk"),
        ("user2@test.org", "not-an-email"), ("user3@company.com", "mary@business.com"), (None, None),
    ], "email_address string, contact_info string")
    got = by_name(V.validate_email(df))
    assert (got["email_address"]["valid_count"], got["email_address"]["invalid_count"]) == (3, 1)
    assert got["contact_info"]["detected_by_content"] and got["contact_info"]["invalid_percent"] == 25
    assert all(r["is_problematic"] for r in got.values())


def test_phone_by_name_on_numbers_is_invalid(spark):
    df = spark.createDataFrame([(34612345678,), (612345678,)], "telefono bigint")
    assert V.validate_phone(df).first()["invalid_count"] == 2


def test_dates_count_as_phones_first(spark):
    df = spark.createDataFrame([("2024-01-15",), ("2024-01-16",)], "x string")
    assert V.detect_content_types(df).first()["content_type"] == "phone"
    dates_first = V.detect_content_types(df, priority=("email", "date", "phone", "url", "numeric"))
    assert dates_first.first()["content_type"] == "date"


def test_content_of_a_sample(spark):
    df = spark.createDataFrame([(i, "a@b.cc" if i < 10 else "x") for i in range(100)], "i int, v string")
    assert V.detect_content_types(df, "v").first()["content_type"] == "other"
    assert V.detect_content_types(df, "v", sample=10, row_key="i").first()["content_type"] == "email"


def test_date_consistency_boundary(spark):
    rows = [(f"2024-01-{d:02d}",) for d in range(1, 20)] + [("15/01/2024",)]
    row = V.validate_date(spark.createDataFrame(rows, "fecha string")).first()
    assert row["format_consistency"] == pytest.approx(0.95) and not row["is_problematic"]
    assert row["most_common_format"] == "%Y-%m-%d" and row["formats"] == 2


def test_mixed_dates(spark):
    df = spark.createDataFrame([("2024-01-15",), ("15/01/2024",), ("01-15-2024",), ("15.01.2024",), ("nope",)], "fecha_registro string")
    row = V.validate_date(df).first()
    assert (row["valid_count"], row["invalid_count"], row["formats"]) == (4, 1, 4) and row["is_problematic"]


def test_date_column_without_values_is_no_problem(spark):
    df = spark.createDataFrame([(None,)], "fecha string")
    assert V.validate_date(df).count() == 0


def test_native_dates_are_valid(spark):
    df = spark.sql("SELECT date'2024-01-02' AS fecha, timestamp'2024-01-02 10:00:00' AS created_time")
    got = by_name(V.validate_date(df))
    assert got["fecha"]["most_common_format"] == "%Y-%m-%d" and got["created_time"]["invalid_count"] == 0
    assert got["fecha"]["ambiguous_count"] == 0


def test_ambiguous_dates(spark):
    df = spark.createDataFrame([(1, "03/04/2024"), (2, "12/13/2024"), (3, "01/02/2024")], "i int, fecha string")
    assert [r["i"] for r in V.ambiguous_dates(df, "i").orderBy("i").collect()] == [1, 3]


def test_examples_are_the_first_and_short(spark):
    df = spark.createDataFrame([(i, "x" * 80 if i % 2 else "a@b.cc") for i in range(40)], "i int, email string")
    got = V.invalid_examples(df, "email", "i", "email").orderBy("n").collect()
    assert [r["i"] for r in got] == [1, 3, 5, 7, 9] and len(got[0]["value"]) == 50


def test_numeric_and_text(spark):
    df = spark.createDataFrame([(30, -1.0, " a#"), (-5, 0.0, "b"), (None, float("nan"), "c" * 501)], "edad int, x double, t string")
    got = by_name(V.validate_numeric(df))
    assert got["edad"]["is_problematic"] and got["edad"]["negative_count"] == 1
    assert not got["x"]["is_problematic"] and got["x"]["zero_count"] == 1 and got["x"]["max"] == 0
    row = V.validate_text(df).first()
    assert (row["special_chars_count"], row["edge_spaces_count"], row["long_values_count"]) == (1, 1, 1)


def test_domain_rules(spark):
    df = spark.createDataFrame(
        [(25, "IT"), (150, "Ventas"), (30, None), (-5, "HR"), (45, "Sales"), (60, "IT")], "age bigint, department string")
    got = {(r["domain"], r["rule"]): r for r in U.check_rules(df, U.domain_rules()).collect()}
    assert got["healthcare", "age"]["violations"] == 2
    assert got["hr", "department"]["violations"] == 2
    assert got["hr", "age"]["violations"] == 2
    assert len(U.DOMAIN_RULES) == 23


def test_rule_percent_and_matching(spark):
    df = spark.createDataFrame([(-1 if i < 2 else i, i) for i in range(10)], "price bigint, page_id int")
    assert U.check_rules(df, U.domain_rules("ecommerce")).first()["violation_percent"] == 20.0
    age = U.domain_rules("healthcare")
    assert U.check_rules(df, age).count() == 1
    assert U.check_rules(df, age, match="token").count() == 0


def test_rule_patterns_and_examples(spark):
    df = spark.createDataFrame([(i, f"{i:05d}" if i % 2 else "x") for i in range(40)] + [(99, None)], "i int, zip_code string")
    rules = U.rules_from_config({"gov": {"rules": {"zip_code": {"type": "text", "pattern": "^[0-9]{5}$"}}}})
    assert U.check_rules(df, rules).first()["violations"] == 20
    assert [r["i"] for r in U.rule_examples(df, rules, "i").orderBy("n").collect()] == list(range(0, 20, 2))


def test_allowed_table(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    row = U.check_allowed(df, "v", spark.createDataFrame([("a",), (None,)], "ok string")).first()
    assert (row["rows"], row["violations"]) == (4, 2)
