import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clearwell.operators import cleaning as C
from clearwell.operators import filters as L
from clearwell.operators import semantics as M
from clearwell.sources import sinks


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([
        (1, "$1,234.56", "10/01/2024", "10/02/2024", "Sí", " A@B.COM "),
        (2, "(2.000,10)", "2024-99-99", "2024-01-01", "quizas", "bad"),
        (3, "n/d", "10 de enero de 2024", "2023-01-01", "no", None),
        (4, "  ", None, "2024-01-01", None, ""),
    ], "id int, importe string, fecha_inicio string, fecha_fin string, activo string, email string")


def kinds(df, **overrides):
    return {t.name: t.semantic for t in M.column_types(df, overrides or None)}


def test_semantic_types(spark, orders):
    assert kinds(orders) == {
        "id": "Text", "importe": "Float", "fecha_inicio": "Date", "fecha_fin": "Date", "activo": "Text", "email": "Email"}
    df = spark.createDataFrame([("001", "A1", "true", "5", "2024-01-01 10:00:00", "+34612345678")],
                               "folio_pedido string, sku string, activo string, n string, cuando string, telefono string")
    assert kinds(df) == {"folio_pedido": "Text", "sku": "Text", "activo": "Boolean", "n": "Integer", "cuando": "DateTime", "telefono": "Phone"}
    empty = spark.createDataFrame([(None, None)], "x string, fecha string")
    assert kinds(empty) == {"x": "Text", "fecha": "Date"}


def test_clean_and_quarantine(orders):
    clean, bad = C.clean_and_quarantine(orders, overrides={"activo": M.BOOLEAN})
    rows = {r["id"]: r for r in clean.collect()}
    assert set(rows) == {1, 4}
    assert rows[1]["importe"] == Decimal("1234.56") and rows[1]["fecha_inicio"] == date(2024, 1, 10)
    assert rows[1]["activo"] is True and rows[1]["email"] == "a@b.com" and rows[4]["importe"] is None
    found = {(json.loads(r["row_json"])["id"], r["column_name"], r["category"]) for r in bad.collect()}
    assert found == {
        (2, "fecha_inicio", "BAD_DATE"), (2, "activo", "BAD_BOOLEAN"), (2, "email", "BAD_EMAIL"),
        (3, "importe", "BAD_NUMBER"), (3, "fecha_fin", "BAD_DATE_RANGE")}
    assert json.loads(bad.where("category = 'BAD_NUMBER'").first()["row_json"])["email"] is None
    # Every row is in exactly one of the outputs.
    assert clean.count() + bad.select("row_json").distinct().count() == orders.count()


def test_integers_of_any_writing(spark):
    df = spark.createDataFrame([("1.234,00",), ("7",), ("7.5",), ("99999999999999999999999",)], "n string")
    types = [M.ColumnType("n", M.INTEGER)]
    assert [r["n"] for r in C.clean_rows(df, types).collect()] == [1234, 7]
    assert C.quarantine_rows(df, types).count() == 2


def test_leading_zeros_stay(spark):
    df = spark.createDataFrame([("0012", "00ab")], "folio_pedido string, sku string")
    assert tuple(C.clean(df).first()) == ("0012", "00ab")


def test_clean_dedupes_and_drops_sparse_rows(spark):
    df = spark.createDataFrame(
        [("Ana", "$5.00", "A@x.com"), ("Ana", "$5.00", "A@x.com"), (" Luis ", "7", "b@x.com"), ("Eva", None, None)],
        "`customer's name` string, monto string, email string")
    sparse = df.union(spark.createDataFrame([("Z", None, None)] * 3, df.schema))
    got = C.clean(sparse)
    assert {r["customer's name"] for r in got.collect()} == {"Ana", "Luis"}
    assert {r["email"] for r in got.collect()} == {"a@x.com", "b@x.com"}


def test_decimal_sizes(spark):
    df = spark.createDataFrame([("1234.5678",), ("(12)",), ("x",)], "v string")
    row = M.decimal_types(df, "v").first()
    assert (row["precision"], row["scale"]) == (10, 4)
    big = spark.createDataFrame([("123456789012.5",)], "v string")
    assert tuple(M.decimal_types(big, "v").first())[1:] == (14, 2)


def test_dominant_format(spark):
    df = spark.createDataFrame([("10/01/2024",), ("11/01/2024",), ("2024-01-01",)], "f string")
    assert tuple(M.dominant_date_format(df, "f").first()) == ("f", "%d/%m/%Y", 2)


def test_surrogate_keys(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r["k"] for r in C.with_surrogate_key(df, "k", dense=True).collect()) == list(range(1, 101))
    assert C.with_surrogate_key(df, "k").select("k").distinct().count() == 100


def test_dense_keys_lose_no_row_after_a_shuffle(spark):
    df = spark.range(20_000).selectExpr("id", "id % 97 AS `a k`", "repeat('x', cast(id % 50 as int)) AS t").repartition(64, "a k")
    keyed = C.with_surrogate_key(df, "n", dense=True)
    assert keyed.columns == ["id", "a k", "t", "n"]
    row = keyed.agg(F.count("id"), F.countDistinct("id"), F.countDistinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(row) == (20_000, 20_000, 20_000, 1, 20_000)


def test_numbers_are_not_rounded(spark):
    df = spark.createDataFrame([("1.00000000001", "1.123456789012"), ("2.000", "1e3"), ("9223372036854775808", "5"), ("-7", "x")], "i string, f string")
    types = M.column_types(df, {"i": M.INTEGER, "f": M.FLOAT})
    clean = [(r["i"], str(r["f"])) for r in C.clean_rows(df, [*types[:1], M.ColumnType("f", M.TEXT)]).collect()]
    assert sorted(c[0] for c in clean) == [-7, 2]
    assert types[1].scale == 12
    assert {r["original_value"] for r in C.quarantine_rows(df, types).collect()} >= {"1.00000000001", "9223372036854775808", "x"}
    narrow = [types[0], M.ColumnType("f", M.FLOAT, 20, 10)]
    assert "1.123456789012" in {r["original_value"] for r in C.quarantine_rows(df, narrow).collect()}


def test_checks_and_keys(spark, orders):
    clean, bad = C.clean_and_quarantine(orders)
    checks = {(r["check"], r["subject"]): r["value"] for r in C.post_load_checks(clean, bad).collect()}
    assert checks["clean_rows", "table"] == clean.count() and checks["quarantine_rows", "table"] == bad.count()
    assert C.repeated_keys(orders.union(orders)).count() == 4
    assert C.business_keys(spark.createDataFrame([(1, 2, 3)], "order_id int, sku int, x int")) == ["order_id", "sku"]


def test_filters(spark):
    df = spark.createDataFrame([(1, " a<b "), (2, None), (3, " ")], "i int, t string")
    ids = lambda d: [r["i"] for r in d.orderBy("i").collect()]
    assert ids(L.drop_nulls(df, "t")) == [1, 3] and ids(L.drop_blanks(df, "t")) == [1]
    assert ids(L.drop_unsafe_chars(df, "t")) == [2, 3] and ids(L.complete_rows(df)) == [1, 3]
    assert L.trim_texts(L.remove_unsafe_chars(df)).where("i = 1").first()["t"] == "ab"
    assert L.drop_columns(df, ["t"]).columns == ["i"]


def test_sinks(spark, orders, tmp_path):
    clean, bad = C.clean_and_quarantine(orders)
    a, b = str(tmp_path / "clean"), str(tmp_path / "bad")
    sinks.write_pair(clean, bad, a, b)
    sinks.write_pair(clean, bad, a, b, "append")
    assert spark.read.parquet(a).count() == 2 * clean.count()
    sinks.write_pair(clean, bad, a, b, "REPLACE")
    assert spark.read.parquet(b).count() == bad.count()
    with pytest.raises(ValueError):
        sinks.load_mode("MERGE")
