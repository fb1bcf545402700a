from datetime import date, datetime
from decimal import Decimal

import pytest

from clearwell import functions as X


@pytest.mark.parametrize("expression, good, bad", [
    (X.is_email,
     ["user@example.com", "john.doe@domain.co.uk", "test+tag@test.org", "a@b.co", "User@Example.COM", " x@y.zz\t"],
     ["not-an-email", "@example.com", "user@", "user @example.com", "user..name@example.com", ".a@b.com", "a.@b.com",
      "a@.b.com", "a@b..com", "a@b@c.com", ""]),
    (X.is_phone,
     ["+34612345678", "34612345678", "+1-555-123-4567", "(555) 123-4567", "555.123.4567"],
     ["not-a-phone", "123", "abc-def-ghij", ""]),
    (X.is_url,
     ["https://example.com", "http://example.co.uk/path", "https://sub.example.com/path?query=value"],
     ["not-a-url", "www.example.com", "http://", "ftp://example.com", "http:// x"]),
    (X.is_date,
     ["2024-01-15", "15/01/2024", "01/15/2024", "15-01-2024", "2024/01/15", "01-15-2024", "1/2/2024"],
     ["not-a-date", "2024-13-01", "2024-01-32", "01-2024-15", "31/02/2024", "15.01.2024", "0000-01-01"]),
    (X.is_integer, ["123", "-456", "+5"], ["12.34", "abc", "", "1_000"]),
    (X.is_number, ["123.45", "123", "-456.78", ".5", "5.", "1e5", "nan"], ["abc", "1d", "1f", ""]),
    (X.has_special_chars, ["test@123", "hello#world"], ["test123", "hello_world", "María, José. a-b"]),
    (X.has_edge_spaces, [" test", "test ", " test ", "x\n", " x"], ["test", "a b"]),
    (X.has_sql_unsafe_chars, ["<a>", "a|b", "a\\b", "`", "~", '"'], ["abc", "a'b"]),
])
def test_accepts_and_rejects(texts, expression, good, bad):
    assert texts(expression, good) == [True] * len(good)
    assert texts(expression, bad) == [False] * len(bad)


def test_value_types(texts):
    cases = {
        "123": "Entero", "-456": "Entero", "123.45": "Flotante", ".5": "Flotante", "user@example.com": "Email",
        "+34612345678": "Teléfono", "2024-01-15": "Teléfono", "1/2/2024": "Fecha", "https://a.bc": "URL",
        "random text": "Texto", "": "Nulo", "   ": "Texto",
    }
    assert texts(X.value_type, list(cases)) == list(cases.values())
    assert texts(X.value_type, [None]) == ["Nulo"]


def test_numbers(texts):
    cases = {
        "$1,234.56": "1234.56", "€ 1.234,56": "1234.56", "(£2,000.00)": "-2000.00", "$1,250.50": "1250.50",
        "1.250,50": "1250.50", "(1,250.50)": "-1250.50", "abc1250xyz": None, "1,5": "1.5", "1,234,567": "1234567",
        "1,234,56": None, "1.234.567": None, "USD 5": "5", "$12,234.50": "12234.50", "n/d": None, "(-5)": "-5", "12,": "12",
    }
    assert texts(X.normalize_number, list(cases)) == list(cases.values())
    assert texts(lambda c: X.to_number(c, "decimal(10,2)"), ["(£2,000.00)"]) == [Decimal("-2000.00")]


def test_booleans(texts):
    assert texts(X.normalize_boolean, ["Sí", "verdadero", "N", "0", "quizas", " TRUE ", None]) == [
        True, True, False, False, None, True, None]


def test_dates(texts):
    day = date(2024, 1, 10)
    good = ["2024-01-10", "10/01/2024", "10-ene-24", "10 de enero de 2024", "10 enero 2024", "January 10, 2024",
            "10 JANUARY 2024", "10.01.2024", "20240110", "2024-01-10T08:30:00Z", "2024-01-10 08:30", "10/1/24", "Jan 10 2024"]
    assert texts(X.parse_date, good) == [day] * len(good)
    padded = ["10 enero 2024" + " " * 200, "\n" * 300 + "10/01/2024\t", "10" + " " * 40 + "de enero de 2024", "2024-01-10" + " " * 500]
    assert texts(X.parse_date, padded) == [day] * len(padded)
    assert texts(X.parse_date, ["x" * 100_000, "10 " * 10_000]) == [None, None]
    bad = ["2024-99-99", "31/02/2024", "hello", "", "2024", "2024-01", "10/13/14/2024", "99999999"]
    assert texts(X.parse_date, bad) == [None] * len(bad)
    assert texts(X.parse_date, ["12/13/2024", "01-15-2024", "1/2/70"]) == [date(2024, 12, 13), date(2024, 1, 15), date(1970, 2, 1)]
    assert texts(X.parse_timestamp, ["2024-01-10 08:30:05", "10/01/2024"]) == [
        datetime(2024, 1, 10, 8, 30, 5), datetime(2024, 1, 10)]


def test_date_formats(texts):
    cases = {
        "2024-01-15": "%Y-%m-%d", "15/01/2024": "%d/%m/%Y", "12/13/2024": "%m/%d/%Y", "15-01-2024": "%d-%m-%Y",
        "2024/01/15": "%Y/%m/%d", "15.01.2024": "%d.%m.%Y", "20240115": "%Y%m%d", "15 Jan 2024": "%d %b %Y",
        "15 January 2024": "%d %B %Y", "Jan 15, 2024": "%b %d, %Y", "January 15, 2024": "%B %d, %Y",
        "15 May 2024": "%d %b %Y", "01-15-2024": "<formato_no_estándar>", "10-ene-24": "<formato_no_estándar>", "x": None,
    }
    assert texts(X.date_format_label, list(cases)) == list(cases.values())


def test_ambiguity(texts):
    assert texts(X.is_ambiguous_date, ["03/04/2024", "12/13/2024", "01/02/2024", "2024-01-02", "a/b", "1-2"]) == [
        True, False, True, False, False, True]


def test_small_transforms(texts):
    assert texts(X.collapse_spaces, ["  a \t b  "]) == ["a b"]
    assert texts(lambda c: X.truncate(c, 3), ["abcd", "abc"]) == ["abc...", "abc"]
    assert texts(X.special_char_count, ["a b!c?", "ñ 1"]) == [2, 0]
    assert texts(lambda c: X.in_range(c, 0, 10), ["5", "11", "x", None, "10"]) == [True, False, False, False, True]


def test_long_texts_are_linear_and_whole(texts):
    spaces, letters = "a" + " " * 200_000 + "b", "a" * 200_000
    assert texts(X.has_edge_spaces, [spaces]) == [False]
    assert texts(X.is_email, [letters, letters + "@x.com"]) == [False, True]
    assert texts(X.has_special_chars, [letters + "#"]) == [True]
    assert texts(X.parse_date, [letters]) == [None]


def test_value_key_keeps_values_apart(texts):
    long_a, long_b = "x" * 100, "x" * 99 + "y"
    keys = texts(X.value_key, ["short", long_a, long_b, long_a])
    assert keys[0] == "short" and keys[1] == keys[3] != keys[2] and len(keys[1]) == 71
    # The digest written out is itself long, so it cannot be mistaken for the text.
    assert texts(X.value_key, [keys[1]])[0] != keys[1]


@pytest.mark.parametrize("name, hint", [
    ("fecha_registro", "Fecha/Hora"), ("correo", "Email"), ("TELEFONO", "Teléfono"), ("website", "URL"), ("id", "Identificador"),
    ("id_cliente", "Identificador"), ("customer_id", "Identificador"), ("codigo", "Identificador"), ("nombre", None), ("valid", None),
])
def test_name_hints(spark, name, hint):
    assert X.name_hint(name) == hint
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(X.name_hint_column("n")).first()[0] == hint
