"""Display text helpers against independently computed expectations."""

from __future__ import annotations

import datetime as dt
import urllib.parse
from decimal import Decimal as D

from conftest import AS_OF, day

from seatledger.functions import predicates as P
from seatledger.functions import text as X


def _es_money(x: D) -> str:
    """Reference rule written out in Python: '.' groups from five integer digits."""
    neg = x < 0
    whole, frac = f"{abs(x):.2f}".split(".")
    if len(whole) >= 5:
        parts = []
        while whole:
            parts.insert(0, whole[-3:])
            whole = whole[:-3]
        whole = ".".join(parts)
    return "$" + ("-" if neg else "") + whole + "," + frac


def test_money_text(spark):
    vals = [D("0"), D("5.5"), D("999.99"), D("1234.5"), D("9999.99"), D("10000"), D("12345.67"), D("1234567.89"), D("-1234.5"), D("-98765.43")]
    df = spark.createDataFrame([(v,) for v in vals], "x decimal(12,2)")
    got = [r[0] for r in df.select(X.money_text("x")).collect()]
    assert got == [_es_money(v) for v in vals]
    assert got[3] == "$1234,50" and got[6] == "$12.345,67"


def test_long_date_text(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 5),), (dt.date(1999, 12, 31),), (None,)], "d date")
    got = [r[0] for r in df.select(X.long_date_text("d")).collect()]
    assert got == ["05 de enero de 2000", "31 de diciembre de 1999", "Sin fecha"]


def test_expiry_badge(spark):
    dates = [None, day(-3), day(0), day(1), day(3), day(4)]
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    b = X.expiry_badge("d", AS_OF)
    got = [tuple(r) for r in df.select(b["status_class"], b["status_text"]).collect()]
    assert got == [
        ("no-date", "Sin fecha"),
        ("expired", "Venció hace 3 día(s)"),
        ("expired", "Vence hoy"),
        ("warning", "Vence en 1 día(s)"),
        ("warning", "Vence en 3 día(s)"),
        ("active", "Vence en 4 días"),
    ]


def test_uri_component_matches_uri_encoding(spark):
    texts = ["Hola *Ana*\n¡Gracias! 🤗", "a b+c~d'(e)f", "100% = ok; x&y/z?", "ÑandÚ — 📅"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.uri_component("t")).collect()]
    # encodeURIComponent leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are
    assert got == [urllib.parse.quote(t, safe="-_.!~*'()") for t in texts]


def test_phone_and_link(spark):
    df = spark.createDataFrame([("+54 (11) 1-2", "hi there")], "p string, m string")
    assert df.select(X.chat_link("p", "m")).collect()[0][0] == "https://wa.me/541112?text=hi%20there"


def test_parse_days():
    assert [P.parse_days(x) for x in (None, "", "0", 0, "abc", "30", "12x", 15, "-3")] == [7, 7, 7, 7, 7, 30, 12, 15, -3]


def test_date_prefix(spark):
    df = spark.createDataFrame([("2000-01-05T00:00:00.000Z",), ("bad",), (None,)], "s string")
    assert [r[0] for r in df.select(X.date_prefix("s")).collect()] == [dt.date(2000, 1, 5), None, None]
