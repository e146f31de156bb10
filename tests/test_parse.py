import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hedra.functions import parse

CASES = [
    ("", "auto", "missing", None), (None, "auto", "missing", None), (" Sem Valor ", "auto", "missing", None), (" - ", "auto", "missing", None),
    ("1.234", "auto", "ambiguous", None), ("1,234", "auto", "ambiguous", None), ("1,5", "auto", "parsed", 1.5), ("1.2345", "auto", "parsed", 1.2345),
    ("1.234.567", "auto", "parsed", 1234567.0), ("1,234,56", "auto", "malformed", None), (",5", "auto", "malformed", None), ("5.", "auto", "malformed", None),
    ("1.234,56", "auto", "parsed", 1234.56), ("1,234.56", "auto", "parsed", 1234.56), ("1.23,456.7", "auto", "malformed", None), ("R$ 1.234,56", "auto", "parsed", 1234.56),
    ("12 345,6", "auto", "parsed", 12345.6), ("-3,5 EUR", "auto", "parsed", -3.5), ("+", "auto", "malformed", None), ("-inf", "auto", "non_finite", None), ("Infinity", "auto", "non_finite", None),
    ("1e3", "auto", "parsed", 1000.0), ("1.5E-2", "auto", "parsed", 0.015), ("1e999", "auto", "non_finite", None), ("1d", "auto", "non_numeric", None), ("abc", "auto", "non_numeric", None),
    ("1.234", "pt-BR", "parsed", 1234.0), ("1,234", "pt-BR", "parsed", 1.234), ("1.23", "pt-BR", "parsed", 1.23), ("1.2345", "pt-BR", "malformed", None), ("1.234,5", "pt-BR", "parsed", 1234.5),
    ("1,2,3", "pt-BR", "malformed", None), ("1,234.56", "en-US", "parsed", 1234.56), ("1,234", "en-US", "parsed", 1234.0), ("1,23", "en-US", "parsed", 1.23), ("12,34.5", "en-US", "malformed", None),
    ("1", "fr-FR", "malformed", None),
]


def test_decision_table(spark):
    for locale in ("auto", "pt-BR", "en-US", "fr-FR"):
        own = [c for c in CASES if c[1] == locale]
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(own)], "i int, t string")
        got = {r["i"]: (r["p"]["status"], r["p"]["value"]) for r in df.select("i", parse.parse_number(F.col("t"), locale).alias("p")).collect()}
        for i, (text, _, status, value) in enumerate(own):
            assert got[i][0] == status, (text, locale, got[i])
            assert got[i][1] == pytest.approx(value) if value is not None else got[i][1] is None, text


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(0, 10**9), min_size=1, max_size=30))
def test_round_trip(spark, values):
    frame = pd.DataFrame({"v": values, "en": [f"{v / 100:,.2f}" for v in values]})
    df = spark.createDataFrame(frame).withColumn("pt", F.translate("en", ",.", ".,"))
    out = df.select("v", parse.to_number(F.col("en"), "en-US").alias("a"), parse.to_number(F.col("pt"), "pt-BR").alias("b"), parse.to_number(F.concat(F.lit("R$ "), "pt"), "auto").alias("c")).collect()
    assert all(r["a"] == r["b"] == r["c"] == pytest.approx(r["v"] / 100) for r in out)


def test_shapes(spark):
    df = spark.createDataFrame([("2024-02-30", "=1+1"), ("2024-02-29", "​@x"), ("29/02/2024", "plain"), (None, None)], "d string, c string")
    got = df.select(parse.iso_date(F.col("d")).alias("iso"), parse.is_date_shaped(F.col("d")).alias("shaped"), parse.neutral_cell(F.col("c")).alias("cell"), parse.to_timestamp(F.col("d")).alias("ts")).collect()
    assert [r["iso"] is not None for r in got] == [False, True, False, False]
    assert [r["shaped"] for r in got] == [True, True, True, None]
    assert [r["cell"] for r in got] == ["'=1+1", "'​@x", "plain", ""]
    assert got[2]["ts"].day == 29 and got[0]["ts"] is None
    text = spark.createDataFrame([("CPF 123.456.789-09, a.b@c.org " + "0af3" * 8,)], "t string").select(parse.redact(F.col("t")).alias("t")).first()["t"]
    assert text == "CPF [cpf], [mail] [token]"


def test_usual_cells_are_read_as_all_others(spark):
    """A blank at the end sends a text the long way, which says the same of it."""
    rng = random.Random(4)
    atoms = [*"0123456789.,+-eE", "R$", "usd ", "EUR", " ", "12", "345", "6.789", "1,5", "abc", "inf", "na", "é", "n/a", "000"]
    texts = ["", "12", "1.234", "1,234.5", "R$ 1.234,56", "r$12,5", "usd", "USDinf", "infeur", "words", "none", "Infinity", "...", "1.2.3", "07", "€ 1", "1 €"] + ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for locale in ("auto", "pt-BR", "en-US", "other"):
        both = df.select("x", parse.parse_number(F.col("x"), locale).alias("a"), parse.parse_number(F.concat("x", F.lit(" ")), locale).alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
    # and without a function of higher order
    plan = df.select(parse.parse_number(F.col("x"), "pt-BR")["status"].alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("transform(")
