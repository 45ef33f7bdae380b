import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions import text as T


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_element_item(spark):
    cases = {"33.90.30.34": "30.34", "33.90.30/34": "30.34", "339030/34": "30.34", "339039": "39", "30.34": "30.34", "30/34": "30.34", "39.17": "39.17", "30": "30", "339000": None, "33.90.30.34\n": "30.34", " 30 / 34 ": "30.34", "abc": None, "": None, "33903900": "39", "33.90.39": "39", "00": None, "30.00": None, None: None}
    assert values(spark, list(cases), S.element_item) == list(cases.values())


def test_element_item_loose(spark):
    cases = {"33.90.30.34": "30.34", "33.90.39/17": "39.17", "33.90.39.17": "39.17", "30.24": "30.24", "30/04": "30.04", "39.17": "39.17", "33.01": "33.01", "4490.52.08": "52.08", "33.9\n0.39/\n24": "39.24", "xyz": "xyz", "": None}
    assert values(spark, list(cases), S.element_item_loose) == list(cases.values())


def test_element_sub(spark):
    cases = {"39.17": (39, 17), "33.90.39/24": (39, 24), "33.90.30": (30, None), "339030": (30, None), "30/17": (30, 17), "339039/24": (39, 24), "x": (None, None), "": (None, None)}
    assert [tuple(r) for r in values(spark, list(cases), S.element_sub)] == list(cases.values())


def test_money(spark):
    assert values(spark, ["1.999,80", "0,30", "x", "", None, "12"], S.money_strict) == [Decimal("1999.80"), Decimal("0.30"), None, None, None, Decimal("12")]
    assert values(spark, ["R$ 1.234,56", "38.99", "1.500", "r$7", "1.2.3"], S.money) == [Decimal("1234.56"), Decimal("38.99"), Decimal("1500"), Decimal("7"), None]
    assert values(spark, ["6.666", "2,5", "1.25"], S.quantity) == [Decimal("6666"), Decimal("2.5"), Decimal("1.25")]


def test_format_is_the_inverse_of_parse(spark):
    df = spark.range(2000).select((F.col("id") * 977 / 100).cast("decimal(18,2)").alias("x"))
    assert df.filter(S.money_strict(S.format_amount(F.col("x"))) != F.col("x")).count() == 0


def test_flexible_date(spark):
    d = datetime.date
    cases = {"27/02/2026": d(2026, 2, 27), "27/FEV/2026": d(2026, 2, 27), "9 de fevereiro de 2026": d(2026, 2, 9), "1 de março de 2025": d(2025, 3, 1), "27 FEV 26": d(2026, 2, 27), "27 JAN 2026": d(2026, 1, 27), "30JUN26": d(2026, 6, 30), "18JUN2025": d(2025, 6, 18), "11/01/26": d(2026, 1, 11), "31/02/2026": None, "30 DIAS": None, "": None}
    assert values(spark, list(cases), S.flexible_date) == list(cases.values())


def test_numbers(spark):
    assert values(spark, ["9014/2024", "004/2025", "90004/2025", "4/2025", "x"], S.bid_number) == ["90014/2024", "90004/2025", "90004/2025", "90004/2025", "x"]
    assert values(spark, ["59/2024", "059/2024", "1059/2024", "x"], S.contract_number) == ["059/2024", "059/2024", "1059/2024", "x"]
    assert values(spark, ["12.345.678/0001-90", "", None], S.tax_id) == ["12345678000190", None, None]


def test_short_object(spark):
    assert values(spark, ["Aquisição de Material Esportivo (SFPC)", "Serviço de Manutenção", "a b c d e f g h"], S.short_object) == ["AQS DE MAT ESPORTIVO", "SV DE MNT", "A B C D E F"]


def test_clean_description(spark):
    assert values(spark, ["CHAPA | DE [AÇO] R$ 10,00 12345", "ab"], S.clean_description) == ["CHAPA DE AÇO", None]


def test_template_tokens(spark):
    got = values(spark, ["X, 2026NC000343, ND 33.90.30, PI E6SUPLJA3RR, PE 90004/2025, UASG 160142 (GER)."], S.template_tokens)[0]
    assert (got.nc, got.nd, got.pi, got.pe, got.uasg, got.ugr) == ("2026NC000343", "339030", "E6SUPLJA3RR", "90004/2025", "160142", None)


def test_rebuilt_text(spark):
    df = spark.createDataFrame([("ab", [["l", "o", None, "n", "g"], [None, None]]), ("x" * 101, [["y"] * 300]), (None, None)], "t string, rows array<array<string>>")
    assert [r.y for r in df.select(S.rebuilt_text(F.col("t"), F.col("rows")).alias("y")).collect()] == ["lo ng", "x" * 101, ""]


def test_text_helpers(spark):
    assert values(spark, ["a1 b2 a1", ""], lambda c: T.find_distinct(c, "([a-z][0-9])")) == [["a1", "b2"], []]
    assert values(spark, ["xx 10 - Aa yy 20 - Bb"], lambda c: T.segments(c, r"\b[0-9]+ - ")) == [["10 - Aa yy ", "20 - Bb"]]
    assert values(spark, ["abcKEYdef", "none"], lambda c: T.around(c, F.lit("KEY"), 2, 4)) == ["bcKEYd", None]
    assert values(spark, ["SITUAÇÃO x", "situação y", "z"], lambda c: T.find(c, r"Situação (\w)")) == ["x", "y", None]


@pytest.mark.parametrize("days,status,label", [(-4, "bloqueio", "4 dias vencida"), (0, "ressalva", "vence hoje"), (15, "ressalva", "15 dias"), (16, "conforme", "16 dias")])
def test_expiry(spark, days, status, label):
    row = spark.range(1).select(S.expiry_status(F.lit(days)).alias("s"), S.expiry_label(F.lit(days)).alias("l")).first()
    assert (row.s, row.l) == (status, label)


def test_common_amounts_take_the_short_way_to_the_same_value(spark):
    texts = ["R$ 1.234,56", "R$1,5", "1.234,56", "r$ 2,00", "R$  3,00", "1.234", "12.5", "1,2,3", ".,5", "", None, "R$ x", " 7,00 "]
    got = [str(r[0]) if r[0] is not None else None for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.money(F.col("t"))).collect()]
    assert got == ["1234.56", "1.50", "1234.56", "2.00", "3.00", "1234.00", "12.50", None, "0.50", None, None, None, "7.00"]
    pairs = [("30.24", "30.24"), ("30.00", None), ("30/24", "30.24"), (" 30.24", "30.24"), ("339030", "30"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string").orderBy("i").select(S.element_item(F.col("t"))).collect()] == [w for _, w in pairs]
    assert [str(r[0]) for r in spark.createDataFrame([(0, "17"), (1, "1.234"), (2, "1,5")], "i int, t string").orderBy("i").select(S.quantity(F.col("t"))).collect()] == ["17.0000", "1234.0000", "1.5000"]
