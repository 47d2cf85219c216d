import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from terrapulse.functions import text


def python_slug(value: str) -> str:
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")


def test_clean_turns_markers_and_blanks_into_null(values):
    assert values(text.clean, "***", None, "", "   ", " *** ", "\xa0", "  A B\t") == [
        None, None, None, None, None, None, "A B",
    ]


def test_iso_date(values):
    assert values(
        text.iso_date, "17/11/2009", "3/4/2016", "40/07/2016", "29/02/2015", "29/02/2016", "***", "2009-11-17", "07/08/16", " 30/06/1998 "
    ) == ["2009-11-17", "2016-04-03", None, None, "2016-02-29", None, None, None, "1998-06-30"]


def test_activity_code(values):
    assert values(
        text.activity_code,
        "A.01.2.3-4/05-06", "U.99.8.7-6/54-32", " J.62.0.9-1/00-00\xa0", "7-31.40.12", "V.62.0.9-1/00-00",
        None, "", "no code", "J.62.0.9-1/00-0", "j.62.0.9-1/00-00",
    ) == ["0123405", "9987654", "6209100", None, None, None, None, None, None, None]


NAMES = [
    "TATUQUARA", "Água Verde", "São Braz", "LINDÓIA", "Alto da XV", "  Jardim  das Américas ", "Nº 3 ½", "Ærø ß",
    "épico", "ﬁm", "Ǆ", "¼ de ²", "Ｗｉｄｅ", "東京 A", "---", "", "Ĳssel",
    "N№ 5", "a…b", "3㎏", "Ⅷ rua", "𝐀𝟗 𝒷", "e\u0301 ﷺ x",
]


def test_slug_equals_unicode_decomposition(values):
    assert values(text.slug, *NAMES) == [python_slug(n) for n in NAMES]


def test_slug_of_every_character(spark):
    chars = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    df = spark.createDataFrame([(c, f"a{c}b") for c in chars], "c string, x string")
    found = {r["c"]: r["s"] for r in df.select("c", text.slug("x").alias("s")).collect()}
    assert found == {c: python_slug(f"a{c}b") for c in chars}


def test_display_texts(spark):
    df = spark.createDataFrame(
        [("R. X", "10", "CENTRO"), ("R. X", None, "CENTRO"), (None, None, "CENTRO"), ("R. X", "1", None)],
        "a string, b string, c string",
    )
    got = [r[0] for r in df.select(text.display_address("a", "b", "c")).collect()]
    assert got == ["R. X, 10 - CENTRO", "R. X - CENTRO", " - CENTRO", "R. X, 1"]


@pytest.mark.parametrize(
    ("parts", "expected"),
    [
        (("AV. DAS TORRES", "00471", "GUABIROTUBA", "81540000"), "AV. DAS TORRES, 471, GUABIROTUBA, 81540-000, Curitiba, PR, Brasil"),
        (("R. X", None, None, None), "R. X, Curitiba, PR, Brasil"),
        ((" R. X ", "  ", "", "8101"), "R. X, 8101, Curitiba, PR, Brasil"),
        (("R. X", "000", None, None), "R. X, 0, Curitiba, PR, Brasil"),
        (("R. X", "12A", None, "81010-120"), "R. X, 12A, 81010-120, Curitiba, PR, Brasil"),
    ],
)
def test_geocoding_address(spark, parts, expected):
    df = spark.createDataFrame([parts], "a string, b string, c string, d string")
    assert df.select(text.geocoding_address("a", "b", "c", "d")).first()[0] == expected


def test_search_text(values):
    assert values(text.complete_search_text, "R. X", "R. X, CURITIBA") == [
        "R. X, Curitiba, PR, Brasil",
        "R. X, CURITIBA",
    ]


def test_number_text_is_the_shortest_decimal(spark):
    numbers = [0.5, 0.25, 1.0, 0.0005, 0.00012345, 9.99999e-06, 1e-05, 0.001, 0.123456789]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r["t"] for r in df.orderBy("i").select(text.number_text("x").alias("t")).collect()]
    assert got == [str(x) for x in numbers]
    assert spark.range(1).select(text.number_text(F.lit(None).cast("double"))).first()[0] == "None"
