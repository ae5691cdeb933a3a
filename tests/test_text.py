import pytest
from pyspark.sql import functions as F

from titlesieve.functions import text
from titlesieve.functions.phonetic import phonetic_code, word_key


def evaluate(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["out"] for r in df.select("i", column(F.col("c")).alias("out")).orderBy("i").collect()]


def test_normalize_title(spark):
    cases = {
        "  Climate  Change—News!  ": "climate change news", "News & Technology": "news technology",
        "  Title 123  ": "title 123", "my_title_here": "my title here", "": "", None: "", "café": "caf",
        "समाचार": "", "Größe": "gr sse", "Straße": "strasse", "ＮＥＷＳ ﬁle": "news file", "a\tb\nc": "a b c", "İx": "i x", "K½": "k1 2",
    }
    assert evaluate(spark, list(cases), text.normalize_title) == list(cases.values())


def test_normalize_domain(spark):
    cases = {
        "news - sports": "news-sports", "News - Technology": "news-technology", "  business  ": "business",
        "": "unknown", None: "unknown", "   ": "", "a  b": "a-b", "x - y": "x-y",
    }
    assert evaluate(spark, list(cases), text.normalize_domain) == list(cases.values())


def test_latin_script(spark):
    cases = {"Climate Change Today": True, "12345": True, "समाचार पत्रिका": False, "": False, None: False,
             "abcdж": True, "abcжж": False}
    assert evaluate(spark, list(cases), text.is_latin_script) == list(cases.values())


def test_blank_to_null(spark):
    cases = {"": None, " \t": None, "NaN": None, " nan ": None, " x ": "x", None: None, " ": None}
    assert evaluate(spark, list(cases), text.blank_to_null) == list(cases.values())


def test_normalizing_twice_changes_nothing(spark):
    once = evaluate(spark, ["Ünïcode Títle — №5", "ǅ ß ẞ", "A.B.C"], text.normalize_title)
    assert evaluate(spark, once, text.normalize_title) == once


@pytest.mark.parametrize("value,digits,want", [(0.03125, 4, 0.0312), (0.745, 2, 0.74), (2.675, 2, 2.67), (1234.565, 2, 1234.57)])
def test_round_exact(spark, value, digits, want):
    assert spark.range(1).select(text.round_exact(F.lit(value), digits)).first()[0] == want == round(value, digits)


@pytest.mark.parametrize("word,key", [
    ("climate", "KLMT"), ("klimat", "KLMT"), ("news", "NS"), ("newz", "NS"), ("smith", "SM0"), ("schmidt", "XMT"),
    ("knight", "NT"), ("michael", "MKL"), ("chianti", "KNT"), ("caesar", "SSR"), ("character", "KRKTR"),
    ("accident", "AKSTNT"), ("bacci", "PX"), ("edge", "AJ"), ("edgar", "ATKR"), ("laugh", "LF"), ("hugh", "H"),
    ("though", "0"), ("right", "RT"), ("danger", "TNJR"), ("island", "ALNT"), ("sugar", "XKR"), ("school", "SKL"),
    ("nation", "NXN"), ("thomas", "TMS"), ("filipowicz", "FLPTS"), ("breaux", "PR"), ("xavier", "SF"), ("zhao", "J"),
    ("phone", "FN"), ("technology", "TKNLJ"), ("architect", "ARKTKT"), ("success", "SKSS"), ("123", ""),
])
def test_word_key(word, key):
    assert word_key(word) == key


def test_phonetic_code(spark):
    titles = ["Climate News", "Klimat Newz", "समाचार", "", "123", None]
    code = evaluate(spark, titles, lambda c: phonetic_code(c, text.normalize_title(c)))
    assert code == ["KLMT NS", "KLMT NS", None, None, None, None]
