import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import similarity, text

CASES = [
    (None, ""), ("!?-_", ""), ("A&B", "a and b"), ("＆", "and"), ("ＡＢ１", "ab1"), ("Straße", "strasse"), ("İ", "i̇"), ("ΟΔΟΣ", "οδοσ"),
    ("a–b’c", "a b c"), ("a\x1fb\tc\x00d", "a b c d"), ("é", "é"), ("xࡰy", "xࡰy"), ("北京 市", "北京 市"), ("²", "2"),
]


@pytest.mark.parametrize("value, normal", CASES)
def test_normal_form(value, normal):
    assert text.normalize_text(value, True) == normal


def test_country_keeps_no_and():
    assert text.normalize_text("A&B", False) == "a b"


def test_columns_take_both_ways(spark):
    rows = spark.createDataFrame([(i, v, v) for i, (v, _) in enumerate(CASES)], "i int, x string, y string")
    found = {r["i"]: (r["x"], r["y"]) for r in text.normalize_columns(rows, {"x": True, "y": False}).collect()}
    assert found == {i: (n, text.normalize_text(v, False)) for i, (v, n) in enumerate(CASES)}


def test_native_ascii_equals_python(spark):
    values = ["".join(map(chr, range(128))), "a&&b", " x ", "", "A-1"]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", text.normalize_ascii(F.col("x"), True).alias("n")).collect()
    assert all(r["n"] == text.normalize_text(r["x"], True) for r in rows)


def test_tokens_numbers_and_trigrams(spark):
    rows = spark.createDataFrame([("b a b",), ("",), ("ab",), ("abcd x",), ("12 a345 ٣٤٥ 12",)], "x string")
    found = rows.select(text.tokens(F.col("x")).alias("t"), text.numbers(F.col("x")).alias("n"), text.trigrams(F.col("x")).alias("g")).collect()
    assert [r["t"] for r in found] == [["b", "a"], [], ["ab"], ["abcd", "x"], ["12", "a345", "٣٤٥"]]
    assert found[4]["n"] == ["12", "345", "٣٤٥"]
    assert [r["g"] for r in found[:4]] == [["bab"], [], ["ab"], ["abc", "bcd", "cdx"]]


def test_scripts(spark):
    rows = spark.createDataFrame([("abc",), ("москва",), ("北京",), ("abc москва",), ("123",), ("é",)], "x string")
    found = {r["x"]: r["s"] for r in text.with_scripts(rows, "x", "s").collect()}
    assert found == {"abc": ["LATIN"], "москва": ["CYRILLIC"], "北京": ["CJK"], "abc москва": ["CYRILLIC", "LATIN"], "123": [], "é": ["LATIN"]}


def _table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


words = st.text(alphabet="abc é", max_size=12)


@given(words, words)
def test_lcs_equals_the_table(a, b):
    assert similarity.lcs(a, b) == _table(a, b)


@given(words, words)
def test_partial_equals_all_windows(a, b):
    def best(x, y):
        return max((2 * _table(x, w) / (len(x) + len(w)) for e in range(1, len(y) + len(x)) if (w := y[max(0, e - len(x)) : e])), default=0.0)

    if a and b:
        x, y = sorted((a, b), key=len)
        expected = max(best(x, y), best(y, x)) if len(x) == len(y) else best(x, y)
        assert similarity.partial_ratio(a, b) == pytest.approx(expected)


def test_empty_and_subset_similarities():
    s = similarity
    assert (s.ratio("", ""), s.token_sort_ratio("", ""), s.partial_ratio("", ""), s.token_set_ratio("", "")) == (1, 1, 1, 0)
    assert (s.ratio("a", ""), s.partial_ratio("a", ""), s.token_set_ratio("a", "")) == (0, 0, 0)
    assert s.token_set_ratio("b a", "a b c") == 1 and s.token_sort_ratio("é z", "z é") == 1
    assert s.ratio("abcd", "abxd") == s.ratio("abxd", "abcd") == 0.75
