"""Text normalisation and token functions.

Normalised text is NFKC, casefolded, with every character that is no letter, mark or number as a space, and single spaces.
Spark has neither NFKC nor casefold, so rows of plain ASCII take native functions and only the others a Python one, whose
Unicode tables are also the newer ones.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..config import STOPWORDS

ASCII = r"^[\x00-\x7F]*$"


def normalize_text(value: str | None, ampersand: bool) -> str:
    """Normal form of any value; with `ampersand`, & is the word "and"."""
    folded = unicodedata.normalize("NFKC", value or "").casefold()
    if ampersand:
        folded = folded.replace("&", " and ")
    return " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in folded).split())


def normalize_ascii(value: Column, ampersand: bool) -> Column:
    """The same for values that are null or plain ASCII, without leaving the JVM."""
    low = F.lower(F.coalesce(value, F.lit("")))
    if ampersand:
        low = F.replace(low, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def _udf(ampersand: bool):
    @F.pandas_udf(StringType())
    def normalized(values: pd.Series) -> pd.Series:
        return values.map(lambda v: normalize_text(v, ampersand))

    return normalized


def normalize_columns(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """df with the given columns normalised; the value says whether & becomes "and". Null becomes empty.

    Rows whose columns are all plain ASCII never enter Python.
    """
    plain = F.lit(True)
    for c in columns:
        plain = plain & F.coalesce(F.col(c), F.lit("")).rlike(ASCII)
    native = df.where(plain).withColumns({c: normalize_ascii(F.col(c), a) for c, a in columns.items()})
    other = df.where(~plain).withColumns({c: _udf(a)(F.coalesce(F.col(c), F.lit(""))) for c, a in columns.items()})
    return native.unionByName(other)


def tokens(normal: Column) -> Column:
    """Distinct tokens of normalised text in order of first appearance; none for empty text."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def compact(normal: Column) -> Column:
    return F.replace(normal, F.lit(" "), F.lit(""))


def numbers(normal: Column) -> Column:
    """Distinct runs of decimal digits of any script."""
    return F.array_distinct(F.regexp_extract_all(normal, F.lit(r"(\p{Nd}+)"), F.lit(1)))


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def trigrams(normal: Column) -> Column:
    """Distinct windows of 3 characters without spaces; shorter text is one of its own, empty text has none."""
    s = compact(normal)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def significant(normal: Column) -> Column:
    """Sorted distinct tokens that are no stopwords."""
    return F.filter(F.array_sort(tokens(normal)), lambda t: ~t.isin(*STOPWORDS))


def sorted_tokens(normal: Column) -> Column:
    """All tokens, repeats included, sorted and joined again."""
    return F.array_join(F.array_sort(F.split(normal, " ")), " ")


def _scripts(text: str) -> list[str]:
    found = {unicodedata.name(c, "").split(" ")[0] for c in text if unicodedata.category(c)[0] == "L"}
    return sorted(found - {""})


@F.pandas_udf(ArrayType(StringType()))
def scripts(values: pd.Series) -> pd.Series:
    """First words of the Unicode names of each text's letters, such as LATIN or CJK."""
    return values.map(lambda v: _scripts(v or ""))


def with_scripts(df: DataFrame, normal: str, name: str) -> DataFrame:
    """df plus the scripts of a normalised column; plain ASCII has LATIN or nothing and stays in the JVM."""
    plain = F.col(normal).rlike(ASCII)
    latin = F.when(F.col(normal).rlike("[a-z]"), F.array(F.lit("LATIN"))).otherwise(F.array().cast("array<string>"))
    return df.where(plain).withColumn(name, latin).unionByName(df.where(~plain).withColumn(name, scripts(F.col(normal))))
