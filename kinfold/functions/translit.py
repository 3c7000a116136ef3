"""Transliteration to plain Latin letters by the ICU library that Spark brings along.

Latin letters transliterate one by one, so their table is read from ICU once (it is bounded by Unicode) and sent out.
Names in other scripts need ICU's rules over whole names; no function of Spark reaches those on executors without a jar,
so their distinct names pass through the driver, in parts, and are joined back.
"""

import sys
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ASCII, normalize_text

RULES, VERSION = "Any-Latin; Latin-ASCII", "77.1"
#: Names that the driver sends to ICU at once.
PART = 2000


def _icu(spark: SparkSession):
    icu = spark._jvm.com.ibm.icu
    if not (found := icu.util.VersionInfo.ICU_VERSION.toString()).startswith(VERSION):
        raise RuntimeError(f"ICU {VERSION} is needed, not {found}")
    return icu.text.Transliterator.getInstance(RULES)


_TABLE: dict[int, str] = {}


def latin_table(spark: SparkSession) -> dict[int, str]:
    """What each Latin letter outside ASCII becomes; read from ICU once."""
    if _TABLE:
        return _TABLE
    letters = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and unicodedata.name(c, "").startswith("LATIN ")]
    _TABLE.update({ord(c): to for c, to in zip(letters, _icu(spark).transliterate("\n".join(letters)).split("\n"), strict=True)})
    return _TABLE


def with_latin(df: DataFrame, normal: str, name: str) -> DataFrame:
    """df plus the transliteration of a normalised column, normalised again. Plain ASCII stays as it is."""
    spark = df.sparkSession
    plain = F.col(normal).rlike(ASCII)
    shared = spark.sparkContext.broadcast(latin_table(spark))

    @F.pandas_udf("string")
    def by_letter(values: pd.Series) -> pd.Series:
        table = shared.value

        def one(v: str) -> str | None:
            return normalize_text(v.translate(table), True) if all(ord(c) < 128 or ord(c) in table for c in v) else None

        return values.map(one)

    ascii_rows = df.where(plain).withColumn(name, F.col(normal))
    rest = df.where(~plain).withColumn(name, by_letter(F.col(normal)))
    return ascii_rows.unionByName(rest)


def with_any_latin(df: DataFrame, normal: str, name: str) -> DataFrame:
    """with_latin(), and names in other scripts by ICU on the driver. Runs a job over the distinct names that need it."""
    spark = df.sparkSession
    done = with_latin(df, normal, name)
    icu, part, rows = _icu(spark), [], []

    def send():
        rows.extend((a, normalize_text(b, True)) for a, b in zip(part, icu.transliterate("\n".join(part)).split("\n"), strict=True))
        part.clear()

    for r in done.where(F.col(name).isNull()).select(normal).distinct().toLocalIterator():
        part.append(r[0])
        if len(part) == PART:
            send()
    if part:
        send()
    if not rows:
        return done
    found = spark.createDataFrame(rows, f"`{normal}` string, _latin string")
    return done.join(found, normal, "left").withColumn(name, F.coalesce(name, "_latin")).drop("_latin").select(*done.columns)
