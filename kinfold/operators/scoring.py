"""Scores of pairs: an ensemble's mean, from tree models or from logistic stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logistic stand-ins for four models whose files aren't public: bias, and weights of features.
STAND_INS = [
    (-6.0, {"name_token_jaccard": 5.0, "address_token_jaccard": 4.0, "country_equal": 1.0, "name_exact": 1.5}),
    (-5.5, {"name_token_jaccard": 4.5, "address_token_jaccard": 4.5, "country_equal": 0.75, "address_exact": 1.25}),
    (-6.5, {"name_token_containment": 5.0, "address_token_containment": 4.5, "numeric_jaccard": 1.5, "country_equal": 1.0}),
    (-5.0, {"name_char_trigram_jaccard": 5.0, "address_char_trigram_jaccard": 4.0, "numeric_conflict": -1.0, "country_equal": 1.0}),
]


def with_stand_ins(pairs: DataFrame) -> DataFrame:
    """pairs plus p0 to p3, as 32-bit floats of feature columns."""
    scores = {}
    for i, (bias, weights) in enumerate(STAND_INS):
        z = F.lit(bias)
        for name, weight in weights.items():
            z = z + F.lit(weight) * F.col(name).cast("double")
        scores[f"p{i}"] = (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).cast("float")
    return pairs.withColumns(scores)


def with_mean(pairs: DataFrame, models: int = 4) -> DataFrame:
    """pairs plus score: the mean of p0, p1, ..., added up in this order in 32-bit floats."""
    total = F.col("p0")
    for i in range(1, models):
        total = (total + F.col(f"p{i}")).cast("float")
    return pairs.withColumn("score", (total / F.lit(models)).cast("float"))
