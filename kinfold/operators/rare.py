"""Candidates by the rarest address tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.similarity import lcs_length, ratio_column
from ..functions.text import is_number, numbers, tokens
from ..sources.storage import dealt


def _at():
    return tokens(F.col("a"))


def token_frequencies(targets: DataFrame) -> DataFrame:
    """(c, token, freq): number of targets of a country with each address token."""
    return targets.select("c", F.explode(_at()).alias("token")).groupBy("c", "token").agg(F.count("*").alias("freq"))


def chosen_tokens(s1: DataFrame, targets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(s1_id, c, token, freq) of each entity's rarest address tokens that targets of its country have, ties by token."""
    own = s1.select("s1_id", "c", F.explode(_at()).alias("token")).where(F.length("token") >= config.rare_token_length)
    known = token_frequencies(targets).where(F.col("freq") <= config.rare_cap)
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy("freq", "token"))
    return own.join(known, ["c", "token"]).withColumn("rank", rank).where(F.col("rank") <= config.rare_tokens).drop("rank")


def pool(s1: DataFrame, targets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Distinct (s1_id, target_idx) where the target has a chosen token; tokens over the cap join nothing."""
    postings = targets.select("target_idx", "c", F.explode(_at()).alias("token"))
    found = chosen_tokens(s1, targets, config).select("s1_id", "c", "token").join(postings, ["c", "token"]).select("s1_id", "target_idx")
    return dealt(found, "s1_id", "target_idx").distinct()


def with_records(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs with both records; target columns begin with t_. Every pair must have both."""
    t = targets.select("target_idx", *[F.col(c).alias(f"t_{c}") for c in targets.columns if c != "target_idx"])
    return pairs.join(s1, "s1_id").join(t, "target_idx")


def eligible_before_overflow(s1: DataFrame, targets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs of the pool that overlap enough: first by tokens alone, then by text only where Dice doesn't do."""
    with_tokens = {"at": _at(), "words": F.filter(_at(), lambda t: ~is_number(t))}
    one, two = s1.select("s1_id", "a").withColumns(with_tokens), targets.select("target_idx", "a").withColumns(with_tokens)
    sets = with_records(pool(s1, targets, config), one, two).withColumn("shared", F.size(F.array_intersect("words", "t_words")))
    enough = sets.where(F.col("shared") >= config.shared_words)
    dice = (2.0 * F.size(F.array_intersect("at", "t_at"))) / F.greatest(F.lit(1), F.size("at") + F.size("t_at"))
    scored = enough.withColumn("dice", dice).withColumn("lcs", lcs_length(F.when(F.col("dice") < config.least_dice, F.col("a")), F.col("t_a")))
    near = 200 * F.col("lcs") >= config.least_ratio * (F.length("a") + F.length("t_a"))
    return scored.where((F.col("dice") >= config.least_dice) | F.coalesce(near, F.lit(False))).select("s1_id", "target_idx")


def eligible(s1: DataFrame, targets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The same without entities that have over eligible_cap of them (those of the baseline count)."""
    rows = eligible_before_overflow(s1, targets, config)
    few = rows.groupBy("s1_id").agg(F.count("*").alias("n")).where(F.col("n") <= config.eligible_cap).select("s1_id")
    return rows.join(few, "s1_id", "left_semi")


def added(eligible_pairs: DataFrame, baseline_pairs: DataFrame) -> DataFrame:
    return eligible_pairs.join(baseline_pairs, ["s1_id", "target_idx"], "left_anti")


def best_added(added_pairs: DataFrame, s1: DataFrame, targets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The rare_top best of each entity's additions: no conflict of numbers, then address and name likeness as 32-bit floats."""
    fields = [F.col("n"), F.col("a"), numbers(F.col("a")).alias("nums"), _at().alias("at")]
    records = with_records(dealt(added_pairs), s1.select("s1_id", *fields), targets.select("target_idx", *fields))
    x, y, at, tat = map(F.col, ("nums", "t_nums", "at", "t_at"))
    both = (F.size(x) > 0) & (F.size(y) > 0)
    common = F.size(F.array_intersect(at, tat))
    union = F.size(at) + F.size(tat) - common
    ranked = records.select(
        "s1_id", "target_idx", F.when(both & ~F.arrays_overlap(x, y), 1).otherwise(0).alias("conflict"),
        F.when(union > 0, common / union).otherwise(1.0).cast("float").alias("jaccard"),
        ratio_column("a", "t_a").cast("float").alias("address"), F.when(both & (F.array_sort(x) == F.array_sort(y)), 1).otherwise(0).alias("exact"),
        ratio_column("n", "t_n").cast("float").alias("name"),
    )
    order = Window.partitionBy("s1_id").orderBy("conflict", F.col("jaccard").desc(), F.col("address").desc(), F.col("exact").desc(), F.col("name").desc(), "target_idx")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.rare_top).select("s1_id", "target_idx", "rank")


def candidates(s1: DataFrame, targets: DataFrame, baseline_pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(s1_id, target_idx, is_rare): the baseline, and the best rare additions."""
    new = best_added(added(eligible(s1, targets, config), baseline_pairs), s1, targets, config)
    return baseline_pairs.select("s1_id", "target_idx", F.lit(0).alias("is_rare")).unionByName(new.select("s1_id", "target_idx", F.lit(1).alias("is_rare")))
