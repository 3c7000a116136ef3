"""The 39 features of a pair. Whatever belongs to one record is computed before the pairs are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FEATURES
from ..functions.similarity import partial_column, ratio_column, set_column, sort_column
from ..functions.text import compact, tokens, trigrams, with_scripts
from ..functions.translit import with_any_latin, with_latin
from .blocking import prepared, shared_routes
from .rare import with_records


def records(rows: DataFrame, other_scripts: bool = True) -> DataFrame:
    """rows (n, a, c and more) with all that features need of one record.

    other_scripts: also transliterate names outside the Latin script, which takes a job of its own over those names.
    """
    ready = with_scripts(prepared(rows), "n", "scripts")
    ready = (with_any_latin if other_scripts else with_latin)(ready, "n", "latin")
    latin = F.coalesce("latin", F.col("n"))
    return ready.withColumns({"ng": trigrams(F.col("n")), "ag": trigrams(F.col("a")), "latin": latin}).withColumns({"lt": tokens(F.col("latin")), "lg": trigrams(F.col("latin"))})


def _jaccard(a: Column, b: Column, empty: float) -> Column:
    """Of arrays without repeats."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(empty))


def _containment(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def native_features() -> dict[str, Column]:
    """Features of a joined pair that need no text similarity; s1's columns have plain names, the target's t_ ones."""
    n, tn, a, ta, c, tc = (F.col(x) for x in ("n", "t_n", "a", "t_a", "c", "t_c"))
    nt, tt, at, tat, nums, tnums = (F.col(x) for x in ("nt", "t_nt", "at", "t_at", "nums", "t_nums"))
    cn, ctn = compact(n), compact(tn)
    prefix = lambda k: _flag((F.length(cn) >= k) & (F.length(ctn) >= k) & (F.substring(cn, 1, k) == F.substring(ctn, 1, k)))
    ratio = lambda x, y: F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
    both = (F.size(nums) > 0) & (F.size(tnums) > 0)
    scripts = (F.size("scripts") > 0) & (F.size("t_scripts") > 0) & ~F.arrays_overlap("scripts", "t_scripts")
    first = F.substring_index(n, " ", 1)
    routes = shared_routes(F.col("keys"), F.col("t_keys")).cast("double")
    return {
        "name_exact": _flag((n != "") & (n == tn)),
        "name_token_jaccard": _jaccard(nt, tt, 1.0),
        "name_prefix6": prefix(6),
        "name_prefix4": prefix(4),
        "name_common_tokens": F.size(F.array_intersect(nt, tt)).cast("double"),
        "name_common_token_ratio": _jaccard(nt, tt, 1.0),
        "name_first_word_match": _flag((first != "") & (first == F.substring_index(tn, " ", 1))),
        "address_exact": _flag((a != "") & (a == ta)),
        "address_token_jaccard": _jaccard(at, tat, 1.0),
        "numeric_jaccard": _jaccard(nums, tnums, 1.0),
        "country_equal": _flag((c != "") & (c == tc)),
        "name_length_ratio": ratio(n, tn),
        "name_length_gap": F.abs(F.length(n) - F.length(tn)) / 100.0,
        "address_length_ratio": ratio(a, ta),
        "address_length_gap": F.abs(F.length(a) - F.length(ta)) / 200.0,
        "s1_address_missing": _flag(a == ""),
        "target_address_missing": _flag(ta == ""),
        "is_india": _flag(F.contains(c, F.lit("india"))),
        "target_is_s2": _flag(F.col("t_source") == 2),
        "name_is_short": _flag(F.least(F.length(cn), F.length(ctn)) <= 5),
        "numeric_set_exact": _flag(both & (F.array_sort(nums) == F.array_sort(tnums))),
        "numeric_conflict": _flag(both & ~F.arrays_overlap(nums, tnums)),
        "rare_address_overlap": F.col("is_rare").cast("double"),
        "original_route_count": routes,
        "route_agreement_count": routes + F.col("is_rare"),
        "name_token_containment": _containment(nt, tt),
        "address_token_containment": _containment(at, tat),
        "name_char_trigram_jaccard": _jaccard(F.col("ng"), F.col("t_ng"), 0.0),
        "address_char_trigram_jaccard": _jaccard(F.col("ag"), F.col("t_ag"), 0.0),
        "name_script_mismatch": _flag(scripts),
        "transliterated_token_jaccard": _jaccard(F.col("lt"), F.col("t_lt"), 0.0),
        "transliterated_char_trigram_jaccard": _jaccard(F.col("lg"), F.col("t_lg"), 0.0),
    }


def similarity_features() -> dict[str, Column]:
    return {
        "name_fuzz_ratio": ratio_column("n", "t_n"), "name_token_sort_ratio": sort_column("n", "t_n"), "name_token_set_ratio": set_column("n", "t_n"),
        "name_partial_ratio": partial_column("n", "t_n"), "address_fuzz_ratio": ratio_column("a", "t_a"), "address_token_sort_ratio": sort_column("a", "t_a"),
        "transliterated_name_fuzz": ratio_column("latin", "t_latin"),
    }


def pair_records(pairs: DataFrame, s1: DataFrame, targets: DataFrame, other_scripts: bool = True) -> DataFrame:
    """pairs (s1_id, target_idx, is_rare) with everything that features are made of. A target's source must be 2 or 3."""
    wrong = F.raise_error(F.lit("a target's source must be 2 or 3"))
    checked = targets.withColumn("source", F.when(F.col("source").isin(2, 3), F.col("source")).otherwise(wrong.cast("int")))
    return with_records(pairs, records(s1, other_scripts), records(checked, other_scripts))


def with_features(joined: DataFrame, *more: str) -> DataFrame:
    """s1_id, target_idx, the named other columns, and all FEATURES as 32-bit floats, in order."""
    found = native_features() | similarity_features()
    return joined.select("s1_id", "target_idx", *more, *[found[f].cast("float").alias(f) for f in FEATURES])
