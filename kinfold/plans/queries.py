"""One query for each operator, over the documents table as entities, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, FEATURES
from ..functions.text import tokens
from ..operators import blocking, contract, features, metrics, policy, rare, scoring
from ..sources.entities import entity_view, normalized, queries_and_targets
from ..sources.output import shards
from ..sources.storage import dealt, written
from . import sql
from .linkage import link

Query = Callable[[SparkSession, str], DataFrame]
#: Caps low enough to bite on small tables.
TIGHT = replace(DEFAULT, posting_cap=20, eligible_cap=10)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None, config=DEFAULT):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if statement:
            SQL[name] = sql.statement(statement, config)
        return f

    return register


@query("entity_view", "SELECT doc_id AS row_pos, source, entity_id, business_name, business_address, country FROM e")
def _(spark, d):
    return entity_view(spark, d)


for _name, _column in (("normalize_name", "n"), ("normalize_address", "a"), ("normalize_country", "c")):
    query(_name, f"SELECT entity_id, {_column} AS normal FROM n")(lambda spark, d, c=_column: normalized(entity_view(spark, d)).select("entity_id", F.col(c).alias("normal")))


@query("tokens_unique", "SELECT entity_id, array_to_string(nt, ' ') AS tokens, CAST(len(nt) AS BIGINT) AS n_tokens FROM r")
def _(spark, d):
    t = tokens(F.col("n"))
    return normalized(entity_view(spark, d)).select("entity_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n_tokens"))


_KEYS = {"keys_exact": "E", "keys_prefix6": "P6", "keys_prefix4": "P4", "keys_sorted_pairs": "ST", "keys_word": "W", "keys_numeric": "AN"}
for _name, _route in _KEYS.items():
    query(_name, f"SELECT entity_id, unnest(k_{_route}) AS key FROM r2")(
        lambda spark, d, r=_route: normalized(entity_view(spark, d)).select("entity_id", F.explode(blocking.route_keys(r, F.col("n"), F.col("a"), F.col("c"))).alias("key"))
    )


@query("keys_all", "SELECT entity_id, unnest(keys) AS key FROM r")
def _(spark, d):
    return blocking.exploded(normalized(entity_view(spark, d)), "entity_id")


def _targets(spark, d):
    return queries_and_targets(spark, d)[1]


@query("key_frequencies", "SELECT key, freq FROM kf")
def _(spark, d):
    return blocking.frequencies(blocking.exploded(_targets(spark, d), "target_idx"))


@query("key_cap_filter", "SELECT target_idx, key FROM live", TIGHT)
def _(spark, d):
    return blocking.capped(blocking.exploded(_targets(spark, d), "target_idx"), TIGHT).select("target_idx", "key")


@query("baseline_candidates", "SELECT s1_id, target_idx FROM base")
def _(spark, d):
    return blocking.baseline(*queries_and_targets(spark, d))


@query("target_fetch", "SELECT target_idx, entity_id, n, a, c, source FROM t WHERE target_idx IN (SELECT target_idx FROM base UNION SELECT target_idx FROM pool)")
def _(spark, d):
    s1, t = queries_and_targets(spark, d)
    wanted = blocking.baseline(s1, t).select("target_idx").union(rare.pool(s1, t).select("target_idx")).distinct()
    return wanted.join(t, "target_idx").select("target_idx", "entity_id", "n", "a", "c", "source")


@query("rare_token_select", "SELECT s1_id, token, freq FROM chosen")
def _(spark, d):
    return rare.chosen_tokens(*queries_and_targets(spark, d)).select("s1_id", "token", "freq")


@query("rare_pool", "SELECT s1_id, target_idx FROM pool")
def _(spark, d):
    return rare.pool(*queries_and_targets(spark, d))


@query("rare_eligible", "SELECT s1_id, target_idx FROM eligible")
def _(spark, d):
    return rare.eligible(*queries_and_targets(spark, d)).select("s1_id", "target_idx")


@query("rare_overflow", "SELECT s1_id, target_idx FROM eligible", TIGHT)
def _(spark, d):
    return rare.eligible(*queries_and_targets(spark, d), TIGHT).select("s1_id", "target_idx")


def _added(spark, d):
    s1, t = queries_and_targets(spark, d)
    return s1, t, rare.added(rare.eligible(s1, t), blocking.baseline(s1, t))


@query("rare_added", "SELECT s1_id, target_idx FROM added")
def _(spark, d):
    return _added(spark, d)[2].select("s1_id", "target_idx")


@query("rare_top25", "SELECT s1_id, target_idx, rank FROM best")
def _(spark, d):
    s1, t, new = _added(spark, d)
    return rare.best_added(new, s1, t)


def _pairs(pairs: DataFrame) -> DataFrame:
    return written(dealt(pairs), "pairs")


def _scores(scored: DataFrame) -> DataFrame:
    """Scored pairs, written: the policy reads a score several times, and Spark would work it out as often within its filter."""
    return written(scored.select("s1_id", "target_idx", "score", "numeric_conflict", "name_exact"), "scores")


def _linked(spark, d, keep_scores=lambda scored: scored):
    return link(*queries_and_targets(spark, d), keep=_pairs, other_scripts=False, keep_scores=keep_scores)


@query("candidate_union", "SELECT s1_id, target_idx, is_rare FROM pairs")
def _(spark, d):
    return _linked(spark, d).pairs


def _number(name: str) -> F.Column:
    return F.round(F.col(name).cast("float").cast("double"), 6).alias(name)


def _features(spark, d, names, other_scripts=False):
    """Only the named features' columns are made: the optimizer drops the others, and the trip to Python if none needs it."""
    s1, t = queries_and_targets(spark, d)
    pairs = _pairs(rare.candidates(s1, t, blocking.baseline(s1, t)))
    joined = features.pair_records(pairs, s1, t, other_scripts)
    return features.with_features(joined).select("s1_id", "target_idx", *map(_number, names))


_FEATURES = {
    "feat_name_equalities": ["name_exact", "name_prefix6", "name_prefix4", "name_first_word_match"],
    "feat_token_sets": ["name_token_jaccard", "name_common_tokens", "name_common_token_ratio", "address_token_jaccard"],
    "feat_lengths": ["name_length_ratio", "name_length_gap", "address_length_ratio", "address_length_gap", "name_is_short"],
    "feat_missing_context": ["address_exact", "country_equal", "s1_address_missing", "target_address_missing", "is_india", "target_is_s2"],
    "feat_numeric": ["numeric_jaccard", "numeric_set_exact", "numeric_conflict"],
    "feat_routes": ["rare_address_overlap", "original_route_count", "route_agreement_count"],
    "feat_containment": ["name_token_containment", "address_token_containment"],
    "feat_trigram": ["name_char_trigram_jaccard", "address_char_trigram_jaccard"],
    "feat_ratio": ["name_fuzz_ratio", "address_fuzz_ratio"],
    "feat_token_sort": ["name_token_sort_ratio", "address_token_sort_ratio"],
    "feat_translit": ["transliterated_name_fuzz", "transliterated_token_jaccard", "transliterated_char_trigram_jaccard"],
    "feat_script_mismatch": ["name_script_mismatch"],
}
for _name, _columns in _FEATURES.items():
    _select = ", ".join(f"round(CAST(CAST({sql.FORMULAS[c]} AS FLOAT) AS DOUBLE), 6) AS {c}" for c in _columns)
    query(_name, f"SELECT s1_id, target_idx, {_select} FROM p")(lambda spark, d, names=_columns, name=_name: _features(spark, d, names, name == "feat_translit"))


_SET = "SELECT s1_id, target_idx, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS name_token_set_ratio FROM set_ratios"


@query("feat_token_set", _SET)
def _(spark, d):
    return _features(spark, d, ["name_token_set_ratio"])


_WINDOWS = "list_transform(range(2 - CAST(length({x}) AS BIGINT), CAST(length({y}) AS BIGINT) + 1), lambda i: substr({y}, greatest(i, 1), least(i + CAST(length({x}) AS BIGINT), CAST(length({y}) AS BIGINT) + 1) - greatest(i, 1)))"


def _windows(x: str, y: str) -> str:
    return f"SELECT s1_id, target_idx, {x} AS q, unnest({_WINDOWS.format(x=x, y=y)}) AS v FROM p WHERE length({x}) <= length({y}) AND {x} <> ''"


_PARTIAL = (
    "SELECT s1_id, target_idx, round(CAST(CAST(CASE WHEN n = '' OR t_n = '' THEN CASE WHEN n = t_n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE best END AS FLOAT) AS DOUBLE), 6) AS name_partial_ratio "
    f"FROM p LEFT JOIN (SELECT s1_id, target_idx, max({sql.ratio('q', 'v')}) AS best FROM "
    f"(SELECT DISTINCT * FROM ({_windows('n', 't_n')} UNION ALL {_windows('t_n', 'n')})) GROUP BY s1_id, target_idx) USING (s1_id, target_idx)"
)


@query("feat_partial", _PARTIAL)
def _(spark, d):
    return _features(spark, d, ["name_partial_ratio"])


_ALL = ", ".join(f"round(CAST(CAST({sql.FORMULAS[c]} AS FLOAT) AS DOUBLE), 6) AS {c}" for c in FEATURES if c in sql.FORMULAS)


@query("features_all", f"SELECT s1_id, target_idx, {_ALL}, name_token_set_ratio, name_partial_ratio FROM p JOIN ({_SET}) USING (s1_id, target_idx) JOIN ({_PARTIAL}) USING (s1_id, target_idx)")
def _(spark, d):
    return _features(spark, d, FEATURES, other_scripts=True)


@query("score", "SELECT s1_id, target_idx, " + ", ".join(f"round(CAST(p{i} AS DOUBLE), 5) AS p{i}" for i in range(4)) + " FROM ps")
def _(spark, d):
    return _linked(spark, d).scored.select("s1_id", "target_idx", *[F.round(F.col(f"p{i}").cast("double"), 5).alias(f"p{i}") for i in range(4)])


def _score() -> F.Column:
    return F.round(F.col("score").cast("double"), 5).alias("score")


@query("score_mean", "SELECT s1_id, target_idx, round(CAST(score AS DOUBLE), 5) AS score FROM sc")
def _(spark, d):
    return _linked(spark, d).scored.select("s1_id", "target_idx", _score())


@query("policy_threshold", "SELECT s1_id, target_idx, round(CAST(score AS DOUBLE), 5) AS score FROM ok")
def _(spark, d):
    return policy.accepted(_linked(spark, d, _scores).scored).select("s1_id", "target_idx", _score())


@query("policy_top11", "SELECT s1_id, target_idx, rank FROM m")
def _(spark, d):
    return _linked(spark, d, _scores).matches.select("s1_id", "target_idx", "rank")


@query("submission_candidates", "SELECT source1_entity_id, candidate_entity_ids FROM cl")
def _(spark, d):
    return _linked(spark, d).candidate_lists.drop("row_pos")


@query("submission_matches", "SELECT source1_entity_id, matched_entity_ids FROM ml")
def _(spark, d):
    return _linked(spark, d, _scores).match_lists.drop("row_pos")


@query("merged_output", "SELECT cl.row_pos, cl.source1_entity_id, candidate_entity_ids, matched_entity_ids FROM cl JOIN ml USING (row_pos) ORDER BY row_pos")
def _(spark, d):
    found = _linked(spark, d, _scores)
    return found.candidate_lists.join(found.match_lists.drop("source1_entity_id"), "row_pos").orderBy("row_pos")


#: Results with planted faults, by row: the lists of every 7th, 11th, 13th and 17th entity break a rule each.
_FAULTY = [("candidate_entity_ids", 7, "S2-x,S2-x"), ("candidate_entity_ids", 11, "S1-1"), ("matched_entity_ids", 13, "S3-none"), ("matched_entity_ids", 17, ",".join(f"S2-m{i}" for i in range(12)))]


def _broken(table: DataFrame, column: str) -> DataFrame:
    value = F.col(column)
    for c, every, ids in _FAULTY:
        value = F.when(F.col("row_pos") % every == 1, ids).otherwise(value) if c == column else value
    return table.withColumn(column, value)


def _broken_sql(column: str) -> str:
    value = column
    for c, every, ids in _FAULTY:
        value = f"CASE WHEN row_pos % {every} = 1 THEN '{ids}' ELSE {value} END" if c == column else value
    return value


_LISTED = (
    f"(SELECT source1_entity_id, CASE WHEN cx = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(cx, ',') END AS cs, CASE WHEN mx = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(mx, ',') END AS ms "
    f"FROM (SELECT cl.source1_entity_id, {_broken_sql('candidate_entity_ids')} AS cx, {_broken_sql('matched_entity_ids')} AS mx FROM cl JOIN ml USING (row_pos)))"
)
_RULES = {
    "repeated candidate": "len(list_distinct(cs)) < len(cs)",
    "repeated match": "len(list_distinct(ms)) < len(ms)",
    "too many matches": "len(ms) > 11",
    "wrong target id": "len(list_filter(list_concat(cs, ms), lambda i: NOT regexp_matches(i, '^S[23]-.+$'))) > 0",
    "match is no candidate": "len(list_filter(ms, lambda i: NOT list_contains(cs, i))) > 0",
}


@query("validate_contract", " UNION ALL ".join(f"SELECT '{rule}' AS rule, source1_entity_id FROM {_LISTED} WHERE {test}" for rule, test in _RULES.items()))
def _(spark, d):
    s1, t = queries_and_targets(spark, d)
    found = link(s1, t, keep=_pairs, other_scripts=False, keep_scores=_scores)
    return contract.violations(s1, _broken(found.candidate_lists, "candidate_entity_ids"), _broken(found.match_lists, "matched_entity_ids"))


_SHARD = "SELECT *, CAST(least(row_pos // greatest(1, (total + 3) // 4), 3) AS INTEGER) AS shard FROM (SELECT *, count(*) OVER () AS total FROM s)"
_RANGES = f"SELECT shard, count(*) AS rows, min(row_pos) AS first_pos, max(row_pos) + 1 AS end_pos, min_by(s1_id, row_pos) AS first_id, max_by(s1_id, row_pos) AS last_id FROM ({_SHARD}) GROUP BY shard"


def _ranges(spark, d):
    return contract.shard_ranges(shards(queries_and_targets(spark, d)[0], 4))


@query("shard_partition", _RANGES)
def _(spark, d):
    return _ranges(spark, d)


@query("shard_contiguity", f"SELECT shard, first_pos, end_pos, first_pos = lag(end_pos, 1, 0) OVER (ORDER BY first_pos) AS contiguous FROM ({_RANGES}) WHERE shard <> 2")
def _(spark, d):
    return contract.gaps(_ranges(spark, d).where("shard <> 2")).select("shard", "first_pos", "end_pos", "contiguous")


@query("resume_check", f"SELECT shard, shard IN (0, 2) AS complete FROM ({_RANGES})")
def _(spark, d):
    planned = _ranges(spark, d)
    finished = planned.where("shard <> 3").withColumn("rows", F.col("rows") - F.when(F.col("shard") == 1, 1).otherwise(0))
    return contract.resumable(planned, finished).select("shard", F.coalesce("complete", F.lit(False)).alias("complete"))


@query(
    "run_metrics",
    "SELECT count(*) AS entities, CAST(sum(c) AS BIGINT) AS candidate_pairs, CAST(sum(m) AS BIGINT) AS matching_pairs, min(c) AS least_candidates, max(c) AS most_candidates FROM "
    "(SELECT CASE WHEN candidate_entity_ids = '' THEN 0 ELSE CAST(len(string_split(candidate_entity_ids, ',')) AS BIGINT) END AS c, "
    "CASE WHEN matched_entity_ids = '' THEN 0 ELSE CAST(len(string_split(matched_entity_ids, ',')) AS BIGINT) END AS m FROM cl JOIN ml USING (row_pos))",
)
def _(spark, d):
    found = _linked(spark, d, _scores)
    return metrics.run_metrics(found.candidate_lists, found.match_lists)


@query("run_progress", f"SELECT count(*) AS shards, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(rows) - 1 AS BIGINT) AS done, false AS complete, max(CAST(first_pos AS DOUBLE)) AS seconds FROM ({_RANGES})")
def _(spark, d):
    done = F.col("rows") - F.when(F.col("shard") == 0, 1).otherwise(0)
    return metrics.progress(_ranges(spark, d).select("shard", "rows", done.alias("done"), (done == F.col("rows")).alias("complete"), F.col("first_pos").cast("double").alias("seconds")))


@query(
    "output_fingerprint",
    "SELECT count(*) AS rows, sha256(CAST(sum(CAST(concat('0x', substr(sha256(s1_id || chr(1) || n || chr(1) || a || chr(1) || c), 1, 15)) AS BIGINT)) AS VARCHAR)) AS sha256 FROM s",
)
def _(spark, d):
    return metrics.fingerprint(queries_and_targets(spark, d)[0], ["s1_id", "n", "a", "c"])


@query(
    "parity_diff",
    f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing, round(max(abs(CAST(CAST({sql.FORMULAS['name_token_containment']} AS FLOAT) AS DOUBLE) - CAST(CAST({sql.FORMULAS['name_token_jaccard']} AS FLOAT) AS DOUBLE))), 5) AS difference FROM p",
)
def _(spark, d):
    found = _features(spark, d, ["name_token_containment", "name_token_jaccard"])
    a = found.select("s1_id", "target_idx", F.col("name_token_containment").alias("v"))
    b = found.select("s1_id", "target_idx", F.col("name_token_jaccard").alias("v"))
    return metrics.largest_difference(a, b, ["s1_id", "target_idx"], ["v"]).withColumn("difference", F.round("difference", 5))


@query(
    "f_half",
    "SELECT precision, recall, CASE WHEN 0.25::DOUBLE * precision + recall > 0 THEN 1.25::DOUBLE * precision * recall / (0.25::DOUBLE * precision + recall) ELSE 0.0::DOUBLE END AS f_half FROM "
    "(SELECT h / CAST(greatest(np, 1) AS DOUBLE) AS precision, h / CAST(greatest(na, 1) AS DOUBLE) AS recall FROM "
    "(SELECT (SELECT count(*) FROM m) AS np, (SELECT count(*) FROM p WHERE n <> '' AND n = t_n) AS na, (SELECT count(*) FROM m JOIN p USING (s1_id, target_idx) WHERE n <> '' AND n = t_n) AS h))",
)
def _(spark, d):
    """Accepted pairs against pairs of one name, as a stand-in for known matches."""
    found = _linked(spark, d, _scores)
    return metrics.f_half(found.matches, found.scored.where("name_exact = 1"), ["s1_id", "target_idx"])
