"""SQL that states the queries once more, for an independent engine: named steps, each built on those before it."""

from __future__ import annotations

from ..config import DEFAULT, FEATURES, STOPWORDS, Config
from ..operators.scoring import STAND_INS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')"


def _normal(column: str, ampersand: bool) -> str:
    """Right for these tables, whose letters are composed already and differ from lower case by one sharp s at most."""
    low = f"replace(lower({column}), 'ß', 'ss')"
    low = f"replace({low}, '&', ' and ')" if ampersand else low
    return rf"trim(regexp_replace({low}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def _unique(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by the textbook table, a row for each character of a."""
    row = f"list_transform(range(0, CAST(length({b}) AS BIGINT) + 1), lambda z: CAST(0 AS BIGINT))"
    chars = f"list_transform(range(1, CAST(length({a}) AS BIGINT) + 1), lambda z: [CAST(ord(substr({a}, z, 1)) AS BIGINT)])"
    step = (
        f"list_reduce(list_transform(range(1, CAST(length({b}) AS BIGINT) + 1), lambda z: [z]), lambda acc, j: "
        f"list_append(acc, greatest(acc[-1], r[j[1] + 1], r[j[1]] + CASE WHEN e[1] = ord(substr({b}, j[1], 1)) THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)])"
    )
    return f"CASE WHEN {a} = {b} THEN length({a}) WHEN {a} = '' OR {b} = '' THEN 0 ELSE (list_reduce({chars}, lambda r, e: {step}, {row}))[-1] END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END"


def _jaccard(a: str, b: str, empty: float) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} > 0 THEN len(list_intersect({a}, {b})) / CAST({union} AS DOUBLE) ELSE {empty}::DOUBLE END"


def _contained(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / CAST(greatest(1, least(len({a}), len({b}))) AS DOUBLE)"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _grams(x: str) -> str:
    s = f"replace({x}, ' ', '')"
    return f"CASE WHEN {s} = '' THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(CAST(length({s}) AS BIGINT) - 2, 1) + 1), lambda i: substr({s}, i, 3))) END"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def _steps(config: Config) -> dict[str, str]:
    key = {
        "E": "CASE WHEN c <> '' AND n <> '' THEN ['E|' || c || '|' || n] ELSE CAST([] AS VARCHAR[]) END",
        "P6": "CASE WHEN c <> '' AND length(cp) >= 6 THEN ['P6|' || c || '|' || substr(cp, 1, 6)] ELSE CAST([] AS VARCHAR[]) END",
        "P4": "CASE WHEN c <> '' AND length(cp) >= 4 THEN ['P4|' || c || '|' || substr(cp, 1, 4)] ELSE CAST([] AS VARCHAR[]) END",
        "ST": "CASE WHEN c <> '' THEN flatten(list_transform(range(1, CAST(len(w3) AS BIGINT) + 1), lambda i: list_transform(w3[i + 1:i + 2], lambda u: 'ST|' || c || '|' || w3[i] || '_' || u))) ELSE CAST([] AS VARCHAR[]) END",
        "W": "CASE WHEN c <> '' THEN list_transform(list_filter(w3, lambda x: length(x) >= 5), lambda x: 'W|' || c || '|' || x) ELSE CAST([] AS VARCHAR[]) END",
        "AN": "CASE WHEN c <> '' AND a <> '' THEN list_transform(list_filter(nums, lambda x: length(x) >= 3), lambda x: 'AN|' || c || '|' || x) ELSE CAST([] AS VARCHAR[]) END",
    }
    t_of = "n, a, c, cp, nt, adt, nums, keys, ng, ag, latin, lt, lg"
    both = "len(nums) > 0 AND len(t_nums) > 0"
    f = {
        "name_exact": _flag("n <> '' AND n = t_n"),
        "name_token_jaccard": _jaccard("nt", "t_nt", 1.0),
        "name_fuzz_ratio": ratio("n", "t_n"),
        "name_prefix6": _flag("length(cp) >= 6 AND length(t_cp) >= 6 AND substr(cp, 1, 6) = substr(t_cp, 1, 6)"),
        "name_prefix4": _flag("length(cp) >= 4 AND length(t_cp) >= 4 AND substr(cp, 1, 4) = substr(t_cp, 1, 4)"),
        "name_token_sort_ratio": ratio("ns", "t_ns"),
        "name_common_tokens": "CAST(len(list_intersect(nt, t_nt)) AS DOUBLE)",
        "name_common_token_ratio": _jaccard("nt", "t_nt", 1.0),
        "name_first_word_match": _flag("n <> '' AND split_part(n, ' ', 1) = split_part(t_n, ' ', 1)"),
        "address_exact": _flag("a <> '' AND a = t_a"),
        "address_token_jaccard": _jaccard("adt", "t_adt", 1.0),
        "address_fuzz_ratio": ratio("a", "t_a"),
        "address_token_sort_ratio": ratio("ads", "t_ads"),
        "numeric_jaccard": _jaccard("nums", "t_nums", 1.0),
        "country_equal": _flag("c <> '' AND c = t_c"),
        "name_length_ratio": "least(length(n), length(t_n)) / CAST(greatest(length(n), length(t_n), 1) AS DOUBLE)",
        "name_length_gap": "abs(length(n) - length(t_n)) / 100.0::DOUBLE",
        "address_length_ratio": "least(length(a), length(t_a)) / CAST(greatest(length(a), length(t_a), 1) AS DOUBLE)",
        "address_length_gap": "abs(length(a) - length(t_a)) / 200.0::DOUBLE",
        "s1_address_missing": _flag("a = ''"),
        "target_address_missing": _flag("t_a = ''"),
        "is_india": _flag("contains(c, 'india')"),
        "target_is_s2": _flag("t_source = 2"),
        "name_is_short": _flag("least(length(cp), length(t_cp)) <= 5"),
        "numeric_set_exact": _flag(f"{both} AND list_sort(nums) = list_sort(t_nums)"),
        "numeric_conflict": _flag(f"{both} AND len(list_intersect(nums, t_nums)) = 0"),
        "rare_address_overlap": "CAST(is_rare AS DOUBLE)",
        "original_route_count": "CAST(len(list_distinct(list_transform(list_intersect(keys, t_keys), lambda k: split_part(k, '|', 1)))) AS DOUBLE)",
        "name_token_containment": _contained("nt", "t_nt"),
        "address_token_containment": _contained("adt", "t_adt"),
        "name_char_trigram_jaccard": _jaccard("ng", "t_ng", 0.0),
        "address_char_trigram_jaccard": _jaccard("ag", "t_ag", 0.0),
        "name_script_mismatch": "0.0::DOUBLE",
        "transliterated_name_fuzz": ratio("latin", "t_latin"),
        "transliterated_token_jaccard": _jaccard("lt", "t_lt", 0.0),
        "transliterated_char_trigram_jaccard": _jaccard("lg", "t_lg", 0.0),
    }
    f["route_agreement_count"] = f"{f['original_route_count']} + is_rare"
    FORMULAS.update(f)
    set_base, set_a, set_b = (f"array_to_string({x}, ' ')" for x in ("co", "list_concat(co, da)", "list_concat(co, db)"))
    z = [f"{bias}::DOUBLE + " + " + ".join(f"{w}::DOUBLE * CAST({name} AS DOUBLE)" for name, w in weights.items()) for bias, weights in STAND_INS]
    used = sorted({name for _, weights in STAND_INS for name in weights} | {"numeric_conflict"})
    return {
        "e": f"SELECT doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS source, 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, array_to_string(w[greatest(len(w) - 3, 1):greatest(len(w) - 3, 1) + 3], ' ') AS business_name, array_to_string(w[5:14], ' ') || ' ' || n_chars AS business_address, coalesce(lang, '') AS country FROM (SELECT *, {_WORDS} AS w FROM documents)",
        "n": f"SELECT doc_id, source, entity_id, {_normal('business_name', True)} AS n, {_normal('business_address', True)} AS a, {_normal('country', False)} AS c FROM e",
        "r0": rf"SELECT *, replace(n, ' ', '') AS cp, list_filter(string_split(n, ' '), lambda x: x <> '') AS nt0, list_filter(string_split(a, ' '), lambda x: x <> '') AS at0, regexp_extract_all(a, '\p{{Nd}}+') AS nums0, strip_accents(n) AS latin FROM n",
        "r1": f"SELECT * EXCLUDE (nt0, at0, nums0), {_unique('nt0')} AS nt, {_unique('at0')} AS adt, {_unique('nums0')} AS nums, {_grams('n')} AS ng, {_grams('a')} AS ag, {_grams('latin')} AS lg, list_distinct(list_filter(string_split(latin, ' '), lambda x: x <> '')) AS lt, {_sorted('n')} AS ns, {_sorted('a')} AS ads, list_filter(list_sort(list_distinct(nt0)), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS w3 FROM r0",
        "r2": "SELECT *, " + ", ".join(f"{v} AS k_{k}" for k, v in key.items()) + " FROM r1",
        "r": "SELECT *, list_distinct(list_concat(" + ", ".join(f"k_{k}" for k in key) + ")) AS keys FROM r2",
        "s": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_pos, entity_id AS s1_id, * EXCLUDE (entity_id, source, doc_id) FROM r WHERE source = 1",
        "t": "SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS target_idx, * EXCLUDE (doc_id) FROM r WHERE source <> 1",
        "sk": "SELECT s1_id, unnest(keys) AS key FROM s",
        "tk": "SELECT target_idx, unnest(keys) AS key FROM t",
        "kf": "SELECT key, count(*) AS freq FROM tk GROUP BY key",
        "live": f"SELECT tk.target_idx, tk.key FROM tk JOIN kf USING (key) WHERE freq <= {config.posting_cap}",
        "base": "SELECT DISTINCT s1_id, target_idx FROM sk JOIN live USING (key)",
        "st": "SELECT s1_id, c, unnest(adt) AS token FROM s",
        "tt": "SELECT target_idx, c, unnest(adt) AS token FROM t",
        "tf": "SELECT c, token, count(*) AS freq FROM tt GROUP BY c, token",
        "chosen": f"SELECT * FROM (SELECT s1_id, c, token, freq, row_number() OVER (PARTITION BY s1_id ORDER BY freq, token) AS rank FROM st JOIN tf USING (c, token) WHERE length(token) >= {config.rare_token_length} AND freq <= {config.rare_cap}) WHERE rank <= {config.rare_tokens}",
        "pool": "SELECT DISTINCT s1_id, target_idx FROM chosen JOIN tt USING (c, token)",
        "overlap": rf"SELECT *, 2.0::DOUBLE * len(common) / greatest(1, len(adt) + len(t_adt)) AS dice FROM (SELECT s1_id, target_idx, s.a AS a, t.a AS t_a, s.adt AS adt, t.adt AS t_adt, list_intersect(s.adt, t.adt) AS common FROM pool JOIN s USING (s1_id) JOIN t USING (target_idx)) WHERE len(list_filter(common, lambda x: NOT regexp_full_match(x, '\p{{Nd}}+'))) >= {config.shared_words}",
        "enough": f"SELECT s1_id, target_idx FROM overlap WHERE dice >= {config.least_dice}::DOUBLE UNION ALL SELECT s1_id, target_idx FROM (SELECT *, {lcs('a', 't_a')} AS l FROM overlap WHERE dice < {config.least_dice}::DOUBLE) WHERE 200 * l >= {config.least_ratio} * (length(a) + length(t_a))",
        "eligible": f"SELECT s1_id, target_idx FROM (SELECT *, count(*) OVER (PARTITION BY s1_id) AS n FROM enough) WHERE n <= {config.eligible_cap}",
        "added": "SELECT * FROM eligible ANTI JOIN base USING (s1_id, target_idx)",
        "ranked": f"SELECT s1_id, target_idx, {f['numeric_conflict']} AS conflict, CAST({f['address_token_jaccard']} AS FLOAT) AS jac, CAST({f['address_fuzz_ratio']} AS FLOAT) AS adr, {f['numeric_set_exact']} AS exact, CAST({f['name_fuzz_ratio']} AS FLOAT) AS nam FROM (SELECT s1_id, target_idx, s.n AS n, s.a AS a, s.adt AS adt, s.nums AS nums, t.n AS t_n, t.a AS t_a, t.adt AS t_adt, t.nums AS t_nums FROM added JOIN s USING (s1_id) JOIN t USING (target_idx))",
        "best": f"SELECT * FROM (SELECT s1_id, target_idx, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY conflict, jac DESC, adr DESC, exact DESC, nam DESC, target_idx) AS INTEGER) AS rank FROM ranked) WHERE rank <= {config.rare_top}",
        "pairs": "SELECT s1_id, target_idx, 0 AS is_rare FROM base UNION ALL SELECT s1_id, target_idx, 1 AS is_rare FROM best",
        "p": "SELECT s1_id, target_idx, is_rare, " + ", ".join(f"s.{x} AS {x}, t.{x} AS t_{x}" for x in (t_of + ", ns, ads").split(", ")) + ", t.source AS t_source FROM pairs JOIN s USING (s1_id) JOIN t USING (target_idx)",
        "sets": "SELECT *, list_sort(list_intersect(nt, t_nt)) AS co, list_sort(list_filter(nt, lambda x: NOT list_contains(t_nt, x))) AS da, list_sort(list_filter(t_nt, lambda x: NOT list_contains(nt, x))) AS db FROM p",
        "set_texts": f"SELECT *, {set_base} AS x0, {set_a} AS xa, {set_b} AS xb FROM sets",
        "set_ratios": f"SELECT s1_id, target_idx, CASE WHEN len(nt) = 0 OR len(t_nt) = 0 THEN 0.0::DOUBLE WHEN len(co) > 0 AND (len(da) = 0 OR len(db) = 0) THEN 1.0::DOUBLE WHEN len(co) = 0 THEN {ratio('xa', 'xb')} ELSE greatest({ratio('xa', 'xb')}, {ratio('x0', 'xa')}, {ratio('x0', 'xb')}) END AS v FROM set_texts",
        "fs": "SELECT s1_id, target_idx, " + ", ".join(f"CAST({f[x]} AS FLOAT) AS {x}" for x in used) + " FROM p",
        "ps": "SELECT *, " + ", ".join(f"CAST(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))) AS FLOAT) AS p{i}" for i, x in enumerate(z)) + " FROM fs",
        "sc": "SELECT *, CAST((((p0 + p1) + p2) + p3) / CAST(4 AS FLOAT) AS FLOAT) AS score FROM ps",
        "ok": f"SELECT * FROM sc WHERE score >= CASE WHEN numeric_conflict > 0 THEN CAST({config.conflict_threshold} AS FLOAT) ELSE CAST({config.threshold} AS FLOAT) END",
        "m": f"SELECT * FROM (SELECT s1_id, target_idx, score, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_idx DESC) AS INTEGER) AS rank FROM ok) WHERE rank <= {config.most_matches}",
        "cl": "SELECT row_pos, s1_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM s LEFT JOIN (SELECT s1_id, string_agg(entity_id, ',' ORDER BY target_idx) AS ids FROM pairs JOIN t USING (target_idx) GROUP BY s1_id) USING (s1_id)",
        "ml": "SELECT row_pos, s1_id AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM s LEFT JOIN (SELECT s1_id, string_agg(entity_id, ',' ORDER BY rank) AS ids FROM m JOIN t USING (target_idx) GROUP BY s1_id) USING (s1_id)",
    }


#: SQL of each feature, over the step "p".
FORMULAS: dict[str, str] = {}
_steps(DEFAULT)
assert set(FORMULAS) | {"name_token_set_ratio", "name_partial_ratio"} == set(FEATURES)


def statement(select: str, config: Config = DEFAULT) -> str:
    """A whole statement around `select`, with the steps that it needs."""
    import re

    steps, needed, names = _steps(config), set(), set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", select))
    while names:
        needed |= names
        names = {x for n in names for x in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", steps.get(n, "")) if x in steps} - needed
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in steps.items() if n in needed) + f" {select}"
