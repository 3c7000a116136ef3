"""Licence scans with a positional index of rare licence words, in DataFrame functions only.

Templates are known notices with the phrases they must hold. Over all documents, the document frequency of every template
word gives its IDF; the index keeps, of each template, the ANCHORS highest-IDF words of its mandatory phrases with their
positions. A file looks up its own highest-IDF licence words, intersects their postings by relative position, and each
alignment left is verified: every mandatory phrase in its place, and SHARE of the template's words in theirs.

All of it runs inside the row, so there is no shuffle but that of the word counts (as many rows as licence words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Label, words of the notice, phrases it must hold.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
]
#: A phrase of the base rule ends in "license"; the words before it, and its label.
BASE = [(("mit",), "mit"), (("apache",), "apache"), (("general", "public"), "gpl")]

ANCHORS = 4
SHARE = 0.8
#: A file's highest-IDF licence words that are looked up; more than the index has words, so none is left out.
LOOK_UP = ANCHORS * len(TEMPLATES)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _mandatory(notice: list[str], phrases: list[str]) -> dict[int, str]:
    """Positions in the notice that a match must have right, with their words."""
    found = {}
    for phrase in map(str.split, phrases):
        at = next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)
        found |= {at + j: w for j, w in enumerate(phrase)}
    return found


def word_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Number of documents with each template word, over all documents; at most as many rows as the templates have words."""
    known = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    present = F.array_intersect(words(F.col(text)), F.array(*map(F.lit, known)))
    counts = docs.select(F.explode(present).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def _index(frequencies: dict[str, int]) -> list[dict]:
    """Templates with their anchors, rarest first."""
    out = []
    for label, notice, phrases in TEMPLATES:
        must = _mandatory(notice.split(), phrases)
        first = {}
        for at, word in sorted(must.items()):
            first.setdefault(word, at)
        anchors = sorted(first, key=lambda w: (frequencies.get(w, 0), w))[:ANCHORS]
        out.append({"label": label, "words": notice.split(), "must": sorted(must.items()), "anchors": [(w, first[w]) for w in anchors]})
    return out


def _alignments(w: Column, top: Column, template: dict) -> Column:
    """Shares of the template's words in place, one for each verified alignment."""
    n = len(template["words"])
    known = F.array(*[F.struct(F.lit(a).alias("w"), F.lit(o).alias("o")) for a, o in template["anchors"]])
    held = F.filter(known, lambda a: F.array_contains(top, a["w"]))
    one, two = F.get(held, F.lit(0)), F.get(held, F.lit(1))
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == one["w"])
    starts = F.transform(places, lambda i: i - one["o"])
    second = F.filter(starts, lambda d: two.isNull() | (F.get(w, d + two["o"]) == two["w"]))

    def verified(d: Column) -> Column:
        ok = F.lit(True)
        for at, word in template["must"]:
            ok = ok & (F.get(w, d + F.lit(at)) == word)
        return ok

    def share(d: Column) -> Column:
        return sum((F.when(F.get(w, d + F.lit(i)) == x, 1).otherwise(0) for i, x in enumerate(template["words"])), F.lit(0)) / F.lit(float(n))

    shares = F.filter(F.transform(F.filter(second, verified), share), lambda s: s >= SHARE)
    found = F.when(F.size(held) >= 2, shares) if len(template["anchors"]) >= 2 else F.when(F.size(held) >= 1, shares)
    return F.coalesce(found, F.array().cast("array<double>"))


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Null text is empty: no words, null places, empty labels, score 0. score is the best share of a verified notice's
    words in place; a file that the base rule alone labels has 0.5. Repeated rows are scanned alike.
    """
    frequencies = word_frequencies(docs, text)
    index = _index(frequencies)
    by_idf = sorted({a for t in index for a, _ in t["anchors"]}, key=lambda a: (frequencies.get(a, 0), a))
    rows = docs.select(F.col(id).alias("doc_id"), words(F.col(text)).alias("w"))
    w = F.col("w")
    rows = rows.select("*", F.slice(F.array_intersect(F.array(*map(F.lit, by_idf)), w), 1, LOOK_UP).alias("top"))
    at = F.when(F.array_contains(w, "license"), F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == "license"))

    def base(i: Column) -> Column:
        hit = F.lit(None).cast("struct<label:string,start:int>")
        for before, label in BASE:
            match = F.lit(True)
            for back, word in enumerate(reversed(before), 1):
                match = match & (F.get(w, i - back) == word)
            hit = F.when(match, F.struct(F.lit(label).alias("label"), (i - len(before)).cast("int").alias("start"))).otherwise(hit)
        return hit

    hits = F.filter(F.transform(F.coalesce(at, F.array().cast("array<int>")), base), lambda h: h.isNotNull())
    found = [F.when(F.size("top") >= 1, _alignments(w, F.col("top"), t)).otherwise(F.array().cast("array<double>")) for t in index]
    kept = rows.select("doc_id", F.size(w).cast("long").alias("n_words"), hits.alias("hits"), *[f.alias(f"t{i}") for i, f in enumerate(found)])
    labels = F.concat(F.col("hits.label"), *[F.when(F.size(f"t{i}") > 0, F.array(F.lit(t["label"]))).otherwise(F.array().cast("array<string>")) for i, t in enumerate(index)])
    best = F.array_max(F.concat(*[F.col(f"t{i}") for i in range(len(index))]))
    text_of = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return kept.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_base"),
        F.array_min(F.col("hits.start")).cast("long").alias("first_word"), F.array_max(F.col("hits.start")).cast("long").alias("last_word"),
        text_of(F.col("hits.label")).alias("base_labels"), text_of(labels).alias("labels"),
        F.coalesce(best, F.when(F.size("hits") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _template_rows() -> str:
    rows = []
    for t, (label, notice, phrases) in enumerate(TEMPLATES):
        must = _mandatory(notice.split(), phrases)
        rows += [f"({t}, '{label}', {i}, '{w}', {int(i in must)}, {len(notice.split())}, {len(must)})" for i, w in enumerate(notice.split())]
    return ", ".join(rows)


OP6_SQL = rf"""
WITH t(t, label, o, word, must, n, n_must) AS (VALUES {_template_rows()}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
a AS (SELECT doc_id, t, label, i - o AS at, count(*) AS hits, sum(must) AS musts, any_value(n) AS n, any_value(n_must) AS n_must
      FROM p JOIN t USING (word) GROUP BY doc_id, t, label, i - o HAVING sum(must) = any_value(n_must)),
m AS (SELECT doc_id, label, hits / CAST(n AS DOUBLE) AS share FROM a WHERE hits / CAST(n AS DOUBLE) >= {SHARE}),
q AS (SELECT doc_id, word AS w2, i, lag(word, 1) OVER s AS w1, lag(word, 2) OVER s AS w0 FROM p WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, CASE WHEN w1 = 'mit' THEN 'mit' WHEN w1 = 'apache' THEN 'apache' ELSE 'gpl' END AS label, CASE WHEN w1 = 'public' THEN i - 2 ELSE i - 1 END AS start
      FROM q WHERE w2 = 'license' AND (w1 IN ('mit', 'apache') OR (w1 = 'public' AND w0 = 'general'))),
bs AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
ms AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN ms USING (doc_id)
"""
