"""Blocking keys, their frequencies, and candidates that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import compact, numbers, significant, tokens

ROUTES = ("E", "P6", "P4", "ST", "W", "AN")
#: Keys over the cap that are left out before any shuffle of postings: the most frequent ones, at most this many.
HOTTEST = 1000


def _none() -> Column:
    return F.array().cast("array<string>")


def route_keys(route: str, n: Column, a: Column, c: Column) -> Column:
    """Keys ROUTE|country|value of one route; none without a country, or without name (AN: address)."""
    prefix = F.concat(F.lit(f"{route}|"), c, F.lit("|"))
    one = lambda value: F.array(F.concat(prefix, value))
    short = compact(n)
    if route == "E":
        found = one(n)
    elif route in ("P6", "P4"):
        size = int(route[1])
        found = F.when(F.length(short) >= size, one(F.substring(short, 1, size))).otherwise(_none())
    elif route == "ST":
        words = F.filter(significant(n), lambda t: F.length(t) >= 3)
        found = F.flatten(F.transform(words, lambda t, i: F.transform(F.slice(words, i + 2, F.lit(2)), lambda u: F.concat(prefix, t, F.lit("_"), u))))
    elif route == "W":
        found = F.transform(F.filter(significant(n), lambda t: F.length(t) >= 5), lambda t: F.concat(prefix, t))
    else:
        found = F.transform(F.filter(numbers(a), lambda t: F.length(t) >= 3), lambda t: F.concat(prefix, t))
    return F.when((c != "") & ((a if route == "AN" else n) != ""), found).otherwise(_none())


def all_keys(n: Column, a: Column, c: Column) -> Column:
    return F.array_distinct(F.concat(*[route_keys(r, n, a, c) for r in ROUTES]))


def exploded(rows: DataFrame, id: str) -> DataFrame:
    """(id, key) of rows with n, a, c, or with their keys already there."""
    keys = F.col("keys") if "keys" in rows.columns else all_keys(F.col("n"), F.col("a"), F.col("c"))
    return rows.select(id, F.explode(keys).alias("key"))


def frequencies(target_keys: DataFrame) -> DataFrame:
    return target_keys.groupBy("key").agg(F.count("*").alias("freq"))


def capped(target_keys: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Postings of keys that at most posting_cap targets have; other keys go whole.

    The hottest of those are left out by broadcast, so that their postings never meet in one task.
    """
    freq = frequencies(target_keys)
    hot = freq.where(F.col("freq") > config.posting_cap).orderBy(F.col("freq").desc(), "key").limit(HOTTEST).select("key")
    rest = target_keys.join(F.broadcast(hot), "key", "left_anti")
    return rest.join(freq.where(F.col("freq") <= config.posting_cap).select("key"), "key", "left_semi")


def baseline(s1: DataFrame, targets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Distinct (s1_id, target_idx) that share a key within the cap."""
    live = capped(exploded(targets, "target_idx"), config)
    return exploded(s1, "s1_id").join(live, "key").select("s1_id", "target_idx").distinct()


def shared_routes(keys: Column, target_keys: Column) -> Column:
    """Number of routes among shared keys, those over the cap included."""
    return F.size(F.array_distinct(F.transform(F.array_intersect(keys, target_keys), lambda k: F.substring_index(k, "|", 1))))


def prepared(rows: DataFrame) -> DataFrame:
    """rows with their keys and token sets, computed once per record and not once per pair."""
    n, a, c = F.col("n"), F.col("a"), F.col("c")
    return rows.withColumns({"keys": all_keys(n, a, c), "nt": tokens(n), "at": tokens(a), "nums": numbers(a)})
