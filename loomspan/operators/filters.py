"""Filters of usages, names, endpoints and planned work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in a name that announce planned work.
PLANNED_NAMES = "(?i)new|upcoming|planned|future|next|v[0-9]+|version[0-9]+"


def _trusted(rules: list[tuple[str, str]]) -> Column:
    """Whether (object, member) is trusted; one alternation for each member, so that a row is tested against its own member's patterns only."""
    by_member: dict[str, list[str]] = {}
    for pattern, member in rules:
        by_member.setdefault(member, []).append(pattern)
    out = F.lit(False)
    for member, patterns in by_member.items():
        out = out | ((F.col("member") == member) & F.col("object").rlike("|".join(f"(?:{p})" for p in patterns)))
    return out


def trusted_members(usages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Usages ``(object, member)`` that no rule (object pattern, member) trusts; the rule list is configuration."""
    return usages.where(~F.coalesce(_trusted(rules), F.lit(False)))


def trusted_stats(usages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    return usages.groupBy("member").agg(F.count("*").alias("total"), F.count_if(_trusted(rules)).alias("dropped"))


def builtins_filter(usages: DataFrame, builtins: DataFrame, on: list[str]) -> DataFrame:
    """Usages whose names are not built in."""
    return usages.join(builtins.select(*on), on, "left_anti")


def planned_feature(uncommitted: Column, todo: Column, stub: Column, branch: Column, name: Column, extra: str = "") -> tuple[Column, Column]:
    """Whether signals say that something is planned, and with what confidence: two signals, or one that is a to-do note; a planned name counts half."""
    signals = sum((c.cast("int") for c in (uncommitted, todo, stub, branch)), F.lit(0)) + F.when(name.rlike(PLANNED_NAMES + extra), 0.5).otherwise(0.0)
    return (signals >= 2) | ((signals >= 1) & todo), F.least(F.lit(95.0), 60 + signals * 15)


def endpoint_lookup(requests: DataFrame, routes: DataFrame, on: list[str]) -> DataFrame:
    """Requests with ``found``: whether a route has their key."""
    return requests.join(routes.select(*on).distinct().withColumn("__route", F.lit(True)), on, "left").withColumn("found", F.col("__route").isNotNull()).drop("__route")


def names_matching(symbols: DataFrame, pattern: str, kinds: list[str] | None = None) -> DataFrame:
    out = symbols.where(F.col("name").rlike(pattern))
    return out.where(F.col("kind").isin(kinds)) if kinds else out
