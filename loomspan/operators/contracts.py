"""Callers against providers: endpoints, fields, parameters, operations, events. ``keys`` names the columns that tell projects apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import scalars as S
from loomspan.operators.tables import written

Keys = tuple[str, ...]

# Type names of the two sides that fit each other.
COMPATIBLE = {"string": "str string text email uuid", "number": "int float integer", "boolean": "bool boolean", "any": "any", "unknown": "any"}


def match_endpoints(services: DataFrame, routes: DataFrame, keys: Keys = (), methods: bool = False) -> DataFrame:
    """``services(service, method, path)`` with ``route``, ``route_method``, ``tier`` and ``score``.

    Tiers: 1 same path and method, 2 without the API prefix, 3 with parameters made generic, 4 both, 5-8 the same
    paths with another method. Each tier is one equi join on a derived key; a service keeps its first tier, and in it
    the first route by path and method. Another method scores 50, the same 100. Services without a match stay. With
    ``methods`` also ``other_methods``, the sorted methods of the route's path besides the service's own.
    """
    ways = (lambda p: S.normalize_path(p), lambda p: S.strip_api_prefix(p), lambda p: S.generic_params(S.normalize_path(p)), lambda p: S.generic_params(S.strip_api_prefix(p)))
    r = routes.select(*keys, F.col("path").alias("route"), F.upper("method").alias("route_method")).distinct()
    parts = None
    for i, way in enumerate(ways):
        left = services.select(*keys, "service", F.upper("method").alias("m"), way(F.col("path")).alias("k"))
        pairs = left.join(r.withColumn("k", way(F.col("route"))), [*keys, "k"])
        tier = F.when(F.col("m") == F.col("route_method"), i + 1).otherwise(i + 5)
        part = pairs.select(*keys, "service", F.struct(tier.alias("tier"), F.col("route"), F.col("route_method")).alias("hit"))
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy(*keys, "service").agg(F.min("hit").alias("hit"))
    out = services.join(best, [*keys, "service"], "left")
    score = F.when(F.col("hit").isNull(), 0).when(F.col("hit.tier") <= 4, 100).otherwise(50)
    out = out.select(*services.columns, "hit.route", "hit.route_method", "hit.tier", score.alias("score"))
    if not methods:
        return out
    of_path = r.groupBy(*keys, "route").agg(F.array_sort(F.collect_set("route_method")).alias("__all"))  # as many as there are methods
    others = F.coalesce(F.array_remove("__all", F.upper("method")), F.array().cast("array<string>"))
    return out.join(of_path, [*keys, "route"], "left").select(*out.columns, others.alias("other_methods"))


def unmatched_routes(routes: DataFrame, matches: DataFrame, services: DataFrame, keys: Keys = ()) -> DataFrame:
    """Routes that no service chose, whose first segment services use, and whose path no service has exactly; none without services."""
    chosen = matches.where("route is not null").select(*keys, F.col("route").alias("path"), F.col("route_method").alias("method")).distinct()
    root = lambda c: F.substring_index(S.strip_api_prefix(F.col(c)), "/", 1)
    used = services.select(*keys, root("path").alias("root")).distinct()
    strict = services.select(*keys, S.normalize_path(F.col("path")).alias("strict")).distinct()
    left = routes.join(chosen, [*keys, "path", "method"], "left_anti").withColumn("root", root("path")).join(used, [*keys, "root"], "left_semi")
    return left.withColumn("strict", S.normalize_path(F.col("path"))).join(strict, [*keys, "strict"], "left_anti").select(*routes.columns)


def unregistered_routes(unmatched: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(method, path, file, severity, confidence)``: unmatched routes ``(method, path, file)`` that a file in a routes directory defines outside the API prefix: their router is likely mounted nowhere."""
    inside = F.translate("file", "\\", "/").rlike("/routes/")
    path = S.normalize_path(F.col("path"))
    return unmatched.where(inside & (path != "api") & ~path.startswith("api/")).select(*keys, "method", "path", "file", F.lit("high").alias("severity"), F.lit(85).alias("confidence"))


#: Letters of the stretches by which a segment is looked for in longer ones, and how much longer each prefix is than the one before.
GRAM, GROWTH = 3, 1.25


def _prefix_sizes(longest: int) -> list[int]:
    """1, 2, 3, ... growing by ``GROWTH``, up to the longest."""
    sizes, n = [], 1
    while n <= longest:
        sizes.append(n)
        n = max(n + 1, int(n * GROWTH))
    return sizes


def similar_candidates(x: DataFrame, y: DataFrame, least: float, keys: Keys = ()) -> DataFrame:
    """``(a, b)``: pairs of the distinct segments of ``x(a)`` and ``y(b)`` that may have a similarity of ``least`` or more; no such pair is missing.

    Similar segments are of one of three kinds, each of which has its own index, linear in a segment's length:

    - one holds the other: it then holds its rarest stretch of ``GRAM`` letters (a shorter one as a whole);
    - they begin alike: with p letters in common p is at least ``least`` of the shorter, so they share the longest prefix of
      a growing row of sizes that is no longer than that;
    - few edits part them: e edits, at most 1 - ``least`` of the longer length n, leave n - 1 - 2 e of its pairs of
      neighbouring letters. So if each segment's pairs are sorted by how rare they are, the first ones, all but as many
      as must be shared and one more, have one in common, no more than e places apart. Whoever meets so must then
      share that many pairs of letters in all.
    """
    own = x.select(*keys, F.col("a").alias("s"), F.lit(0).alias("side")).unionByName(y.select(*keys, F.col("b").alias("s"), F.lit(1).alias("side"))).where("s <> ''").distinct()
    own = own.withColumn("low", F.lower("s")).withColumn("n", F.char_length("low"))
    longest = own.agg(F.max("n").alias("n")).first()["n"] or 0
    sides = lambda df, *more: (df.where("side = 0").select(*keys, F.col("s").alias("a"), *(F.col(c).alias(f"{c}_a") for c in more), "key"), df.where("side = 1").select(*keys, F.col("s").alias("b"), *(F.col(c).alias(f"{c}_b") for c in more), "key"))
    grams = lambda size: F.when(F.col("n") >= size, F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.substring("low", i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    both_ways = lambda whole, parts: whole[0].join(parts[1], [*keys, "key"]).select(*keys, "a", "b").unionByName(parts[0].join(whole[1], [*keys, "key"]).select(*keys, "a", "b"))

    held = written(own.select(*keys, "s", "side", "n", F.explode(F.array_distinct(F.concat(*(grams(i) for i in range(1, GRAM + 1))))).alias("key")), "grams")
    rare = held.where(F.char_length("key") == F.least(F.lit(GRAM), F.col("n")))
    rarest = rare.join(rare.groupBy(*keys, "key").agg(F.count("*").alias("df")), [*keys, "key"]).groupBy(*keys, "s", "side").agg(F.min_by("key", F.struct("df", "key")).alias("key"))
    met = both_ways(sides(rarest), sides(held))

    sizes = F.array(*map(F.lit, _prefix_sizes(longest) or [1]))
    begins = own.select(*keys, "s", "side", F.explode(F.transform(F.filter(sizes, lambda k: k <= F.col("n")), lambda k: F.substring("low", F.lit(1), k))).alias("key"))
    first = F.ceil(F.round(least * F.col("n"), 9)).cast("int")
    begin = own.select(*keys, "s", "side", F.substring("low", F.lit(1), F.array_max(F.filter(sizes, lambda k: k <= first))).alias("key"))
    met = met.unionByName(both_ways(sides(begin), sides(begins)))

    pairs = written(own.where("n > 1").select(*keys, "s", "side", "n", F.posexplode(grams(2)).alias("pos", "key")), "pairs")
    count = pairs.groupBy(*keys, "key").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy(*keys, "s", "side", "key").orderBy("pos"))
    place = F.row_number().over(Window.partitionBy(*keys, "s", "side").orderBy("df", "key", "pos"))
    must = F.greatest(F.lit(1), F.ceil(F.round((2 * least - 1) * F.col("n") - 1, 9)))
    ranked = pairs.join(count, [*keys, "key"]).withColumn("place", place).where(F.col("place") <= F.col("n") - 1 - must + 1)
    u, v = sides(ranked, "n", "pos")
    edits = F.floor(F.round((1 - least) * F.greatest("n_a", "n_b"), 9))
    close = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") - edits) & (F.abs(F.col("pos_a") - F.col("pos_b")) <= edits)
    near = u.join(v, [*keys, "key"]).where(close).select(*keys, "a", "b", "n_a", "n_b").distinct()
    bag = pairs.withColumn("nth", nth).groupBy(*keys, "s", "side").agg(F.collect_set(F.struct("key", "nth")).alias("bag"))  # no longer than the segment
    of = lambda side, name: bag.where(f"side = {side}").select(*keys, F.col("s").alias(name), F.col("bag").alias(f"bag_{name}"))
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    near = near.join(of(0, "a"), [*keys, "a"]).join(of(1, "b"), [*keys, "b"]).where(shared >= F.greatest("n_a", "n_b") - 1 - 2 * edits).select(*keys, "a", "b")
    return met.unionByName(near).distinct()


def _alike_segments(x: DataFrame, y: DataFrame, least: float, keys: Keys = ()) -> DataFrame:
    """``(a, b)``: the distinct segments of ``x(a)`` and ``y(b)`` that are equal or have a similarity of ``least`` or more."""
    near = similar_candidates(x, y, least, keys).where((F.col("a") == F.col("b")) | (S.segment_similarity(F.col("a"), F.col("b")) >= least)).select(*keys, "a", "b")
    empty = x.where("a = ''").select(*keys, "a").distinct().join(y.where("b = ''").select(*keys, "b").distinct().withColumn("a", F.lit("")), [*keys, "a"])
    return near.unionByName(empty.select(*keys, "a", "b")).distinct()


def similar_route(services: DataFrame, routes: DataFrame, least: float = 0.7, keys: Keys = ()) -> DataFrame:
    """``(service, route, similarity, same_path)``: the nearest route with as many segments.

    The same path counts 1; else segments score 1 if equal, 0.6 against a parameter, their similarity from 0.5 on, and
    the mean must reach ``least``. So one segment at least must, and paths meet only where they have alike segments at
    the same place; these are found once among the distinct segments.
    """
    split = lambda c: F.split(S.strip_api_prefix(F.col(c)), "/")
    a = services.select(*keys, "service", S.strip_api_prefix(F.col("path")).alias("p"), split("path").alias("x")).withColumn("n", F.size("x"))
    b = routes.select(*keys, F.col("path").alias("route")).distinct().select(*keys, "route", S.strip_api_prefix(F.col("route")).alias("q"), split("route").alias("y")).withColumn("n", F.size("y"))
    param = lambda s: s.rlike(r"^[{<:$]")

    def score(x, y):
        near = S.segment_similarity(x, y)
        return F.when(x == y, 1.0).when(param(x) | param(y), 0.6).when(near >= 0.5, near).otherwise(0.0)

    mean = F.aggregate(F.zip_with("x", "y", score), F.lit(0.0), lambda acc, v: acc + v) / F.col("n")
    paths, targets = a.select(*keys, "p", "x", "n").distinct(), b.select(*keys, "q", "y", "n").distinct()
    at_x, at_y = paths.select(*keys, "p", "n", F.posexplode("x").alias("at", "a")), targets.select(*keys, "q", "n", F.posexplode("y").alias("at", "b"))
    alike = _alike_segments(at_x.select(*keys, "a").distinct(), at_y.select(*keys, "b").distinct(), least, keys)
    met = at_x.join(alike, [*keys, "a"]).join(at_y, [*keys, "n", "at", "b"]).select(*keys, "p", "q").distinct()
    scored = met.join(paths, [*keys, "p"]).join(targets.drop("n"), [*keys, "q"]).withColumn("similarity", F.when(F.col("p") == F.col("q"), 1.0).otherwise(F.round(mean, 9))).where(F.col("similarity") >= least).select(*keys, "p", "q", "similarity")
    best = scored.join(b.select(*keys, "q", "route"), [*keys, "q"]).groupBy(*keys, "p").agg(F.min_by(F.struct("route", "similarity", (F.col("p") == F.col("q")).alias("same_path")), F.struct(-F.col("similarity"), F.col("route"))).alias("b"))
    return a.select(*keys, "service", "p").join(best, [*keys, "p"]).select(*keys, "service", "b.*")


def unmatched_services(matches: DataFrame, similar: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(service, finding, severity, confidence)`` of services without a route, by what is near: the same path (methodMismatch), another (pathMismatch), nothing (notFound)."""
    open_ = matches.where("route is null or tier > 4").select(*keys, "service", F.col("route").alias("other"))
    joined = open_.join(similar.select(*keys, "service", F.col("route").alias("near"), "same_path"), [*keys, "service"], "left")
    method = F.col("other").isNotNull() | F.coalesce("same_path", F.lit(False))
    path = F.col("near").isNotNull()
    pick = lambda m, p, n: F.when(method, m).when(path, p).otherwise(n)
    return joined.select(*keys, "service", pick("methodMismatch", "pathMismatch", "notFound").alias("finding"), pick("critical", "high", "critical").alias("severity"), pick(95, 90, 95).alias("confidence"))


def match_models(fields: DataFrame, least_same: float = 0.1, least: float = 0.7, keys: Keys = ()) -> DataFrame:
    """``(owner, model, tier, overlap)`` from ``fields(owner, side, field)``, side 0 the callers' types, side 1 the models.

    Tier 1 is the same name, 2 the same without case and underscores, both with an overlap of fields of at least
    ``least_same`` where both have fields; tier 3 the largest overlap above ``least``. A null field names a type whose
    fields are unknown; it matches by name alone, with overlap 0. Types meet by name, and for tier 3 by one of their
    rarest fields: two with an overlap above ``least`` share one among the first ``n - ceil(least * n) + 1`` of each,
    so that fields that all types have bring no pairs.
    """
    norm = S.normalize_name(F.col("field"), hyphens=True)
    every = written(fields.select(*keys, "owner", "side", norm.alias("f")).distinct(), "fields")
    own = every.where("f is not null")
    types = written(every.groupBy(*keys, "owner", "side").agg(F.count("f").alias("n")), "types")
    alike = S.normalize_name(F.col("owner"), True)
    front, back = (types.where(f"side = {i}").select(*keys, F.col("owner").alias(c), F.col("n").alias(k), alike.alias("name")) for i, c, k in ((0, "owner", "a"), (1, "model", "b")))
    by_name = front.join(back, [*keys, "name"]).select(*keys, "owner", "model")
    place = F.row_number().over(Window.partitionBy(*keys, "owner", "side").orderBy("df", "f"))
    first = own.join(own.groupBy(*keys, "f").agg(F.count("*").alias("df")), [*keys, "f"]).join(types, [*keys, "owner", "side"]).withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(least * F.col("n")) + 1)
    by_field = first.where("side = 0").select(*keys, "owner", "f").join(first.where("side = 1").select(*keys, F.col("owner").alias("model"), "f"), [*keys, "f"]).select(*keys, "owner", "model")
    met = written(by_name.unionByName(by_field).distinct(), "met")
    common = met.join(own.where("side = 0").select(*keys, "owner", "f"), [*keys, "owner"]).join(own.where("side = 1").select(*keys, F.col("owner").alias("model"), "f"), [*keys, "model", "f"]).groupBy(*keys, "owner", "model").agg(F.count("*").alias("c"))
    sized = met.join(common, [*keys, "owner", "model"], "left").fillna(0, ["c"]).join(front.select(*keys, "owner", "a"), [*keys, "owner"]).join(back.select(*keys, "model", "b"), [*keys, "model"])
    both = (F.col("a") > 0) & (F.col("b") > 0)
    scored = sized.withColumn("overlap", F.when(both, F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).otherwise(0.0))
    fits = ~both | (F.col("overlap") >= least_same)
    named = S.normalize_name(F.col("owner"), True) == S.normalize_name(F.col("model"), True)
    tier = F.when((F.col("owner") == F.col("model")) & fits, 1).when(named & fits, 2).when(F.col("overlap") > least, 3)
    rank = F.row_number().over(Window.partitionBy(*keys, "owner").orderBy("tier", F.desc("overlap"), "model"))
    return scored.withColumn("tier", tier).where("tier is not null").withColumn("r", rank).where("r = 1").select(*keys, "owner", "model", "tier", "overlap")


def type_problem(left: Column, right: Column) -> Column:
    """Null for fitting types, else struct<severity, problem>: of a caller's type and a provider's."""
    a, b = F.lower(left), F.lower(right)
    known = F.lit(False)
    for name, others in COMPATIBLE.items():
        known = known | ((a == name) & b.isin(*others.split()))
    make = lambda severity, problem: F.struct(F.lit(severity).alias("severity"), F.lit(problem).alias("problem"))
    bad = F.when((b == "uuid") & (a != "string"), make("medium", "uuid")).when((b == "decimal") & (a == "number"), make("medium", "decimal"))
    bad = bad.when(b.isin("datetime", "date") & (a != "string"), make("high", "datetime")).when(a.contains("[]") & ~b.contains("list"), make("high", "array"))
    return F.when(~known, bad)


def field_diff(pairs: DataFrame, fields: DataFrame, differ=None, keys: Keys = ()) -> DataFrame:
    """``(owner, model, field, finding, severity, confidence)`` of matched pairs: missing required fields, other naming, other types, extra fields.

    ``fields(owner, side, field, ftype, required)``; names meet in normal form. ``differ`` tells types apart.
    """
    differ = differ or (lambda a, b: a != b)
    norm = S.normalize_name(F.col("field"), hyphens=True).alias("f")
    front = pairs.join(fields.where("side = 0").select(*keys, "owner", norm, F.col("field").alias("a"), F.col("ftype").alias("at")), [*keys, "owner"]).select(*keys, "owner", "model", "f", "a", "at")
    back = pairs.join(fields.where("side = 1").select(*keys, F.col("owner").alias("model"), norm, F.col("field").alias("b"), F.col("ftype").alias("bt"), "required"), [*keys, "model"]).select(*keys, "owner", "model", "f", "b", "bt", "required")
    both = front.join(back, [*keys, "owner", "model", "f"], "full")
    naming = (F.col("a") != F.col("b")) & (S.naming_convention(F.col("a")) != S.naming_convention(F.col("b")))
    row = lambda when, finding, severity, confidence: F.when(when, F.struct(F.lit(finding).alias("finding"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = F.array(
        row(F.col("a").isNull() & (F.col("required") == 1), "missingRequired", "high", 95), row(here & naming, "namingMismatch", "medium", 90),
        row(here & differ(F.col("at"), F.col("bt")), "typeMismatch", "medium", 85), row(F.col("b").isNull(), "extraField", "low", 70),
    )
    return both.select(*keys, "owner", "model", F.col("f").alias("field"), F.explode(F.array_compact(rows)).alias("x")).select(*keys, "owner", "model", "field", "x.*")


def compatibility_score(pairs: DataFrame, diff: DataFrame, per_type: int = 10, keys: Keys = ()) -> DataFrame:
    """``(owner, model, score)``: 100 less 15 a missing required field, 5 a naming mismatch, ``per_type`` a type mismatch; at least 0."""
    points = F.when(F.col("finding") == "missingRequired", 15).when(F.col("finding") == "namingMismatch", 5).when(F.col("finding") == "typeMismatch", per_type).otherwise(0)
    lost = diff.groupBy(*keys, "owner", "model").agg(F.sum(points).alias("lost"))
    return pairs.select(*keys, "owner", "model").join(lost, [*keys, "owner", "model"], "left").select(*keys, "owner", "model", F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).alias("score"))


def field_coverage(pairs: DataFrame, fields: DataFrame, problems: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(owner, model, coverage, score)``: common over the larger number of fields; 100, less 20 below 0.8, less 10 a problem."""
    norm = S.normalize_name(F.col("field"), hyphens=True).alias("f")
    own = lambda side, name: pairs.join(fields.where(f"side = {side}").select(*keys, F.col("owner").alias(name), norm).distinct(), [*keys, name]).select(*keys, "owner", "model", "f")
    marked = own(0, "owner").withColumn("s", F.lit(0)).unionByName(own(1, "model").withColumn("s", F.lit(1))).groupBy(*keys, "owner", "model", "f").agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b"))
    counts = marked.groupBy(*keys, "owner", "model").agg((F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.greatest(F.count_if(F.col("a") > 0), F.count_if(F.col("b") > 0))).alias("coverage"))
    bad = problems.groupBy(*keys, "owner", "model").agg(F.count("*").alias("n"))
    score = 100 - F.when(F.col("coverage") < 0.8, 20).otherwise(0) - 10 * F.coalesce("n", F.lit(0))
    return counts.join(bad, [*keys, "owner", "model"], "left").select(*keys, "owner", "model", "coverage", F.greatest(F.lit(0), score).cast("long").alias("score"))


def query_param_diff(sent: DataFrame, declared: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(endpoint, param, finding)`` of ``sent(endpoint, param, ptype)`` and ``declared(endpoint, param, ptype, required)``: missing required, extra where anything is declared, other type."""
    both = sent.select(*keys, "endpoint", "param", F.col("ptype").alias("a"), F.lit(True).alias("in_a")).join(declared.select(*keys, "endpoint", "param", F.col("ptype").alias("b"), "required", F.lit(True).alias("in_b")), [*keys, "endpoint", "param"], "full")
    some = declared.select(*keys, "endpoint").distinct().withColumn("any", F.lit(True))
    called = sent.select(*keys, "endpoint").distinct().withColumn("called", F.lit(True))
    finding = F.when(F.col("in_a").isNull() & F.col("required") & F.col("called"), "missingParam").when(F.col("in_b").isNull() & F.col("any"), "extraParam").when(F.col("a") != F.col("b"), "typeMismatch")
    return both.join(some, [*keys, "endpoint"], "left").join(called, [*keys, "endpoint"], "left").select(*keys, "endpoint", "param", finding.alias("finding")).where("finding is not null")


def path_compat(matches: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(service, finding)`` of matched services: other method, other segments, parameters missing or too many, and a method that the name doesn't suggest.

    ``matches(service, name, method, path, route, route_method)``.
    """
    mine, theirs = S.path_params(F.col("path")), S.path_params(F.col("route"))
    x, y = F.split(S.strip_api_prefix(F.col("path")), "/"), F.split(S.strip_api_prefix(F.col("route")), "/")
    param = lambda s: s.rlike(r"^[{<:$]")
    same = F.when(F.size(x) == F.size(y), F.forall(F.zip_with(x, y, lambda a, b: (a == b) | param(a) | param(b)), lambda v: v)).otherwise(False)
    inferred = S.infer_method(F.col("name"))
    rows = F.array(
        F.when(F.upper("method") != F.upper("route_method"), "methodMismatch"), F.when(~same, "pathMismatch"), F.when(F.size(mine) < F.size(theirs), "missingParam"),
        F.when(F.size(mine) > F.size(theirs), "extraParam"), F.when(inferred != F.upper("method"), "suspiciousMethod"),
    )
    return matches.where("route is not null").select(*keys, "service", F.explode(F.array_compact(rows)).alias("finding"))


def double_prefix(services: DataFrame, sources: DataFrame, keys: Keys = ()) -> DataFrame:
    """Services whose path begins with ``api/`` while a base URL in their file (``sources(file, content)``) ends in ``/api``."""
    ends = sources.where(F.col("content").rlike(r"""(?i)base_?url["']?\s*[:=]\s*["'`][^"'`]*/api/?["'`]""")).select(*keys, "file")
    return services.where(S.normalize_path(F.col("path")).rlike("^api(/|$)")).join(ends.distinct(), [*keys, "file"], "left_semi")


def graphql_contract(operations: DataFrame, schema_operations: DataFrame, selections: DataFrame, schema_fields: DataFrame, variables: DataFrame, arguments: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(operation, score, found)``: 0 if the schema lacks it, else 100 less 20 a missing field, 10 an unused variable, 15 a variable of another type, 20 a missing required argument.

    ``selections(operation, parent, field)``, ``schema_fields(parent, field)``, ``variables(operation, name, vtype, used)``, ``arguments(operation, name, vtype, required)``.
    """
    known = operations.join(schema_operations.select(*keys, "operation").distinct().withColumn("found", F.lit(True)), [*keys, "operation"], "left").withColumn("found", F.col("found").isNotNull())
    lost = selections.join(schema_fields.select(*keys, "parent", "field").distinct(), [*keys, "parent", "field"], "left_anti").select(*keys, "operation", F.lit(20).alias("p"))
    lost = lost.unionByName(variables.where("not used").select(*keys, "operation", F.lit(10).alias("p")))
    typed = variables.select(*keys, "operation", "name", F.col("vtype").alias("v")).join(arguments, [*keys, "operation", "name"])
    lost = lost.unionByName(typed.where(F.regexp_replace("v", "!", "") != F.regexp_replace("vtype", "!", "")).select(*keys, "operation", F.lit(15).alias("p")))
    lost = lost.unionByName(arguments.where("required").join(variables.select(*keys, "operation", "name"), [*keys, "operation", "name"], "left_anti").select(*keys, "operation", F.lit(20).alias("p")))
    sums = lost.groupBy(*keys, "operation").agg(F.sum("p").alias("p"))
    return known.join(sums, [*keys, "operation"], "left").select(*keys, "operation", F.when(F.col("found"), F.greatest(F.lit(0), 100 - F.coalesce("p", F.lit(0)))).otherwise(0).cast("long").alias("score"), "found")


def event_contract(client: DataFrame, server: DataFrame, keys: Keys = ()) -> DataFrame:
    """``client(event, action)`` with ``score``: 0 if no ``server(event, direction)`` has the event, 70 if the direction doesn't fit, else 100."""
    s = server.groupBy(*keys, "event").agg(F.collect_set("direction").alias("d"))
    fits = F.array_contains("d", "bidirectional") | F.when(F.col("action") == "emit", F.array_contains("d", "client-to-server")).otherwise(F.array_contains("d", "server-to-client"))
    return client.join(s, [*keys, "event"], "left").select(*client.columns, F.when(F.col("d").isNull(), 0).when(fits, 100).otherwise(70).alias("score"))


def apply_mounts(routes: DataFrame, mounts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Routes ``(file, router, path)`` with ``full_path``: behind the prefix of ``mounts(key, prefix)`` whose key is the file's base name, else the router's."""
    base = F.regexp_replace(S.file_name(F.col("file")), r"\.[^.]+$", "")
    one = mounts.groupBy(*keys, "key").agg(F.min("prefix").alias("prefix"))
    joined = routes.withColumn("__base", base).join(one.select(*keys, F.col("key").alias("__base"), F.col("prefix").alias("__p1")), [*keys, "__base"], "left").join(one.select(*keys, F.col("key").alias("router"), F.col("prefix").alias("__p2")), [*keys, "router"], "left")
    full = S.normalize_path(F.concat_ws("/", F.coalesce("__p1", "__p2", F.lit("")), "path"))
    return joined.select(*routes.columns, F.concat(F.lit("/"), full).alias("full_path"))


def contract_summary(findings: DataFrame, matches: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row, or one a project: findings by severity, services with and without a route."""
    severities = ("critical", "high", "medium", "low")
    marked = findings.select(*keys, "severity", F.lit(None).cast("boolean").alias("has")).unionByName(matches.select(*keys, F.lit(None).cast("string").alias("severity"), F.col("route").isNotNull().alias("has")))
    return marked.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in severities), F.count_if("has").alias("matched"), F.count_if(~F.col("has")).alias("unmatched"))
