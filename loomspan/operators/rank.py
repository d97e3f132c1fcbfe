"""Top-k, relevance and similar names. ``keys`` names the columns that tell projects apart."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from loomspan.functions import scalars as S
from loomspan.operators.pairs import tiled_join
from loomspan.operators.tables import written

Keys = tuple[str, ...]


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with ``rank`` from 1; Spark limits each partition before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"rank <= {k}")


def best_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows, or those of each project. Order must not leave ties."""
    return top_k(df, keys, order, k).drop("rank") if keys else df.orderBy(*order).limit(k)


def jaro_winkler_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity of each pair with the bonus of up to four common leading characters, always given; transpositions are halved, not rounded.

    All pairs at once: the places of the first names are walked together, and each takes the first free equal letter
    within reach of every second name.
    """
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out = np.zeros(len(a))
    order = np.argsort(np.maximum(n, m), kind="stable")
    at = 0
    while at < len(order):
        # As many pairs as fill about a million places.
        width = max(1, int(np.maximum(n, m)[order[min(len(order) - 1, at + 4095)]]))
        rows = order[at : at + max(1, min(4096, (1 << 20) // width))]
        at += len(rows)
        x, y = _letters([a[i] for i in rows]), _letters([b[i] for i in rows])
        la, lb = n[rows], m[rows]
        reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        place = np.arange(y.shape[1])
        free = place[None, :] < lb[:, None]
        left, right = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        for i in range(x.shape[1]):
            fits = free & (y == x[:, i : i + 1]) & (np.abs(place[None, :] - i) <= reach[:, None]) & (i < la)[:, None]
            hit = np.flatnonzero(fits.any(axis=1))
            first = fits[hit].argmax(axis=1)
            free[hit, first], right[hit, first], left[hit, i] = False, True, True
        matched = left.sum(axis=1)
        rank = lambda taken: np.where(taken, np.cumsum(taken, axis=1) - 1, -1)
        most = int(matched.max(initial=0))
        first, second = np.zeros((len(rows), most), x.dtype), np.zeros((len(rows), most), y.dtype)
        for taken, letters, to in ((left, x, first), (right, y, second)):
            r, c = np.nonzero(taken)
            to[r, rank(taken)[r, c]] = letters[r, c]
        swaps = (first != second).sum(axis=1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(matched > 0, (matched / la + matched / lb + (matched - swaps) / matched) / 3, 0.0)
        k = min(4, x.shape[1], y.shape[1])
        same = (x[:, :k] == y[:, :k]) & (np.arange(k)[None, :] < np.minimum(la, lb)[:, None])
        prefix = np.cumprod(same, axis=1).sum(axis=1)
        out[rows] = np.where(matched > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
    equal = np.array([p == q for p, q in zip(a, b, strict=True)], bool)
    return np.where(equal, 1.0, out) if len(a) else out


def jaro_winkler(a: str, b: str) -> float:
    """The same for one pair."""
    return float(jaro_winkler_pairs([a], [b])[0])


def _letters(names: list[str]) -> np.ndarray:
    """Code points of the names, one row each, filled up with zeros."""
    sizes = np.array([len(x) for x in names])
    out = np.zeros((len(names), max(1, int(sizes.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler_pairs([x or "" for x in a], [x or "" for x in b]), dtype="float64")


def _name_keys(df: DataFrame, column: str, keys: Keys) -> DataFrame:
    """Each distinct name with its parts, trigrams and first two letters."""
    low = F.lower(column)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(column) - 2)), lambda i: F.concat(F.lit("g:"), F.substring(low, i, F.lit(3))))
    parts = F.transform(S.name_parts(F.col(column)), lambda p: F.concat(F.lit("p:"), p))
    all_ = F.array_distinct(F.concat(grams, parts, F.array(F.concat(F.lit("s:"), F.substring(low, 1, 2)))))
    return df.select(*keys, column).where(F.col(column).isNotNull()).distinct().select(*keys, column, F.explode(all_).alias("key"))


def similar_pairs(targets: DataFrame, names: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(target, name, base, bound)``: distinct pairs that share a name part, a trigram or the first two characters.

    ``base`` is what the score has from all but the edit similarity, ``bound`` what it can be at most: similarity grows
    with the letters in common, which are no more than the shorter name has. Both are columns. The names of a frequent
    key are joined in tiles.
    """
    own = [*keys, "key"]
    pairs = tiled_join(_name_keys(targets, "target", keys), _name_keys(names, "name", keys), own, "target", "name").where("target <> name").select(*keys, "target", "name").distinct()
    a, b = F.lower("target"), F.lower("name")
    prefix = S.common_prefix(a, b)
    base = (
        F.when(a.contains(b) | b.contains(a), 30).otherwise(0) + F.when(S.shares_part(F.col("target"), F.col("name")), 20).otherwise(0) + 5 * prefix
        + F.when(F.char_length("target") == F.char_length("name"), 10).otherwise(0)
    )
    n, m = F.char_length("target"), F.char_length("name")
    short = F.least(n, m)
    jaro = F.when(short > 0, (short / n + short / m + 1) / 3).otherwise(0.0)
    most = F.when(a == b, 1.0).otherwise(jaro + F.least(F.lit(4), prefix) * 0.1 * (1 - jaro))
    return pairs.withColumn("base", base).withColumn("bound", 50 * most + F.col("base") + 1e-9)


def suggest_similar(targets: DataFrame, names: DataFrame, k: int = 3, least: float = 25.0, keys: Keys = (), report: list[DataFrame] | None = None) -> DataFrame:
    """``(target, name, score, rank)``: up to k similar names of each distinct target.

    Only pairs of ``similar_pairs`` are compared. The score adds similarity, containment, shared parts, prefix and equal
    length. The edit similarity, the dear part, is taken for the 2 k pairs of a target with the largest bounds; of the
    rest only for those whose bound reaches the target's k-th score so far, as others can't be among the k. The scored
    pairs are appended to ``report`` if it is given.
    """
    own = [*keys, "target"]
    pairs = written(similar_pairs(targets, names, keys).where(F.col("bound") > least), "pairs")
    first = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("bound"), "name"))
    score = lambda df: df.withColumn("score", 50 * jaro_winkler_udf(F.lower("target"), F.lower("name")) + F.col("base")).select(*own, "name", "score")
    head = written(pairs.withColumn("r", first).where(f"r <= {2 * k}"), "head")
    begun = written(score(head), "begun")
    floor = top_k(begun, own, [F.desc("score"), "name"], k).where(f"rank = {k}").select(*own, F.col("score").alias("floor"))
    rest = pairs.join(head.select(*own, "name"), [*own, "name"], "left_anti").join(floor, own, "left").where("floor is null or bound >= floor")
    scored = written(begun.unionByName(score(rest)), "scored")
    if report is not None:
        report.append(scored)
    return top_k(scored.where(F.col("score") > least), own, [F.desc("score"), "name"], k)


def levenshtein_neighbours(names: DataFrame, distance: int = 3, keys: Keys = ()) -> DataFrame:
    """``(a, b, d)``: distinct names within an edit distance.

    A name cut into ``distance + 1`` pieces leaves at least one of them whole after that many edits, moved by no more
    than ``distance`` places. Names meet where a piece of one is the same as a stretch of the other near that place;
    only these pairs are measured, and the measure stops at the threshold. Of two names the shorter is cut.

    Names of up to ``distance`` letters have no such pieces. Two of them are always near, so all their pairs are in the
    result. With a longer name they have in common what is left of it after ``distance`` deletions, so they meet by
    such a rest.
    """
    own = names.select(*keys, "name").where("name is not null").distinct()
    n, parts = F.char_length("name"), distance + 1
    pieces = F.sequence(F.lit(0), F.lit(distance))
    start = lambda i, size: F.floor(i * size / parts).cast("int")
    cut = lambda i: F.struct(n.alias("size"), i.alias("i"), F.substring("name", start(i, n) + 1, start(i + 1, n) - start(i, n)).alias("piece"))
    index = own.where(n > distance).select(*keys, F.col("name").alias("a"), F.explode(F.transform(pieces, cut)).alias("k")).select(*keys, "a", "k.*")

    def near(size):
        """All stretches of a name that may be a piece of one with ``size`` letters."""

        def of_piece(i):
            at, width = start(i, size), start(i + 1, size) - start(i, size)
            places = F.sequence(F.greatest(F.lit(0), at - distance), F.greatest(F.lit(0), F.least(at + distance, n - width)))
            return F.transform(F.filter(places, lambda p: p + width <= n), lambda p: F.struct(size.alias("size"), i.alias("i"), F.substring("name", p + 1, width).alias("piece")))

        return F.flatten(F.transform(pieces, of_piece))

    sizes = F.sequence(F.greatest(F.lit(distance + 1), n - distance), n)
    probes = own.where(n > distance).select(*keys, F.col("name").alias("b"), F.explode(F.array_distinct(F.flatten(F.transform(sizes, near)))).alias("k")).select(*keys, "b", "k.*")
    ordered = lambda df: df.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = ordered(index.join(probes, [*keys, "size", "i", "piece"]).where("a <> b"))

    def rests(letters: int, size: int):
        """The distinct rests of ``letters`` letters of a name with ``size``."""
        pick = lambda places: F.concat(*(F.substring("name", p + 1, 1) for p in places))
        return F.array_distinct(F.array(*(pick(c) for c in itertools.combinations(range(size), letters))))

    short = own.where((n > 0) & (n <= distance))
    of_short = F.flatten(F.array(*(F.when(n == size, F.transform(rests(left, size), lambda r: F.struct(F.lit(left + distance).alias("size"), r.alias("rest")))).otherwise(F.array().cast("array<struct<size:int,rest:string>>")) for size in range(1, distance + 1) for left in range(1, size + 1))))  # noqa: B023
    of_long = F.flatten(F.array(*(F.when(n == size, F.transform(rests(size - distance, size), lambda r: F.struct(F.lit(size).alias("size"), r.alias("rest")))).otherwise(F.array().cast("array<struct<size:int,rest:string>>")) for size in range(distance + 1, 2 * distance + 1))))  # noqa: B023
    mixed = short.select(*keys, F.col("name").alias("a"), F.explode(of_short).alias("k")).select(*keys, "a", "k.*").join(
        own.where((n > distance) & (n <= 2 * distance)).select(*keys, F.col("name").alias("b"), F.explode(of_long).alias("k")).select(*keys, "b", "k.*"), [*keys, "size", "rest"]
    )
    tiny = own.where(n <= distance).withColumn("one", F.lit(1))
    both = tiled_join(tiny.withColumnRenamed("name", "a"), tiny.withColumnRenamed("name", "b"), [*keys, "one"], "a", "b").where("a < b").select(*keys, "a", "b")
    every = pairs.unionByName(ordered(mixed)).unionByName(both).distinct()
    close = every.select(*keys, "a", "b", F.levenshtein("a", "b", distance).alias("d")).where("d >= 0")
    return close.unionByName(close.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def score_relevance(signals: DataFrame, k: int = 200, least: float = 0.3, keys: Keys = ()) -> DataFrame:
    """``(symbol, score, reasons)`` from ``(symbol, score, reason)``: sums of at least ``least``, the k best."""
    found = signals.groupBy(*keys, "symbol").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return best_rows(found.where(F.col("score") >= least - 1e-9), list(keys), [F.desc("score"), "symbol"], k)


# Weights of the signals of relevance, and how many files the ranked ones take.
SIGNALS = {"imported": 1.0, "related": 0.8, "current": 0.7, "recentFile": 0.9, "recentSymbol": 0.6, "hotspot": 0.35, "similar": 0.3}
LINEAGE_WEIGHT, POPULAR_MOST = 0.5, 0.4
MOST_RELATED, MOST_POPULAR, MOST_LINEAGE, MOST_HOTSPOTS, MOST_SIMILAR = 50, 100, 10, 5, 5


def relevance_signals(
    file_symbols: DataFrame, usage: DataFrame, imported: DataFrame | None = None, related: DataFrame | None = None, current: DataFrame | None = None, recent_files: DataFrame | None = None, recent_symbols: DataFrame | None = None,
    lineage: DataFrame | None = None, hot: DataFrame | None = None, similar: DataFrame | None = None, keys: Keys = (),
) -> DataFrame:
    """The signals of ``score_relevance``, ``(symbol, score, reason)``; legs that are None are left out.

    ``file_symbols(file, symbol)``: what each file defines. ``usage(symbol, usage)``: the hundred most used give
    min(0.4, usage / 100). ``imported(symbol)`` 1; ``related(symbol, score)``, the fifty best 0.8; ``current(file)`` 0.7 and
    ``recent_files(file)`` 0.9 for their symbols; ``recent_symbols(symbol)`` 0.6; ``lineage(file, place, score)``, the ten
    newest files, half their score; ``hot(file, frequency)``, the five most changed 0.35; ``similar(file, n)``, the five
    with most shared imports 0.3. A symbol that several files of a leg define gets the leg's score once for each.
    """
    own = list(keys)
    defined = file_symbols.select(*keys, "file", "symbol").distinct()
    leg = lambda df, score, reason: df.select(*keys, "symbol", score.cast("double").alias("score"), F.lit(reason).alias("reason"))
    of = lambda files, score, reason: leg(defined.join(files, [*keys, "file"]), score, reason)
    fixed = lambda reason: F.lit(SIGNALS[reason])
    ranked = lambda df, order, k: best_rows(df, own, order, k)
    legs = [leg(ranked(usage.select(*keys, "symbol", "usage"), [F.desc("usage"), "symbol"], MOST_POPULAR), F.least(F.lit(POPULAR_MOST), F.col("usage") / 100), "popular")]
    if imported is not None:
        legs.append(leg(imported.select(*keys, "symbol").distinct(), fixed("imported"), "imported"))
    if related is not None:
        legs.append(leg(ranked(related.select(*keys, "symbol", F.col("score").alias("s")), [F.desc("s"), "symbol"], MOST_RELATED), fixed("related"), "related"))
    for files, reason in ((current, "current"), (recent_files, "recentFile")):
        if files is not None:
            legs.append(of(files.select(*keys, "file").distinct(), fixed(reason), reason))
    if recent_symbols is not None:
        legs.append(leg(recent_symbols.select(*keys, "symbol").distinct(), fixed("recentSymbol"), "recentSymbol"))
    if lineage is not None:
        legs.append(of(ranked(lineage.select(*keys, "file", "place", F.col("score").alias("s")), ["place", "file"], MOST_LINEAGE), F.col("s") * LINEAGE_WEIGHT, "lineage"))
    if hot is not None:
        legs.append(of(ranked(hot.select(*keys, "file", "frequency"), [F.desc("frequency"), "file"], MOST_HOTSPOTS), fixed("hotspot"), "hotspot"))
    if similar is not None:
        legs.append(of(ranked(similar.select(*keys, "file", "n"), [F.desc("n"), "file"], MOST_SIMILAR), fixed("similar"), "similar"))
    out = legs[0]
    for more in legs[1:]:
        out = out.unionByName(more)
    return out


def hotspots(history: DataFrame, least: float = 0.1, k: int = 20, keys: Keys = ()) -> DataFrame:
    return best_rows(history.where(F.col("frequency") >= least), list(keys), [F.desc("frequency"), "file"], k)


def recently_modified(commit_files: DataFrame, n: int = 10, keys: Keys = ()) -> DataFrame:
    """``(file, place)``: files of the newest n commits and the place of the newest commit that has them, from 0."""
    order = [F.desc("ts"), F.desc("commit_id")]
    newest = best_rows(commit_files.select(*keys, "commit_id", "ts").distinct(), list(keys), order, n)
    placed = newest.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)  # n rows a project
    own = [*keys, "commit_id"]
    return commit_files.join(placed.select(*own, "place"), own).groupBy(*keys, "file").agg(F.min("place").alias("place"))


def lineage_score(history: DataFrame, recent: DataFrame, hot: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, score)``: 0.8 less 0.05 a place if recent, 0.4 if hot, up to 0.2 for commits; at most 1."""
    own = [*keys, "file"]
    joined = history.select(*own, "commits").join(recent, own, "left").join(hot.select(*own).distinct().withColumn("hot", F.lit(0.4)), own, "left")
    score = F.coalesce(0.8 - 0.05 * F.col("place"), F.lit(0.0)) + F.coalesce("hot", F.lit(0.0)) + F.least(F.lit(0.2), F.col("commits") / 100)
    return joined.select(*own, F.least(F.lit(1.0), score).alias("score"))


def similar_files(imports: DataFrame, wanted: DataFrame, key: str = "symbol_id", keys: Keys = ()) -> DataFrame:
    """``(file, n)``: files by number of wanted imports they share."""
    return imports.join(wanted.select(*keys, key).distinct(), [*keys, key], "left_semi").groupBy(*keys, "file").agg(F.countDistinct(key).alias("n"))


def newest_first(files: DataFrame, when: str, key: str, n: int, keys: Keys = ()) -> DataFrame:
    return best_rows(files, list(keys), [F.desc(when), key], n)
