"""Usage counts, indexes, co-occurrence, history, complexity of texts.

``keys`` names the columns that tell projects apart: counts, ranks, shares and pairs are then those of each project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.pairs import BLOCK, pairs_of
from loomspan.operators.rank import best_rows
from loomspan.operators.tables import numbered, written

Keys = tuple[str, ...]

# Words that are no keywords of a text, and words that mark a decision.
STOP_WORDS = "the and for from import export const let var function return this that with async await true false".split()
DECISIONS = r"(?<![A-Za-z0-9_])(if|elif|else if|for|while|case|catch|except|and|or)(?![A-Za-z0-9_])|&&|\|\||\?"


def symbol_usage(edges: DataFrame, imports: DataFrame, key: str = "symbol_id", keys: Keys = ()) -> DataFrame:
    """Per symbol: imports, distinct callers, ``usage`` (their sum), distinct files."""
    own = [*keys, key]
    called = edges.groupBy(*own).agg(F.countDistinct("caller").alias("callers"), F.countDistinct("file").alias("files"))
    imported = imports.groupBy(*own).agg(F.count("*").alias("imports"))
    out = called.join(imported, own, "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("callers", "files", "imports")}
    return out.withColumns(zero).withColumn("usage", F.col("imports") + F.col("callers"))


def index_by(symbols: DataFrame, key: str, value: str, keys: Keys = ()) -> DataFrame:
    """``key``, number and sorted list of its distinct values. The list grows with the key; ``postings`` has none that does."""
    return symbols.groupBy(*keys, key).agg(F.array_sort(F.collect_set(value)).alias("values")).withColumn("n", F.size("values").cast("long"))


def postings(symbols: DataFrame, key: str, value: str, size: int = 1024, keys: Keys = ()) -> DataFrame:
    """``(key, chunk, first, n, values)``: the distinct values of each key in order, cut into lists of at most ``size``.

    ``first`` makes the rows a directory: a value is looked up in the last chunk whose ``first`` is not above it. No key is
    one task, whatever its size.
    """
    own = [*keys, key]
    distinct = symbols.select(*own, F.col(value).alias("value")).where("value is not null").distinct()
    placed = numbered(distinct, own, ["value"]).withColumn("chunk", F.floor(F.col("place") / size))
    return placed.groupBy(*own, "chunk").agg(F.min("value").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list("value")).alias("values"))


def in_postings(lists: DataFrame, asked: DataFrame, key: str, keys: Keys = ()) -> DataFrame:
    """The rows of ``asked(key, value)`` that ``lists`` has: each meets the one chunk that could hold it."""
    own = [*keys, key]
    directory = lists.select(*own, "chunk", "first")
    # The chunk is found among the firsts of the key alone; only that chunk's list is read.
    marks = directory.select(*own, F.col("first").alias("value"), "chunk").unionByName(asked.select(*own, "value").distinct().withColumn("chunk", F.lit(None).cast("long")))
    last = F.last("chunk", ignorenulls=True).over(Window.partitionBy(*own).orderBy("value", F.col("chunk").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    sought = marks.withColumn("in", last).where("chunk is null and in is not null").select(*own, "value", F.col("in").alias("chunk"))
    return sought.join(lists.select(*own, "chunk", "values"), [*own, "chunk"]).where(F.array_contains("values", F.col("value"))).select(*own, "value")


def index_statistics(symbols: DataFrame, used: DataFrame, key: str = "symbol_id", keys: Keys = ()) -> DataFrame:
    """Totals, exported and unused symbols by kind and over all (kind null), in one pass."""
    marked = symbols.join(used.select(*keys, key).distinct().withColumn("__used", F.lit(True)), [*keys, key], "left")
    counts = [F.count("*").alias("total"), F.count_if("exported").alias("exported"), F.count_if(F.col("__used").isNull()).alias("unused")]
    if not keys:
        return marked.rollup("kind").agg(*counts)
    return marked.groupingSets([[*keys, "kind"], list(keys)], *keys, "kind").agg(*counts)


def project_summary(files: DataFrame, symbols: DataFrame, names: int = 20, imports: DataFrame | None = None, path: str | None = None, most: int = 10, keys: Keys = ()) -> DataFrame:
    """``(section, value, n)``: files by language, symbols by kind, and the most frequent names.

    With ``imports(target)`` also the ``most`` most imported files, and with ``path``, a column of ``files``, the number of
    files in each directory, where the files of the root count as in ``.``.
    """
    by = lambda df, c, section: df.groupBy(*keys, F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(*keys, F.lit(section).alias("section"), "value", "n")
    top = best_rows(by(symbols, "name", "name"), list(keys), [F.desc("n"), "value"], names)
    out = by(files, "language", "language").unionByName(by(symbols, "kind", "kind")).unionByName(top)
    if imports is not None:
        out = out.unionByName(best_rows(by(imports.where("target is not null"), "target", "imported"), list(keys), [F.desc("n"), "value"], most))
    if path is not None:
        folder = F.regexp_replace(F.translate(path, "\\", "/"), "/?[^/]*$", "")
        out = out.unionByName(by(files.withColumn("__dir", F.when(folder == "", ".").otherwise(folder)), "__dir", "directory"))
    return out


def file_history(commit_files: DataFrame, as_of: Column, newest: int = 5, keys: Keys = ()) -> DataFrame:
    """Per file: commits, authors, last change, the newest commits, and commits per day since the last change (0 if that is not in the past).

    The newest are ranked per file first, so that no list grows with a file's history.
    """
    own = [*keys, "file"]
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("ts"), F.desc("commit_id")))
    last = commit_files.withColumn("__r", rank).where(f"__r <= {newest}").groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "commit_id"))), lambda x: x["commit_id"]).alias("newest"))
    out = commit_files.groupBy(*own).agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("author").alias("authors"), F.max("ts").alias("last_modified"))
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_modified").cast("timestamp"))) / F.lit(86_400_000_000)
    return out.join(last, own).withColumn("frequency", F.when(days > 0, F.col("commits") / days).otherwise(0.0))


def co_change(commit_files: DataFrame, max_group: int | None = None, keys: Keys = (), block: int = BLOCK) -> DataFrame:
    """``(file, partner, n)``: commits that change both. ``max_group`` leaves out commits of more files; None keeps all.

    Pairs are made once, smaller file first, in tiles, and mirrored after they are counted.
    """
    members = _limited(commit_files.select(*keys, "commit_id", "file").distinct(), [*keys, "commit_id"], max_group)
    return _mirrored(_counted(members, keys, "commit_id", "file", block), "file", "partner", keys)


def co_occurrence(file_symbols: DataFrame, min_count: int = 2, max_group: int | None = None, keys: Keys = (), block: int = BLOCK) -> DataFrame:
    """``(a, b, n)``: files that hold both symbols, from ``min_count`` on, both orders. A symbol in fewer files than that has no pair, and goes before pairs are made."""
    members = _limited(file_symbols.select(*keys, "file", F.col("symbol_id").alias("s")).distinct(), [*keys, "file"], max_group)
    if min_count > 1:
        often = members.groupBy(*keys, "s").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select(*keys, "s")
        members = members.join(often, [*keys, "s"], "left_semi")
    return _mirrored(_counted(members, keys, "file", "s", block).where(F.col("n") >= min_count), "a", "b", keys)


def _limited(members: DataFrame, on: list[str], most: int | None) -> DataFrame:
    return members if most is None else members.join(members.groupBy(*on).count().where(F.col("count") <= most).select(*on), on, "left_semi")


def _counted(members: DataFrame, keys: Keys, group: str, item: str, block: int) -> DataFrame:
    """Pairs of the items of a group, counted over groups; counts are combined before they are shuffled."""
    return pairs_of(members, [*keys, group], item, block).groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))


def _mirrored(pairs: DataFrame, a: str, b: str, keys: Keys) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("x").alias(a), F.col("y").alias(b)), F.struct(F.col("y").alias(a), F.col("x").alias(b))))
    return pairs.select(*keys, both.alias("p"), "n").select(*keys, "p.*", "n")


def usage_rituals(co: DataFrame, usage: DataFrame, min_usage: int = 3, share: float = 0.5, keys: Keys = ()) -> DataFrame:
    """``(symbol, expected, frequency, confidence)``: what is used together with a symbol in more than ``share`` of its uses."""
    base = usage.where(F.col("usage") >= min_usage).select(*keys, F.col("symbol_id").alias("a"), "usage")
    found = co.join(base, [*keys, "a"]).withColumn("frequency", F.col("n") / F.col("usage")).where(F.col("frequency") > share)
    return found.select(*keys, F.col("a").alias("symbol"), F.col("b").alias("expected"), "frequency", F.when(F.col("usage") > 10, 0.9).otherwise(0.7).alias("confidence"))


def ritual_deviations(file_symbols: DataFrame, rituals: DataFrame, share: float = 0.8, keys: Keys = ()) -> DataFrame:
    """``(file, symbol, expected)``: files that use a symbol without what nearly always goes with it."""
    own = file_symbols.select(*keys, "file", F.col("symbol_id").alias("symbol")).distinct()
    wanted = own.join(rituals.where(F.col("frequency") > share).select(*keys, "symbol", "expected"), [*keys, "symbol"])
    return wanted.join(own.select(*keys, "file", F.col("symbol").alias("expected")), [*keys, "file", "expected"], "left_anti").select(*keys, "file", "symbol", "expected")


def file_keywords(files: DataFrame, k: int = 15, path: str | None = None, keys: Keys = ()) -> DataFrame:
    """``(file, keyword, n)``: the k most frequent words of each text that are no stop words and longer than three letters; ties by word.

    ``path`` names a column whose parts, without suffix and those that begin with a dot, are keywords as well; n is 0
    for those that are not among the words.
    """
    words = F.explode(F.regexp_extract_all(F.lower("content"), F.lit("(?<![a-z0-9_])[a-z][a-z0-9_]{3,}+"), F.lit(0)))
    own = [*keys, "file"]
    # Texts are dealt by file before they become words: counts and ranks then need no shuffle of the words, which are larger.
    counts = files.repartition(*own).select(*own, words.alias("keyword")).where(~F.col("keyword").isin(*STOP_WORDS)).groupBy(*own, "keyword").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("n"), "keyword"))
    top = counts.withColumn("r", rank).where(f"r <= {k}").drop("r")
    if path is None:
        return top
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & ~p.startswith("."))
    named = files.select(*own, F.explode(F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"\.[^.]+$", ""))).alias("keyword")).distinct()
    return top.unionByName(named.join(top, [*own, "keyword"], "left_anti").withColumn("n", F.lit(0).cast("long")))


def keyword_index(keywords: DataFrame, size: int = 1024, keys: Keys = ()) -> DataFrame:
    """``(keyword, chunk, first, n, values)``: the inverted index, the files of each keyword as ``postings``. A keyword of nothing but files that are null has one empty list."""
    own = [*keys, "keyword"]
    given = written(keywords.select(*own, "file"), "keywords")  # read twice below
    lists = postings(given, "keyword", "file", size, keys)
    bare = given.where("file is null").select(*own).distinct().join(given.where("file is not null"), own, "left_anti")
    blank = {"chunk": F.lit(0), "first": F.lit(None), "n": F.lit(0), "values": F.array()}
    return lists.unionByName(bare.select(*own, *(x.cast(lists.schema[c].dataType).alias(c) for c, x in blank.items())))


def keyword_files(index: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(keyword, n, first_file)`` of ``keyword_index``: how many files its lists of a word hold, and the first."""
    return index.groupBy(*keys, "keyword").agg(F.sum(F.size("values")).alias("n"), F.min(F.get("values", F.lit(0))).alias("first_file"))


def detect_language(files: DataFrame, words: dict[str, list[str]], keys: Keys = ()) -> DataFrame:
    """``(file, language, confidence)`` by counting each language's words; ties by name; null without any hit. The word table is configuration."""
    text = F.concat(F.lit(" "), F.lower("content"), F.lit(" "))
    hits = F.array(*(F.struct(F.regexp_count(text, F.lit(r"(?<![\p{L}])(" + "|".join(w) + r")(?![\p{L}])")).alias("hits"), F.lit(lang).alias("language")) for lang, w in sorted(words.items())))
    best = F.reduce(hits, F.struct(F.lit(0).alias("hits"), F.lit(None).cast("string").alias("language")), lambda a, x: F.when(x["hits"] > a["hits"], x).otherwise(a))
    total = F.aggregate(hits, F.lit(0), lambda a, x: a + x["hits"])
    out = files.select(*keys, "file", best.alias("best"), total.alias("total"))
    return out.select(*keys, "file", "best.language", F.when(F.col("total") > 0, F.least(F.lit(90), F.round(100 * F.col("best.hits") / F.col("total")).cast("int"))).alias("confidence"))


def complexity(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, complexity, n_lines, depth, level)``: one and the decision words, lines, deepest indent in steps of four."""
    lines = F.split("content", "\n")
    depth = F.array_max(F.transform(lines, lambda x: F.floor(F.char_length(F.regexp_extract(x, "^( *)", 1)) / 4)))
    out = files.select(*keys, "file", (1 + F.regexp_count("content", F.lit(DECISIONS))).alias("complexity"), F.size(lines).alias("n_lines"), depth.alias("depth"))
    return out.withColumn("level", F.when(F.col("complexity") > 20, "high").when((F.col("complexity") > 10) | (F.col("n_lines") > 50) | (F.col("depth") > 4), "medium").otherwise("low"))


def duplicate_definitions(symbols: DataFrame, key: str = "name", keys: Keys = ()) -> DataFrame:
    return symbols.groupBy(*keys, key).agg(F.count("*").alias("n")).where("n > 1")


def context_quality(all_symbols: DataFrame, kept: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row, or one a project: share of symbols that pruning removed, and what that says."""
    marked = all_symbols.select(*keys, F.lit(1).alias("t"), F.lit(0).alias("k")).unionByName(kept.select(*keys, F.lit(0).alias("t"), F.lit(1).alias("k")))
    counts = marked.groupBy(*keys).agg(F.coalesce(F.sum("t"), F.lit(0)).alias("total"), F.coalesce(F.sum("k"), F.lit(0)).alias("kept"))
    share = F.when(F.col("total") > 0, 1 - F.col("kept") / F.col("total")).otherwise(0.0)
    return counts.select(*keys, "total", "kept", F.when(share > 0.7, "excellent").when(share > 0.5, "good").otherwise("fair").alias("quality"))
