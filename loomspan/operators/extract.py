"""Tables of symbols, imports, routes, calls and rule hits from source text, by one pass of regular expressions over lines.

``keys`` names columns of the files that go with every row, such as the project's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.rules import RULES

Keys = tuple[str, ...]

_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
# Declarations by kind and language; group 1 is the name.
SYMBOLS = [
    ("function", "js", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}\s*\("),
    ("function", "js", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
    ("class", "js", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"),
    ("interface", "js", rf"^\s*(?:export\s+)?interface\s+{_NAME}"),
    ("type", "js", rf"^\s*(?:export\s+)?type\s+{_NAME}\s*(?:<[^>]*>)?\s*="),
    ("enum", "js", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"),
    ("function", "python", rf"^(?:async\s+)?def\s+{_NAME}\s*\("),
    ("method", "python", rf"^\s+(?:async\s+)?def\s+{_NAME}\s*\("),
    ("class", "python", rf"^\s*class\s+{_NAME}\s*[(:]"),
]
VERBS = "get|post|put|patch|delete"
# Words that look like calls and are none.
KEYWORDS = "if for while switch catch return function typeof await new super def class elif except with print lambda not and or in is".split()


def lines(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, language, line, text)``, lines counted from 1; null contents have none."""
    return files.where("content is not null").select(*keys, "file", "language", F.posexplode(F.split("content", "\r?\n")).alias("p", "text")).select(*keys, "file", "language", (F.col("p") + 1).alias("line"), "text")


def _is_python() -> Column:
    return F.col("language") == "python"


def extract_symbols(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, name, kind, exported)``; in Python, names without a leading underscore are exported."""
    rows = [F.when(_is_python() if lang == "python" else ~_is_python(), F.struct(F.regexp_extract("text", rule, 1).alias("name"), F.lit(kind).alias("kind"))) for kind, lang, rule in SYMBOLS]
    found = lines(files, keys).select("*", F.explode(F.array_compact(F.array(*rows))).alias("s")).where("s.name <> ''")
    exported = F.when(_is_python(), ~F.col("s.name").startswith("_")).otherwise(F.col("text").rlike(r"^\s*export\b"))
    return found.select(*keys, "file", "line", "s.name", "s.kind", exported.alias("exported")).dropDuplicates([*keys, "file", "line", "name"])


def extract_imports(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, module, imported, local, is_relative)``, one row for each imported name; ``*`` for whole modules."""
    base = lines(files, keys)
    row = lambda module, items: F.when(module != "", F.transform(items, lambda x: F.struct(module.alias("module"), F.trim(F.regexp_extract(x, r"^\s*(?:type\s+)?([^\s]+)", 1)).alias("imported"), F.coalesce(F.nullif(F.regexp_extract(x, r"\sas\s+([^\s]+)", 1), F.lit("")), F.regexp_extract(x, r"^\s*(?:type\s+)?([^\s]+)", 1)).alias("local"))))
    named, default, star, bare, dynamic = (
        r"""^\s*import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*['"]([^'"]+)['"]""", r"""^\s*import\s+(?:type\s+)?([\w$]+)\s*(?:,\s*\{[^}]*\})?\s*from\s*['"]([^'"]+)['"]""",
        r"""^\s*import\s+\*\s+as\s+([\w$]+)\s+from\s*['"]([^'"]+)['"]""", r"""^\s*import\s*['"]([^'"]+)['"]""", r"""\b(?:import|require)\(\s*['"]([^'"]+)['"]\s*\)""",
    )
    get = lambda rule, group: F.regexp_extract("text", rule, group)
    one = lambda module, imported, local: F.when(module != "", F.array(F.struct(module.alias("module"), imported.alias("imported"), local.alias("local"))))
    js = F.array(
        row(get(named, 2), F.filter(F.split(get(named, 1), ","), lambda x: F.trim(x) != "")), one(get(default, 2), F.lit("default"), get(default, 1)), one(get(star, 2), F.lit("*"), get(star, 1)),
        one(get(bare, 1), F.lit("*"), F.lit("")), one(get(dynamic, 1), F.lit("*"), F.lit("")),
    )
    from_, whole = r"^\s*from\s+([\w.]+)\s+import\s+\(?([^#()]*)", r"^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?"
    py = F.array(row(get(from_, 1), F.filter(F.split(get(from_, 2), ","), lambda x: F.trim(x) != "")), one(get(whole, 1), F.lit("*"), F.coalesce(F.nullif(get(whole, 2), F.lit("")), get(whole, 1))))
    found = base.select(*keys, "file", "line", F.explode(F.flatten(F.array_compact(F.when(_is_python(), py).otherwise(js)))).alias("i")).select(*keys, "file", "line", "i.*")
    return found.withColumn("is_relative", F.col("module").startswith(".")).distinct()


def extract_exports(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, name, is_default)`` of export statements, with the names of export lists."""
    base = lines(files, keys).where(~_is_python()).where(F.col("text").rlike(r"^\s*export\b"))
    listed = F.transform(F.filter(F.split(F.regexp_extract("text", r"^\s*export\s*\{([^}]*)\}", 1), ","), lambda x: F.trim(x) != ""), lambda x: F.struct(F.regexp_extract(F.trim(x), r"([\w$]+)$", 1).alias("name"), F.lit(False).alias("is_default")))
    default = F.regexp_extract("text", r"^\s*export\s+default\s+(?:async\s+)?(?:function\s*|class\s+)?([\w$]*)", 1)
    plain = F.regexp_extract("text", r"^\s*export\s+(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:const\s+enum|function\s*\*?|const|let|var|class|interface|type|enum)\s+([\w$]+)", 1)
    is_default = F.col("text").rlike(r"^\s*export\s+default\b")
    rows = F.when(is_default, F.array(F.struct(F.when(default == "", "default").otherwise(default).alias("name"), F.lit(True).alias("is_default")))).when(plain != "", F.array(F.struct(plain.alias("name"), F.lit(False).alias("is_default")))).otherwise(listed)
    return base.select(*keys, "file", "line", F.explode(rows).alias("e")).select(*keys, "file", "line", "e.*")


def extract_routes(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, method, path, router, handler)``: router calls, and Python decorators with the function of one of the next five lines."""
    js, py = rf"""\b(\w+)\.({VERBS})\(\s*['"`]([^'"`]+)['"`](?:.*,\s*([\w.$]+)\s*\)?;?\s*$)?""", rf"""^\s*@(\w+)\.({VERBS})\(\s*['"]([^'"]*)['"]"""
    base = lines(files, keys)
    ahead = Window.partitionBy(*keys, "file").orderBy("line")
    name = lambda text: F.nullif(F.regexp_extract(text, r"^\s*(?:async\s+)?def\s+(\w+)", 1), F.lit(""))
    after = F.coalesce(*(name(F.lead("text", i).over(ahead)) for i in range(1, 6)))
    rule = F.when(_is_python(), F.lit(py)).otherwise(F.lit(js))
    get = lambda i: F.when(_is_python(), F.regexp_extract("text", py, i)).otherwise(F.regexp_extract("text", js, i))
    found = base.withColumn("after", F.when(_is_python(), after)).where(F.regexp_like("text", rule)).where(_is_python() | F.regexp_extract("text", js, 1).isin("app", "router", "server", "api") | F.regexp_extract("text", js, 1).endswith("Router"))
    return found.select(*keys, "file", "line", F.upper(get(2)).alias("method"), get(3).alias("path"), get(1).alias("router"), F.when(_is_python(), F.col("after")).otherwise(F.nullif(F.regexp_extract("text", js, 4), F.lit(""))).alias("handler"))


def extract_services(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, client, method, path)``: calls of a client's verbs, and of fetch, with a literal endpoint. Any name that ends in Client, Api or Service is a client."""
    verbs, fetch = rf"""\b(axios|http|client|api|requests|httpx|this\.http|[A-Za-z]+(?:Client|Api|Service))\.({VERBS})(?:<[^>]*>)?\(\s*f?['"`]([^'"`]+)['"`]""", r"""\b(fetch)\(\s*['"`]([^'"`]+)['"`](?:.*method:\s*['"](\w+)['"])?"""
    get = lambda i: F.regexp_extract("text", verbs, i)
    fetched = F.regexp_extract("text", fetch, 2)
    method = F.when(get(2) != "", F.upper(get(2))).otherwise(F.upper(F.coalesce(F.nullif(F.regexp_extract("text", fetch, 3), F.lit("")), F.lit("GET"))))
    found = lines(files, keys).where((get(3) != "") | (fetched != ""))
    return found.select(*keys, "file", "line", F.when(get(1) != "", get(1)).otherwise("fetch").alias("client"), method.alias("method"), F.when(get(3) != "", get(3)).otherwise(fetched).alias("path"))


def extract_fields(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, owner, field, ftype, required)`` of interface, type and Python model blocks. A line belongs to the last block that opened before it."""
    opens = F.coalesce(F.nullif(F.regexp_extract("text", r"^\s*(?:export\s+)?(?:interface|type)\s+(\w+)[^{]*\{", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"^class\s+(\w+)\s*\(", 1), F.lit("")))
    closes = F.when(_is_python(), F.col("text").rlike(r"^\S") & opens.isNull()).otherwise(F.col("text").rlike(r"^\s*\}"))
    order = Window.partitionBy(*keys, "file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(opens.isNotNull(), opens).when(closes, "")
    held = lines(files, keys).withColumn("owner", F.last(mark, ignorenulls=True).over(order)).where(opens.isNull() & (F.col("owner") != ""))
    rule = r"^\s+(?:readonly\s+)?(\w+)(\??)\s*:\s*([^;=,#]+?)\s*(=.*)?[;,]?\s*(?:#.*)?$"
    get = lambda i: F.regexp_extract("text", rule, i)
    ftype = get(3)
    required = F.when(_is_python(), ~ftype.startswith("Optional") & ~ftype.contains("| None") & (get(4) == "")).otherwise(get(2) == "")
    return held.where(get(1) != "").select(*keys, "file", "owner", get(1).alias("field"), ftype.alias("ftype"), required.alias("required"))


def scan_rules(files: DataFrame, rules: list[tuple[str, str]], keys: Keys = ()) -> DataFrame:
    """``(file, line, rule)``: lines that match a rule ``(id, pattern)``. Rules are configuration; one pass over the text tries all."""
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(pattern), F.lit(name)) for name, pattern in rules)))
    return lines(files, keys).select(*keys, "file", "line", F.explode(hits).alias("rule"))


def _line_ends(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def _match_lines(text: Column, pattern: str) -> Column:
    """The lines, from 1, on which the matches of a pattern begin: each match is taken with the gap before it."""
    moved = re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + 2}", pattern)  # two groups stand before those of the pattern
    whole = F.lit(rf"((?s:.*?))(?:({moved})|\z)")
    steps = F.zip_with(F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def step(acc, x):
        line = acc["line"] + _line_ends(x["gap"])
        return F.struct((line + _line_ends(x["hit"])).alias("line"), F.when(x["hit"] == "", acc["found"]).otherwise(F.concat(acc["found"], F.array(line))).alias("found"))

    return F.aggregate(steps, F.struct(F.lit(1).alias("line"), F.expr("cast(array() as array<int>)").alias("found")), step, lambda acc: acc["found"])


def rule_matches(files: DataFrame, rules: list[tuple] = RULES, keys: Keys = ()) -> DataFrame:
    """``(file, rule, severity, line)``: every match of a rule ``(id, severity, languages, pattern)`` of the file's language, with the line that it begins on.

    Patterns may reach over lines, so each is tried on the whole text. Null contents have no matches.
    """

    def hits(name, severity, languages, pattern):
        lines_ = F.when(F.col("language").isin(*languages) & F.col("content").rlike(pattern), _match_lines(F.col("content"), pattern))
        return F.transform(F.coalesce(lines_, F.expr("cast(array() as array<int>)")), lambda n: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), n.alias("line")))

    return files.select(*keys, "file", F.explode(F.concat(*(hits(*rule) for rule in rules))).alias("x")).select(*keys, "file", "x.*")


def log_only_catch(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, n)``: catch blocks that only log."""
    rule = r"catch\s*(?:\([^)]*\))?\s*\{\s*console\.\w+\([^;{}]*\);?\s*\}"
    return files.select(*keys, "file", F.regexp_count("content", F.lit(rule)).alias("n")).where("n > 0")


def single_use_interface(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, name)``: interfaces whose name occurs at most twice, its declaration counted."""
    declared = extract_symbols(files, keys).where("kind = 'interface'").select(*keys, "file", "name").distinct()
    words = files.select(*keys, F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("name"))
    return declared.join(words.groupBy(*keys, "name").agg(F.count("*").alias("n")).where("n <= 2"), [*keys, "name"]).select(*keys, "file", "name")


def suppressed_access(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, object, member)``: member accesses on the line after a suppression comment."""
    before = F.lag("text").over(Window.partitionBy(*keys, "file").orderBy("line"))
    found = lines(files, keys).withColumn("before", before).where(F.col("before").rlike(r"@ts-(ignore|expect-error)|type:\s*ignore|eslint-disable-next-line"))
    each = F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)"), F.lit(0))
    return found.select(*keys, "file", "line", F.explode(each).alias("x")).select(*keys, "file", "line", F.substring_index("x", ".", 1).alias("object"), F.substring_index("x", ".", -1).alias("member"))


def extract_usages(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, usage_type, object, name)``: instantiations, method calls and calls, outside comment lines, without keywords and declarations."""
    code = lines(files, keys).where(~F.col("text").rlike(r"^\s*(//|#|\*|/\*)"))
    each = F.regexp_extract_all("text", F.lit(r"(?:\bnew\s+|\bfunction\s+|\bdef\s+|\bclass\s+)?(?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*\s*\("), F.lit(0))
    x = F.col("x")
    found = code.select(*keys, "file", "line", F.explode(each).alias("x")).where(~x.rlike(r"^(function|def|class)\s"))
    target = F.regexp_replace(F.regexp_replace(x, r"^new\s+", ""), r"\s*\($", "")
    kind = F.when(x.rlike(r"^new\s"), "instantiation").when(target.contains("."), "methodCall").otherwise("call")
    out = found.select(*keys, "file", "line", kind.alias("usage_type"), F.when(target.contains("."), F.regexp_extract(target, r"^(.*)\.", 1)).alias("object"), F.substring_index(target, ".", -1).alias("name"))
    return out.where(~F.col("name").isin(*KEYWORDS))


def extract_type_refs(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, name, context)``: capitalised names after a colon or arrow, in angle brackets, after extends and implements."""
    rules = [("annotation", r"(?::|->)\s*([A-Z]\w*)"), ("generic", r"<\s*([A-Z]\w*)"), ("extends", r"\bextends\s+([A-Z]\w*)"), ("implements", r"\bimplements\s+([A-Z]\w*)")]
    rows = F.flatten(F.array(*(F.transform(F.regexp_extract_all("text", F.lit(rule), F.lit(1)), _context(context)) for context, rule in rules)))
    return lines(files, keys).select(*keys, "file", "line", F.explode(rows).alias("r")).select(*keys, "file", "line", "r.*").distinct()


def _context(context: str):
    return lambda x: F.struct(x.alias("name"), F.lit(context).alias("context"))


def extract_local_definitions(files: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, line, name)``: parameters, assigned names and loop names."""
    params = F.filter(F.transform(F.split(F.regexp_extract("text", r"(?:function\s*\w*|def\s+\w+|=)\s*\(([^)]*)\)", 1), ","), lambda p: F.regexp_extract(p, r"^\s*(?:\.\.\.|\*{1,2})?(\w+)", 1)), lambda p: p != "")
    assigned = F.regexp_extract_all("text", F.lit(r"(?:\b(?:const|let|var|for)\s+\(?\s*(?:const\s+|let\s+)?|^\s*)([A-Za-z_$][\w$]*)\s*(?:=(?!=)|:[^=]+=(?!=)|\s(?:of|in)\s)"), F.lit(1))
    return lines(files, keys).select(*keys, "file", "line", F.explode(F.array_distinct(F.concat(params, assigned))).alias("name"))


def hrefs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, target)``: the links of pages, as imports are of files."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
