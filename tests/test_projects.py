"""Operators by project: two projects that use the same names give what each gives alone."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import contracts as C
from loomspan.operators import diff as D
from loomspan.operators import extract as X
from loomspan.operators import graph as G
from loomspan.operators import rank as K
from loomspan.operators import resolve as R
from loomspan.operators import usage as U

KEYS = ("project_id",)
_SCHEMAS = {
    "usages": "file long, line long, symbol_id long, caller long, usage_type string, arg_count int",
    "catalog": "file long, symbol_id long, name string, kind string, exported boolean, param_min int, param_max int",
    "imports": "file long, symbol_id long, name string, is_type_only boolean, package string, module string, target string",
    "edges": "src long, dst long", "commits": "commit_id long, author long, ts timestamp, file long", "files": "file string, language string, content string",
    "tree": "node long, parent long", "scoped": "scope long, name string", "calls": "file long, object string, member string", "members": "name string, scope string",
}


def _rows(name, r):
    n, letter = r.randrange, lambda: r.choice("abcdefgh")
    return {
        "usages": lambda: [(n(6), n(20), n(15), n(6), r.choice(["call", "reference", "methodCall"]), n(5)) for _ in range(60)],
        "catalog": lambda: [(n(6), s, letter() + letter(), r.choice(["f", "c"]), r.random() < 0.6, n(2), 2 + n(2)) for s in r.sample(range(15), 9)],
        "imports": lambda: [(n(6), n(15), letter() + letter(), r.random() < 0.5, letter(), r.choice(["@/x/", "a.", ""]) + letter(), None) for _ in range(25)],
        "edges": lambda: [(n(9), n(9)) for _ in range(14)],
        "commits": lambda: [(c, c % 3, __import__("datetime").datetime(2024, 1, 1 + c), f) for c in range(8) for f in r.sample(range(7), 3)],
        "files": lambda: [(f"{r.choice(['src/', 'src/x/', 'x/', ''])}{c}{r.choice(['.ts', '.py', '/index.ts'])}", r.choice(["ts", "py"]), " ".join(r.choices(["alpha", "beta", "gamma", "if", "use"], k=12))) for c in "abcdefgh"],
        "tree": lambda: [(0, None), *((i, n(i)) for i in range(1, 9))],
        "scoped": lambda: sorted({(n(9), letter()) for _ in range(14)}),
        "calls": lambda: [(n(4), r.choice(["user", "user.name", "this", "api", "order[0]", "`t`", "ghost", "box"]), letter()) for _ in range(40)],
        "members": lambda: [(letter(), r.choice([None, "User", "order", "box"])) for _ in range(5)],
    }[name]()


@pytest.fixture(scope="module")
def tables(spark):
    out = {}
    for i, (name, schema) in enumerate(_SCHEMAS.items()):
        rows = [(p, *row) for p in (1, 2) for row in _rows(name, random.Random(100 * p + i))]
        out[name] = spark.createDataFrame(rows, f"project_id long, {schema}").persist()
    return out


def _methods(t, k):
    pick = lambda name, c: t["members"].where("scope is not null").select(*k, F.col("scope").alias(c)).distinct()
    roots = t["calls"].select(*k, F.regexp_extract("object", "^[a-z]+", 0).alias("root")).where("root not in ('', 'ghost')").distinct()
    internal = t["calls"].where("file < 3").select(*k, "file", F.regexp_extract("object", "^[a-z]+", 0).alias("name"))
    members = t["members"].sparkSession.createDataFrame([("a",)], "member string")
    return R.unresolved_methods(t["calls"], t["members"], ["api"], roots, members, pick("members", "name"), internal, keys=k)


def _name(df):
    return df.withColumnRenamed("symbol_id", "s").withColumn("name", F.col("s").cast("string"))


def _history(t, k):
    return U.file_history(t["commits"], F.lit("2024-03-01"), keys=k)


def _co(t, k):
    return U.co_occurrence(t["usages"], 2, keys=k)


def _usage(t, k):
    return t["usages"].groupBy(*k, "symbol_id").agg(F.count("*").alias("usage"))


def _closure(t, k):
    return G.ancestors(t["tree"], keys=k)


def _seeds(t, k):
    return t["edges"].where("src < 4").select(*k, F.col("src").alias("seed"))


def _aliases(t, k):
    extra = t["files"].select(*k, F.lit("@/x").alias("prefix"), F.lit("x").alias("target")).distinct()
    return R.common_aliases(t["files"], keys=k).unionByName(extra)


def _as_symbol(df, k):
    return df.select(*k, F.col("symbol_id").alias("symbol")).distinct()


def _services(t, k):
    return t["usages"].select(*k, F.col("line").alias("service"), F.lit("GET").alias("method"), F.concat(F.lit("/api/things/item"), F.col("symbol_id")).alias("path")).distinct()


def _routes(t, k):
    return t["imports"].select(*k, F.when(F.col("is_type_only"), "GET").otherwise("PUT").alias("method"), F.concat(F.lit("/things/item"), F.col("symbol_id")).alias("path")).distinct()


def _fields(t, k):
    side = lambda i, suffix, df: df.select(*k, F.concat(F.substring("name", 1, 1), F.lit(suffix)).alias("owner"), F.lit(i).alias("side"), F.concat(F.lit("f"), F.col("symbol_id") % 4).alias("field"), F.lit("int").alias("ftype"), F.lit(1).alias("required")).distinct()
    return side(0, "x", t["imports"]).unionByName(side(1, "y", t["imports"].where("file > 1")))


def _code(t, k):
    return t["imports"].select(*k, F.col("symbol_id").cast("string").alias("file"), F.lit("js").alias("language"), F.concat(F.lit("interface "), F.col("package"), F.lit(" {\n}\nrun."), F.col("name"), F.lit("()")).alias("content")).distinct()


CASES = {
    "unresolved": lambda t, k: R.unresolved_references(t["usages"], t["catalog"], t["imports"].where("file < 2"), kinds=("call", "reference"), keys=k),
    "unresolved_strict": lambda t, k: R.unresolved_references(t["usages"], t["catalog"], t["imports"], strict=True, keys=k),
    "methods": _methods,
    "dependencies": lambda t, k: R.validate_dependencies(t["imports"], t["imports"].where("file = 1"), t["imports"].sparkSession.createDataFrame([("c",), ("d",)], "package string"), keys=k),
    "resolve": lambda t, k: R.resolve_imports(t["imports"].drop("target"), t["files"], _aliases(t, k), dotted=True, keys=k),
    "unresolved_imports": lambda t, k: R.unresolved_imports(t["imports"].withColumn("target", F.when(F.col("symbol_id") > 3, F.col("file").cast("string"))), t["catalog"].withColumn("file", F.col("file").cast("string")), keys=k),
    "arity": lambda t, k: R.arity_check(t["usages"].drop("file"), t["catalog"], keys=k),
    "unused_imports": lambda t, k: R.unused_imports(_name(t["imports"].drop("name")), [_name(t["usages"])], keys=k),
    "type_only": lambda t, k: R.type_only_misuse(_name(t["imports"].drop("name")), _name(t["usages"]), keys=k),
    "unused_exports": lambda t, k: R.unused_exports(t["catalog"], t["imports"], [t["usages"].where("usage_type = 'call'")], keys=k),
    "orphans": lambda t, k: R.orphan_files(t["catalog"].select(*k, "file").distinct(), t["edges"].where("dst < 3"), t["catalog"], t["imports"].where("file = 0"), keys=k),
    "unused_definitions": lambda t, k: R.unused_definitions(t["catalog"].withColumn("exported", F.lit(False)), t["imports"].select(*k, "file", "name"), keys=k),
    "unused_members": lambda t, k: R.unused_members(t["catalog"].select(*k, F.col("kind").alias("class"), F.col("name").alias("member")), t["catalog"].select(*k, F.col("kind").alias("class"), F.col("symbol_id").alias("instance")), t["catalog"].where("file < 3").select(*k, F.col("symbol_id").alias("instance"), F.col("name").alias("member")), keys=k),
    "scope": lambda t, k: R.scope_resolve(t["scoped"].select(*k, (F.col("scope") + 1).alias("scope"), "name"), _closure(t, k), t["scoped"], t["imports"].withColumn("name", F.substring("name", 1, 1)), keys=k),
    "shadowed": lambda t, k: R.shadowed_symbols(_closure(t, k), t["scoped"], keys=k),
    "bridges": lambda t, k: R.bridge_edges(t["usages"].select(*k, "file", F.concat(F.lit("/"), F.col("symbol_id")).alias("name")), t["imports"].select(*k, "file", F.concat(F.lit("/"), F.col("symbol_id")).alias("name")), keys=k),
    "relations": lambda t, k: R.relations_of(t["edges"].select(*k, F.col("src").alias("symbol")).distinct(), t["edges"], keys=k),
    "types": lambda t, k: R.unknown_types(t["imports"].select(*k, F.col("file").alias("id"), "name"), t["catalog"], ["ab"], t["usages"].select(*k, F.col("line").alias("id"), F.col("file").alias("object"), F.col("symbol_id").alias("property")), t["catalog"].select(*k, F.col("file").alias("object"), F.col("kind").alias("type")), t["catalog"].select(*k, F.col("kind").alias("type"), F.col("symbol_id").alias("property")), keys=k).distinct(),
    "find": lambda t, k: R.find_symbol(t["imports"].select(*k, F.col("symbol_id").alias("id"), F.substring("name", 1, 1).alias("name"), "file", F.lit(None).cast("string").alias("scope")), t["catalog"].select(*k, F.substring("name", 1, 1).alias("name"), "file", F.lit(None).cast("string").alias("scope"), F.col("symbol_id").alias("symbol")), keys=k),
    "usage": lambda t, k: U.symbol_usage(t["usages"], t["imports"], keys=k),
    "index": lambda t, k: U.index_by(t["usages"], "file", "symbol_id", keys=k),
    "postings": lambda t, k: U.postings(t["usages"], "file", "symbol_id", 3, keys=k),
    "statistics": lambda t, k: U.index_statistics(t["catalog"], t["imports"], keys=k),
    "summary": lambda t, k: U.project_summary(t["files"], t["catalog"], 3, t["imports"].withColumn("target", F.col("symbol_id")), "file", 2, keys=k),
    "history": _history,
    "co_change": lambda t, k: U.co_change(t["commits"], keys=k, block=2),
    "co_occurrence": _co,
    "rituals": lambda t, k: U.usage_rituals(_co(t, k), _usage(t, k), 2, 0.3, keys=k),
    "deviations": lambda t, k: U.ritual_deviations(t["usages"], U.usage_rituals(_co(t, k), _usage(t, k), 2, 0.3, keys=k), 0.35, keys=k),
    "keywords": lambda t, k: U.file_keywords(t["files"], 2, "file", keys=k),
    "keyword_index": lambda t, k: U.keyword_index(U.file_keywords(t["files"], 2, keys=k), keys=k),
    "complexity": lambda t, k: U.complexity(t["files"], keys=k),
    "duplicates": lambda t, k: U.duplicate_definitions(t["usages"], "symbol_id", keys=k),
    "quality": lambda t, k: U.context_quality(t["catalog"], t["catalog"].where("exported"), keys=k),
    "neighbourhood": lambda t, k: G.neighbourhood(t["edges"], _seeds(t, k), 3, keys=k),
    "neighbourhood_summary": lambda t, k: G.neighbourhood_summary(t["edges"], _seeds(t, k), 2, external=t["imports"].select(*k, F.col("file").alias("node"), "package"), components=G.cycles(t["edges"], keys=k), keys=k),
    "blast": lambda t, k: G.blast_radius(t["edges"], _seeds(t, k), t["catalog"].select(*k, F.col("symbol_id").alias("node"), "file"), keys=k),
    "hubs": lambda t, k: G.hubs(t["edges"], 2, keys=k),
    "cycles": lambda t, k: G.cycles(t["edges"], keys=k),
    "ancestors": _closure,
    "scope_metrics": lambda t, k: G.scope_metrics(_closure(t, k), t["scoped"], keys=k),
    "entries": lambda t, k: G.entry_points(t["edges"], keys=k),
    "leaves": lambda t, k: G.leaf_nodes(t["edges"], keys=k),
    "related": lambda t, k: G.related_symbols(t["edges"], _co(t, k), 4, keys=k),
    "relevant": lambda t, k: G.relevant_symbols(_as_symbol(t["imports"], k), G.related_symbols(t["edges"], _co(t, k), 4, keys=k), 5, keys=k),
    "suggest": lambda t, k: K.suggest_similar(t["imports"].select(*k, F.concat("name", "package").alias("target")), t["catalog"].select(*k, "name"), 2, keys=k),
    "levenshtein": lambda t, k: K.levenshtein_neighbours(t["imports"].select(*k, F.concat("name", "package", "name").alias("name")), 2, keys=k),
    "hotspots": lambda t, k: K.hotspots(_history(t, k), 0.0, 3, keys=k),
    "recent": lambda t, k: K.recently_modified(t["commits"], 3, keys=k),
    "lineage": lambda t, k: K.lineage_score(_history(t, k), K.recently_modified(t["commits"], 3, keys=k), K.hotspots(_history(t, k), 0.0, 3, keys=k), keys=k),
    "relevance": lambda t, k: K.score_relevance(K.relevance_signals(t["usages"].select(*k, "file", F.col("symbol_id").alias("symbol")), _usage(t, k).withColumnRenamed("symbol_id", "symbol"), imported=_as_symbol(t["imports"], k), hot=_history(t, k), similar=K.similar_files(t["imports"], t["imports"].where("symbol_id < 5"), keys=k), keys=k).withColumn("score", F.col("score").cast("decimal(20,8)")), 6, keys=k),
    "diff_risk": lambda t, k: D.diff_risk(t["imports"], t["catalog"].select(*k, "name", F.when(F.col("exported"), "added").otherwise("removed").alias("change_type")), t["catalog"], "^a", keys=k),
    "changed_files": lambda t, k: D.changed_files(t["files"].where("file < 'src/c'"), t["files"].where("file > 'a'").withColumn("content", F.concat("content", "language")), keys=k),
    "extracted": lambda t, k: X.extract_usages(_code(t, k), keys=k),
    "single_use": lambda t, k: X.single_use_interface(_code(t, k), keys=k),
    "endpoints": lambda t, k: C.match_endpoints(_services(t, k), _routes(t, k), keys=k, methods=True),
    "unmatched_routes": lambda t, k: C.unmatched_routes(_routes(t, k), C.match_endpoints(_services(t, k).where("service < 9"), _routes(t, k), keys=k), _services(t, k), keys=k),
    "similar_routes": lambda t, k: C.similar_route(_services(t, k), _routes(t, k), keys=k),
    "models": lambda t, k: C.match_models(_fields(t, k), 0.0, 0.1, keys=k),
    "field_diff": lambda t, k: C.field_diff(C.match_models(_fields(t, k), 0.0, 0.1, keys=k), _fields(t, k), keys=k),
    "coverage": lambda t, k: C.field_coverage(C.match_models(_fields(t, k), 0.0, 0.1, keys=k), _fields(t, k), C.match_models(_fields(t, k), 0.0, 0.1, keys=k), keys=k),
    "events": lambda t, k: C.event_contract(t["imports"].select(*k, F.col("name").alias("event"), F.lit("emit").alias("action")), t["catalog"].select(*k, F.col("name").alias("event"), F.lit("server-to-client").alias("direction")), keys=k),
    "contract_summary": lambda t, k: C.contract_summary(t["usages"].select(*k, F.lit("high").alias("severity")), C.match_endpoints(_services(t, k), _routes(t, k), keys=k), keys=k),
    "line_diff": lambda t, k: D.line_diff(t["files"].select(*k, F.substring("file", 1, 1).alias("file"), F.when(F.col("language") == "ts", "old").otherwise("new").alias("side"), F.translate("content", " ", "\n").alias("text")), keys=k),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_projects_stay_apart(tables, name):
    case = CASES[name]
    as_rows = lambda df, columns: sorted(str([str(x) for x in r]) for r in df.select(*columns).collect())
    both = case(tables, KEYS)
    columns = [c for c in both.columns if c != "project_id"]
    want = []
    for p in (1, 2):
        alone = case({n: df.where(f"project_id = {p}").drop("project_id") for n, df in tables.items()}, ())
        want += as_rows(alone.withColumn("project_id", F.lit(p).cast("long")), ["project_id", *columns])
    assert as_rows(both, ["project_id", *columns]) == sorted(want) and want
