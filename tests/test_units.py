"""Small fixtures whose results are known, and properties."""

import itertools
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import contracts as C
from loomspan.operators import diff as D
from loomspan.operators import extract as X
from loomspan.operators import findings as O
from loomspan.operators import graph as G
from loomspan.operators import rank as K
from loomspan.operators import resolve as R
from loomspan.operators import usage as U
from loomspan.operators.components import connected_components
from loomspan.sources import files as files_
from loomspan.streaming import edits as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CHAIN = [("UserModule", "API_CORE"), ("AuthService", "UserModule"), ("LoginForm", "AuthService")]


def blast(spark, edges, target, depth):
    e = spark.createDataFrame(edges, "src string, dst string")
    files = spark.createDataFrame([(n, f"{n}.ts") for n in {x for p in edges for x in p}], "node string, file string")
    return G.blast_radius(e, spark.createDataFrame([(target,)], "seed string"), files, depth).first()


def test_blast_chain(spark):
    assert blast(spark, CHAIN, "API_CORE", 5)["symbols"] == 3
    assert blast(spark, CHAIN, "API_CORE", 2)["symbols"] == 2
    assert blast(spark, CHAIN, "AuthService", 2)["severity"] == "low"
    assert blast(spark, CHAIN, "UserModule", 5)["severity"] == "medium"
    assert blast(spark, CHAIN + [(f"c{i}", "API_CORE") for i in range(10)], "API_CORE", 5)["severity"] == "high"


def test_ritual(spark):
    co = spark.createDataFrame([("startSession", "trackEvent", 10), ("trackEvent", "startSession", 10)], "a string, b string, n long")
    usage = spark.createDataFrame([("startSession", 10), ("trackEvent", 10)], "symbol_id string, usage long")
    rituals = U.usage_rituals(co, usage)
    assert rows(rituals.select("symbol", "expected", "confidence")) == [("startSession", "trackEvent", 0.7), ("trackEvent", "startSession", 0.7)]
    alone = spark.createDataFrame([("a.ts", "startSession"), ("b.ts", "startSession"), ("b.ts", "trackEvent")], "file string, symbol_id string")
    assert rows(U.ritual_deviations(alone, rituals).select("file", "expected")) == [("a.ts", "trackEvent")]


@pytest.mark.parametrize(
    ("severities", "types", "score", "verdict"),
    [(["critical"], ["nonExistentFunction"], 75, "REJECT"), (["high"] * 3, ["nonExistentFunction"] * 3, 55, "REVIEW"), (["low"], ["unusedExport"], 98, "CLEAN_UP"), (["low"], ["dependencyHallucination"], 97, "REJECT")],
)
def test_score_and_verdict(spark, severities, types, score, verdict):
    f = spark.createDataFrame([(1, s, t) for s, t in zip(severities, types, strict=True)], "run long, severity string, type string")
    assert O.quality_score(f, ["run"]).first()["score"] == score
    assert O.verdict(f, ["run"]).first()["verdict"] == verdict


def test_method_mismatch_and_missing_param(spark):
    services = spark.createDataFrame([(1, "GET", "/api/clients"), (2, "POST", "/api/clients"), (3, "GET", "/orders/${order.orderId}")], "service long, method string, path string")
    routes = spark.createDataFrame([("POST", "/api/clients"), ("GET", "/orders/{order_id}")], "method string, path string")
    m = C.match_endpoints(services, routes)
    assert rows(m.select("service", "tier", "score")) == [(1, 5, 50), (2, 1, 100), (3, 3, 100)]
    near = C.similar_route(services, routes)
    assert rows(C.unmatched_services(m, near).select("service", "finding", "severity")) == [(1, "methodMismatch", "critical")]
    pair = spark.createDataFrame([(1, "getClient", "GET", "/api/clients", "/api/clients/{client_id}", "GET")], "service long, name string, method string, path string, route string, route_method string")
    assert {r["finding"] for r in C.path_compat(pair).collect()} == {"missingParam", "pathMismatch"}


def test_field_diff(spark):
    fields = spark.createDataFrame([("C", 0, "clientName", "string", 0), ("C", 0, "age", "number", 0), ("C", 1, "client_name", "string", 1), ("C", 1, "age", "str", 1), ("C", 1, "email", "str", 1)], "owner string, side int, field string, ftype string, required int")
    pairs = spark.createDataFrame([("C", "C")], "owner string, model string")
    got = rows(C.field_diff(pairs, fields).select("field", "finding"))
    assert got == [("age", "typeMismatch"), ("clientname", "namingMismatch"), ("email", "missingRequired")]
    assert C.compatibility_score(pairs, C.field_diff(pairs, fields)).first()["score"] == 70


def test_type_problem(spark):
    df = spark.createDataFrame([("string", "UUID"), ("Date", "datetime"), ("item[]", "str"), ("number", "int")], "a string, b string")
    assert [r[0] and (r[0]["severity"], r[0]["problem"]) for r in df.select(C.type_problem(F.col("a"), F.col("b"))).collect()] == [None, ("high", "datetime"), ("high", "array"), None]


def test_graphql_double_prefix_handlers(spark):
    make = spark.createDataFrame
    score = C.graphql_contract(
        make([("q1",), ("q2",)], "operation string"), make([("q1",)], "operation string"), make([("q1", "User", "name"), ("q1", "User", "nick")], "operation string, parent string, field string"), make([("User", "name")], "parent string, field string"),
        make([("q1", "id", "Int", False)], "operation string, name string, vtype string, used boolean"), make([("q1", "id", "ID!", True), ("q1", "org", "ID!", True)], "operation string, name string, vtype string, required boolean"),
    )
    assert rows(score) == [("q1", 35, True), ("q2", 0, False)]
    services = make([("a.ts", "/api/users"), ("b.ts", "/api/users"), ("a.ts", "/users")], "file string, path string")
    sources = make([("a.ts", "const baseURL = 'http://x/api'"), ("b.ts", "const baseURL = 'http://x'")], "file string, content string")
    assert rows(C.double_prefix(services, sources)) == [("a.ts", "/api/users")]


CODE = """import React, { useState as s, useEffect } from 'react';
import * as path from "path";
import type { Shape } from './shape';
export async function loadUser(id: string): Promise<User> {
  const res = await fetch('/api/users', { method: 'POST' });
  try { run(); } catch (e) { console.log(e); }
  return new Store(res).save(api.get<User>('/users/1'));
}
export const total = (a, b) => a + b;
export default class Cart extends Base implements Shape {
  // @ts-ignore
  n = window.secret;
}
interface Item {
  id: string;
  label?: number;
}
router.get('/items/:id', auth, getItem);
export { helper as tool, other };
"""
PY = '''from .models import User, Order as O
import os.path as p
@router.post("/orders")
# note
async def create_order(payload: Order):
    for item in payload: total = item
    return requests.get("/stock")
class Client(BaseModel):
    name: str
    nick: Optional[str] = None
def _hidden(): pass
'''


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame([("a.ts", "js", CODE), ("b.py", "python", PY), ("c.ts", "js", None), ("d.ts", "js", "")], "file string, language string, content string")


def test_extract(spark, code):
    assert set(rows(X.extract_symbols(code).select("name", "kind", "exported"))) == {("loadUser", "function", True), ("total", "function", True), ("Cart", "class", True), ("Item", "interface", False), ("create_order", "function", True), ("Client", "class", True), ("_hidden", "function", False)}
    imports = set(rows(X.extract_imports(code).select("module", "imported", "local", "is_relative")))
    assert {("react", "useState", "s", False), ("react", "useEffect", "useEffect", False), ("react", "default", "React", False), ("path", "*", "path", False), ("./shape", "Shape", "Shape", True), (".models", "User", "User", True), (".models", "Order", "O", True), ("os.path", "*", "p", False)} <= imports
    assert set(rows(X.extract_exports(code).select("name", "is_default"))) == {("loadUser", False), ("total", False), ("Cart", True), ("tool", False), ("other", False)}
    assert set(rows(X.extract_routes(code).select("method", "path", "handler"))) == {("GET", "/items/:id", "getItem"), ("POST", "/orders", "create_order")}
    assert set(rows(X.extract_services(code).select("method", "path"))) == {("POST", "/api/users"), ("GET", "/users/1"), ("GET", "/stock")}
    assert set(rows(X.extract_fields(code))) == {("a.ts", "Item", "id", "string", True), ("a.ts", "Item", "label", "number", False), ("b.py", "Client", "name", "str", True), ("b.py", "Client", "nick", "Optional[str]", False)}
    assert {("instantiation", None, "Store"), ("call", None, "fetch"), ("methodCall", "console", "log"), ("call", None, "run")} <= {(r["usage_type"], r["object"], r["name"]) for r in X.extract_usages(code).collect()}
    assert {("User", "generic"), ("Base", "extends"), ("Shape", "implements"), ("Order", "annotation")} <= set(rows(X.extract_type_refs(code).select("name", "context")))
    assert {"res", "a", "b", "payload", "item", "total"} <= {r["name"] for r in X.extract_local_definitions(code).collect()}
    assert rows(X.suppressed_access(code).select("object", "member")) == [("window", "secret")]
    assert rows(X.log_only_catch(code)) == [("a.ts", 1)]
    assert rows(X.single_use_interface(code)) == [("a.ts", "Item")]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "package.json").write_text('{"dependencies": {"react": "1", "@s/x": "2"}, "devDependencies": {"@types/node": "1"}}')
    (tmp_path / "requirements.txt").write_text("Flask-Login[x]>=1\n# c\n\nnumpy; python_version>'3'\n")
    (tmp_path / "pyproject.toml").write_text('[project]\ndependencies = [\n "ruff>=1",\n "a-b",\n]\n')
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "node_modules" / "x.py").write_text("x = 1")
    f = files_.scan_files(spark, str(tmp_path), [".json", ".txt", ".toml", ".py"])
    assert f.count() == 4
    assert {r["package"] for r in files_.read_manifests(f).collect()} == {"react", "@s/x", "@types/node", "node", "flask_login", "numpy", "ruff", "a_b"}
    inits = spark.createDataFrame([("a/__init__.py", '__all__ = ["One", "two", "not valid"]'), ("b/__init__.py", "x = 1"), ("c.py", '__all__ = ["no"]')], "file string, content string")
    assert {r["name"] for r in files_.read_module_exports(inits).collect()} == {"One", "two", "*"}


def test_jaro_winkler():
    assert K.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert K.jaro_winkler("abc", "abc") == 1
    assert K.jaro_winkler("", "a") == 0 == K.jaro_winkler("ab", "xy")


def test_suggest_similar(spark):
    names = spark.createDataFrame([("getUserById",), ("getUserByEmail",), ("zzz",)], "name string")
    got = K.suggest_similar(spark.createDataFrame([("getUserByID",), (None,)], "target string"), names).collect()
    assert [r["name"] for r in got] == ["getUserById", "getUserByEmail"]


def test_line_runs(spark):
    v = [("add", "old", "a\nb"), ("add", "new", "a\nb\nc"), ("del", "old", "a\nb\nc\nd\ne"), ("del", "new", "a\nc\nb\nd\ne"), ("mod", "old", "a\nb\nc"), ("mod", "new", "a\nx\nc"), ("same", "old", "a"), ("same", "new", "a"), ("gone", "old", "a\nb"), ("one", "old", "a\nb\nc"), ("one", "new", "a\nc")]
    got = rows(D.line_runs(spark.createDataFrame(v, "file string, side string, text string")))
    # Found on the old side alone: the line counts as modified, and the rest of the old side as deleted.
    assert got == [("add", "addition", 3, 3), ("del", "addition", 2, 2), ("del", "deletion", 5, 5), ("del", "modification", 3, 3), ("del", "modification", 4, 4), ("gone", "deletion", 1, 2), ("mod", "modification", 2, 2), ("one", "deletion", 3, 3), ("one", "modification", 2, 2)]


def naive_runs(old, new):
    """The same rule, written down by cases with whole-list searches."""
    out, i, j = [], 0, 0
    while True:
        if i >= len(old) or j >= len(new):
            out += [("addition", j + 1, len(new))] if i >= len(old) and j < len(new) else []
            out += [("deletion", i + 1, len(old))] if i < len(old) else []
            return out
        in_old = old[i : i + 10].index(new[j]) + i if new[j] in old[i : i + 10] else -1
        in_new = new[j : j + 10].index(old[i]) + j if old[i] in new[j : j + 10] else -1
        if old[i] == new[j]:
            i, j = i + 1, j + 1
        elif in_old >= 0 and in_old < in_new:
            out.append(("deletion", i + 1, in_old))
            i = in_old
        elif in_new >= 0:
            out.append(("addition", j + 1, in_new))
            j = in_new
        else:
            out.append(("modification", i + 1, i + 1))
            i, j = i + 1, j + 1


def test_line_runs_against_a_naive_version(spark):
    r = random.Random(3)
    pairs = [([r.choice("abcdefgh") for _ in range(r.randint(1, 30))], [r.choice("abcdefgh") for _ in range(r.randint(1, 30))]) for _ in range(200)]
    v = [(i, side, "\n".join(x)) for i, pair in enumerate(pairs) for side, x in zip(("old", "new"), pair, strict=True)]
    got = rows(D.line_runs(spark.createDataFrame(v, "file long, side string, text string")))
    assert got == sorted((i, *x) for i, pair in enumerate(pairs) for x in naive_runs(*pair))


def test_carry_over(spark):
    findings = spark.createDataFrame([("f", 1), ("f", 3), ("f", 5)], "file string, line long")
    changes = spark.createDataFrame([("f", 3, 3)], "file string, start long, end long")
    assert rows(D.carry_over(findings, changes, spark.createDataFrame([("f", 10)], "file string, n_lines long"))) == [("f", 1), ("f", 5)]
    assert rows(D.carry_over(findings, changes, spark.createDataFrame([("f", 3)], "file string, n_lines long"))) == []


def test_intent_window(spark):
    make = lambda m, p: (m, "a", f"2024-01-01 00:{m:02d}:00", p)
    edits = spark.createDataFrame([make(1, "src/old/x"), make(10, "src/components/a"), make(11, "src/components/b"), make(12, "src/components/a"), make(12, "src/utils/u")], "event_id long, agent string, t string, path string").withColumn("ts", F.col("t").cast("timestamp"))
    edits = edits.withColumn("language", F.when(F.col("path").contains("utils"), "py").otherwise("ts")).withColumn("symbol", F.substring("path", -1, 1))
    got = T.intent_focus(T.recent_intent(edits)).where("window_end = timestamp'2024-01-01 00:14:00'").first()
    assert (got["focus"], got["n"], got["language"], got["symbols"]) == ("src/components", 4, "ts", ["a", "b", "u"])
    at = F.expr("timestamp'2024-01-01 00:13:00'")
    assert {r["path"] for r in T.file_relevance(edits, at).collect()} == {"src/components/a", "src/components/b", "src/utils/u"}
    files = spark.createDataFrame([("src/components/deep/z",), ("src/components/a",), ("src/other",), ("top",)], "path string")
    assert {r["path"]: r["relevance"] for r in T.file_relevance(edits, at, files=files).collect()}["src/components/deep/z"] == 0.5
    assert {(r["symbol"], r["relevance"]) for r in T.symbol_relevance(edits, at).collect()} == {("a", 0.8), ("b", 0.8), ("u", 0.8)}


def test_alerts_survive_late_batches_and_restarts(spark, tmp_path):
    """The newest event of a file wins whatever batch brings it, and a second run goes on from the first one's checkpoint."""
    schema = "project_id long, file string, event_id long, severity string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "alerts")
    add = lambda *rows_: spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: rows(T.alert_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), folder=folder))
    add((1, "a", 10, "critical"), (1, "b", 11, "low"))
    add((1, "a", 5, "low"), (1, "b", 4, "high"))  # older events in a later batch
    assert run() == [(1, "a", 10, "critical")]
    add((1, "b", 20, "high"), (1, "a", 21, "low"))
    assert run() == [(1, "b", 20, "high")]
    assert run() == [(1, "b", 20, "high")]


def test_validation_by_batches(spark, tmp_path):
    """Three checks for each batch; a deletion clears, and a late batch with older events is void."""
    schema = "event_id long, file long, change_type string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    catalog = spark.createDataFrame([(1, 1, True), (2, 2, True)], "symbol_id long, file long, exported boolean")
    imports = spark.createDataFrame([(1, 2), (3, 2)], "file long, symbol_id long")
    usages = spark.createDataFrame([(1, 7), (3, 2), (2, 1)], "file long, symbol_id long")
    add = lambda *rows_: spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: rows(T.incremental_validate(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), catalog, imports, usages, folder))
    add((1, 1, "change"), (2, 2, "add"), (3, 3, "change"))
    assert run() == [(1, 1, 1, "unusedExport"), (1, 1, 2, "unusedImport"), (1, 1, 7, "unresolvedReference")]
    add((9, 1, "unlink"))
    add((4, 1, "change"))
    assert run() == []


def test_names_within_an_edit_distance(spark):
    r = random.Random(4)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(150)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    frame = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "name string")
    for most in (1, 3):
        want = sorted((a, b, d) for a in names for b in names if a != b and (d := distance(a, b)) <= most)
        assert rows(K.levenshtein_neighbours(frame, most)) == want


def test_similar_routes_against_all_pairs(spark):
    r = random.Random(5)
    words = ["users", "user", "orders", "order-items", "{id}", "reports", "report", "search", "a", "ab", "settings", "setting"]
    path = lambda: "/" + "/".join(r.choice(words) for _ in range(r.randint(1, 4)))
    services, routes = [(i, path()) for i in range(60)], sorted({path() for _ in range(60)})
    s, t = spark.createDataFrame(services, "service long, path string"), spark.createDataFrame([(p,) for p in routes], "path string")
    got = {x["service"]: (x["route"], round(x["similarity"], 6)) for x in C.similar_route(s, t).collect()}
    segments = [(a, b) for a in words for b in words]
    near = {(x["a"], x["b"]): x["s"] for x in spark.createDataFrame(segments, "a string, b string").withColumn("s", S.segment_similarity(F.col("a"), F.col("b"))).collect()}
    want = {}
    for i, p in services:
        x, best = p[1:].split("/"), []
        for q in routes:
            y = q[1:].split("/")
            if len(x) == len(y):
                marks = [1.0 if a == b else 0.6 if "{" in a + b else near[a, b] if near[a, b] >= 0.5 else 0.0 for a, b in zip(x, y, strict=True)]
                if (mean := 1.0 if p == q else round(sum(marks) / len(marks), 9)) >= 0.7:
                    best.append((-mean, q))
        if best:
            want[i] = (min(best)[1], round(-min(best)[0], 6))
    assert got == want


def test_models_meet_by_name_and_by_rare_fields(spark):
    rows_ = [("User", 0, None), ("user", 1, "id"), ("user", 1, "mail"), ("Order", 0, "id"), ("Order", 0, "total"), ("Order", 1, "name"), ("Bill", 0, "id"), ("Bill", 0, "sum"), ("Bill", 0, "due"), ("Invoice", 1, "id"), ("Invoice", 1, "sum"), ("Invoice", 1, "due"), ("Loner", 0, "id")]
    rows_ += [(f"M{i}", 1, f) for i in range(20) for f in ("id", f"x{i}", f"y{i}")]
    got = {(x["owner"], x["model"], x["tier"]) for x in C.match_models(spark.createDataFrame(rows_, "owner string, side int, field string")).collect()}
    assert got == {("User", "user", 2), ("Bill", "Invoice", 3)}


def test_unregistered_routes(spark):
    df = spark.createDataFrame([("GET", "/users", "src/routes/u.ts"), ("GET", "/api/users", "src/routes/u.ts"), ("GET", "/users", "src/u.ts"), ("PUT", "/x", "src\\routes\\x.ts"), ("PUT", "/y", None)], "method string, path string, file string")
    assert [r[:2] for r in rows(C.unregistered_routes(df))] == [("GET", "/users"), ("PUT", "/x")]


def test_walks_are_never_cut(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "src long, dst long")
    assert len(rows(G.cycles(ring))) == 12
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    assert G.neighbourhood(chain, spark.createDataFrame([(0,)], "seed long"), 9, "imports").agg(F.max("depth")).first()[0] == 9


def test_find_symbol_takes_the_nearest(spark):
    symbols = spark.createDataFrame([("f", "a", "s", 1), ("f", "a", "t", 2), ("f", "b", "s", 3), ("f", "b", None, 4), ("g", "z", None, 5)], "name string, file string, scope string, symbol long")
    asked = [(1, "f", "a", "t"), (2, "f", "b", "x"), (3, "f", "c", "s"), (4, "f", "c", "x"), (5, "f", "c", None), (6, "h", "a", "s"), (7, "g", "a", "s")]
    assert rows(R.find_symbol(spark.createDataFrame(asked, "id long, name string, file string, scope string"), symbols)) == [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (7, 5)]


def test_contract_scores_of_events(spark):
    client = spark.createDataFrame([("a", "emit"), ("a", "on"), ("b", "emit")], "event string, action string")
    server = spark.createDataFrame([("a", "client-to-server")], "event string, direction string")
    assert rows(C.event_contract(client, server)) == [("a", "emit", 100), ("a", "on", 70), ("b", "emit", 0)]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_jaccard_properties(pairs):
    for a, b in itertools.islice(pairs, 3):
        assert K.jaro_winkler(str(a), str(b)) <= 1.0 + 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cycles(spark, seed):
    import random

    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(36)] + [(5, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: min(y for y in parent if find(y) == find(x)) for x in parent}
    out = {}
    for a, b in edges[:-1]:
        out.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), list(out.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += out.get(y, ())
        return seen

    ways = {x: reach(x) for x in parent}
    want = {x: min(y for y in ways[x] | {x} if x in ways.get(y, ()) and y in ways[x]) for x in parent if x in ways[x]}
    assert dict(rows(G.cycles(spark.createDataFrame(edges[:-1], "src long, dst long")))) == want


def test_merge_is_idempotent_and_dedupe(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file string, v long")
    new = spark.createDataFrame([("a", 9)], "file string, v long")
    once = D.merge_changed(base, new)
    assert rows(once) == rows(D.merge_changed(once, new)) == [("a", 9), ("b", 3)]
    assert rows(O.dedupe(base, ["file"], ["v"])) == [("a", 1), ("b", 3)]


def test_resolved_and_unresolved_partition_usages(spark):
    usages = spark.createDataFrame([(i % 7, "call", i % 5) for i in range(40)], "symbol_id long, usage_type string, file long")
    catalog = spark.createDataFrame([(1, 0), (2, 0)], "symbol_id long, file long")
    for n in (1, 7):
        open_ = R.unresolved_references(usages.repartition(n), catalog)
        assert open_.count() + usages.join(catalog.select("symbol_id"), "symbol_id", "left_semi").count() == 40


def test_scalars(spark):
    df = spark.createDataFrame([("src/pages/app.test.tsx", "GetUserName", "/users/${user.userId}/x/{id}")], "p string, n string, r string")
    got = df.select(S.is_test(F.col("p")), S.extension(F.col("p")), S.parent_directory(F.col("p")), S.naming_convention(F.col("n")), S.path_params(F.col("r")), S.generic_params(F.col("r"))).first()
    assert tuple(got) == (True, ".tsx", "src/pages", "PascalCase", ["id", "user_id"], "/users/{param}/x/{param}")
    assert S.glob_to_regex("src/**/*.ts") == r"^src/(?:.*/)?[^/]*\.ts$"


def test_rule_table_against_a_plain_scan(spark):
    """All rules on a source of each language, against another engine's matches and their line numbers."""
    import regex

    from loomspan.functions.rules import RULES

    js = """import { one } from './one'
import lone from './other'
const a_b = 5
const x = fetchAll(1).then(y => y)
try { f(200) } catch (e) { }
try { g() } catch (e) {
  console.log(e)
}
function check(input) {
  return input
}
// TODO later
const p = { a: 1 };
const q = { a: 2 };
let n: any = fs.readFileSync('x')
for (let i = 0; i < 3; i++) { s += 'x' }
class Box extends React.Component { }
useEffect(() => { load() }, [])
if (a) { if (b) { if (c) { if (d) { } } } }
run((a) => { go((b) => { stop((c) => 1) }) })
function long(a, b) {
""" + "  step();\n" * 90 + "}\n"
    py = "global state\ndef f(a=[]):\n    try:\n        g(404)\n    except:\n        pass  # TODO\n"
    files = [("a.ts", "typescript", js), ("a.js", "javascript", js), ("b.py", "python", py), ("c.py", "python", None), ("d.py", "python", "")]
    want = []
    for file, language, text in files:
        for name, severity, languages, pattern in RULES:
            if language in languages:
                want += [(file, name, severity, 1 + text[: m.start()].count("\n")) for m in regex.finditer(pattern, text or "")]
    got = rows(X.rule_matches(spark.createDataFrame(files, "file string, language string, content string")))
    assert got == sorted(want) and {r[0] for r in RULES} - {w[1] for w in want} <= {"AP-024"}


def test_keywords_of_paths_and_entry_points_of_frameworks(spark):
    files = spark.createDataFrame([(1, "alpha alpha beta", "src/Users/.cache/alpha.test.ts"), (2, None, None)], "file long, content string, path string")
    assert rows(U.file_keywords(files, path="path")) == [(1, "alpha", 2), (1, "alpha.test", 0), (1, "beta", 1), (1, "src", 0), (1, "users", 0)]
    paths = spark.createDataFrame([("web/app/x/page.tsx",), ("web/pages/a.tsx",), ("web/pages/_app.tsx",), ("srv/api/u.py",), ("lib/u.py",)], "p string")
    found = lambda f: [r[0] for r in paths.select(S.is_entry_point(F.col("p"), f)).collect()]
    assert found(("nextjs",)) == [True, True, False, False, False] and found(("fastapi",)) == [False, False, False, True, False]


def test_files_of_findings_follow_the_rows(spark, tmp_path):
    """300 runs, whose names keep their type, added in two goes."""
    from loomspan.sources import files as R

    path = str(tmp_path / "findings")
    runs = spark.range(600).selectExpr("lpad(cast(id % 300 as string), 5, '0') as run_id", "timestamp'2024-01-01' as ts", "id")
    R.write_findings(runs, path)
    R.write_findings(runs.where("run_id < '00010'"), path)
    assert len(list((tmp_path / "findings").rglob("*.parquet"))) <= 8
    got = R.read_findings(spark, path, since="2024-01-01").groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in got} == {f"{i:05d}": 4 if i < 10 else 2 for i in range(300)}


def test_tasks_of_queries_are_bounded(spark):
    """Whatever the session says, a query's tasks read a bounded size; what the session said comes back after."""
    from loomspan.operators.tables import unbounded
    from loomspan.plans.all_queries import QUERIES
    from tests.conftest import SF

    unbounded(spark)
    key, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    try:
        QUERIES["carry_over"](spark, SF)
        QUERIES["hotspots"](spark, SF)
        assert int(spark.conf.get(key)) == 4 << 20 and int(spark.conf.get(parts)) >= 2000
        unbounded(spark)
        assert spark.conf.get(key) == "1g" and spark.conf.get(parts, None) is None
    finally:
        spark.conf.set(key, before)


def test_words_are_counted_before_a_shuffle(spark):
    """Texts are dealt by file once; their words, which are larger, are ranked where they are."""
    from loomspan.operators import usage as U

    files = spark.createDataFrame([("a", "word word other the_one 1abc abc xabcd9 word1"), ("a", "word more"), ("b", "WORD _nope 9word")], "file string, content string")
    got = U.file_keywords(files, k=3)
    assert sorted(map(tuple, got.collect())) == [("a", "more", 1), ("a", "other", 1), ("a", "word", 3), ("b", "word", 1)]
    assert str(got.select("*")._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1


def test_equal_versions_are_not_walked(spark):
    """One row a file goes to Python, in batches, and only if its versions differ."""
    from loomspan.operators import diff as D

    rows = [(1, "old", "a\nb"), (1, "new", "a\nb"), (2, "old", "a\nb"), (2, "new", "a\nc\nb"), (3, "new", "x\ny"), (4, "old", None), (4, "new", None), (5, "old", ""), (5, "new", None)]
    got = D.line_runs(spark.createDataFrame(rows, "file long, side string, text string"))
    assert sorted(map(tuple, got.collect())) == [(2, "addition", 2, 2), (3, "addition", 1, 2), (5, "deletion", 1, 1)]
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_every_related_symbol_counts(spark, tmp_path):
    """The sums of relevance are over all related symbols of an imported one, also where it has more than ten."""
    from loomspan.plans.all_queries import QUERIES

    def table(name, rows_, schema):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    table("customer", [(c,) for c in range(100)], "c_custkey long")
    table("part", [(0,), (1,)], "p_partkey long")
    table("orders", [(3 * i, 0, "F") for i in range(1, 26)], "o_orderkey long, o_custkey long, o_orderstatus string")  # 0 calls 3, 6, ... 75
    table("lineitem", [(3, 1, 0, 1, "A", 1), (3, 2, 0, 2, "A", 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity long")
    assert rows(QUERIES["relevant_symbols"](spark, str(tmp_path))) == [(3 * i, 0.9) for i in range(1, 21)]
    edges = spark.createDataFrame([(0, i) for i in range(1, 31)], "src long, dst long")
    co = spark.createDataFrame([], "a long, b long, n long")
    assert G.related_symbols(edges, co, None).where("symbol = 0").count() == 30
    assert G.related_symbols(edges, co).where("symbol = 0").count() == 10


def test_keyword_index_holds_the_files(spark):
    """The index names every file of a word, in lists of bounded size that can be looked up; counts come from the lists."""
    words = [("hot", f) for f in range(150)] + [("hot", 7), ("rare", 3), ("both", None), ("both", 9), ("bare", None)]
    keywords = spark.createDataFrame(words, "keyword string, file long")
    index = U.keyword_index(keywords, 64)
    lists = sorted((r["keyword"], r["chunk"], r["n"], r["values"]) for r in index.collect())
    assert [(w, c, n) for w, c, n, _ in lists] == [("bare", 0, 0), ("both", 0, 1), ("hot", 0, 64), ("hot", 1, 64), ("hot", 2, 22), ("rare", 0, 1)]
    assert sum((v for w, *_, v in lists if w == "hot"), []) == list(range(150)) and [v for w, *_, v in lists if w != "hot"] == [[], [9], [3]]
    asked = spark.createDataFrame([("hot", 99), ("hot", 150), ("rare", 3), ("bare", 1)], "keyword string, value long")
    assert rows(U.in_postings(index, asked, "keyword")) == [("hot", 99), ("rare", 3)]
    assert rows(U.keyword_files(index)) == [("bare", 0, None), ("both", 1, 9), ("hot", 150, 0), ("rare", 1, 3)]
