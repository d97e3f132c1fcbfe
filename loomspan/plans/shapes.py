"""Extractors over scripts of many shapes: each row of part is a script of one of the shapes below, so that every rule has rows.

A shape is its language, its lines, and what each extractor finds in it, as templates over the part's key {k} and size {z}.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.rules import RULES
from loomspan.operators import extract as X
from loomspan.operators.tables import spread
from loomspan.plans.registry import query
from loomspan.plans.views import table

SHAPES: list[tuple[str, list[str], dict[str, list[tuple]]]] = [
    ("js", ["export const f{k} = async (a, b) => a", "const g{k} = x => x"], {"symbols": [(1, "f{k}", "function", True), (2, "g{k}", "function", False)], "exports": [(1, "f{k}", False)]}),
    ("js", ["export default class C{k} {", "}", "class D{k} extends C{k} {}"], {"symbols": [(1, "C{k}", "class", True), (3, "D{k}", "class", False)], "exports": [(1, "C{k}", True)], "types": [(3, "C{k}", "extends")]}),
    ("js", ["export default function main{k}() {", "}"], {"symbols": [(1, "main{k}", "function", True)], "exports": [(1, "main{k}", True)]}),
    ("js", ["export default { k: {k} }"], {"exports": [(1, "default", True)]}),
    ("js", ["export enum E{k} { A, B }", "const enum G{k} { A }", "export const enum H{k} { A }"], {"symbols": [(1, "E{k}", "enum", True), (2, "G{k}", "enum", False), (3, "H{k}", "enum", True)], "exports": [(1, "E{k}", False), (3, "H{k}", False)]}),
    ("js", ["export type T{k} = {", "  id: string", "  size?: number", "}", "type U{k}<V> = V"], {"symbols": [(1, "T{k}", "type", True), (5, "U{k}", "type", False)], "exports": [(1, "T{k}", False)], "fields": [("T{k}", "id", "string", True), ("T{k}", "size", "number", False)], "types": [(5, "V", "generic")]}),
    ("js", ["import D{k} from 'd{k}'", "import * as n{k} from '../n'", "import './side{k}.css'", "const r = require('r{k}')"], {"imports": [(1, "d{k}", "default", "D{k}", False), (2, "../n", "*", "n{k}", True), (3, "./side{k}.css", "*", "", True), (4, "r{k}", "*", "", False)]}),
    ("js", ["import D, { a as b{k}, c } from './m{k}'"], {"imports": [(1, "./m{k}", "a", "b{k}", True), (1, "./m{k}", "c", "c", True), (1, "./m{k}", "default", "D", True)]}),
    ("js", ["fetch('/api/{k}')", "fetch(`/p/{k}`, { method: 'put' })", "userClient.delete('/u/{k}')", "api.get<Item>('/i/{z}')"], {"services": [(1, "fetch", "GET", "/api/{k}"), (2, "fetch", "PUT", "/p/{k}"), (3, "userClient", "DELETE", "/u/{k}"), (4, "api", "GET", "/i/{z}")]}),
    ("js", ["app.get('/a/{k}', list{k})", "userRouter.patch('/b/{k}', guard, save{k});", "thing.get('/c/{k}')"], {"routes": [(1, "GET", "/a/{k}", "app", "list{k}"), (2, "PATCH", "/b/{k}", "userRouter", "save{k}")]}),
    ("js", ["const u = new Box{k}(1)", "u.open{k}(2)", "run{k}()", "// skip{k}()"], {"usages": [(1, "instantiation", None, "Box{k}"), (2, "methodCall", "u", "open{k}"), (3, "call", None, "run{k}")]}),
    ("python", ["class M{k}(BaseModel):", "    name: str", "    size: Optional[int] = None", "    def area(self):", "        pass"], {"symbols": [(1, "M{k}", "class", True), (4, "area", "method", True)], "fields": [("M{k}", "name", "str", True), ("M{k}", "size", "Optional[int]", False)]}),
    ("python", ["import os.path as p{k}", "from .a{k} import b, c as d"], {"imports": [(1, "os.path", "*", "p{k}", False), (2, ".a{k}", "b", "b", True), (2, ".a{k}", "c", "d", True)]}),
    ("python", ['@app.get("/py/{k}")', "@cached", "async def get{k}():", "    return requests.post('/q/{z}')"], {"symbols": [(3, "get{k}", "function", True)], "routes": [(1, "GET", "/py/{k}", "app", "get{k}")]}),
]
_COLUMNS = {
    "symbols": ("line", "name", "kind", "exported"), "exports": ("line", "name", "is_default"), "fields": ("owner", "field", "ftype", "required"), "types": ("line", "name", "context"), "imports": ("line", "module", "imported", "local", "is_relative"),
    "services": ("line", "client", "method", "path"), "routes": ("line", "method", "path", "router", "handler"), "usages": ("line", "usage_type", "object", "name"),
}

#: A text for each rule, which matches it once, on the line given; {k} is the part's key.
RULE_TEXTS: dict[str, tuple[str, str, int]] = {
    "AP-001": ("javascript", "try { f{k}() } catch (e) { }", 1), "AP-006": ("javascript", "f{k}()\nconsole.log (x)", 2), "AP-007": ("python", "x{k}\n# TODO later", 2), "AP-017": ("javascript", "x\ny{k}\nfs.existsSync(p)", 3),
    "AP-019": ("python", "try:\n  f{k}()\nexcept:\n  pass", 3), "AP-020": ("python", "def f{k}(a, b=[]):", 1), "AP-021": ("python", "def f():\n  global g{k}", 2), "AP-016": ("typescript", "let a{k}: any", 1),
    "AP-002": ("javascript", "try { f{k}() } catch (e) { console.log(e) }", 1), "AP-003": ("javascript", "wait()\nsleep( 404 ) // {k}x", 2), "AP-005": ("javascript", "f(x)\nconst unused{k} = f()", 2), "AP-008": ("javascript", "function long{k}() { " + "x " * 300 + "}", 1),
    "AP-009": ("python", "if (a{k}) { if (b) { if (c) { if", 1), "AP-010": ("javascript", "const a = { x: {k} };\nlet b = { y: 1 };", 1), "AP-011": ("javascript", "function g{k}(a) {\n}", 1), "AP-013": ("javascript", "import { Thing{k} } from './m'", 1),
    "AP-015": ("typescript", "function h{k}(a) {", 1), "AP-018": ("javascript", "load{k}()\nfetchIt(a).then(b)", 2), "AP-022": ("javascript", "for (const x of y) { s{k} += 'a' }", 1), "AP-024": ("javascript", "function W{k}() { useState(1) }", 1),
    "AP-014": ("javascript", "f(a{k})\nconst my_name = f(my_name{k})", 2), "AP-012": ("javascript", "f{k}((a) => { g((b) => { h((c) => c) }) })", 1), "AP-025": ("javascript", "useEffect(() => { f{k}() }, [])", 1), "AP-023": ("javascript", "class V{k} extends React.Component {}", 1),
}


def _filled(text: str):
    """A column with the template's places filled."""
    return F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{z}"), F.col("p_size").cast("string"))


def _sql(text: str) -> str:
    return "replace(replace('" + text.replace("'", "''") + "', '{k}', cast(p_partkey as varchar)), '{z}', cast(p_size as varchar))"


def _chosen(values: list, of):
    """The value of the part's shape: parts take turns."""
    turn = F.col("p_partkey") % len(values)
    out = F.when(turn == 0, of(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(turn == i, of(v))
    return out


def scripts(spark, sf_dir):
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return part.select(F.col("p_partkey").alias("file"), _chosen(SHAPES, lambda s: F.lit(s[0])).alias("language"), _chosen(SHAPES, lambda s: _filled("\n".join(s[1]))).alias("content"))


def _expected(what: str) -> str:
    """The rows of an extractor as SQL over part."""
    value = lambda x: str(x).lower() if isinstance(x, (bool, int)) else "cast(null as varchar)" if x is None else _sql(x)
    parts = [
        f"select p_partkey as file, {', '.join(f'{value(x)} as {c}' for c, x in zip(_COLUMNS[what], row, strict=True))} from part where p_partkey % {len(SHAPES)} = {i}"
        for i, shape in enumerate(SHAPES) for row in shape[2].get(what, [])
    ]
    return " union all ".join(parts)


def _of(what: str, df):
    return df.select("file", *_COLUMNS[what])


@query(_expected("symbols"))
def symbol_shapes(spark, sf_dir):
    return _of("symbols", X.extract_symbols(scripts(spark, sf_dir)))


@query(_expected("exports"))
def export_shapes(spark, sf_dir):
    return _of("exports", X.extract_exports(scripts(spark, sf_dir)))


@query(_expected("fields"))
def field_shapes(spark, sf_dir):
    return _of("fields", X.extract_fields(scripts(spark, sf_dir).where("language = 'python' or content like 'export type%'")))


@query(_expected("types"))
def type_shapes(spark, sf_dir):
    found = _of("types", X.extract_type_refs(scripts(spark, sf_dir)))
    return found.where("context in ('extends', 'generic') and name <> 'Item'")


@query(_expected("imports"))
def import_shapes(spark, sf_dir):
    return _of("imports", X.extract_imports(scripts(spark, sf_dir)))


@query(_expected("services") + f" union all select p_partkey, 4, 'requests', 'POST', {_sql('/q/{z}')} from part where p_partkey % {len(SHAPES)} = {len(SHAPES) - 1}")
def service_shapes(spark, sf_dir):
    return _of("services", X.extract_services(scripts(spark, sf_dir)))


@query(_expected("routes"))
def route_shapes(spark, sf_dir):
    return _of("routes", X.extract_routes(scripts(spark, sf_dir)))


_USED = [i for i, s in enumerate(SHAPES) if "usages" in s[2]]


@query(_expected("usages"))
def usage_shapes(spark, sf_dir):
    """All three kinds of usages, of the scripts that are about them."""
    return _of("usages", X.extract_usages(scripts(spark, sf_dir).where(F.col("file") % len(SHAPES) == _USED[0])))


_RULE_IDS = sorted(RULE_TEXTS)


@query(" union all ".join(f"select p_partkey as file, '{r}' as rule, '{next(x[1] for x in RULES if x[0] == r)}' as severity, {RULE_TEXTS[r][2]} as line from part where p_partkey % {len(_RULE_IDS)} = {i}" for i, r in enumerate(_RULE_IDS)))
def rule_shapes(spark, sf_dir):
    """A text of each rule in turn; the matches of the rule that a text is of."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    texts = part.select(F.col("p_partkey").alias("file"), _chosen(_RULE_IDS, lambda r: F.lit(r)).alias("meant"), _chosen(_RULE_IDS, lambda r: F.lit(RULE_TEXTS[r][0])).alias("language"), _chosen(_RULE_IDS, lambda r: _filled(RULE_TEXTS[r][1])).alias("content"))
    return X.rule_matches(texts, keys=("meant",)).where("rule = meant").drop("meant")
