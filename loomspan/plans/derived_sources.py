"""Queries of the extractors and readers over source texts that Spark derives from the tables: each row of part is a script, each supplier a Python file."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import contracts as C
from loomspan.operators import extract as X
from loomspan.plans.registry import query
from loomspan.plans.views import table
from loomspan.sources import files as R

#: Lines of a part's script, as templates over its columns; {brand} is the brand without its sign.
_SCRIPT = [
    "import {{ fnA as fnB, {brand} }} from './m{key}'",
    "export function f{key}(a{size}: {brand}, b) {{",
    "  const r{size} = axios.get('/brand/{key}')",
    "  // @ts-ignore",
    "  w = box{size}.m{key}{cast}",
    "  {body}",
    "}}",
    "export interface I{key} {{",
    "  f{size}{maybe}: string",
    "}}",
    "export {{ f{key} as g{key}, h{size} }}",
    "router.post('/items/{key}', h{key})",
    "class C{key} extends {brand} implements I{key} {{}}",
]
_PYTHON = ["from .brand import S{key}", '@router.put("/s/{key}")', "def s{key}(x{nation}: int = 1):", "    pass"]


def _filled(template: str, **columns):
    """A column with the template's places filled."""
    parts, rest = [], template.replace("{{", "\x01").replace("}}", "\x02")
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), columns[name].cast("string")]
    return F.translate(F.concat(*parts, F.lit(rest)), "\x01\x02", "{}")


def code(spark, sf_dir):
    """``(file, language, content)`` of all scripts and Python files."""
    large = F.col("p_size") > 25
    part = {
        "key": F.col("p_partkey"), "size": F.col("p_size"), "brand": F.replace("p_brand", F.lit("#"), F.lit("")), "maybe": F.when(large, "?").otherwise(""), "cast": F.when(large, "").otherwise(F.concat(F.lit(" as I"), F.col("p_partkey"))),
        "body": F.when(large, "try { go() } catch (e) { console.log(e) }").otherwise("let q = 1"),
    }
    scripts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("file"), F.lit("js").alias("language"), F.concat_ws("\n", *(_filled(t, **part) for t in _SCRIPT)).alias("content"))
    supplier = {"key": F.col("s_suppkey"), "nation": F.col("s_nationkey")}
    return scripts.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("file"), F.lit("python").alias("language"), F.concat_ws("\n", *(_filled(t, **supplier) for t in _PYTHON)).alias("content")))


_P = ("p", "select 'p' || p_partkey as file, p_partkey as k, p_size as z, replace(p_brand, '#', '') as b from part")
_S = ("s", "select 's' || s_suppkey as file, s_suppkey as k, s_nationkey as n from supplier")


@query("select file, 2 as line, 'f' || k as name, 'function' as kind, true as exported from p union all select file, 8, 'I' || k, 'interface', true from p union all select file, 13, 'C' || k, 'class', false from p union all select file, 3, 's' || k, 'function', true from s", _P, _S)
def extract_symbols(spark, sf_dir):
    return X.extract_symbols(code(spark, sf_dir))


@query("select file, 1 as line, './m' || k as module, 'fnA' as imported, 'fnB' as local, true as is_relative from p union all select file, 1, './m' || k, b, b, true from p union all select file, 1, '.brand', 'S' || k, 'S' || k, true from s", _P, _S)
def extract_imports(spark, sf_dir):
    return X.extract_imports(code(spark, sf_dir))


@query("select file, x.a as line, x.n as name, false as is_default from (select file, unnest([{'a': 2, 'n': 'f' || k}, {'a': 8, 'n': 'I' || k}, {'a': 11, 'n': 'g' || k}, {'a': 11, 'n': 'h' || z}]) as x from p)", _P)
def extract_exports(spark, sf_dir):
    return X.extract_exports(code(spark, sf_dir))


@query("select file, 12 as line, 'POST' as method, '/items/' || k as path, 'router' as router, 'h' || k as handler from p union all select file, 2, 'PUT', '/s/' || k, 'router', 's' || k from s", _P, _S)
def extract_routes(spark, sf_dir):
    return X.extract_routes(code(spark, sf_dir))


@query("select file, 3 as line, 'axios' as client, 'GET' as method, '/brand/' || k as path from p", _P)
def extract_services(spark, sf_dir):
    return X.extract_services(code(spark, sf_dir))


@query("select file, 'I' || k as owner, 'f' || z as field, 'string' as ftype, z <= 25 as required from p", _P)
def extract_fields(spark, sf_dir):
    return X.extract_fields(code(spark, sf_dir))


@query("select file, 1 as n from p where z > 25", _P)
def log_only_catch(spark, sf_dir):
    return X.log_only_catch(code(spark, sf_dir))


@query("select file, 'I' || k as name from p where z > 25", _P)
def single_use_interface(spark, sf_dir):
    return X.single_use_interface(code(spark, sf_dir))


@query("select file, 5 as line, 'box' || z as object, 'm' || k as member from p", _P)
def suppressed_access(spark, sf_dir):
    return X.suppressed_access(code(spark, sf_dir))


@query("select file, 2 as line, b as name, 'annotation' as context from p union all select file, 13, b, 'extends' from p union all select file, 13, 'I' || k, 'implements' from p", _P)
def extract_type_refs(spark, sf_dir):
    return X.extract_type_refs(code(spark, sf_dir))


@query("select file, 2 as line, 'a' || z as name from p union all select file, 2, 'b' from p union all select file, 3, 'r' || z from p union all select file, 5, 'w' from p union all select file, 6, 'q' from p where z <= 25 union all select file, 3, 'x' || n from s", _P, _S)
def extract_local_definitions(spark, sf_dir):
    return X.extract_local_definitions(code(spark, sf_dir))


@query("select file, 'AP-005' as rule, 'low' as severity, 3 as line from p union all select file, 'AP-005', 'low', 6 from p where z <= 25", _P)
def rule_matches(spark, sf_dir):
    """One rule of the table on the scripts: names that nothing on their line repeats."""
    from loomspan.functions.rules import RULES

    return X.rule_matches(code(spark, sf_dir).withColumn("language", F.when(F.col("language") == "js", "javascript").otherwise(F.col("language"))), [r for r in RULES if r[0] == "AP-005"])


@query("select 'w' || p_partkey || '/package.json' as file, 'dependencies' as section, p_brand as package from part union all select 'w' || p_partkey || '/package.json', 'devDependencies', '@types/t' || p_size from part union all select 'w' || p_partkey || '/package.json', 'devDependencies', 't' || p_size from part union all select 's' || s_suppkey || '/requirements.txt', 'dependencies', 'lib_' || s_nationkey from supplier")
def read_manifests(spark, sf_dir):
    js = F.to_json(F.struct(F.create_map("p_brand", F.lit("1")).alias("dependencies"), F.create_map(F.concat(F.lit("@types/t"), F.col("p_size")), F.lit("2")).alias("devDependencies")))
    manifests = table(spark, sf_dir, "part").select(F.concat(F.lit("w"), F.col("p_partkey"), F.lit("/package.json")).alias("file"), js.alias("content"))
    python = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit("/requirements.txt")).alias("file"), F.concat(F.lit("# all\nLib-"), F.col("s_nationkey"), F.lit(">=1\n")).alias("content"))
    return R.read_manifests(manifests.unionByName(python))


@query("select 'm' || s_suppkey || '/__init__.py' as file, case when s_acctbal > 0 then 'S' || s_suppkey else '*' end as name from supplier union all select 'm' || s_suppkey || '/__init__.py', 'n' || s_nationkey from supplier where s_acctbal > 0")
def read_module_exports(spark, sf_dir):
    listed = F.concat(F.lit('__all__ = ["S'), F.col("s_suppkey"), F.lit("\", 'n"), F.col("s_nationkey"), F.lit("']\n"))
    return R.read_module_exports(table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey"), F.lit("/__init__.py")).alias("file"), F.when(F.col("s_acctbal") > 0, listed).otherwise("x = 1").alias("content")))


@query("select page_id, file, path from (select page_id, 'f' || page_id % 30 as file, case when page_id % 2 = 0 then '/api' || path else path end as path from v_paths) where regexp_matches(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^/|/$', '', 'g'), '^api(/|$)') and file in (select 'f' || n_nationkey from nation where n_nationkey < 12)")
def double_prefix(spark, sf_dir):
    """Base URLs end in the prefix in the files of half of the nations."""
    services = table(spark, sf_dir, "v_paths").select("page_id", F.expr("concat('f', page_id % 30)").alias("file"), F.expr("case when page_id % 2 = 0 then concat('/api', path) else path end").alias("path"))
    ending = F.when(F.col("n_nationkey") < 12, "const baseURL = 'http://x.org/api/'").otherwise("const baseURL = 'http://x.org'")
    return C.double_prefix(services, table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey")).alias("file"), ending.alias("content")))


_GRAPHQL = [
    ("op", "select o_orderkey as operation from orders"), ("known", "select o_orderkey as operation from orders where o_orderstatus <> 'P'"), ("sel", "select l_orderkey as operation, l_returnflag as parent, l_partkey as field from lineitem"),
    ("fields", "select distinct l_returnflag as parent, l_partkey as field from lineitem where l_quantity > 20"), ("vars", "select distinct l_orderkey as operation, l_linenumber as name, l_linestatus as vtype, l_quantity > 10 as used from lineitem"),
    ("args", "select distinct o_orderkey as operation, cast(c_nationkey % 8 as int) as name, case when o_orderstatus = 'F' then 'F!' else 'O' end as vtype, o_totalprice > 100000 as required from orders join customer on c_custkey = o_custkey"),
]


@query(
    "select op.operation, cast(case when op.operation in (select operation from known) then greatest(0, 100 - coalesce(p, 0)) else 0 end as bigint) as score, op.operation in (select operation from known) as found from op left join (select operation, sum(p) as p from (select operation, 20 as p from sel where (parent, field) not in (select (parent, field) from fields) "
    "union all select operation, 10 from vars where not used union all select v.operation, 15 from vars v join args a on a.operation = v.operation and a.name = v.name where replace(v.vtype, '!', '') <> replace(a.vtype, '!', '') "
    "union all select operation, 20 from args where required and (operation, name) not in (select (operation, name) from vars)) group by 1) using (operation)",
    *_GRAPHQL,
)
def graphql_contract(spark, sf_dir):
    for name in ("orders", "lineitem", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return C.graphql_contract(*(spark.sql(sql) for _, sql in _GRAPHQL))


@query(
    "select p_partkey as id, len(list_filter(string_split(lower(p_name), ' '), lambda x: len(list_filter(string_split(lower(p_type), ' '), lambda y: contains(x, y) or contains(y, x))) > 0)) > 0 as shared, cast(coalesce(list_position(list_transform(range(1, least(length(p_name), length(p_type)) + 1), lambda i: p_name[i] <> lower(p_type)[i]), true) - 1, least(length(p_name), length(p_type))) as int) as prefix, "
    "len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type || ' ' || p_name), ' '))) / len(list_distinct(string_split(lower(p_type || ' ' || p_name), ' '))) as jaccard from part",
    doubles=("jaccard",),
)
def name_likeness(spark, sf_dir):
    """Shared parts, common prefix and the overlap of two sets of words."""
    name, kind = F.col("p_name"), F.lower("p_type")
    both = F.split(F.concat(kind, F.lit(" "), name), " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.shares_part(name, kind).alias("shared"), S.common_prefix(name, kind).alias("prefix"), S.jaccard(F.split(name, " "), both).alias("jaccard"))
