"""Queries that hold references against definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import resolve as R
from loomspan.operators import usage as U
from loomspan.plans.registry import query
from loomspan.plans.views import table


@query("select file, line, symbol_id, count(*) as n from v_usages where usage_type in ('call', 'reference') and symbol_id not in (select symbol_id from v_catalog) and (file, symbol_id) not in (select (file, symbol_id) from v_imports) and symbol_id % 50 <> 0 group by all")
def unresolved_references(spark, sf_dir):
    imports = table(spark, sf_dir, "v_imports")
    usages = table(spark, sf_dir, "v_usages").join(imports, ["file", "symbol_id"], "left_anti")
    builtins = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("symbol_id"))
    return R.unresolved_references(usages, table(spark, sf_dir, "v_catalog"), builtins=builtins).groupBy("file", "line", "symbol_id").agg(F.count("*").alias("n"))


@query(
    "select u.file, u.symbol_id, bool_or(c.symbol_id is not null) as exists_in_project, count(*) as n from v_usages u left join v_catalog c on u.symbol_id = c.symbol_id where usage_type in ('call', 'reference') "
    "and not exists (select 1 from v_imports i where i.file = u.file and i.symbol_id = u.symbol_id) group by 1, 2"
)
def unresolved_references_strict(spark, sf_dir):
    catalog = table(spark, sf_dir, "v_catalog").withColumn("file", F.lit(-1).cast("long"))
    out = R.unresolved_references(table(spark, sf_dir, "v_usages"), catalog, table(spark, sf_dir, "v_imports"), strict=True)
    return out.groupBy("file", "symbol_id").agg(F.bool_or("exists_in_project").alias("exists_in_project"), F.count("*").alias("n"))


_METHODS = "select l_orderkey as file, 's' || l_suppkey % 12 as object, l_partkey as member from lineitem where l_returnflag = 'R'"


@query(
    "select file, object, member, finding, severity, count(*) as n from (select *, case when object not in (select 's' || s_suppkey from supplier where s_suppkey < 10) then 'undefinedVariable' else 'nonExistentMethod' end as finding, "
    "case when object not in (select 's' || s_suppkey from supplier where s_suppkey < 10) then 'critical' else 'medium' end as severity from u where object <> 's3' and (object not in (select 's' || s_suppkey from supplier where s_suppkey < 10) "
    "or (member not in (select p_partkey from part where p_size % 2 = 0) and not exists (select 1 from part where p_partkey = member and p_size % 2 = 1 and 's' || p_size % 12 = object)))) group by all",
    ("u", _METHODS),
)
def unresolved_methods(spark, sf_dir):
    usages = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.expr("concat('s', l_suppkey % 12)").alias("object"), F.col("l_partkey").alias("member"))
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.expr("case when p_size % 2 = 1 then concat('s', p_size % 12) end").alias("scope"))
    roots = table(spark, sf_dir, "supplier").where("s_suppkey < 10").select(F.expr("concat('s', s_suppkey)").alias("root"))
    return R.unresolved_methods(usages, catalog, ["s3"], roots).groupBy("file", "object", "member", "finding", "severity").agg(F.count("*").alias("n"))


@query(
    "select file, symbol_id, case when r then 'missingDependency' else 'dependencyHallucination' end as finding, case when r then 'low' else 'critical' end as severity, cast(case when r then 100 else 99 end as int) as confidence "
    "from (select i.file, i.symbol_id, p.p_brand in (select p_brand from part where p_partkey % 10 in (3, 4) and p_size > 25) as r from v_imports i join part p on p.p_partkey = i.symbol_id where p.p_brand not in (select p_brand from part where p_partkey < 12))"
)
def validate_dependencies(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    imports = table(spark, sf_dir, "v_imports").join(part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("package")), "symbol_id")
    brands = lambda where: part.where(where).select(F.col("p_brand").alias("package"))
    return R.validate_dependencies(imports, brands("p_partkey < 12"), brands("p_partkey % 10 in (3, 4) and p_size > 25")).select("file", "symbol_id", "finding", "severity", "confidence")


@query(
    "select page_id, case when target is null then 'missingModule' else 'missingExport' end as finding, cast(case when target is null then 99 else 93 end as int) as confidence from (select s.page_id, s.method as name, r.path as target, s.page_id % 10 as star from v_services s left join (select distinct path from v_routes) r "
    "on regexp_replace(s.path, '[0-9]+', '{id}') = r.path) x where target is null or (star <> 0 and not exists (select 1 from v_routes e where e.path = x.target and e.method = x.name))"
)
def unresolved_imports(spark, sf_dir):
    routes = table(spark, sf_dir, "v_routes").select(F.col("path").alias("file"), F.col("method").alias("name"))
    imports = table(spark, sf_dir, "v_services").select("page_id", F.expr("regexp_replace(path, '^([^0-9]*)[0-9]+', '$1{id}')").alias("module"), F.expr("case when page_id % 10 = 0 then '*' else method end").alias("name"))
    resolved = imports.join(routes.select(F.col("file").alias("module"), F.col("file").alias("target")).distinct(), "module", "left")
    return R.unresolved_imports(resolved, routes).select("page_id", "finding", "confidence")


@query(
    "select page_id, case when base || '.ts' in (select f from fs) then base || '.ts' when base || '.tsx' in (select f from fs) then base || '.tsx' when base || '.py' in (select f from fs) then base || '.py' when base || '/index.js' in (select f from fs) then base || '/index.js' end as target "
    "from (select page_id, regexp_replace(path, '/$', '') as base from v_paths)",
    ("fs", "select distinct regexp_replace(path, '/$', '') || case page_id % 4 when 0 then '.ts' when 1 then '.tsx' when 2 then '.py' else '/index.js' end as f from v_paths where page_id % 3 <> 1"),
)
def resolve_imports(spark, sf_dir):
    paths = table(spark, sf_dir, "v_paths").withColumn("module", F.regexp_replace("path", "/$", ""))
    files = paths.where("page_id % 3 <> 1").select(F.concat("module", F.expr("case page_id % 4 when 0 then '.ts' when 1 then '.tsx' when 2 then '.py' else '/index.js' end")).alias("file"))
    return R.resolve_imports(paths.select("page_id", "module"), files).select("page_id", "target")


@query("select u.file, u.line, u.symbol_id, count(*) as n from v_usages u join v_catalog c on c.symbol_id = u.symbol_id where arg_count < param_min or arg_count > param_max group by 1, 2, 3")
def arity_check(spark, sf_dir):
    usages = table(spark, sf_dir, "v_usages")
    found = R.arity_check(usages, table(spark, sf_dir, "v_catalog").drop("file"))
    return found.groupBy("file", "line", "symbol_id").agg(F.count("*").alias("n"))


@query("select file, symbol_id from v_imports where symbol_id % 7 <> 0 and (file, symbol_id) not in (select (file, symbol_id) from v_usages where usage_type = 'call') and (file, symbol_id) not in (select (file, caller) from v_usages where usage_type = 'methodCall')")
def unused_imports(spark, sf_dir):
    usages = table(spark, sf_dir, "v_usages")
    imports = table(spark, sf_dir, "v_imports").withColumnRenamed("symbol_id", "name")
    used = [usages.where("usage_type = 'call'").select("file", F.col("symbol_id").alias("name")), usages.where("usage_type = 'methodCall'").select("file", F.col("caller").alias("name"))]
    return R.unused_imports(imports, used, F.col("name") % 7 == 0).withColumnRenamed("name", "symbol_id")


@query("select u.file, u.symbol_id, min(u.line) as line from v_usages u join v_imports i on i.file = u.file and i.symbol_id = u.symbol_id where i.symbol_id % 2 = 0 and usage_type in ('call', 'methodCall', 'reference') group by 1, 2")
def type_only_misuse(spark, sf_dir):
    imports = table(spark, sf_dir, "v_imports").select("file", F.col("symbol_id").alias("name"), (F.col("symbol_id") % 2 == 0).alias("is_type_only"))
    return R.type_only_misuse(imports, table(spark, sf_dir, "v_usages").withColumnRenamed("symbol_id", "name"), ("call", "methodCall", "reference")).withColumnRenamed("name", "symbol_id")


@query("select c_custkey as symbol_id, c_nationkey as file from customer where c_acctbal > 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') and c_custkey not in (select o_custkey from orders where o_orderpriority like '1%')")
def unused_exports(spark, sf_dir):
    """Customers as exported symbols: orders in process import them, urgent ones call them."""
    exports = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_nationkey").alias("file"), (F.col("c_acctbal") > 0).alias("exported"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "symbol_id")
    return R.unused_exports(exports, orders.where("o_orderstatus = 'P'"), [orders.where("o_orderpriority like '1%'")]).select("symbol_id", "file")


@query(
    "select file from (select distinct c_custkey as file from customer where c_custkey % 11 <> 0) f where file in (select src from v_edges) and file not in (select dst from v_edges) and not exists (select 1 from v_edges e where e.src = f.file and e.dst % 97 = 0)"
)
def orphan_files(spark, sf_dir):
    edges = table(spark, sf_dir, "v_edges")
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file")).distinct()
    exports = edges.select(F.col("src").alias("file"), F.col("dst").alias("name"))
    return R.orphan_files(files, edges, exports, exports.where("name % 97 = 0"), F.col("file") % 11 == 0)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = f"select doc_id as file, unnest(string_split_regex({_LOWER}, '[^a-z]+')) as name from documents"


@query("select file, name from (select distinct file, name from t where length(name) > 2) s where name not like 'use%' and (file, name) not in (select (file, name) from t group by file, name having count(*) > 1)", ("t", _TOKENS))
def unused_definitions(spark, sf_dir):
    # Texts are dealt by file, so that names are counted before they are shuffled.
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text").repartition("file")
    tokens = texts.select("file", F.explode(F.split(F.expr(_LOWER), "[^a-z]+")).alias("name"))
    symbols = tokens.where("length(name) > 2 and name not like 'use%'").distinct().withColumn("exported", F.lit(False))
    return R.unused_definitions(symbols, tokens).select("file", "name")


@query(
    "select distinct p_brand as class, p_name as member from part where p_brand in (select p_brand from part where p_partkey % 5 = 0) and not exists (select 1 from lineitem l join part q on l.l_partkey = q.p_partkey where q.p_partkey % 5 = 0 and l.l_quantity < 3 and q.p_brand = part.p_brand and q.p_name = part.p_name)"
)
def unused_members(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    members = part.select(F.col("p_brand").alias("class"), F.col("p_name").alias("member")).distinct()
    instances = part.where("p_partkey % 5 = 0").select(F.col("p_brand").alias("class"), F.col("p_partkey").alias("instance"))
    accesses = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("instance")).join(part.select(F.col("p_partkey").alias("instance"), F.col("p_name").alias("member")), "instance")
    return R.unused_members(members, instances, accesses)


_TREE = "select 'c' || c_custkey as node, 'n' || c_nationkey as parent from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, null from region"
_CLOSURE = "select node, node as ancestor, 0 as distance from tree union all select c.node, t.parent, c.distance + 1 from closure c join tree t on t.node = c.ancestor where t.parent is not null"
_SYMBOLS = "select 'c' || o_custkey as scope, o_orderpriority as name from orders where o_orderkey % 5 = 0 union select 'n' || s_nationkey, case s_suppkey % 3 when 0 then '1-URGENT' when 1 then '3-MEDIUM' else '5-LOW' end from supplier union select 'r' || r_regionkey, '2-HIGH' from region where r_regionkey < 3"


def tree(spark, sf_dir):
    part = lambda t, a, b: table(spark, sf_dir, t).select(a, b)
    out = part("customer", F.expr("concat('c', c_custkey) as node"), F.expr("concat('n', c_nationkey) as parent"))
    out = out.unionByName(part("nation", F.expr("concat('n', n_nationkey) as node"), F.expr("concat('r', n_regionkey) as parent")))
    return out.unionByName(part("region", F.expr("concat('r', r_regionkey) as node"), F.expr("cast(null as string) as parent")))


def scope_symbols(spark, sf_dir):
    orders, suppliers, regions = (table(spark, sf_dir, t) for t in ("orders", "supplier", "region"))
    own = orders.where("o_orderkey % 5 = 0").select(F.expr("concat('c', o_custkey) as scope"), F.col("o_orderpriority").alias("name"))
    nation = suppliers.select(F.expr("concat('n', s_nationkey) as scope"), F.expr("case s_suppkey % 3 when 0 then '1-URGENT' when 1 then '3-MEDIUM' else '5-LOW' end as name"))
    return own.union(nation).union(regions.where("r_regionkey < 3").select(F.expr("concat('r', r_regionkey) as scope"), F.lit("2-HIGH").alias("name"))).distinct()


def closure(spark, sf_dir):
    from loomspan.operators.graph import ancestors

    return ancestors(tree(spark, sf_dir))


@query(
    "select scope, name, defined_in, case when defined_in is not null then 'scope' when name in ('4-NOT SPECIFIED', '4-NOT') then 'import' else 'global' end as how from (select r.scope, r.name, arg_min(c.ancestor, c.distance) filter (where s.scope is not null) as defined_in "
    "from (select distinct 'c' || o_custkey as scope, o_orderpriority as name from orders where o_orderkey % 7 = 0) r join closure c on c.node = r.scope left join symbols s on s.scope = c.ancestor and s.name = r.name group by 1, 2)",
    ("tree", _TREE), ("closure", _CLOSURE), ("symbols", _SYMBOLS), recursive=True,
)
def scope_resolve(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.expr("concat('c', o_custkey) as scope"), F.col("o_orderpriority").alias("name")).distinct()
    imports = table(spark, sf_dir, "orders").where("o_orderpriority like '4-NOT%'").select(F.col("o_orderpriority").alias("name"))
    return R.scope_resolve(refs, closure(spark, sf_dir), scope_symbols(spark, sf_dir), imports)


@query(
    "select s.scope, s.name, arg_min(c.ancestor, c.distance) as shadows from symbols s join closure c on c.node = s.scope and c.distance > 0 join symbols o on o.scope = c.ancestor and o.name = s.name group by 1, 2",
    ("tree", _TREE), ("closure", _CLOSURE), ("symbols", _SYMBOLS), recursive=True,
)
def shadowed_symbols(spark, sf_dir):
    return R.shadowed_symbols(closure(spark, sf_dir), scope_symbols(spark, sf_dir))


@query("select node, ancestor, cast(distance as int) as distance from closure", ("tree", _TREE), ("closure", _CLOSURE), recursive=True)
def ancestors(spark, sf_dir):
    return closure(spark, sf_dir)


@query(
    "select d.node as scope, d.depth, coalesce(s.n, 0) as symbols, coalesce(k.n, 0) as children, coalesce(x.n, 0) as descendants from (select node, cast(max(distance) as int) as depth from closure group by 1) d left join (select scope as node, count(*) as n from symbols group by 1) s using (node) "
    "left join (select ancestor as node, count(*) as n from closure where distance = 1 group by 1) k using (node) left join (select ancestor as node, count(*) as n from closure where distance > 0 group by 1) x using (node)",
    ("tree", _TREE), ("closure", _CLOSURE), ("symbols", _SYMBOLS), recursive=True,
)
def scope_metrics(spark, sf_dir):
    from loomspan.operators.graph import scope_metrics as metrics

    return metrics(closure(spark, sf_dir), scope_symbols(spark, sf_dir))


@query("select distinct a.page_id as src, b.page_id as dst, a.path as name, cast(0.9 as double) as confidence from v_paths a join v_paths b on a.path = b.path and a.page_id <> b.page_id where b.path like '/%'", doubles=("confidence",))
def bridge_edges(spark, sf_dir):
    paths = table(spark, sf_dir, "v_paths").select(F.col("path").alias("name"), F.col("page_id").alias("file"))
    return R.bridge_edges(paths, paths)


@query("select c_custkey as symbol, coalesce((select list(distinct src order by src) from v_edges where dst = c_custkey), []) as callers, coalesce((select list(distinct dst order by dst) from v_edges where src = c_custkey), []) as callees from customer")
def relations_of(spark, sf_dir):
    return R.relations_of(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol")), table(spark, sf_dir, "v_edges"))


@query("select p_partkey as id, p_brand as name from part where p_brand not in ('Brand#11', 'Brand#22') and p_brand not in (select p_brand from part where p_size = 1 and p_partkey % 3 = 0)")
def unknown_types(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), "p_size")
    return R.unknown_types(part.drop("p_size"), part.where("p_size = 1 and id % 3 = 0"), ["Brand#11", "Brand#22"])


@query(
    "select r.o_orderkey as id, arg_min(s.p_partkey, (case when s.p_brand = r.file and s.p_type = r.scope then 0 when s.p_brand = r.file then 1 when s.p_type = r.scope then 2 else 3 end, s.p_brand, s.p_partkey)) as symbol "
    "from (select o.o_orderkey, p.p_name as name, q.p_brand as file, q.p_type as scope from orders o join part p on p.p_partkey = o.o_orderkey % 1000 join part q on q.p_partkey = o.o_custkey % 1000) r join part s on s.p_name = r.name group by 1"
)
def find_symbol(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey % 1000 as a"), F.expr("o_custkey % 1000 as b"))
    requests = orders.join(part.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("name")), "a").join(part.select(F.col("p_partkey").alias("b"), F.col("p_brand").alias("file"), F.col("p_type").alias("scope")), "b").drop("a", "b")
    return R.find_symbol(requests, part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("scope"), F.col("p_partkey").alias("symbol")))


@query("select event_id, event_type as member from events where user_id % 10 in (1, 2) and not ((user_id % 10 = 1 and event_type in ('click', 'view')) or (user_id % 10 = 2 and event_type = 'purchase'))")
def closed_namespaces(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr("user_id % 10 as root"), F.col("event_type").alias("member"))
    members = events.where("(root = 1 and member in ('click', 'view')) or (root = 2 and member = 'purchase')").select("root", "member").distinct()
    return R.closed_namespaces(events, members).select("event_id", "member")


@query(
    "select handler, finding, name from (select distinct user_id as handler, 'noResponse' as finding, cast(null as varchar) as name from events where user_id not in (select user_id from events where event_type = 'view' and value > 90) "
    "union all select distinct user_id, 'unknownModel', props from events where event_type = 'error' and regexp_extract(props, '([0-9]+)', 1) not in (select cast(n_nationkey as varchar) from nation) "
    "union all select distinct user_id, 'unusedLocal', props from events e where event_type = 'click' and not exists (select 1 from events r where r.user_id = e.user_id and r.event_type = 'signup' and r.props = e.props))"
)
def broken_handlers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    fact = F.expr("case when event_type = 'view' and value > 90 then 'respond' when event_type = 'error' then 'query' when event_type = 'click' then 'assign' when event_type = 'signup' then 'read' end")
    facts = events.select(F.col("user_id").alias("handler"), fact.alias("fact"), F.col("props").alias("name"))
    known = events.select("props").distinct().join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k")), F.regexp_extract("props", "([0-9]+)", 1) == F.col("k"), "left_semi").select(F.col("props").alias("name"))
    return R.broken_handlers(facts, facts, known)


# Usage, history, texts.


@query("select coalesce(u.symbol_id, i.symbol_id) as symbol_id, coalesce(callers, 0) as callers, coalesce(files, 0) as files, coalesce(imports, 0) as imports, coalesce(callers, 0) + coalesce(imports, 0) as usage from (select symbol_id, count(distinct caller) as callers, count(distinct file) as files from v_usages group by 1) u full join (select symbol_id, count(*) as imports from v_imports group by 1) i on u.symbol_id = i.symbol_id")
def symbol_usage(spark, sf_dir):
    return U.symbol_usage(table(spark, sf_dir, "v_usages"), table(spark, sf_dir, "v_imports"))


@query("select name, list(distinct symbol_id order by symbol_id) as values, count(distinct symbol_id) as n from v_catalog group by 1")
def name_index(spark, sf_dir):
    return U.index_by(table(spark, sf_dir, "v_catalog"), "name", "symbol_id")


@query("select kind, list(distinct name order by name) as values, count(distinct name) as n from v_catalog group by 1")
def kind_index(spark, sf_dir):
    return U.index_by(table(spark, sf_dir, "v_catalog"), "kind", "name")


@query("select file, list(distinct symbol_id order by symbol_id) as values, count(distinct symbol_id) as n from v_usages group by 1")
def file_index(spark, sf_dir):
    return U.index_by(table(spark, sf_dir, "v_usages"), "file", "symbol_id")


@query("select kind, count(*) as total, count(*) filter (where exported) as exported, count(*) filter (where symbol_id not in (select symbol_id from v_imports)) as unused from v_catalog group by grouping sets ((kind), ())")
def index_statistics(spark, sf_dir):
    return U.index_statistics(table(spark, sf_dir, "v_catalog"), table(spark, sf_dir, "v_imports"))


@query("select 'language' as section, lang as value, count(*) as n from documents group by lang union all select 'kind', kind, count(*) from v_catalog group by kind union all (select 'name', name, count(*) as n from v_catalog group by name order by n desc, name limit 20)")
def project_summary(spark, sf_dir):
    return U.project_summary(table(spark, sf_dir, "documents").withColumnRenamed("lang", "language"), table(spark, sf_dir, "v_catalog"))


@query(
    "select file, count(distinct commit_id) as commits, count(distinct author) as authors, max(ts) as last_modified, (list(commit_id order by ts desc, commit_id desc))[1:5] as newest, case when max(ts) < timestamp '2024-02-01' then count(distinct commit_id) / ((epoch_us(timestamp '2024-02-01') - epoch_us(max(ts))) / 86400000000) else 0.0 end as frequency from v_commit_files group by 1",
    doubles=("frequency",),
)
def file_history(spark, sf_dir):
    return U.file_history(table(spark, sf_dir, "v_commit_files"), F.expr("timestamp'2024-02-01'"))


@query("select a.file, b.file as partner, count(*) as n from v_commit_files a join v_commit_files b on a.commit_id = b.commit_id and a.file <> b.file group by 1, 2")
def co_change(spark, sf_dir):
    return U.co_change(table(spark, sf_dir, "v_commit_files"))


_FILE_SYMBOLS = "select distinct file, symbol_id from v_usages"
_CO = "select x.symbol_id as a, y.symbol_id as b, count(*) as n from fsym x join fsym y on x.file = y.file and x.symbol_id <> y.symbol_id group by 1, 2 having count(*) >= 2"


@query("select a, b, n from co", ("fsym", _FILE_SYMBOLS), ("co", _CO))
def co_occurrence(spark, sf_dir):
    return U.co_occurrence(table(spark, sf_dir, "v_usages").select("file", "symbol_id"))


# Rituals: what each user does in a week of events; a "file" is a user's week.
_WEEKS = "select distinct user_id * 100 + extract(week from ts) as file, event_type as symbol_id from events"
_USE = "select symbol_id, count(*) as usage from fsym group by 1"
_RITUALS = "select a as symbol, b as expected, n / usage as frequency, case when usage > 10 then 0.9 else 0.7 end as confidence from co join uses on symbol_id = a where usage >= 3 and n / usage > 0.5"


def _weeks(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.expr("user_id * 100 + extract(week from ts)").alias("file"), F.col("event_type").alias("symbol_id")).distinct()


def _rituals(weeks):
    use = weeks.groupBy("symbol_id").agg(F.count("*").alias("usage"))
    return U.usage_rituals(U.co_occurrence(weeks), use)


@query("select symbol, expected, frequency, cast(confidence as double) as confidence from rituals", ("fsym", _WEEKS), ("co", _CO), ("uses", _USE), ("rituals", _RITUALS), doubles=("frequency", "confidence",))
def usage_rituals(spark, sf_dir):
    return _rituals(_weeks(spark, sf_dir))


@query("select w.file, w.symbol, w.expected from (select f.file, r.symbol, r.expected from fsym f join rituals r on r.symbol = f.symbol_id where r.frequency > 0.8) w left join fsym g on g.file = w.file and g.symbol_id = w.expected where g.file is null", ("fsym", _WEEKS), ("co", _CO), ("uses", _USE), ("rituals", _RITUALS))
def ritual_deviations(spark, sf_dir):
    weeks = _weeks(spark, sf_dir)
    return U.ritual_deviations(weeks, _rituals(weeks))


_KEYWORDS = (
    "select doc_id as file, w as keyword, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, w) as r from (select doc_id, unnest(regexp_extract_all(lower(text), '\\b[a-z][a-z0-9_]{2,}\\b')) as w from documents) "
    "where length(w) > 3 and w not in (" + ", ".join(f"'{w}'" for w in U.STOP_WORDS) + ") group by 1, 2"
)


def _keywords(spark, sf_dir):
    return U.file_keywords(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"), F.concat_ws("/", "source", F.concat(F.coalesce("lang", F.lit("any")), F.lit(".txt"))).alias("path")), path="path")


_PARTS = "select file, keyword, n from words where r <= 15 union all (select file, keyword, 0 from (select doc_id as file, source as keyword from documents where source is not null union select doc_id, coalesce(lang, 'any') from documents) where (file, keyword) not in (select (file, keyword) from words where r <= 15))"


@query("select file, keyword, n from k", ("words", _KEYWORDS), ("k", _PARTS))
def file_keywords(spark, sf_dir):
    return _keywords(spark, sf_dir)


@query("select keyword, count(distinct file) as n, min(file) as first_file from k group by 1", ("words", _KEYWORDS), ("k", _PARTS))
def keyword_index(spark, sf_dir):
    return U.keyword_files(U.keyword_index(_keywords(spark, sf_dir)))


# Frequent words of four languages.
_WORDS = {"de": ["der", "die", "und", "das", "ein"], "en": ["the", "and", "that", "with", "was"], "es": ["el", "los", "que", "del", "una"], "fr": ["le", "les", "des", "dans", "est"]}


@query(
    "select file, case when greatest(de, en, es, fr) = 0 then null when de >= greatest(en, es, fr) then 'de' when en >= greatest(es, fr) then 'en' when es >= fr then 'es' else 'fr' end as language, cast(case when de + en + es + fr > 0 then least(90, round(100 * greatest(de, en, es, fr) / (de + en + es + fr))) end as int) as confidence from (select doc_id as file, "
    + ", ".join(f"len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x in ({', '.join(repr(x) for x in w)}))) as {k}" for k, w in _WORDS.items())
    + " from documents)"
)
def detect_language_by_keywords(spark, sf_dir):
    return U.detect_language(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")), _WORDS)


@query(
    "select *, case when complexity > 20 then 'high' when complexity > 10 or n_lines > 50 or depth > 4 then 'medium' else 'low' end as level from (select doc_id as file, cast(1 + len(regexp_extract_all(text, '\\b(if|elif|else if|for|while|case|catch|except|and|or)\\b|&&|\\|\\||\\?')) as int) as complexity, "
    "cast(len(string_split(text, chr(10))) as int) as n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: cast(floor(length(regexp_extract(x, '^( *)', 1)) / 4) as bigint))) as depth from documents)"
)
def complexity(spark, sf_dir):
    return U.complexity(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))


@query("select name, count(*) as n from v_catalog group by 1 having count(*) > 1")
def duplicate_definitions(spark, sf_dir):
    return U.duplicate_definitions(table(spark, sf_dir, "v_catalog"))


@query("select (select count(*) from v_catalog) as total, (select count(*) from v_catalog where param_max > 4) as kept, case when 1 - (select count(*) from v_catalog where param_max > 4) / (select count(*) from v_catalog) > 0.7 then 'excellent' when 1 - (select count(*) from v_catalog where param_max > 4) / (select count(*) from v_catalog) > 0.5 then 'good' else 'fair' end as quality")
def context_quality(spark, sf_dir):
    catalog = table(spark, sf_dir, "v_catalog")
    return U.context_quality(catalog, catalog.where("param_max > 4"))
