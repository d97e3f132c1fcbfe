"""Queries by project, and of the wider forms of operators: aliases, evidence, summaries, chunked lists, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import contracts as C
from loomspan.operators import findings as N
from loomspan.operators import graph as G
from loomspan.operators import rank as K
from loomspan.operators import resolve as R
from loomspan.operators import usage as U
from loomspan.plans.registry import query
from loomspan.plans.views import table
from loomspan.streaming import edits as T

PROJECT = ("project_id",)

# Projects: a usage belongs to its order's customer, five projects in all; symbols and imports are each project's own.
_USES = "select o_custkey % 5 as project_id, u.* from v_usages u join (select o_orderkey, min(o_custkey) as o_custkey from orders group by 1) o on o.o_orderkey = u.file"
_DEFS = "select symbol_id % 5 as project_id, * from v_catalog union all select (symbol_id + 1) % 5, * from v_catalog where symbol_id % 3 = 0"
_LINKS = "select src % 3 as project_id, src, dst from v_edges"


def _uses(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("file")).agg(F.min("o_custkey").alias("c"))
    return table(spark, sf_dir, "v_usages").join(orders, "file").withColumn("project_id", F.col("c") % 5).drop("c")


def _defs(spark, sf_dir):
    catalog = table(spark, sf_dir, "v_catalog")
    return catalog.withColumn("project_id", F.col("symbol_id") % 5).unionByName(catalog.where("symbol_id % 3 = 0").withColumn("project_id", (F.col("symbol_id") + 1) % 5))


def _links(spark, sf_dir):
    return table(spark, sf_dir, "v_edges").withColumn("project_id", F.col("src") % 3)


@query("select u.project_id, u.file, u.symbol_id, count(*) as n from u where usage_type in ('call', 'reference') and not exists (select 1 from d where d.project_id = u.project_id and d.symbol_id = u.symbol_id) group by 1, 2, 3", ("u", _USES), ("d", _DEFS))
def project_unresolved_references(spark, sf_dir):
    found = R.unresolved_references(_uses(spark, sf_dir), _defs(spark, sf_dir), keys=PROJECT)
    return found.groupBy("project_id", "file", "symbol_id").agg(F.count("*").alias("n"))


@query("select project_id, symbol_id, name from d where exported and not exists (select 1 from u where u.project_id = d.project_id and u.symbol_id = d.symbol_id and u.usage_type = 'reference') and not exists (select 1 from u where u.project_id = d.project_id and u.symbol_id = d.symbol_id and u.usage_type = 'call')", ("u", _USES), ("d", _DEFS))
def project_unused_exports(spark, sf_dir):
    uses = _uses(spark, sf_dir)
    return R.unused_exports(_defs(spark, sf_dir), uses.where("usage_type = 'reference'"), [uses.where("usage_type = 'call'")], keys=PROJECT).select("project_id", "symbol_id", "name")


@query("select project_id, symbol_id, count(*) as n, cast(row_number() over (partition by project_id order by count(*) desc, symbol_id) as int) as rank from u group by 1, 2 qualify rank <= 4", ("u", _USES))
def project_most_used(spark, sf_dir):
    used = _uses(spark, sf_dir).groupBy("project_id", "symbol_id").agg(F.count("*").alias("n"))
    return K.top_k(used, ["project_id"], [F.desc("n"), "symbol_id"], 4)


@query("select project_id, node, dependents, dependents / total as centrality from (select project_id, dst as node, count(distinct src) as dependents, row_number() over (partition by project_id order by count(distinct src) desc, dst) as r from e group by 1, 2) join (select project_id, count(distinct n) as total from (select project_id, src as n from e union all select project_id, dst from e) group by 1) using (project_id) where r <= 5", ("e", _LINKS), doubles=("centrality",))
def project_hubs(spark, sf_dir):
    return G.hubs(_links(spark, sf_dir), keys=PROJECT)


@query(
    "select a.project_id, a.src as node, min(b.dst) as component from pairs a join pairs b on a.project_id = b.project_id and a.src = b.src and exists (select 1 from pairs p where p.project_id = a.project_id and p.src = b.dst and p.dst = a.src) where a.src = a.dst group by 1, 2",
    ("e", "select a as project_id, src, dst from v_edges, (select unnest([0, 1]) as a) x where (src + dst) % 3 <> a"), ("pairs", "select project_id, src, dst from e union select p.project_id, p.src, e.dst from pairs p join e on p.project_id = e.project_id and p.dst = e.src"), recursive=True,
)
def project_cycles(spark, sf_dir):
    """Two projects with the same files and different imports."""
    edges = table(spark, sf_dir, "v_edges").withColumn("project_id", F.explode(F.array(F.lit(0), F.lit(1)))).where("(src + dst) % 3 <> project_id")
    return G.cycles(edges, keys=PROJECT)


@query(
    "select project_id, a, b, count(*) as n from (select x.project_id, x.symbol_id as a, y.symbol_id as b from s x join s y on x.project_id = y.project_id and x.file = y.file and x.symbol_id <> y.symbol_id) group by 1, 2, 3 having count(*) >= 2",
    ("u", _USES), ("s", "select distinct project_id, file, symbol_id from u"),
)
def project_co_occurrence(spark, sf_dir):
    """In blocks of two, so that nearly every file is cut into tiles."""
    return U.co_occurrence(_uses(spark, sf_dir), keys=PROJECT, block=2)


@query("select project_id, kind, count(*) as total, count(*) filter (where exported) as exported, count(*) filter (where not used) as unused from (select d.*, exists (select 1 from u where u.project_id = d.project_id and u.symbol_id = d.symbol_id) as used from d) group by grouping sets ((project_id, kind), (project_id))", ("u", _USES), ("d", _DEFS))
def project_index_statistics(spark, sf_dir):
    return U.index_statistics(_defs(spark, sf_dir), _uses(spark, sf_dir), keys=PROJECT)


# Wider forms.

# Aliases: @/ is src, @/lib/ is packages/lib, ~ is app. Files take turns between the folders.
_FILES = "select distinct case p_partkey % 5 when 0 then 'src/m' || p_size || '.ts' when 1 then 'packages/lib/m' || p_size || '/index.js' when 2 then 'app/m' || p_size || '.tsx' when 3 then 'src/pkg/m' || p_size || '.py' else 'backend/pkg/m' || p_size || '/__init__.py' end as file from part where p_size % 4 <> 0"
_MODULES = "select p_partkey as id, p_size as z, p_partkey % 4 as way, case p_partkey % 4 when 0 then '@/m' || p_size when 1 then '@/lib/m' || p_size when 2 then '~m' || p_size else 'pkg.m' || p_size end as module from part"


@query(
    "select id, module, case way when 0 then (select min(file) from f where file = 'src/m' || z || '.ts') when 1 then coalesce((select min(file) from f where file = 'packages/lib/m' || z || '/index.js'), (select min(file) from f where file = 'src/lib/m' || z || '.ts')) when 2 then (select min(file) from f where file = 'app/m' || z || '.tsx') "
    "else coalesce((select min(file) from f where file = 'backend/pkg/m' || z || '/__init__.py'), (select min(file) from f where file = 'src/pkg/m' || z || '.py')) end as target from m",
    ("f", _FILES), ("m", _MODULES),
)
def resolve_aliases(spark, sf_dir):
    """Path aliases of which one begins with another, and dotted modules under source roots."""
    part = table(spark, sf_dir, "part")
    files = part.where("p_size % 4 <> 0").select(F.expr("case p_partkey % 5 when 0 then concat('src/m', p_size, '.ts') when 1 then concat('packages/lib/m', p_size, '/index.js') when 2 then concat('app/m', p_size, '.tsx') when 3 then concat('src/pkg/m', p_size, '.py') else concat('backend/pkg/m', p_size, '/__init__.py') end").alias("file"))
    modules = part.select(F.col("p_partkey").alias("id"), F.expr("case p_partkey % 4 when 0 then concat('@/m', p_size) when 1 then concat('@/lib/m', p_size) when 2 then concat('~m', p_size) else concat('pkg.m', p_size) end").alias("module"))
    aliases = spark.createDataFrame([("@/", "src"), ("@/lib/", "packages/lib"), ("~", "app")], "prefix string, target string")
    return R.resolve_imports(modules, files, aliases, dotted=True)


_CALLS = "select l_orderkey as file, 's' || l_suppkey % 12 || case l_linenumber % 3 when 0 then '.a' when 1 then '?.b()' else '' end as object, 's' || l_suppkey % 12 as root, 'S' || l_suppkey % 12 as cls, l_partkey as member from lineitem where l_returnflag = 'R'"


@query(
    "select file, object, member, finding, severity, count(*) as n from (select *, 'undefinedVariable' as finding, 'critical' as severity from u where root not in (select 's' || s_suppkey from supplier where s_suppkey < 10) union all "
    "select *, 'nonExistentMethod', 'medium' from u where root in (select 's' || s_suppkey from supplier where s_suppkey < 10) and file % 2 = 0 and not exists (select 1 from part where p_partkey = member and (p_size % 3 = 0 or (p_size % 3 = 1 and 's' || p_size % 12 in (root, object)) or (p_size % 3 = 2 and 'S' || p_size % 12 = cls and p_size % 12 < 6)))) "
    "where root <> 's3' and member % 50 <> 0 group by all",
    ("u", _CALLS),
)
def unresolved_methods_of_imports(spark, sf_dir):
    """Methods on chains, of instances of classes, on imports of the project's own files; built-in members aside."""
    usages = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.expr("concat('s', l_suppkey % 12, case l_linenumber % 3 when 0 then '.a' when 1 then '?.b()' else '' end)").alias("object"), F.col("l_partkey").alias("member"))
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.expr("case p_size % 3 when 1 then concat('s', p_size % 12) when 2 then concat('S', p_size % 12) end").alias("scope"))
    roots = table(spark, sf_dir, "supplier").where("s_suppkey < 10").select(F.expr("concat('s', s_suppkey)").alias("root"))
    classes = spark.range(6).select(F.expr("concat('S', id)").alias("name"))
    internal = usages.where("file % 2 = 0").select("file", F.regexp_extract("object", "^s[0-9]+", 0).alias("name"))
    members = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("member"))
    found = R.unresolved_methods(usages, catalog, ["s3"], roots, members, classes, internal)
    return found.groupBy("file", "object", "member", "finding", "severity").agg(F.count("*").alias("n"))


@query(
    "select event_id, member, case when root = 'window' and code like '%as any%' then 'critical' when root = 'React' and before like '%@ts-ignore%' then 'high' else 'medium' end as severity, cast(case when root = 'window' and code like '%as any%' then 96 when root = 'React' and before like '%@ts-ignore%' then 85 else 86 end as int) as confidence "
    "from (select event_id, event_type as member, case user_id % 2 when 0 then 'window' else 'React' end as root, case when event_id % 3 = 0 then '(x as any).f()' else 'x.f()' end as code, case when event_id % 4 = 0 then '// @ts-ignore' end as before from events) where (root = 'window' and member not in ('click', 'view')) or (root = 'React' and member <> 'purchase')"
)
def closed_namespace_lines(spark, sf_dir):
    code, before = F.expr("case when event_id % 3 = 0 then '(x as any).f()' else 'x.f()' end"), F.expr("case when event_id % 4 = 0 then '// @ts-ignore' end")
    events = table(spark, sf_dir, "events").select("event_id", F.expr("case user_id % 2 when 0 then 'window' else 'React' end").alias("root"), F.col("event_type").alias("member"), code.alias("code"), before.alias("before"))
    members = spark.createDataFrame([("window", "click"), ("window", "view"), ("React", "purchase")], "root string, member string")
    return R.closed_namespaces(events, members, lines=True).select("event_id", "member", "severity", "confidence")


@query(
    "select handler, finding, name, severity, cast(confidence as int) as confidence from (select distinct user_id as handler, 'noResponse' as finding, cast(null as varchar) as name, 'high' as severity, 75 as confidence from events where user_id not in (select user_id from events where event_type = 'view' and value > 90) "
    "union all select distinct user_id, 'unknownProperty', k, 'high', 80 from x where m in (select n_name from nation) and f not in (select cast(n_regionkey as varchar) from nation where n_name = m))",
    ("x", "select user_id, n_name || '.' || event_id % 7 as k, n_name as m, cast(event_id % 7 as varchar) as f from events join nation on n_nationkey = event_id % 30 where event_type = 'click'"),
)
def handler_properties(spark, sf_dir):
    """Handlers without an answer, and properties that a model doesn't have."""
    events, nation = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    names = nation.select(F.col("n_nationkey").alias("k"), "n_name")
    accessed = events.where("event_type = 'click'").withColumn("k", F.expr("event_id % 30")).join(names, "k").select(F.col("user_id").alias("handler"), F.lit("access").alias("fact"), F.expr("concat(n_name, '.', event_id % 7)").alias("name"))
    facts = events.where("event_type = 'view' and value > 90").select(F.col("user_id").alias("handler"), F.lit("respond").alias("fact"), F.lit(None).cast("string").alias("name")).unionByName(accessed)
    fields = nation.select(F.col("n_name").alias("model"), F.col("n_regionkey").cast("string").alias("field"))
    return R.broken_handlers(events.select(F.col("user_id").alias("handler")), facts, nation.select(F.col("n_name").alias("name")), fields)


@query(
    "select p_partkey as id, 'nonExistentType' as finding, p_brand as name, 'high' as severity, cast(85 as int) as confidence from part where p_brand not in ('Brand#11') and p_brand not in (select p_brand from part where p_size = 1 and p_partkey % 3 = 0) union all "
    "select distinct l_orderkey, 'nonExistentProperty', l_partkey || '.' || l_linenumber, 'high', cast(70 as int) from lineitem join part on p_partkey = l_partkey where p_type in (select p_type from part where p_size % 7 = 0) and l_linenumber not in (select q.p_size from part q where q.p_type = part.p_type and q.p_size % 7 = 0)"
)
def type_and_property_findings(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    refs = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    accesses = lines.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("object"), F.col("l_linenumber").alias("property"))
    properties = part.where("p_size % 7 = 0").select(F.col("p_type").alias("type"), F.col("p_size").alias("property"))
    return R.unknown_types(refs, part.where("p_size = 1 and p_partkey % 3 = 0").select(F.col("p_brand").alias("name")), ["Brand#11"], accesses, part.select(F.col("p_partkey").alias("object"), F.col("p_type").alias("type")), properties)


_BOTH_WAYS = "select distinct o_custkey as seed, o_custkey as node, 0 as depth from orders where o_orderkey % 900 = 0 union select w.seed, e.b, w.depth + 1 from walk w join (select src as a, dst as b from v_edges union select dst, src from v_edges) e on e.a = w.node where w.depth < 2"


@query(
    "select seed, count(*) as files, cast(coalesce(sum(i), 0) as bigint) as imports, cast(coalesce(sum(b), 0) as bigint) as imported_by, coalesce((select list(distinct s_name order by s_name) from (select distinct seed as q, node from walk) join supplier on s_suppkey = node % 20 where q = seed), []) as external, "
    "(select count(distinct s_name) from (select distinct seed as q, node from walk) join supplier on s_suppkey = node % 20 where q = seed) as packages from (select distinct seed, node from walk) left join (select src as node, count(distinct dst) as i from v_edges group by 1) using (node) left join (select dst as node, count(distinct src) as b from v_edges group by 1) using (node) group by seed",
    ("walk", _BOTH_WAYS), recursive=True,
)
def neighbourhood_summary(spark, sf_dir):
    """Files, imports and external packages around each seed; a customer needs the supplier of its number."""
    edges = table(spark, sf_dir, "v_edges")
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 900 = 0").select(F.col("o_custkey").alias("seed")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(seeds.select(F.col("seed").alias("node"))).distinct()
    needs = nodes.withColumn("s_suppkey", F.col("node") % 20).join(table(spark, sf_dir, "supplier"), "s_suppkey").select("node", F.col("s_name").alias("package"))
    return G.neighbourhood_summary(edges, seeds, 2, external=needs)


@query("select file, chunk, min(symbol_id) as first, count(*) as n, list(symbol_id order by symbol_id) as values from (select *, (row_number() over (partition by file order by symbol_id) - 1) // 3 as chunk from (select distinct l_suppkey as file, l_partkey as symbol_id from lineitem)) group by 1, 2")
def file_postings(spark, sf_dir):
    """Symbols of each file in lists of three at most."""
    return U.postings(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol_id")), "file", "symbol_id", 3)


@query("select distinct l_suppkey as file, l_partkey as value from lineitem where l_partkey % 4 = 1")
def posting_lookup(spark, sf_dir):
    """Each file is asked for every fourth number; what it has is found in the one chunk that could hold it."""
    lines = table(spark, sf_dir, "lineitem")
    lists = U.postings(lines.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol_id")), "file", "symbol_id", 8)
    asked = lines.where("l_partkey % 4 = 1").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("value"))
    return U.in_postings(lists, asked.unionByName(asked.withColumn("value", -F.col("value"))), "file")


@query(
    "select 'language' as section, lang as value, count(*) as n from documents group by lang union all select 'kind', kind, count(*) from v_catalog group by kind union all (select 'name', name, count(*) as n from v_catalog group by name order by n desc, name limit 20) "
    "union all (select 'imported', cast(symbol_id as varchar) as v, count(*) as n from v_imports group by symbol_id order by n desc, v limit 10) union all select 'directory', case doc_id % 3 when 0 then '.' when 1 then 'src' else 'src/' || source end, count(*) from documents group by 2"
)
def project_overview(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.expr("concat(case doc_id % 3 when 0 then '' when 1 then 'src/' else concat('src/', source, '/') end, doc_id, '.txt')").alias("path"))
    return U.project_summary(files, table(spark, sf_dir, "v_catalog"), imports=table(spark, sf_dir, "v_imports").select(F.col("symbol_id").alias("target")), path="path")


@query(
    "select event_id, status, method, cast(adjusted as int) as adjusted from (select f.event_id, case when m.method is not null then 'false_positive' when f.type in ('nonExistentFunction', 'unusedImport', 'dependencyHallucination', 'wrongParamCount') then 'confirmed' else 'uncertain' end as status, "
    "case when m.method is not null then m.method else case f.type when 'nonExistentFunction' then 'static_analysis' when 'unusedImport' then 'usage_analysis' when 'dependencyHallucination' then 'registry_check' when 'wrongParamCount' then 'signature_analysis' else 'none' end end as method, "
    "case when m.method = 'cross_reference' then 90 when m.method = 'future_feature_detection' then 85 when m.method = 'usage_analysis' then 90 else case f.type when 'nonExistentFunction' then case when f.file in ('f1', 'f3') then 90 else 95 end when 'unusedImport' then 95 when 'dependencyHallucination' then 99 when 'wrongParamCount' then 92 else f.confidence end end as adjusted "
    "from v_findings f left join (select type, file, project_id, case min(case method when 'cross_reference' then 1 when 'future_feature_detection' then 2 else 3 end) when 1 then 'cross_reference' when 2 then 'future_feature_detection' else 'usage_analysis' end as method from ev group by 1, 2, 3) m on m.type = f.type and m.file = f.file and m.project_id = f.project_id)",
    ("ev", "select type, file, project_id, case when type = 'unusedImport' then 'usage_analysis' when confidence % 2 = 0 then 'cross_reference' else 'future_feature_detection' end as method from v_findings where severity = 'low' and type in ('unusedImport', 'nonExistentFunction')"),
)
def verify_with_methods(spark, sf_dir):
    findings = table(spark, sf_dir, "v_findings")
    evidence = findings.where("severity = 'low' and type in ('unusedImport', 'nonExistentFunction')").select("type", "file", "project_id", F.expr("case when type = 'unusedImport' then 'usage_analysis' when confidence % 2 = 0 then 'cross_reference' else 'future_feature_detection' end").alias("method"))
    changed = findings.where("file in ('f1', 'f3')").select("file")
    return N.verify_with_methods(findings, evidence, ["file", "project_id"], changed).select("event_id", "status", "method", "adjusted")


@query("select event_id, (select count(*) from v_findings where severity = 'high') as total, (select count(*) from v_findings where severity = 'high') > 60 as has_more from v_findings where severity = 'high' order by event_id limit 20 offset 40")
def page_with_total(spark, sf_dir):
    return N.page_with_total(table(spark, sf_dir, "v_findings"), ["event_id"], 20, 40, severity="high").select("event_id", "total", "has_more")


@query("select service, method, route, coalesce((select list(distinct method order by method) from r where r.path = x.route and r.method <> x.method), []) as other_methods from (select s.page_id as service, s.method, (select min(path) from r where regexp_replace(r.path, '^/|/$', '', 'g') = regexp_replace(s.path, '^/|/$', '', 'g') and r.method = s.method) as route from v_paths s) x where route is not null", ("r", "select distinct path, case page_id % 7 when 0 then 'GET' else method end as method from v_paths"))
def other_methods(spark, sf_dir):
    """The other methods of each path that a service calls with one of its own."""
    paths = table(spark, sf_dir, "v_paths")
    routes = paths.select("path", F.expr("case page_id % 7 when 0 then 'GET' else method end").alias("method"))
    found = C.match_endpoints(paths.select(F.col("page_id").alias("service"), "method", "path"), routes, methods=True)
    return found.where("tier = 1").select("service", "method", "route", "other_methods")


# State.

_SESSIONS = "select user_id % 3 as project_id, cast(user_id as varchar) as session, ts, event_id from events"


@query(
    "select cast(project_id as bigint) as project_id, session, ts as last, 'evicted' as reason from (select e.*, lead(event_id) over (partition by project_id, session order by ts, event_id) as next from s e) x "
    "where (select count(distinct session) from s o where o.project_id = x.project_id and (o.ts, o.event_id) > (x.ts, x.event_id) and (x.next is null or (o.ts, o.event_id) < (select (n.ts, n.event_id) from s n where n.event_id = x.next))) >= 10",
    ("s", _SESSIONS),
)
def newest_sessions(spark, sf_dir):
    """A project's ten newest sessions are state; each that goes is given with its last event."""
    events = T.events_stream(spark, sf_dir).select((F.col("user_id") % 3).alias("project_id"), F.col("user_id").alias("session"), "ts", "event_id")
    return T.run_once(T.newest_sessions(events, 10, None)).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query(
    "select agent, first, last, n from (select agent, min(ts) as first, max(ts) as last, count(*) as n from (select *, sum(fresh) over (partition by agent order by ts, event_id) as s from (select user_id as agent, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 600 minute then 0 else 1 end as fresh from events)) group by agent, s) "
    "where last + interval 600 minute < (select max(ts) from events) - interval 1 minute or (agent, last) not in (select user_id, max(ts) from events group by 1)"
)
def session_state(spark, sf_dir):
    """Sessions as state of their own, ended by the next event or by a timer."""
    events = T.events_stream(spark, sf_dir).select(F.col("user_id").alias("agent"), "ts")
    return T.run_once(T.session_state(events, 600)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


_VERSIONS = "select event_id, event_id % 400 as file, event_type <> 'error' as live, [event_id % 90, user_id] as defs, [event_id % 70] as imports, [event_id % 70, user_id % 40] as uses from events"
_LIVE = "select v.* from v join (select file, max(event_id) as event_id from v group by 1) n using (file, event_id) where live"


@query(
    "select cast(0 as bigint) as project_id, file, s as symbol_id, type from (select distinct file, unnest(uses) as s, 'unresolvedReference' as type from l) where s not in (select unnest(defs) from l) union all select cast(0 as bigint), file, s, 'unusedImport' from (select file, unnest(imports) as s, uses from l) where not list_contains(uses, s) "
    "union all select cast(0 as bigint), file, s, 'unusedExport' from (select distinct file, unnest(defs) as s from l) where s % 2 = 0 and s not in (select unnest(imports) from l)",
    ("v", _VERSIONS), ("l", _LIVE),
)
def maintained_findings(spark, sf_dir):
    """Files change again and again, with what they define and import; the findings are those of the newest versions."""
    events = T.events_stream(spark, sf_dir)
    defs = F.transform(F.array(F.col("event_id") % 90, F.col("user_id")), lambda s: F.struct(s.alias("symbol_id"), (s % 2 == 0).alias("exported")))
    edits = events.select(
        F.lit(0).cast("long").alias("project_id"), (F.col("event_id") % 400).alias("file"), "event_id", F.when(F.col("event_type") == "error", "unlink").otherwise("change").alias("change_type"),
        defs.alias("definitions"), F.array(F.col("event_id") % 70).alias("imports"), F.array(F.col("event_id") % 70, F.col("user_id") % 40).alias("uses"),
    )
    return T.maintained_findings(edits)


@query("select project_id, file, event_id from v_findings f where severity <> 'low' and not exists (select 1 from v_findings c where c.project_id = f.project_id and c.file = f.file and c.severity = 'low')")
def scrubbed_scan(spark, sf_dir):
    """The findings of a first scan that no later clean check of their file has cleared."""
    findings = table(spark, sf_dir, "v_findings")
    live = findings.where("severity = 'low'").select("project_id", "file", F.lit(True).alias("clean"))
    return T.scrubbed(findings.where("severity <> 'low'"), live).select("project_id", "file", "event_id")
