"""Queries over endpoints, fields, parameters and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import contracts as C
from loomspan.plans.registry import query
from loomspan.plans.views import table

_NORM = "regexp_replace({0}, '^/|/$', '', 'g')"
_GENERIC = "regexp_replace(regexp_replace({0}, '^/|/$', '', 'g'), '[0-9]+|\\{{id\\}}', '{{param}}', 'g')"
_SERVICES = "select page_id as service, method, case page_id % 3 when 1 then regexp_replace(path, '[0-9]+', '{id}') else '/api' || regexp_replace(path, '[0-9]+', ':num') end as path from v_services"
_STRIP = "regexp_replace(regexp_replace(path, '^/|/$', '', 'g'), '^api/', '')"
_MATCHES = (
    "select service, method, path, h.route as route, h.route_method as route_method, cast(h.tier as int) as tier, cast(case when h is null then 0 when h.tier <= 4 then 100 else 50 end as int) as score from s left join (select service, min({'tier': t, 'route': route, 'route_method': rm}) as h from "
    "(select s.service, case when s.method = r.method then k else k + 4 end as t, r.path as route, r.method as rm from (select service, method, unnest([1, 2, 3, 4]) as k, unnest([regexp_replace(path, '^/|/$', '', 'g'), strip, "
    "regexp_replace(regexp_replace(path, '^/|/$', '', 'g'), ':num|\\{id\\}', '{param}', 'g'), regexp_replace(strip, ':num|\\{id\\}', '{param}', 'g')]) as key from (select *, regexp_replace(regexp_replace(path, '^/|/$', '', 'g'), '^api/', '') as strip from s)) s "
    "join (select distinct method, path, unnest([1, 2, 3, 4]) as k, unnest([regexp_replace(path, '^/|/$', '', 'g'), regexp_replace(path, '^/|/$', '', 'g'), regexp_replace(regexp_replace(path, '^/|/$', '', 'g'), '\\{id\\}', '{param}', 'g'), regexp_replace(regexp_replace(path, '^/|/$', '', 'g'), '\\{id\\}', '{param}', 'g')]) as key from v_routes) r using (k, key)) group by 1) m using (service)"
)


def _services(spark, sf_dir):
    generic = "case page_id % 3 when 1 then regexp_replace(path, '^([^0-9]*)[0-9]+', '$1{id}') else concat('/api', regexp_replace(path, '^([^0-9]*)[0-9]+', '$1:num')) end"
    return table(spark, sf_dir, "v_services").select(F.col("page_id").alias("service"), "method", F.expr(generic).alias("path"))


def _matches(spark, sf_dir):
    return C.match_endpoints(_services(spark, sf_dir), table(spark, sf_dir, "v_routes"))


@query("select * from m", ("s", _SERVICES), ("m", _MATCHES))
def match_endpoints(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(
    "select method, path from v_routes r where not exists (select 1 from m where m.route = r.path and m.route_method = r.method) and string_split(regexp_replace(r.path, '^/|/$', '', 'g'), '/')[1] in (select string_split(strip, '/')[1] from (select " + _STRIP + " as strip from s)) "
    "and regexp_replace(r.path, '^/|/$', '', 'g') not in (select regexp_replace(path, '^/|/$', '', 'g') from s)",
    ("s", _SERVICES + " where method = 'GET'"), ("m", _MATCHES),
)
def unmatched_routes(spark, sf_dir):
    """Routes that the reading callers leave unused."""
    services = _services(spark, sf_dir).where("method = 'GET'")
    routes = table(spark, sf_dir, "v_routes")
    return C.unmatched_routes(routes, C.match_endpoints(services, routes), services).select("method", "path")


@query("select method, path, file, 'high' as severity, 85 as confidence from (select distinct method, case when page_id % 2 = 0 then path else '/api' || path end as path, case when page_id % 5 < 3 then 'src/routes/r.ts' else 'src/pages/p.ts' end as file from v_paths) where file like '%/routes/%' and regexp_replace(path, '^/|/$', '', 'g') <> 'api' and regexp_replace(path, '^/|/$', '', 'g') not like 'api/%'")
def unregistered_routes(spark, sf_dir):
    """Every page as a route of a router or of a page; every other one under the prefix."""
    routes = table(spark, sf_dir, "v_paths").select("method", F.expr("case when page_id % 2 = 0 then path else concat('/api', path) end").alias("path"), F.expr("case when page_id % 5 < 3 then 'src/routes/r.ts' else 'src/pages/p.ts' end").alias("file")).distinct()
    return C.unregistered_routes(routes)


_SEGMENTS = (
    "select service, route, same, unnest(x) as a, unnest(y) as b from (select service, r.path as route, sp = rp as same, string_split(sp, '/') as x, string_split(rp, '/') as y from (select service, " + _STRIP + " as sp from s) s join (select distinct path, " + _STRIP + " as rp from routes) r on len(string_split(sp, '/')) = len(string_split(rp, '/')))"
)
_NEAR = (
    "select service, route, same, case when same then 1.0 else round(sum(case when a = b then 1.0 when regexp_matches(a, '^[{<:$]') or regexp_matches(b, '^[{<:$]') then 0.6 when near >= 0.5 then near else 0 end) / count(*), 9) end as similarity from (select *, case when a = '' or b = '' then 0.0 "
    "when lower(a) like '%' || lower(b) || '%' or lower(b) like '%' || lower(a) || '%' then 0.8 else greatest(cp / least(length(a), length(b)) * 0.7 + cp / greatest(length(a), length(b)) * 0.3, 1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b))) end as near "
    "from (select *, coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: lower(a)[i] <> lower(b)[i]), true) - 1, least(length(a), length(b))) as cp from seg)) group by 1, 2, 3"
)
_BEST = "select service, b.route as route, b.similarity as similarity, b.same as same_path from (select service, arg_min({'route': route, 'similarity': similarity, 'same': same}, (-similarity, route)) as b from near where similarity >= 0.7 group by 1)"


@query("select * from best", ("s", _SERVICES), ("routes", "select * from v_routes"), ("seg", _SEGMENTS), ("near", _NEAR), ("best", _BEST), doubles=("similarity",))
def similar_route(spark, sf_dir):
    return C.similar_route(_services(spark, sf_dir), table(spark, sf_dir, "v_routes"))


@query(
    "select m.service, case when m.route is not null or same_path then 'methodMismatch' when b.route is not null then 'pathMismatch' else 'notFound' end as finding, case when m.route is not null or same_path then 'critical' when b.route is not null then 'high' else 'critical' end as severity, "
    "cast(case when m.route is not null or same_path then 95 when b.route is not null then 90 else 95 end as int) as confidence from m left join best b on b.service = m.service where m.route is null or m.tier > 4",
    ("s", _SERVICES), ("routes", "select * from v_routes where method in ('GET', 'PUT')"), ("m", _MATCHES.replace("from v_routes)", "from routes)")), ("seg", _SEGMENTS), ("near", _NEAR), ("best", _BEST),
)
def unmatched_services(spark, sf_dir):
    services, routes = _services(spark, sf_dir), table(spark, sf_dir, "v_routes").where("method in ('GET', 'PUT')")
    return C.unmatched_services(C.match_endpoints(services, routes), C.similar_route(services, routes))


_FIELDS = "select owner || '_' || (case side when 0 then 'A' else 'a' end) as owner, side, case when side = 0 and required = 1 then upper(field) else field end as field, ftype, required from v_fields"
_PAIRS = (
    "select owner, model, cast(tier as int) as tier, overlap from (select *, row_number() over (partition by owner order by tier, overlap desc, model) as r from (select *, case when lower(replace(owner, '_', '')) = lower(replace(model, '_', '')) and overlap >= 0.1 then 2 when overlap > 0.7 then 3 end as tier from "
    "(select x.owner, y.owner as model, count(*) / (max(x.n) + max(y.n) - count(*)) as overlap from nf x join nf y on x.f = y.f and x.side = 0 and y.side = 1 group by 1, 2)) where tier is not null) where r = 1"
)
_NF = "select *, count(*) over (partition by owner, side) as n from (select distinct owner, side, replace(lower(field), '_', '') as f from fl)"


def _fields(spark, sf_dir):
    f = table(spark, sf_dir, "v_fields")
    return f.withColumns({"owner": F.expr("concat(owner, '_', case side when 0 then 'A' else 'a' end)"), "field": F.expr("case when side = 0 and required = 1 then upper(field) else field end")})


@query("select * from p", ("fl", _FIELDS), ("nf", _NF), ("p", _PAIRS), doubles=("overlap",))
def match_models(spark, sf_dir):
    return C.match_models(_fields(spark, sf_dir))


_DIFF = (
    "select owner, model, f as field, unnest(list_filter([case when a is null and required = 1 then 'missingRequired/high/95' end, case when ta <> bt then 'typeMismatch/medium/85' end, case when b is null then 'extraField/low/70' end], lambda x: x is not null)) as x from "
    "(select coalesce(u.owner, v.owner) as owner, coalesce(u.model, v.model) as model, coalesce(u.f, v.f) as f, u.a, u.ta, v.b, v.bt, v.required from (select p.owner, p.model, replace(lower(field), '_', '') as f, field as a, ftype as ta from p join fl on fl.owner = p.owner and side = 0) u "
    "full join (select p.owner, p.model, replace(lower(field), '_', '') as f, field as b, ftype as bt, required from p join fl on fl.owner = p.model and side = 1) v on u.owner = v.owner and u.model = v.model and u.f = v.f)"
)


@query("select owner, model, field, string_split(x, '/')[1] as finding, string_split(x, '/')[2] as severity, cast(string_split(x, '/')[3] as int) as confidence from d", ("fl", _FIELDS), ("nf", _NF), ("p", _PAIRS), ("d", _DIFF))
def field_diff(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    return C.field_diff(C.match_models(fields), fields)


@query("select p.owner, p.model, cast(greatest(0, 100 - coalesce(sum(case when x like 'missing%' then 15 when x like 'type%' then 10 else 0 end), 0)) as bigint) as score from p left join d on d.owner = p.owner and d.model = p.model group by 1, 2", ("fl", _FIELDS), ("nf", _NF), ("p", _PAIRS), ("d", _DIFF))
def type_compatibility_score(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    pairs = C.match_models(fields)
    return C.compatibility_score(pairs, C.field_diff(pairs, fields))


@query(
    "select p.owner, p.model, c as coverage, cast(greatest(0, 100 - case when c < 0.8 then 20 else 0 end - 10 * (select count(*) from d where d.owner = p.owner and d.model = p.model and x like 'type%')) as bigint) as score from p join (select p.owner, p.model, "
    "(select count(*) from nf a join nf b on a.f = b.f where a.owner = p.owner and b.owner = p.model and a.side = 0 and b.side = 1) / greatest((select count(*) from nf where owner = p.owner and side = 0), (select count(*) from nf where owner = p.model and side = 1)) as c from p) q on q.owner = p.owner and q.model = p.model",
    ("fl", _FIELDS), ("nf", _NF), ("p", _PAIRS), ("d", _DIFF),
    doubles=("coverage",),
)
def field_coverage(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    pairs = C.match_models(fields)
    return C.field_coverage(pairs, fields, C.field_diff(pairs, fields).where("finding = 'typeMismatch'"))


_TYPES = "select p_partkey as id, case p_partkey % 5 when 0 then 'string' when 1 then 'number' when 2 then 'boolean' when 3 then 'item[]' else 'Date' end as a, case p_size % 7 when 0 then 'uuid' when 1 then 'Decimal' when 2 then 'datetime' when 3 then 'list' when 4 then 'int' when 5 then 'str' else 'bool' end as b from part"


@query(
    "select id, case when (la = 'string' and lb in ('str', 'uuid')) or (la = 'number' and lb = 'int') or (la = 'boolean' and lb = 'bool') then null when lb = 'uuid' and la <> 'string' then 'medium uuid' when lb = 'decimal' and la = 'number' then 'medium decimal' when lb = 'datetime' and la <> 'string' then 'high datetime' when la like '%[]%' and lb not like '%list%' then 'high array' end as problem "
    "from (select id, lower(a) as la, lower(b) as lb from t)",
    ("t", _TYPES),
)
def type_compat(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    out = spark.sql(_TYPES).select("id", C.type_problem(F.col("a"), F.col("b")).alias("p"))
    return out.select("id", F.when(F.col("p").isNotNull(), F.concat_ws(" ", "p.severity", "p.problem")).alias("problem"))


_SENT = "select distinct l_suppkey as endpoint, l_partkey % 40 as param, l_returnflag as ptype from lineitem"
_DECL = "select distinct s_suppkey as endpoint, n_nationkey + s_suppkey % 9 as param, case n_nationkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as ptype, n_nationkey % 2 = 0 as required from supplier join nation on n_nationkey % 4 = s_suppkey % 5"


@query(
    "select * from (select coalesce(s.endpoint, d.endpoint) as endpoint, coalesce(s.param, d.param) as param, case when s.param is null and required and coalesce(s.endpoint, d.endpoint) in (select endpoint from sent) then 'missingParam' when d.param is null and s.endpoint in (select endpoint from decl) then 'extraParam' when s.ptype <> d.ptype then 'typeMismatch' end as finding "
    "from sent s full join decl d on s.endpoint = d.endpoint and s.param = d.param) where finding is not null",
    ("sent", _SENT), ("decl", _DECL),
)
def query_param_diff(spark, sf_dir):
    for name in ("lineitem", "supplier", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return C.query_param_diff(spark.sql(_SENT), spark.sql(_DECL))


@query(
    "select service, unnest(list_filter([case when method <> route_method then 'methodMismatch' end, case when len(x) <> len(y) or len(list_filter(list_zip(x, y), lambda z: not (z[1] = z[2] or regexp_matches(z[1], '^[{<:$]') or regexp_matches(z[2], '^[{<:$]')))) > 0 then 'pathMismatch' end, "
    "case when p < r then 'missingParam' end, case when p > r then 'extraParam' end, case when named <> method then 'suspiciousMethod' end], lambda f: f is not null)) as finding from (select *, string_split(" + _STRIP + ", '/') as x, string_split(" + _STRIP.replace("(path", "(route") + ", '/') as y, "
    "cast(regexp_matches(path, ':num|\\{id\\}') as int) as p, cast(regexp_matches(route, ':num|\\{id\\}') as int) as r, case service % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'DELETE' end as named from m where route is not null)",
    ("s", _SERVICES), ("m", _MATCHES),
)
def path_compat(spark, sf_dir):
    named = F.expr("case service % 4 when 0 then 'getThing' when 1 then 'createThing' when 2 then 'removeThing' else 'thing' end")
    return C.path_compat(_matches(spark, sf_dir).withColumn("name", named))


@query(
    "select event_id, cast(case when s.event is null then 0 when b or (action = 'emit' and c) or (action <> 'emit' and v) then 100 else 70 end as int) as score from (select event_id, event_type || user_id % 7 as event, case event_id % 3 when 0 then 'emit' when 1 then 'on' else 'once' end as action from events where event_id % 2 = 0) x "
    "left join (select event_type || user_id % 11 as event, bool_or(event_id % 40 = 1) as b, bool_or(event_id % 3 = 0) as c, bool_or(event_id % 3 <> 0 and event_id % 40 <> 1) as v from (select *, case when event_id % 40 = 1 then 0 else 1 end as k from events) where event_id % 2 = 1 and user_id < 20 group by 1) s using (event)".replace(
        "bool_or(event_id % 3 = 0) as c", "bool_or(event_id % 3 = 0 and event_id % 40 <> 1) as c"
    )
)
def event_contract(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    client = events.where("event_id % 2 = 0").select("event_id", F.expr("concat(event_type, user_id % 7) as event"), F.expr("case event_id % 3 when 0 then 'emit' when 1 then 'on' else 'once' end as action"))
    server = events.where("event_id % 2 = 1 and user_id < 20").select(F.expr("concat(event_type, user_id % 11) as event"), F.expr("case when event_id % 40 = 1 then 'bidirectional' when event_id % 3 = 0 then 'client-to-server' else 'server-to-client' end as direction"))
    return C.event_contract(client, server).select("event_id", "score")


@query(
    "select page_id, '/' || regexp_replace(regexp_replace(coalesce(p1, p2, '') || '/' || path, '/+', '/', 'g'), '^/|/$', '', 'g') as full_path from (select page_id, path, (select min('/m' || n_regionkey) from nation where n_nationkey < 10 and 'f' || n_nationkey = 'f' || page_id % 30) as p1, (select min('/m' || n_regionkey) from nation where n_nationkey < 10 and 'f' || n_nationkey = 'f' || page_id % 13) as p2 from v_paths)"
)
def apply_mounts(spark, sf_dir):
    routes = table(spark, sf_dir, "v_paths").select("page_id", F.expr("concat('src/f', page_id % 30, '.ts') as file"), F.expr("concat('f', page_id % 13) as router"), "path")
    mounts = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.expr("concat('f', n_nationkey) as key"), F.expr("concat('/m', n_regionkey) as prefix"))
    return C.apply_mounts(routes, mounts).select("page_id", "full_path")


@query(
    "select (select count(*) from v_findings where severity = 'critical') as critical, (select count(*) from v_findings where severity = 'high') as high, (select count(*) from v_findings where severity = 'medium') as medium, (select count(*) from v_findings where severity = 'low') as low, "
    "(select count(*) from m where route is not null) as matched, (select count(*) from m where route is null) as unmatched",
    ("s", _SERVICES), ("m", _MATCHES),
)
def contract_summary(spark, sf_dir):
    return C.contract_summary(table(spark, sf_dir, "v_findings"), _matches(spark, sf_dir))
