"""Queries over paths, names and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import filters as P
from loomspan.operators import findings as O
from loomspan.plans.registry import query
from loomspan.plans.views import table

_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_SEGMENTS = ("fr", "node_modules", "dist", "en")


@query(f"select page_id, url from pages where not list_has_any(string_split(replace(url, '\\', '/'), '/'), [{_LIST((*S.EXCLUDED, 'fr'))}])")
def exclude_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~S.is_excluded(F.col("url"), [*S.EXCLUDED, "fr"])).select("page_id", "url")


@query("select page_id, path from v_paths where not regexp_full_match(path, '/en/[^/]*|/(.*/)?7[^/]*')")
def ignore_globs(spark, sf_dir):
    return table(spark, sf_dir, "v_paths").where(~S.is_ignored(F.col("path"), ["/en/*", "/**/7*"])).select("page_id", "path")


@query(
    "select page_id, regexp_matches(lower(url), '\\.test\\.|\\.spec\\.|__tests__|/tests?/') as is_test, regexp_matches(lower(f), '^\\..*rc$|config\\.|settings\\.|\\.env|package\\.json|tsconfig') as is_config, "
    "regexp_matches(lower(f), '^(index|main|app|server|cli|tool|handler|mcp|worker)') or regexp_matches(lower(url), '^src/[^/]+$') or contains(lower(url), '/bin/') as is_entry from (select *, list_last(string_split(url, '/')) as f from pages)"
)
def classify_file(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.is_test(url).alias("is_test"), S.is_config(url).alias("is_config"), S.is_entry_point(url).alias("is_entry"))


@query("select symbol_id, case when kind in ('PROMO') then 'function' when kind in ('STANDARD', 'SMALL') then 'class' when kind = 'ECONOMY' then 'method' else 'variable' end as kind from v_catalog")
def map_kind(spark, sf_dir):
    kind = S.map_kind(F.col("kind"), ("PROMO",), ("STANDARD", "SMALL"), ("ECONOMY",))
    return table(spark, sf_dir, "v_catalog").select("symbol_id", kind.alias("kind"))


_SCOPE_SQL = (
    "case when regexp_matches(lower(url), '/fr/') then 'shared' when regexp_matches(lower(url), 'www\\.|blog\\.') and not regexp_matches(lower(url), '/de/') then 'frontend' when regexp_matches(lower(url), '/de/') then 'backend' "
    "when regexp_matches(url, '\\.[tj]sx$') then 'frontend' when url like '%.py' and url not like '%test%' and regexp_matches(lower(url), 'main\\.py|app\\.py') then 'backend' else 'unknown' end"
)


@query(f"select page_id, {_SCOPE_SQL} as scope from pages")
def file_scope(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.file_scope(F.col("url"), ["/fr/"], ["www.", "blog."], ["/de/"]).alias("scope"))


@query(
    "select event_id, type, severity from (select *, case event_id % 3 when 0 then 'frontend' when 1 then 'backend' else 'unknown' end as scope from v_findings) where severity in ('critical', 'high') "
    "or type in ('apiContractMismatch', 'unusedFunction', 'unusedExport', 'orphanedFile') or scope = 'unknown' or type in ('unusedImport', 'nonExistentFunction', 'nonExistentMethod')"
)
def filter_by_scope(spark, sf_dir):
    scope = F.when(F.col("event_id") % 3 == 0, "frontend").when(F.col("event_id") % 3 == 1, "backend").otherwise("unknown")
    return O.filter_by_scope(table(spark, sf_dir, "v_findings").withColumn("scope", scope)).select("event_id", "type", "severity")


@query(f"select event_id from v_findings where severity in ('critical', 'high') or type in ({_LIST(O.LENIENT_SCOPE)})")
def filter_by_scope_lenient(spark, sf_dir):
    return O.filter_by_scope(table(spark, sf_dir, "v_findings"), "lenient").select("event_id")


@query(f"select event_id, type from v_findings where severity in ('critical', 'high') or type in ({_LIST(O.LENIENT)})")
def lenient_filter(spark, sf_dir):
    return O.lenient_filter(table(spark, sf_dir, "v_findings")).select("event_id", "type")


@query(f"select page_id, regexp_matches(url, '{S.ignored_endpoints_pattern()}') as ignored from pages")
def ignore_endpoints(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.ignored_endpoint(F.col("url")).alias("ignored"))


@query(
    "select symbol_id, case when n like '%\\_%' escape '\\' then 'snake_case' when regexp_full_match(n, '[a-z]+([A-Z][a-z]+)*') then 'camelCase' when regexp_full_match(n, '[A-Z][a-z]+([A-Z][a-z]+)*') then 'PascalCase' "
    "when n like '%-%' then 'kebab-case' else 'unknown' end as convention from (select symbol_id, case symbol_id % 5 when 0 then replace(name, ' ', '_') when 1 then replace(name, ' ', '-') when 2 then replace(name, ' ', '') when 3 then name else upper(name) end as n from v_catalog)"
)
def naming_convention(spark, sf_dir):
    styled = "case symbol_id % 5 when 0 then replace(name, ' ', '_') when 1 then replace(name, ' ', '-') when 2 then replace(name, ' ', '') when 3 then name else upper(name) end"
    return table(spark, sf_dir, "v_catalog").select("symbol_id", S.naming_convention(F.expr(styled)).alias("convention"))


@query("select p_partkey as id, lower(replace(p_brand || '_' || p_name, '_', '')) as plain, lower(replace(replace(p_brand || '-' || p_name, '_', ''), '-', '')) as bare from part")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), S.normalize_name(F.concat_ws("_", "p_brand", "p_name")).alias("plain"), S.normalize_name(F.concat_ws("-", "p_brand", "p_name"), hyphens=True).alias("bare")
    )


@query(
    "select page_id, p as path, regexp_replace(regexp_replace(regexp_replace(p, '^api/', ''), '^v[0-9]+/', ''), '^rest/', '') as stripped, regexp_replace(g, '\\$\\{[^}]+\\}|\\{[^}]+\\}|<[^>]+>|:[A-Za-z_][A-Za-z0-9_]*', '{param}', 'g') as generic "
    "from (select page_id, regexp_replace(regexp_replace('/api//v2' || path, '/+', '/', 'g'), '^/|/$', '', 'g') as p, regexp_replace(path, '[0-9]+', case page_id % 4 when 0 then '{id}' when 1 then '<id>' when 2 then ':id' else '${a.id}' end) as g from v_paths)"
)
def normalize_path(spark, sf_dir):
    path = F.concat(F.lit("/api//v2"), F.col("path"))
    marked = F.expr("replace(regexp_replace(path, '^([^0-9]*)[0-9]+', '$1@'), '@', case page_id % 4 when 0 then '{id}' when 1 then '<id>' when 2 then ':id' else concat('$', '{a.id}') end)")
    return table(spark, sf_dir, "v_paths").select("page_id", S.normalize_path(path).alias("path"), S.strip_api_prefix(path).alias("stripped"), S.generic_params(marked).alias("generic"))


@query("select page_id, case when m[1] = '@' then array_to_string(string_split(m, '/')[1:2], '/') else string_split(m, '/')[1] end as package, string_split(h, '.')[1] as python_package from (select page_id, case page_id % 2 when 0 then '@s' || path else substr(path, 2) end as m, string_split(url, '/')[3] as h from v_paths join pages using (page_id))")
def package_name(spark, sf_dir):
    both = table(spark, sf_dir, "v_paths").join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    module = F.expr("case page_id % 2 when 0 then concat('@s', path) else substr(path, 2) end")
    return both.select("page_id", S.package_name(module).alias("package"), S.package_name(F.split("url", "/")[2], python=True).alias("python_package"))


@query("select page_id, case page_id % 3 when 0 then 'number' when 1 then 'userId' else 'user_id' end as params from v_paths where regexp_matches(path, '[0-9]')")
def path_params(spark, sf_dir):
    marked = F.expr("regexp_replace(path, '[0-9]+', case page_id % 3 when 0 then '{number}' when 1 then ':userId' else '\\\\$\\\\{item.userId\\\\}' end)")
    found = table(spark, sf_dir, "v_paths").select("page_id", F.array_join(S.path_params(marked), ",").alias("params"))
    return found.where("params <> ''")


@query(
    "select page_id, case when regexp_matches(w, 'get|fetch|load|retrieve|read|list|find|search') then 'GET' when regexp_matches(w, 'create|add|post|submit|save|insert|register|login|logout') then 'POST' "
    "when regexp_matches(w, 'update|edit|modify|change|replace') then 'PUT' when regexp_matches(w, 'patch|partial|tweak') then 'PATCH' when regexp_matches(w, 'delete|remove|destroy|clear|drop') then 'DELETE' end as method "
    "from (select page_id, case page_id % 7 when 0 then 'fetch' when 1 then 'save' when 2 then 'edit' when 3 then 'tweak' when 4 then 'drop' when 5 then 'do' else 'updateList' end || replace(path, '/', '') as w from v_paths)"
)
def infer_method(spark, sf_dir):
    word = F.expr("concat(case page_id % 7 when 0 then 'fetch' when 1 then 'save' when 2 then 'edit' when 3 then 'tweak' when 4 then 'drop' when 5 then 'do' else 'updateList' end, replace(path, '/', ''))")
    return table(spark, sf_dir, "v_paths").select("page_id", S.infer_method(word).alias("method"))


@query("select event_id, event_type from events e where not ((regexp_matches('o' || user_id, '^o1') and event_type = 'click') or (regexp_matches('o' || user_id, '^o2[0-9]$') and event_type = 'view'))")
def trusted_members(spark, sf_dir):
    usages = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("o"), "user_id").alias("object"), F.col("event_type").alias("member"))
    return P.trusted_members(usages, [("^o1", "click"), ("^o2[0-9]$", "view")]).select("event_id", "event_type")


@query("select event_type as member, count(*) as total, count(*) filter (where regexp_matches('o' || user_id, '^o1') and event_type in ('click', 'error')) as dropped from events group by 1")
def trusted_member_stats(spark, sf_dir):
    usages = table(spark, sf_dir, "events").select(F.concat(F.lit("o"), "user_id").alias("object"), F.col("event_type").alias("member"))
    return P.trusted_stats(usages, [("^o1", "click"), ("^o1", "error")])


@query("select file, line, symbol_id, usage_type, count(*) as n from v_usages where symbol_id not in (select p_partkey from part where p_type = 'PROMO') group by all")
def builtins_filter(spark, sf_dir):
    builtins = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("symbol_id"))
    return P.builtins_filter(table(spark, sf_dir, "v_usages"), builtins, ["symbol_id"]).groupBy("file", "line", "symbol_id", "usage_type").agg(F.count("*").alias("n"))


@query(
    "select doc_id, s >= 2 or (s >= 1 and todo) as planned, least(95.0, 60 + s * 15) as confidence from (select doc_id, todo, cast(todo as int) + cast(n_chars < 100 as int) + cast(doc_id % 4 = 0 as int) + case when named then 0.5 else 0 end as s "
    "from (select *, regexp_matches(text, '(?i)license') as todo, regexp_matches(source, '(?i)new|upcoming|planned|future|next|v[0-9]+|version[0-9]+|1') as named from documents))",
    doubles=("confidence",),
)
def planned_feature(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    planned, confidence = P.planned_feature(F.col("doc_id") % 4 == 0, F.col("text").rlike("(?i)license"), F.col("n_chars") < 100, F.lit(False), F.col("source"), extra="|1")
    return docs.select("doc_id", planned.alias("planned"), confidence.alias("confidence"))


@query("select s.page_id, s.method, s.path, r.path is not null as found from v_services s left join v_routes r on s.method = r.method and regexp_replace(s.path, '[0-9]+', '{id}') = r.path")
def endpoint_lookup(spark, sf_dir):
    services = table(spark, sf_dir, "v_services").withColumn("key", F.expr("regexp_replace(path, '^([^0-9]*)[0-9]+', '$1{id}')"))
    return P.endpoint_lookup(services, table(spark, sf_dir, "v_routes").withColumnRenamed("path", "key"), ["method", "key"]).select("page_id", "method", "path", "found")


@query("select symbol_id, name, kind from v_catalog where regexp_matches(name, '^[a-m].* [b-p]') and kind in ('PROMO', 'SMALL')")
def names_matching(spark, sf_dir):
    return P.names_matching(table(spark, sf_dir, "v_catalog"), "^[a-m].* [b-p]", ["PROMO", "SMALL"]).select("symbol_id", "name", "kind")


_POINTS = "case when type in ('unusedExport', 'unusedFunction', 'orphanedFile', 'deadCode') then case severity when 'medium' then 5 else 2 end else case severity when 'critical' then 25 when 'high' then 15 when 'medium' then 8 when 'low' then 3 when 'warning' then 3 else 5 end end"
_RUN = "select *, project_id * 1000 + event_id % 1000 as run from v_findings"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "v_findings").withColumn("run", F.expr("project_id * 1000 + event_id % 1000"))


@query(f"select run, cast(greatest(0, 100 - sum({_POINTS})) as bigint) as score from r group by run", ("r", _RUN))
def quality_score(spark, sf_dir):
    return O.quality_score(_runs(spark, sf_dir), ["run"])


@query(
    "select run, case when fake > 0 then 'REJECT' when critical > 0 then 'REJECT' when high > 2 then 'REVIEW' when issues > 0 then 'CAUTION' when dead > 0 then 'CLEAN_UP' else 'ACCEPT' end as verdict, "
    "case when fake > 0 then 'critical' when critical > 0 then 'critical' when high > 2 then 'high' when issues > 0 then 'medium' else 'low' end as risk from (select run, count(*) filter (where type = 'dependencyHallucination') as fake, "
    "count(*) filter (where severity = 'critical' and not dead) as critical, count(*) filter (where severity = 'high' and not dead) as high, count(*) filter (where not dead) as issues, count(*) filter (where dead) as dead "
    "from (select *, type in ('unusedExport', 'unusedFunction', 'orphanedFile', 'deadCode') as dead from r) group by run)",
    ("r", _RUN),
)
def verdict(spark, sf_dir):
    return O.verdict(_runs(spark, sf_dir), ["run"])


@query(
    "select project_id, dimension, value, count(*) as n from (select project_id, 'severity' as dimension, case when severity in ('critical', 'high', 'medium', 'low') then severity else 'low' end as value from v_findings "
    "union all select project_id, 'type', coalesce(type, 'unknown') from v_findings union all select project_id, 'file', coalesce(file, 'unknown') from v_findings) group by all"
)
def finding_counts(spark, sf_dir):
    return O.breakdown(table(spark, sf_dir, "v_findings"), ["project_id"])


@query(
    "select a.*, b.top_files from (select project_id, count(*) as total, count(*) filter (where not dead) as issues, count(*) filter (where dead) as dead_code, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'high') as high, "
    "count(*) filter (where severity = 'medium') as medium, string_agg(distinct type, ',' order by type) as types from (select *, type in ('unusedExport', 'unusedFunction', 'orphanedFile', 'deadCode') as dead from v_findings) group by 1) a join "
    "(select project_id, string_agg(file, ',' order by r) as top_files from (select project_id, file, row_number() over (partition by project_id order by count(*) desc, file) as r from v_findings group by 1, 2) where r <= 5 group by 1) b using (project_id)"
)
def report_summary(spark, sf_dir):
    return O.report_summary(table(spark, sf_dir, "v_findings"), ["project_id"])


@query("select project_id, count(*) filter (where confidence >= 85) as critical, count(*) filter (where confidence between 70 and 84) as high, count(*) filter (where confidence between 50 and 69) as medium from v_findings group by 1")
def confidence_bands(spark, sf_dir):
    return O.confidence_bands(table(spark, sf_dir, "v_findings"), ["project_id"])


@query("select file, count(*) as n from v_findings group by 1 order by n desc, file limit 10")
def top_files(spark, sf_dir):
    return O.top_files(table(spark, sf_dir, "v_findings"), [], 10)


@query("select event_id, file, type from v_findings where severity = 'high' and file like '%1%' order by event_id limit 25 offset 50")
def page_findings(spark, sf_dir):
    return O.page(table(spark, sf_dir, "v_findings"), ["event_id"], 25, 50, severity="high", file_part="1").select("event_id", "file", "type")


@query("select event_id, project_id, cast(floor((row_number() over (partition by project_id order by event_id) - 1) / 25) as bigint) as chunk from v_findings")
def finding_chunks(spark, sf_dir):
    return O.chunks(table(spark, sf_dir, "v_findings"), "project_id", ["event_id"]).select("event_id", "project_id", "chunk")


@query("select project_id, max(event_id) as last, count(*) as total from v_findings group by 1")
def list_reports(spark, sf_dir):
    return O.list_reports(table(spark, sf_dir, "v_findings"), "project_id", "event_id")


@query("select event_id, file, type from (select *, row_number() over (partition by type, file, severity order by event_id) as r from v_findings) where r = 1")
def dedupe_findings(spark, sf_dir):
    return O.dedupe(table(spark, sf_dir, "v_findings"), ["type", "file", "severity"], ["event_id"]).select("event_id", "file", "type")


@query("select event_id, 'issues' as category from v_findings where type not in ('unusedExport', 'orphanedFile') union all select event_id, 'dead_code' from v_findings where type in ('unusedExport', 'orphanedFile')")
def combine_findings(spark, sf_dir):
    f = table(spark, sf_dir, "v_findings")
    dead = F.col("type").isin("unusedExport", "orphanedFile")
    return O.combine(issues=f.where(~dead), dead_code=f.where(dead)).select("event_id", "category")


@query("select project_id, file, count(*) as n from v_findings where severity = 'critical' group by 1, 2")
def pending_alerts(spark, sf_dir):
    return O.pending_alerts(table(spark, sf_dir, "v_findings").where("severity = 'critical'"), ["project_id", "file"])


_VERIFIED = (
    "select f.*, case when (type = 'nonExistentFunction' and e.file is not null) or (type = 'unusedImport' and i.file is not null) then 'false_positive' when confidence >= 85 then 'confirmed' else 'uncertain' end as status from v_findings f "
    "left join (select distinct concat('f', cast(o_orderkey % 50 as varchar)) as file from orders where o_orderpriority like '1%') e using (file) left join (select distinct concat('f', cast(s_suppkey % 50 as varchar)) as file from supplier where s_acctbal < 0) i using (file)"
)


def _verified(spark, sf_dir):
    defined = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.expr("concat('f', cast(o_orderkey % 50 as string))").alias("file"))
    used = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.expr("concat('f', cast(s_suppkey % 50 as string))").alias("file"))
    return O.verify(table(spark, sf_dir, "v_findings"), {"nonExistentFunction": defined, "unusedImport": used}, ["file"])


@query("select event_id, status from v", ("v", _VERIFIED))
def verify_findings(spark, sf_dir):
    return _verified(spark, sf_dir).select("event_id", "status")


@query("select status, count(*) as n from v group by 1", ("v", _VERIFIED))
def verification_stats(spark, sf_dir):
    return O.verification_stats(_verified(spark, sf_dir))


@query("select event_id from v where status = 'confirmed' or (status = 'uncertain' and confidence >= 60)", ("v", _VERIFIED))
def kept_findings(spark, sf_dir):
    return O.kept_findings(_verified(spark, sf_dir), 60).select("event_id")


@query(
    "select event_id, b.rule_id, b.fix from v_findings f left join (select type, arg_min(p_partkey, (p_size, p_partkey)) as rule_id, arg_min(p_name, (p_size, p_partkey)) as fix from (select case p_partkey % 4 when 0 then 'unusedImport' when 1 then 'unusedExport' when 2 then 'orphanedFile' else 'other' end as type, * from part) group by 1) b using (type)"
)
def enrich_with_rules(spark, sf_dir):
    type_ = F.expr("case p_partkey % 4 when 0 then 'unusedImport' when 1 then 'unusedExport' when 2 then 'orphanedFile' else 'other' end")
    rules = table(spark, sf_dir, "part").select(type_.alias("type"), F.struct("p_size", "p_partkey").alias("ord"), F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("fix"))
    return O.enrich_with_rules(table(spark, sf_dir, "v_findings"), rules).select("event_id", "rule_id", "fix")


@query("select cast(toxic as varchar) || cast(quality as varchar) as type, count(*) as expected, count(d.doc_id) as found from labels l left join (select doc_id from documents where regexp_matches(text, 'scum|trash|stupid|disgusting|worthless|idiot')) d using (doc_id) group by 1")
def recall_by_injected_issue(spark, sf_dir):
    found = table(spark, sf_dir, "documents").where(F.col("text").rlike("scum|trash|stupid|disgusting|worthless|idiot"))
    expected = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.col("toxic").cast("string"), F.col("quality").cast("string")).alias("type"))
    return O.recall_by_type(expected, found, ["doc_id"])


@query("select event_id, cast(case type when 'nonExistentFunction' then case when event_id % 5 = 0 then 90 when event_id % 3 = 0 then 95 when event_id % 3 = 1 then 92 else 85 end when 'dependencyHallucination' then 95 when 'wrongParamCount' then 88 when 'unusedImport' then 98 else 75 end as int) as confidence from v_findings")
def confidence_table(spark, sf_dir):
    f = table(spark, sf_dir, "v_findings")
    return f.select("event_id", O.confidence_of(F.col("type"), F.col("event_id") % 5 == 0, F.col("event_id") % 3).alias("confidence"))


@query(
    "select p_partkey as id, case when p_brand = p_name then 1.0 when a like '%' || b || '%' or b like '%' || a || '%' then 0.8 else greatest(cp / least(length(a), length(b)) * 0.7 + cp / greatest(length(a), length(b)) * 0.3, 1 - levenshtein(a, b) / greatest(length(a), length(b))) end as similarity, cast(cp as int) as prefix "
    "from (select *, coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i]), true) - 1, least(length(a), length(b))) as cp from (select *, lower(p_type) as a, lower(p_name) as b from part))",
    doubles=("similarity",),
)
def segment_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a, b = F.col("p_type"), F.col("p_name")
    return p.select(F.col("p_partkey").alias("id"), S.segment_similarity(a, b).alias("similarity"), S.common_prefix(F.lower(a), F.lower(b)).alias("prefix"))


@query("select doc_id, coalesce(string_split(text, chr(10))[3], '') as third, coalesce(string_split(text, chr(10))[1], '') as first from documents")
def line_of_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.line_of(F.col("text"), F.lit(3)).alias("third"), S.line_of(F.col("text"), F.lit(1)).alias("first"))


@query("select o_orderkey as id, (epoch_us(timestamp '2024-02-01') - epoch_us(o_orderdate)) / 86400000000 as days from orders", doubles=("days",))
def days_since(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.days_between(F.expr("timestamp'2024-02-01'"), F.col("o_orderdate")).alias("days"))


@query("select page_id, regexp_extract(url, '^(.*)/', 1) as parent, list_last(string_split(url, '/')) as name, lower(regexp_extract(list_last(string_split(url, '/')), '^.+(\\.[^.]+)$', 1)) as extension from pages")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.parent_directory(url).alias("parent"), S.file_name(url).alias("name"), S.extension(url).alias("extension"))


@query("select event_id, concat('{\"file\":\"', file, '\",\"severity\":\"', severity, '\",\"confidence\":', confidence, '}') as json from v_findings")
def render_json(spark, sf_dir):
    return table(spark, sf_dir, "v_findings").select("event_id", S.as_json("file", "severity", "confidence").alias("json"))
