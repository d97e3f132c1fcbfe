"""Queries over graphs, rankings and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import diff as D
from loomspan.operators import graph as G
from loomspan.operators import rank as K
from loomspan.operators import usage as U
from loomspan.plans.registry import query
from loomspan.plans.views import table

_REACH = "select distinct o_custkey as seed, o_custkey as node, 0 as depth from orders where o_orderkey % 900 = 0 union select r.seed, e.{to}, r.depth + 1 from {name} r join v_edges e on e.{of} = r.node where r.depth < {most}"
_OUT = _REACH.format(to="dst", of="src", name="outward", most=3)
_IN = _REACH.format(to="src", of="dst", name="inward", most=3)


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 900 = 0").select(F.col("o_custkey").alias("seed")).distinct()


@query("select seed, node, cast(min(depth) as int) as depth, 'imports' as direction from outward group by 1, 2 union all select seed, node, cast(min(depth) as int), 'importedBy' from inward group by 1, 2", ("outward", _OUT), ("inward", _IN), recursive=True)
def neighbourhood(spark, sf_dir):
    return G.neighbourhood(table(spark, sf_dir, "v_edges"), _seeds(spark, sf_dir), 3)


_BLAST = (
    "select seed, count(distinct node) filter (where depth > 0 and node <> seed) as symbols, count(distinct node) filter (where depth = 1 and node <> seed) as direct, count(distinct c_nationkey) filter (where depth > 0 and node <> seed) as files "
    "from (select seed, node, min(depth) as depth from inward group by 1, 2) join customer on c_custkey = node group by 1"
)
_SEVERITY = "case when files > 5 or symbols > 15 then 'high' when files > 1 or symbols > 3 then 'medium' else 'low' end"


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("file"))


@query(f"select *, {_SEVERITY} as severity from blast", ("inward", _IN), ("blast", _BLAST), recursive=True)
def blast_radius(spark, sf_dir):
    return G.blast_radius(table(spark, sf_dir, "v_edges"), _seeds(spark, sf_dir), _nations(spark, sf_dir), 3)


_IN2 = _REACH.format(to="src", of="dst", name="inward", most=2)


@query(f"select seed, symbols, files, cast(85 as int) as confidence from blast join customer on c_custkey = seed where {_SEVERITY} = 'high' and c_acctbal > 0", ("inward", _IN2), ("blast", _BLAST), recursive=True)
def high_impact_changes(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("exported"))
    return G.high_impact_changes(_seeds(spark, sf_dir).join(names, "seed"), table(spark, sf_dir, "v_edges"), _nations(spark, sf_dir))


@query("select dst as node, count(distinct src) as dependents, count(distinct src) / (select count(*) from (select src from v_edges union select dst from v_edges)) as centrality from v_edges group by 1 order by dependents desc, node limit 5", doubles=("centrality",))
def hubs(spark, sf_dir):
    return G.hubs(table(spark, sf_dir, "v_edges"))


@query(
    "select a.src as node, min(b.dst) as component from pairs a join pairs b on a.src = b.src and exists (select 1 from pairs p where p.src = b.dst and p.dst = a.src) where a.src = a.dst group by 1",
    ("pairs", "select src, dst from v_edges union select p.src, e.dst from pairs p join v_edges e on p.dst = e.src"), recursive=True,
)
def cycles(spark, sf_dir):
    return G.cycles(table(spark, sf_dir, "v_edges"))


@query("select distinct src as node, 'entry' as kind from v_edges where src not in (select dst from v_edges) union all select distinct dst, 'leaf' from v_edges where dst not in (select src from v_edges)")
def entry_and_leaf_nodes(spark, sf_dir):
    edges = table(spark, sf_dir, "v_edges")
    return G.entry_points(edges).withColumn("kind", F.lit("entry")).unionByName(G.leaf_nodes(edges).withColumn("kind", F.lit("leaf")))


_CO = "select x.symbol_id as a, y.symbol_id as b, count(*) as n from (select distinct file, symbol_id from v_usages) x join (select distinct file, symbol_id from v_usages) y on x.file = y.file and x.symbol_id <> y.symbol_id group by 1, 2"
_ALL_RELATED = (
    "select symbol, related, score from (select symbol, related, max(score) as score, row_number() over (partition by symbol order by max(score) desc, related) as r from (select src as symbol, dst as related, 0.9::double as score from v_edges union all select dst, src, 0.8::double from v_edges "
    "union all select a, b, least(0.7::double, n / 10) from (select *, row_number() over (partition by a order by n desc, b) as r from co) where r <= 5) group by 1, 2)"
)
_RELATED = f"{_ALL_RELATED} where r <= 10"


def _related(spark, sf_dir, k):
    co = U.co_occurrence(table(spark, sf_dir, "v_usages").select("file", "symbol_id"), 1)
    return G.related_symbols(table(spark, sf_dir, "v_edges"), co, k)


@query("select * from rel", ("co", _CO), ("rel", _RELATED), doubles=("score",))
def related_symbols(spark, sf_dir):
    return _related(spark, sf_dir, 10)


@query("select related, round(sum(score), 9) as score from rel where symbol % 3 = 0 group by 1 order by 2 desc, 1 limit 20", ("co", _CO), ("rel", _ALL_RELATED), doubles=("score",))
def relevant_symbols(spark, sf_dir):
    imported = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("symbol"))
    related = _related(spark, sf_dir, None).withColumn("score", F.col("score").cast("decimal(20,10)"))
    return G.relevant_symbols(imported, related).withColumn("score", F.col("score").cast("double"))


@query("select l_orderkey as src, l_suppkey as dst, list(distinct l_partkey order by l_partkey) as symbols from lineitem group by 1, 2")
def file_edges(spark, sf_dir):
    return G.file_edges(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("name")))


@query("select doc_id as file, n_chars from documents where doc_id in (select dst from v_edges where src % 10 = 0)")
def affected_sources(spark, sf_dir):
    affected = table(spark, sf_dir, "v_edges").where("src % 10 = 0").select(F.col("dst").alias("file"))
    return G.affected_sources(affected, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "n_chars"))


# Rankings.


_GRAMS = "list_transform(range(1, greatest(2, length({0}) - 1)), lambda i: substr({0}, i, 3))"
_LIKE = [
    ("names", "select distinct replace(p_name, ' ', '_') as name from part"), ("targets", "select distinct array_to_string(list_reverse(string_split(p_name, ' ')), '_') as target from part where p_partkey % 10 = 0"),
    ("pairs", "select target as a, name as b from targets, names where target <> name and (list_has_any(" + _GRAMS.format("target") + ", " + _GRAMS.format("name") + ") or list_has_any(string_split(target, '_'), string_split(name, '_')) or substr(target, 1, 2) = substr(name, 1, 2))"),
    # Each letter of a takes the first free one of b within reach.
    ("walk", "select a, b, 0 as i, cast([] as bigint[]) as taken, '' as l, cast(null as bigint) as j from pairs union all select a, b, i + 1, case when j2 is null then taken else list_append(taken, j2) end, case when j2 is null then l else l || substr(a, i + 1, 1) end, j2 from (select *, list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda j: b[j] = a[i + 1] and not list_contains(taken, j))[1] as j2 "
        "from (select *, greatest(0, greatest(length(a), length(b)) // 2 - 1) as reach from walk where i < length(a)))"),
    ("jaro", "select a, b, case when m = 0 then 0.0::double else (m::double / length(a) + m::double / length(b) + (m - len(list_filter(range(1, m + 1), lambda k: l[k] <> r[k])) / 2.0::double) / m) / 3 end as jaro from (select *, length(l) as m, array_to_string(list_transform(list_sort(taken), lambda j: b[j]), '') as r from walk where i = length(a))"),
    ("prefixed", "select *, coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i]), true) - 1, least(length(a), length(b))) as p from jaro"),
    ("scored", "select a as target, b as name, 50 * (jaro + case when jaro > 0 then least(p, 4) else 0 end * 0.1::double * (1 - jaro)) + case when contains(a, b) or contains(b, a) then 30 else 0 end + case when len(list_filter(string_split(a, '_'), lambda x: len(list_filter(string_split(b, '_'), lambda y: contains(x, y) or contains(y, x))) > 0)) > 0 then 20 else 0 end + 5 * p + case when length(a) = length(b) then 10 else 0 end as score from prefixed"),
]


@query("select * from (select *, cast(row_number() over (partition by target order by score desc, name) as int) as rank from scored where score > 25) where rank <= 3", *_LIKE, recursive=True, doubles=("score",))
def suggest_similar(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    targets = part.where("p_partkey % 10 = 0").select(F.concat_ws("_", F.reverse(F.split("p_name", " "))).alias("target"))
    return K.suggest_similar(targets, part.select(F.regexp_replace("p_name", " ", "_").alias("name")))


@query("select a, b, cast(levenshtein(a, b) as int) as d from (select distinct p_name as a from part) x, (select distinct p_name as b from part) y where a <> b and levenshtein(a, b) <= 4")
def levenshtein_neighbours(spark, sf_dir):
    return K.levenshtein_neighbours(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), 4)


_HISTORY = "select file, count(distinct commit_id) as commits, case when max(ts) < timestamp '2024-02-01' then count(distinct commit_id) / ((epoch_us(timestamp '2024-02-01') - epoch_us(max(ts))) / 86400000000) else 0.0 end as frequency from v_commit_files group by 1"


def _history(spark, sf_dir):
    return U.file_history(table(spark, sf_dir, "v_commit_files"), F.expr("timestamp'2024-02-01'"))


@query("select file, frequency from h where frequency >= 0.001 order by frequency desc, file limit 20", ("h", _HISTORY), doubles=("frequency",))
def hotspots(spark, sf_dir):
    return K.hotspots(_history(spark, sf_dir), 0.001).select("file", "frequency")


@query("select file, partner, n, cast(r as int) as rank from (select *, row_number() over (partition by file order by n desc, partner) as r from (select a.file, b.file as partner, count(*) as n from v_commit_files a join v_commit_files b on a.commit_id = b.commit_id and a.file <> b.file group by 1, 2)) where r <= 5")
def related_files(spark, sf_dir):
    return K.top_k(U.co_change(table(spark, sf_dir, "v_commit_files")), ["file"], [F.desc("n"), "partner"], 5)


_RECENT = "select file, min(place) as place from v_commit_files join (select commit_id, row_number() over (order by ts desc, commit_id desc) - 1 as place from (select distinct commit_id, ts from v_commit_files order by ts desc, commit_id desc limit 10)) using (commit_id) group by 1"


@query("select file, cast(place as int) as place from recent", ("recent", _RECENT))
def recently_modified(spark, sf_dir):
    return K.recently_modified(table(spark, sf_dir, "v_commit_files"))


@query(
    "select file, round(least(1.0, coalesce(0.8 - 0.05 * place, 0) + case when hot.file is not null then 0.4 else 0 end + least(0.2, commits / 100)), 9) as score from h left join recent using (file) left join (select file from h where frequency >= 0.001 order by frequency desc, file limit 20) hot using (file)",
    ("h", _HISTORY), ("recent", _RECENT),
    doubles=("score",),
)
def lineage_score(spark, sf_dir):
    history = _history(spark, sf_dir)
    out = K.lineage_score(history, K.recently_modified(table(spark, sf_dir, "v_commit_files")), K.hotspots(history, 0.001))
    return out.withColumn("score", F.round("score", 9))


_LEGS = [
    ("h", _HISTORY), ("recent", _RECENT), ("hot", "select file, frequency from h where frequency >= 0.001 order by frequency desc, file limit 20"),
    ("lineage", "select file, place, least(1.0, coalesce(0.8 - 0.05 * place, 0) + case when hot.file is not null then 0.4 else 0 end + least(0.2, commits / 100)) as score from recent join h using (file) left join hot using (file) order by place, file limit 10"),
    ("alike", "select file, count(distinct symbol_id) as n from v_imports group by 1 order by n desc, file limit 5"),
    ("defined", "select distinct file, symbol_id as symbol from v_usages"),
    ("signals", "select symbol, least(0.4, n / 100) as score, 'popular' as reason from (select symbol_id as symbol, count(*) as n from v_usages group by 1 order by n desc, symbol limit 100) union all select distinct symbol_id, 1.0, 'imported' from v_imports "
        "union all select symbol, 0.8, 'related' from (select dst as symbol, count(*) as n from v_edges group by 1 order by n desc, symbol limit 50) union all select symbol, 0.7, 'current' from defined where file % 1000 = 7 union all select symbol, 0.9, 'recentFile' from defined where file % 500 = 0 "
        "union all select p_partkey, 0.6, 'recentSymbol' from part where p_size = 1 union all select symbol, score * 0.5, 'lineage' from defined join lineage using (file) union all select symbol, 0.35, 'hotspot' from defined join (select file from hot order by frequency desc, file limit 5) using (file) "
        "union all select symbol, 0.3, 'similar' from defined join alike using (file)"),
]


@query("select symbol, round(sum(score), 9) as score, list(distinct reason order by reason) as reasons from signals group by 1 having sum(score) >= 0.3 - 1e-9 order by 2 desc, 1 limit 200", *_LEGS, doubles=("score",))
def score_relevance(spark, sf_dir):
    """All nine signals of a symbol's relevance."""
    usages, imports, history = table(spark, sf_dir, "v_usages"), table(spark, sf_dir, "v_imports"), _history(spark, sf_dir)
    commits, hot = table(spark, sf_dir, "v_commit_files"), K.hotspots(history, 0.001)
    recent = K.recently_modified(commits)
    signals = K.relevance_signals(
        usages.select("file", F.col("symbol_id").alias("symbol")), usages.groupBy(F.col("symbol_id").alias("symbol")).agg(F.count("*").alias("usage")),
        imported=imports.select(F.col("symbol_id").alias("symbol")), related=table(spark, sf_dir, "v_edges").groupBy(F.col("dst").alias("symbol")).agg(F.count("*").alias("score")),
        current=usages.where("file % 1000 = 7"), recent_files=usages.where("file % 500 = 0"), recent_symbols=table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("symbol")),
        lineage=K.lineage_score(history, recent, hot).join(recent, "file"), hot=hot, similar=K.similar_files(imports, imports),
    )
    out = K.score_relevance(signals.withColumn("score", F.col("score").cast("decimal(20,10)")))
    return out.withColumn("score", F.col("score").cast("double"))


@query("select file, count(distinct symbol_id) as n from v_imports where symbol_id % 3 = 0 group by 1")
def similar_files(spark, sf_dir):
    imports = table(spark, sf_dir, "v_imports")
    return K.similar_files(imports, imports.where("symbol_id % 3 = 0"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 100")
def newest_first_scan(spark, sf_dir):
    return K.newest_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 100)


# Snapshots.

_DIFF = "select coalesce(b.id, a.id) as id, coalesce(b.name, a.name) as name, case when b.id is null then 'added' when a.id is null then 'removed' else 'modified' end as change_type from v_before b full join v_after a on b.id = a.id and b.name = a.name where b.id is null or a.id is null or b.sig is distinct from a.sig"


@query("select * from d", ("d", _DIFF))
def snapshot_diff(spark, sf_dir):
    return D.snapshot_diff(table(spark, sf_dir, "v_before"), table(spark, sf_dir, "v_after"), ["id", "name"], ["sig"])


@query("select id, sig, 'added' as change_type from (select id, sig from v_after except select id, sig from v_before) union all select id, sig, 'removed' from (select id, sig from v_before except select id, sig from v_after)")
def edge_changes(spark, sf_dir):
    return D.edge_changes(table(spark, sf_dir, "v_before"), table(spark, sf_dir, "v_after"), ["id", "sig"])


@query(
    "select * from (select 'brokenReference' as risk, 'critical' as severity, count(*) as n from v_usages where symbol_id not in (select id from v_after) union all select 'removedReference', 'high', count(*) from v_usages where symbol_id in (select id from d where change_type = 'removed') "
    "union all select 'manyReferences', 'medium', (select count(*) from v_usages)) where n > 0 and (risk <> 'manyReferences' or n > 3 * (select count(*) from d where change_type = 'added'))",
    ("d", _DIFF),
)
def diff_risk(spark, sf_dir):
    before, after = (table(spark, sf_dir, v) for v in ("v_before", "v_after"))
    changes = D.snapshot_diff(before, after, ["id", "name"], ["sig"]).select(F.col("id").cast("string").alias("name"), "change_type")
    references = table(spark, sf_dir, "v_usages").select(F.col("symbol_id").cast("string").alias("name"))
    return D.diff_risk(references, changes, after.select(F.col("id").cast("string").alias("name")))


_OLD = "select doc_id as file, text as content from documents where doc_id % 9 <> 0"
_NEW = "select doc_id as file, case when doc_id % 7 = 0 then text || ' x' else text end as content from documents where doc_id % 8 <> 0"


def _versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    return docs.where("file % 9 <> 0"), docs.where("file % 8 <> 0").withColumn("content", F.expr("case when file % 7 = 0 then concat(content, ' x') else content end"))


@query("select coalesce(o.file, n.file) as file, case when o.file is null then 'added' when n.file is null then 'removed' else 'modified' end as change_type from o full join n on o.file = n.file where o.file is null or n.file is null or o.content <> n.content", ("o", _OLD), ("n", _NEW))
def changed_files(spark, sf_dir):
    return D.changed_files(*_versions(spark, sf_dir))


@query("select id, name, sig from v_before where id not in (select id from v_after where id % 17 = 0) union all select id, name, sig from v_after where id % 17 = 0")
def merge_changed(spark, sf_dir):
    return D.merge_changed(table(spark, sf_dir, "v_before"), table(spark, sf_dir, "v_after").where("id % 17 = 0"), key="id")


_LINES = "select file, side, row_number() over (partition by file, side order by pos) as line, text, row_number() over (partition by file, side, text order by pos) as nth from (select file, side, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as pos from (select file, 'old' as side, content from o union all select file, 'new', content from n))"


@query("select a.file, a.side, cast(a.line as int) as line, a.text from l a where not exists (select 1 from l b where b.file = a.file and b.side <> a.side and b.text = a.text and b.nth = a.nth)", ("o", _OLD), ("n", _NEW), ("l", _LINES))
def line_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    versions = old.select("file", F.lit("old").alias("side"), F.col("content").alias("text")).unionByName(new.select("file", F.lit("new").alias("side"), F.col("content").alias("text")))
    return D.line_diff(versions)


_WALK = (
    "select file, 0::bigint as i, 0::bigint as j, null::varchar as kind, 0::bigint as s, 0::bigint as e from v union all select file, case when kind = 'deletion' then e when kind = 'addition' then i else i + 1 end, case when kind = 'deletion' then j when kind = 'addition' then e else j + 1 end, kind, s, e from (select file, i, j, kind, case when kind = 'addition' then j + 1 else i + 1 end as s, "
    "case when kind = 'addition' then case when i >= len(o) then len(n) else to_new end when kind = 'deletion' then case when j >= len(n) then len(o) else to_old end else i + 1 end as e from (select *, case when i >= len(o) then 'addition' when j >= len(n) then 'deletion' when o[i + 1] = n[j + 1] then null when to_new is null then 'modification' when to_old < to_new then 'deletion' else 'addition' end as kind "
    "from (select w.file, w.i, w.j, v.o, v.n, list_filter(range(i + 1, least(i + 10, len(o))), lambda x: o[x + 1] = n[j + 1])[1] as to_old, list_filter(range(j + 1, least(j + 10, len(n))), lambda x: n[x + 1] = o[i + 1])[1] as to_new from walk w join v using (file) where i < len(o) or j < len(n))))"
)


@query(
    "select file, kind as change_type, s as \"start\", e as \"end\" from walk where kind is not null",
    ("o1", _OLD), ("n1", _NEW), ("v", "select o1.file, string_split(o1.content, chr(10)) as o, string_split(n1.content, chr(10)) as n from o1 join n1 using (file)"), ("walk", _WALK), recursive=True,
)
def line_runs(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    both = old.join(new.select("file"), "file", "left_semi")
    versions = both.select("file", F.lit("old").alias("side"), F.col("content").alias("text")).unionByName(new.join(both.select("file"), "file", "left_semi").select("file", F.lit("new").alias("side"), F.col("content").alias("text")))
    return D.line_runs(versions)


@query(
    "select u.file, u.line, u.symbol_id, count(*) as n from v_usages u where not exists (select 1 from c where c.file = u.file and u.line between c.s and c.e) and u.file not in (select c.file from c join (select file, count(*) as n_lines from v_usages group by 1) k on k.file = c.file group by c.file having sum(c.e - c.s + 1) > 0.3 * max(n_lines)) group by all",
    ("c", "select distinct l_orderkey as file, l_linenumber as s, l_linenumber as e from lineitem where l_quantity < 5"),
)
def carry_over(spark, sf_dir):
    usages = table(spark, sf_dir, "v_usages")
    changes = table(spark, sf_dir, "lineitem").where("l_quantity < 5").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end")).distinct()
    n_lines = usages.groupBy("file").agg(F.count("*").alias("n_lines"))
    return D.carry_over(usages, changes, n_lines).groupBy("file", "line", "symbol_id").agg(F.count("*").alias("n"))
