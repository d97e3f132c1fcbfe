"""Queries over texts, sources and streams. Code-shaped extractors run over the text and html tables, where the same rules find links, calls and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import extract as X
from loomspan.plans.registry import query
from loomspan.plans.views import table
from loomspan.sources import files as R
from loomspan.streaming import edits as T

def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit("js").alias("language"), F.col("text").alias("content"))


@query("select source, cast(sum(octet_length(encode(coalesce(text, ''))) + 1) as bigint) as size, cast(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) as bigint) as n_lines from documents where source not in ('src1', 'src2') group by 1")
def scan_documents(spark, sf_dir):
    """The documents as text files in a folder for each source, scanned without two of the folders."""
    from loomspan.operators.tables import new_path

    path = new_path(spark, "files")
    table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").text(path)
    found = R.scan_files(spark, path, [".txt"], ["source=src1", "source=src2"])
    lines = F.char_length("content") - F.char_length(F.replace("content", F.lit("\n"), F.lit("")))
    return found.groupBy(F.regexp_extract("file", "/source=([^/]*)/", 1).alias("source")).agg(F.sum("size").alias("size"), F.sum(lines.cast("long")).alias("n_lines"))


@query("select commit_id, author, ts, file from v_commit_files where commit_id in (select commit_id from (select distinct commit_id, ts from v_commit_files) order by ts desc, commit_id desc limit 50)")
def read_commits(spark, sf_dir):
    return R.read_commits(table(spark, sf_dir, "v_commit_files"))


@query("select user_id as run_id, count(*) as n, min(event_id) as first from events where ts >= timestamp '2024-01-29' group by 1")
def findings_round_trip(spark, sf_dir):
    """Every user's findings are written as a run, and those of the last day are read again."""
    from loomspan.operators.tables import new_path

    path = new_path(spark, "findings")
    R.write_findings(table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id")), path)
    stored = R.read_findings(spark, path, since="2024-01-29")
    return stored.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("select p_partkey as id, p_name in (select p_name from part where p_size = 3) as known, regexp_matches(p_name, '^[a-c][a-z]* ') as suspicious from part")
def registry_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("package"), "p_size")
    return R.registry_lookup(part.drop("p_size"), part.where("p_size = 3"), fake="^[a-c][a-z]*-").select("id", "known", "suspicious")


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages")
def page_links(spark, sf_dir):
    return X.hrefs(table(spark, sf_dir, "pages"), "page_id", "html")


# Prose rules that stand in for a rule table.
_RULES = [("license", "(?i)license"), ("rights", "All rights reserved"), ("email", "@[a-z0-9]+\\."), ("shout", "[A-Z]{4,}!!"), ("pipes", " \\| .* \\| ")]


@query(
    "select file, cast(line as int) as line, unnest(list_filter([" + ", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in _RULES) + "], lambda x: x is not null)) as rule from "
    "(select doc_id as file, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)"
)
def scan_rules(spark, sf_dir):
    return X.scan_rules(_docs(spark, sf_dir), _RULES)


_CALLED = r"(?:\\bnew\\s+|\\bfunction\\s+|\\bdef\\s+|\\bclass\\s+)?(?:[A-Za-z_$][A-Za-z0-9_$]*\\.)*[A-Za-z_$][A-Za-z0-9_$]*\\s*\\(".replace("\\\\", "\\")


@query(
    "select file, cast(line as int) as line, usage_type, count(*) as n from (select file, line, case when regexp_matches(x, '^new\\s') then 'instantiation' when contains(target, '.') then 'methodCall' else 'call' end as usage_type, regexp_extract(target, '[^.]*$') as name from (select *, regexp_replace(regexp_replace(x, '^new\\s+', ''), '\\s*\\($', '') as target "
    "from (select doc_id as file, line, unnest(regexp_extract_all(t, '" + _CALLED + "')) as x from (select *, unnest(string_split(replace(replace(text, ', ', '('), '. ', '('), chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents) where not regexp_matches(t, '^\\s*(//|#|\\*|/\\*)')) "
    "where not regexp_matches(x, '^(function|def|class)\\s'))) where name not in (" + ", ".join(f"'{k}'" for k in X.KEYWORDS) + ") group by all"
)
def extract_usages(spark, sf_dir):
    """All kinds of usages, of prose in which every comma and full stop opens a call."""
    docs = table(spark, sf_dir, "documents")
    prose = docs.select(F.col("doc_id").alias("file"), F.lit("js").alias("language"), F.expr("replace(replace(text, ', ', '('), '. ', '(')").alias("content"))
    return X.extract_usages(prose).groupBy("file", "line", "usage_type").agg(F.count("*").alias("n"))


# Streams: the stream runs over all events that there are and is held against SQL over the same table.

def _edit_stream(spark, sf_dir, max_files=None):
    """In one batch unless ``max_files`` is given: files need not be in the order of time, and late events would go."""
    from loomspan.plans.views import VIEWS

    T.events_stream(spark, sf_dir, max_files).createOrReplaceTempView("events")
    return spark.sql(VIEWS["v_edits"])


def _finding_stream(spark, sf_dir):
    from loomspan.plans.views import VIEWS

    T.events_stream(spark, sf_dir).createOrReplaceTempView("events")
    return spark.sql(VIEWS["v_findings"])


_BURSTS = (
    "select path, min(ts) as first, max(ts) as last, arg_max(event_id, (ts, event_id)) as event_id, arg_max(change_type, (ts, event_id)) as change_type, count(*) as n from (select *, sum(fresh) over (partition by path order by ts, event_id) as burst from "
    "(select *, case when ts - lag(ts) over (partition by path order by ts, event_id) <= interval 2 hour then 0 else 1 end as fresh from v_edits)) group by path, burst"
)


@query("select path, event_id, change_type, n from (" + _BURSTS + ") where last + interval 2 hour <= (select max(ts) from v_edits) - interval 1 minute")
def debounce(spark, sf_dir):
    """Bursts that the last watermark has passed."""
    return T.run_once(T.debounce(_edit_stream(spark, sf_dir), "2 hours").drop("start", "end"))


@query("select path, event_id, change_type, n from (" + _BURSTS + ")")
def debounce_batch(spark, sf_dir):
    edits = table(spark, sf_dir, "v_edits").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.debounce(edits, "2 hours").drop("start", "end")


_LANGUAGE = "case when substr(path, 4, 1) < '3' then 'ts' else 'py' end"
_WINDOWS = f"select *, regexp_extract(path, '^(.*)/', 1) as dir, {_LANGUAGE} as language, unnest(range(date_trunc('hour', ts) + interval 1 hour, date_trunc('hour', ts) + interval 7 hour, interval 1 hour)) as w from v_edits"
_MOST = "select agent, w, arg_max({0}, (n, length({0}), {0})) as {0} from (select agent, w, {0}, count(*) as n from wide group by 1, 2, 3) group by 1, 2"


@query(
    "select a.agent, a.w as window_end, a.n, d.dir as focus, l.language, a.symbols from (select agent, w, count(*) as n, list(distinct symbol order by symbol) as symbols from wide group by 1, 2) a join dirs d using (agent, w) join langs l using (agent, w) where a.w <= (select max(ts) from v_edits) - interval 10 minute",
    ("wide", _WINDOWS), ("dirs", _MOST.format("dir")), ("langs", _MOST.format("language")),
)
def recent_intent(spark, sf_dir):
    """Windows that the last watermark has passed."""
    edits = _edit_stream(spark, sf_dir).withColumn("language", F.expr(_LANGUAGE))
    counts = T.run_stateful(T.recent_intent(edits, "6 hours", "1 hour"))
    intent = T.intent_focus(counts, "6 hours", "1 hour", "10 minutes").drop("files")  # which SQL has no column for
    return intent.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


_NEWEST = "select *, regexp_extract(path, '^(.*)/', 1) as dir from (select *, row_number() over (partition by agent order by ts desc, event_id desc) as r from v_edits where ts > timestamp '2024-01-20' - interval 14400 minute and ts <= timestamp '2024-01-20') where r <= 50"


@query(
    "select agent, path, greatest(0.5, 1 - 0.1 * (row_number() over (partition by agent order by r) - 1))::double as relevance from (select agent, path, min(r) as r from newest group by 1, 2) union all select f.agent, p.path, 0.5::double from (select agent, arg_max(dir, (n, length(dir), dir)) as dir from (select agent, dir, count(*) as n from newest group by 1, 2) group by 1) f "
    "join (select distinct path, regexp_extract(path, '^(.*)/', 1) as dir from v_edits) p using (dir) where (f.agent, p.path) not in (select (agent, path) from newest)",
    ("newest", _NEWEST), doubles=("relevance",),
)
def file_relevance(spark, sf_dir):
    edits = table(spark, sf_dir, "v_edits").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.file_relevance(edits, F.expr("timestamp'2024-01-20'"), 14400, files=edits.select("path"))


@query("select distinct agent, symbol, 0.8::double as relevance from newest", ("newest", _NEWEST), doubles=("relevance",))
def symbol_relevance(spark, sf_dir):
    edits = table(spark, sf_dir, "v_edits").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.symbol_relevance(edits, F.expr("timestamp'2024-01-20'"), 14400)


@query("select path, event_id, row_number() over (partition by path order by ts, event_id) as version, change_type from v_edits")
def latest_version(spark, sf_dir):
    return T.run_stateful(T.latest_version(_edit_stream(spark, sf_dir)))


@query("select project_id, file, arg_max(event_id, event_id) as event_id, arg_max(severity, event_id) as severity from v_findings group by 1, 2 having arg_max(severity, event_id) in ('critical', 'high')")
def alert_state(spark, sf_dir):
    return T.alert_state(_finding_stream(spark, sf_dir).select("project_id", "file", "event_id", "severity"))


@query("select cast(project_id as bigint) as project_id, file, count(*) as n, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low from v_findings group by 1, 2")
def write_alerts(spark, sf_dir):
    """All findings as alerts, written and read again."""
    from loomspan.operators.tables import new_path

    path = new_path(spark, "alert-files")
    T.write_alerts(table(spark, sf_dir, "v_findings"), path)
    return T.read_alerts(spark, path)


_CHANGED = "select cast(floor(event_id / 2) as bigint) as file, max(event_id) as event_id from v_edits group by 1 having arg_max(change_type, event_id) <> 'unlink'"


@query(
    "select u.file, c.event_id, u.symbol_id, 'unresolvedReference' as type from (select distinct file, symbol_id from v_usages) u join c using (file) where u.symbol_id not in (select symbol_id from v_catalog) union all select i.file, c.event_id, i.symbol_id, 'unusedImport' from i join c using (file) where (i.file, i.symbol_id) not in (select (file, symbol_id) from v_usages) "
    "union all select s.symbol_id, c.event_id, s.symbol_id, 'unusedExport' from v_catalog s join c on c.file = s.symbol_id where s.exported and s.symbol_id not in (select symbol_id from i)",
    ("c", _CHANGED), ("i", "select distinct o_orderkey as file, o_custkey as symbol_id from orders where o_orderpriority like '1%'"),
)
def incremental_validate(spark, sf_dir):
    """Every file changes twice; modules define one symbol each; urgent orders import their customers' numbers."""
    edits = _edit_stream(spark, sf_dir, 16).select("event_id", F.floor(F.col("event_id") / 2).alias("file"), "change_type")
    catalog = table(spark, sf_dir, "v_catalog").select("symbol_id", F.col("symbol_id").alias("file"), "exported")
    imports = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("symbol_id"))
    return T.incremental_validate(edits, catalog, imports, table(spark, sf_dir, "v_usages"))


@query("select project_id, case when d = 0 then 'none' when d < t then 'partial' else 'full' end as coverage from (select project_id, count(*) filter (where s) as d, count(*) as t from (select project_id, file, bool_or(severity = 'low') as s from v_findings group by 1, 2) group by 1)")
def scan_status(spark, sf_dir):
    return T.scan_status(table(spark, sf_dir, "v_findings").withColumn("scanned", F.col("severity") == "low"))


@query(
    "select 'f' as kind, path as a, '' as b from (select distinct path from v_edits) where path not in (select path from g) union all select 'e', src, dst from (select distinct path as src, lead(path) over (order by event_id) as dst from v_edits) where dst is not null and src not in (select path from g) and dst not in (select path from g)",
    ("g", "select path from v_edits group by 1 having arg_max(change_type, (ts, event_id)) = 'unlink'"),
)
def unlink_cascade(spark, sf_dir):
    edits = table(spark, sf_dir, "v_edits")
    edges = edits.select(F.col("path").alias("src"), (F.col("event_id") + 1).alias("e")).join(edits.select(F.col("path").alias("dst"), F.col("event_id").alias("e")), "e").select("src", "dst").distinct()
    files, kept = T.unlink_cascade(edits.select("path").distinct(), edges, edits)
    return files.select(F.lit("f").alias("kind"), F.col("path").alias("a"), F.lit("").alias("b")).unionByName(kept.select(F.lit("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query("select project_id, case when count(distinct file) < 55 then 'learning' else 'strict' end as mode from v_findings group by 1")
def mode_switch(spark, sf_dir):
    return T.mode_switch(table(spark, sf_dir, "v_findings"), 55)


@query("select user_id as agent, max(ts) as last from events group by 1 having max(ts) >= timestamp '2024-01-30' - interval 600 minute order by 2 desc, 1 limit 10")
def snapshot_expiry(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), "ts")
    return T.snapshot_expiry(events, F.expr("timestamp_ntz'2024-01-30'"), 600)


@query(
    "select agent, first, last, n from (select agent, min(ts) as first, max(ts) as last, count(*) as n from (select *, sum(fresh) over (partition by agent order by ts, event_id) as s from (select user_id as agent, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 600 minute then 0 else 1 end as fresh from events)) group by agent, s) "
    "where last + interval 600 minute <= (select max(ts) from events) - interval 1 minute"
)
def session_expiry(spark, sf_dir):
    """Sessions that the last watermark has passed."""
    events = T.events_stream(spark, sf_dir, None).select(F.col("user_id").alias("agent"), "ts")
    return T.run_once(T.session_expiry(events, 600)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})
