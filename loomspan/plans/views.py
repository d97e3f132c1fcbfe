"""Adapter views that give the star schema the shape of the engine's tables. The same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_catalog": "select p_partkey as symbol_id, p_name as name, p_brand as file, p_type as kind, p_size % 2 = 0 as exported, p_size % 3 as param_min, p_size % 5 + 2 as param_max from part where p_partkey % 10 <> 0",
    "v_usages": "select l_orderkey as file, l_linenumber as line, l_partkey as symbol_id, l_suppkey as caller, case l_returnflag when 'A' then 'call' when 'N' then 'reference' else 'methodCall' end as usage_type, cast(l_quantity as int) % 8 as arg_count from lineitem",
    "v_imports": "select distinct l_orderkey as file, l_partkey as symbol_id from lineitem where l_linestatus = 'O' and l_orderkey % 40 = 0",
    "v_commit_files": "select distinct o_orderkey as commit_id, o_custkey as author, o_orderdate as ts, l_partkey as file from orders join lineitem on o_orderkey = l_orderkey",
    "v_edges": "select distinct o_custkey as src, o_orderkey % (select count(*) from customer) as dst from orders where o_orderstatus = 'F' and o_orderkey % 3 = 0 and o_custkey <> o_orderkey % (select count(*) from customer)",
    "v_edits": "select event_id, user_id as agent, ts, case event_type when 'signup' then 'add' when 'error' then 'unlink' else 'change' end as change_type, concat('dir', cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) % 7 as varchar(9)), '/f', regexp_extract(props, '([0-9]+)', 1)) as path, event_type as symbol from events",
    "v_findings": "select event_id, user_id as project_id, concat('f', regexp_extract(props, '([0-9]+)', 1)) as file, case event_type when 'error' then 'critical' when 'purchase' then 'high' when 'click' then 'medium' when 'view' then 'low' else 'warning' end as severity, case event_id % 6 when 0 then 'nonExistentFunction' when 1 then 'unusedImport' when 2 then 'dependencyHallucination' when 3 then 'wrongParamCount' when 4 then 'unusedExport' else 'orphanedFile' end as type, cast(50 + event_id % 50 as int) as confidence from events",
    "v_paths": "select page_id, case page_id % 5 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' when 3 then 'PATCH' else 'DELETE' end as method, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') as path from pages",
    "v_routes": "select distinct method, regexp_replace(path, '[0-9]+', '{id}') as path from v_paths where page_id % 3 = 0",
    "v_services": "select page_id, method, path from v_paths where page_id % 3 <> 0",
    "v_fields": "select p_brand as owner, p_partkey % 2 as side, replace(p_name, ' ', '_') as field, min(p_type) as ftype, max(case when p_size % 2 = 0 then 1 else 0 end) as required from part where p_partkey % 7 < 4 group by 1, 2, 3",
    "v_before": "select p_partkey as id, p_name as name, p_size as sig from part where p_partkey % 11 <> 0",
    "v_after": "select p_partkey as id, p_name as name, case when p_partkey % 17 = 0 then p_size + 1 else p_size end as sig from part where p_partkey % 13 <> 0",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needs(sql: str) -> list[str]:
    """The tables and views that a statement names."""
    return [n for n in (*VIEWS, *TABLES) if re.search(rf"\b{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or an adapter view, under ``sf_dir``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for other in _needs(VIEWS[name]):
        table(spark, sf_dir, other).createOrReplaceTempView(other)
    return spark.sql(VIEWS[name])


def oracle(body: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """``body`` with the views it names, and ``extra`` (name, sql) pairs, in front."""
    found: dict[str, str] = {}

    def add(sql: str) -> None:
        for name in _needs(sql):
            if name in VIEWS and name not in found:
                add(VIEWS[name])
                found[name] = VIEWS[name]

    for sql in (*(s for _, s in extra), body):
        add(sql)
    parts = [f"{n} as ({s})" for n, s in (*found.items(), *extra)]
    return (f"with {'recursive ' * recursive}{', '.join(parts)} " if parts else "") + body
