"""Findings: filters, scores, verdicts, reports, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.tables import numbered

# Points that an issue of each severity costs, and confidence by type of finding.
WEIGHTS = {"critical": 25, "high": 15, "medium": 8, "low": 3, "warning": 3}
OTHER_WEIGHT, DEAD_MEDIUM, DEAD_OTHER = 5, 5, 2
CONFIDENCE = {"dependencyHallucination": 95, "wrongParamCount": 88, "nonExistentMethod": 70, "nonExistentImport": 93, "undefinedVariable": 90, "unusedImport": 98}
DEAD_TYPES = ("unusedExport", "unusedFunction", "orphanedFile", "deadCode")
LENIENT_SCOPE = ("unusedImport", "unusedFunction", "unusedExport", "dependencyHallucination", "missingDependency")
LENIENT = (*LENIENT_SCOPE, "nonExistentMethod")
SCOPED = ("unusedImport", "nonExistentFunction", "nonExistentMethod")


def confidence_of(type_: Column, exists_in_project: Column, similar: Column) -> Column:
    """Confidence by type; for missing functions and classes by whether the name exists elsewhere and how many are similar."""
    missing = F.when(exists_in_project, 90).when(similar == 0, 95).when(similar == 1, 92).otherwise(85)
    out = F.when(type_.isin("nonExistentFunction", "nonExistentClass"), missing)
    for name, value in CONFIDENCE.items():
        out = out.when(type_ == name, value)
    return out.otherwise(75)


def filter_by_scope(findings: DataFrame, mode: str = "strict") -> DataFrame:
    """Findings worth an alert, by severity, type and the ``scope`` of their file."""
    severe = F.col("severity").isin("critical", "high")
    if mode == "lenient":
        return findings.where(severe | F.col("type").isin(*LENIENT_SCOPE))
    always = F.col("type").isin("apiContractMismatch", "unusedFunction", "unusedExport", "orphanedFile")
    return findings.where(severe | always | ~F.col("scope").isin("frontend", "backend") | F.col("type").isin(*SCOPED))


def lenient_filter(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin("critical", "high") | F.col("type").isin(*LENIENT))


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def quality_score(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``score``: 100 less the weights of the findings, at least 0."""
    dead = F.col("type").isin(*DEAD_TYPES)
    weight = F.when(dead, F.when(F.col("severity") == "medium", DEAD_MEDIUM).otherwise(DEAD_OTHER))
    for severity, points in WEIGHTS.items():
        weight = weight.when(F.col("severity") == severity, points)
    return findings.groupBy(*keys).agg(F.greatest(F.lit(0), 100 - F.sum(weight.otherwise(OTHER_WEIGHT))).cast("long").alias("score"))


def verdict(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``verdict``, ``risk``: the first rule that holds."""
    issue = ~F.col("type").isin(*DEAD_TYPES)
    counts = findings.groupBy(*keys).agg(
        _count(F.col("type") == "dependencyHallucination").alias("fake"),
        _count((F.col("type") == "architecturalDeviation") & F.coalesce(F.lower("message").contains("impact"), F.lit(False))).alias("impact") if "message" in findings.columns else F.lit(0).alias("impact"),
        _count(issue & (F.col("severity") == "critical")).alias("critical"),
        _count(issue & (F.col("severity") == "high")).alias("high"),
        _count(issue).alias("issues"),
        _count(~issue).alias("dead"),
    )
    rules = [("fake > 0", "REJECT", "critical"), ("impact > 0", "CAUTION", "high"), ("critical > 0", "REJECT", "critical"), ("high > 2", "REVIEW", "high"), ("issues > 0", "CAUTION", "medium"), ("dead > 0", "CLEAN_UP", "low")]

    def first(index: int, default: str) -> Column:
        out = None
        for rule in rules:
            out = F.when(F.expr(rule[0]), rule[index]) if out is None else out.when(F.expr(rule[0]), rule[index])
        return out.otherwise(default)

    return counts.select(*keys, first(1, "ACCEPT").alias("verdict"), first(2, "low").alias("risk"))


def breakdown(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``dimension``, ``value``, ``n``: counts by severity (unknown: low), type and file in one pass."""
    known = F.when(F.col("severity").isin("critical", "high", "medium", "low"), F.col("severity")).otherwise("low")
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("severity", known), ("type", F.coalesce("type", F.lit("unknown"))), ("file", F.coalesce("file", F.lit("unknown"))))))
    return findings.select(*keys, F.explode(each).alias("x")).groupBy(*keys, "x.dimension", "x.value").agg(F.count("*").alias("n"))


def confidence_bands(findings: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col("confidence")
    return findings.groupBy(*keys).agg(_count(c >= 85).alias("critical"), _count(c.between(70, 84)).alias("high"), _count(c.between(50, 69)).alias("medium"))


def top_files(findings: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``keys``, ``file``, ``n``, ``rank``: the k files with most findings of each key, ties by name."""
    counts = findings.groupBy(*keys, "file").agg(F.count("*").alias("n"))
    if not keys:
        return counts.orderBy(F.desc("n"), "file").limit(k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "file"))
    return counts.withColumn("rank", rank).where(f"rank <= {k}")


def report_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, severities, categories and the five files with most findings, per key."""
    dead = F.col("type").isin(*DEAD_TYPES)
    totals = findings.groupBy(*keys).agg(
        F.count("*").alias("total"), _count(~dead).alias("issues"), _count(dead).alias("dead_code"),
        *(_count(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
    )
    files = top_files(findings, keys, 5).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]), ",").alias("top_files"))
    return totals.join(files, keys)


def page(findings: DataFrame, order: list[str], limit: int = 25, offset: int = 0, severity: str | None = None, type_: str | None = None, file_part: str | None = None) -> DataFrame:
    """One page of the filtered findings in a unique order."""
    return _filtered(findings, severity, type_, file_part).orderBy(*order).offset(offset).limit(limit)


def _filtered(findings: DataFrame, severity: str | None = None, type_: str | None = None, file_part: str | None = None) -> DataFrame:
    for column, value in (("severity", severity), ("type", type_)):
        findings = findings.where(F.col(column) == value) if value is not None else findings
    return findings.where(F.col("file").contains(file_part)) if file_part is not None else findings


def page_with_total(findings: DataFrame, order: list[str], limit: int = 25, offset: int = 0, **filters: str | None) -> DataFrame:
    """One page of the filtered findings, as ``page`` gives it, with ``total``, how many pass the filters, and ``has_more``, whether any comes after the page."""
    total = _filtered(findings, **filters).agg(F.count("*").alias("total"))
    return page(findings, order, limit, offset, **filters).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # total is one row


def chunks(findings: DataFrame, run: str, order: list[str], size: int = 25) -> DataFrame:
    """Findings with the number of the chunk of ``size`` that they fall in, per run. A large run is spread over tasks."""
    return numbered(findings, [run], order, "chunk").withColumn("chunk", F.floor(F.col("chunk") / size))


def list_reports(findings: DataFrame, run: str, when: str) -> DataFrame:
    """Runs, newest first, with their totals."""
    return findings.groupBy(run).agg(F.max(when).alias("last"), F.count("*").alias("total")).orderBy(F.desc("last"), run)


def dedupe(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return findings.withColumn("__first", first).where("__first = 1").drop("__first")


def combine(**tables: DataFrame) -> DataFrame:
    """The union of tables, each row with its table's name as ``category``."""
    parts = [df.withColumn("category", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def pending_alerts(alerts: DataFrame, keys: list[str]) -> DataFrame:
    return alerts.groupBy(*keys).agg(F.count("*").alias("n"))


def verify(findings: DataFrame, refuted: dict[str, DataFrame], on: list[str], sure: int = 85) -> DataFrame:
    """Findings with ``status``: false_positive where the table of evidence for their type has their key, confirmed from ``sure`` on, else uncertain."""
    evidence = None
    for type_, df in refuted.items():
        part = df.select(*on).distinct().withColumn("type", F.lit(type_))
        evidence = part if evidence is None else evidence.unionByName(part)
    joined = findings.join(evidence.withColumn("__refuted", F.lit(True)), [*on, "type"], "left") if evidence is not None else findings.withColumn("__refuted", F.lit(None))
    status = F.when(F.col("__refuted"), "false_positive").when(F.col("confidence") >= sure, "confirmed").otherwise("uncertain")
    return joined.withColumn("status", status).drop("__refuted")


# How a finding of a type is confirmed, how surely, and how surely if its file has changes that are not committed.
CONFIRMED = {
    "nonExistentFunction": ("static_analysis", 95, 90), "nonExistentClass": ("static_analysis", 95, 90), "undefinedVariable": ("static_analysis", 95, 90), "nonExistentImport": ("module_resolution", 98, 98),
    "dependencyHallucination": ("registry_check", 99, 99), "missingDependency": ("manifest_check", 70, 70), "wrongParamCount": ("signature_analysis", 92, 92), "unusedImport": ("usage_analysis", 95, 95),
}
# How surely each kind of evidence refutes a finding, in the order in which they are asked.
REFUTED = {"local_scope": 95, "cross_reference": 90, "future_feature_detection": 85, "module_resolution": 80, "registry_check": 85, "subdirectory_manifest_check": 98, "signature_analysis": 88, "dependency_graph": 98, "usage_analysis": 90, "symbol_lookup": 90}


def verify_with_methods(findings: DataFrame, evidence: DataFrame, on: list[str], changed: DataFrame | None = None) -> DataFrame:
    """Findings with ``status``, ``method`` and ``adjusted``, the confidence after verification.

    ``evidence(type, *on, method)`` refutes: the finding is a false positive by the first method in the order of
    ``REFUTED``. Else a type that can be confirmed is, by its own method; findings in files of ``changed(file)`` a little
    less surely where the code may be of a planned feature. Other types stay uncertain with the confidence they had.
    """
    order = {m: i for i, m in enumerate(REFUTED)}
    lookup = lambda table, c: F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v)))[F.col(c)]
    best = evidence.where(F.col("method").isin(*REFUTED)).groupBy("type", *on).agg(F.min_by("method", lookup(order, "method")).alias("__by"))
    out = findings.join(best, ["type", *on], "left")
    if changed is not None:
        out = out.join(changed.select("file").distinct().withColumn("__changed", F.lit(True)), "file", "left")
    else:
        out = out.withColumn("__changed", F.lit(None).cast("boolean"))
    no, known = F.col("__by").isNotNull(), F.col("type").isin(*CONFIRMED)
    column = lambda i: lookup({k: v[i] for k, v in CONFIRMED.items()}, "type")
    return out.select(
        *findings.columns, F.when(no, "false_positive").when(known, "confirmed").otherwise("uncertain").alias("status"), F.when(no, F.col("__by")).when(known, column(0)).otherwise("none").alias("method"),
        F.when(no, lookup(REFUTED, "__by")).when(known & F.col("__changed"), column(2)).when(known, column(1)).otherwise(F.col("confidence")).cast("int").alias("adjusted"),
    )


def verification_stats(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count("*").alias("n"))


def kept_findings(verified: DataFrame, sure: int = 85) -> DataFrame:
    return verified.where((F.col("status") == "confirmed") | ((F.col("status") == "uncertain") & (F.col("confidence") >= sure)))


def enrich_with_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Each finding with the first rule of its type's category: ``rules(type, ord, rule_id, fix)``. Rules are a small dimension; Spark broadcasts them by size."""
    best = rules.groupBy("type").agg(F.min_by(F.struct("rule_id", "fix"), "ord").alias("rule"))
    return findings.join(best, "type", "left").select(*findings.columns, "rule.rule_id", "rule.fix")


def recall_by_type(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per injected type: how many there are and how many a run found."""
    hit = found.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return expected.join(hit, keys, "left").groupBy("type").agg(F.count("*").alias("expected"), F.count("__hit").alias("found"))
