"""Snapshots, changes, carry-over. ``keys`` names the columns that tell projects apart; where a key or columns are given, they go there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = tuple[str, ...]


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """``key`` and ``change_type``: added, removed, modified; nulls compare as values."""
    old = before.select(*key, F.struct(*compared).alias("old"), F.lit(True).alias("in_old"))
    new = after.select(*key, F.struct(*compared).alias("new"), F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return old.join(new, key, "full").select(*key, kind.alias("change_type")).where("change_type is not null")


def edge_changes(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one snapshot only, with ``change_type``."""
    old, new = before.select(*columns).distinct(), after.select(*columns).distinct()
    added = new.exceptAll(old).withColumn("change_type", F.lit("added"))
    return added.unionByName(old.exceptAll(new).withColumn("change_type", F.lit("removed")))


def diff_risk(references: DataFrame, changes: DataFrame, catalog: DataFrame, fake: str = "(?i)^(foo|fake|dummy|todo)", keys: Keys = ()) -> DataFrame:
    """``(risk, n)`` of new references ``(name)``: to nothing (critical), to something removed (high), to names that look made up (high), and more than three times as many as new symbols (medium)."""
    own = [*keys, "name"]
    counts = [
        ("brokenReference", "critical", references.join(catalog.select(*own).distinct(), own, "left_anti")),
        ("removedReference", "high", references.join(changes.where("change_type = 'removed'").select(*own).distinct(), own, "left_semi")),
        ("fakeName", "high", references.where(F.col("name").rlike(fake))),
    ]
    parts = [df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.lit(r).alias("risk"), F.lit(s).alias("severity"), "n") for r, s, df in counts]
    marked = references.select(*keys, F.lit(1).alias("r"), F.lit(0).alias("a")).unionByName(changes.where("change_type = 'added'").select(*keys, F.lit(0).alias("r"), F.lit(1).alias("a")))
    many = marked.groupBy(*keys).agg(F.sum("r").alias("refs"), F.sum("a").alias("added"))
    parts.append(many.where("refs > 3 * added").select(*keys, F.lit("manyReferences").alias("risk"), F.lit("medium").alias("severity"), F.col("refs").alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0")


def changed_files(old: DataFrame, new: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, change_type)`` by a fingerprint of the content."""
    print_ = F.sha2(F.col("content").cast("binary"), 256).alias("fingerprint")
    own = [*keys, "file"]
    return snapshot_diff(old.select(*own, print_), new.select(*own, print_), own, ["fingerprint"])


def merge_changed(base: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "file", keys: Keys = ()) -> DataFrame:
    """``base`` with all rows of changed files replaced, and those of removed files gone."""
    own = [*keys, key]
    gone = changed.select(*own) if removed is None else changed.select(*own).unionByName(removed.select(*own))
    return base.join(gone.distinct(), own, "left_anti").unionByName(changed)


def line_diff(versions: DataFrame, keys: Keys = ()) -> DataFrame:
    """``(file, side, line, text)``: lines of one side only, by text and how often it has come before. ``versions(file, side, text)``, side old or new."""
    own = [*keys, "file"]
    lines = versions.select(*own, "side", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    nth = F.row_number().over(Window.partitionBy(*own, "side", "text").orderBy("pos"))
    marked = lines.withColumn("nth", nth).withColumn("h", F.xxhash64("text"))
    met = [*own, "h", "nth"]
    old, new = marked.where("side = 'old'"), marked.where("side = 'new'")
    out = old.join(new.select(*met), met, "left_anti").unionByName(new.join(old.select(*met), met, "left_anti"))
    return out.select(*own, "side", (F.col("pos") + 1).alias("line"), "text")


def line_runs(versions: DataFrame, look_ahead: int = 10, keys: Keys = ()) -> DataFrame:
    """``(file, change_type, start, end)``: runs of added, deleted and modified lines between a file's old and new version.

    Both versions are walked together. Where they differ, the old line is looked for in the next ``look_ahead - 1`` new
    lines and the new line among as many old ones. Found on both sides, the place with the smaller line number decides:
    on the old side it is a deletion up to there, else an addition; found on the new side alone it is an addition; on
    the old side alone, or not at all, one line is modified. What is left at the end is one addition or deletion.
    Additions are numbered on the new side, deletions and modifications on the old, from 1, both ends included. A file
    with one version only is all added or all deleted; null texts count as missing. A row is the two versions of one
    file.
    """

    def walk(before: str | None, after: str | None) -> list[dict]:
        old, new = (x.split("\n") if x is not None else [] for x in (before, after))
        found = lambda lines, at, line: next((n for n in range(at + 1, min(at + look_ahead, len(lines))) if lines[n] == line), None)
        i = j = 0
        out = []
        while i < len(old) and j < len(new):
            if old[i] == new[j]:
                i, j = i + 1, j + 1
                continue
            in_old, in_new = found(old, i, new[j]), found(new, j, old[i])
            if in_new is None:
                out.append(("modification", i + 1, i + 1))
                i, j = i + 1, j + 1
            elif in_old is not None and in_old < in_new:
                out.append(("deletion", i + 1, in_old))
                i = in_old
            else:
                out.append(("addition", j + 1, in_new))
                j = in_new
        if i < len(old):
            out.append(("deletion", i + 1, len(old)))
        if j < len(new):
            out.append(("addition", j + 1, len(new)))
        return [dict(zip(("change_type", "start", "end"), m, strict=True)) for m in out]

    @F.pandas_udf("array<struct<change_type:string,start:bigint,end:bigint>>")
    def runs(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([walk(a, b) for a, b in zip(old, new, strict=True)], dtype="object")

    own = [*keys, "file"]
    side = lambda name: F.last(F.when(F.col("side") == name, F.col("text")), ignorenulls=True).alias(name)
    # Equal versions have no runs and need no walk.
    both = versions.groupBy(*own).agg(side("old"), side("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*own, F.explode(runs("old", "new")).alias("m")).select(*own, "m.*")


def carry_over(findings: DataFrame, changes: DataFrame, n_lines: DataFrame, most: float = 0.3, keys: Keys = ()) -> DataFrame:
    """Findings ``(file, line)`` on lines that did not change ``(file, start, end)``, of files of which at most ``most`` of the lines changed."""
    own = [*keys, "file"]
    share = changes.groupBy(*own).agg(F.sum(F.col("end") - F.col("start") + 1).alias("changed")).join(n_lines, own)
    redo = share.where(F.col("changed") > most * F.col("n_lines")).select(*own)
    kept = findings.join(redo, own, "left_anti")
    c = changes.select(*(F.col(x).alias(f"__{x}") for x in own), "start", "end")
    same = [F.col(x) == F.col(f"__{x}") for x in own]
    return kept.join(c, [*same, F.col("line").between(F.col("start"), F.col("end"))], "left_anti")
