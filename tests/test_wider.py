"""Tiles, doubling, chunked lists, similar names and segments against plain versions; changes of real files."""

import os
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import contracts as C
from loomspan.operators import graph as G
from loomspan.operators import rank as K
from loomspan.operators import tables
from loomspan.operators import usage as U
from loomspan.operators.pairs import pairs_of, tiled_join
from loomspan.streaming.folder import watch_folder


def test_pairs_in_tiles(spark):
    r = random.Random(1)
    rows = sorted({(g, r.randrange(40)) for g, n in ((1, 60), (2, 9), (3, 1)) for _ in range(n)})
    members = spark.createDataFrame(rows, "g long, item long")
    got = [tuple(x) for x in pairs_of(members, ["g"], "item", 4).collect()]
    assert sorted(got) == sorted((g, x, y) for g, x in rows for h, y in rows if g == h and x < y)
    other = members.where("item % 3 = 0").withColumnRenamed("item", "b")
    met = [tuple(x) for x in tiled_join(members, other, ["g"], "item", "b", 4).collect()]
    assert sorted(met) == sorted((g, x, y) for g, x in rows for h, y in rows if g == h and y % 3 == 0)


def test_a_large_group_is_many_tiles(spark):
    """No task of the join holds more than the pairs of two blocks."""
    members = spark.range(600).select(F.lit(1).alias("g"), F.col("id").alias("item"))
    pairs = pairs_of(members, ["g"], "item", 64)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "__p" in plan and pairs.count() == 600 * 599 // 2


def test_rare_symbols_go_before_pairs(spark):
    rows = [(f, s) for f in range(6) for s in (1, 2, 100 + f, 200 + f)]
    got = {tuple(x) for x in U.co_occurrence(spark.createDataFrame(rows, "file long, symbol_id long"), 3).collect()}
    assert got == {(1, 2, 6), (2, 1, 6)}


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    plain = tables.written
    monkeypatch.setattr(G, "written", lambda df, name: rounds.append(name) or plain(df, name))
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(300).select((F.col("id") + n).alias("src"), F.when(F.col("id") == 299, 17).otherwise(F.col("id") + n + 1).alias("dst"))
    got = G.cycles(ring.unionByName(tail)).groupBy("component").count().collect()
    assert [(r["component"], r["count"]) for r in got] == [(0, n)] and len(rounds) < 40


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 24
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.choice([18, 30, 45]))} | {(i, i + 1) for i in range(30, 36)} | {(36, 33)}
    reach = {a: {a} for a in range(40)}
    for _ in range(40):
        for a, b in edges:
            for x in reach.values():
                if a in x:
                    x.add(b)
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in range(40) if (a, a) in edges or any(b != a and a in reach[b] for b in reach[a])}
    got = {x["node"]: x["component"] for x in G.cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == want


def test_postings_of_a_frequent_key(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 1000).alias("v")).unionByName(spark.createDataFrame([("cold", 5), ("cold", 5), (None, 9), ("none", None)], "k string, v long"))
    lists = U.postings(rows, "k", "v", 64).collect()
    hot = sorted((x["chunk"], x["first"], x["n"], x["values"]) for x in lists if x["k"] == "hot")
    assert [c for c, *_ in hot] == list(range(16)) and all(n <= 64 and v[0] == f and v == sorted(v) for _, f, n, v in hot) and sum((v for *_, v in hot), []) == list(range(1000))
    assert {(x["k"], tuple(x["values"])) for x in lists if x["k"] != "hot"} == {("cold", (5,)), (None, (9,))}


def plain_jaro_winkler(a, b):
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            left.append(c)
    if not left:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True)) / 2
    jaro = (len(left) / len(a) + len(left) / len(b) + (len(left) - swaps) / len(left)) / 3
    return jaro + len(os.path.commonprefix([a[:4], b[:4]])) * 0.1 * (1 - jaro)


def test_jaro_winkler_of_many_pairs():
    r = random.Random(2)
    names = ["", "a", "ab", "ba", "getUser", "getUsers", "üser", "x" * 40] + ["".join(r.choices("abcé", k=r.randrange(1, 12))) for _ in range(60)]
    a, b = zip(*[(x, y) for x in names for y in names], strict=True)
    assert np.allclose(K.jaro_winkler_pairs(list(a), list(b)), [plain_jaro_winkler(x, y) if x and y or x == y else 0.0 for x, y in zip(a, b, strict=True)])


def test_suggestions_score_few_pairs(spark):
    r = random.Random(3)
    names = sorted({"get" + "".join(r.choices(string.ascii_lowercase, k=r.randrange(3, 9))) for _ in range(300)})
    targets = names[::30]
    frame = lambda c, xs: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    report = []
    got = {}
    for x in K.suggest_similar(frame("target", targets), frame("name", names), report=report).collect():
        got.setdefault(x["target"], []).append((x["rank"], x["name"]))
    pairs = K.similar_pairs(frame("target", targets), frame("name", names)).collect()
    score = lambda p: 50 * plain_jaro_winkler(p["target"].lower(), p["name"].lower()) + p["base"]
    for t in targets:
        best = sorted(((-score(p), p["name"]) for p in pairs if p["target"] == t and score(p) > 25))[:3]
        assert [n for _, n in sorted(got[t])] == [n for _, n in best]
    assert all(score(p) <= p["bound"] for p in pairs) and report[0].count() < len(pairs)


@pytest.mark.parametrize("distance", [1, 3])
def test_neighbours_of_short_names(spark, distance):
    r = random.Random(4)
    names = sorted({"", "a", "b", "ab", "ba", "abc", "xyz"} | {"".join(r.choices("abc", k=r.randrange(1, 9))) for _ in range(50)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, d in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
        return row[-1]

    got = {tuple(x) for x in K.levenshtein_neighbours(spark.createDataFrame([(x,) for x in names], "name string"), distance).collect()}
    assert got == {(a, b, lev(a, b)) for a in names for b in names if a != b and lev(a, b) <= distance}


def test_alike_segments_against_all_pairs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdE", k=r.randrange(1, 9)))
    xs = sorted({word() for _ in range(70)} | {"", "user", "users", "user-list"})
    ys = sorted({word() for _ in range(60)} | {x[:-1] + "z" for x in xs[:20]} | {"", "USER"})
    frame = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    x, y = frame("a", xs), frame("b", ys)
    want = {tuple(p) for p in x.crossJoin(y).where((F.col("a") == F.col("b")) | (S.segment_similarity(F.col("a"), F.col("b")) >= 0.7)).collect()}
    assert {tuple(p) for p in C._alike_segments(x, y, 0.7).collect()} == want


def test_candidates_of_random_segments_are_few(spark):
    r = random.Random(6)
    some = lambda: ["".join(r.choices(string.ascii_lowercase, k=12)) for _ in range(300)]
    frame = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    assert C.similar_candidates(frame("a", some()), frame("b", some()), 0.7).count() < 0.005 * 300 * 300


def test_long_segments_are_linear(spark):
    r = random.Random(7)
    long = "".join(r.choices(string.ascii_lowercase, k=10_000))
    frame = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = C.similar_candidates(frame("a", [long, "short"]), frame("b", [long[:5000] + "x" + long[5000:], "other", long[200:300]]), 0.7).collect()
    assert {(len(p["a"]), len(p["b"])) for p in got} >= {(10_000, 10_001), (10_000, 100)}


def test_changes_of_real_files(spark, tmp_path):
    folder, listings, out = tmp_path / "watched", tmp_path / "listings", tmp_path / "out"
    (folder / "sub").mkdir(parents=True)
    seen = []

    def run():
        stream = watch_folder(spark, str(folder), str(listings))
        query = stream.writeStream.foreachBatch(lambda batch, _: seen.extend((r["path"], r["change_type"]) for r in batch.collect())).option("checkpointLocation", str(out)).trigger(processingTime="200 milliseconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    (folder / "a.ts").write_text("1")
    (folder / "sub" / "b.ts").write_text("2")
    run()
    assert sorted(seen) == [("a.ts", "add"), ("sub/b.ts", "add")]
    (folder / "a.ts").write_text("longer")
    (folder / "sub" / "b.ts").unlink()
    (folder / "c.ts").write_text("3")
    seen.clear()
    run()  # a new stream on the same checkpoint
    assert sorted(seen) == [("a.ts", "change"), ("c.ts", "add"), ("sub/b.ts", "unlink")]
    seen.clear()
    run()
    assert seen == []


def test_dear_rows_are_spread_over_tasks(spark):
    """A small table is one split; rules and extractors take its rows in tasks of bounded size."""
    from loomspan.operators.tables import spread
    from loomspan.plans.all_queries import QUERIES
    from tests.conftest import SF

    assert spread(spark.range(25_001).coalesce(1)).rdd.getNumPartitions() == 6
    for name in ("rule_shapes", "symbol_shapes"):
        assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4
