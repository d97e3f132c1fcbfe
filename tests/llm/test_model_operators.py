"""Whitening, language-model scoring and hard negatives against plain versions; repeated and shared rows of earlier operators."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import ann, decontam, hmm, negatives, quality, whitening
from loomspan.llm.queries import QUERIES
from tests.conftest import SF

# 11


def plain_whitening(x):
    x = np.asarray(x, dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    off = (n * x - sums).astype(object)
    centred = lambda a: (n * a - sums).astype(float) / n
    c = centred(fit)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, (off**2).sum(axis=1), centred(x), values[::-1], vectors[:, ::-1]


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in table]).astype(np.float64)).astype(np.int64) + 1_000_000
    n, deviation, centred, values, vectors = plain_whitening(x)
    got = QUERIES["op11_whitening"](spark, SF).orderBy("vec_id", "component").toPandas()
    assert len(got) == 16 * len(table) and set(got.n) == {n} and (got.deviation.to_numpy().reshape(-1, 16) == deviation.astype(np.int64)[:, None]).all()
    want, own = centred @ vectors[:, :16] / np.sqrt(values[:16]), got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-9
    assert np.abs(got.explained.to_numpy()[:16] - values[:16] / values.sum()).max() < 1e-12 and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9


def test_whitening_odd_rows(spark):
    r = random.Random(2)
    base = [[r.randrange(-50, 50) for _ in range(5)] for _ in range(40)]
    rows = [(i, v, "x") for i, v in enumerate(base)] + [(i % 3, base[0], "x") for i in range(30)] + [(None, base[1], "x"), (90, None, "x"), (91, [1, None, 2, 3, 4], "x"), (92, [], "x"), (93, [7, 7], "x")]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, n string")
    got = whitening.whiten(df, components=9).toPandas()
    n, deviation, centred, values, vectors = plain_whitening([*base, [7, 7, 0, 0, 0]])
    assert n == 41 and set(got.n) == {41} and got.component.max() == 5 and len(got) == 5 * 72 and len(got[got.id.isna()]) == 5
    last = got[got.id == 93].sort_values("component")
    assert np.allclose(np.abs(last.whitened), np.abs(centred[-1] @ vectors / np.sqrt(values))) and {int(x) for x in last.deviation} == {deviation[-1]}
    flat = whitening.whiten(spark.createDataFrame([(i, [i, 2 * i, 5]) for i in range(9)], "vec_id long, vector array<long>"), components=3).toPandas().sort_values(["id", "component"])
    assert flat[flat.component > 1].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all() and flat.explained.iloc[0] == pytest.approx(1) and flat.identity_error.max() < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [3, 4]), (2, [3, 4])], "vec_id long, vector array<long>")).toPandas()
    assert len(same) == 4 and same.whitened.isna().all() and same.explained.isna().all() and same.identity_error.isna().all()
    big = whitening.whiten(spark.createDataFrame([(1, [2**50, 1]), (2, [-(2**50), 5]), (3, [7, 2**49])], "vec_id long, vector array<long>"), components=1).toPandas()
    assert {int(x) for x in big.deviation} == set(plain_whitening([[2**50, 1], [-(2**50), 5], [7, 2**49]])[1])
    assert whitening.whiten(df.where("false")).count() == 0 == whitening.whiten(df.where("vec_id = 92")).count()


# 12


def paths_probability(model, symbols):
    """The probability of a sequence as the sum over all paths of states."""
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[path[0]]
        for i, (s, o) in enumerate(zip(path, symbols, strict=True)):
            p *= model.emit[o, s] * (model.step[path[i - 1], s] if i else 1)
        total += p
    return total


def small_model(states=3, symbols=6):
    rng = np.random.default_rng(4)
    share = rng.uniform(0.5, 2, symbols)
    return hmm.Model.random(share / share.sum(), states)


def test_forward_is_the_sum_over_paths(monkeypatch):
    model, r = small_model(), random.Random(3)
    texts = [np.array([r.randrange(6) for _ in range(n)], np.uint16) for n in (1, 2, 7, 5, 7, 3)]
    want = [math.log(paths_probability(model, t)) for t in texts]
    assert np.allclose(model.likelihood(texts), want)
    monkeypatch.setattr(hmm, "STEPS", 3)  # windows hand over their vectors
    monkeypatch.setattr(hmm, "LANES", 2)
    assert np.allclose(model.likelihood(texts), want)
    long = np.array([r.randrange(6) for _ in range(5000)], np.uint16)
    a = model.start * model.emit[long[0]]
    log = 0.0
    for o in long[1:]:
        log += math.log(a.sum())
        a = (a / a.sum()) @ model.step * model.emit[o]
    assert np.allclose(model.likelihood([long]), log + math.log(a.sum()))


def test_expected_counts_are_those_of_all_paths():
    model, r = small_model(2, 4), random.Random(5)
    texts = [np.array([r.randrange(4) for _ in range(n)], np.uint16) for n in (4, 1, 6, 3)]
    got = hmm.Counts(4, 2)
    model.learn(texts, got)
    start, step, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for t in texts:
        all_ = paths_probability(model, t)
        for path in itertools.product(range(2), repeat=len(t)):
            p = model.start[path[0]]
            for i, (s, o) in enumerate(zip(path, t, strict=True)):
                p *= model.emit[o, s] * (model.step[path[i - 1], s] if i else 1)
            start[path[0]] += p / all_
            for i, (s, o) in enumerate(zip(path, t, strict=True)):
                emit[o, s] += p / all_
                if i:
                    step[path[i - 1], s] += p / all_
    assert np.allclose(got.start, start) and np.allclose(got.emit, emit) and np.allclose(got.step * model.step, step)


def test_training_never_lowers_the_likelihood():
    model, r = small_model(3, 8), random.Random(6)
    texts = [np.array([r.choice([0, 1, 2]) if i % 2 else r.choice([5, 6, 7]) for i in range(30)], np.uint16) for _ in range(20)]
    share = np.full(8, 1 / 8)
    before = -math.inf
    for _ in range(8):
        now = model.likelihood(texts).sum()
        assert now > before - 1.0  # shares and added counts may cost a little at the end
        before = now
        counts = hmm.Counts(8, 3)
        model.learn(texts, counts)
        model = model.better(counts, share)
    assert before > small_model(3, 8).likelihood(texts).sum() + 10


def plain_base(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for i, t in docs]
    counts = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens]


def test_scores_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op12_hidden_markov"](spark, SF).collect()}
    n, want = plain_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(got) == len(want)
    for i, tokens, known, base in want:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, zlib.crc32(str(i).encode()) % 10 == 0) and r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["Ab", "cd", "ef", "gh ij"]) for _ in range(12)), "x") for i in range(60)]
    rows += [(90, None, "x"), (91, "", "x"), (92, " \t\n", "x"), (93, "Unknown wörds hére", "x"), (93, "ab", "y"), (None, "ab cd", "x"), (94, "ab " * 30000, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    monkeypatch.setattr(hmm, "TABLE", 4)  # all other words are joined
    monkeypatch.setattr(hmm, "SYMBOLS", hmm.CLASSES + 3)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    got = hmm.score(docs, fold != 0, states=2).collect()
    train = [("" if i is None else i, t) for i, t, _ in rows]
    n, want = plain_base(train)
    key = lambda i, n_, k, b: (str(i), n_, k, round(b, 6))
    assert sorted(key("" if x["id"] is None else x["id"], x["n_tokens"], x["n_known"], x["base_score"]) for x in got) == sorted(key(*w) for w in want)
    assert all(x["train_tokens"] == n and math.isfinite(x["score"]) and x["score"] < 0 for x in got)
    none = hmm.score(docs, F.lit(None).cast("boolean"), states=2).collect()
    assert len(none) == len(rows) and all(x["n_known"] == 0 and not x["learned"] and math.isfinite(x["score"]) for x in none)
    assert hmm.score(docs.where("false"), fold != 0).count() == 0


def test_shares_of_rare_words_add_up(spark):
    """Known words and one unknown of each class have the probability 1 in all."""
    counts = spark.createDataFrame([(1, 0, 9), (2, 0, 1), (3, 0, 1), (4, 7, 1)], "hash long, cls int, n long")
    v = hmm.vocabulary(counts, 3)
    inner = {int(h): 10**x for h, x in zip(v.hashes, v.inner, strict=True)}
    assert inner[1] == 1 and inner[2] + inner[3] + 0.1 / v.class_total[0] == pytest.approx(1) and inner[4] + 0.1 / v.class_total[7] == pytest.approx(1) and v.share.sum() == pytest.approx(1)


# 13


def plain_negatives(rows, least=50, most=95):
    fine = sorted({(i, label, tuple(v)) for i, label, v, _ in rows if None not in (i, label, v) and None not in v})
    width = max((len(v) for _, _, v in fine), default=0)
    fine = [(i, label, [*v, *[0] * (width - len(v))]) for i, label, v in fine]
    anchors = {(i, label, tuple(v)) for i, label, v in fine if any(a for j, _, _, a in rows if j == i)}
    out = []
    for a, label, v in sorted(anchors):
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in fine if i != a)
        for s, p, _ in [x for x in scores if x[2]][:5]:
            fits = [(t, i) for t, i, same in scores if not same and least * -s <= 100 * -t <= most * -s][:3]
            out += [(a, p, rank + 1, i, -s, -t) for rank, (t, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_all_pairs(spark, monkeypatch, seed):
    """Small rows, packs and stretches, so that members are certified at many places; ties, copies, odd rows."""
    for name, value in (("ROW", 8), ("PACK", 3), ("PARTS", 2), ("STRETCHES", (0.1, 0.3, 0.6, 1.0)), ("MEMBERS", 4)):
        monkeypatch.setattr(negatives, name, value)
    r = random.Random(seed)
    centres = [[r.randrange(-40, 40) for _ in range(4)] for _ in range(6)]
    rows = [(i, r.randrange(3), [x + r.randrange(-6, 7) for x in r.choice(centres)], i % 7 == 0) for i in range(150)]
    rows += [(200 + i, i % 2, centres[0], i % 9 == 0) for i in range(30)] + [rows[3], rows[7]]
    rows += [(300, None, centres[1], True), (301, 1, None, True), (302, 1, [1, None, 2, 3], True), (303, 2, [0, 0, 0, 0], True), (304, 1, [5], True), (305, 9, centres[2], True), (306, 1, [], False)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>, anchor boolean").withColumn("rank", F.lit("clash"))
    got = sorted(tuple(x) for x in negatives.mine(df, F.col("anchor")).collect())
    assert got == plain_negatives(rows) and got


def test_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, [1, 2]), (2, 2, [3, 4])], "vec_id long, label int, vector array<long>")
    assert negatives.mine(df.where("false"), F.lit(True)).count() == 0 == negatives.mine(df, F.lit(False)).count() == negatives.mine(df, F.lit(True)).count()


# Earlier operators.


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(1)
    base = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    rows = [*base, *base, (70, [1.0, 2.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda id_: id_ % 20 == 0).collect()
    x = np.array([v for _, v in base] + [[1.0, 2.0] + [0.0] * 6])
    ids = [*range(60), 70]
    for q in (0, 20, 40):
        mine = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == q)
        order = sorted((-float(x[ids.index(i)] @ x[q]), i) for i in ids if i != q)
        assert [i for _, i in mine] == [i for _, i in order[:20]] and [k for k, _ in mine] == list(range(1, 21))


def test_quality_with_many_more_labels_than_documents(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad stuff there ") * 5) for i in range(40)], "doc_id long, text string")
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    assert len(got) == 40 and all(p == i % 2 for i, p in got.items())


def test_one_passage_in_all_documents_and_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "TILE", 5)
    monkeypatch.setattr(decontam, "ITEMS", 2)
    shared = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"start{i} {shared} end{i}") for i in range(12)], "doc_id long, text string")
    items = spark.createDataFrame([*((i, shared) for i in range(4)), *((10 + i, f"{shared} tail{i}") for i in range(3)), (None, shared)], "item_id long, text string")
    got = decontam.contaminated(docs, items).collect()
    assert len(got) == 12 * 8 and all(r["start_word"] == 1 and r["n_equal"] == 20 for r in got)
