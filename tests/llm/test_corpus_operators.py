"""Language, neighbours, quality, joins, decontamination, pipeline: brute force, held-out accuracy and odd inputs."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import ann, decontam, langid, memory, ngram_join, quality, words
from loomspan.llm.queries import ORACLE_SQL, QUERIES
from loomspan.operators.tables import new_path, passing, settled, written
from tests.conftest import SF
from tests.test_queries import in_order, plain

MIDDLE = "/root/testdata/sf0.01"


def empty(df):
    return df.where("false")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert in_order(got) == in_order([tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()])


# 4


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    r = random.Random(1)
    vocabulary = {"xx": ["the", "and", "of", "with"], "yy": ["der", "und", "ein", "zu"]}
    rows = [(i, " ".join(r.choice(vocabulary[lang]) for _ in range(40)), lang) for i in range(120) for lang in vocabulary]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "123 !!", None), (903, "日本語", None), (904, "the and of " * 20000, None), (905, "UND DER EIN", None), (905, "UND DER EIN", None), (None, "the of and with", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.identify(docs).where("doc_id >= 900 or doc_id is null").collect()
    pred = {(x["doc_id"]): x["lang_pred"] for x in got}
    assert len(got) == 8 and pred[900] == pred[901] == pred[902] == "und" and pred[903] in vocabulary and pred[904] == "xx" and pred[905] == "yy" and pred[None] == "xx"
    assert langid.identify(empty(docs)).count() == 0


def test_network_responses_are_a_convolution():
    """Tables over byte pairs against the plain sum over the places of each filter, and pooling over windows by hand."""
    net = langid.Network(["a", "b", "c"], np.random.default_rng(5)).prepared()
    x = np.random.default_rng(6).integers(0, 256, (3, 40)).astype(np.uint8)
    wide = np.concatenate([x, np.full((3, 4), 0x20, np.uint8)], axis=1)
    plain = np.zeros((3, 40, net.w.shape[2]))
    for f in range(net.w.shape[2]):
        width = langid.WIDTHS[f // langid.FILTERS]
        for row in range(3):
            for at in range(40):
                plain[row, at, f] = sum(float(net.w[k, wide[row, at + k], f]) for k in range(width))
    assert np.allclose(net.responses(x), plain, atol=1e-4)
    hidden = np.maximum(plain.max(axis=1) + net.bias, 0)
    z = np.exp(hidden @ net.top + net.base)
    assert np.allclose(net.probabilities(x), z / z.sum(axis=1, keepdims=True), atol=1e-4)


def test_every_language_is_learned(spark):
    """More languages than any fixed number of classes, and many rows of one id."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 20, f"l{i}") for i in range(300)]
    net = langid.train(spark.createDataFrame([(t, lang, i) for i, t, lang in rows for _ in range(2)], "text string, lang string, h long"), rows=1)
    assert len(net.classes) == 300


# 6


def brute_nearest(x, ids, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out[ids[i]] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def recall(got, vectors):
    p = vectors.toPandas()
    want = brute_nearest(np.stack(p.embedding).astype(float), p.vec_id.to_numpy(), 20)
    found = {q: dict(zip(g.id, g.score, strict=True)) for q, g in got.groupby("query_id")}
    assert sorted(found) == sorted(want) and (got.groupby("query_id").size() == 20).all()
    for q, w in want.items():
        assert all(abs(found[q][i] - s) < 1e-12 for i, s in w if i in found[q])
    return np.mean([len(found[q].keys() & {i for i, _ in w}) / 20 for q, w in want.items()])


def test_nearest_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(ann.nearest(e, lambda c: c % 20 == 0).toPandas(), e) >= 0.9


def test_nearest_passes_over_far_leaves(spark, monkeypatch):
    """Well-separated groups: recall holds although the calibrated visits are few, and bounds leave out most leaves."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16)) * 5
    rows = [(i, (centres[rng.integers(60)] + rng.normal(size=16) * 0.3).tolist()) for i in range(6000)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "SAMPLE", 2000)
    assert recall(ann.nearest(e, lambda c: c % 20 == 0).toPandas(), e) >= 0.9


def test_nearest_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 4)).astype(np.float32)
    rows = [(i, base[i % 40 if i < 40 else 0].tolist()) for i in range(400)]
    rows += [(400, None), (401, [0.0] * 4), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf"), 1.0, 1.0, 1.0]), (420, []), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = ann.nearest(df, lambda c: c % 20 == 0).collect()
    ids = np.arange(400)
    want = brute_nearest(np.array([r[1] for r in rows[:400]], dtype=np.float32).astype(float), ids, 20)
    for q, w in want.items():
        mine = [(r["id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert [i for i, _ in mine] == [i for i, _ in w] and np.allclose([s for _, s in mine], [s for _, s in w], rtol=1e-12)
    assert {r["query_id"] for r in got} == set(want)
    assert ann.nearest(empty(df), lambda c: c % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 1, 2)"), lambda c: c % 20 == 0).count() == 2


# 7


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = labels.join(docs.select("doc_id"), "doc_id").select("doc_id", "quality")
    got = quality.classify(docs, labels).join(some, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert np.mean([(g > bad).mean() for g in good]) > 0.98 and (got.predicted == got.quality).mean() > 0.95


def test_quality_odd_rows(spark):
    rows = [(i, "good words here and there " * (1 + i % 3) if i % 2 else "### %%% $$$ " * (1 + i % 3)) for i in range(200)] + [(500, None), (501, ""), (502, "   "), (503, "### " * 50000), (503, "### " * 50000), (None, "good words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(0, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] == 503} == {0} and all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert quality.classify(empty(docs), labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == len(rows)


def naive_buckets(text):
    """The buckets of a text, n-gram by n-gram and word by word."""
    data, out = (text or "").encode(), set()
    for n in range(1, 5):
        for at in range(len(data) - n + 1):
            code = 0
            for b in data[at : at + n]:
                code = (code * 0x01000193 + b + 1) & 0xFFFFFFFF
            h = ((code ^ ((n - 1) * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
            out.add((h ^ h >> 15) & 0xFFFF)
    kind = lambda b: 1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 5 if b > 127 else 4
    found = list(__import__("re").finditer(rb"[^\x20\x09-\x0D]+", data))
    shapes = []
    for i, m in enumerate(found):
        w = m[0]
        end = found[i + 1].start() if i + 1 < len(found) else len(data)
        again = i > 0 and found[i - 1][0].lower() == w.lower()
        seen = 0
        for b in w:
            seen |= 1 << kind(b)
        shapes.append(kind(w[0]) | kind(w[-1]) << 3 | seen << 6 | min(end - m.start(), 31) // 8 << 12 | again << 16)
    for a, b in zip(shapes, shapes[1:], strict=False):
        x = np.array([(b * 0x9E3779B97F4A7C15 + a) & (2**64 - 1)], np.uint64)
        out.add(int(words.mixed(x)[0]) & 0xFFFF)
    return out


def test_quality_counts_and_margins_are_the_plain_ones(spark):
    """Indicators, class counts and scores against sums by hand."""
    import pyarrow as pa

    r = random.Random(2)
    texts = ["".join(r.choice(["ab", "A ", "7", ", ", "é", "same same ", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, ""]
    sets = [naive_buckets(t) for t in texts]
    assert [set(x.tolist()) for x in quality.indicators(pa.array(texts))] == sets
    labels = [i % 2 for i in range(len(texts))]
    counted = {r["bucket"]: (r["n0"], r["n1"]) for b in quality._counts([pa.record_batch([pa.array(texts), pa.array(labels)], names=["t", "l"])]) for r in b.to_pylist()}
    for bucket in set().union(*sets):
        assert counted[bucket] == tuple(sum(bucket in x for x, y in zip(sets, labels, strict=True) if y == c) for c in (0, 1))
    weights = np.random.default_rng(0).normal(size=quality.BUCKETS)
    got = {x["id"]: x["score"] for x in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (weights, 0.25)).collect()}
    for i, x in enumerate(sets):
        assert abs(got[i] - 1 / (1 + np.exp(-(sum(weights[b] for b in x) / max(1, len(x)) ** 0.5 + 0.25)))) < 1e-9


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = [np.unique(np.append(rng.integers(10, 60, 12), rng.integers(0, 5) + 5 * (i % 2))) for i in range(300)]
    y = np.where(np.arange(300) % 2, 1.0, -1.0)
    w, b = quality.dual_coordinate_descent(x, np.ones(60), y, np.ones(300) * 10, rng)
    assert np.mean(np.sign([w[i].sum() / np.sqrt(len(i)) + b for i in x]) == y) == 1.0


# 8


def brute_components(rows, k=5):
    sets = {}
    for i, text in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    ids = sorted(sets)
    of = {i: i for i in ids}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_join_is_exact(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 40, 120]))] + passage * r.randint(0, 1)
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 25))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy).replace("w1", "W1"))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (0, texts[0]), (905, texts[3])]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, id string, n int")
    got = {x["id"]: x["component"] for x in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_join_large_groups_stay_linear(spark):
    """Near copies of one text, and texts that share a long passage: links are right, and the pairs met stay few."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[r.randrange(150)] = r.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(base[:100] + [r.choice(vocabulary) for _ in range(60)])) for i in range(100)]
    got = {x["id"]: x["component"] for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_join_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string")
    got = ngram_join.jaccard_components(df).collect()
    assert sorted((x["id"] or 0, x["n_shingles"], x["component"] or 0) for x in got) == [(0, 3, 0), (0, 3, 0), (1, 3, 1)]
    assert ngram_join.jaccard_components(empty(df)).count() == 0


def test_adaptive_prefix_lengthens_for_frequent_shingles():
    none = np.zeros(0, np.int64)
    assert ngram_join._prefix(100, none, 75)[0] == 0  # nothing is shared
    assert ngram_join._prefix(100, np.full(100, 2), 75)[:2] == (25 + ngram_join._most(100), 26)
    upto, base, matches = ngram_join._prefix(1000, np.full(1000, 5000), 75)
    assert base == 251 and matches > 4 and upto == 250 + ngram_join._most(1000)
    # Shingles that stand alone come first: the prefix holds fewer others.
    assert ngram_join._prefix(100, np.full(80, 3), 75)[0] == 25 + ngram_join._most(100) - 20


@pytest.mark.parametrize("seed", range(2))
def test_join_is_exact_on_long_sets_near_the_threshold(spark, seed):
    """Sets of over 255 shingles, most of them a passage of many texts, with similarities around 0.75."""
    r = random.Random(100 + seed)
    vocabulary = [f"w{i}" for i in range(6000)]
    words_of = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [words_of(240) for _ in range(3)]
    texts = []
    for passage in passages:
        for _ in range(10):
            base = passage[: r.randint(200, 240)] + words_of(r.randint(20, 70))
            for _ in range(r.randint(1, 4)):
                copy = list(base)
                for _ in range(r.randint(0, 12)):
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
                texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = {x["id"]: x["component"] for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_join_of_ids_with_several_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (5, one), (5, two), (9, two + " more"), (7, one), (7, None), (8, "c d e f g h"), (8, "")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and all(x["component"] == want[x["id"]] for x in got) and want[9] == 1


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_join_does_not_shuffle_texts_without_partner(spark, monkeypatch):
    """Where the asked ids are too many for a broadcast, only texts that may have a partner go through a shuffle."""
    r = random.Random(4)
    rows = [(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(200))) for i in range(600)]
    rows += [(1000 + i, text + " more") for i, text in rows[:10]]
    moved, write = {}, ngram_join.written

    def counted(df, name):
        before = shuffled(spark)
        out = write(df, name)
        moved[name] = shuffled(spark) - before
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {x["id"]: x["component"] for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert 0 < moved["sets"] < sum(len(text) for _, text in rows) // 10


@pytest.mark.parametrize("most", [1, 2048])
def test_filter_of_ids_loses_none(spark, monkeypatch, most):
    """Every asked id passes, also where the filter is too small for them; others hardly do where it is not."""
    monkeypatch.setattr(ngram_join, "FILTER_ROWS", most)
    docs = spark.range(-3000, 57_000).select("id", F.lit("x").alias("text")).unionByName(spark.createDataFrame([(None, "x")], "id long, text string"))
    live = spark.range(-3000, 57_000, 4).toDF("id")
    kept = [x["id"] for x in ngram_join._perhaps(docs, live).collect()]
    wanted = set(range(-3000, 57_000, 4))
    assert wanted <= set(kept) and len(kept) - len(set(kept)) == 0
    assert len(kept) - len(wanted) < (45_000 if most == 1 else 2500)


def test_first_pass_drops_the_same_sets_in_any_layout(spark):
    """Sets without a partner are found however the rows are dealt; chunks that end anywhere lose nothing."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    gone = [{tuple(r) for r in ngram_join._lonely(docs.repartition(n), 5, 75, 1).collect()} for n in (1, 7, 40)]
    assert gone[0] == gone[1] == gone[2] and gone[0]
    counts = {}
    rows = [(r["text"]) for r in docs.collect()]
    sets = [frozenset(x.tolist()) for x in words.shingle_sets(__import__("pyarrow").array(rows))]
    for x in sets:
        for token in x:
            counts[token] = counts.get(token, 0) + 1
    want = {x for x in sets if x and 100 * sum(counts[t] > 1 for t in x) < 75 * len(x)}
    assert len(gone[0]) == len(want)


def test_shingle_hashes_count_like_text():
    import pyarrow as pa

    texts = ["A b  c\td e f", "a b c d e f", None, "", "x", "a b c d", "é " * 9 + "é"]
    assert [len(s) for s in words.shingle_sets(pa.array(texts))] == [2, 2, 0, 0, 1, 1, 1]


# 10


def test_decontamination(spark):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([40, 25, 14, 9, 6, 3])] + [(90, None), (91, "")]
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, want = [], set()
    for i, text in items[:6]:
        w = text.split()
        docs.append((10 + i, " ".join(noise(50) + w + noise(40)).upper().replace("V", "v")))
        want.add((10 + i, i))
        if len(w) > 12:
            changed = [x if j % 9 else "changed" for j, x in enumerate(w)]  # substitutions
            docs.append((20 + i, " ".join(noise(5) + changed)))
            want.add((20 + i, i))
    docs += [(50 + i, " ".join(noise(300))) for i in range(30)] + [(200, None), (201, ""), (10, docs[0][1]), (None, " ".join(items[0][1].split()))]
    want.add((None, 0))
    frame = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(frame, bench).collect()
    assert {(x["id"], x["item"]) for x in got} == want and sum(x["id"] == 10 for x in got) == 2
    assert decontam.contaminated(empty(frame), bench).count() == decontam.contaminated(frame, empty(bench)).count() == 0


def brute_overlaps(docs, items, min_share=0.5, min_words=6, penalty=2.0):
    """Every document and item that some alignment lays side by side well enough, by trying all."""
    out = set()
    split = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    for d, text in docs:
        words_ = split(text)
        for i, item in items:
            item_ = split(item)
            for start in range(-len(item_) + 1, len(words_)):
                best = run = 0.0, 0
                for j, w in enumerate(item_):
                    at = start + j
                    if not 0 <= at < len(words_):
                        continue
                    same = words_[at] == w
                    run = (run[0] + (1.0 if same else -penalty), run[1] + same)
                    run = run if run[0] >= 0 else (0.0, 0)
                    best = max(best, run)
                equal = best[1]
                if item_ and equal >= min(min_words, len(item_)) and (equal >= min_share * len(item_) or equal >= 4 * min_words):
                    out.add((d, i))
    return out


def test_short_items_and_substitutions_against_all_alignments(spark):
    """Items of one to thirteen words, whole and with one word substituted at any inner place; longer ones with every ninth."""
    r = random.Random(8)
    vocabulary = [f"u{i}" for i in range(2000)]
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items, docs = [], []
    for n in [*range(1, 14), 20, 33]:
        w = [f"item{n}w{j}" for j in range(n)]
        items.append((n, " ".join(w)))
        docs.append((len(docs), " ".join(noise(9) + w + noise(9))))
        for gap in range(1, n - 1) if n < 14 else [5]:
            docs.append((len(docs), " ".join(noise(9) + [x if j % 9 != gap % 9 or (n < 14 and j != gap) else "other" for j, x in enumerate(w)] + noise(9))))
    want = brute_overlaps(docs, items)
    got = {(x["id"], x["item"]) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and {i for _, i in want} == {i for i, _ in items}


def test_leaks_in_the_documents(spark):
    """Against brute force: documents that hold a whole benchmark text."""
    docs, bench = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [" ".join(x["text"].split()).lower() for x in bench.collect()]
    texts = {d["doc_id"]: " ".join(d["text"].split()).lower() for d in docs.collect()}
    want = {d for d, text in texts.items() if any(i in text for i in items)}
    got = {x["id"] for x in decontam.contaminated(docs, bench).collect()}
    assert want <= got

    def equal(words, item):
        """Most equal words of the item's best stretch over all ways to lay it along the text."""
        best = 0
        for at in range(1 - len(item), len(words)):
            score = run = 0
            for a, b in zip(words[max(0, at) :], item[max(0, -at) :]):
                score, run = (score + 1, run + 1) if a == b else (score - 2, run)
                if score <= 0:
                    score = run = 0
                best = max(best, run)
        return best

    # Documents beyond these hold an item with substituted words.
    for d in got - want:
        assert any(equal(texts[d].split(), i.split()) >= max(min(6, len(i.split())), min(24, len(i.split()) / 2)) for i in items), d


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    text = lambda i: " ".join(f"word{i}x{j} the and of" for j in range(30))
    leak = " ".join(f"bench{j}" for j in range(30))
    rows = [(i, text(i), "en" if i % 2 else None, "s", 5, "more") for i in range(40)]
    rows += [(100, "12 34", "en", "s", 5, "m"), (101, None, "en", "s", 5, "m"), (102, text(0) + " extra", "en", "s", 5, "m"), (103, text(50) + " " + leak, "en", "s", 5, "m"), (104, text(60) + " a.b@c.org", "en", "s", 5, "m"), (1, text(1), "en", "s", 5, "more"), (1, text(90), "en", "s", 5, "more"), (None, text(70), "en", "s", 5, "m"), (None, text(70) + " again", "en", "s", 5, "m"), (None, text(80) + " " + leak, "en", "s", 5, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").withColumn("__key", F.lit("mine")).withColumn("a.b", F.create_map(F.lit("k"), F.col("source")))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        path = str(tmp_path / f"{name}.parquet")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    got = {r["doc_id"]: r for r in docs.collect()}
    assert all(r["__key"] == "mine" and r["a.b"] == {"k": "s"} for r in got.values())
    assert set(got) == {*range(40), 104, None} and docs.count() == 43  # id 1 with an unrelated text is a document of its own
    assert got[104]["text"].endswith(" [EMAIL]") and got[104]["n_chars"] == len(got[104]["text"]) and got[0]["lang"] == "en"
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 43


def _tables(spark):
    """The tables in the application's part of the shared folder."""
    return {os.path.basename(p) for p in glob.glob(os.path.dirname(new_path(spark, "x")).removeprefix("file:") + "/*")}


def test_pipeline_stages_leave_only_what_their_results_read(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, left in (("language_id", []), ("near_duplicates", ["first", "groups"]), ("decontamination", ["leaks"]), ("personal_data", ["base", "spans"])):
        before = _tables(spark)
        out = dict(cp.STAGES)[name](spark, docs, SF)
        assert sorted(x.rsplit("-", 1)[0] for x in _tables(spark) - before) == left, name
        assert 0 < out.count() <= docs.count()
    before = _tables(spark)
    assert cp.run(spark, SF).count() > 0
    assert [x.rsplit("-", 1)[0] for x in _tables(spark) - before] == ["personal_data"]


def test_tables_of_a_block_go_also_if_it_fails(spark):
    before = _tables(spark)
    with pytest.raises(ZeroDivisionError), passing(spark):
        assert written(spark.range(3), "inner").count() == 3 and len(_tables(spark) - before) == 1
        inner = settled(spark, lambda: written(spark.range(5), "a").where("id > 1"), "nested")
        assert inner.count() == 3
        1 / 0  # noqa: B018
    assert _tables(spark) == before
    kept = settled(spark, lambda: written(spark.range(5), "a").where("id > 1"), "kept")
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4]
    assert [x.rsplit("-", 1)[0] for x in _tables(spark) - before] == ["kept"]


def test_personal_data_shuffles_no_text_without_any(spark):
    """Of 400 texts of 20 KB two hold an address; words of two letters are no terms, so that nothing else is shuffled."""
    import corpus_pipeline as cp

    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefghijklmnop") + r.choice("abcdefghijklmnop") for _ in range(7000))
    rows = [(i, text()) for i in range(398)] + [(1000, text() + " ann.b@c.org zanzibar"), (1001, None), (1002, text() + " zanzibar 10.0.0.1")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "docs")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, given = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {x["doc_id"]: x["text"] for x in cp.personal_data(spark, docs, SF).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert shuffled() - before < 1_000_000
    assert len(got) == len(rows) and all(got[i] == t for i, t in rows if i < 1000) and got[1001] == ""
    assert "[EMAIL]" in got[1000] and got[1002].endswith("[IP]")


def test_pipeline_batches_are_bounded_by_bytes(spark):
    import corpus_pipeline as cp

    docs = spark.range(0, 48, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab cd ', 100000)").alias("text"))
    try:
        cp.tokens(spark, docs, SF)
        got = [r["n"] for r in docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(got) >= 48 * 600_000 and max(got) <= memory.BATCH_BYTES + 700_000


def test_tasks_give_back_what_they_freed():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024

    pins = []

    def work(batches):
        for batch in batches:
            large = [np.ones(8_000) for _ in range(4_000)]  # 256 MB in blocks that the C library keeps while one behind them is in use
            pins.append(np.ones(8_000))
            del large
            yield batch

    before, untidy = held(), list(work([1]))
    kept = held() - before
    assert list(memory.tidy(work)([2])) == [2] and untidy == [1]
    assert kept > 150 and held() - before < 60


def test_pipeline_rejects_languages_that_it_did_not_learn(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心", "bqz xkvw qqzt zzkx vjhq wpqz xxqj kzvq qjxw zkqv " * 2, "Привет мир", "人人生而自由"]
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in cp.language_id(spark, docs.unionByName(more), SF).collect()}
    lettered = {r["doc_id"] for r in docs.where("text rlike '[a-zA-Z]'").collect()}
    assert kept == lettered


def test_pipeline_against_plain_stages(spark, tmp_path):
    """All stages of run() over a small table against plain Python: copies by all pairs, passages by containment, addresses by a pattern, tokens by the library."""
    import hashlib
    import re

    import corpus_pipeline as cp
    import public_tokenizers
    import tiktoken

    r = random.Random(9)
    common = "the of and to in that is was for with as his they at be this have from or one had by word but not what all were we when".split()
    other = "der die und das ein zu den mit sich auf ist im dem nicht eine als auch es an werden aus er hat dass sie nach wird bei".split()
    text = lambda words, n: " ".join(r.choices(words, k=n))
    passage = " ".join(f"quiz{i}" for i in range(20))
    rows = [(i, text(common if i % 2 else other, 60), "en" if i % 2 else "de") for i in range(80)]
    for i in range(80, 100):
        words_ = rows[r.randrange(80)][1].split()
        if i % 2:
            words_[r.randrange(60)] = "changed"
        rows.append((i, " ".join(words_), None))
    rows += [(100, f"{text(common, 20)} {passage} {text(common, 20)}", "en"), (101, f"{text(common, 30)} mail a.b@c.org {text(common, 30)}", "en"), (102, "12 34", "en"), (103, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t, _ in rows if t and re.search("[a-z]", t)}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in kept.items()}
    root = {i: i for i in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = {i: re.sub(r"\S+@\S+", "[EMAIL]", t) for i, t in kept.items() if root[i] == i and passage not in t}
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (len(ids := encoding.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, t in kept.items()}
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"]) for x in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and {i for i in got if got[i] != want[i]} <= {101}  # the address's own text may lose more terms with it
