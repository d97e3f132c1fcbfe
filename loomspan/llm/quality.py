"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams, hashed into ``BUCKETS``: n-grams of its bytes, and pairs of the shapes of neighbouring
words (case, first and last kind of character, whether a word repeats the one before). Each indicator is scaled by the
log ratio of its frequencies in the two classes, which are counted over all labelled rows, and by the square root of
the set's size. A linear model with hinge loss is fitted on these by dual coordinate descent, and its margins are
turned into probabilities by a logistic curve fitted on rows that it hasn't seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.words import _SPACE, mixed, pieces, raw, word_hashes
from loomspan.operators.tables import written

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Labelled rows that the linear model is fitted on, and the part of them that calibrates it.
ROWS, CALIBRATION = 4000, 4
#: Bytes of their sets that may reach the driver; very long texts leave fewer rows.
SAMPLE_BYTES = 128 << 20
COST, EPOCHS, SMOOTH, SEED = 1.0, 20, 1.0, 11

# Kinds of bytes for word shapes: white space, small, capital, digit, other ASCII, beyond ASCII.
_KIND = np.full(256, 4, np.uint64)
_KIND[_SPACE] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5


def _word_shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the shape of each word, and the rows' word offsets."""
    words, cuts = word_hashes(data, offsets)
    if not len(words):
        return words, cuts
    solid = ~_SPACE[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.logical_not(solid[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(solid & edge)
    kinds = _KIND[data]
    some = np.flatnonzero(np.diff(cuts))
    final = cuts[some + 1] - 1  # the last word of each row: nothing behind its row counts
    stop = np.append(starts[1:], len(data))
    stop[final] = offsets[some + 1]
    last = np.maximum.reduceat(np.where(solid, np.arange(len(data)), 0)[starts[0] :], starts - starts[0])
    seen = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), kinds)[starts[0] :] * solid[starts[0] :], starts - starts[0])
    length = np.minimum(stop - starts, 31).astype(np.uint64) // np.uint64(8)
    again = np.append(False, words[1:] == words[:-1])
    again[cuts[some]] = False
    return kinds[starts] | kinds[last] << np.uint64(3) | seen << np.uint64(6) | length << np.uint64(12) | again.astype(np.uint64) << np.uint64(16), cuts


def indicators(texts: pa.Array):
    """For each row, the sorted distinct buckets of its n-grams."""
    data, offsets = raw(texts)
    flags = np.zeros(BUCKETS, bool)
    for a, b in pieces(offsets):
        part = offsets[a : b + 1] - offsets[a]
        own = data[offsets[a] : offsets[b]]
        wide = own.astype(np.uint32) + np.uint32(1)
        grams, code = [], np.zeros(len(own), np.uint32)
        for n in range(max(ORDERS)):
            code = code[: len(own) - n] * np.uint32(0x01000193) + wide[n:] if n < len(own) else np.zeros(0, np.uint32)
            if n + 1 in ORDERS:
                h = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                grams.append((n, ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.uint16)))
        shapes, cuts = _word_shapes(own, part)
        pairs = mixed(shapes[1:] * np.uint64(0x9E3779B97F4A7C15) + shapes[:-1]) & np.uint64(BUCKETS - 1) if len(shapes) > 1 else shapes[:0]
        for i in range(b - a):
            flags[:] = False
            for n, h in grams:
                flags[h[part[i] : max(part[i], part[i + 1] - n)]] = True
            flags[pairs[cuts[i] : max(cuts[i], cuts[i + 1] - 1)]] = True
            yield np.flatnonzero(flags).astype(np.uint16)


def _counts(batches):
    for batch in batches:
        sums = np.zeros((2, BUCKETS), np.int64)
        rows = [0, 0]
        for label, x in zip(batch.column(1).to_pylist(), indicators(batch.column(0)), strict=True):
            sums[label, x] += 1
            rows[label] += 1
        some = np.flatnonzero(sums.any(axis=0))
        buckets = np.append(some, BUCKETS)  # the last counts the rows
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.append(sums[0, some], rows[0])), pa.array(np.append(sums[1, some], rows[1]))], names=["bucket", "n0", "n1"])


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in indicators(batch.column(0))], pa.binary()), *batch.columns[1:]], names=["x", "label", "h"])


def dual_coordinate_descent(x: list[np.ndarray], values: np.ndarray, y: np.ndarray, costs: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss model; row i holds ``values`` at x[i] over the square root of its size."""
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(x))
    rows = [values[i] / np.sqrt(max(1, len(i))) for i in x]
    squares = np.array([r @ r + 1.0 for r in rows])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            slope = y[i] * (w[x[i]] @ rows[i] + bias) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), costs[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * y[i]
                w[x[i]] += change * rows[i]
                bias += change
                alpha[i] = new
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the calibration curve, by Newton's method with softened targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.column_stack([margin, np.ones(len(margin))])
    at = np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - t))
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def train(labelled: DataFrame, sample_of=None) -> tuple[np.ndarray, float]:
    """Weights by bucket and intercept, so that the score is the logistic of their sum over a set by the root of its size.

    ``labelled`` has text, label (0 or 1) and a hash h. All of its rows are counted for the ratios; at most ``ROWS``,
    those with the smallest hashes, and of these as many as ``SAMPLE_BYTES`` hold, fit the model. ``sample_of(limit)`` gives the rows with ``h % 2**30 <= limit`` where
    there is a cheaper way to them. With one class only, its share alone is learned.
    """
    shaped = lambda df: df.where("label in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"), "h")
    sample_of = sample_of or (lambda limit: labelled.where(F.pmod("h", F.lit(1 << 30)) <= limit))
    counts = shaped(labelled).select("text", "label").mapInArrow(_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    sums = np.zeros((2, BUCKETS + 1))
    sums[:, counts["bucket"]] = counts[["n0", "n1"]].to_numpy().T
    rows = sums[:, -1]
    if rows.min() == 0:
        return np.zeros(BUCKETS), float(np.log((rows[1] + 1) / (rows[0] + 1)))
    freq = sums[:, :-1] + SMOOTH
    ratio = np.log(freq[1] / freq[1].sum() / (freq[0] / freq[0].sum()))
    limit = int(min(1.0, ROWS * 1.2 / rows.sum()) * (1 << 30))
    drawn = written(shaped(sample_of(limit)).mapInArrow(_sets, "x binary, label int, h long"), "sample").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "x").limit(ROWS)
    sizes = np.cumsum([r["n"] for r in drawn.select(F.length("x").alias("n")).collect()])  # at most ROWS numbers
    sample = drawn.limit(max(1, int(np.searchsorted(sizes, SAMPLE_BYTES, side="right")))).collect()
    sample = sorted(sample, key=lambda r: (r["h"] % (1 << 30), r["h"], r["x"]))
    x = [np.frombuffer(r["x"], np.uint16) for r in sample]
    y = np.array([1.0 if r["label"] else -1.0 for r in sample])
    rng = np.random.default_rng(SEED)
    held = np.arange(len(x)) % CALIBRATION == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    costs = np.where(y > 0, 1.0, np.sqrt((y > 0).sum() / max(1, (y < 0).sum()))) * COST
    w, bias = dual_coordinate_descent([x[i] for i in fit], ratio, y[fit], costs[fit], rng)
    weights = w * ratio
    some = np.flatnonzero(held) if held.any() else fit
    slope, base = _logistic(np.array([weights[x[i]].sum() / np.sqrt(max(1, len(x[i]))) + bias for i in some]), y[some])
    return weights * slope, bias * slope + base


def score(documents: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)``: the probability of label 1 of every row's whole text; null and empty texts are empty sets. Rows repeat as they come."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        weights, base = shared.value
        for batch in batches:
            margins = np.array([weights[x].sum() / np.sqrt(max(1, len(x))) for x in indicators(batch.column(1))]) + base
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))), pa.float64())], names=["id", "score"])

    return docs.mapInArrow(of, f"id {docs.schema['id'].dataType.simpleString()}, score double")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: learns from labels of documents with crc32(doc_id) mod 5 other than 0.

    Null and empty texts are empty sets and have the score of the intercept. Labels that are null, no 0 or 1, or of an
    unknown or null id teach nothing; without any, every score is 0.5. Rows with a null id are not held out; repeated
    rows and ids stay, repeated labels count as often; very long texts are read whole, other columns are not read, and
    an empty table gives an empty one.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where(fold != 0).select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("h"))
    texts = documents.select("doc_id", "text")
    # Labels may be many more than documents: only those of documents go on, found by ids alone, without texts. They
    # grow with the documents and meet these by sorting. The sample's labels are left to Spark, which knows their size.
    known = written(known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    few = lambda limit: texts.join(written(known.where(F.pmod("h", F.lit(1 << 30)) <= limit), "few"), "doc_id")
    out = score(documents, train(texts.join(known.hint("merge"), "doc_id"), few))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
