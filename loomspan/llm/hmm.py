"""Language-model scoring: a hidden Markov model of words, trained by Baum-Welch over all training texts.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end after each text. All words are counted. The most
frequent ones (at most ``SYMBOLS`` less the classes, seen twice or more) are symbols of the model; every other word, known
or not, emits the symbol of its class (its last two bytes and its length), and its share of the class comes from the
counts: (c + 0.1) / (class total + 0.1 * (class words + 1)), with c = 0 for unknown words. This share does not depend on
the state, so the likelihood of a text is a forward recursion over its symbols times the shares of its rare words.

Every round of Baum-Welch is one pass in which each task runs scaled forward and backward recursions over its texts and
gives expected counts by symbol, which Spark adds up. Rounds over all training texts follow a start from random states on
whole texts of at most ``START_TOKENS`` tokens, as a start from nothing needs many rounds. Recursions go over many texts
side by side, in windows of ``STEPS`` symbols, so that memory is bounded besides a text's own symbols. In scoring a window
takes over the forward vector of the last one, so a text's likelihood is exact whatever its length. In learning each
window of a long text is a sequence of its own: all symbols count, and one step in ``STEPS`` does not.

What is broadcast has a fixed size: counts of at most ``TABLE`` words, and emissions of ``SYMBOLS`` symbols. Counts of
other words are joined. Words are told apart by 64-bit hashes: two of n words share one with a chance of n * n / 4e19.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.words import _LOWER, _SPACE, pieces, raw, word_hashes
from loomspan.operators.tables import written

#: Latent states, symbols of the model with its classes of rare words, and words whose counts go to all executors.
STATES, SYMBOLS, CLASSES, TABLE = 16, 1 << 15, 256, 1 << 20
#: Tokens that start the states, rounds over these, and rounds over all training texts.
START_TOKENS, START_ROUNDS, ROUNDS, SEED = 300_000, 20, 3, 5
#: Added to every count, and the share of an emission that comes from all texts whatever the state.
ADDED, MIX = 0.1, 0.1
#: Texts that a recursion takes at a time, and steps of a window; longer texts are learned as several sequences.
LANES, STEPS = 256, 1024


def _words(texts: pa.Array):
    """For pieces of the rows: first row, hashes and classes of the words, and the rows' word offsets."""
    data, offsets = raw(texts)
    for a, b in pieces(offsets):
        part = offsets[a : b + 1]
        some, at = data[part[0] : part[-1]], part - part[0]
        hashes, cuts = word_hashes(some, at)
        solid = np.concatenate([~_SPACE[some], [False]])
        border = np.zeros(len(some) + 1, bool)
        border[at] = True
        ends = np.flatnonzero(solid[:-1] & (~solid[1:] | border[1:]))
        starts = np.flatnonzero(solid[:-1] & np.concatenate([[True], ~solid[:-2] | border[1:-1]])) if len(some) else ends
        length = ends - starts + 1
        before = np.where(length > 1, _LOWER[some[ends - 1]], 0).astype(np.int64) if len(some) else ends
        yield a, hashes, ((_LOWER[some[ends]].astype(np.int64) * 31 + before) * 7 + np.minimum(length, 12)) % CLASSES if len(some) else ends, cuts


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Parts of (hash, class, count) with one row a hash."""
    hashes, classes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    each, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    return each, classes[first], np.bincount(of, counts, len(each)).astype(np.int64)


def _counted(batches):
    """(hash, class, n) of the words of a task's texts, added up before they are sent."""

    def batch_of(hashes, classes, counts):
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(classes.astype(np.int32)), pa.array(counts)], names=["hash", "cls", "n"])

    held, size = [], 0
    for batch in batches:
        for _, hashes, classes, _ in _words(batch.column(0)):
            held.append(_added([(hashes, classes, np.ones(len(hashes), np.int64))]))
            size += len(held[-1][0])
            if size > 1 << 20:
                held = [_added(held)]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield batch_of(*held.pop())
                    size = 0
    if held:
        yield batch_of(*_added(held))


@dataclass
class Vocabulary:
    """Counts of the frequent words, and what each gives in a text."""

    hashes: np.ndarray  #: sorted
    symbol: np.ndarray  #: of each word: its own, or that of its class
    base: np.ndarray  #: log10 of its smoothed share of all tokens
    inner: np.ndarray  #: log10 of its share of its class; 0 where the symbol is its own
    classes: int  #: the first class symbol; the end is symbol 0
    tokens: int
    distinct: int
    texts: int
    share: np.ndarray  #: smoothed share of each symbol in all tokens
    class_total: np.ndarray  #: smoothed total of each class


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From ``counts(hash, cls, n)`` and the number of training texts. The words that go to the driver are the most frequent ones in whole bands of counts, ``TABLE`` at most."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] + texts, total["v"] + (texts > 0)
    bands = sorted(((r["band"], r["count"]) for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("band")).count().collect()), reverse=True)
    least, sum_ = None, 0
    for band, n in bands:
        sum_ += n
        if sum_ > TABLE:
            break
        least = band
    top = counts.where(F.floor(F.log2("n") * 8) >= least).toArrow() if least is not None else pa.table({"hash": pa.array([], pa.int64()), "cls": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    hashes, cls, n = (top.column(c).to_numpy() for c in ("hash", "cls", "n"))
    hashes = hashes.view(np.uint64)
    order = np.lexsort((hashes, -n))
    own = order[: SYMBOLS - CLASSES - 1]
    own = own[n[own] > 1]
    free = len(own) + 1
    symbol = (free + cls).astype(np.int64)
    symbol[own] = np.arange(1, free)
    in_class, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        in_class[r["cls"]], words[r["cls"]] = r["n"], r["v"]
    in_class -= np.bincount(cls[own], n[own], CLASSES)
    words -= np.bincount(cls[own], minlength=CLASSES)
    class_total = in_class + ADDED * (words + 1)
    share = np.concatenate([[texts + ADDED], n[own] + ADDED, class_total])
    inner = np.log10((n + ADDED) / class_total[cls])
    inner[own] = 0
    sort = np.argsort(hashes)
    base = np.log10((n + ADDED) / (tokens + ADDED * (distinct + 1)))
    return Vocabulary(hashes[sort], symbol[sort], base[sort], inner[sort], free, tokens, distinct, texts, share / share.sum(), class_total)


def _coder(shared, names: list[str]):
    """Texts to symbols: sums over the words whose counts are at hand, and a list of the others."""

    def code(batches):
        v: Vocabulary = shared.value
        for batch in batches:
            for row, hashes, classes, cuts in _words(batch.column(2)):
                docs = len(cuts) - 1
                each, first, of = np.unique(hashes, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(v.hashes, each), max(0, len(v.hashes) - 1))
                hit = v.hashes[at] == each if len(v.hashes) else np.zeros(len(each), bool)
                known = lambda x, other: np.where(hit, x[at], other) if len(v.hashes) else other  # noqa: B023, E731
                symbol = known(v.symbol, v.classes + classes[first]).astype(np.uint16)
                doc = np.repeat(np.arange(docs), np.diff(cuts))
                adds = lambda x: np.bincount(doc, x[of], docs)  # noqa: B023, E731
                ends = cuts[1:] + np.arange(docs)
                data = np.zeros(len(hashes) + docs, np.uint16)
                data[np.arange(len(hashes)) + doc] = symbol[of]
                offsets = (np.concatenate([[0], ends + 1]) * 2).astype(np.int32)
                symbols = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                rest = np.flatnonzero(~hit[of])
                pair, n = np.unique(doc[rest] * max(1, len(each)) + of[rest], return_counts=True)
                word = pair % max(1, len(each))
                rest_of = np.searchsorted(pair // max(1, len(each)), np.arange(docs + 1)).astype(np.int32)
                fields = [pa.array(each.view(np.int64)[word]), pa.array(classes[first][word].astype(np.int32)), pa.array(n.astype(np.int64))]
                others = pa.ListArray.from_arrays(pa.array(rest_of), pa.StructArray.from_arrays(fields, names=["hash", "cls", "n"]))
                none = np.zeros(len(each))
                columns = [*(batch.column(i).slice(row, docs) for i in (0, 1)), pa.array(np.diff(cuts) + 1), symbols, pa.array(adds(known(v.base, none))), pa.array(adds(known(v.inner, none))), pa.array(adds(hit.astype(float)).astype(np.int64)), others]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return code


class Model:
    """Start, transition and emission probabilities; emissions by symbol."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray, held: np.ndarray):
        self.start, self.step, self.emit, self.held = start, step, emit, held  # held: share of the tokens of each state

    @classmethod
    def random(cls, share: np.ndarray, states: int) -> Model:
        rng = np.random.default_rng(SEED)
        emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
        step = rng.uniform(0.8, 1.2, (states, states)) + states * np.eye(states)
        return cls(np.full(states, 1 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), np.full(states, 1 / states))

    def better(self, counts: Counts, share: np.ndarray) -> Model:
        """From expected counts; emissions keep a part of the symbol's share in all texts, so none is zero."""
        step = self.step * counts.step + ADDED
        start = counts.start + ADDED
        held = counts.emit.sum(axis=0) + ADDED
        emit = (1 - MIX) * counts.emit / held + MIX * share[:, None]
        return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), held / held.sum())

    def likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each text (none is empty, as each has its end), by one recursion from its start to its end."""
        out = np.zeros(len(texts))
        for some, sizes in _lanes(texts):
            logs, last = np.zeros(len(some)), None
            for t in range(0, int(sizes[0]), STEPS):
                *_, alphas, scale = self._forward([texts[j] for j in some], sizes, t, last)
                logs[: scale.shape[1]] += np.log(scale).sum(axis=0)
                last = alphas[-1]
            out[some] = logs
        return out

    def learn(self, texts: list[np.ndarray], to: Counts) -> None:
        """Adds the expected counts of ``texts``, cut into sequences of ``STEPS`` symbols. One that does not begin its text starts from the states' shares, and is no start."""
        parts = [x[t : t + STEPS] for x in texts for t in range(0, len(x), STEPS)]
        begins = np.array([t == 0 for x in texts for t in range(0, len(x), STEPS)])
        for some, sizes in _lanes(parts):
            first = np.where(begins[some][:, None], self.start, self.held)
            self._backward(*self._forward([parts[j] for j in some], sizes, 0, first), begins[some], to)

    def _forward(self, texts, sizes, t, carry):
        """A window of steps from ``t`` over the texts that reach it: symbols, live lanes of each step, emissions, scaled forward vectors and scales. ``carry`` is the last vector, or at 0 the start if it isn't the model's."""
        live = int(np.searchsorted(-sizes, -t, side="left"))  # texts are sorted by falling length
        steps = int(min(STEPS, sizes[0] - t))
        symbols = np.zeros((steps, live), np.int64)
        for j in range(live):
            part = texts[j][t : t + steps]
            symbols[: len(part), j] = part
        lanes = [int(np.searchsorted(-sizes, -(t + i), side="left")) for i in range(steps)]
        emitted = self.emit[symbols]
        alphas, scale = [], np.ones((steps, live), self.emit.dtype)
        for i, k in enumerate(lanes):
            before = alphas[-1][:k] @ self.step if i else self.start if carry is None else carry[:k] @ self.step if t else carry
            a = emitted[i, :k] * before
            scale[i, :k] = a.sum(axis=1)
            a /= scale[i, :k, None]
            alphas.append(a)
        return symbols, lanes, emitted, alphas, scale

    def _backward(self, symbols, lanes, emitted, alphas, scale, begins, to) -> None:
        onward = None  # emission times backward vector over scale, at the step after
        for i in range(len(lanes) - 1, -1, -1):
            beta = np.ones_like(alphas[i])
            if onward is not None:
                to.step += alphas[i][: len(onward)].T @ onward
                beta[: len(onward)] = onward @ self.step.T
            onward = emitted[i, : lanes[i]] * beta
            onward /= scale[i, : lanes[i], None]
            emitted[i, : lanes[i]] = alphas[i] * beta  # no longer asked for; the states' probabilities take its place
        live = np.arange(symbols.shape[1])[None, :] < np.array(lanes)[:, None]
        flat, states = symbols[live], emitted[live]
        for s in range(states.shape[1]):
            to.emit[:, s] += np.bincount(flat, states[:, s], len(to.emit))
        to.start += emitted[0][begins].sum(axis=0, dtype=np.float64)


def _lanes(texts: list[np.ndarray]):
    """Groups of ``LANES`` texts of like length, longest first, with their falling lengths."""
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), LANES):
        some = order[i : i + LANES]
        yield some, sizes[some]


class Counts:
    """Expected counts of starts, steps (still without the step's own probability) and emissions."""

    def __init__(self, symbols: int, states: int):
        self.start, self.step, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))


def _texts(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def _expected(model: Model, coded: DataFrame) -> Counts:
    """Expected counts over all rows of ``coded``: each task adds up its own, Spark those of the tasks. They are as many as symbols times states."""
    size, states = model.emit.shape
    light = Model(*(x.astype(np.float32) for x in (model.start, model.step, model.emit, model.held)))
    shared = coded.sparkSession.sparkContext.broadcast(light)
    names = [f"s{i}" for i in range(states)]

    def expect(batches):
        own = Counts(size, states)
        for batch in batches:
            shared.value.learn(_texts(batch.column(0)), own)
        some = np.flatnonzero(own.emit.any(axis=1))
        rows = np.concatenate([own.emit[some], own.step, own.start[None]]).astype(np.float32)
        place = np.concatenate([some, size + np.arange(states + 1)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(rows[:, s]) for s in range(states))], names=["place", *names])

    parts = coded.select("symbols").mapInArrow(expect, "place int, " + ", ".join(f"{x} float" for x in names))
    table = parts.groupBy("place").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    rows = np.zeros((size + states + 1, states))
    rows[table.column("place").to_numpy()] = np.stack([table.column(x).to_numpy() for x in names], axis=1)
    out = Counts(size, states)
    out.emit, out.step, out.start = rows[:size], rows[size : size + states], rows[-1]
    shared.unpersist()
    return out


def baum_welch(coded: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` over all rows of ``coded``, which start from a bounded set of whole texts."""
    model = Model.random(share, states)
    sizes = coded.select("row", "n_tokens").orderBy(F.xxhash64("row"), "row").limit(2000).collect()
    some, sum_ = [], 0
    for r in sizes:
        if sum_ + r["n_tokens"] <= START_TOKENS:
            some.append(r["row"])
            sum_ += r["n_tokens"]
    if some:
        texts = _texts(coded.where(F.col("row").isin(some)).orderBy("row").select("symbols").toArrow().column(0))
        for _ in range(START_ROUNDS):
            counts = Counts(*model.emit.shape)
            model.learn(texts, counts)
            model = model.better(counts, share)
    for _ in range(rounds if sizes else 0):
        model = model.better(_expected(model, coded), share)
    return model


def score(documents: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``(id, learned, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``documents``.

    ``is_training`` says which rows are learned from; null counts as no. ``score`` is the log10 probability of the whole
    text with its end, ``base_score`` that of independent tokens, (c + 0.1) / (N + 0.1 * (V + 1)) each. A null or empty
    text is an end alone. Repeated rows and rows of one id are texts of their own; a null id stays null. Without training
    rows all words are unknown. An empty table gives an empty one. Other columns are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(is_training, F.lit(False)).alias("learned"), F.col(text_col).alias("text"))
    training = rows.where("learned")
    counts = written(training.select("text").mapInArrow(_counted, "hash long, cls int, n long").groupBy("hash").agg(F.min("cls").alias("cls"), F.sum("n").alias("n")), "counts")
    v = vocabulary(counts, training.count())
    shared = spark.sparkContext.broadcast(v)
    kind = dict(rows.dtypes)["id"]
    names = ["id", "learned", "n_tokens", "symbols", "base", "inner", "n_known", "rest"]
    schema = f"id {kind}, learned boolean, n_tokens long, symbols binary, base double, inner double, n_known long, rest array<struct<hash: bigint, cls: int, n: bigint>>"
    coded = written(rows.mapInArrow(_coder(shared, names), schema).withColumn("row", F.monotonically_increasing_id()), "coded")
    model = spark.sparkContext.broadcast(baum_welch(coded.where("learned"), v.share, states, rounds))

    def likelihood(batches):
        for batch in batches:
            logs = model.value.likelihood(_texts(batch.column(3))) / np.log(10)
            kept = [i for i in range(batch.num_columns) if i != 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(logs)], names=["id", "learned", "n_tokens", "base", "inner", "n_known", "row", "log"])

    scored = coded.select("id", "learned", "n_tokens", "symbols", "base", "inner", "n_known", "row").mapInArrow(likelihood, f"id {kind}, learned boolean, n_tokens long, base double, inner double, n_known long, row long, log double")
    totals = F.element_at(F.array(*map(F.lit, v.class_total.tolist())), F.col("cls") + 1)
    all_ = v.tokens + ADDED * (v.distinct + 1)
    other = coded.where("size(rest) > 0").select("row", F.explode("rest").alias("w")).select("row", "w.*").join(counts.select("hash", F.col("n").alias("c")), "hash", "left")
    c = F.coalesce("c", F.lit(0))
    sums = other.groupBy("row").agg(F.sum(F.col("n") * F.log10((c + ADDED) / all_)).alias("base2"), F.sum(F.col("n") * F.log10((c + ADDED) / totals)).alias("inner2"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known2"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    end = float(np.log10((v.texts + ADDED) / all_))
    return scored.join(sums, "row", "left").select(
        "id", "learned", "n_tokens", (F.col("n_known") + zero("known2") + int(v.texts > 0)).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2") + end).alias("base_score"), (F.col("log") + F.col("inner") + zero("inner2")).alias("score"),
    )
