"""Language identification by a convolutional network over bytes, in numpy.

A text is cut into windows of ``WINDOW`` bytes, folded to letters and white space. Filters of several widths slide over
each window, the largest response of each filter over the window goes through a rectifier into a softmax over the
languages. A document's distribution is that of its windows, weighted by their letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.memory import tidy
from loomspan.llm.words import pieces, raw

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
#: Filters of each width.
FILTERS = 8
#: Labelled rows of each language, and windows of each row, that the network is fitted on.
ROWS, ROW_WINDOWS = 800, 2
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.02, 7
#: Rows of all languages together that it is fitted on, at least one each: many languages share them.
MOST_ROWS = 50_000

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[0x80:0x9F] += 0x20  # the second byte of Latin capitals to that of their small letters
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded windows of all rows, white space behind the last of each, and the row that each belongs to."""
    sizes = np.diff(offsets)
    many = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), many)
    first = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[:-1][row] + first * WINDOW
    place = start[:, None] + np.arange(WINDOW)
    inside = place < offsets[1:][row][:, None]
    folded = np.append(_FOLD[data], np.uint8(0x20))
    return folded[np.where(inside, place, len(data))], row


def trigrams_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of folded windows ``x`` as numbers, and whether a letter stands in their middle."""
    wide = x.astype(np.int32)
    return wide[:, :-2] << 16 | wide[:, 1:-1] << 8 | wide[:, 2:], x[:, 1:-1] != 0x20


class Network:
    """Filters ``w[k, byte, filter]`` of the widest width with zeros beyond each filter's own, and the softmax on top."""

    def __init__(self, classes: list[str], rng: np.random.Generator):
        self.classes, total = classes, FILTERS * len(WIDTHS)
        self.used = np.repeat(np.array(WIDTHS), FILTERS)[None, :] > np.arange(max(WIDTHS))[:, None]
        self.w = (rng.normal(0, 0.3, (max(WIDTHS), 256, total)) * self.used[:, None, :]).astype(np.float32)
        self.bias = np.zeros(total, np.float32)
        self.top = rng.normal(0, 0.3, (total, len(classes))).astype(np.float32)
        self.base = np.zeros(len(classes), np.float32)
        self.seen = np.zeros(0, np.int32)  # trigrams of the windows that it is fitted on

    def prepared(self) -> Network:
        """Adds tables of the filters over pairs of bytes."""
        w = self.w
        self.pairs = [(w[k][:, None, :] + w[k + 1][None, :, :]).reshape(1 << 16, -1) for k in (0, 2)]
        return self

    def known(self, x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """For each of ``rows`` texts, with windows ``x`` of texts ``row``, the share of its trigrams that learning met."""
        table = np.zeros(1 << 24, bool)
        table[self.seen] = True
        met, every = np.zeros(rows), np.zeros(rows)
        for i in range(0, len(x), 4096):
            code, inside = trigrams_of(x[i : i + 4096])
            met += np.bincount(row[i : i + 4096], (table[code] & inside).sum(axis=1), rows)
            every += np.bincount(row[i : i + 4096], inside.sum(axis=1), rows)
        return met / np.maximum(every, 1)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """The filters' responses at all places of windows ``x``; places over the end see white space."""
        wide = np.concatenate([x, np.full((len(x), max(WIDTHS) - 1), 0x20, np.uint8)], axis=1)
        pair = wide[:, :-1].astype(np.int32) << 8 | wide[:, 1:]
        n = x.shape[1]
        out = np.take(self.pairs[0], pair[:, :n], axis=0)
        out += np.take(self.pairs[1], pair[:, 2 : n + 2], axis=0)
        out += np.take(self.w[4], wide[:, 4 : n + 4], axis=0)
        return out

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(x).max(axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.hidden(x) @ self.top + self.base)

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Network:
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self._weights().items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                own = order[at : at + BATCH]
                for k, g in self._gradients(x[own], y[own], rng).items():
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    weight = self._weights()[k]
                    weight -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) * (1 - 0.9 * step / (EPOCHS * len(x) / BATCH + 1))
        return self

    def _weights(self) -> dict[str, np.ndarray]:
        return {"w": self.w, "bias": self.bias, "top": self.top, "base": self.base}

    def _gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        wide = np.concatenate([x, np.full((len(x), max(WIDTHS) - 1), 0x20, np.uint8)], axis=1)
        n = x.shape[1]
        response = np.take(self.w[0], wide[:, :n], axis=0)  # the weights change with every batch: no tables
        for k in range(1, max(WIDTHS)):
            first = FILTERS * sum(width <= k for width in WIDTHS)  # narrower filters have no weights here
            response[:, :, first:] += np.take(self.w[k][:, first:], wide[:, k : n + k], axis=0)
        at = response.argmax(axis=1)
        pooled = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0, :] + self.bias
        keep = (rng.random(pooled.shape) > 0.3) / np.float32(0.7)
        h = np.maximum(pooled, 0) * keep
        error = _softmax(h @ self.top + self.base)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.top.T) * keep * (pooled > 0)
        grad = np.zeros_like(self.w)
        filters = np.broadcast_to(np.arange(back.shape[1]), back.shape)
        for k in range(max(WIDTHS)):
            seen = wide[np.arange(len(x))[:, None], at + k]
            np.add.at(grad[k], (seen, filters), back * self.used[k])
        return {"w": grad, "bias": back.sum(axis=0), "top": h.T @ error, "base": error.sum(axis=0)}


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, rows: int = ROWS) -> Network | None:
    """The network fitted on at most ``rows`` rows of each language of ``labelled`` (text, lang, and a hash ``h``).

    Every language that labels a text is learned. The rows with the smallest share of hashes are taken, a sample bounded
    by ``rows`` a language and ``MOST_ROWS`` in all; windows are drawn from anywhere in them. None if nothing is labelled.
    """
    some = labelled.where("lang is not null and text is not null and length(text) > 0")
    counts = some.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not counts:
        return None
    rows = max(1, min(rows, MOST_ROWS // len(counts)))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * rows / r["n"] + 20 / r["n"]))))
    taken = some.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20))
    spots = [F.expr(f"substring(text, 1 + cast(pmod(xxhash64(h, {i}), greatest(1, length(text) - {WINDOW} + 1)) as int), {WINDOW})") for i in range(ROW_WINDOWS)]
    # Rows with one hash, such as those of one id, are cut before they are collected.
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", F.xxhash64("text"))
    taken = taken.withColumn("r", F.row_number().over(first)).where(f"r <= {rows}")
    found = taken.select("lang", "h", F.array(*spots).alias("spots")).collect()  # bounded by rows, languages and windows
    rng = np.random.default_rng(SEED)
    classes = sorted(r["lang"] for r in counts)
    x, y, of = [], [], dict.fromkeys(classes, 0)
    for r in sorted(found, key=lambda r: (r["lang"], r["h"] & (1 << 20) - 1, r["h"], r["spots"])):
        if of[r["lang"]] < rows:
            of[r["lang"]] += 1
            for spot in set(r["spots"]):
                got, _ = windows_of(np.frombuffer(spot.encode(), np.uint8), np.array([0, min(WINDOW, len(spot.encode()))]))
                x.append(got)
                y += [classes.index(r["lang"])] * len(got)
    net = Network(classes, rng)
    if x:
        code, inside = trigrams_of(np.concatenate(x))
        net.seen = np.unique(code[inside])
    if len(classes) > 1:
        x, y = np.concatenate(x), np.array(y)
        short = x.copy()  # short texts are windows that are mostly white space
        for i, n in enumerate(rng.integers(12, 120, len(short))):
            short[i, n:] = 0x20
        net.fit(np.concatenate([x, short]), np.concatenate([y, y]), rng)
    return net


def predict(documents: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(id, lang_pred, score)`` of every row, from the whole text; with ``carry``, also text, those columns, and ``known``,
    the share of the text's trigrams that learning met: scores only compare the learned languages.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for null texts and texts without a letter. Repeated
    rows and null ids stay.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(carry or []))
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        known = shared.value
        known = known.prepared() if known else None
        for batch in batches:
            langs, scores, met = [], [], []
            texts = batch.column(1)
            data, offsets = raw(texts)
            for a, b in pieces(offsets):
                part = offsets[a : b + 1]
                own = data[part[0] : part[-1]]
                x, row = windows_of(own, part - part[0])
                if not known or not len(x):
                    langs += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    met += [0.0] * (b - a)
                    continue
                p = np.concatenate([known.probabilities(x[i : i + 128]) for i in range(0, len(x), 128)])
                met += known.known(x, row, b - a).tolist() if carry else []
                weight = (x != 0x20).sum(axis=1) + 1e-3
                total = np.zeros((b - a, len(known.classes)))
                np.add.at(total, row, p * weight[:, None])
                some = np.zeros(b - a, bool)
                letters = np.add.reduceat(np.append(_ASCII_LETTER[own], False), np.minimum(part[:-1] - part[0], len(own))) > 0
                for i in range(b - a):
                    if part[i] == part[i + 1]:
                        continue
                    some[i] = letters[i] or any(c.isalpha() for c in texts[a + i].as_py())
                best = total.argmax(axis=1)
                sure = total[np.arange(b - a), best] / np.maximum(total.sum(axis=1), 1e-12)
                langs += [known.classes[k] if s else "und" for k, s in zip(best, some, strict=True)]
                scores += np.where(some, np.clip(sure, 0, 1), 0.0).tolist()
            columns = [*batch.columns[:2], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(met, pa.float64()), *batch.columns[2:]] if carry else [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "lang_pred", "score", "known", *carry] if carry else ["id", "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(tidy(score), ", ".join([f"id {kinds['id']}", *(["text string"] if carry else []), "lang_pred string", "score double", *(["known double"] if carry else []), *(f"`{c}` {kinds[c]}" for c in carry or [])]))


def identify(documents: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learns from labelled documents with crc32(doc_id) mod 3 other than 1.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing is labelled. Rows with a
    null id are not learned from and not held out; repeated rows and ids stay, ties go to the language that sorts first,
    very long texts are read whole, columns of any other name are not read, and an empty table gives an empty one.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    labelled = documents.where(fold != 1).select("text", "lang", F.xxhash64("doc_id").alias("h"))
    out = predict(documents, train(labelled))
    return out.select(F.col("id").alias("doc_id"), (F.coalesce(F.crc32(F.col("id").cast("string")) % 3, F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")
