"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a stretch of words: it hashes the words at some places and ignores the others, so that a
hash survives words that were substituted at ignored places. Hashes of all places of all documents meet those of the
benchmark; around every hit the two texts are laid side by side and the stretch with the best score (a point for an
equal word, ``PENALTY`` off for a different one) is the overlap.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.memory import tidy
from loomspan.llm.words import _ODD, mixed, pieces, raw, word_hashes
from loomspan.operators.tables import written

#: Masks over words: 1 is hashed, 0 ignored.
SEEDS = ("11111111", "110110111011", "101101101111", "1110010110111")
#: Items of so many words up to the longest mask are also hashed whole and whole with any one place left out; shorter ones only whole.
LEAVE_OUT = 7
PENALTY = 2.0
#: Bits of the filter of benchmark hashes.
BITS = 1 << 26
#: Hits or seeds of one hash that are compared in a task, and items that come to a document at a time.
TILE, ITEMS = 4096, 256


def masks(short: list[int]) -> list[list[int]]:
    """The places of each mask: the seeds, and for every length of a short item its whole-item masks."""
    found = [[i for i, c in enumerate(seed) if c == "1"] for seed in SEEDS]
    for n in sorted(short):
        found.append(list(range(n)))
        if n >= LEAVE_OUT:
            found += [[i for i in range(n) if i != gap] for gap in range(1, n - 1)]
    return found


def spans(short: list[int]) -> list[int | None]:
    """For each mask the length of the items that it is for; None if for all."""
    return [None] * len(SEEDS) + [n for n in sorted(short) for _ in range(n - 1 if n >= LEAVE_OUT else 1)]


def seed_hashes(words: np.ndarray, offsets: np.ndarray, mask: list[int], number: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of one mask at all places, and which places lie inside one row."""
    m, span = len(words), mask[-1] + 1
    if m < span:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(m - span + 1, np.uint64)
    for o in mask:
        total += words[o : o + len(total)] * _ODD[o]
    inside = np.ones(m, bool)
    ends = offsets[1:]
    for back in range(1, span):  # places whose mask would reach over the end of their row
        at = ends - back
        inside[at[(at >= offsets[:-1]) & (at < m)]] = False
    return mixed(total ^ np.uint64(number * 0x9E3779B97F4A7C15 & (2**64 - 1))), inside[: len(total)]


def _rows(texts: pa.Array):
    data, offsets = raw(texts)
    for a, b in pieces(offsets):
        part = offsets[a : b + 1]
        yield (a, b, *word_hashes(data[part[0] : part[-1]], part - part[0]))


def _index(short: list[int]):
    """Benchmark rows to (item, hash, pos) and, with no hash, (item, words)."""
    found, only = masks(short), spans(short)

    def index(batches):
        for batch in batches:
            items, hashes, places, lists = [], [], [], []
            for a, b, words, cuts in _rows(batch.column(1)):
                for i in range(a, b):
                    own = words[cuts[i - a] : cuts[i - a + 1]]
                    key = batch.column(0)[i].as_py()
                    items.append(key)
                    hashes.append(None)
                    places.append(None)
                    lists.append(own.view(np.int64).tolist())
                    for number, mask in enumerate(found):
                        if only[number] not in (None, len(own)):
                            continue
                        got, _ = seed_hashes(own, np.array([0, len(own)]), mask, number)
                        items += [key] * len(got)
                        hashes += got.view(np.int64).tolist()
                        places += range(len(got))
                        lists += [None] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(items, batch.column(0).type), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["item", "hash", "pos", "words"])

    return index


def _probe(short: list[int], filter_):
    """Documents to (id, key, hashes, places, words) where any hash passes the filter."""
    found = masks(short)

    def probe(batches):
        bits = filter_.value
        for batch in batches:
            rows, hashes, places, lists = [], [], [], []
            for a, b, words, cuts in _rows(batch.column(1)):
                hits, at = [], []
                for number, mask in enumerate(found):
                    got, inside = seed_hashes(words, cuts, mask, number)
                    bit = got & np.uint64(BITS - 1)
                    passed = np.flatnonzero(inside & ((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool))
                    hits.append(got[passed])
                    at.append(passed)
                hits, at = np.concatenate(hits), np.concatenate(at)
                row = np.searchsorted(cuts, at, side="right") - 1
                for r in np.unique(row):
                    own = row == r
                    rows.append(a + int(r))
                    hashes.append(hits[own].view(np.int64).tolist())
                    places.append((at[own] - cuts[r]).tolist())
                    lists.append(words[cuts[r] : cuts[r + 1]].view(np.int64))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            keys = [uuid.uuid4().hex for _ in rows]
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int64()))], names=["id", "key", "hashes", "places", "words"])

    return probe


def overlap(words: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Start in the document, length and equal words of the best stretch with the item laid from word ``diagonal`` on; of equal scores, that with most equal words."""
    a, b = max(0, -diagonal), min(len(item), len(words) - diagonal)
    if a >= b:
        return 0, 0, 0
    same = words[diagonal + a : diagonal + b] == item[a:b]
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -PENALTY))])
    low = np.minimum.accumulate(sums)
    first = np.searchsorted(-low, -low)  # for each end, the first place of the lowest sum before it
    ends = np.flatnonzero(sums - low == (sums - low).max())
    counts = np.concatenate([[0], np.cumsum(same)])
    end = int(ends[np.argmax((counts[ends] - counts[first[ends]]))])
    start = int(first[end])
    return diagonal + a + start, end - start, int(counts[end] - counts[start])


def _verify(min_share: float, min_words: int):
    """(id, words, items) to (id, of, start_word, ...) for each item of the list that overlaps."""

    def verify(batches):
        for batch in batches:
            rows, texts, starts, lengths, equal, shares = [], [], [], [], [], []
            for i in range(batch.num_rows):
                words = np.asarray(batch.column(1)[i].values)
                for asked in batch.column(2)[i]:
                    item = np.asarray(asked["item_words"].values)
                    best = max((overlap(words, item, int(d)) for d in np.asarray(asked["diagonals"].values)), key=lambda x: (x[2], -x[1], -x[0]), default=(0, 0, 0))
                    share = best[2] / max(1, len(item))
                    if best[2] >= min(min_words, len(item)) and (share >= min_share or best[2] >= 4 * min_words):
                        rows.append(i)
                        texts.append(asked["text"].as_py())
                        for to, x in zip((starts, lengths, equal, shares), (*best, share), strict=True):
                            to.append(x)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(equal, pa.int64()), pa.array(shares, pa.float64())], names=["id", "of", "start_word", "n_words", "n_equal", "item_share"])

    return verify


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_share: float = 0.5, min_words: int = 6) -> DataFrame:
    """``(id, item, start_word, n_words, n_equal, item_share)``: each document and benchmark item that overlap, with their best stretch.

    A pair counts if its stretch has ``min_words`` equal words that are ``min_share`` of the item's words or four times
    ``min_words``. An item of fewer words counts where all of its words stand in a row; one of ``LEAVE_OUT`` words or more
    may have any one inner word substituted, and from the longest mask on whatever a seed survives. Words are split at
    ASCII white space, A-Z lower-cased. Null, empty and blank texts or items meet nothing; an item with a null id counts
    as item null; of several items with one text, and of rows with one item id, each is met; repeated documents give
    repeated rows, very long ones are read whole; either table may be empty. Other columns are not read. The benchmark's
    hashes reach executors only as a filter of fixed size; what passes it is joined exactly.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    kinds = {c: t for c, t in (*docs.dtypes, *bench.dtypes)}
    n_words = F.size(F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"))
    short = [r["n"] for r in bench.where("text is not null").select(n_words.alias("n")).where(f"n > 0 and n < {max(map(len, SEEDS))}").distinct().collect()]  # a few lengths
    index = written(bench.mapInArrow(tidy(_index(short)), f"item {kinds['item']}, hash long, pos int, words array<bigint>"), "seeds")
    seeds = index.where("hash is not null").select("item", "hash", "pos")
    place = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    parts = seeds.select(place.alias("bit")).distinct().groupBy(F.expr("bit div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for part in parts:
        bits[part["part"] * 4096 : (part["part"] + 1) * 4096] = np.frombuffer(part["bits"], np.uint8)
    filter_ = documents.sparkSession.sparkContext.broadcast(bits)
    probed = written(docs.mapInArrow(tidy(_probe(short, filter_)), f"id {kinds['id']}, key string, hashes array<bigint>, places array<int>, words array<bigint>"), "probed")
    hits = probed.select("key", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("key", F.col("h.hashes").alias("hash"), F.col("h.places").alias("at"))
    # Items with the same words are laid once; whoever has one has all of them.
    texts = index.where("words is not null").select("item", F.col("words").alias("item_words"), F.sha2(F.to_json("words"), 256).alias("text"))
    of_text = texts.select("item", "text")
    one = written(texts.groupBy("text").agg(F.first("item_words").alias("item_words")), "texts")
    seeds = written(seeds.join(of_text.withColumnRenamed("item", "own"), F.col("item").eqNullSafe(F.col("own"))).select("text", "hash", "pos").distinct(), "seeds")
    # A hash of many documents and items is cut into tiles, so that no key is one task.
    pairs = _met(hits, seeds).groupBy("key", "text").agg(F.collect_set(F.col("at") - F.col("pos")).alias("diagonals"))
    # The words of a document go with it once: its items come as a list of bounded parts.
    part = F.floor((F.row_number().over(Window.partitionBy("key").orderBy("text")) - 1) / ITEMS)
    asked = pairs.join(one, "text").withColumn("part", part).groupBy("key", "part").agg(F.collect_list(F.struct("text", "item_words", "diagonals")).alias("items"))
    laid = asked.join(probed.select("id", "key", "words"), "key").select("id", "words", "items")
    found = laid.mapInArrow(tidy(_verify(min_share, min_words)), f"id {kinds['id']}, of string, start_word long, n_words long, n_equal long, item_share double")
    return found.join(of_text, found["of"] == of_text["text"]).select("id", "item", "start_word", "n_words", "n_equal", "item_share")


def _met(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(key, text, at, pos)`` of hits and seeds with the same hash. A hash of more than ``TILE`` of either is dealt: its hits into blocks, each of which meets every block of its seeds."""
    blocks = lambda df, n: df.groupBy("hash").agg(F.ceil(F.count("*") / TILE).alias(n)).where(f"{n} > 1")
    one = F.lit(1).cast("long")
    x, y = blocks(hits, "x"), blocks(seeds, "y")
    sized = lambda df: df.join(x, "hash", "left").join(y, "hash", "left").withColumns({"x": F.coalesce("x", one), "y": F.coalesce("y", one)})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = sized(hits).select("key", "hash", "at", F.pmod(F.xxhash64("key", "at"), "x").alias("i"), each("y").alias("j"))
    right = sized(seeds).select("text", "hash", "pos", F.pmod(F.xxhash64("text", "pos"), "y").alias("j"), each("x").alias("i"))
    return left.join(right, ["hash", "i", "j"]).select("key", "text", "at", "pos")
