"""N-gram Jaccard join with adaptive multi-match prefixes.

Each text is a set of word shingles. All sets are ordered by one global order: by the number of documents that hold a
shingle, counted exactly, then by hash. Two sets of similarity t or more share at least o shingles, o = ceil(t * size),
so the first ``size - o + m`` of each hold at least m common ones. m = 1 gives the shortest prefix. Where a prefix holds
frequent shingles, so that it would draw many candidates, a longer one with a larger m is cheaper: each document takes
the m with the least estimated cost, and a pair must share as many prefix shingles as the smaller of its two m before
anything is verified.

Shingles that no other document holds are in no intersection. A first pass therefore counts, in packed blocks, how many
shingles of each text stand alone, and texts with too many of these, which can't have a partner, go no further; the
rest are counted and ordered exactly among themselves. Equal sets are one node.

Before candidates are paired, every node is verified against one hub it shares prefix shingles with. Nodes so connected
need no further pair among themselves; of the others, a pair has at least one end outside the largest connected part
that holds the shingle, so that large groups of near copies stay linear. No link between two components is lost, and
every surviving pair is verified on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.memory import tidy, tidy_group
from loomspan.llm.words import mixed, shingle_sets
from loomspan.operators.components import connected_components
from loomspan.operators.tables import written

#: Matches that the prefix of any set may ask for, and further ones for every so many shingles of the set.
MATCHES, MATCHES_EVERY = 4, 64
#: Shingles and texts of a chunk of the first pass, and shingles of one of its buckets.
CHUNK_SHINGLES, CHUNK_TEXTS, BUCKET = 1 << 21, 1 << 16, 1 << 20
#: Cost of verifying a candidate against that of reading one posting.
VERIFY_COST = 8.0
#: Ids for which the filter in front of the texts gets a row of 4 KB (32 bits an id), and its rows at most (8 MB).
FILTER_IDS, FILTER_ROWS = 1024, 2048
_LOW = np.uint64(0xFFFFFFFF)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _digest(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    return int(mixed(x).sum()), int(mixed(x ^ np.uint64(0x5851F42D4C957F2D)).sum())


def _digests(k: int):
    def make(batches):
        for batch in batches:
            sets = [(_digest(x), len(x)) for x in shingle_sets(batch.column(1), k)]
            both = np.array([d for d, _ in sets], dtype=np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(both[:, 0])), pa.array(_signed(both[:, 1])), pa.array([n for _, n in sets], pa.int64())], names=["id", "h1", "h2", "n"])

    return make


def _packed(chunk: str, sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One chunk's distinct shingles by bucket: those of one text with the text's number, those of several texts alone; and, in the last row, the texts' digests."""
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])[order]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    single = np.diff(np.append(first, len(tokens))) == 1
    tokens, of = tokens[first], of[first]
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # grows with the token
    low = (tokens & _LOW).astype(np.uint32)
    used, starts = np.unique(bucket, return_index=True)
    rows = []
    for b, i, j in zip(used.tolist(), starts, np.append(starts[1:], len(tokens)), strict=True):
        own = single[i:j]
        rows.append((b, low[i:j][own].tobytes(), of[i:j][own].tobytes(), low[i:j][~own].tobytes()))
    digests = np.array([(*_digest(x), len(x)) for x in sets], dtype=np.uint64)
    rows.append((buckets + int(digests[0, 0] % np.uint64(buckets)), digests.tobytes(), None, None))
    bucket, low, of, more = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([chunk] * len(rows)), *(pa.array(c, pa.binary()) for c in (low, of, more))], names=["bucket", "chunk", "tokens", "texts", "more"])


def _pack(k: int, buckets: int):
    def pack(batches):
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for x in shingle_sets(batch.column(0), k):
                if len(x):
                    held.append(x)
                    n += len(x)
                if n >= CHUNK_SHINGLES or len(held) == CHUNK_TEXTS:
                    yield _packed(f"{part}-{seq}", held, buckets)
                    held, n, seq = [], 0, seq + 1
        if held:
            yield _packed(f"{part}-{seq}", held, buckets)

    return pack


def _alone(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, its texts with shingles that occur nowhere else, and how many. Rows of digests pass."""
    chunks, texts, numbers, digests = [], [], [], []
    rows = list(zip(*(table.column(c) for c in ("chunk", "tokens", "texts", "more")), strict=True))
    for chunk, tokens, of, _ in rows:
        if not of.is_valid:
            chunks.append(chunk.as_py())
            texts.append(None)
            numbers.append(None)
            digests.append(tokens.as_py())
    rows = [r for r in rows if r[2].is_valid]
    if rows:
        single = [np.frombuffer(r[1].as_buffer(), np.uint32) for r in rows]
        every = np.sort(np.concatenate([*single, *(np.frombuffer(r[3].as_buffer(), np.uint32) for r in rows)]))
        again = every[1:] == every[:-1]
        once = every[~(np.append(False, again) | np.append(again, False))]
        for (chunk, _, of, _), own in zip(rows, single, strict=True):
            at = np.searchsorted(once, own)
            at[at == len(once)] = 0
            lone = once[at] == own if len(once) else np.zeros(len(own), bool)
            which, many = np.unique(np.frombuffer(of.as_buffer(), np.uint16)[lone], return_counts=True)
            if len(which):
                chunks.append(chunk.as_py())
                texts.append(which.tobytes())
                numbers.append(many.astype(np.uint32).tobytes())
                digests.append(None)
    return pa.Table.from_arrays([pa.array(chunks, pa.string()), *(pa.array(c, pa.binary()) for c in (texts, numbers, digests))], names=["chunk", "texts", "many", "digests"])


def _without_partner(percent: int):
    def judge(table: pa.Table) -> pa.Table:
        """The digests of a chunk's texts of which fewer than ``percent`` of a hundred shingles occur elsewhere."""
        known = [x for x in table.column("digests") if x.is_valid]
        digests = np.frombuffer(known[0].as_buffer(), np.uint64).reshape(-1, 3) if known else np.zeros((0, 3), np.uint64)
        alone = np.zeros(len(digests), np.int64)
        if known:
            for texts, many in zip(table.column("texts"), table.column("many"), strict=True):
                if texts.is_valid:
                    alone[np.frombuffer(texts.as_buffer(), np.uint16)] += np.frombuffer(many.as_buffer(), np.uint32)
        n = digests[:, 2].astype(np.int64)
        gone = digests[100 * (n - alone) < percent * n]
        return pa.Table.from_arrays([pa.array(_signed(gone[:, i])) for i in range(3)], names=["h1", "h2", "n"])

    return judge


def _lonely(docs: DataFrame, k: int, percent: int, shingles: int) -> DataFrame:
    """``(h1, h2, n)`` of sets that can have no partner but an equal set.

    A shingle travels as 32 bits beside its bucket, once a chunk however many texts hold it, so that frequent ones don't
    gather in one task. Two shingles that are taken for one, or a chunk that a repeated attempt has cut differently,
    only leave more sets to the exact count that follows.
    """
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET))
    packed = docs.where("id is not null").select("text").mapInArrow(tidy(_pack(k, buckets)), "bucket long, chunk string, tokens binary, texts binary, more binary")
    alone = packed.groupBy("bucket").applyInArrow(tidy_group(_alone), "chunk string, texts binary, many binary, digests binary")
    return alone.groupBy("chunk").applyInArrow(tidy_group(_without_partner(percent)), "h1 long, h2 long, n long").distinct()


def _perhaps(docs: DataFrame, live: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be one of ``live``: all that are, and few others, so that a join need not shuffle every text.

    Ids are bits of a filter whose size doesn't go beyond 8 MB; where it is full, more texts pass and the join decides.
    """
    rows = min(FILTER_ROWS, live.count() // FILTER_IDS + 1)
    place = F.pmod(F.xxhash64("id"), F.lit(rows << 15))
    bits = live.select(place.alias("bit")).groupBy(F.expr("bit div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits"))
    held = F.expr("bit_get(cast(conv(hex(substring(bits, cast(bit % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) = 1")
    probed = docs.withColumn("bit", place).withColumn("part", F.expr("bit div 32768"))
    return probed.join(F.broadcast(bits), "part").where(held).select(*docs.columns)


def _sets(k: int):
    """(id, text, key, h1, h2, n, times) to (key, n, times, items) where the text's set is the one that is asked for."""

    def make(batches):
        for batch in batches:
            h1, h2 = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            rows, values = [], []
            for i, x in enumerate(shingle_sets(batch.column(1), k)):
                if (np.array(_digest(x), np.uint64).view(np.int64) == (h1[i], h2[i])).all():
                    rows.append(i)
                    values.append(x)
            if rows:
                some = batch.take(pa.array(rows))
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(2), some.column(5), some.column(6), pa.ListArray.from_arrays(pa.array(cuts), pa.array(_signed(np.concatenate(values))))], names=["key", "n", "times", "items"])

    return make


def _most(n: int) -> int:
    """Matches up to which a set of n shingles answers."""
    return MATCHES + n // MATCHES_EVERY


def _prefix(n: int, df: np.ndarray, percent: int) -> tuple[int, int, int]:
    """Of a set of n shingles with counts ``df``, rising, of those that others hold too: how many of these are in the longest prefix, the length for one match, and the matches chosen."""
    overlap = -(-percent * n // 100)
    base, alone = n - overlap + 1, n - len(df)
    upto = min(n, base - 1 + _most(n)) - alone
    matches = np.arange(1, min(overlap, _most(n)) + 1)
    sums = np.concatenate([[0], np.cumsum(df)])
    # A partner of equal size must share more than the smallest one, which leaves fewer places for its matches.
    places = n - -(-2 * percent * n // (100 + percent)) + matches
    drawn = sums[np.clip(places - alone, 0, len(df))]
    cost = places + drawn * (1 + VERIFY_COST / matches**2)
    return max(0, upto), base, int(np.argmin(cost)) + 1


def _postings(percent: int):
    """(key, n, items, df) to (token, key, n, pos, entry, matches, share): one row for each shingle of the longest prefix; ``entry`` is the number of matches from which it counts."""

    def make(batches):
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for key, n, items, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                df = df.values.to_numpy()
                m, base, matches = _prefix(n, df, percent)
                pos = np.arange(n - len(df), n - len(df) + m)
                row = (items.values.to_numpy()[:m], np.full(m, key), np.full(m, n), pos, np.maximum(1, pos - base + 2), np.full(m, matches), np.full(m, 255 * len(df) // n))
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["token", "key", "n", "pos", "entry", "matches", "share"])

    return make


def _may_link(n_a: str, n_b: str, matches: str, percent: int) -> str:
    """Whether the sizes and c common shingles in the prefixes for ``matches`` still allow the similarity.

    The set whose prefix ends first in the global order has all other common shingles behind that prefix.
    """
    rest = [f"greatest(0, (({percent} * {n} + 99) div 100) - {matches})" for n in (n_a, n_b)]
    return f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b}) and (100 + {percent}) * (c + greatest({rest[0]}, {rest[1]})) >= {percent} * ({n_a} + {n_b})"


def _verified(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the asked similarity. ``ordered`` lacks only shingles that no other set holds."""
    side = lambda to, items, n: ordered.select(F.col("key").alias(to), F.col("items").alias(items), F.col("n").alias(n))
    both = pairs.join(side("a", "x", "na"), "a").join(side("b", "y", "nb"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("c"), (F.col("na") + F.col("nb")).alias("s")).where(f"(100 + {percent}) * c >= {percent} * s").select("a", "b")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """``(key, n, items, df)``: the shingles of each set that other sets hold too, by their number of sets; sets with too few of them have no partner and go."""
    each = sets.select("key", "n", F.explode("items").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(counts, "token").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("x"))  # no longer than the text
    return shared.where(f"100 * size(x) >= {percent} * n").select("key", "n", F.col("x.token").alias("items"), F.col("x.df").alias("df"))


def _across(shared: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) of nodes that ``first`` (node, component) doesn't connect: they share as many prefix shingles as the more modest one asks for, at places that allow the similarity."""
    open_ = written(shared.join(first.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")), "open")
    parts = open_.groupBy("token", "component").agg(F.count("*").alias("many"))
    major = parts.groupBy("token").agg(F.max(F.struct("many", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    mixed_ = written(open_.join(major.select("token", F.col("top.component").alias("major")), "token"), "mixed")
    u, v = mixed_.where("component <> major").alias("u"), mixed_.alias("v")
    asked = F.least("u.matches", "v.matches")  # both answer it, and neither draws more than it has reckoned with
    meet = (
        (F.col("u.token") == F.col("v.token"))
        & (F.col("u.component") != F.col("v.component"))
        & ((F.col("v.component") == F.col("v.major")) | (F.col("u.key") < F.col("v.key")))
        & (100 * F.least("u.n", "v.n") >= percent * F.greatest("u.n", "v.n"))
        & (F.greatest("u.entry", "v.entry") <= asked)
        # Behind each of the first m common shingles there is at most the rest of either set.
        & ((100 + percent) * (asked + F.least(F.col("u.n") - F.col("u.pos"), F.col("v.n") - F.col("v.pos")) - 1) >= percent * (F.col("u.n") + F.col("v.n")))
    )
    met = u.join(v, meet).select(F.least("u.key", "v.key").alias("a"), F.greatest("u.key", "v.key").alias("b"), asked.alias("m"))
    return met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("m").alias("m")).where("c >= m").select("a", "b")


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``(id, n_shingles, component)`` for every row.

    Two ids link when ``100 * |intersection| >= percent * |union|`` of their sets of k-word shingles; ``component`` is
    the smallest id reachable over links. A text of fewer than k words is one shingle. Null, empty and blank texts have
    an empty set, link with nothing, and are their own component. Rows with one id are one node, linked if any of
    their texts is; a null id keeps its row with a null component and links nothing. Repeated rows stay, ties in any
    order give the same result, and an empty table gives an empty one. Very long texts are one set each. Other columns
    are not read.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    listed = written(docs.mapInArrow(tidy(_digests(k)), f"id {kind}, h1 long, h2 long, n long"), "digests")
    digest = ["h1", "h2", "n"]
    rows = listed.where("n > 0 and id is not null").groupBy(*digest, "id").agg(F.count("*").alias("times"))
    nodes = written(rows.groupBy(*digest).agg(F.min(F.struct("id", "times")).alias("x")).select(*digest, "x.id", "x.times"), "nodes")
    shingles = int(listed.agg(F.sum("n")).first()[0] or 0)

    lonely = written(_lonely(docs, k, percent, shingles), "lonely")
    # Keys are fixed by writing them. Nodes of one id with several texts have a key each.
    live = written(nodes.join(lonely, digest, "left_anti").select("id", F.monotonically_increasing_id().alias("key"), *digest, "times"), "live")
    asked = _perhaps(docs, live).join(live, "id").select("id", "text", "key", "h1", "h2", "n", "times")
    sets = written(asked.mapInArrow(tidy(_sets(k)), "key long, n long, times long, items array<bigint>"), "sets")
    sets = sets.where("times = 1").unionByName(sets.where("times > 1").dropDuplicates(["key"]))
    ordered = written(_ordered(sets, percent), "ordered")

    postings = written(ordered.mapInArrow(tidy(_postings(percent)), "token long, key long, n long, pos long, entry long, matches long, share long"), "postings")
    hubs = postings.groupBy("token").agg(F.count("*").alias("many"), F.max(F.struct("share", "key", "n")).alias("hub")).where("many > 1")
    shared = written(postings.drop("share").join(hubs.select("token", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n")), "token"), "shared")
    # Every node against the hub that it shares most with.
    met = shared.where("key <> hub").groupBy("key", "n", "hub", "hub_n").agg(F.count("*").alias("c"))
    best = met.groupBy("key", "n").agg(F.max(F.struct("c", "hub", "hub_n")).alias("best")).select(F.col("key").alias("b"), "n", F.col("best.hub").alias("a"), "best.hub_n", "best.c")
    # Written first, so that Spark knows how few these are before it plans the joins with the sets.
    tried = written(best.where(_may_link("n", "hub_n", "1", percent)).select("a", "b"), "tried")
    near = written(_verified(tried, ordered, percent), "near")
    first = written(connected_components(near), "first")
    # All pairs of nodes that are not connected yet.
    across = written(_across(shared.drop("hub", "hub_n"), first, percent), "across")
    more = _verified(across, ordered, percent)

    of_key = live.select("key", "id")
    links = near.unionByName(more).join(of_key.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(of_key.select(F.col("key").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    # An id with several texts is in the sets of all of them.
    text = F.struct(*digest)
    several = listed.where("id is not null").groupBy("id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi").select("id")
    own = rows.join(several, "id").select(*digest, F.col("id").alias("x")).join(nodes.select(*digest, F.col("id").alias("y")), digest).select("x", "y")
    joined = written(connected_components(links.unionByName(own), "x", "y"), "components")

    of_nodes = nodes.join(joined.withColumnRenamed("node", "id"), "id", "left").select(*digest, F.coalesce("component", "id").alias("component"))
    of_nodes = written(of_nodes, "of-nodes")
    out = listed.join(of_nodes, digest, "left")
    empty = listed.where("n = 0 and id is not null").select(F.col("id").alias("node")).distinct().join(joined, "node").select("node", F.col("component").alias("other"))
    out = out.join(empty, (F.col("id") == F.col("node")) & (F.col("n") == 0), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "other", "id")).alias("component"))
