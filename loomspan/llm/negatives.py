"""Hard-negative mining with lists that the anchors of a cluster share.

Anchors are clustered by direction. For each cluster all candidates are sorted once by what a member can score with them
at most: the candidate's length times the cosine of its angle to the centre, less the widest angle of a member. Every
member walks that list from its head until what is left can no longer change its result, which the bound at the place
reached proves; only then it stops, so results are exact whatever the data. The list is cut into rows of ``ROW``
candidates, and members are packed, so that a step of the walk is one product of matrices. Members walk in rounds of
growing stretches; who is done leaves, and the next round is a join of the remaining members with the next stretch.

There are two walks: the first finds each anchor's positives, the second the negatives in the band of scores that each
positive sets. Scores are integers, computed exactly: in doubles where no product can reach 2^53, else in 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.tables import written

#: Anchors that place the clusters, members that a cluster should have, the most clusters, and rounds of k-means.
SAMPLE, MEMBERS, CLUSTERS, ROUNDS, SEED = 20_000, 64, 8, 8, 11
#: Candidates of a row of a list, members of a pack, and parts into which a list is dealt.
ROW, PACK, PARTS = 1024, 256, 32
#: Shares of a list that have been walked after each round.
STRETCHES = (1 / 32, 1 / 4, 1.0)
#: Components are held to this, so that scores fit 64 bits.
LARGEST = 1 << 27
#: Below any score.
_NONE = -(1 << 62)


def _vectors(column) -> np.ndarray:
    """Rows of 32-bit components from binary values, as doubles."""
    n = len(column)
    data = b"".join(x.as_py() for x in column)
    return np.frombuffer(data, np.int32).reshape(n, -1).astype(np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if len(a) and len(b) and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) >= 2.0**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def _best(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int):
    """Rows and columns of the k best of each row among those that fit, ties to the smaller id; in this order."""
    masked = np.where(fits, scores, np.iinfo(np.int64).min)
    if masked.shape[1] > k:
        fits = fits & (masked >= np.partition(masked, masked.shape[1] - k, axis=1)[:, -k][:, None])
    rows, cols = np.nonzero(fits)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label"
) -> DataFrame:
    """``(anchor, positive, rank, negative, positive_score, negative_score)``: hard negatives of each anchor and positive.

    Vectors are arrays of whole numbers. An anchor's positives are its best ``positives`` other rows of its label by inner
    product, ties by smaller id. For each, the first ``negatives`` rows of other labels are given whose score, times
    100, lies between ``least`` and ``most`` times the positive's. Rows with a null id, label, vector or component take
    no part; a vector shorter than the longest counts as filled up with zeros; components beyond 2^27 count as that. Ids
    are whole numbers; of rows that share id, vector and label one counts. Zero vectors score 0 with all. An anchor
    without other rows of its label gives nothing, and an empty table an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "anchor long, positive long, rank int, negative long, positive_score long, negative_score long"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), is_anchor.alias("anchor"))
    fine = own.where("id is not null and label is not null and v is not null and not exists(v, x -> x is null)")
    width = fine.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if width is None:
        return spark.createDataFrame([], schema)
    held = F.transform("v", lambda x: F.least(F.greatest(x, F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    filled = fine.withColumn("v", F.concat(held, F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    rows = written(filled.mapInArrow(_packed, "id long, label long, v binary, anchor boolean"), "rows")
    # Of equal vectors with one label only the smallest ids can be among the first; one more, as an anchor is not its own.
    first = Window.partitionBy("v", "label").orderBy("id")
    candidates = rows.select("id", "label", "v").distinct().withColumn("r", F.row_number().over(first)).where(f"r <= {max(positives + 1, negatives)}").drop("r")
    members = rows.where("anchor").select("id", "label", "v").distinct()
    centres = _centres(members)
    if not len(centres):
        return spark.createDataFrame([], schema)
    members = _members(members, centres)
    lists = _lists(candidates, centres, members)
    close = _walk(members, lists, positives, None)
    # Positives of one anchor with equal scores share a band.
    wanted = close.groupBy("key").agg(F.collect_set("score").alias("wanted"))
    found = _walk(members.join(wanted, "key"), lists, negatives, (least, most))
    pairs = close.select("key", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    chosen = found.select("key", F.col("band").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    out = pairs.join(chosen, ["key", "positive_score"]).join(members.select("key", F.col("id").alias("anchor")), "key")
    return out.select("anchor", "positive", "rank", "negative", "positive_score", "negative_score")


def _packed(batches):
    for batch in batches:
        v = batch.column(2)
        flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), dtype=np.int32)
        each = flat.reshape(len(v), -1) if len(v) else flat.reshape(0, 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in each], pa.binary()), batch.column(3)], names=["id", "label", "v", "anchor"])


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def _centres(members: DataFrame) -> np.ndarray:
    """Unit centres by k-means over directions of a bounded sample of anchors. They decide how long the walks are, not what they find."""
    table = members.orderBy(F.xxhash64("id", F.lit(SEED)), "id").select("v").limit(SAMPLE).toArrow()
    if not table.num_rows:
        return np.zeros((0, 0))
    x = _units(_vectors(table.column(0)))
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(CLUSTERS, -(-len(x) // MEMBERS)), replace=False)]
    for _ in range(ROUNDS):
        of = np.argmax(x @ centres.T, axis=1)
        centres = _units(np.stack([x[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def _members(members: DataFrame, centres: np.ndarray) -> DataFrame:
    """Members with a key of their own, cluster, length and angle to the centre."""

    def place(batches):
        for batch in batches:
            v = _vectors(batch.column(2)) if batch.num_rows else np.zeros((0, centres.shape[1]))
            cosine = np.clip(_units(v) @ centres.T, -1, 1)
            of = np.argmax(cosine, axis=1)
            length = np.sqrt((v * v).sum(axis=1))
            angle = np.where(length > 0, np.arccos(cosine[np.arange(len(v)), of]), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(length), pa.array(angle)], names=["id", "label", "v", "cluster", "length", "angle"])

    placed = members.mapInArrow(place, "id long, label long, v binary, cluster int, length double, angle double")
    return written(placed.withColumn("key", F.monotonically_increasing_id()), "members")


def _lists(candidates: DataFrame, centres: np.ndarray, members: DataFrame) -> DataFrame:
    """``(cluster, bound, ids, labels, vectors, part, stretch)``: each cluster's candidates by falling bound, ``ROW`` in a row at most; ``bound`` is the first one's.

    Sorted by Spark's range partitioning; rows are cut where a task's stretch of the order or a cluster ends.
    """
    widest = np.zeros(len(centres))
    for r in members.groupBy("cluster").agg(F.max("angle").alias("a")).collect():  # one row a cluster
        widest[r["cluster"]] = r["a"]
    used = np.array(sorted(r["cluster"] for r in members.select("cluster").distinct().collect()))

    def bounds(batches):
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(2))
                angle = np.arccos(np.clip(_units(v) @ centres[used].T, -1, 1))
                length = np.sqrt((v * v).sum(axis=1))
                bound = length[:, None] * (np.cos(np.maximum(0, angle - widest[used])) + 1e-12)  # more than rounding can take
                for j, c in enumerate(used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(bound[:, j]), *batch.columns], names=["cluster", "bound", "id", "label", "v"])

    def rows(batches):
        held: list[tuple] = []

        def row(part):
            cluster, bound, ids, labels, v = part
            order = np.argsort(ids)
            return [cluster, bound[0], ids[order].tobytes(), labels[order].tobytes(), b"".join(v[j] for j in order)]

        def out(parts):
            columns = list(zip(*(row(x) for x in parts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["cluster", "bound", "ids", "labels", "vectors"])

        for batch in batches:
            cluster, bound, ids, labels = (batch.column(i).to_numpy() for i in range(4))
            v = batch.column(4).to_pylist()
            cuts = np.flatnonzero(np.diff(cluster)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                while a < b:
                    if held and (held[0] != cluster[a] or len(held[2]) >= ROW):
                        yield out([held])
                        held = []
                    take = min(b - a, ROW - (len(held[2]) if held else 0))
                    part = [int(cluster[a]), bound[a : a + take], ids[a : a + take], labels[a : a + take], v[a : a + take]]
                    held = part if not held else [held[0], np.concatenate([held[1], part[1]]), np.concatenate([held[2], part[2]]), np.concatenate([held[3], part[3]]), held[4] + part[4]]
                    a += take
        if held:
            yield out([held])

    each = candidates.mapInArrow(bounds, "cluster int, bound double, id long, label long, v binary")
    ordered = each.repartitionByRange("cluster", F.desc("bound"), "id").sortWithinPartitions("cluster", F.desc("bound"), "id")
    lists = written(ordered.mapInArrow(rows, "cluster int, bound double, ids binary, labels binary, vectors binary"), "lists")
    share = lists.groupBy("cluster").agg(F.percentile_approx(-F.col("bound"), F.array(*map(F.lit, STRETCHES[:-1])), 10_000).alias("ends"))
    ends = {r["cluster"]: [-x for x in r["ends"]] for r in share.collect()}  # one row a cluster
    limits = F.create_map(*(x for c, at in ends.items() for x in (F.lit(c), F.array(*map(F.lit, at)))))
    stretch = F.size(F.filter(limits[F.col("cluster")], lambda x: F.col("bound") < x))
    return lists.select("*", stretch.alias("stretch"), F.pmod(F.xxhash64("cluster", "bound", "ids"), F.lit(PARTS)).cast("int").alias("part"))


def _walk(members: DataFrame, lists: DataFrame, k: int, band: tuple[int, int] | None) -> DataFrame:
    """``(key, band, rank, id, score)`` for all members, from rounds over the stretches of their lists.

    Without ``band``: the k best other rows of the member's label, ``band`` is 0. With it: for each score in ``wanted``
    the k best rows of other labels from ``band[0]`` to ``band[1]`` hundredths of it; ``band`` in the result is that score.
    """
    lowest = (lambda w: F.floor(w * band[0] / 100) - 1) if band else (lambda w: F.lit(_NONE))
    wanted = F.col("wanted") if band else F.array(F.lit(0).cast("long"))
    active = members.select("key", "id", "label", "v", "cluster", "length", wanted.alias("wanted")).withColumn("floors", F.transform("wanted", lowest))
    by = Window.partitionBy("key", "band").orderBy(F.desc("score"), "id")
    best = None
    for i in range(len(STRETCHES)):
        # Each pack meets every part of its cluster's list once.
        packs = _packs(active).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        pairs = packs.join(lists.where(F.col("stretch") == i), ["cluster", "part"])
        hits = pairs.select("pack", "members", "bound", "ids", "labels", "vectors").mapInArrow(_compared(k, band), "key long, band long, id long, score long")
        every = hits if best is None else best.unionByName(hits)
        best = written(every.withColumn("rank", F.row_number().over(by)).where(f"rank <= {k}").drop("rank"), "best")
        # A member is done if what is left of its list lies below its k-th best, or below its band.
        ahead = lists.where(F.col("stretch") > i).groupBy("cluster").agg(F.max("bound").alias("bound"))
        full = best.groupBy("key", "band").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
        got = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "floor"))).alias("got"))
        floor = F.transform("wanted", lambda w: F.greatest(F.coalesce(F.try_element_at("got", w), F.lit(_NONE)), lowest(w)))
        reach = F.col("length") * F.col("bound")
        on = active.drop("floors").join(ahead, "cluster").join(got, "key", "left").withColumn("floors", floor)
        active = written(on.where(F.array_min("floors") <= reach + 1e-6 * F.abs(reach) + 1e-3).drop("got", "bound"), "active")
        if active.isEmpty():
            break
    return best.withColumn("rank", F.row_number().over(by))


def _packs(active: DataFrame) -> DataFrame:
    """``(cluster, pack, members)``: at most ``PACK`` members of a cluster in a row."""
    columns = ["key", "id", "label", "v", "length", "wanted", "floors"]

    def pack(batches):
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            for c in np.unique(cluster):
                some = np.flatnonzero(cluster == c)
                for a in range(0, len(some), PACK):
                    rows = batch.take(pa.array(some[a : a + PACK])).select(columns)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema) as stream:
                        stream.write_batch(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), rows.column(0).slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["cluster", "pack", "members"])

    dealt = active.select("cluster", *columns).repartitionByRange(max(1, -(-active.count() // (4 * PACK))), "cluster", "key")
    return written(dealt.mapInArrow(pack, "cluster int, pack long, members binary"), "packs")


class _Pack:
    """Members with what they have found so far in this task."""

    def __init__(self, data: bytes):
        table = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.keys, self.ids, self.labels, self.length = (table.column(c).to_numpy() for c in ("key", "id", "label", "length"))
        self.v = _vectors(table.column("v"))
        wanted, floors = table.column("wanted").combine_chunks(), table.column("floors").combine_chunks()
        self.sizes = np.diff(wanted.offsets.to_numpy())
        self.member = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.wanted, self.floors = wanted.flatten().to_numpy(), floors.flatten().to_numpy().copy()
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, found: tuple[np.ndarray, ...], k: int) -> None:
        """Keeps the k best of each member and band; with k of them the floor rises to the last."""
        self.found.append(found)
        slot, ids, scores = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -scores, slot))
        slot, ids, scores = slot[order], ids[order], scores[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < k
        self.found = [(slot[keep], ids[keep], scores[keep])]
        full = place == k - 1
        self.floors[slot[full]] = np.maximum(self.floors[slot[full]], scores[full])


def _compared(k: int, band: tuple[int, int] | None):
    def compare(batches):
        held: dict[int, _Pack] = {}

        def out(packs):
            parts = [(p.keys[p.member[slot]], p.wanted[slot], ids, scores) for p in packs for slot, ids, scores in p.found]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "band", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                name = batch.column(0)[row].as_py()
                if name not in held:
                    if len(held) >= 64:  # packs of a task come in any order; those that go now may come back
                        yield out(held.values())
                        held.clear()
                    held[name] = _Pack(batch.column(1)[row].as_py())
                pack = held[name]
                reach = pack.length * batch.column(2)[row].as_py()
                lowest = np.minimum.reduceat(pack.floors, np.concatenate([[0], np.cumsum(pack.sizes)[:-1]]))
                live = np.flatnonzero(lowest <= reach + 1e-6 * np.abs(reach) + 1e-3)  # others have certified that this row holds nothing for them
                if not len(live):
                    continue
                ids, labels = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in (3, 4))
                v = np.frombuffer(batch.column(5)[row].as_py(), np.int32).reshape(len(ids), -1).astype(np.float64)
                scores = _products(pack.v[live], v)
                same = pack.labels[live][:, None] == labels[None, :]
                seats = np.full(len(pack.ids), -1)
                seats[live] = np.arange(len(live))
                slots = np.flatnonzero(seats[pack.member] >= 0)
                at = seats[pack.member[slots]]
                for a in range(0, len(slots), 256):
                    some, seat = slots[a : a + 256], at[a : a + 256]
                    s = scores[seat]
                    fits = s >= pack.floors[some][:, None]
                    if band:
                        want = pack.wanted[some][:, None]
                        fits &= ~same[seat] & (100 * s >= band[0] * want) & (100 * s <= band[1] * want)
                    else:
                        fits &= same[seat] & (pack.ids[pack.member[some]][:, None] != ids[None, :])
                    if fits.any():
                        r, c = _best(s, fits, ids, k)
                        pack.add((some[r], ids[c], s[r, c]), k)
        yield out(held.values())

    return compare
