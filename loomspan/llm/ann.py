"""Approximate nearest neighbours: a tree of k-means, searched best bin first.

The tree is fitted on a bounded sample and every row is put into one of its leaves. A query walks the tree with a
priority queue of branches by the distance of their centres and so lists leaves in the order in which they promise
most. How many it visits is calibrated: for some rows that did not fit the tree the true neighbours are found by
comparing with all rows, and the visits widen until the leaves seen hold the asked share of them; at the widest all
leaves are visited and the search is exact. A query's first leaves give it a floor; of the others those are passed over
whose centre and radius leave nothing above it. A query goes once to a shard of neighbouring leaves, not to every leaf.
For the largest inner product, vectors get one more component that makes them equally long, and queries a zero.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.tables import written

#: Rows that fit the tree, its branching, vectors that a leaf should hold, and rounds of k-means.
SAMPLE, BRANCHES, LEAF, ROUNDS, SEED = 20_000, 8, 100, 8, 3
#: Rows that calibrate the visits, and the share of their true neighbours that the visited leaves must hold.
CALIBRATION, RECALL = 200, 0.94
#: Vectors or queries that are compared at a time.
CHUNK = 8192
#: Leaves of a query that are searched first, and leaves of a shard.
FIRST, SHARD = 8, 16


class Tree:
    """Nodes with their children, the centres of these, and the number of the leaf (-1: inner node)."""

    def __init__(self, x: np.ndarray, leaves: int, longest: float):
        self.scale, self.children, self.centres, self.leaf, self.leaves = longest * (1 + 1e-9), [], [], [], 0
        self._grow(self.points(x), max(4, len(x) // max(1, leaves)), np.random.default_rng(SEED))

    def _grow(self, x: np.ndarray, size: int, rng: np.random.Generator) -> int:
        node = len(self.children)
        self.children.append([])
        self.centres.append(None)
        self.leaf.append(-1)
        parts = []
        if len(x) > size:
            k = int(min(BRANCHES, -(-len(x) // size)))
            centres = x[rng.choice(len(x), k, replace=False)]
            for _ in range(ROUNDS):
                of = _nearest(x, centres)
                centres = np.stack([x[of == j].mean(axis=0) if (of == j).any() else x[rng.integers(len(x))] for j in range(k)])
            of = _nearest(x, centres)
            parts = [j for j in range(k) if (of == j).any()]
        if len(parts) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return node
        self.centres[node] = centres[parts]
        self.children[node] = [self._grow(x[of == j], size, rng) for j in parts]
        return node

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])

    def leaf_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, and how far it is from that leaf's centre."""
        out, far = np.zeros(len(x), np.int32), np.zeros(len(x))
        work = [(0, np.arange(len(x)))]
        points = self.points(x)
        while work:
            node, rows = work.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            of = _nearest(points[rows], self.centres[node])
            far[rows] = np.sqrt(((points[rows] - self.centres[node][of]) ** 2).sum(axis=1))
            work += [(child, rows[of == j]) for j, child in enumerate(self.children[node]) if (of == j).any()]
        return out, far

    def visits(self, query: np.ndarray, most: int) -> tuple[list[int], list[float]]:
        """The first ``most`` leaves, best bin first, and the inner product of the query's direction with their centres."""
        q = np.append(query / np.sqrt(query @ query), 0.0)
        queue, found, near = [(0.0, 0, 1.0)], [], []
        while queue and len(found) < most:
            _, node, product = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                near.append(product)
                continue
            centres = self.centres[node]
            products = centres @ q
            for d, p, child in zip((centres * centres).sum(axis=1) - 2 * products, products, self.children[node], strict=True):
                heapq.heappush(queue, (float(d), child, float(p)))
        return found, near


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that take part, each row once: none null or zero, no null or non-finite component; filled up with zeros to the longest."""
    some = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = some.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        zero = F.lit(0).cast(fine.schema["v"].dataType.elementType)
        fine = fine.withColumn("v", F.concat("v", F.array_repeat(zero, F.lit(sizes["b"]) - F.size("v"))))
    return fine.distinct()


def _best(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Rows, columns and exact scores of the k best of each row of ``scores`` that reach its floor, ties to the smaller id."""
    n = scores.shape[1]
    least = np.full(len(scores), -np.inf) if floor is None else floor
    if n > k:
        least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
    rows, cols = np.nonzero(scores >= (least - 1e-9 * np.maximum(1.0, np.where(np.isfinite(least), np.abs(least), 0)))[:, None])
    exact = (vectors[cols] * queries[rows]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
    order = np.lexsort((ids[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    if floor is not None:
        keep &= exact >= floor[rows]
    return rows[keep], cols[keep], exact[keep]


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: for each row with ``is_query`` its k neighbours of largest inner product.

    The query's own row is no neighbour of its own. Ties go to the smaller id; fewer than k candidates are all given.
    Equal vectors are searched once, and of each only the k + 1 smallest ids can be neighbours, so that copies cost
    nothing; all queries get their rows. Ids are integers. A row that is there more than once counts once; an id with
    several vectors is searched with each, and none of them is a neighbour of another. A vector shorter than the longest
    counts as filled up with zeros. Rows with a null id, or whose vectors can't take part (null, empty, zero, with null or
    non-finite components), give and get nothing. An empty table gives an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    kinds = dict(rows.dtypes)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("s")).first()
    out = "query_id long, rank int, id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], out)
    first = Window.partitionBy("v").orderBy("id")
    distinct = rows.withColumn("r", F.row_number().over(first)).where(f"r <= {k + 1}")

    trial = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(CALIBRATION).toArrow()
    apart = trial.column("id").to_pylist() if stats["n"] >= 4 * CALIBRATION else []  # they don't fit the tree, unless there are hardly others
    limit = min(1.0, 1.1 * SAMPLE / stats["n"])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(limit * (1 << 30))).where(~F.col("id").isin(apart)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    tree = Tree(_matrix(sample.column("v").combine_chunks()), -(-stats["n"] // LEAF), float(np.sqrt(stats["s"])))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            leaf, far = shared.value.leaf_of(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(far), *batch.columns], names=["leaf", "far", "id", "v"])

    index = written(distinct.select("id", "v").mapInArrow(place, f"leaf int, far double, id {kinds['id']}, v {kinds['v']}"), "index")
    most = _calibrated(index, tree, trial, k)
    radius = np.full(tree.leaves, -np.inf)
    for r in index.groupBy("leaf").agg(F.max("far").alias("far")).collect():  # no more leaves than the sample has rows
        radius[r["leaf"]] = r["far"]
    radii = spark.sparkContext.broadcast(radius)

    queries = rows.where(is_query(F.col("id"))).withColumn("key", F.monotonically_increasing_id())
    reps = written(queries.groupBy("v").agg(F.min("id").alias("rep")), "reps")

    def route(early: bool):
        def by_shard(batches):
            """(rep, q, floor) to one row for each shard that holds leaves to visit."""
            for batch in batches:
                q, floors = _matrix(batch.column(1)), batch.column(2).to_numpy()
                at, shards, lists = [], [], []
                for i, x in enumerate(q):
                    leaves, near = shared.value.visits(x, min(FIRST, most) if early else most)
                    if not early:
                        bound = np.sqrt(x @ x) * shared.value.scale * (np.array(near[FIRST:]) + radii.value[leaves[FIRST:]])
                        leaves = [leaf for leaf, b in zip(leaves[FIRST:], bound, strict=True) if b >= floors[i] - 1e-9 * max(1.0, abs(b))]
                    of: dict[int, list[int]] = {}
                    for leaf in leaves:
                        of.setdefault(leaf // SHARD, []).append(leaf)
                    at += [i] * len(of)
                    shards += of.keys()
                    lists += of.values()
                row = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(lists, pa.list_(pa.int32())), *(c.take(row) for c in batch.columns)], names=["shard", "leaves", "rep", "q", "floor"])

        return by_shard

    routed = f"shard int, leaves array<int>, rep {kinds['id']}, q {kinds['v']}, floor double"
    low = F.lit(float("-inf"))
    by_rep = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    begun = reps.select("rep", "v", low.alias("floor")).mapInArrow(route(early=True), routed)
    early = written(_compared(begun, index, k), "early")
    floor = early.withColumn("r", F.row_number().over(by_rep)).where(f"r = {k + 1}").select("rep", F.col("score").alias("floor"))
    bounded = reps.join(floor, "rep", "left").select("rep", "v", F.coalesce("floor", low).alias("floor"))
    later = written(bounded.mapInArrow(route(early=False), routed), "routed")
    found = early.unionByName(_compared(later, index, k))
    best = found.withColumn("r", F.row_number().over(by_rep)).where(f"r <= {k + 1}").select("rep", "id", "score")
    every = queries.select("key", F.col("id").alias("query_id"), "v").join(reps, "v").select("key", "query_id", "rep")
    by_query = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    ranked = every.join(best, "rep").where("id <> query_id").withColumn("rank", F.row_number().over(by_query)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "id", "score")


def _compared(routed: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``(rep, id, score)``: for each query and shard the k + 1 best of the leaves to visit that reach the query's floor. Large shards and shards of many queries are compared in blocks."""
    vectors = index.select((F.col("leaf") / SHARD).cast("int").alias("shard"), "leaf", "id", "v")
    parts = vectors.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).alias("vs")).join(routed.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).alias("qs")), "shard")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = routed.join(parts, "shard").select("shard", "leaves", "rep", "q", "floor", F.pmod(F.xxhash64("rep"), "qs").alias("qb"), each("vs").alias("vb"))
    right = vectors.join(parts, "shard").select("shard", "leaf", "id", "v", F.pmod(F.xxhash64("id"), "vs").alias("vb"), each("qs").alias("qb"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        reps, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            q, v, own = _matrix(a.column("q").combine_chunks()), _matrix(b.column("v").combine_chunks()), b.column("id").to_numpy()
            names, floor, leaf = a.column("rep").to_numpy(), a.column("floor").to_numpy(), b.column("leaf").to_numpy()
            lists = a.column("leaves").combine_chunks()
            asked = np.zeros((len(q), SHARD), bool)
            asked[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy() % SHARD] = True
            for x in np.unique(leaf):
                some, here = np.flatnonzero(asked[:, x % SHARD]), np.flatnonzero(leaf == x)
                for at in range(0, len(some), 1024):
                    part = some[at : at + 1024]
                    row, col, exact = _best(q[part] @ v[here].T, own[here], q[part], v[here], k + 1, floor[part])
                    reps.append(names[part[row]])
                    ids.append(own[here[col]])
                    scores.append(exact)
        reps, ids, scores = map(np.concatenate, (reps, ids, scores))
        order = np.lexsort((ids, -scores, reps))
        reps, ids, scores = reps[order], ids[order], scores[order]
        keep = np.arange(len(reps)) - np.searchsorted(reps, reps) <= k
        return pa.Table.from_arrays([pa.array(x[keep]) for x in (reps, ids, scores)], names=["rep", "id", "score"])

    key = ["shard", "qb", "vb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "rep long, id long, score double")


def _calibrated(index: DataFrame, tree: Tree, trial: pa.Table, k: int) -> int:
    """The leaves to visit, from the true neighbours of the trial rows among all others."""
    q, names = _matrix(trial.column("v").combine_chunks()), trial.column("id").to_numpy()
    shared = index.sparkSession.sparkContext.broadcast(q)

    def compare(batches):
        for batch in batches:
            v, ids, leaf = _matrix(batch.column(2)), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            row, col, exact = _best(shared.value @ v.T, ids, shared.value, v, k + 1) if len(v) else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(leaf[col]), pa.array(ids[col]), pa.array(exact.astype(np.float64))], names=["q", "leaf", "id", "score"])

    near = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = index.select("leaf", "id", "v").mapInArrow(compare, "q int, leaf int, id long, score double").withColumn("r", F.row_number().over(near)).where(f"r <= {k + 1}").collect()  # CALIBRATION * (k + 1) rows
    places = [{leaf: i for i, leaf in enumerate(tree.visits(x, tree.leaves)[0])} for x in q]
    at = np.sort([places[r["q"]][r["leaf"]] for r in true if r["id"] != names[r["q"]]])
    asked = int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))))]) + 1 if len(at) else tree.leaves
    return max(asked, min(FIRST, tree.leaves))
