"""Approximate nearest neighbours with learned partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import checkpointed

FIT_ROWS = 128
PARTS, MOST_PARTS = 32, 128
PART_ROWS = 4096
GRAPH_K = 12
MASS = 0.98
LEAST_PROBES = 4
BLOCK_ROWS = 4096
QUERY_ROWS = 256
SALTS = 16


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k rows with the largest inner product with each row, without itself."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        scores = x[a : a + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out[a : a + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_partition(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Parts of equal size with few graph edges between them: halves are split again along the second eigenvector of
    the graph's random walk, at its median, and then exchange rows in pairs while that saves edges."""
    n = len(graph)
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for bit in range(max(0, (parts - 1).bit_length())):
        nxt = label * 2
        for part in np.unique(label):
            own = np.flatnonzero(label == part)
            if len(own) < 2:
                continue
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[source] >= 0) & (place[target] >= 0)
            a, b = place[source[inside]], place[target[inside]]
            a, b = np.concatenate((a, b)), np.concatenate((b, a))
            degree = np.bincount(a, minlength=len(own)) + 1.0
            v = rng.standard_normal(len(own))
            for _ in range(60):
                v -= (v * degree).sum() / degree.sum()
                v = (np.bincount(a, v[b], len(own)) + v) / degree + v
                v /= np.linalg.norm(v) + 1e-12
            side = np.zeros(len(own), np.int64)
            side[np.argsort(v, kind="stable")[len(own) // 2 :]] = 1
            for _ in range(8):
                other = np.bincount(a, (side[a] != side[b]).astype(float), len(own))
                gain = 2 * other - (degree - 1)
                zero, one = (np.flatnonzero(side == s) for s in (0, 1))
                zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
                m = min(len(zero), len(one), max(1, len(own) // 20))
                good = int((gain[zero[:m]] + gain[one[:m]] > 2).sum())
                if not good:
                    break
                side[zero[:good]], side[one[:good]] = 1, 0
            nxt[own] += side
        label = nxt
    return label


def fit_router(x: np.ndarray, parts: int = PARTS, k: int = GRAPH_K, hidden: int = 128, epochs: int = 80, seed: int = 3) -> dict:
    """A small network from a vector to the parts that hold its neighbours. Its targets are the shares of the parts
    among a fitted row and its graph neighbours."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    if len(x) < 4 * parts:
        return {"parts": 1}
    graph = neighbour_graph(x, k)
    label = balanced_partition(graph, parts)
    goal = np.zeros((len(x), parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1.0 / (graph.shape[1] + 3))
    goal[np.arange(len(x)), label] += 3.0 / (graph.shape[1] + 3)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    net = [rng.standard_normal((x.shape[1], hidden)).astype(np.float32) * np.float32(np.sqrt(2 / x.shape[1])), np.zeros(hidden, np.float32), rng.standard_normal((hidden, parts)).astype(np.float32) * np.float32(np.sqrt(1 / hidden)), np.zeros(parts, np.float32)]
    first, second, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(z), 256):
            i = order[a : a + 256]
            noisy = z[i] + rng.standard_normal(z[i].shape).astype(np.float32) * np.float32(0.15)
            h = np.maximum(noisy @ net[0] + net[1], 0)
            out = h @ net[2] + net[3]
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - goal[i]) / len(i)
            dh = (d @ net[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((noisy.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                g = g + 1e-4 * net[j]
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                net[j] -= (0.003 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return {"parts": parts, "mean": mean, "spread": spread, "net": net}


def route(router: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of the parts for each row."""
    if router["parts"] == 1:
        return np.ones((len(x), 1))
    z = (x.astype(np.float32) - router["mean"]) / router["spread"]
    w1, b1, w2, b2 = router["net"]
    out = (np.maximum(z @ w1 + b1, 0) @ w2 + b2).astype(np.float64)
    p = np.exp(out - out.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: not null, of the most frequent length, with finite components that are
    not all zero, and with an id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(
        "vec_id is not null and vector is not null and size(vector) > 0"
    )
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = v.where(finite & F.exists("vector", lambda c: c != 0))
    sizes = v.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").take(1)
    return v.where(F.size("vector") == (sizes[0]["d"] if sizes else 1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(scores: np.ndarray, base: np.ndarray, q: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best ids of one query among entries, ties to smaller ids. scores are those of a matrix product, whose
    last bits depend on its blocks: all entries about as near as the k-th one are measured again, each by itself."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    else:
        near = np.arange(len(scores))
    exact = (base[near] * q).sum(axis=1)
    sizes = np.diff(bounds)[near]
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own, exact = ids[np.repeat(bounds[:-1][near], sizes) + inner], np.repeat(exact, sizes)
    order = np.lexsort((own, -exact))[:k]
    return exact[order], own[order]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, fit_rows: int = FIT_ROWS, parts: int | None = None, mass: float = MASS) -> DataFrame:
    """query_id, rank, vec_id, score: for every usable row that meets `queries`, the k rows found with the largest inner
    product, in double precision on the original vectors, without the row itself; ties go to the smaller vec_id.

    Equal vectors are one entry of the index, with their k + 1 smallest ids, which is all that a result can hold; equal
    queries are searched once. There is a part for about PART_ROWS entries, PARTS at least and MOST_PARTS at most. The router is fitted
    on about fit_rows entries a part, drawn by hash; every entry is then
    indexed in its most probable part. A query goes to its most probable parts until they have `mass` of its
    probability (LEAST_PROBES at least), where it meets every entry, in blocks. Rows that take no part (usable) are
    neither queries nor candidates; with k or fewer other rows all that the query meets are returned; an empty table
    gives no rows. Repeated rows with one vec_id and vector count once; a vec_id with two vectors has both."""
    rows = usable(vectors).distinct()
    key = F.md5(F.array_join(F.transform("vector", lambda c: F.hex(F.when(c == 0, F.lit(0.0)).otherwise(c).cast("string"))), ",").cast("binary"))
    keyed = rows.withColumn("key", key)
    order = Window.partitionBy("key").orderBy("vec_id")
    entries = checkpointed(
        keyed.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
        .groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vector").alias("vector"))
    )
    asked = keyed.where(queries).select(F.col("vec_id").alias("query_id"), "key")
    total = entries.count()
    parts = parts or min(MOST_PARTS, max(PARTS, 1 << (total // PART_ROWS).bit_length()))
    draw = F.shiftrightunsigned(F.xxhash64("key"), 1) / F.lit(float(1 << 63))
    fitted = entries.where(draw < min(1.0, fit_rows * parts / max(total, 1))).select("key", "vector").collect()  # fit_rows x MOST_PARTS at most
    x = np.array([r["vector"] for r in sorted(fitted, key=lambda r: r["key"])], np.float32)
    shipped = vectors.sparkSession.sparkContext.broadcast(fit_router(x, parts) if len(x) else {"parts": 1})  # of bounded size

    def place(batches):
        for batch in batches:
            own = route(shipped.value, _matrix(batch.column("vector"))).argmax(1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*batch.schema.names, "part"])

    def probe(batches):
        for batch in batches:
            p = route(shipped.value, _matrix(batch.column("vector"))) if len(batch) else np.zeros((0, 1))
            ranked = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, ranked, 1), 1) - np.take_along_axis(p, ranked, 1)
            chosen = (before < mass) | (np.arange(p.shape[1]) < LEAST_PROBES)
            lists = [r[c].tolist() for r, c in zip(ranked, chosen)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    placed = entries.select("key", "ids", "vector").mapInArrow(place, "key string, ids array<long>, vector array<double>, part int")
    placed = checkpointed(placed)
    blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))  # a row a part
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    candidates = placed.join(F.broadcast(blocks), "part").select("part", block.alias("block"), F.lit(0).alias("side"), "key", "ids", "vector")
    wanted = asked.select("key").distinct()
    looking = (
        entries.join(wanted, "key", "left_semi").select("key", "vector")
        .mapInArrow(probe, "key string, vector array<double>, parts array<int>")
        .withColumn("part", F.explode("parts")).join(F.broadcast(blocks), "part")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "block", F.lit(1).alias("side"), "key", F.lit(None).cast("array<long>").alias("ids"), "vector")
    )
    dealt = candidates.union(looking).repartition("part", "block").sortWithinPartitions("part", "block", "side")

    def search(batches):
        at, ids, held, base, bounds = None, [], [], None, None
        for batch in batches:
            place_ = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            matrix = _matrix(batch.column("vector"))
            start = 0
            while start < len(place_):
                end = start
                while end < len(place_) and place_[end] == place_[start]:
                    end += 1
                if place_[start][:2] != at:
                    at, ids, held, base = place_[start][:2], [], [], None
                some = batch.slice(start, end - start)
                if place_[start][2] == 0:
                    ids += some.column("ids").to_pylist()
                    held.append(matrix[start:end])
                elif ids:
                    if base is None:
                        base, bounds, flat = np.concatenate(held), np.cumsum([0, *map(len, ids)]), np.array([i for x in ids for i in x], np.int64)
                    for a in range(start, end, QUERY_ROWS):
                        q = matrix[a : min(a + QUERY_ROWS, end)]
                        found = [best_of(s, base, v, flat, bounds, k + 1) for s, v in zip(q @ base.T, q)]
                        sizes = [len(i) for _, i in found]
                        keys = batch.column("key").slice(a, len(q)).take(pa.array(np.repeat(np.arange(len(q)), sizes)))
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(np.concatenate([s for s, _ in found])), pa.array(np.concatenate([i for _, i in found]))], names=["key", "score", "vec_id"]
                        )
                start = end

    found = dealt.mapInArrow(search, "key string, score double, vec_id long").distinct()
    nearest_first = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("at", F.row_number().over(nearest_first)).where(F.col("at") <= k + 1)
    best = checkpointed(best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), F.col("vec_id").alias("id")))).alias("found")))
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return (
        asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)))
        .join(salted, ["key", "salt"])
        .select("query_id", F.posexplode(F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)).alias("at", "f"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.d")).alias("score"))
    )
