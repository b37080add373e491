"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Equal vectors are folded first (each distinct vector keeps its ``k + 1`` smallest ids, all that a top-k list
can ever need), then dealt by hash into shards of about ``SHARD_BYTES``. Each shard is one directed graph,
built by inserting its vectors in batches of doubling size: a greedy beam search over the graph so far
proposes neighbours, relaxed distance pruning keeps a diverse few (a candidate is dropped if a kept one is
``ALPHA`` times closer to it than the new vector is), and the reverse edges are pruned alike. Distances
are Euclidean after one more coordinate has made all norms equal, so the nearest vector is the one of largest
inner product. Search runs in single precision on vectors divided by the shard's largest component, so neither
huge nor tiny ones leave its range. Every query meets every shard: a task holds one shard's index and streams a
block of up to ``QUERIES`` queries past it; beam search from a few fixed entries proposes vectors, whose inner
products are computed in double precision from the original components; the best over all shards win.

All vectors are indexed and all candidates are reached by search, none by scanning; README has the recall.

Defined results: a vector that is null, zero, of a length other than the table's most frequent one, or with a
null or non-finite component takes no part, nor does a row without id; ties go to the smaller id; an inner
product beyond double precision is infinite as such, one that is no number ranks last; fewer than k candidates
give all that were found; repeated rows of one id count once, with the vector that is least component by
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialize, named, scratch

K = 20
SHARD_BYTES = 20_000_000
QUERIES = 65_536
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 256
WIDE = 4
ALPHA = 1.2
ENTRIES = 48


def beam_search(queries, points, graph, entries, beam: int, wide: int = WIDE):
    """ids, distances of the best found (queries, beam), and the ids expanded on the way (-1 pads).

    The distance is the negative inner product."""
    import numpy as np

    n, at = len(queries), np.arange(len(queries))
    first = -(queries @ points[entries].T)
    order = np.argsort(first, 1, kind="stable")[:, :beam]
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    ids[:, : order.shape[1]] = entries[order]
    dist[:, : order.shape[1]] = np.take_along_axis(first, order, 1)
    seen = ids < 0
    trail = [[] for _ in range(2)]
    active = at
    while len(active):
        open_rank = np.where(seen[active], beam, np.arange(beam))
        pick = np.argsort(open_rank, 1, kind="stable")[:, :wide]
        fresh = np.take_along_axis(open_rank, pick, 1) < beam
        going = fresh[:, 0]
        active, pick, fresh = active[going], pick[going], fresh[going]
        if not len(active):
            break
        nodes = np.where(fresh, ids[active[:, None], pick], -1)
        seen[active[:, None], pick] |= fresh
        trail[0].append(active)
        trail[1].append(nodes)
        near = np.where(nodes[:, :, None] >= 0, graph[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        known = (near[:, :, None] == ids[active][:, None, :]).any(2)
        near[known] = -1
        d = -np.einsum("ijk,ik->ij", points[np.maximum(near, 0)], queries[active], optimize=True)
        d[near < 0] = np.inf
        all_ids, all_d = np.concatenate([ids[active], near], 1), np.concatenate([dist[active], d], 1)
        all_seen = np.concatenate([seen[active], near < 0], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        ids[active], dist[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_d, order, 1)
        seen[active] = np.take_along_axis(all_seen, order, 1)
    width = sum(x.shape[1] for x in trail[1])
    visited = np.full((n, width), -1, np.int32)
    k = 0
    for who, nodes in zip(*trail, strict=True):
        visited[who, k : k + nodes.shape[1]] = nodes
        k += nodes.shape[1]
    return ids, dist, visited


def robust_prune(own, candidates, points, degree: int = DEGREE, alpha: float = ALPHA):
    """For each own vector the kept ones of its candidates (-1 pads), nearest first."""
    import numpy as np

    out = np.full((len(own), degree), -1, np.int32)
    for lo in range(0, len(own), 512):
        p, c = own[lo : lo + 512], candidates[lo : lo + 512].copy()
        c[c == p[:, None]] = -1
        c.sort(1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        x = points[np.maximum(c, 0)]
        norm = (x * x).sum(2)
        d = np.maximum(norm + (points[p] ** 2).sum(1)[:, None] - 2 * np.einsum("ijk,ik->ij", x, points[p], optimize=True), 0)
        d[c < 0] = np.inf
        order = np.argsort(d, 1, kind="stable")[:, : 3 * BEAM]
        c, d, norm = (np.take_along_axis(v, order, 1) for v in (c, d, norm))
        x = points[np.maximum(c, 0)]
        between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * x @ x.transpose(0, 2, 1), 0)
        alive, rows = d < np.inf, np.arange(len(p))
        for k in range(degree):
            pick = np.argmax(alive, 1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[lo : lo + 512, k] = np.where(some, c[rows, pick], -1)
            alive &= (alpha * alpha * between[rows, pick] > d) | ~some[:, None]
            alive[rows, pick] = False
    return out


def build_graph(vectors, degree: int = DEGREE, beam: int = BEAM):
    """(points, degree) neighbours and the entry points, for float32 vectors."""
    import numpy as np

    n = len(vectors)
    norm = (vectors.astype(np.float64) ** 2).sum(1)
    points = np.concatenate([vectors, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None].astype(np.float32)], 1)
    order = np.random.default_rng(n).permutation(n).astype(np.int32)
    graph = np.full((n, degree), -1, np.int32)
    entries = np.sort(order[: min(ENTRIES, n)])
    done = 0
    while done < n:
        batch = order[done : done + max(1, min(done, 512))]
        if done == 0:
            batch = order[: min(ENTRIES, n)]
            found = np.repeat(batch[None, :], len(batch), 0)
        else:
            ids, _, visited = beam_search(points[batch], points, graph, entries, beam)
            found = np.concatenate([ids, visited], 1)
        graph[batch] = robust_prune(batch, found, points, degree)
        src = np.repeat(batch, degree)
        dst = graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        done += len(batch)
        if not len(dst):  # a single vector
            continue
        by = np.lexsort((src, dst))
        src, dst = src[by], dst[by]
        heads, first, counts = np.unique(dst, return_index=True, return_counts=True)
        reverse = np.full((len(heads), counts.max()), -1, np.int32)
        reverse[np.repeat(np.arange(len(heads)), counts), np.arange(len(dst)) - np.repeat(first, counts)] = src
        both = np.concatenate([graph[heads], reverse], 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        size = (both >= 0).sum(1)
        fits = size <= degree
        packed = -np.sort(-both[fits], 1)[:, :degree]
        if packed.shape[1] < degree:
            packed = np.pad(packed, ((0, 0), (0, degree - packed.shape[1])), constant_values=-1)
        graph[heads[fits]] = packed
        if not fits.all():
            graph[heads[~fits]] = robust_prune(heads[~fits], both[~fits], points, degree)
    return graph, entries


def usable(vector: Column) -> Column:
    d = vector.cast("array<double>")
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(d, lambda x: x != 0)


def _scaled(vectors):
    """As float32, divided by the largest component."""
    import numpy as np

    return (vectors / max(np.abs(vectors).max(initial=0), np.finfo(float).tiny)).astype(np.float32)


INDEX = "shard int, vectors binary, graph binary, entries binary, sizes binary, ids binary"


def _build(batches):
    import numpy as np
    import pyarrow as pa

    batches = list(batches)  # a shard
    if not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches).sort_by("node")
    vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    graph, entries = build_graph(_scaled(vectors))
    ids = table.column("ids").combine_chunks()
    parts = (vectors, graph, entries, ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), ids.flatten().to_numpy(zero_copy_only=False))
    yield pa.RecordBatch.from_arrays([table.column("shard").combine_chunks().slice(0, 1), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts)], [c.split()[0] for c in INDEX.split(", ")])


class Shard:
    """An index that was read back."""

    def __init__(self, row: dict):
        import numpy as np

        self.sizes = np.frombuffer(row["sizes"], np.int32)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.sizes), -1)
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.sizes), -1)
        self.entries = np.frombuffer(row["entries"], np.int32)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.points = _scaled(self.vectors)

    def nearest(self, wanted, queries, k: int, beam: int):
        """(query ids, vec ids, scores) of the k best found for each query."""
        import numpy as np

        scale = np.abs(queries).max(1, keepdims=True)
        found, _, _ = beam_search((queries / scale).astype(np.float32), self.points, self.graph, self.entries, beam)
        with np.errstate(all="ignore"):
            score = np.einsum("ijk,ik->ij", self.vectors[np.maximum(found, 0)], queries)
        out = []
        for i, own in enumerate(wanted):
            nodes, s = found[i][found[i] >= 0], score[i][found[i] >= 0]
            vec = np.concatenate([self.ids[self.begin[x] : self.begin[x] + self.sizes[x]] for x in nodes])
            s = np.repeat(s, self.sizes[nodes])
            s, vec = s[vec != own], vec[vec != own]
            best = np.lexsort((vec, -np.where(np.isnan(s), -np.inf, s)))[:k]
            out.append((np.full(len(best), own), vec[best], s[best]))
        return list(map(np.concatenate, zip(*out, strict=True)))


def _search(k: int, beam: int):
    """Rows come sorted by group and kind: each group is the index of a shard and then its queries."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shard = of = None
        for batch in batches:
            kind, groups = batch.column("kind").to_numpy(), batch.column("group").to_numpy()
            cuts = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | (np.diff(groups, prepend=-1) != 0)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(kind)], strict=True):
                part = batch.slice(a, b - a)
                if not kind[a]:
                    shard = Shard(part.select(["vectors", "graph", "entries", "sizes", "ids"]).to_pylist()[0])
                    of = groups[a]
                    continue
                if of != groups[a]:  # a shard that no vector fell into
                    continue
                wanted = part.column("query_id").to_numpy()
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(wanted), -1)
                for lo in range(0, len(wanted), 256):
                    found = shard.nearest(wanted[lo : lo + 256], vectors[lo : lo + 256], k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shard: int | None = None, beam: int = SEARCH_BEAM, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where the condition ``queries`` holds, against all rows. shard: vectors in one, else by SHARD_BYTES."""
    with scratch(vectors.sparkSession):
        rows = vectors.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
        rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        size = common[0]["size"] if common else 0
        rows = rows.filter(F.size("vector") == size).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
        rows = materialize(rows, "ann-rows")

        first = rows.select("vec_id", "vector").withColumn("nth", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
        nodes = first.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("node", F.col("ids")[0])
        nodes = materialize(nodes, "ann-nodes")
        shard = shard or max(1, SHARD_BYTES // (8 * size + 4 * DEGREE))
        shards = max(1, -(-nodes.count() // shard))
        dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
        index = materialize(dealt.repartitionById(shards, F.col("shard")).mapInArrow(_build, INDEX), "ann-index")

        asked = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "vector")
        blocks = max(1, -(-asked.count() // block))
        group = lambda s, b: (s * F.lit(blocks) + b).cast("int").alias("group")
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(group(F.col("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks))), F.lit(1).alias("kind"), "query_id", "vector")
        index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(group(F.col("shard"), F.col("block")), F.lit(0).alias("kind"), *[c for c in index.columns if c != "shard"])
        streams = index.unionByName(asked, allowMissingColumns=True).repartitionById(shards * blocks, F.col("group")).sortWithinPartitions("group", "kind")
        found = streams.mapInArrow(_search(k, beam), "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))), "vec_id")
        return kept(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-nearest")
