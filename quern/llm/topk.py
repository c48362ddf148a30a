"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are put in an order that brings like signs together, split by ranges of it into runs, and each run by its
widest terms into blocks. A block keeps its forward index (a row a vector) and the largest and smallest weight of
each term; a run keeps those too. For a query, the sum of its weights times the extreme of the right sign bounds
every score in a block or a run.

Each query is first searched in its own run, whose k-th score is a floor for all. Runs whose bound is below the floor
never get the query; in the others blocks are scored in order of their bounds until those fall below the k-th best
score. Each run answers with its k best for a query, and the best of those are the result.

How much is skipped depends on the vectors: where they form clusters, most blocks are; where they lie evenly in
many dimensions, hardly any (README has figures).

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id take
no part; shorter vectors count as padded with zeros; rows with a query's own id are not its candidates; of
rows that share a query's id the first by weights asks, once; ties go to the smaller id, rows that share an id are
candidates each; scores outside 64 bits are held at its bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidied

#: Vectors of a run and of a block, queries of a query block, about, and runs whose bounds are asked together.
RUN = 4096
BLOCK = 64
QUERIES = 1024
BOXES = 1024
#: Leading terms whose signs order the vectors.
SIGNS = 16
_RUN = "part int, dims int, ids binary, weights binary, edges binary, high binary, low binary"
_QUERY = "id bigint, dims int, weights binary, floor double"
_ASK = "part int, dims int, ids binary, weights binary, floors binary"


def quantized(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """id, w: floor(scale * component) of the vectors that take part."""
    v = F.col(f"`{column}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return df.filter(v.isNotNull() & finite & F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("w"))


def _matrix(column) -> np.ndarray:
    """A list column as a matrix of doubles, padded with zeros."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.flatten(), np.float64)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _bytes(w: np.ndarray) -> bytes:
    """Whole numbers as floats of 4 bytes each where that loses nothing, else of 8."""
    return w.astype(np.float32).tobytes() if np.abs(w).max(initial=0) < 2**24 else w.tobytes()


def _floats(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) < 8 * n * dims else np.float64).reshape(n, dims).astype(np.float64)


def blocked(w: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): rows split in halves by their widest term until each part has at most `block`."""
    order, edges, todo = [], [0], [np.arange(len(w))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            if len(rows):
                order.append(rows)
                edges.append(edges[-1] + len(rows))
            continue
        part = w[rows]
        rows = rows[np.argsort(part[:, int(np.argmax(part.var(0)))] if part.shape[1] else rows, kind="stable")]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return np.concatenate(order) if order else np.zeros(0, np.int64), np.array(edges, np.int32)


def _runs(batches):
    """One row a partition: ids and weights in the order of their blocks, the blocks' edges, and the run's extremes."""
    from pyspark import TaskContext

    ids, mats = [], []
    for batch in batches:
        ids.append(np.asarray(batch.column("id"), np.int64))
        mats.append(_matrix(batch.column("w")))
    if not ids:
        return
    dims = max(m.shape[1] for m in mats)
    ids, w = np.concatenate(ids), np.concatenate([np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in mats])
    order = np.lexsort((*w.T[::-1], ids))  # whatever order the rows came in
    ids, w = ids[order], w[order]
    order, edges = blocked(w, BLOCK)
    row = (TaskContext.get().partitionId(), dims, ids[order].tobytes(), _bytes(w[order]), edges.tobytes(), w.max(0).tobytes(), w.min(0).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], ["part", "dims", "ids", "weights", "edges", "high", "low"])


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and box the most that a score can be, in doubles, widened by more than their rounding can lose."""
    dims = max(q.shape[1], high.shape[1])
    q, high, low = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (q, high, low))
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return bound + np.abs(bound) * 1e-9 + (1.0 if np.abs(bound).max(initial=0) > 2**52 else 0.0)


def _dot(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Integer products as exact as their size allows: doubles below 2**53, else Python's integers."""
    if q.size == 0 or w.size == 0 or np.abs(q).max() * np.abs(w).max() * q.shape[1] < 2**53:
        return (q @ w.T).astype(np.int64)
    whole = np.array([int(x) for x in q.ravel()], object).reshape(q.shape) @ np.array([int(x) for x in w.ravel()], object).reshape(w.shape).T
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in whole.ravel()], np.int64).reshape(whole.shape)


def search_run(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int, edges: np.ndarray, floors: np.ndarray | None = None, scored: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best in one run, by pruning its blocks; scores below `floors` may be left out.

    To `scored` go pairs (blocks scored, blocks) of queries.
    """
    dims = max(q.shape[1], w.shape[1])
    q, w = np.pad(q, ((0, 0), (0, dims - q.shape[1]))), np.pad(w, ((0, 0), (0, dims - w.shape[1])))
    ends, edges = edges[1:], edges[:-1]
    block = int((ends - edges).max(initial=0))
    high, low = np.array([w[a:b].max(0) for a, b in zip(edges, ends, strict=True)]), np.array([w[a:b].min(0) for a, b in zip(edges, ends, strict=True)])
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    worst = np.full(len(q), -np.inf) if floors is None else floors.astype(np.float64).copy()
    n_scored = 0
    best_s, best_i = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
    none = np.zeros((len(q), 0), bool)
    live = np.arange(len(q))
    for t in range(len(edges)):
        at = order[live, t]
        live = live[bound[live, at] >= worst[live]]
        if not len(live):
            break
        at = order[live, t]
        n_scored += len(live)
        width = block
        s, i, gone = np.zeros((len(q), width), np.int64), np.zeros((len(q), width), np.int64), np.ones((len(q), width), bool)
        for b in np.unique(at):
            rows, a, z = live[at == b], edges[b], ends[b]
            there = ids[a:z]
            s[rows, : len(there)] = _dot(q[rows], w[a:z])
            i[rows, : len(there)] = there
            gone[rows, : len(there)] = there[None, :] == qids[rows, None]
        cs, ci, cg = (np.concatenate((x[live], y[live]), 1) for x, y in ((best_s, s), (best_i, i), (none, gone)))
        keep = np.lexsort((ci, -cs.astype(object) if cs.size and cs.min() == -(2**63) else -cs, cg), axis=1)[:, :k]
        wide = keep.shape[1]
        if best_s.shape[1] < wide:
            grow = wide - best_s.shape[1]
            best_s, best_i, none = np.pad(best_s, ((0, 0), (0, grow))), np.pad(best_i, ((0, 0), (0, grow))), np.pad(none, ((0, 0), (0, grow)), constant_values=True)
        rows = np.arange(len(live))[:, None]
        best_s[live, :wide], best_i[live, :wide], none[live, :wide] = cs[rows, keep], ci[rows, keep], cg[rows, keep]
        full = ~none[live].any(1) if best_s.shape[1] == k else np.zeros(len(live), bool)
        if full.any():
            worst[live[full]] = np.maximum(worst[live[full]], best_s[live[full], k - 1])
    if scored is not None:
        scored.append((n_scored, len(q) * len(edges)))
    q_at, slot = np.nonzero(~none)
    return qids[q_at], best_i[q_at, slot], best_s[q_at, slot]


def own_floors(qids: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th score of each query among what was found; none if there are fewer."""
    out = np.full(len(qids), -np.inf)
    order = np.lexsort((-found[2].astype(np.float64), found[0]))
    owner, score = found[0][order], found[2][order]
    first, last = np.searchsorted(owner, qids, "left"), np.searchsorted(owner, qids, "right")
    full = last - first >= k
    # rounded down, where a double can't hold it
    out[full] = np.nextafter(score[first[full] + k - 1].astype(np.float64), -np.inf)
    return out


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, <id>, score: for each row whose id is divisible by `every`, its k best among all others."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = quantized(df, id_column, column)
    n = max(1, -(-vectors.count() // RUN))
    signs = F.aggregate(F.slice("w", 1, SIGNS), F.lit(0), lambda s, x: s * 2 + (x > 0).cast("int"))
    # rows of one frequent vector are dealt by their ids, and equal rows apart
    dealt = vectors.withColumn("signs", signs).withColumn("apart", F.rand(5)).repartitionByRange(n, "signs", "id", "apart").select("id", "w")
    runs = scratch.keep(dealt.mapInArrow(_runs, _RUN), "runs")

    def ask(part: int, ids: np.ndarray, w: np.ndarray, floors: np.ndarray):
        row = (part, w.shape[1], ids.tobytes(), _bytes(w), floors.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "dims", "ids", "weights", "floors"])

    @tidied
    def of_queries(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                w = _floats(r["weights"], len(ids), r["dims"])
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    at = at[np.lexsort((*w[at].T[::-1], ids[at]))]
                    asked, first = np.unique(ids[at], return_index=True)
                    q = w[at[first]]
                    found = search_run(asked, q, ids, w, k, np.frombuffer(r["edges"], np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array([r["dims"]] * len(asked), pa.int32()), pa.array([_bytes(x) for x in q], pa.binary()), pa.array(own_floors(asked, found, k))], ["id", "dims", "weights", "floor"])

    def merged(part):
        import pandas as pd

        part, dims = part.sort_values("id"), int(part["dims"].max())
        w = np.array([np.pad(_floats(x, 1, d)[0], (0, dims - d)) for x, d in zip(part["weights"], part["dims"], strict=True)]).reshape(len(part), dims)
        return pd.DataFrame({"part": [int(part["b"].iloc[0])], "dims": [dims], "ids": [part["id"].to_numpy(np.int64).tobytes()], "weights": [_bytes(w)], "floors": [part["floor"].to_numpy(np.float64).tobytes()]})

    # of the rows that share an id one asks
    one = runs.mapInArrow(of_queries, _QUERY).groupBy("id").agg(F.min(F.struct("weights", "dims", (-F.col("floor")).alias("less"))).alias("x"))
    queries = scratch.keep(one.select("id", "x.dims", "x.weights", (-F.col("x.less")).alias("floor")), "queries")
    n_blocks = max(1, -(-queries.count() // QUERIES))
    blocks = scratch.keep(queries.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("b").applyInPandas(merged, _ASK), "blocks")

    # which runs each query of a block must see: the runs' bounds go to the queries, in bounded groups, before any query travels
    groups = -(-n // BOXES)
    boxes = runs.select((F.col("part") / BOXES).cast("int").alias("g"), F.struct("part", F.col("dims").alias("d"), "high", "low").alias("x")).groupBy("g").agg(F.collect_list("x").alias("boxes"))
    met = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).join(boxes, "g").select("dims", "ids", "weights", "floors", "boxes")

    @tidied
    def wanted(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, floors = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["floors"])
                q = _floats(r["weights"], len(ids), r["dims"])
                for x in r["boxes"]:
                    live = bounds(q, *(np.frombuffer(x[c]).reshape(1, x["d"]) for c in ("high", "low")))[:, 0] >= floors
                    if live.any():
                        yield ask(x["part"], ids[live], q[live], floors[live])

    asked = met.mapInArrow(wanted, _ASK).select("part", *[F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "weights", "floors")])

    @tidied
    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                qids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                found = search_run(qids, _floats(r["q_weights"], len(qids), r["q_dims"]), ids, _floats(r["weights"], len(ids), r["dims"]), k, np.frombuffer(r["edges"], np.int32), np.frombuffer(r["q_floors"]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "id", "score"])

    found = runs.select("part", "dims", "ids", "weights", "edges").join(asked.hint("shuffle_merge"), "part").mapInArrow(search, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
