"""Approximate nearest neighbours over learned partitions.

A bounded sample is linked to its nearest neighbours, and the graph is halved
again and again along its Fiedler vector at the median, so that all parts have
equal size and few links are cut.  A small neural classifier learns the part
of a vector.  It places every row of the table, and routes a query to the most
probable parts, in which all rows are ranked by their exact distance.  There
are more parts for larger tables, and how many of them are probed is measured
on the sample, against its exact neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelark.llm._spark import hash_sample, staged

SEED = 7
#: Rows of a part that is aimed at; parts that are made; sample rows for each part.
PART, FEWEST, MOST, EACH = 4096, 16, 1024, 32
#: Bytes of the sample's vectors, and of the rows and of the queries of one cell.
SAMPLE_BYTES, CELL_BYTES = 1 << 26, 1 << 25
#: Rows and queries whose distances a task holds at once.
ROWS, QUERIES = 8192, 512


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` nearest other rows of every row."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), dtype=np.int64)
    norm = (x * x).sum(axis=1)
    step = max(1, (1 << 23) // len(x))
    for lo in range(0, len(x), step):
        d = norm[None] - 2 * x[lo : lo + step] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + step] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def halve(nodes: np.ndarray, near: np.ndarray, rounds: int, rng) -> np.ndarray:
    """True for one half of ``nodes``: the upper half of the graph's Fiedler vector."""
    place = np.full(len(near), -1)
    place[nodes] = np.arange(len(nodes))
    a = np.repeat(np.arange(len(nodes)), near.shape[1])
    b = place[near[nodes]].ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(nodes)) + 1.0
    root = np.sqrt(degree)
    v = rng.standard_normal(len(nodes))
    for _ in range(rounds):  # power iteration on the lazy normalised adjacency
        v -= root * (root @ v) / (root @ root)
        v = v + (np.bincount(a, weights=v[b] / root[b], minlength=len(nodes)) + v / root) / root
        v /= np.linalg.norm(v)
    half = np.zeros(len(nodes), dtype=bool)
    half[np.argsort(v / root, kind="stable")[len(nodes) // 2 :]] = True
    return half


def partition(x: np.ndarray, parts: int, near: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """A balanced partition of the neighbour graph; ``parts`` is a power of two."""
    near, rng = neighbour_graph(x, 10) if near is None else near, np.random.default_rng(SEED)
    label = np.zeros(len(x), dtype=np.int64)
    size = 1
    while size < parts:
        for part in range(size):
            nodes = np.nonzero(label == part)[0]
            if len(nodes) > 1:
                label[nodes[halve(nodes, near, rounds, rng)]] += size
        size *= 2
    return label


@dataclass
class Router:
    """One hidden layer; ``scores`` are the logits of the parts."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) * self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train(x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30) -> Router:
    """Cross-entropy by Adam on the sample."""
    rng = np.random.default_rng(SEED)
    mean = x.mean(axis=0)
    scale = 1 / max(float(np.sqrt(((x - mean) ** 2).mean())), 1e-300)
    z, d = (x - mean) * scale, x.shape[1]
    p = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, s, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for lo in range(0, len(z), 128):
            at = order[lo : lo + 128]
            a = np.maximum(z[at] @ p[0] + p[1], 0)
            o = a @ p[2] + p[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            o /= o.sum(axis=1, keepdims=True)
            o[np.arange(len(at)), label[at]] -= 1
            o /= len(at)
            back = (o @ p[2].T) * (a > 0)
            t += 1
            for i, g in enumerate([z[at].T @ back, back.sum(axis=0), a.T @ o, o.sum(axis=0)]):
                g = g + 1e-4 * p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p[i] -= 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *p)


def probes_for(router: Router, x: np.ndarray, near: np.ndarray, parts: int, target: float) -> int:
    """The fewest parts to probe that hold ``target`` of the sample's exact neighbours.

    A row's neighbours in the whole table are closer than those in a sample,
    so this rather asks for too many.
    """
    if not near.size:
        return parts
    place = np.argmax(router.scores(x), axis=1)
    asked = np.arange(min(len(x), 2048))
    order = np.argsort(-router.scores(x[asked]), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(parts)[None], axis=1)
    needed = np.take_along_axis(turn, place[near[asked]], axis=1)
    found = np.bincount(needed.ravel(), minlength=parts).cumsum() / needed.size
    return int(np.searchsorted(found, target)) + 1


def nearest(qv: np.ndarray, qid: np.ndarray, qkey: np.ndarray, xv: np.ndarray, xid: np.ndarray, xkey: np.ndarray, k: int):
    """Exact (query, id, distance) of each query's ``k`` nearest of the block, as places and distances.

    Ties go to smaller ids, then to smaller keys; a row of the query's id and
    key is the query itself.
    """
    order = np.lexsort((xkey, xid))
    xv, xid, xkey = xv[order], xid[order], xkey[order]
    rough = (qv * qv).sum(axis=1)[:, None] + (xv * xv).sum(axis=1)[None] - 2 * qv @ xv.T
    rough[(qid[:, None] == xid[None]) & (qkey[:, None] == xkey[None])] = np.inf
    slack = 1e-9 * ((qv * qv).sum(axis=1) + (xv * xv).sum(axis=1).max())
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(xid) > k else np.full(len(qid), np.inf)
    for i in range(len(qid)):
        near = np.nonzero((rough[i] <= kth[i] + slack[i]) & np.isfinite(rough[i]))[0]
        d = np.sqrt(((xv[near] - qv[i]) ** 2).sum(axis=1))
        best = np.argsort(d, kind="stable")[:k]
        for j in best:
            yield int(qid[i]), int(qkey[i]), int(xid[near[j]]), int(xkey[near[j]]), float(d[j])


FOUND = {"query_id": pa.int64(), "query_key": pa.int64(), "vec_id": pa.int64(), "vec_key": pa.int64(), "score": pa.float64()}


def _search(k: int):
    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            def columns(t: pa.Table) -> tuple:
                flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                return flat.reshape(t.num_rows, -1), t.column("id").to_numpy(), t.column("key").to_numpy()

            x, q = columns(rows), columns(queries)
            for lo in range(0, rows.num_rows, ROWS):
                for at in range(0, queries.num_rows, QUERIES):
                    out += nearest(*(c[at : at + QUERIES] for c in q), *(c[lo : lo + ROWS] for c in x), k)
        cols = list(zip(*out, strict=True)) if out else [()] * len(FOUND)
        return pa.table([pa.array(c, t) for c, t in zip(cols, FOUND.values(), strict=True)], names=list(FOUND))

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``(id, key, v)`` without vectors that are null, zero, or hold null or non-finite values, and their number.

    Of vectors of several lengths those of the most frequent one take part.
    ``key`` is a hash of the vector: rows that repeat both id and vector are
    one row, rows of one id and different vectors are different rows.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )
    good = good.select("id", F.xxhash64("v").alias("key"), "v")
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not common:
        return good, 0
    good = good.where(F.size("v") == common["d"])
    if not good.groupBy("id", "key").count().where("count > 1").isEmpty():
        good = good.dropDuplicates(["id", "key"])
    return good, common["count"]


def search(
    rows: DataFrame,
    is_query,
    k: int = 10,
    parts: int | None = None,
    probes: int | None = None,
    sample: int | None = None,
    target: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score, query_key, vec_key)``: the ``k`` nearest found of every query row.

    Nearness is the Euclidean distance in double precision, ties go to the
    smaller id, then to the smaller key (a hash of the vector).  Rows that
    repeat id and vector are one row; a row is not its own neighbour, rows of
    its id and another vector may be.  Queries of one id and different vectors
    are answered apart, told by ``query_key``.

    Unless given, ``parts`` is a power of two of about ``PART`` rows each, from
    16 to 1024, the parts and the router are fitted on at most ``sample`` rows
    (4096, or 32 a part; 64 MB of vectors) chosen by a hash, and ``probes`` is
    what ``target`` of the sample's exact neighbours need; every row is placed.
    Parts and their queries are dealt in cells of about 32 MB, so a part that
    holds a large share of the rows is searched by as many tasks as it needs.
    Rows whose vector can't be measured (see ``usable``) take no part; null ids
    neither.  An empty table gives an empty result; other columns are not
    looked at.
    """
    spark = rows.sparkSession
    good, total = usable(rows, id_col, vector_col)
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, query_key bigint, vec_key bigint")
    if parts is None:
        parts = min(MOST, max(FEWEST, 1 << max(0, (total - 1) // PART).bit_length()))
    fit = hash_sample(good, ["id", "key"], sample or max(4096, EACH * parts)).select("v").toArrow().column("v").combine_chunks()
    x = fit.flatten().to_numpy(zero_copy_only=False).reshape(len(fit), -1)
    x = x[: max(1, SAMPLE_BYTES // (8 * x.shape[1]))]
    while parts > 1 and parts * 2 * k > len(x):
        parts //= 2
    router = None
    if parts > 1:
        near = neighbour_graph(x, k)
        router = train(x, partition(x, parts, near), parts)
        probes = min(parts, probes or probes_for(router, x, near, parts, target))

    @F.pandas_udf("array<int>")
    def route(v: pd.Series, asked: pd.Series) -> pd.Series:
        if router is None or not len(v):
            return pd.Series([[0]] * len(v), dtype=object)
        score = router.scores(np.stack(v.to_numpy()))
        best = np.argmax(score, axis=1).astype(np.int32)[:, None].tolist()
        at = np.nonzero(asked.to_numpy(dtype=bool))[0]
        turns = np.argsort(-score[at], axis=1, kind="stable")[:, :probes].astype(np.int32).tolist()
        for i, turn in zip(at.tolist(), turns, strict=True):
            best[i] = turn
        return pd.Series(best, dtype=object)

    asked = F.coalesce(is_query(F.col("id")), F.lit(False))
    placed = staged(good.withColumn("asked", asked).withColumn("parts", route("v", "asked")))
    stored = placed.select("id", "key", "v", F.col("parts")[0].alias("part"))
    fresh = [F.col(c).alias(c) for c in ("id", "key", "v")]  # columns of their own for the cogroup
    queries = placed.where("asked").select(*fresh, F.explode("parts").alias("part"))
    most = max(1, CELL_BYTES // (8 * x.shape[1]))  # rows or queries of a cell
    sizes = stored.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias("cells"))
    loads = queries.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias("loads"))
    cells = F.broadcast(sizes.join(loads, "part"))  # at most ``parts`` rows
    own = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = stored.join(cells, "part").select("id", "key", "v", "part", own("cells").alias("cell"), every("loads").alias("load"))
    right = queries.join(cells, "part").select(*fresh, F.col("part").alias("part"), own("loads").alias("load"), every("cells").alias("cell"))
    keys = ["part", "cell", "load"]
    shape = "query_id bigint, query_key bigint, vec_id bigint, vec_key bigint, score double"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), shape)
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id", "vec_key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_key", "vec_key")
