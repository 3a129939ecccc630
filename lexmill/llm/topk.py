"""Exact top-k inner-product search by ball trees, branch and bound.

Rows are dealt to shards by geometry: each goes to the nearest of at most `CENTRES` sampled vectors, and the rows of one
centre, if many, to several shards by a hash (equal vectors can't be parted otherwise). A shard's ball tree is built once and
stored; a shard's own queries are one block, so the queries of a block lie close together.

1. Each block searches its own shard's tree, in the task that builds it.
2. Blocks meet the balls of all shards, in packs. A shard whose ball's upper bound (q . centre + |q| radius) doesn't reach the kth
   score of any query of the block gets nothing; the `NEXT` shards with the highest bounds of each pack are searched first.
3. With the kth scores from there, bounds are taken again, and only queries that still reach into a shard go to it.

In a tree, nodes wait in a heap by the largest bound that any query still needs, and a node is opened only for the queries
whose bound reaches their kth score. Leaves are scored as one product of matrices: in doubles where no sum can pass 2**53,
which is exact for integers; in Python's integers elsewhere.

The work is that of queries times shards where vectors are so spread that bounds prune nothing; nothing is cut off then.
Tasks hold one shard and a few blocks, and give only hits that reach the known kth score.

Defined results: vectors that are null, or hold a component that is null, NaN, infinite or so large that 64 times it is, take no
part, nor do rows with a null id; a score beyond 64 bits counts as the largest or smallest 64-bit number; of vectors of unequal
length, components beyond the shorter one count as 0; an empty vector scores 0; ties go to the smaller id; rows that repeat
an id are candidates each for itself and queries each for itself, and a query is no candidate for its own id; fewer
candidates than k give all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, staged

#: Rows of a shard, about.
SHARD_ROWS = 4096
#: Sampled vectors that rows are dealt by, at most; they go to the driver and to each task.
CENTRES = 1024
LEAF = 64
#: Shards of a pack that are searched first; balls of a pack; blocks that meet one shard in one task.
NEXT, PACK, LANE = 2, 512, 32
MOST = 2**63 - 1


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as whole doubles; null for vectors that take no part."""
    x = F.transform(embedding.cast("array<double>"), lambda c: c * scale)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # Doubles of 2**53 and more are whole.
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)))


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held to 64 bits."""
    largest = (float(np.abs(queries).max(initial=0)), float(np.abs(points).max(initial=0)))
    # The factors apart, as their product may be infinite.
    if max(largest) < 2.0**53 and largest[0] * largest[1] * max(1, points.shape[1]) < 2.0**53:
        return (queries @ points.T).astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    exact = whole(queries) @ whole(points).T if points.shape[1] else np.zeros((len(queries), len(points)), dtype=object)
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """(queries, balls): no point of a ball scores higher. The margin covers the rounding of means, roots and sums."""
    with np.errstate(all="ignore"):
        reach = np.sqrt((queries**2).sum(1))[:, None] * radii
        size = reach + np.abs(queries) @ np.abs(centres).T
        bounds = queries @ centres.T + reach + 1e-9 * size + 1e-6
        # Scores are held to 64 bits, so no bound is below them.
    return np.maximum(np.where(np.isnan(bounds), np.inf, bounds), -float(MOST))


class BallTree:
    """Nested halves of the points, cut along the line between two far points; a ball around the mean of each."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[list[int]] = []  # first, last, left child, right child
        centres, radii = [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            first, last, parent, side = todo.pop()
            own = points[order[first:last]]
            with np.errstate(all="ignore"):
                centre = own.mean(0)
                away = ((own - centre) ** 2).sum(1)
                k, radius = len(self.nodes), np.sqrt(away.max(initial=0))
            self.nodes.append([first, last, -1, -1])
            centres.append(centre)
            radii.append(radius)
            if parent >= 0:
                self.nodes[parent][2 + side] = k
            if last - first > leaf and 0 < radius < np.inf:
                a = own[away.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                half = (last - first) // 2
                order[first:last] = order[first:last][np.argpartition(own @ (b - a), half)]
                todo += [(first, first + half, k, 0), (first + half, last, k, 1)]
        self.ids, self.points = ids[order], points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> tuple[list[list[tuple[int, int]]], np.ndarray, int]:
        """Per query up to k best (-score, id), all that reach `kth` among them; the scores then known to be reached; leaves opened."""
        queries = fitted(queries, self.points.shape[1])
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        kth, opened = kth.copy(), 0
        bounds = upper_bounds(queries, self.centres, self.radii)
        heap = [(-np.inf, 0, np.arange(len(queries)))] if len(queries) else []
        while heap:
            _, node, live = heapq.heappop(heap)
            live = live[bounds[live, node] >= kth[live]]
            if not len(live):
                continue
            first, last, *children = self.nodes[node]
            if children[0] >= 0:
                for child in children:
                    need = live[bounds[live, child] >= kth[live]]
                    if len(need):
                        heapq.heappush(heap, (-bounds[need, child].max(), child, need))
                continue
            opened += 1
            names = self.ids[first:last]
            scores = products(queries[live], self.points[first:last])
            hit = (scores >= kth[live, None]) & (names != query_ids[live, None])
            for r in np.flatnonzero(hit.any(1)).tolist():
                at = np.flatnonzero(hit[r])
                q = int(live[r])
                found = heapq.merge(best[q], sorted(zip((-scores[r, at]).tolist(), names[at].tolist(), strict=True)))
                best[q] = [x for x, _ in zip(found, range(k), strict=False)]
                if len(best[q]) == k:
                    kth[q] = max(kth[q], -best[q][-1][0])
        return best, kth, opened


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled with zeros to a width."""
    out = np.zeros((len(rows), width))
    both = min(width, rows.shape[1])
    out[:, :both] = rows[:, :both]
    return out


def _matrix(vectors: list) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for r, v in enumerate(vectors):
        out[r, : len(v)] = v
    return out


def _deal(centres: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """centre: the nearest of the centres, the first among equals."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nearest = []
            for first in range(0, len(frame), 1024):
                own = fitted(_matrix(frame["v"].iloc[first : first + 1024].tolist()), centres.shape[1])
                with np.errstate(all="ignore"):
                    nearest.append(np.argmin(np.nan_to_num((centres**2).sum(1) - 2 * own @ centres.T, nan=np.inf), axis=1))
            frame["centre"] = np.concatenate(nearest) if nearest else np.empty(0, dtype=int)
            yield frame

    return deal


_HITS = "q_row long, query_id long, vec_id long, score long"
_SHARD = f"centre int, part int, ball binary, tree binary, asking int, block binary, hits array<struct<{_HITS.replace(' long', ':long')}>>"


def _hits(rows: np.ndarray, ids: np.ndarray, best: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    return [(int(row), int(i), name, -score) for row, i, own in zip(rows, ids, best, strict=True) for score, name in own]


def _build(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One shard: its tree and ball, its own queries as a block, and what they find in it."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        points, ids = _matrix(frame["v"].tolist()), frame["id"].to_numpy()
        tree, asks = BallTree(ids, points), frame["asks"].to_numpy()
        rows, queries = frame["row"].to_numpy()[asks], points[asks]
        best, _, _ = tree.search(ids[asks], queries, k, np.full(len(rows), -MOST))
        ball = pickle.dumps((tree.centres[0], tree.radii[0]))
        return pd.DataFrame([(frame["centre"].iloc[0], frame["part"].iloc[0], ball, pickle.dumps(tree), len(rows), pickle.dumps((rows, ids[asks], queries)), _hits(rows, ids[asks], best))], columns=["centre", "part", "ball", "tree", "asking", "block", "hits"])

    return build


def _reach(narrow: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Blocks against packs of balls: the parts of each block that a shard may hold better hits for; narrow: for the first few shards only."""

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for home, block, known, pack, seen in zip(frame["home"], frame["block"], frame["known"], frame["balls"], frame["seen"], strict=True):
                rows, ids, queries = pickle.loads(block)
                reached = {int(x["q_row"]): int(x["kth"]) for x in known} if known is not None else {}
                kth = np.array([reached.get(int(r), -MOST) for r in rows], dtype=np.int64)
                done = {home, *(seen if seen is not None else ())}
                able = []
                for ball in pack:
                    if ball["shard"] in done:
                        continue
                    centre, radius = pickle.loads(ball["ball"])
                    bounds = upper_bounds(fitted(queries, len(centre)), centre[None], np.array([radius]))[:, 0]
                    if (need := bounds >= kth).any():
                        able.append((bounds.max(), ball["shard"], need))
                able.sort(key=lambda x: (-x[0], x[1]))
                for _, shard, need in able[:NEXT] if narrow else able:
                    yield pd.DataFrame({"home": [home], "shard": [shard], "asked": [pickle.dumps((rows[need], ids[need], queries[need], kth[need]))]})

    return reach


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        hits: list = []
        if len(trees) and len(asked):
            tree = pickle.loads(trees["tree"].iloc[0])
            for home, blob in zip(asked["home"], asked["asked"], strict=True):
                rows, ids, queries, kth = pickle.loads(blob)
                hits += [(home, *x) for x in _hits(rows, ids, tree.search(ids, queries, k, kth)[0])]
        return pd.DataFrame(hits, columns=["home", "q_row", "query_id", "vec_id", "score"]).astype({c: "int64" for c in ("q_row", "query_id", "vec_id", "score")})

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest inner products of quantised vectors.

    is_query is a condition on the table's columns. A count and the centres go to the driver.
    """
    clean = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), quantised(F.col(embedding), scale).alias("v"))
    clean = staged(clean.where("id is not null and v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    wanted = min(CENTRES, max(1, -(-clean.count() // shard_rows)))
    centres = _matrix([r["v"] for r in clean.orderBy(F.xxhash64("row"), "row").limit(wanted).select("v").collect()])
    placed = staged(clean.mapInPandas(_deal(centres), "id long, asks boolean, v array<double>, row long, centre int") if len(centres) else clean.withColumn("centre", F.lit(0)), "placed")
    # One row a centre, so the broadcast is bounded.
    parts = placed.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "centre").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    shards = staged(dealt.groupBy("centre", "part").applyInPandas(_build(k), _SHARD), "shards")
    dropped(clean, placed)
    named = shards.withColumn("shard", F.concat_ws(".", "centre", "part"))

    packs = max(1, -(-shards.count() // PACK))
    balls = named.select(F.pmod(F.xxhash64("shard"), F.lit(packs)).cast("int").alias("pack"), "shard", "ball")
    balls = balls.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("shard", "ball"))).alias("balls"))
    blocks = named.where("asking > 0").select(F.col("shard").alias("home"), "block")

    def best_of(hits: DataFrame) -> DataFrame:
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id")))
        return ranked.where(F.col("rank") <= k)

    def asked(hits: DataFrame, seen: DataFrame | None) -> DataFrame:
        """home, shard and the queries that the shard is still needed for; hits: home and what is found so far."""
        kth = best_of(hits).groupBy("home", "q_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        known = kth.groupBy("home").agg(F.collect_list(F.struct("q_row", "kth")).alias("known"))
        rows = blocks.join(known, "home", "left")
        rows = rows.join(seen, "home", "left") if seen is not None else rows.withColumn("seen", F.lit(None).cast("array<string>"))
        met = rows.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).repartition("home", "pack").join(balls, "pack")
        return staged(met.select("home", "block", "known", "balls", "seen").mapInPandas(_reach(seen is None), "home string, shard string, asked binary"), "asked")

    def found(asked: DataFrame) -> DataFrame:
        """home and hits. As many lanes a shard as its blocks need; the tree goes to each."""
        own = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / LANE).cast("int").alias("lanes"))
        laned = asked.join(own, "shard").withColumn("lane", F.pmod(F.xxhash64("home"), F.col("lanes")).cast("int"))
        trees = named.select("shard", "tree").join(own, "shard").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).select("shard", "lane", "tree")
        pairs = trees.groupBy("shard", "lane").cogroup(laned.select("shard", "lane", "home", "asked").groupBy("shard", "lane"))
        return pairs.applyInPandas(_search(k), f"home string, {_HITS}")

    at_home = named.where("asking > 0").select(F.col("shard").alias("home"), F.explode("hits").alias("hit")).select("home", "hit.*")
    first = asked(at_home, None)
    near = staged(best_of(found(first).unionByName(at_home)).drop("rank"), "hits")
    rest = asked(near, first.groupBy("home").agg(F.collect_list("shard").alias("seen")))
    dropped(first)
    return best_of(near.unionByName(found(rest))).select("query_id", "rank", "vec_id", "score")


SQL = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
