"""Exact top-k by inner product: tiled matrix products, partial selection, tree merging.

Queries and candidates are cut into blocks by a hash of their ids; every (query block,
candidate block) pair is one tile, whose scores are one matrix product. A tile keeps its
best k of each query; the lists are merged level by level, ``FAN_IN`` lists at a time, so
no task sees more than ``FAN_IN * k`` rows of a query. Each side is repeated once per
block of the other side; nothing is broadcast and no pair leaves its tile.

Components are integers floor(scale * x), held as doubles: beyond 2**53 every double is an
integer. Products run in float64 while every partial sum stays below 2**53 and is then exact; a
tile whose bound is larger uses Python integers. A score beyond the range of a long counts as
the nearest long.

Defined results: vectors that are null or hold null or non-finite components (or such whose
scaled value is beyond a double) take no part, nor do rows without an id; only vectors of equal length are compared; a query never
meets rows of its own id; rows that repeat an id and its vector count once; of an id with several vectors
each vector counts. Ties go to the smaller id. Fewer than k candidates: all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import save_stage

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
FAN_IN = 32
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: int) -> Column:
    """Integer components; null unless every component is a finite number."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    scaled = F.transform(whole, lambda x: x * scale)
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(scaled, lambda x: F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x)))


def _tile_top(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            q, c = np.vstack(left["q_vec"].to_numpy()), np.vstack(right["vec"].to_numpy())
            q_ids, ids = left["q_id"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            c, ids = c[order], ids[order]
            bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
            kind = np.float64 if bound < EXACT else object
            if kind is object:
                q, c = (np.array([[int(x) for x in row] for row in side], dtype=object).reshape(side.shape) for side in (q, c))
            for at in range(0, len(q), 256):
                scores = q[at:at + 256] @ c.T
                if kind is object:
                    scores = np.maximum(np.minimum(scores, MOST), LEAST)
                for row, own in zip(scores, q_ids[at:at + 256]):
                    usable = np.flatnonzero(ids != own)
                    values = row[usable]
                    if len(values) > k:
                        # the k-th score bounds what can be kept; its ties are cut by the id order of the columns
                        least = np.partition(values, len(values) - k)[len(values) - k] if kind is np.float64 else sorted(values)[-k]
                        above, level = usable[values > least], usable[values == least]
                        usable = np.concatenate([above, level[:k - len(above)]])
                    found.append(pd.DataFrame({"query_id": own, "vec_id": ids[usable], "score": row[usable].astype(np.int64)}))
        out = pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return out.astype("int64").assign(part=np.int32(key[1]))[["query_id", "vec_id", "score", "part"]]
    return run


def merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """Merge lists of numbered parts, FAN_IN at a time, into query_id, rank, vec_id, score."""
    while True:
        lists = lists.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        parts = math.ceil(parts / FAN_IN)
        best = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if parts <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; both inputs have vec_id and embedding."""
    def ready(df: DataFrame, label: str) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding"), scale).alias("vec"))
        return save_stage(rows.filter("id is not null and vec is not null").distinct().withColumn("dim", F.size("vec")), label)
    q, c = ready(queries, "topk-queries"), ready(candidates, "topk-candidates")
    n_q, n_c = max(1, math.ceil(q.count() / QUERY_BLOCK)), max(1, math.ceil(c.count() / CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), "dim", block(n_q).alias("q_block"), everywhere(n_c).alias("c_block"))
    right = c.select("id", "vec", "dim", block(n_c).alias("c_block"), everywhere(n_q).alias("q_block"))
    tiles = left.groupBy("q_block", "c_block", "dim").cogroup(right.groupBy("q_block", "c_block", "dim"))
    return merged(tiles.applyInPandas(_tile_top(k), "query_id long, vec_id long, score long, part int"), n_c, k)
