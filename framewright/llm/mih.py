"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are scaled by the largest norm and given one more coordinate so that all lie on the unit
sphere and the order by inner product is the order by angle. Rotations learned on a bounded
sample (SAMPLE rows; alternating sign codes and orthogonal Procrustes, from TURNS random starts)
give BITS-bit codes, split into substrings of 16 bits, each of which indexes every row of a block.

A query probes, in every substring's table, all values within floor(radius / substrings) bits of its
own; by the pigeonhole principle it so meets every code within the radius. Where the values to probe
outnumber the rows of the block, its codes are compared in turn instead, with the same result. Codes
within the radius are ranked by the exact inner product in double precision. Each query climbs a
ladder of radii until the radius covers, with a margin, the codes to be expected at the angle of the last
of its neighbours in the block (k over the number of blocks, and two deviations more); the last rung is fitted on the sample, so that it holds TARGET of the sample's true
neighbours. Queries with near neighbours so look at few rows; where all vectors are far apart (neighbours
at 65 degrees and more) a radius that holds them is beyond what tables can prune.

Rows are dealt into blocks of at most about BLOCK_ROWS, queries into blocks of QUERY_ROWS; each
pair of blocks is one group, which gives each query its `k` best, and the best of all blocks are
merged. Memory follows the two bounds, not the table.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do vectors
of another length than most (the greater length on a tie), nor rows without an id. Equal scores go by
smaller id, in a block and between blocks; a query is no candidate of its own (rows that repeat its id
are none either); a candidate's repeated rows count once. Fewer than k candidates: all. Empty table: no
rows. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import stored

BITS, TURNS, SAMPLE, FIT_QUERIES, TARGET = 256, 8, 4000, 200, 0.985
BLOCK_ROWS, QUERY_ROWS, SEED = 1 << 17, 1 << 13, 11


def _rotation(x: np.ndarray, bits: int, rng: np.random.Generator, turns: int) -> np.ndarray:
    """Columns of an orthogonal map onto `bits` (at most the dimension) axes that fits sign codes."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0][:, :bits]
    for _ in range(turns):
        u, _, v = np.linalg.svd(x.T @ np.sign(x @ r), full_matrices=False)
        r = u @ v
    return r


def encode(x: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes."""
    return np.packbits(x @ maps > 0, axis=1)


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    v = v / top
    return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))])


class Codes:
    """Tables over the 16-bit substrings of the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        parts = np.ascontiguousarray(codes).view(np.uint16)
        self.n, self.m = parts.shape
        order = np.argsort(parts, axis=0, kind="stable")
        start = [np.searchsorted(parts[order[:, j], j], np.arange(65537)) + j * self.n for j in range(self.m)]
        # the tables one after the other: rows by value, and the place of each value's first row
        self.order, self.start = order.T.ravel().astype(np.int32), np.concatenate(start)
        self.base = (np.arange(self.m) * 65537)[:, None]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """Rows whose code differs from `code` in at most `radius` bits, and how many rows were looked at.

        The tables hold every such row under a value within floor(radius / substrings) bits of the code's.
        Where the values to probe outnumber the block's rows, its codes are compared in turn.
        """
        near = _masks(radius // self.m)
        if len(near) * self.m > self.n:
            found = np.arange(self.n)
        else:
            at = ((near[None, :] ^ code.view(np.uint16)[:, None]).astype(np.int64) + self.base).ravel()
            lo = self.start[at]
            size = self.start[at + 1] - lo
            some = np.flatnonzero(size)
            lo, size = lo[some], size[some]
            found = np.unique(self.order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())])
        apart = np.bitwise_count(self.words[found] ^ code.view(np.uint64)).sum(1)
        return found[apart <= radius], len(found)


@functools.cache
def _masks(bits: int) -> np.ndarray:
    """All 16-bit numbers with at most so many bits."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) <= bits]


def best(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k nearest of some rows."""
    rows = rows[ids[rows] != own]
    if len(rows) > 4 * k:
        rough = vectors[rows] @ query
        cut = np.partition(rough, len(rows) - k)[len(rows) - k]
        rows = rows[rough >= cut - 1e-9 * max(1.0, abs(cut))]
    score = (vectors[rows] * query).sum(1)  # summed row by row, so that equal vectors tie in any block
    order = np.lexsort((ids[rows], -score))[:k]
    return ids[rows[order]], score[order]


def reach(cosine: float, bits: int = BITS, sigmas: float = 2.5) -> float:
    """Bits by which the code of a vector at this angle differs, with a margin: a bit flips with probability angle / pi."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return bits * p + sigmas * np.sqrt(bits * p * (1 - p))


def learn(x: np.ndarray, top: float, k: int, bits: int = BITS) -> tuple[np.ndarray, list[int]]:
    """Rotations and the ladder of radii, from a sample of vectors."""
    rng = np.random.default_rng(SEED)
    y = lifted(x, top)
    per = y.shape[1]
    maps = np.hstack([_rotation(y, min(per, bits - i), rng, TURNS) for i in range(0, bits, per)])
    codes, q = encode(y, maps), np.arange(0, len(x), max(1, len(x) // FIT_QUERIES))
    unit = x[q] / np.maximum(np.linalg.norm(x[q], axis=1, keepdims=True), 1e-300)
    asked = encode(np.hstack([unit, np.zeros((len(q), 1))]), maps)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    apart = np.bitwise_count(codes[near] ^ asked[:, None, :]).sum(2).ravel() if near.size else np.array([bits])
    last = int(np.quantile(apart, TARGET, method="higher")) if len(x) > 4 * k else bits
    # rungs so low that hardly a row of the sample has a neighbour there are left out
    m, low = bits // 16, 0.7 * float(np.quantile(apart.reshape(len(q), -1).min(1), 0.01)) if near.size else 0
    return maps, [*[r for r in range(m - 1, last, m) if r >= low], last]


def search(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", probes: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`, against all rows; on request `probed`, the rows that the query looked at in the candidate's block."""
    spark = table.sparkSession
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    top, d = size["top"], size["d"]
    rows = stored(rows.filter(F.size("v") == d).select("vec_id", "v"), "vectors")
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows
    maps, ladder = learn(np.array([r["v"] for r in drawn]), top, k)
    held = spark.sparkContext.broadcast((maps, ladder, top))
    # at least as many groups as the cluster has cores, while a block has some thousand rows
    blocks = max(1, -(-size["n"] // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, size["n"] // 4096))
    # of a query's k nearest a block, to which rows are dealt evenly, mostly holds fewer
    some = min(k, int(np.ceil(k / blocks + 2 * (k / blocks) ** 0.5 + 1)))
    asked = rows.filter(F.col("vec_id") % every == 0)
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    every_part, every_block = F.sequence(F.lit(0), F.lit(parts - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")  # noqa: E731  evenly, also where rows repeat
    index = rows.select(F.col("vec_id").alias("id"), F.col("v").alias("w"), deal(blocks).alias("block")).withColumn("part", F.explode(every_part))
    asked = asked.withColumn("part", deal(parts)).withColumn("block", F.explode(every_block))

    def run(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(block):
            maps, ladder, top = held.value
            ids, vectors = block["id"].to_numpy(), np.stack(block["w"].to_numpy())
            table = Codes(encode(lifted(vectors, top), maps))
            q = np.stack(queries["v"].to_numpy())
            codes = encode(np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))]), maps)
            for own, vector, code in zip(queries["vec_id"], q, codes, strict=True):
                norm, looked = np.linalg.norm(vector), 0
                for radius in ladder:
                    found, rows = table.within(code, radius)
                    looked = max(looked, rows)
                    if radius == ladder[-1] or len(found) <= some:
                        continue
                    _, near = best(vector, own, ids, vectors, found, some)
                    if len(near) == some:
                        need = int(np.ceil(reach(near[-1] / (norm * top))))
                        if need > radius:  # farther ones cannot come nearer than this
                            found, rows = table.within(code, min(need, ladder[-1]))
                            looked = max(looked, rows)
                        break
                if len(found) < len(ids) and (ids[found] != own).sum() < some:
                    found = np.arange(len(ids))  # too few within the last radius: the whole block
                    looked = len(ids)
                for i, s in zip(*best(vector, own, ids, vectors, found, k), strict=True):
                    out.append((own, i, s, looked))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "probed"])

    pairs = asked.groupBy("part", "block").cogroup(index.groupBy("part", "block")).applyInPandas(run, "query_id long, vec_id long, score double, probed long")
    best_ = pairs.groupBy("query_id", "vec_id", "score").agg(F.max("probed").alias("probed"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = best_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score", *(["probed"] if probes else []))
