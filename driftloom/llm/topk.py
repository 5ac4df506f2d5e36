"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into equal segments; of each the mean and the deviation are kept,
at a coarse and a fine resolution.  For two vectors a and b the squared distance
is at least the sum over segments of ``len * ((mean_a - mean_b)**2 + (dev_a - dev_b)**2)``.
With the norms, that lower bound on the distance is an upper bound on the inner
product: a candidate is dropped where the bound at some resolution, coarse first,
lies under the k-th best exact score so far.  The survivors get exact scores.

Queries are a stated subset; they meet all candidates in blocks.  Query blocks and
candidate blocks are dealt by a hash of id and vector, one pair of blocks a task, and each
pair returns at most k ids a query.  Statistics are computed once a vector and ride along.  Within a block the threshold
rises as candidates are scored, the most promising first.

Vectors of which two might have a product that doesn't fit 62 bits (``LARGEST``) are dealt to blocks of their own. There the same
bounds hold for vectors scaled down by a power of two, and scores are exact integers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.plans.lineage import cut

QUERY_BLOCK, CANDIDATE_BLOCK, LONG_BLOCK = 2048, 8192, 1024
#: Bound on an ordinary scaled vector's length, so that inner products of two stay under 2**62.
LARGEST = float(1 << 31)
#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (4, 16)


def integer_vectors(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, x, scale) with v the components as floor(scale * x), or null where they are so large that x has to stand for them.

    Left out are rows with a null id and vectors that are null or not finite throughout.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    short = F.aggregate(x, F.lit(0.0), lambda total, c: total + c * scale * c * scale) < LARGEST**2
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    own = F.when(short, F.transform(x, lambda c: F.floor(c * scale)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), own.alias("v"), F.when(~short, x).alias("x"), F.lit(scale).alias("scale"))


def whole_numbers(x: list[float], scale: int) -> list[int]:
    """floor(scale * c) of finite components of any size."""
    # from 2**53 on a double is an integer itself
    return [scale * int(c) if abs(c) >= 1 << 53 else math.floor(c * scale) for c in x]


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """For each row and segment sqrt(len) * mean and sqrt(len) * deviation; their products sum to a bound on the inner product."""
    dims = v.shape[1]
    bounds = np.linspace(0, dims, min(segments, dims) + 1).astype(int)
    size = np.diff(bounds)
    mean = np.add.reduceat(v, bounds[:-1], axis=1) / size
    square = np.add.reduceat(v * v, bounds[:-1], axis=1) / size
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean * np.sqrt(size), deviation * np.sqrt(size)], axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``b`` with ``a``, both of integers or of doubles that hold such."""
    return (b @ a).astype(np.int64)


def statistics(v: np.ndarray) -> np.ndarray:
    """The statistics of all resolutions, side by side."""
    return np.concatenate([segment_statistics(v.astype(np.float64), s) for s in RESOLUTIONS], axis=1)


def search_block(query_ids: np.ndarray, queries: np.ndarray, query_stats: np.ndarray, ids: np.ndarray, candidates: np.ndarray, stats: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) with the k best ids of each query row in this block, ties to the smaller id.

    A candidate with the query's own id doesn't count; of several vectors with one id the best counts.
    """
    first = 2 * min(RESOLUTIONS[0], queries.shape[1])
    fine = np.ascontiguousarray(stats[:, first:])
    coarse = query_stats[:, :first] @ stats[:, :first].T
    # room for the rounding of the bounds themselves
    slack = 1e-9 * (np.abs(query_stats).sum(axis=1) * np.abs(stats).max() + 1)
    # doubles add up integers exactly as long as no sum reaches 2**53, and much faster
    q, c = queries.astype(np.float64), candidates.astype(np.float64)
    if max((x * x).sum(axis=1).max() for x in (q, c)) < 1 << 52:
        queries, candidates = q, c
    found: tuple[list, list, list] = ([], [], [])
    for i in range(len(queries)):
        bound, finer, least = coarse[i] + slack[i], None, None
        left = np.flatnonzero(ids != query_ids[i])
        if len(left) > 4 * k:  # what lies under the k-th best score of the most promising of as many ids needn't be put in order
            some = left[np.argpartition(-bound[left], 4 * k - 1)[: 4 * k]]
            names, best = ids[some], exact_products(queries[i], candidates[some])
            if len(np.unique(names)) == len(names):
                least = np.partition(best, len(best) - k)[len(best) - k]
                left = left[bound[left] >= least]
        order = left[np.argsort(-bound[left])]
        scores, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 16 * k
        while at < len(order) and (least is None or bound[order[at]] >= least):
            part = order[at : at + step]
            at, step = at + step, 4 * step
            if least is not None:
                part = part[bound[part] >= least]
                if finer is None:  # where the coarse bound left any
                    finer = fine @ query_stats[i, first:] + slack[i]
                part = part[finer[part] >= least]
            exact = exact_products(queries[i], candidates[part])
            if least is not None:
                part, exact = part[exact >= least], exact[exact >= least]
            scores, names = np.concatenate([scores, exact]), np.concatenate([names, ids[part]])
            best = np.lexsort((names, -scores))
            _, once = np.unique(names[best], return_index=True)  # the best of each id
            best = best[np.sort(once)][:k]
            scores, names = scores[best], names[best]
            least = scores[-1] if len(scores) == k else least
        found[0].append(np.full(len(scores), query_ids[i]))
        found[1].append(names)
        found[2].append(scores)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _scaled(vectors: list[list[int]]) -> tuple[np.ndarray, int]:
    """Vectors as doubles of a bounded size, and the power of two that they were divided by."""
    most = max((abs(c) for v in vectors for c in v), default=0)
    shift = max(0, most.bit_length() - 400)
    return np.array([[float(c >> shift) for c in v] for v in vectors], dtype=np.float64).reshape(len(vectors), -1), shift


def search_long(query_ids: list[int], queries: list[list[int]], ids: list[int], candidates: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """As ``search_block`` for integers of any size: (query_id, vec_id, score)."""
    a, by_a = _scaled(queries)
    b, by_b = _scaled(candidates)
    if a.shape[1]:
        qs, cs = statistics(a), statistics(b)
        bound = qs @ cs.T + (1e-9 * (np.abs(qs).sum(axis=1) * np.abs(cs).max() + 1))[:, None] + 4 * a.shape[1] * (np.abs(a).max() + np.abs(b).max() + 1) * bool(by_a or by_b)
    else:
        bound = np.zeros((len(queries), len(candidates)))
    out = []
    for i, query in enumerate(queries):
        best: dict[int, int] = {}
        least = None
        for c in np.argsort(-bound[i], kind="stable").tolist():
            if least is not None and bound[i, c] < least:
                break
            if ids[c] == query_ids[i]:
                continue
            score = sum(p * q for p, q in zip(query, candidates[c], strict=True))
            if ids[c] not in best or score > best[ids[c]]:
                best[ids[c]] = score
                if len(best) >= k:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
                    last = min(best.values())
                    # bounds count in units of what both sides were divided by
                    least = float(last >> (by_a + by_b)) if last.bit_length() < 1000 + by_a + by_b else None
        out += [(query_ids[i], name, score) for name, score in best.items()]
    return out


def _ordered(score: int) -> tuple[int, str]:
    """The nearest long to a score, and a string that puts scores of one long in order."""
    near = max(-(1 << 63), min((1 << 63) - 1, score))
    if near == score:
        return near, "1"
    digits = f"{len(str(abs(score))):06d}{abs(score)}"
    return near, "2" + digits if score > 0 else "0" + digits.translate(str.maketrans("0123456789", "9876543210"))


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors(vec_id, v)`` with the largest inner product for each query.

    ``vectors`` are as ``integer_vectors`` returns them; rows where ``is_query`` holds are the queries.
    All scores are exact and decide the order; ties go to the smaller id.  A score that doesn't fit a long is given as the nearest long.
    Only vectors of as many components are compared; those without components have the score 0.

    - A query's candidates are all rows with another id; with fewer than k of them it gets fewer rows, with none no row.
    - Rows that share an id are one candidate with the best of their scores, and one query likewise.
    - Other columns aren't read.  An empty table gives an empty table.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                stats = statistics(np.asarray(pc.list_flatten(part.column(1))).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s.tobytes() for s in stats], pa.binary())], names=["vec_id", "v", "dims", "q", "s"])

    size = F.size(F.coalesce("v", "x"))
    plain = vectors.select("vec_id", "v", size.alias("dims"), F.coalesce(is_query, F.lit(False)).alias("q"), "x", "scale")
    long = (F.col("dims") == 0) | F.col("v").isNull()
    usual = plain.where(~long).select("vec_id", "v", "dims", "q").mapInArrow(described, "vec_id long, v array<long>, dims int, q boolean, s binary")
    rows = cut(usual.unionByName(plain.where(long), allowMissingColumns=True).withColumn("long", F.col("s").isNull()))
    n, n_queries, n_long, long_queries = rows.agg(F.count_if(~F.col("long")), F.count_if(F.col("q") & ~F.col("long")), F.count_if("long"), F.count_if(F.col("q") & F.col("long"))).first()
    blocks_of = lambda count, size: -(-count // size)
    query_blocks, blocks = max(1, blocks_of(n_queries, QUERY_BLOCK)), max(1, blocks_of(n, CANDIDATE_BLOCK))
    # long vectors have blocks of their own after those of all others
    more_queries, more = blocks_of(long_queries, LONG_BLOCK), blocks_of(n_long, LONG_BLOCK)

    def dealt(i: int, count: int, after: int) -> Column:
        name = F.xxhash64("vec_id", "v", "x", F.lit(i))
        return F.when(F.col("long"), F.lit(count) + F.pmod(name, F.lit(max(1, after)))).otherwise(F.pmod(name, F.lit(count))).cast("int")

    def spread(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    own = ["dims", "vec_id", "v", "s", "x", "scale"]
    asked = rows.where("q").select(*own, F.lit(True).alias("q"), dealt(1, query_blocks, more_queries).alias("a"), spread(blocks + more).alias("b"))
    offered = rows.select(*own, F.lit(False).alias("q"), spread(query_blocks + more_queries).alias("a"), dealt(2, blocks, more).alias("b"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        q = table.column("q").to_numpy()
        got = [np.zeros(0, np.int64)] * 3
        keys = None
        if q.any() and not q.all():
            ids = table.column("vec_id").to_numpy()
            if table.column("s").null_count:
                whole = [v if x is None else whole_numbers(x, scale) for v, x, scale in zip(*(table.column(c).to_pylist() for c in ("v", "x", "scale")), strict=True)]
                part = [[w for w, own in zip(whole, q, strict=True) if own == side] for side in (True, False)]
                found = search_long(ids[q].tolist(), part[0], ids[~q].tolist(), part[1], k)
                scores = [_ordered(score) for _, _, score in found]
                got, keys = [[f[0] for f in found], [f[1] for f in found], [s[0] for s in scores]], [s[1] for s in scores]
            else:
                v = np.asarray(pc.list_flatten(table.column("v"))).reshape(len(ids), -1)
                s = np.frombuffer(b"".join(table.column("s").to_pylist())).reshape(len(ids), -1)
                got = search_block(ids[q], v[q], s[q], ids[~q], v[~q], s[~q], k)
        own = [pa.array(np.asarray(x, np.int64)) for x in got]
        return pa.table([*own, pa.array(keys or ["1"] * len(own[0]), pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    part = asked.unionByName(offered).groupBy("dims", "a", "b").applyInArrow(run, "query_id long, vec_id long, score long, beyond string")
    # several vectors of one query id
    once = part.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "beyond")).alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("best.score").alias("score"))
