"""Embedding near-dedup by product quantisation.

1. Vectors that are equal in all components collapse to a class with the
   smallest id and a count, by one aggregation with map-side combine.
2. A bounded sample (``Params.sample`` classes of a length) fits, in a task, the coarse centroids and the
   residual codebooks of each subspace.  There are about as many lists as the square root of the classes.  Beyond
   ``Params.coarse`` of them a list is a coarse centroid plus one of the fine ones that all share, so the model's
   size depends on the parameters alone.
3. Each class goes to its home list, with the 8-byte code of its residual, and as a query to every list
   whose centroid is within ``Params.probe_margin`` of its nearest one's squared distance, ``Params.probes`` lists at least.
4. Lists are dealt in blocks of members and of queries, so a hot list is many tasks.  A task
   adds up table-lookup distances over the codes, keeps what may lie within the threshold, and
   reranks that by exact cosine in double precision.  The vectors ride along in their own precision: to fetch
   them by a join would make a row of each pair of a group.  A task returns each class's count of links and
   a spanning forest of them, never the pairs.

A pair is seen where one of the two probes the other's home; it is counted in
the list of the smaller number if both do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.skew import join_counted
from driftloom.operators.graph import connected_components
from driftloom.plans.lineage import cut


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the vectors that the model is fitted on, ``coarse`` each of the two levels of centroids.

    ``lists`` sets the number of lists, which else follows the number of classes.  ``lengths`` bounds the vector lengths that have a model, the
    commonest; vectors of other lengths are compared exactly within their length.
    """

    sample: int = 20_000
    coarse: int = 1024
    lists: int | None = None
    lengths: int = 16
    subspaces: int = 8
    codes: int = 64
    rounds: int = 6
    probes: int = 4
    probe_margin: float = 0.12
    #: Added to the table distance's threshold, for what the codes leave out.
    slack: float = 0.35
    block: int = 2048


@dataclass(frozen=True)
class Model:
    """List number ``c * len(fine) + f`` has the centroid ``coarse[c] + fine[f]``."""

    coarse: np.ndarray  # (lists of the first level, dims)
    fine: np.ndarray  # (lists of the second level, dims), one row of zeros if there is no second level
    codebooks: np.ndarray  # (subspaces, codes, width), dims padded to subspaces * width

    def centroid(self, number: int) -> np.ndarray:
        return self.coarse[number // len(self.fine)] + self.fine[number % len(self.fine)]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of the rows of ``x``, which are repeated if there are fewer than k."""
    centroids = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _split(x: np.ndarray, subspaces: int) -> np.ndarray:
    """(rows, subspaces, width), padded with zeros."""
    width = -(-x.shape[1] // subspaces)
    return np.pad(x, ((0, 0), (0, subspaces * width - x.shape[1]))).reshape(len(x), subspaces, width)


def fit(unit: np.ndarray, lists: int, params: Params) -> Model:
    rng = np.random.default_rng(7)
    first = min(lists, params.coarse)
    second = min(-(-lists // first), params.coarse)
    coarse = _kmeans(unit, first, params.rounds, rng)
    rest = unit - coarse[np.argmin(_squared(unit, coarse), axis=1)]
    fine = _kmeans(rest, second, params.rounds, rng) if second > 1 else np.zeros((1, unit.shape[1]))
    rest = _split(rest - fine[np.argmin(_squared(rest, fine), axis=1)], params.subspaces)
    return Model(coarse, fine, np.stack([_kmeans(rest[:, s], params.codes, params.rounds, rng) for s in range(params.subspaces)]))


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1)


def probed(x: np.ndarray, model: Model, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each row, row, list): the lists that each row probes, the home among them.

    With two levels, a row looks at the lists under its ``probes`` nearest coarse centroids and those within the margin.
    """
    rows, numbers, distances = [], [], []
    top = _squared(x, model.coarse)
    if len(model.fine) == 1:
        rows, numbers, distances = np.repeat(np.arange(len(x)), len(model.coarse)), np.tile(np.arange(len(model.coarse)), len(x)), top.ravel()
    else:
        row, c = np.nonzero(top <= _reach(top, params)[:, None])
        below = _squared(x[row] - model.coarse[c], model.fine)
        f = len(model.fine)
        rows, numbers, distances = np.repeat(row, f), (c[:, None] * f + np.arange(f)).ravel(), below.ravel()
    per = np.bincount(rows, minlength=len(x))
    ends = np.cumsum(per)
    order = np.lexsort((distances, rows))
    rows, numbers, distances = rows[order], numbers[order], distances[order]
    starts = ends - per
    kth = starts + np.minimum(params.probes, per) - 1
    reach = np.maximum(distances[starts] + params.probe_margin, distances[kth])
    near = distances <= reach[rows]
    return numbers[starts], rows[near], numbers[near]


def _reach(distances: np.ndarray, params: Params) -> np.ndarray:
    k = min(params.probes, distances.shape[1])
    return np.maximum(distances.min(axis=1) + params.probe_margin, np.partition(distances, k - 1, axis=1)[:, k - 1])


def encode(rest: np.ndarray, model: Model) -> np.ndarray:
    """The codes of residuals, one byte a subspace."""
    parts = _split(rest, len(model.codebooks))
    return np.stack([np.argmin(_squared(parts[:, s], book), axis=1) for s, book in enumerate(model.codebooks)], axis=1).astype(np.uint8)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(pc.list_flatten(column), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large and very small components keep their direction
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(list_no: int, m: pa.Table, q: pa.Table, model: Model | None, least: float, params: Params) -> pa.Table:
    """(id, n, other): counts of links of one block of members and queries, and a forest of them where ``other`` isn't null."""
    ids_m, ids_q = m.column("id").to_numpy(), q.column("id").to_numpy()
    n_m, n_q = m.column("n").to_numpy(), q.column("n").to_numpy()
    x_m, x_q = _unit(_vectors(m.column("v"))), _unit(_vectors(q.column("v")))
    homes = q.column("home").to_numpy()
    if model is not None:
        codes = np.frombuffer(b"".join(m.column("code").to_pylist()), np.uint8).reshape(len(ids_m), -1)
        rest = _split(x_q - model.centroid(list_no), params.subspaces)
        tables = np.stack([_squared(rest[:, s], book) for s, book in enumerate(model.codebooks)], axis=1).astype(np.float32)
        limit = 2 - 2 * least + params.slack
        # (home of a query, member) where the member probes that home too
        probes = m.column("probes").combine_chunks()
        owner = np.repeat(np.arange(len(ids_m)), pc.list_value_length(probes).to_numpy())
        numbers = pc.list_flatten(probes).to_numpy()
        both = {}
        for number in np.unique(homes[homes < list_no]).tolist():
            both[number] = np.zeros(len(ids_m), bool)
            both[number][owner[numbers == number]] = True
    count_m, count_q = np.zeros(len(ids_m), np.int64), np.zeros(len(ids_q), np.int64)
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    edges: list[tuple[int, int]] = []
    for i in range(len(ids_q)):
        if model is None:
            near = np.arange(len(ids_m))
        else:
            distance = tables[i, 0, codes[:, 0]]
            for s in range(1, params.subspaces):
                distance = distance + tables[i, s, codes[:, s]]
            near = np.flatnonzero(distance <= limit)
        # each pair once: within the home list by the order of ids, across lists in the smaller list if both see it
        if homes[i] == list_no:
            near = near[ids_m[near] < ids_q[i]]
        elif homes[i] < list_no:
            near = near[~both[int(homes[i])][near]]
        if not len(near):
            continue
        near = near[x_m[near] @ x_q[i] >= least]
        if not len(near):
            continue
        count_q[i] += n_m[near].sum()
        count_m[near] += n_q[i]
        for j in near.tolist():
            a, b = root(int(ids_q[i])), root(int(ids_m[j]))
            if a != b:
                up[max(a, b)] = min(a, b)
                edges.append((int(ids_q[i]), int(ids_m[j])))
    ids = np.concatenate([ids_m[count_m > 0], ids_q[count_q > 0]])
    counts = np.concatenate([count_m[count_m > 0], count_q[count_q > 0]])
    src, dst = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    return pa.table(
        [
            pa.array(np.concatenate([ids, src])),
            pa.array(np.concatenate([counts, np.zeros(len(src), np.int64)])),
            pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(dst)]),
        ],
        names=["id", "n", "other"],
    )


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", params: Params = Params()) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``vectors``.

    Vectors link where their cosine in double precision is ``least`` or more.  ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest id that links reach,
    ``kept`` marks the row whose id that is.  Every link is exact; the search may miss some (see the README for measured recall).

    - Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
    - A null id links with nothing, its ``component_id`` is null and it is kept.
    - Equal vectors are linked with each other, whatever their number.  Rows that share an id are one node:
      unlike vectors of it don't link with each other, and each row has the links of all.
    - Vectors of unlike length don't link.  The commonest lengths have models; others are compared in full within their length.
    - Other columns aren't read.  An empty table gives an empty table.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    x = F.col(vector_col).cast(kind)
    usable = F.coalesce(
        F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False)
    )
    # 0 + x turns -0.0 into 0.0, so that equal vectors have equal keys
    zero = F.lit(0.0).cast("float" if kind == "array<float>" else "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, F.transform(x, lambda c: c + zero)).alias("v"))
    classes = cut(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    found = cut(_search(classes, kind, least, params))
    components = connected_components(found.where("other IS NOT NULL"), "id", "other")
    # several classes may have one id, so classes are told apart by their vectors
    done = (
        classes.join(found.where("other IS NULL").groupBy("id").agg(F.sum("n").alias("linked")), "id", "left")
        .join(components.select(F.col("node").alias("id"), F.col("component").alias("component_id")), "id", "left")
        .select("v", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    linked = join_counted(rows.where("v IS NOT NULL"), cut(done), ["v"], "n", rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _models(classes: DataFrame, params: Params) -> dict[int, Model]:
    """A model for each of the commonest vector lengths, each fitted in a task on a bounded sample."""
    common = classes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(params.lengths)
    common = F.broadcast(common)  # params.lengths rows
    part = F.least(F.lit(1.0), F.lit(1.1 * params.sample) / F.col("n"))
    drawn = classes.select("id", "v", F.size("v").alias("dims")).join(common, "dims").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < part * (1 << 20))
    first = Window.partitionBy("dims").orderBy(F.xxhash64("id", F.lit(6)), "id", "v")
    drawn = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= params.sample)

    def run(table: pa.Table) -> pa.Table:
        x = _unit(_vectors(table.column("v")))
        n = table.column("n")[0].as_py()
        model = fit(x, params.lists or max(1, math.isqrt(n)), params)
        parts = [a.astype(np.float64).tobytes() for a in (model.coarse, model.fine, model.codebooks)]
        return pa.table([pa.array([x.shape[1]], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["dims", "coarse", "fine", "books"])

    fitted = drawn.select("dims", "n", "v").groupBy("dims").applyInArrow(run, "dims int, coarse binary, fine binary, books binary").collect()
    out = {}
    for r in fitted:
        dims = r["dims"]
        books = np.frombuffer(r["books"]).reshape(params.subspaces, params.codes, -1)
        out[dims] = Model(np.frombuffer(r["coarse"]).reshape(-1, dims), np.frombuffer(r["fine"]).reshape(-1, dims), books)
    return out


def _search(classes: DataFrame, kind: str, least: float, params: Params) -> DataFrame:
    """(id, n, other) as ``_links`` returns them, for all classes."""
    shared = classes.sparkSession.sparkContext.broadcast(_models(classes, params))
    names = ["id", "v", "n", "home", "list", "member", "code", "probes"]

    def placed_rows(part: pa.RecordBatch, model: Model | None) -> pa.RecordBatch:
        size = part.num_rows
        if model is None:
            home, row, to = np.zeros(size, np.int64), np.arange(size), np.zeros(size, np.int64)
            codes = [b""] * size
        else:
            x = _unit(_vectors(part.column(1)))
            home, row, to = probed(x, model, params)
            centre = model.coarse[home // len(model.fine)] + model.fine[home % len(model.fine)]
            codes = [c.tobytes() for c in encode(x - centre, model)]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))]).astype(np.int32)
        own = pa.ListArray.from_arrays(pa.array(bounds), pa.array(to.astype(np.int64)))
        at = np.concatenate([np.arange(size), row])
        taken = part.take(pa.array(at))
        more = len(row)
        none = pa.ListArray.from_arrays(pa.array(np.zeros(more + 1, np.int32)), pa.array([], pa.int64()))
        columns = [taken.column(0), taken.column(1), taken.column(2), pa.array(home[at].astype(np.int64)), pa.array(np.concatenate([home, to]).astype(np.int64)), pa.array(np.arange(len(at)) < size)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(codes + [b""] * more, pa.binary()), pa.concat_arrays([own, none])], names=names)

    def place(batches):
        models = shared.value
        for batch in batches:
            length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dims in np.unique(length).tolist():
                part = batch.filter(pa.array(length == dims))
                for at in range(0, part.num_rows, 256):
                    yield placed_rows(part.slice(at, 256), models.get(dims))

    schema = f"id long, v {kind}, n long, home long, list long, member boolean, code binary, probes array<long>"
    placed = cut(classes.select("id", "v", "n").mapInArrow(place, schema)).withColumn("dims", F.size("v"))
    # a hot list is dealt to more blocks of members and of queries; one row a list
    sizes = placed.groupBy("dims", "list").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q"))
    blocks = {k: F.greatest(F.lit(1), F.ceil(F.col(k) / params.block)).cast("int").alias(k + "s") for k in ("m", "q")}
    large = sizes.where((F.col("m") > params.block) | (F.col("q") > params.block)).select("dims", "list", *blocks.values())
    dealt = placed.join(large, ["dims", "list"], "left").fillna(1, ["ms", "qs"])

    def mine(k: str) -> Column:
        return F.array(F.pmod(F.xxhash64("id", "v", F.lit(3)), F.col(k)).cast("int"))

    def every(k: str) -> Column:
        return F.sequence(F.lit(0), F.col(k) - 1)

    dealt = dealt.withColumn("a", F.explode(F.when(F.col("member"), mine("ms")).otherwise(every("ms"))))
    dealt = dealt.withColumn("b", F.explode(F.when(F.col("member"), every("qs")).otherwise(mine("qs"))))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        member = table.column("member")
        if not 0 < pc.sum(member).as_py() < len(member):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        model = shared.value.get(table.column("dims")[0].as_py())
        return _links(table.column("list")[0].as_py(), table.filter(member), table.filter(pc.invert(member)), model, least, params)

    return dealt.select("dims", "list", "a", "b", "id", "v", "n", "home", "member", "code", "probes").groupBy("dims", "list", "a", "b").applyInArrow(run, "id long, n long, other long")
