"""MinHash near-dedup with an LSH forest.

1. ``sketch``: each whole text becomes a set of word shingles, its size, a
   128-bit fingerprint of the set, and ``HASHES`` min-hash values.
2. Equal sets collapse to a class with the smallest id.  This is one
   aggregation with map-side combine, so a huge group of copies is one row per
   map task.
3. Forest: ``TREES`` trees each sort the classes by their own order of the
   signature values (range partitioning, so a hot prefix is cut wherever the order
   allows).  The first ``MIN_DEPTH`` values of the trees are disjoint, the deeper
   ones a permutation of a tree's own.  Classes that share ``MIN_DEPTH`` values of a
   tree are a region.  Each class is a candidate with its neighbour of the longest common
   prefix in the order and with the hub of its region; a region of more than
   ``REGION`` classes goes deeper, value by value, and has a hub for each part.
4. Candidates are confirmed on full shingle sets, and the links make components.
5. The pairs of a region that are neither candidates nor in one component by now are left.  They
   are decided exactly: the region's members outside its largest component meet all its members of other components, block by
   block, and a pair goes on to the full sets only if it could link by how many shingles each has in ``SLOTS``
   buckets: the sum of the smaller counts is never under the overlap.  Only what passes leaves the task and moves a set.

So a pair at similarity J shares no region, and may be missed, with probability
(1 - J**4)**24: 3 in a million at 0.8, whatever a region's size.  A class is in
at most two candidates a tree, so copies of a set are bounded by ``TREES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm import textkernel
from driftloom.llm.skew import join_counted
from driftloom.operators.graph import connected_components
from driftloom.plans.lineage import cut

HASHES = 96
MIN_DEPTH, MAX_DEPTH = 4, 12
TREES = HASHES // MIN_DEPTH
REGION = 64
#: Pairs of one hub that a share holds, more or less.
SHARE = 256
#: Buckets of a set's counts, how many of them are added up for a first look, and members of a region that a task has of each side.
SLOTS, COARSE, BLOCK = 256, 8, 1024
#: Pairs that are compared at a time.
PAIRS = 1 << 16

_MULTIPLIERS = textkernel.mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_KEY = 1 + 2 * MAX_DEPTH


def _orders() -> np.ndarray:
    """For each tree the positions of its values, first its own ``MIN_DEPTH``, then others at random."""
    out = np.empty((TREES, MAX_DEPTH), dtype=np.int64)
    for t in range(TREES):
        own = np.arange(MIN_DEPTH * t, MIN_DEPTH * (t + 1))
        others = np.random.default_rng(t).permutation(np.setdiff1d(np.arange(HASHES), own))
        out[t] = np.concatenate([own, others[: MAX_DEPTH - MIN_DEPTH]])
    return out


_ORDERS = _orders()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The min-hash values of a non-empty set, 16 bits each."""
    low = np.full(HASHES, ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * _MULTIPLIERS).min(axis=0), out=low)
    return (textkernel.mix64(low) >> np.uint64(48)).astype(np.uint16)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for at, end, raw, offsets in textkernel.slices(texts):
        words, first = textkernel.word_hashes(raw, offsets)
        for i in range(end - at):
            yield np.unique(textkernel.shingle_hashes(words[first[i] : first[i + 1]], width))


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig) of each row; sig is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sigs = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                h1.append(int(np.add.reduce(s).astype(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(textkernel.mix64(s + np.uint64(1))).astype(np.int64)) if len(s) else 0)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "sig"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _tree_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): for each tree its number and the first MAX_DEPTH values in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
            keys = np.empty((len(sigs), TREES, _KEY), dtype=np.uint8)
            keys[:, :, 0] = np.arange(TREES, dtype=np.uint8)
            keys[:, :, 1:] = np.ascontiguousarray(sigs[:, _ORDERS]).view(np.uint8)
            flat = pa.Array.from_buffers(pa.binary(_KEY), len(sigs) * TREES, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([flat, pa.array(np.repeat(batch.column(0).to_numpy(), TREES))], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key binary, rep long")


def _region_links(keys: np.ndarray, reps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, others): the neighbours of one region in the order, and hubs of parts of at most ``REGION`` or of all values equal."""
    yield reps[1:], reps[:-1]
    todo = [(0, len(reps), MIN_DEPTH)]
    while todo:
        at, end, depth = todo.pop()
        if end - at < 3:  # two are neighbours
            continue
        if end - at <= REGION or depth == MAX_DEPTH:
            yield reps[at + 2 : end], np.full(end - at - 2, reps[at])
            continue
        part = keys[at:end, 1 + 2 * depth : 3 + 2 * depth]
        starts = np.flatnonzero((part[1:] != part[:-1]).any(axis=1)) + 1
        bounds = [0, *starts.tolist(), end - at]
        todo += [(at + a, at + b, depth + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: links (src, dst), and the members (src, region) of regions of several; ``border`` marks
    the outermost members at both ends, whose regions may go on in the partitions beside."""
    names = ["src", "dst", "region", "border"]
    prefix = 1 + 2 * MIN_DEPTH

    def named(rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows), np.uint64)
        for column in rows[:, :prefix].T:
            total = textkernel.mix64(total * np.uint64(257) + column)
        return total.view(np.int64)

    def out(keys: np.ndarray, reps: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        several = np.flatnonzero(np.diff(bounds) > 1)
        if not len(several):
            return
        links = [x for i in several for x in _region_links(keys[bounds[i] : bounds[i + 1]], reps[bounds[i] : bounds[i + 1]])]
        src, dst = (np.concatenate([x[k] for x in links]) for k in (0, 1))
        n = len(src)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))], names=names)
        inside = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in several])
        n = len(inside)
        yield pa.RecordBatch.from_arrays([pa.array(reps[inside]), pa.nulls(n, pa.int64()), pa.array(named(keys[inside])), pa.array(np.zeros(n, bool))], names=names)

    def border(key: np.ndarray, rep: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(rep)]), pa.nulls(1, pa.int64()), pa.array(named(key[None])), pa.array([True])], names=names)

    held: list[tuple[np.ndarray, np.ndarray]] = []  # the region that is still growing, a part a batch

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            keys, reps = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            yield from out(keys, reps, np.array([0, len(reps)]))

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, reps = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, _KEY), batch.column(1).to_numpy()
        if last is None:
            yield border(keys[0], reps[0])
        elif (keys[0, :prefix] != last[0][:prefix]).any():
            yield from flush()
        last = keys[-1], reps[-1]
        starts = np.flatnonzero((keys[1:, :prefix] != keys[:-1, :prefix]).any(axis=1)) + 1
        if not len(starts):
            held.append((keys, reps))
            continue
        held.append((keys[: starts[0]], reps[: starts[0]]))
        yield from flush()
        yield from out(keys, reps, starts)
        held.append((keys[starts[-1] :], reps[starts[-1] :]))
    yield from flush()
    if last is not None:
        yield border(*last)


def forest(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst), the candidates, and (region, rep), the members of regions of several classes, of ``classes(rep, sig)``."""
    ordered = _tree_keys(classes).repartitionByRange("key").sortWithinPartitions("key", "rep")
    found = cut(ordered.mapInArrow(_neighbours, "src long, dst long, region long, border boolean"))
    links = found.where("dst IS NOT NULL").select("src", "dst")
    # a region that a partition border cuts: at most two rows a partition
    over = found.where("border").groupBy("region").agg(F.collect_set("src").alias("s")).where("size(s) > 1")
    over = over.select(F.explode("s").alias("src"), F.array_min("s").alias("dst"))
    pairs = links.unionByName(over).where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    return pairs, found.where("region IS NOT NULL").select("region", F.col("src").alias("rep"))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have |A & B| * 100 >= percent * |A | B|."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _sets_of(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(rep, s): the shingle set of each text whose id is one of ``reps(rep)``, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, at = batch.column(0), 0
            for s in _bounded(shingle_sets(batch.column(1), width)):
                yield pa.RecordBatch.from_arrays([rep.slice(at, len(s)), pa.array(s, pa.binary())], names=["rep", "s"])
                at += len(s)

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.join(reps, "rep", "left_semi").dropDuplicates(["rep", "text"]).mapInArrow(run, "rep long, s binary")


def _bounded(sets: Iterator[np.ndarray], most: int = 1 << 22) -> Iterator[list[bytes]]:
    """Runs of sets of about ``most`` bytes."""
    held, size = [], 0
    for s in sets:
        held.append(s.tobytes())
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): those of the distinct ``pairs`` that link on their full sets.

    The pairs of a hub (``dst``) are dealt to shares, one for every ``SHARE`` of them, so that most hubs travel once.  A share
    reads the hub's set first and then a member's after the other, so a task holds two sets and not a group.  An id with
    several texts links if any of them does.
    """
    pairs = pairs.select(F.col("dst").alias("hub"), F.col("src").alias("rep"))
    sized = join_counted(pairs, pairs.groupBy("hub").agg(F.count("*").alias("n")), ["hub"], "n", pairs.count())
    dealt = cut(sized.select("hub", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / SHARE)).alias("share"), "rep"))
    hubs = dealt.select("hub", "share", F.col("hub").alias("rep")).distinct()
    rows = dealt.unionByName(hubs).join(sets, "rep").select("hub", "share", "rep", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            src, dst = [], []
            for hub, share, rep, s in zip(*(batch.column(k) for k in range(4)), strict=True):
                hub, share, rep = hub.as_py(), share.as_py(), rep.as_py()
                if (hub, share) != key:
                    key, own = (hub, share), []
                s = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                if rep == hub:
                    own.append(s.copy())
                elif any(similar(s, other, percent) for other in own):
                    src.append(rep), dst.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    ordered = rows.repartition("hub", "share").sortWithinPartitions("hub", "share", F.col("rep") != F.col("hub"), "rep")
    return cut(ordered.mapInArrow(run, "src long, dst long"))


def _counted(sets: DataFrame) -> DataFrame:
    """(rep, n, c) of ``sets(rep, s)``: the size of a set and how many of its shingles fall in each of ``SLOTS``, in as few bytes as the largest count needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts = [], []
            for s in batch.column(1):
                s = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                c = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=SLOTS)
                sizes.append(len(s))
                counts.append(c.astype(np.min_scalar_type(int(c.max()))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary())], names=["rep", "n", "c"])

    return sets.select("rep", "s").mapInArrow(run, "rep long, n long, c binary")


def _unpacked(packed: list[bytes]) -> np.ndarray:
    """Rows of counts from ``_counted``."""
    width = max(map(len, packed)) // SLOTS
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
    if all(len(p) == SLOTS * width for p in packed):
        return np.frombuffer(b"".join(packed), dtype=kind[width]).reshape(-1, SLOTS)
    return np.stack([np.frombuffer(p, dtype=kind[len(p) // SLOTS]).astype(kind[width]) for p in packed])


def possible(asks: np.ndarray, minor: np.ndarray, reps: np.ndarray, labels: np.ndarray, sizes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rep, rep): pairs of a row that ``asks`` with one that doesn't, of different labels, that may link; no pair that links is missing.

    A row that asks is ``minor``.  Two minor rows ask each other, of which the one with the larger rep counts.
    """
    order = np.argsort(sizes, kind="stable")
    asks, minor, reps, labels, sizes, counts = (x[order] for x in (asks, minor, reps, labels, sizes, counts))
    rough = counts.reshape(len(counts), -1, COARSE).sum(axis=2, dtype=np.uint32)
    own, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    low = np.searchsorted(sizes[others], -(-percent * sizes[own] // 100))
    span = np.searchsorted(sizes[others], 100 * sizes[own] // percent, side="right") - low
    width = np.cumsum(span)
    found, at = [], 0
    while at < len(own):
        end = max(at + 1, int(np.searchsorted(width, (width[at - 1] if at else 0) + PAIRS, side="right")))
        n = span[at:end]
        x = np.repeat(own[at:end], n)
        y = others[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:end], n)]
        at = end
        keep = (labels[x] != labels[y]) & (~minor[y] | (reps[x] > reps[y]))
        for table in (rough, counts):
            x, y = x[keep], y[keep]
            bound = np.minimum(table[x], table[y]).sum(axis=1, dtype=np.int64)
            keep = (100 + percent) * bound >= percent * (sizes[x] + sizes[y])
        found.append((reps[x[keep]], reps[y[keep]]))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def left_pairs(members: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(src, dst): pairs of ``members(region, rep)`` that ``linked(node, component)`` doesn't connect and that may link; None if there are none.

    Any two sets of a region that link and aren't connected are among them, and all of them share a region.
    """
    block = BLOCK
    label = F.coalesce("component", "rep").alias("label")
    labelled = cut(members.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("region", "rep", label).distinct())
    parts = labelled.groupBy("region", "label").agg(F.count("*").alias("m"))
    regions = parts.groupBy("region").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.sum("m").alias("all"), (F.sum("m") - F.max("m")).alias("few")).where("few > 0")
    regions = cut(regions)
    total = regions.agg(F.sum("all")).first()[0]
    if total is None:
        return None
    # members of regions of one component alone aren't among them, so the counts of members add up to the total
    mixed = cut(join_counted(labelled.join(regions.select("region"), "region", "left_semi"), regions, ["region"], "all", total))
    own = mixed.join(_counted(sets.join(mixed.select("rep").distinct(), "rep", "left_semi")), "rep")
    # blocks of members outside the largest component, and of all members
    name, to = F.xxhash64("rep"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block) - 1))
    minor = own.where("label <> largest")
    asked = minor.select("region", F.pmod(name, F.ceil(F.col("few") / block)).alias("a"), to("all").alias("b"), F.lit(True).alias("asks"), F.lit(True).alias("minor"), "rep", "label", "n", "c")
    offered = own.select("region", to("few").alias("a"), F.pmod(name, F.ceil(F.col("all") / block)).alias("b"), F.lit(False).alias("asks"), (F.col("label") != F.col("largest")).alias("minor"), "rep", "label", "n", "c")
    rows = asked.unionByName(offered).repartition("region", "a", "b").sortWithinPartitions("region", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([table.column(k).to_numpy() for k in range(3)])
            bounds = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
            asks, minor, reps, labels, sizes = (table.column(k).to_numpy() for k in range(3, 8))
            packed = table.column(8).to_pylist()
            pairs = []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                if asks[low:high].any() and not asks[low:high].all():
                    pairs.append(possible(*(x[low:high] for x in (asks, minor, reps, labels, sizes)), _unpacked(packed[low:high]), percent))
            if pairs:
                x, y = (np.concatenate(side) for side in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = new if rest is None else pa.concat_tables([rest, new])
            keys = np.stack([table.column(k).to_numpy() for k in range(3)])
            # the last tile of a batch may go on in the next
            at = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            if at:
                yield from tiles(table.slice(0, at))
            rest = table.slice(at)
        if rest is not None and rest.num_rows:
            yield from tiles(rest)

    return rows.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate groups of whole texts, one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  The set of a text is its
    distinct shingles of ``width`` words, or all its words as one if there are
    fewer.  Texts link if ``100 * |A & B| >= percent * |A | B|``, decided on the full sets;
    ``component_id`` is the smallest id that links reach, ``kept`` marks the row whose id that is.

    - Null, empty and blank texts have the empty set and link with nothing.
    - A null id links with nothing; its ``component_id`` is null and it is kept.
    - Rows that share an id are one document: it has the links of all of them.
    - Repeated texts have similarity 1, whatever their number.
    - Very long texts are used whole.  Other columns aren't read.  An empty table gives an empty table.
    """
    sketches = cut(sketch(docs, id_col, text_col, width))
    linkable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(linkable.groupBy("h1", "h2", "n_shingles", "sig").agg(F.min("doc_id").alias("rep")))
    found, members = forest(classes)
    pairs = cut(found)
    sets = cut(_sets_of(docs, members.select("rep").distinct(), id_col, text_col, width))
    links = confirmed(pairs, sets, percent)
    components = connected_components(links)
    if (more := left_pairs(members, components, sets, percent)) is not None:
        # components so far are stars
        stars = components.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        components = connected_components(stars.unionByName(confirmed(cut(more), sets, percent)))
    joined = classes.join(components.select(F.col("node").alias("rep"), F.col("component").alias("component_id")), "rep", "left")
    joined = joined.select("h1", "h2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    # several classes of one repeated id are one node, so the smallest is the same for each
    linked = linkable.select("doc_id", "n_shingles", "h1", "h2").join(joined, ["h1", "h2", "n_shingles"])
    alone = sketches.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
