"""Catalogs of files: folder trees with sizes, and the metadata of array hierarchies.

Listings are tables of paths.  A hierarchy is walked level by level, down to a depth, so a walk is as many joins as it may go down; sizes
are rolled up over the ancestors of each path without any recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.plans.lineage import cut

_PARENT = "/[^/]*$"


def parent_of(path: Column) -> Column:
    """The path without its last step; '' for a path of one step."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, _PARENT, "")).otherwise(F.lit(""))


def ancestors(path: Column, most: int | None = None) -> Column:
    """The folders that a path lies in, the outermost first, ``most`` of them at most."""
    steps = F.split(path, "/")
    n = F.size(steps) - 1
    wanted = n if most is None else F.least(n, F.lit(most))
    return F.when(wanted > 0, F.transform(F.sequence(F.lit(1), wanted), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def find_folders(paths: DataFrame, pattern: str) -> DataFrame:
    """(folder): the folders above ``paths(path)`` whose names fit a regular expression, but none inside another such folder."""
    steps = F.split("path", "/")
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda k: (k < F.size(steps)) & F.element_at(steps, k).rlike(pattern))
    first = paths.where("path IS NOT NULL").select(steps.alias("steps"), F.get(hits, F.lit(0)).alias("k")).where("k IS NOT NULL")
    return first.select(F.array_join(F.slice("steps", 1, F.col("k")), "/").alias("folder")).distinct()


def largest(arrays: DataFrame, by: list[str], size: str, name: str) -> DataFrame:
    """(by..., size, name): the largest of each group, of equals the one with the smallest name."""
    best = F.min(F.struct((-F.col(size)).alias("s"), F.col(name).alias("n")))
    return arrays.where(F.col(size).isNotNull()).groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.s")).alias(size), F.col("b.n").alias(name))


def folder_sizes(files: DataFrame) -> DataFrame:
    """(folder, bytes, files): everything below each folder, at any depth, of ``files(path, length)``.

    Null lengths count as 0 and null paths not at all; a path that is listed several times counts as often.
    """
    up = files.where("path IS NOT NULL").select(F.explode(ancestors(F.col("path"))).alias("folder"), F.coalesce("length", F.lit(0)).alias("length"))
    return up.groupBy("folder").agg(F.sum("length").cast("long").alias("bytes"), F.count("*").alias("files"))


def folder_tree(files: DataFrame, depth: int = 3, items: int = 40, stop: str = "$^") -> DataFrame:
    """(path, parent, name, depth, is_folder, bytes, files, more): what a listing shows of ``files(path, length)``.

    Shown are the first ``items`` entries of a folder by name, from depth 0 down to ``depth``; folders whose names fit the regular expression
    ``stop`` are shown but not entered.  ``bytes`` and ``files`` are all that lies in or under an entry; ``more`` says how many
    entries of its folder aren't shown.  Empty steps, as of ``a//b``, are entries with an empty name.
    """
    steps = F.split("path", "/")
    levels = F.explode(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(depth + 1)))).alias("k")
    path = F.array_join(F.slice(steps, 1, F.col("k")), "/")
    own = files.where("path IS NOT NULL").select("path", F.coalesce("length", F.lit(0)).alias("length"), levels).select(path.alias("path"), F.col("k"), "length", (F.size(steps) > F.col("k")).alias("inner"))
    entries = own.groupBy("path", "k").agg(F.max("inner").alias("is_folder"), F.sum("length").cast("long").alias("bytes"), F.count("*").alias("files"))
    entries = entries.select("path", F.when(F.col("k") == 1, F.lit(None)).otherwise(parent_of(F.col("path"))).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("k") - 1).alias("depth"), "is_folder", "bytes", "files")
    above = F.coalesce("parent", F.lit("/"))  # no parent of an entry is called so
    entries = entries.withColumn("above", above)
    sizes = entries.groupBy("above").agg(F.greatest(F.count("*") - items, F.lit(0)).alias("more"))
    first = F.row_number().over(Window.partitionBy("above").orderBy("name"))
    listed = cut(entries.withColumn("place", first).where(F.col("place") <= items).drop("place").join(sizes, "above").drop("above"))
    shown = [listed.where("depth = 0")]
    for d in range(1, depth + 1):
        entered = shown[-1].where(F.col("is_folder") & ~F.col("name").rlike(stop)).select(F.col("path").alias("parent"))
        shown.append(listed.where(F.col("depth") == d).join(entered, "parent", "left_semi"))
    return reduce(DataFrame.unionByName, [s.select("path", "parent", "name", "depth", "is_folder", "bytes", "files", "more") for s in shown])


def array_metadata(files: DataFrame) -> DataFrame:
    """(folder, kind, version, shape, dtype, chunks, attributes) of each folder with array metadata among ``files(path, content)``.

    ``zarr.json`` comes first; else ``.zarray`` makes an array and ``.zgroup`` a group, with attributes in ``.zattrs``.  Values are JSON texts, as
    they are; what is missing is null.  Content that isn't JSON says nothing, so such a folder is a group without attributes.
    """
    known = files.where("path IS NOT NULL").select(parent_of(F.col("path")).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    held = known.groupBy("folder").agg(*[F.max(F.when(F.col("file") == name, F.coalesce("content", F.lit("")))).alias(c) for name, c in (("zarr.json", "v3"), (".zarray", "array"), (".zgroup", "group"), (".zattrs", "attrs"))])
    meta = F.coalesce("v3", "array", "group")
    get = lambda *paths: F.coalesce(*[F.get_json_object(meta, p) for p in paths])
    v3 = F.col("v3").isNotNull()
    kind = F.when(v3, F.coalesce(F.get_json_object("v3", "$.node_type"), F.lit("group"))).when(F.col("array").isNotNull(), "array").otherwise("group")
    return held.where(meta.isNotNull()).select(
        "folder", kind.alias("kind"), F.when(v3, 3).otherwise(2).alias("version"), get("$.shape").alias("shape"), get("$.data_type", "$.dtype").alias("dtype"),
        get("$.chunk_grid.configuration.chunk_shape", "$.chunks").alias("chunks"), F.when(v3, F.get_json_object("v3", "$.attributes")).otherwise(F.get_json_object("attrs", "$")).alias("attributes"),
    )


def walk_metadata(files: DataFrame, roots: DataFrame | None = None, depth: int = 4, most: int = 600) -> DataFrame:
    """(root, folder, name, depth, kind, version, shape, dtype, chunks, attributes): the hierarchies under ``roots(folder)``, 0 to ``depth`` levels down.

    A folder belongs to a walk if all folders from the root to it have metadata.  Without ``roots`` these are the folders with metadata whose parent
    has none.  Shapes, types and chunks are those of arrays; attributes of more than ``most`` characters are cut and end in '...', and empty ones are null.
    """
    # '' is the folder of a path of one step and lies in no other
    meta = cut(array_metadata(files).withColumn("parent", F.when(F.col("folder") != "", parent_of(F.col("folder")))))
    if roots is None:
        roots = meta.join(meta.select(F.col("folder").alias("parent")), "parent", "left_anti").select("folder")
    step = meta.join(roots.select("folder").distinct(), "folder", "left_semi").withColumns({"root": F.col("folder"), "depth": F.lit(0)})
    levels = [step]
    for d in range(1, depth + 1):
        step = meta.join(step.select(F.col("folder").alias("parent"), "root"), "parent").withColumn("depth", F.lit(d))
        levels.append(step)
    walked = reduce(DataFrame.unionByName, levels)
    array = lambda c: F.when(F.col("kind") == "array", F.col(c)).alias(c)
    text = F.when(F.col("attributes") != "{}", F.when(F.char_length("attributes") > most, F.concat(F.substring("attributes", 1, most), F.lit("..."))).otherwise(F.col("attributes")))
    return walked.select("root", "folder", F.element_at(F.split("folder", "/"), -1).alias("name"), "depth", "kind", "version", array("shape"), array("dtype"), array("chunks"), text.alias("attributes"))
