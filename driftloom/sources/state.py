"""State that a run leaves behind and a later one takes up.

A store is a folder that versions are only added to, each written as a whole; a version without Spark's success mark isn't
complete and is passed over, so a run that dies while it saves leaves the version before in force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.sources.frames import names_in


def renamed_keys(state: Column, replacements: list[tuple[str, str]]) -> Column:
    """A map with the parts of its keys replaced, one replacement after the other, each in what the one before left.

    Where two keys become one the map is refused, as Spark refuses any map with a key twice.
    """

    def rename(key: Column, _: Column) -> Column:
        for old, new in replacements:
            key = F.replace(key, F.lit(old), F.lit(new))
        return key

    return F.transform_keys(state, rename)


def save_state(state: DataFrame, folder: str, version: int) -> None:
    """Adds ``version`` to the store; one that is there already is an error."""
    state.write.mode("errorifexists").parquet(f"{folder}/version={version}")


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The largest complete version in the store, None if there is none."""
    versions = sorted((int(n.removeprefix("version=")) for n in names_in(spark, folder) if n.startswith("version=") and n.removeprefix("version=").isdigit()), reverse=True)
    return next((v for v in versions if "_SUCCESS" in names_in(spark, f"{folder}/version={v}")), None)


def load_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state of the latest complete version, None if there is none."""
    version = latest_version(spark, folder)
    return None if version is None else spark.read.parquet(f"{folder}/version={version}")


TRACE_STATE = "run string, best double, best_epoch long, seconds double, epochs long"


def resumed_trace(history: DataFrame, state: DataFrame | None, patience: int, budget: float) -> tuple[DataFrame, DataFrame]:
    """(trace, state): ``history(run, epoch, val, sec)`` as ``profile.training_trace`` traces it after the epochs that ``state`` stands for, and the state after it.

    The state has a row a run: its best value, the last epoch that reached it, and the seconds and number of its epochs.  Runs that
    have no new epochs keep theirs.
    """
    if state is None:
        state = history.sparkSession.createDataFrame([], TRACE_STATE)
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    before = state.withColumnsRenamed({"best": "best_0", "best_epoch": "epoch_0", "seconds": "seconds_0", "epochs": "epochs_0"})
    rows = history.join(before, "run", "left").withColumn("best", F.least(F.min("val").over(w), F.col("best_0")))  # least passes over null
    own = F.max(F.when(F.col("val") == F.col("best"), F.col("epoch"))).over(w)
    last = F.coalesce(own, F.col("epoch_0"))
    seconds = F.sum("sec").over(w) + F.coalesce("seconds_0", F.lit(0.0))
    epochs = F.count("sec").over(w) + F.coalesce("epochs_0", F.lit(0))
    traced = rows.withColumns({"best_epoch": last, "seconds": seconds, "epochs": epochs})
    traced = traced.withColumns({"since": F.col("epoch") - F.col("best_epoch"), "over_budget": F.col("seconds") + F.col("seconds") / F.col("epochs") > budget})
    trace = traced.withColumn("stop", F.col("since") >= patience).select(*history.columns, "best", "since", "stop", "over_budget")
    after = traced.groupBy("run").agg(*[F.max_by(F.col(c).cast(kind), "epoch").alias(c) for c, kind in (("best", "double"), ("best_epoch", "long"), ("seconds", "double"), ("epochs", "long"))])
    return trace, after.unionByName(state.join(after.select("run"), "run", "left_anti"))
