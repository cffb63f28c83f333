"""References to records that do not exist, or came only later.

Keyed state, advanced by increments::

    state, index = empty_state(spark), empty_index(spark)
    state, index = advance(state, index, refs=..., arrived=..., gone=..., at=...)
    counts = standing(state)      # a snapshot, after as many increments as one likes

``state`` has one row per reference: ``ref_table, record_id, target, key, ref_at, parent_at, known,
status, gone_at``. ``parent_at`` is the time the parent came (NULL if it has none), ``status`` is
``open`` (no such parent: the reference waits), ``late`` (a parent came after the reference)
or ``ok``; ``gone_at`` is when the parent of an open reference was deleted, NULL if it never had
one. The parent index is itself a table ``target, key, since``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "ref_table string, record_id string, target string, key string, ref_at timestamp_ntz, parent_at timestamp_ntz, known boolean, status string, gone_at timestamp_ntz"
INDEX = "target string, key string, since timestamp_ntz"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def _status(known: Column, parent_at: Column, ref_at: Column) -> Column:
    return F.when(~known, F.lit("open")).when(parent_at > ref_at, F.lit("late")).otherwise(F.lit("ok"))


def advance_index(index: DataFrame, arrived: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The parent index after ``gone (target, key)`` left and ``arrived (target, key, since)`` came.

    The earliest known ``since`` of a key counts; a NULL ``since`` is a parent of unknown time.
    """
    if gone is not None:
        index = index.join(gone.select("target", "key").distinct(), ["target", "key"], "left_anti")
    return index.unionByName(arrived.select("target", "key", "since")).groupBy("target", "key").agg(F.min("since").alias("since"))


def advance(state: DataFrame, index: DataFrame, refs: DataFrame, arrived: DataFrame, gone: DataFrame | None = None, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One increment: ``(state, index)`` after new references, arriving and deleted parents.

    * ``refs (ref_table, record_id, target, key, ref_at)`` are new references; each probes the
      parent index. Those with a NULL key are no references and are left out; a record given
      twice, in one increment or in two, counts once, with its earliest ``ref_at``.
    * ``arrived`` parents resolve waiting orphans of their key; an earlier version of a known
      parent changes what its references are.
    * ``gone`` parents reopen the references of their key; ``at`` is the time that is noted for it.
      A parent that goes and comes in one increment is there afterwards.

    Only references that are new, waiting, or of a touched key are probed again: the rest pass
    through. The probe is one equi-join with an index that holds each key once, so a key that
    holds a third of all references is split by the adaptive skew join and never copied.
    """
    idx = advance_index(index, arrived, gone)
    new = (
        refs.where(F.col("key").isNotNull() & F.col("record_id").isNotNull())
        .groupBy("ref_table", "record_id", "target", "key")
        .agg(F.min("ref_at").alias("ref_at"))
    )
    ref = ["ref_table", "record_id", "target", "key"]
    cols = [f.name for f in empty_cols()]
    keys = arrived.select("target", "key")
    if gone is not None:
        keys = keys.unionByName(gone.select("target", "key"))
    marked = state.select(*cols).join(keys.distinct().withColumn("moved", F.lit(True)), ["target", "key"], "left").join(new.select(*ref).withColumn("again", F.lit(True)), ref, "left")
    hit = (F.col("status") == "open") | F.col("moved").isNotNull() | F.col("again").isNotNull()
    touched, rest = marked.where(hit), marked.where(~hit)
    none = F.lit(None)
    fresh = new.select(*ref, "ref_at", none.cast("boolean").alias("before"), none.cast("timestamp_ntz").alias("gone_at"))
    old = touched.select(*ref, "ref_at", F.col("known").alias("before"), "gone_at")
    lost = F.when(F.col("before"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("gone_at"))
    probed = (
        fresh.unionByName(old).groupBy(*ref).agg(F.min("ref_at").alias("ref_at"), F.bool_or("before").alias("before"), F.max("gone_at").alias("gone_at"))
        .join(idx.withColumn("known", F.lit(True)), ["target", "key"], "left")
        .withColumn("known", F.coalesce(F.col("known"), F.lit(False)))
        .withColumn("status", _status(F.col("known"), F.col("since"), F.col("ref_at")))
        .withColumn("gone_at", F.when(~F.col("known"), lost))
        .withColumnRenamed("since", "parent_at")
    )
    return rest.select(*cols).unionByName(probed.select(*cols)), idx


def empty_cols():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(STATE).fields


def problems(state: DataFrame) -> DataFrame:
    """``ref_table, record_id, problem`` of every reference without a parent or before it."""
    return state.where(F.col("status").isin("open", "late")).select(
        "ref_table", "record_id", F.when(F.col("status") == "open", "absent").otherwise("late").alias("problem")
    ).distinct()


def standing(state: DataFrame) -> DataFrame:
    """``ref_table, refs, waiting, reopened, late``: a snapshot of the state, a row per table.

    ``waiting`` references have no parent now, of which ``reopened`` lost one they had.
    """
    return state.groupBy("ref_table").agg(
        F.count(F.lit(1)).alias("refs"), F.count_if(F.col("status") == "open").alias("waiting"),
        F.count_if((F.col("status") == "open") & F.col("gone_at").isNotNull()).alias("reopened"), F.count_if(F.col("status") == "late").alias("late"),
    )


def snapshots(state: DataFrame, period: str = "month") -> DataFrame:
    """Per table and period: references made, orphans opened, resolved, and waiting at its end.

    A reference waits from ``ref_at``, or from when its parent was deleted, until ``parent_at``;
    references without a time are in the period NULL. Counted by +1 and -1 per period and a running sum over few rows per table.
    """
    at = lambda c: F.date_trunc(period, c).cast("date")
    base = state.where(F.col("status") != "ok")
    made = state.groupBy("ref_table", at(F.col("ref_at")).alias("period")).agg(F.count(F.lit(1)).alias("refs"))
    opened = base.groupBy("ref_table", at(F.coalesce("gone_at", "ref_at")).alias("period")).agg(F.count(F.lit(1)).alias("opened"))
    closed = base.where(F.col("status") == "late").groupBy("ref_table", at(F.col("parent_at")).alias("period")).agg(F.count(F.lit(1)).alias("resolved"))
    long = (
        made.withColumns({"opened": F.lit(0), "resolved": F.lit(0)})
        .unionByName(opened.withColumns({"refs": F.lit(0), "resolved": F.lit(0)}))
        .unionByName(closed.withColumns({"refs": F.lit(0), "opened": F.lit(0)}))
        .groupBy("ref_table", "period")
        .agg(*[F.sum(c).alias(c) for c in ("refs", "opened", "resolved")])
    )
    from pyspark.sql import Window

    w = Window.partitionBy("ref_table").orderBy(F.col("period").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("waiting", F.sum(F.col("opened") - F.col("resolved")).over(w))
