"""Readiness, selection and comparison joins, set operations and closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.storage import scratch, written


def group_state(expected: DataFrame, manifests: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """by, state: waiting without a manifest, skipped if a stem of it is missing or of another geometry, else ready (SC4).

    expected: by, stem. files: by, stem, sample_rate, channels, frames.
    """
    j = expected.join(manifests.select(*by, F.lit(True).alias("_hl_m")).distinct(), by, "left").join(files, [*by, "stem"], "left")
    geometry = F.struct("sample_rate", "channels", "frames")
    whole = F.bool_and(F.col("frames").isNotNull()) & (F.min(geometry) == F.max(geometry))
    return j.groupBy(*by).agg(F.when(~F.bool_or(F.coalesce("_hl_m", F.lit(False))), "waiting").when(F.coalesce(whole, F.lit(False)), "ready").otherwise("skipped").alias("state"))


def playback_state(requests: DataFrame, files: DataFrame, manifests: DataFrame, by: list[str]) -> DataFrame:
    """requests with state: ready if the file is there, skipped if only its manifest is, else waiting (SC5)."""
    j = requests.join(files.select(*by, F.lit(True).alias("_hl_f")).distinct(), by, "left").join(manifests.select(*by, F.lit(True).alias("_hl_m")).distinct(), by, "left")
    return j.withColumn("state", F.when(F.col("_hl_f"), "ready").when(F.col("_hl_m"), "skipped").otherwise("waiting")).drop("_hl_f", "_hl_m")


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """What is expected and not present (SO2)."""
    return expected.select(*on).distinct().join(present.select(*on).distinct(), on, "left_anti")


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets (SO1)."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def repeated_values(groups: DataFrame, by: list[str], value: str) -> DataFrame:
    """Values that stand in a group more than once (SO3, PJ5)."""
    return groups.groupBy(*by, value).count().where("count > 1").select(*by, value)


def compared(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """key, difference for files that are missing, unexpected or of another hash, case ignored (JN12)."""
    e, a = expected.select(key, F.lower(digest).alias("_hl_e"), F.lit(True).alias("_hl_in_e")), actual.select(key, F.lower(digest).alias("_hl_a"), F.lit(True).alias("_hl_in_a"))
    both = e.join(a, key, "full_outer")
    kind = F.when(F.col("_hl_in_a").isNull(), "missing").when(F.col("_hl_in_e").isNull(), "unexpected").when(~F.col("_hl_e").eqNullSafe(F.col("_hl_a")), "changed")
    return both.withColumn("difference", kind).where("difference is not null").select(key, "difference")


def best_adapter(adapters: DataFrame, interfaces: DataFrame, addresses: DataFrame, index: str, metric: str, name: str) -> DataFrame:
    """The connected adapter of least metric, then name (JN10)."""
    return adapters.join(interfaces, index).join(addresses, index).orderBy(metric, name).limit(1)


def helper_of(players: DataFrame, helpers: DataFrame) -> DataFrame:
    """players with target_pid: the first helper, by id, of the same session (a null session fits), else the player itself (JN13)."""
    h = helpers.select(F.col("pid").alias("_hl_pid"), F.col("session").alias("_hl_s"))
    own = h.groupBy("_hl_s").agg(F.min("_hl_pid").alias("_hl_own"))
    every = h.groupBy().agg(F.min("_hl_pid").alias("_hl_any"), F.min(F.when(F.col("_hl_s").isNull(), F.col("_hl_pid"))).alias("_hl_free")).withColumn("_hl_one", F.lit(1))
    j = players.withColumn("_hl_one", F.lit(1)).join(own.where("_hl_s is not null"), F.col("session") == F.col("_hl_s"), "left").join(every, "_hl_one", "left")
    target = F.when(F.col("session").isNull(), F.col("_hl_any")).otherwise(F.least("_hl_own", "_hl_free"))
    return j.select(*players.columns, F.coalesce(target, F.col("pid")).alias("target_pid"))


def best_process(processes: DataFrame) -> DataFrame:
    """One process for each name, case ignored: one with a title first, then the smallest id; titled ones lead the list (AG9, TK5)."""
    named = processes.where((F.col("pid") > 0) & (F.trim("name") != "")).select("pid", F.trim("name").alias("name"), F.trim(F.coalesce("title", F.lit(""))).alias("title"))
    best = named.groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("name", "title", "pid"), F.struct(F.col("title") != "", -F.col("pid"))).alias("b")).select("key", "b.*")
    return best.orderBy(F.col("title") == "", "key")


def virtual_endpoints(endpoints: DataFrame, pattern: str) -> DataFrame:
    """Endpoints with virtual true where their name matches (SC16)."""
    return endpoints.withColumn("virtual", F.lower("name").rlike(pattern))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node for all that the seeds reach along edges (parent, child), case ignored, the seeds too (GR1).

    Breadth first: each round joins only the nodes that are new and drops those seen, so cycles end it. The edges are written once,
    each round's nodes too, so no round depends on an earlier plan or on an executor that is gone.
    """
    spark = edges.sparkSession
    e = written(edges.select(F.lower("parent").alias("parent"), F.lower("child").alias("child")).distinct(), "closure-edges")
    at, step = scratch(spark, "closure-nodes"), 0
    read = lambda of: spark.read.schema("node string").parquet(f"{at}/{of}")
    seeds.select(F.lower("node").alias("node")).distinct().write.parquet(f"{at}/0")
    while not (fresh := read(step)).isEmpty():
        reached = fresh.join(e, fresh["node"] == e["parent"]).select(F.col("child").alias("node")).distinct()
        step += 1
        reached.join(read("*"), "node", "left_anti").write.parquet(f"{at}/{step}")
    return read("*")
