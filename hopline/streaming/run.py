"""Machines on batch and streaming frames, the micro-batch source, and sinks."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hopline.schemas import schema
from hopline.storage import scratch


def _out(key: str, types: dict[str, str], ddl: str):
    return schema(f"{key} {types[key]}, {ddl}")


def _rows(pdf: pd.DataFrame) -> list[dict]:
    return pdf.astype(object).where(lambda d: d.notna(), None).to_dict("records")


def _steps(machine, key_value, key: str, pdf: pd.DataFrame, order: str, columns: list[str]) -> pd.DataFrame:
    rows = [{key: key_value, **o} for r in _rows(pdf.sort_values(order, kind="stable")) for o in machine.step(r)]
    return pd.DataFrame(rows, columns=columns)


def replay(events: DataFrame, key: str, order: str, make: Callable[[], object], ddl: str) -> DataFrame:
    """A machine over each key's events in ``order``, as a batch.

    Partitions hold whole keys in order and are read batch by batch, so a session of any length takes the machine's
    state and one batch of memory.
    """
    out = _out(key, dict(events.dtypes), ddl)
    columns = out.fieldNames()

    def run(batches):
        machine, current = None, None
        for pdf in batches:
            rows = []
            for r in _rows(pdf):
                if machine is None or r[key] != current:
                    machine, current = make(), r[key]
                rows += [{key: current, **o} for o in machine.step(r)]
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return events.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, out)


def streamed(events: DataFrame, key: str, order: str, make: Callable[[], object], ddl: str) -> DataFrame:
    """The same on a stream; the machine is kept as state between micro-batches, in which a key's events are put in order."""
    out = _out(key, dict(events.dtypes), ddl)
    columns = out.fieldNames()

    def run(k: tuple, batches, state: GroupState):
        machine = pickle.loads(state.get[0]) if state.exists else make()
        yield _steps(machine, k[0], key, pd.concat(list(batches)), order, columns)
        state.update((pickle.dumps(machine),))

    return events.groupBy(key).applyInPandasWithState(run, out, "machine binary", "append", GroupStateTimeout.NoTimeout)


def files(spark: SparkSession, path: str, ddl: str, at_once: int = 1, fmt: str = "parquet") -> DataFrame:
    """A file stream that takes ``at_once`` files for each micro-batch (ST1)."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", at_once).format(fmt).load(path)


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a Parquet table in the shared folder."""
    spark = stream.sparkSession
    at = scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def in_parts(df: DataFrame, name: str, parts: int, part) -> str:
    """df as files of a folder that a file stream takes one after the other: those with part 0 first, and so on."""
    at = scratch(df.sparkSession, name)
    for i in range(parts):
        df.where(part == i).write.mode("append").parquet(at)
    return at


def complete_windows(events: DataFrame, at: str, by: list[str], size: str, hop: str, late: str, aggs: list) -> DataFrame:
    """Event-time windows under a watermark; a window comes out once nothing of it can follow."""
    return events.withWatermark(at, late).groupBy(*by, F.window(at, size, hop)).agg(*aggs)


def newest_commands(events: DataFrame, key: str, sequence: str, at: str, late: str) -> DataFrame:
    """Each command once (ST14): repeats within the watermark are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key, sequence])


def published(stream: DataFrame, out: str, checkpoint: str, manifest: Callable[[DataFrame], DataFrame]):
    """Stems of each micro-batch under out/stems, then their manifest under out/manifests (SK3, SK4): who reads by manifest never sees half a window. A batch that is run again replaces itself."""

    def publish(df: DataFrame, batch: int) -> None:
        df = df.persist()
        df.write.mode("overwrite").parquet(f"{out}/stems/batch={batch}")
        manifest(df).write.mode("overwrite").json(f"{out}/manifests/batch={batch}")
        df.unpersist()

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_dead_letters(stream: DataFrame, good: str, failed: str, checkpoint: str, valid: str):
    """Rows for which ``valid`` holds under ``good``, all others with it null or false under ``failed`` (ST7)."""

    def split(df: DataFrame, batch: int) -> None:
        df = df.withColumn("_hl_ok", F.coalesce(F.expr(valid), F.lit(False))).persist()
        df.where("_hl_ok").drop("_hl_ok").write.mode("overwrite").parquet(f"{good}/batch={batch}")
        df.where("not _hl_ok").drop("_hl_ok").write.mode("overwrite").parquet(f"{failed}/batch={batch}")
        df.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_document(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows as JSON documents in ``value`` (SK2, SK11, SK13)."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def changed_status(df: DataFrame, by: list[str], order: str, payload: str) -> DataFrame:
    """Status rows that differ from the one before (SK12, WN12)."""
    from hopline.operators.framing import changed

    return df.withColumn("_hl_c", changed(payload, by, order)).where("_hl_c").drop("_hl_c")
