"""Alerts as a stream: each key is reported once, across batches and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textforge.operators.dedup import keep_first
from textforge.operators.state import new_alerts


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path; a path that cannot be looked at is an error, not an empty one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def run_alerts(spark: SparkSession, source: str, schema: str, state_path: str, out_path: str, checkpoint: str, key: str = "job_id", order: str = "event_id") -> None:
    """Reads what is new in source, appends the first row of each key not yet alerted to out_path, and its key to state_path.

    A batch's rows carry its number, and a batch that is run again replaces its own, so a restart repeats nothing.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        known = spark.createDataFrame([], batch.select(key).schema)
        if _exists(spark, state_path):
            known = spark.read.schema(StructType([*known.schema, StructType.fromDDL("batch int")[0]])).parquet(state_path).where(F.col("batch") < number).select(key)
        fresh = keep_first(new_alerts(batch, known, key), [key], [order])
        fresh.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        fresh.select(key).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_alerts(spark: SparkSession, source: str, schema: str, out_path: str, checkpoint: str, key: str = "job_id", time: str = "ts", horizon: str = "30 days", files: int | None = None) -> StreamingQuery:
    """As run_alerts(), with the keys in Spark's own state: a key is alerted once within `horizon` of its event time.

    The state forgets a key when the newest event is `horizon` past it, so it is as large as the keys of that time;
    rows that come later than that are left out. The checkpoint holds state and progress, so a restart repeats nothing.
    files: new files taken in one batch.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(source)
    first = rows.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
    run = first.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return run
