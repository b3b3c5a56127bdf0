"""Refresh status kept up by a stream of runs, instead of a scan of the whole log.

The stream holds the latest run and the latest success of every job as its state. A batch writes the jobs that it
changed, under its number, so a batch that is run again writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nearcite.operators.status import job_states


def stream_status(spark: SparkSession, in_dir: str, target_dir: str, checkpoint: str, schema: T.StructType) -> StreamingQuery:
    """Take every file of runs in ``in_dir`` that has not been taken yet, then stop.

    Runs are reduced to one row a job in the tasks that read them; what meets the state is that.
    """
    states = job_states(spark.readStream.schema(schema).parquet(in_dir))

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target_dir}/batch={batch_id}")

    return (
        states.writeStream.outputMode("update")
        .foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_states(spark: SparkSession, target_dir: str) -> DataFrame:
    """The newest state of every job, as ``job_states`` gives them."""
    rows = spark.read.parquet(target_dir)
    newest = rows.groupBy("job_id").agg(F.max_by(F.struct("last", "last_success_time"), "batch").alias("state"))
    return newest.select("job_id", "state.*")
