"""S3 as a file stream: new sample files are extracted exactly once.

The reference resumes a batch job by skipping ids already in its output
CSV. As a Structured Streaming job the same contract is kept by keyed state:
`dropDuplicates` on the key holds the ids seen so far in the state store,
partitioned by key and versioned with the stream's checkpoint, so a
micro-batch looks up its own ids only and never reads the output. Each
micro-batch overwrites its own folder `epoch=<id>` of the output, so an epoch
that is replayed after a failure writes nothing twice.

The stream's checkpoint must live in shared storage, like every other
checkpoint of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_epoch(out_path: str, extract: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: its rows, extracted, become the whole of its epoch's folder."""
    def batch(df: DataFrame, epoch_id: int) -> None:
        extract(df).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")
    return batch


def start_extract_stream(spark: SparkSession, source_dir: str, schema: StructType, key: str,
                         out_path: str, checkpoint: str,
                         extract: Callable[[DataFrame], DataFrame], available_now: bool = True):
    """Start the stream; with `available_now` it processes what is there and stops.

    The output has the extracted columns and the partition column `epoch`.
    """
    new = spark.readStream.schema(schema).parquet(source_dir).dropDuplicates([key])
    w = new.writeStream.foreachBatch(write_epoch(out_path, extract)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
