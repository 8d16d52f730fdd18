"""Records as new files arrive.

Not a part of the batch analysis: stage tables that grow by files are read as a stream and
turned into records batch by batch; the checkpoint remembers what is done, in place of a
list of outputs. All rows of a panorama have to come in one file set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from streetlens import schemas
from streetlens.config import DEFAULT, Config
from streetlens.plans.analysis import records


def stream_records(spark: SparkSession, pixels: str, flags: DataFrame, output: str, checkpoint: str, config: Config = DEFAULT) -> StreamingQuery:
    """Process what there is of a folder of pixel files (label_px with depth_norm), once."""
    arriving = spark.readStream.schema(f"{schemas.LABEL_PX}, depth_norm float").parquet(pixels)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own records
        records(batch, flags, config=config).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
