"""Incremental enrichment: the same plan as ``plans.enrich``, run by
Structured Streaming over a folder that receives raw sighting TSV files.

The enrichment is stateless per row (joins against the OUI registry and the
geocode responses), so no watermark or state store is needed. The stream
carries the raw rows; each micro-batch is enriched by one batch plan a sink, so
that a sink's plan reads and shuffles only what that sink needs, and no
enriched row is kept: the wide rows of a large batch fit no memory. The
responses are parsed once a micro-batch and kept for both plans. Each micro-batch writes the integrated rows and the dead letter into
a ``batch_id`` partition with dynamic overwrite: a batch replayed after a
failure rewrites its own partition, so the sinks are exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apsight import schemas
from apsight.operators import geocode
from apsight.session import scratch_path


def raw_stream(spark: SparkSession, raw_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(schemas.RAW_SIGHTINGS).option("sep", "\t").option("comment", "#")
         .option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"'))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(raw_dir)


def start_enrichment_stream(spark: SparkSession, raw_dir: str, registry: DataFrame, responses: DataFrame,
                            out_dir: str, checkpoint: str | None = None, available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``. ``checkpoint`` defaults
    to a folder under the shared ``spark.checkpoint.dir``."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        points = geocode.dedupe_responses(responses).persist()  # a row a point
        tagged = geocode.enrich(batch, registry, responses, points)
        for name, rows in (("integrated", geocode.integrated_rows(tagged)), ("dead_letter", geocode.dead_letter_rows(tagged))):
            (rows.withColumn("batch_id", F.lit(batch_id)).write
             .option("partitionOverwriteMode", "dynamic").mode("overwrite")
             .partitionBy("batch_id").parquet(f"{out_dir}/{name}"))
        points.unpersist()

    w = (raw_stream(spark, raw_dir).writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoints/enrichment")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
