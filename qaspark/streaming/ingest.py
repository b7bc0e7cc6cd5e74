"""7.2: the ingest + audit plan on a Structured Streaming file source.

New result files dropped into a folder are picked up by ``readStream``;
each micro-batch holds whole files, so ``foreachBatch`` runs the same
batch functions (normalised union and per-file audit).  Each batch overwrites its own
``batch_id=N`` folder of both tables, so a batch that failed between the two writes and is replayed
leaves no duplicates; progress is kept in the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import file_audit, union_normalised
from ..sources.files import line_blocks, relative_path


def start_ingest(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str,
                 canonical: list[str], glob: str = "*.{csv,tsv}", available_now: bool = True):
    """Start the streaming ingest; returns the StreamingQuery.

    Files are told apart by their path below ``input_dir``.  ``canonical``: the columns of the
    table, the same for all batches; columns besides them are left out.
    """
    if not canonical:
        raise ValueError("name the canonical columns: batches must share one schema")
    lines = (spark.readStream.format("text").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(input_dir)
             .select(relative_path(F.col("_metadata.file_path"), input_dir).alias("file"), F.col("_metadata.file_block_start").alias("split"),
                     F.col("value").alias("line")))

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        b = line_blocks(batch)
        if b.isEmpty():
            return
        table = union_normalised(b, canonical)
        table.select(*[c for c in canonical if c != "source_file"], "source_file").write.mode("overwrite").parquet(f"{output_dir}/aggregate/batch_id={epoch_id}")
        file_audit(b, canonical).write.mode("overwrite").parquet(f"{output_dir}/audit/batch_id={epoch_id}")

    w = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
