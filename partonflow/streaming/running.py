"""Running histograms over event files as they arrive.

The aggregation is keyed by (categories, variable, bin), so its state is as
large as the histogram and does not grow with the number of events.  Events can
belong to any dataset: one stream with a ``dataset`` column replaces one stream
per dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from partonflow.plans.analysis import Analysis


#: Totals that stay: the newest, and one before it for readers that are at it.
KEPT_TOTALS = 2


def event_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Event files under ``path`` as a stream; all new files per batch unless limited."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def start_running_histogram(
    stream: DataFrame, analysis: Analysis, out: str, checkpoint: str, available_now: bool = True,
    keep: int = KEPT_TOTALS,
) -> StreamingQuery:
    """Keep ``out`` at the histogram of everything seen so far.

    Every batch writes the new total, at most ``categories x bins`` rows, to
    ``out/batch=<id>``.  A total that is being written hides no earlier one, and
    a batch that is repeated after a failure replaces only its own.  Once it is
    written, all but the newest ``keep`` are removed, so the folder does not grow
    with the stream; ``keep`` is 2 at least, or a repeated batch could leave none.
    """
    if keep < 2:
        raise ValueError("keep is 2 at least")

    def publish(total: DataFrame, batch: int) -> None:
        total.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        forget_totals(total.sparkSession, out, batch - keep + 1)

    writer = (
        analysis.histogram(stream)
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def forget_totals(spark: SparkSession, out: str, first: int) -> None:
    """Remove the totals under ``out`` of batches before ``first``, through the file system that ``out`` is on."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < first:
            files.delete(status.getPath(), True)


def final_histogram(
    spark: SparkSession, stream: DataFrame, analysis: Analysis, out: str, checkpoint: str
) -> DataFrame:
    """Drain the stream and return the last total."""
    run = start_running_histogram(stream, analysis, out, checkpoint)
    run.awaitTermination()
    return last_total(spark, out)


def last_total(spark: SparkSession, out: str) -> DataFrame:
    """The newest total under ``out`` that was written to its end."""
    totals = spark.read.parquet(out)
    newest = totals.agg(F.max("batch")).first()[0]
    return totals.filter(F.col("batch").eqNullSafe(F.lit(newest))).drop("batch")
