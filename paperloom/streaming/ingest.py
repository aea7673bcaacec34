"""Upload ingestion as a stream: a watched folder, one file a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.ingest import appended_rows, assign_ids, parse_uploads
from paperloom.runtime import release, store, work_path

APPENDED = "doc_id long, original_id string, title string, authors string, category string, date string, dl long"


def ingest_stream(spark: SparkSession, inbox: str, table: str, checkpoint: str, first_id: int = 0,
                  name: str = "value", wholetext: bool = True):
    """Start a stream that appends every upload in ``inbox`` to the Parquet table ``table``.

    Each micro-batch gets the ids after those of the batches before, which a small table
    beside ``table`` keeps: one row a batch with its first free id, so the documents are not
    read again. A batch writes its own sub-folders by overwrite, so a batch that is repeated
    after a failure replaces itself. Rows equal in ``name`` are equal altogether, so their
    order does not matter.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        free = s.read.schema("next long, epoch long").parquet(f"{table}-next").filter(F.col("epoch") < epoch)
        start = free.agg(F.coalesce(F.max("next"), F.lit(first_id))).first()[0]
        rows = store(appended_rows(assign_ids(parse_uploads(batch, name), start, name)))
        rows.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        rows.agg((F.lit(start) + F.count("*")).alias("next")).write.mode("overwrite").parquet(f"{table}-next/epoch={epoch}")
        release(rows)

    source = spark.readStream.format("text").option("wholetext", wholetext).load(inbox)
    for folder in (table, f"{table}-next"):
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_folder_once(lines: DataFrame) -> DataFrame:
    """Write ``lines`` (column value) to a fresh inbox, run the stream until the inbox is
    read, and give the appended table without its batch number."""
    spark = lines.sparkSession
    base = work_path(spark)
    lines.select("value").write.text(f"{base}/inbox")
    stream = ingest_stream(spark, f"{base}/inbox", f"{base}/table", f"{base}/state", wholetext=False)
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()
    return spark.read.schema(APPENDED).parquet(f"{base}/table").drop("epoch")
