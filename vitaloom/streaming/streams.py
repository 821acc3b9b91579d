"""Streams.

Each sink is a log of immutable batch folders named by batch id. A batch that is
run again after a failure overwrites its own folder, so the log has every batch
once, and the tables are computed from it by the batch operators.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vitaloom.operators.integrity import last_login
from vitaloom.operators.jobs import dedupe_jobs, upsert_jobs
from vitaloom.session import complete_folders, remove


def write_log(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append", once: bool = False):
    """Start writing each micro-batch to ``path/batch_id=N``. ``once`` stops when the input is used up."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(StructType([*like.schema, StructField("batch_id", LongType())])).option("basePath", path).parquet(path)


def stream_dedupe_jobs(jobs: DataFrame, key: str = "url", time: str = "posted_date", delay: str = "30 days") -> DataFrame:
    """First row per key within ``delay``; state is dropped once the watermark has passed, so a key that returns later is
    new again. :func:`write_new_jobs` never forgets one."""
    return jobs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_upsert_jobs(feed_rows: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append normalised feed rows to the change log; a batch costs what it brings, not the catalogue size."""
    return write_log(feed_rows, path, checkpoint, once=once)


def catalogue_with_log(jobs: DataFrame, log: DataFrame, as_of: str | None = None, seq: str = "seq", stamp: str | None = None) -> DataFrame:
    """The catalogue after every logged batch, in batch order; ``stamp`` names the column with the time of each logged row."""
    ordered = log.withColumn("_order", F.struct("batch_id", seq)).drop("batch_id", seq)
    return upsert_jobs(jobs, ordered, as_of, "_order", stamp)


UPTO = "upto="


def newest_base(spark: SparkSession, base: str, jobs: DataFrame) -> tuple[int, DataFrame]:
    """The last batch that the newest complete base holds, and the base; before the first compaction -1 and ``jobs``."""
    held = [int(n.removeprefix(UPTO)) for n in complete_folders(spark, base) if n.startswith(UPTO)]
    return (max(held), spark.read.schema(jobs.schema).parquet(f"{base}/{UPTO}{max(held)}")) if held else (-1, jobs)


def current_catalogue(spark: SparkSession, path: str, base: str, jobs: DataFrame, like: DataFrame, as_of: str | None = None, seq: str = "seq",
                      stamp: str | None = None) -> DataFrame:
    """The newest base with the batches logged after it."""
    upto, held = newest_base(spark, base, jobs)
    return catalogue_with_log(held, read_log(spark, path, like).where(F.col("batch_id") > upto), as_of, seq, stamp)


def compact_log(spark: SparkSession, path: str, base: str, jobs: DataFrame, like: DataFrame, as_of: str | None = None, seq: str = "seq",
                stamp: str | None = None) -> int:
    """Write a new base with all complete batches and remove what it replaces; returns the last batch it holds.

    A base is named by that batch and counts once its write has ended, and readers leave out logged batches up to it. So a
    compaction that fails anywhere changes nothing, and a batch that the stream runs again afterwards is not applied twice.
    ``jobs`` is the catalogue that the log began with. Readers that still hold an older base must be done before its removal.
    """
    upto, held = newest_base(spark, base, jobs)
    batches = [int(n.removeprefix("batch_id=")) for n in complete_folders(spark, path) if n.startswith("batch_id=")]
    last = max(batches, default=-1)
    if last > upto:
        fresh = read_log(spark, path, like).where((F.col("batch_id") > upto) & (F.col("batch_id") <= last))
        catalogue_with_log(held, fresh, as_of, seq, stamp).write.mode("overwrite").parquet(f"{base}/{UPTO}{last}")
        upto = last
    for batch in batches:
        if batch <= upto:
            remove(spark, f"{path}/batch_id={batch}")
    for name in complete_folders(spark, base):
        if name.startswith(UPTO) and int(name.removeprefix(UPTO)) < upto:
            remove(spark, f"{base}/{name}")
    return upto


def write_new_jobs(stream: DataFrame, path: str, checkpoint: str, known: DataFrame, key: str = "url", order: tuple[str, ...] = ("posted_date",),
                   once: bool = False):
    """Log the first row of each key that neither ``known`` nor an earlier batch has, however long ago it came.

    A watermark forgets keys after its delay; here the log itself is the memory, so a link that returns after months is not
    new. Of ``known`` and the log only the keys are read, and only those that the batch brings too are compared. Rows
    without a key are one group, like any other value. A batch that runs again sees the batches before it only.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = dedupe_jobs(batch, list(order), key)
        before = read_log(spark, path, batch).where(F.col("batch_id") < batch_id) if complete_folders(spark, path) else batch.where("false")
        keys = known.select(key).unionByName(before.select(key))
        seen = keys.withColumnRenamed(key, "_key").join(first.select(F.col(key).alias("_own")), F.col("_key").eqNullSafe(F.col("_own")), "left_semi").distinct()
        new = first.join(seen, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_last_login(logins: DataFrame) -> DataFrame:
    """Running last login per user, for update mode."""
    return last_login(logins)


def last_login_from_log(log: DataFrame) -> DataFrame:
    """Newest value per user from an update-mode log."""
    return log.groupBy("user_id").agg(F.max("last_login").alias("last_login"))
