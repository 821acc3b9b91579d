"""Line segments as rows, for reports over parts of documents."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaloom.functions.bullets import _SIGN


def line_segments(df: DataFrame, key: str, text: str = "text", starts: str = "(?U)^" + _SIGN) -> DataFrame:
    """Runs of lines that begin with a line matching ``starts``: key, segment number, first and last line.

    Only line numbers are shuffled, not the lines; the window is one document.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    numbered = lines.select(key, (F.col("n") + 1).cast("bigint").alias("n"),
                            F.col("line").rlike(starts).cast("bigint").alias("begins"))
    running = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    segments = numbered.withColumn("segment", F.sum("begins").over(running)).where("segment > 0")
    return segments.groupBy(key, "segment").agg(F.min("n").alias("first_line"), F.max("n").alias("last_line"),
                                                F.count("*").alias("n_lines"))
