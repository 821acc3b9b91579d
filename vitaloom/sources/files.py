"""Uploaded documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed


def scan_resume_files(spark: SparkSession, path: str, glob: str = "*.pdf",
                      max_bytes: int = fixed.MAX_FILE_BYTES, with_content: bool = False) -> DataFrame:
    """Accepted files: right name, not above the size limit. The length filter is pushed to the listing."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .load(path).where(F.col("length") <= max_bytes))
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    columns = [name, F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("upload_date")]
    return files.select(*columns, *(["content"] if with_content else []))
