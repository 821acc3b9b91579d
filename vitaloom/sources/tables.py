"""The five tables, and results written back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom import schemas


def scan_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read one table with its fixed schema."""
    return spark.read.format(fmt).schema(schemas.TABLES[name]).load(f"{path}/{name}")


def scan_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: scan_table(spark, path, name, fmt) for name in schemas.TABLES}


def scan_jdbc(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """Read one table from a database; pass ``partitionColumn``, bounds and ``numPartitions`` to read in parallel."""
    frame = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    wanted = [f for f in schemas.TABLES[name] if f.name in frame.columns]
    return frame.select(*[F.col(f.name).cast(f.dataType) for f in wanted])


def json_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for stores without nested types."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                       for f in df.schema])


def write_scored(df: DataFrame, path: str, partition_by: list[str] | None = None, as_json: bool = False,
                 mode: str = "errorifexists") -> None:
    """Persist analyses or recommendations. With partitions, ``overwrite`` replaces only those it writes."""
    writer = (json_columns(df) if as_json else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
