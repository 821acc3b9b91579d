"""Helpers shared by the operators of this package."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """``crc32`` of the key as text modulo ``parts``: which rows are held out."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns beside those of ``df``: the given ones, with underscores where a column has that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def discard(written: DataFrame) -> None:
    """Remove the files of a table from ``cut_lineage`` that nothing reads any more."""
    files = written.inputFiles()
    if files:
        spark = written.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def map_rows(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """One Arrow pass over the partitions of ``df``: ``rows`` gets the values of a row and yields output tuples.

    Output leaves in batches of bounded size, so one long text never holds more than its own rows in memory.
    """
    types = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for out in rows(*values):
                    held.append(out)
                    if len(held) >= BATCH_ROWS:
                        yield as_batch(held, types)
                        held = []
        if held:
            yield as_batch(held, types)

    return df.mapInArrow(run, schema)


def arrow(ddl: str) -> pa.Schema:
    """The Arrow form of a schema."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class WordIds(dict):
    """64-bit hash of a word, remembered for the words seen lately; at most ``limit`` are held."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value
