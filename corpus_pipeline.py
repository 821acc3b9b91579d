"""A training corpus from raw documents: drop toxic ones, keep one of each group of near copies, cut repeated passages,
drop what holds benchmark items, and encode the rest.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and returns the columns of
``documents`` (the last one returns the encoding). Its result is written and reread before the next stage.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm import decontaminate, jaccard_join, radix_dedup, toxicity, transducer
from vitaloom.llm.common import fold, read
from vitaloom.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3
# Near copies: five words, similarity 0.8 or more.
NEAR = jaccard_join.Rule(words=5, num=80, den=100)
# Bytes of a repeated passage: 50 words of prose are about 320 bytes with their blanks, and hardly ever fewer than this.
REPEATED = 240
# Rows that Spark hands to a Python worker at once. A worker holds a batch several times over (as it comes, as Python objects, as
# results), and stages take turns in the same workers, so 10,000 whole texts or pairs of token sets add up beside the JVM's heap.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage in a session whose Python workers get ``BATCH_ROWS`` rows at most at once; a smaller setting stays."""
    @wraps(stage)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
            spark.conf.set(BATCH, BATCH_ROWS)
        return stage(spark, *args, **options)
    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``. Labels of held-out rows are not learned."""
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, out="_score").where(F.col("_score") < TOXIC).select(COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of rows with equal ids and texts one."""
    docs = docs.select(COLUMNS)
    near = jaccard_join.near_duplicates(docs, rule=NEAR).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(near, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of ``REPEATED`` bytes that occur more than once; every occurrence goes, the first too.

    Null texts become empty, texts below that length stay whole, and of a character cut in half nothing stays.
    """
    cut = radix_dedup.remove_repeats(docs, threshold=REPEATED)
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = transducer.MODEL) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return transducer.round_trip(docs, transducer.load(model))


STAGES = [(name, in_small_batches(stage)) for name, stage in (("toxicity", drop_toxic), ("jaccard_join", keep_one), ("suffix_dedup", cut_repeats),
                                                              ("decontamination", drop_leaks), ("sentencepiece", encode))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs


# No SQL expresses the classifier or the edit distances; tests compare every stage with a brute-force version.
ORACLE_SQL = None
