"""Many keyword searches over a catalogue at once, through an index of three-letter strings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
# Stands where a text has nothing to search: every job has it.
ANY = ""


def grams(text, size: int):
    """All strings of ``size`` characters of a text, each once."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def keyword_grams(keywords):
    """Strings that any text must hold to match the keywords: of their literal pieces, the longest there are up to ``GRAM``."""
    pieces = F.filter(F.split(keywords, r"\\.|[%_]"), lambda p: p != "")
    by_size = [F.array_distinct(F.flatten(F.transform(pieces, lambda p, n=size: grams(p, n)))) for size in range(GRAM, 0, -1)]
    chosen = F.lit(None).cast("array<string>")
    for found in reversed(by_size):
        chosen = F.when(F.size(found) > 0, found).otherwise(chosen)
    return F.coalesce(chosen, F.array(F.lit(ANY)))


def search_many(jobs: DataFrame, searches: DataFrame, id: str = "id", search: str = "keywords") -> DataFrame:
    """``search, id``: which jobs each of the keyword strings finds, as :func:`vitaloom.operators.jobs.filter_keywords` does.

    The whole string must stand in the title or the description, ``%`` and ``_`` are wildcards. Each search meets the jobs
    that hold its rarest string of three letters (shorter ones only where it has no longer), and those are verified by
    ``LIKE``. Only strings that some search asks for leave the scan of the jobs. Empty keywords find all jobs, null ones
    none; equal searches are one. ``id`` must be unique.
    """
    asked = searches.where(F.col(search).isNotNull()).select(F.col(search).alias("_search")).distinct().withColumn("_low", F.lower("_search"))
    asked = asked.withColumn("_gram", F.explode(keyword_grams(F.col("_low"))))
    wanted = asked.select("_gram").distinct()
    title, body = F.coalesce(F.lower("title"), F.lit("")), F.coalesce(F.lower("description"), F.lit(""))
    texts = jobs.select(F.col(id).alias("_id"), F.lower("title").alias("_title"), F.lower("description").alias("_body"), title.alias("_t"), body.alias("_b"))
    every = F.array_distinct(F.concat(F.array(F.lit(ANY)), *[grams(F.col(c), size) for c in ("_t", "_b") for size in range(1, GRAM + 1)]))
    held = texts.select("_id", F.explode(every).alias("_gram")).join(wanted, "_gram", "left_semi")
    lengths = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_length"))
    # A string that no job has ends its search.
    rarest = asked.join(lengths, "_gram", "left").groupBy("_search", "_low").agg(
        F.min_by("_gram", F.struct(F.coalesce("_length", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_gram"))
    met = rarest.join(held, "_gram").join(texts.select("_id", "_title", "_body"), "_id")
    pattern = "concat('%', _low, '%')"
    found = met.where(F.expr(f"_title LIKE {pattern} OR _body LIKE {pattern}") | (F.col("_low") == ""))
    return found.select(F.col("_search").alias("search"), F.col("_id").alias("id"))
