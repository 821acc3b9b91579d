"""Whole-word hits of a vocabulary of any size, as a dictionary join instead of one expression for each term."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.functions.text import all_matches, tokens


def anchored(terms: DataFrame) -> DataFrame:
    """``term, ord, anchor, plain``: a term is met through its longest run of word characters.

    Word edges stand around a term, and other characters around the runs in it, so each of its runs is a whole word of
    any text that holds it. Of equal terms the first ``ord`` counts. Terms without a word character are left out.
    """
    one = terms.where(F.col("term").isNotNull()).groupBy(F.lower("term").alias("term")).agg(F.min("ord").cast("long").alias("ord"))
    runs = F.transform(all_matches(F.col("term"), r"\w+"), lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
    longest = one.withColumn("_longest", F.array_max(runs)).where("_longest IS NOT NULL")
    return longest.select("term", "ord", F.col("_longest.run").alias("anchor"), (F.col("_longest.run") == F.col("term")).alias("plain"))


def find_terms(docs: DataFrame, terms: DataFrame, id: str = "doc_id", text: str = "text", out: str = "terms") -> DataFrame:
    """Add ``out``: the terms that occur between word edges, lower-cased, in the order of ``ord``.

    ``terms`` has ``term`` and ``ord``. A text's distinct words meet the terms anchored at them by an equi-join, so the work
    follows the words of the texts and the plan does not grow with the vocabulary. One-word terms are hits at once; terms
    with blanks or punctuation are searched in the text, and only in texts that hold their anchor. ``id`` must be unique;
    null texts and rows without an id have no terms. The side of the terms is the small one and broadcast only if Spark
    finds it small; else a very common word is split among tasks.
    """
    known = anchored(terms)
    low = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.lower(text).alias("_low"))
    words = low.select("_id", F.explode(F.array_distinct(tokens(F.col("_low")))).alias("anchor"))
    met = words.join(known, "anchor")
    hit = F.struct("ord", "term")
    plain = met.where("plain").select("_id", hit.alias("_hit"))
    # A text's candidates are few: each is anchored at one of its words.
    wanted = met.where("NOT plain").groupBy("_id").agg(F.collect_list(hit).alias("_wanted"))
    there = F.filter("_wanted", lambda w: F.contains(F.col("_low"), w["term"]) & F.regexp_like(
        F.col("_low"), F.concat(F.lit(r"(?U)\b\Q"), w["term"], F.lit(r"\E\b"))))
    phrases = low.join(wanted, "_id").select("_id", F.explode(there).alias("_hit"))
    found = plain.unionByName(phrases).groupBy("_id").agg(F.transform(F.sort_array(F.collect_list("_hit")), lambda h: h["term"]).alias("_found"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    return docs.join(found, F.col(id) == F.col("_id"), "left").select(*kept, F.coalesce("_found", F.array().cast("array<string>")).alias(out))
