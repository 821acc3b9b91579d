"""Keys and references between the tables, and account look-ups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose reference is set but has no parent."""
    keys = parent.select(F.col(key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def cascade_delete(child: DataFrame, column: str, deleted: DataFrame, key: str = "id",
                   set_null: bool = False) -> DataFrame:
    """Child rows after parents were deleted: dependants go, or lose their reference."""
    keys = deleted.select(F.col(key).alias(column)).distinct()
    if not set_null:
        return child.join(keys, column, "left_anti").select(*child.columns)
    marked = child.join(keys.withColumn("_gone", F.lit(True)), column, "left")
    return marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*child.columns)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once; null keys are never equal."""
    present = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return present.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def existing_account(signups: DataFrame, users: DataFrame) -> DataFrame:
    """Signups whose lower-cased email and username belong to one existing user."""
    known = users.select("email", "username").distinct()
    probe = signups.withColumn("email", F.lower("email"))
    return probe.join(known, ["email", "username"], "left_semi")


def last_login(logins: DataFrame) -> DataFrame:
    return logins.groupBy("user_id").agg(F.max("ts").alias("last_login"))
