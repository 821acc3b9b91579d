import os

from vitaloom.session import cut_lineage, scratch, ship_package


def test_scratch_removes_what_it_wrote(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    with scratch(spark):
        df = cut_lineage(spark.range(10), "scoped")
        assert df.count() == 10 and any(f.startswith("scoped-") for f in os.listdir(root))
    assert not any(f.startswith("scoped-") for f in os.listdir(root))
    kept = cut_lineage(spark.range(3), "kept")
    assert kept.count() == 3


def test_package_reaches_workers(spark):
    ship_package(spark)

    def where(batches):
        import vitaloom.session

        for pdf in batches:
            yield pdf.assign(path=vitaloom.session.__file__)

    assert spark.range(2).mapInPandas(where, "id long, path string").count() == 2


def test_encoder_gives_the_semantic_points(spark):
    from pyspark.sql import functions as F

    from vitaloom import fixed_values as fixed
    from vitaloom.functions.encoders import dense, encode_hashed
    from vitaloom.plans.analyze import analyze_resumes

    def encoder(df):
        return encode_hashed(df, features=64).withColumn("vector", dense(F.col("vector"), 64))

    df = spark.createDataFrame([(1, " ".join(fixed.IDEAL_SENTENCES)), (2, "zzz qqq"), (3, None)], "id int, text string")
    got = {r["id"]: r["analysis"] for r in analyze_resumes(df, encoder=encoder).collect()}
    assert got[1]["scoreBreakdown"]["ml_semantic_score"] > got[2]["scoreBreakdown"]["ml_semantic_score"] and got[3] is None
