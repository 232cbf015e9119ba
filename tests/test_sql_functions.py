from pyspark.sql import functions as F

from docflow.functions import labels, sql
from docflow.operators import search


def test_register(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    rows = spark.range(0, 2100, 7).select(F.col("id").alias("n"), labels.roman(F.col("id")).alias("r"), labels.letter(F.col("id")).alias("l"))
    rows.createOrReplaceTempView("numbers")
    assert spark.sql("SELECT * FROM numbers WHERE docflow_roman(n) != r OR docflow_letter(n) != l").count() == 0
    one = spark.sql("SELECT docflow_half_up(-2.5D) a, docflow_page_of(99.8D, 100D) b, docflow_spread_of(5L, 'odd-right') c, docflow_normalize('• it’s\\ta—b') d").first()
    assert tuple(one) == (-2, 1, 2, "it's" + "a-b")
    text = spark.createDataFrame([("x | y “z”",)], "s string")
    assert text.select(search.normalize(F.col("s"))).first()[0] == text.selectExpr("docflow_normalize(s)").first()[0] == 'xy"z"'
