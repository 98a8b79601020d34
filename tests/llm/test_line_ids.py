"""The two halves of a line's id don't follow from each other."""

from pyspark.sql import functions as F

from flockwise.llm import line_dedup


def test_halves_of_a_line_id_are_independent(spark, documents):
    lines = line_dedup._lines(documents([(1, "one line\nother line\n\none line")]), "doc_id", "text").collect()
    chained = spark.createDataFrame([(r.a,) for r in lines], "a long").select("a", F.expr("reflect('org.apache.spark.sql.catalyst.expressions.XXH64', 'hashInt', 1, a)").alias("b"))
    derived = {r.a: int(r.b) for r in chained.collect()}
    assert all(r.b != derived[r.a] for r in lines)
    assert len({(r.a, r.b) for r in lines}) == 3
