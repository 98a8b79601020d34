from pathlib import Path

from flockwise.llm.common import stored

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffled(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in folders for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).repartition(4).groupBy("id").count()
    before, setting = shuffled(spark), spark.conf.get(CLEANUP, None)
    first, again = stored(df, "t"), stored(df, "t")
    assert shuffled(spark) <= before and spark.conf.get(CLEANUP, None) == setting
    assert first.count() == again.count() == 1000
