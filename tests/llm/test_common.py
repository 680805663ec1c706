from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from turnweave.llm import common


def test_a_cluster_must_name_its_shared_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)


def test_tables_stay_until_they_are_removed_and_no_longer_read(spark):
    before = set(common.made())
    one = common.materialise(spark.range(5), "one")
    two = common.materialise(one.withColumn("x", F.lit(1)), "two")
    paths = [p for p in common.made() if p not in before]
    assert len(paths) == 2 and one.count() == two.count() == 5
    common.remove(spark, paths, unless_read_by=one.filter("id > 1"))
    assert one.count() == 5 and [p for p in common.made() if p not in before] == paths[:1]
    common.remove(spark, paths)
    assert [p for p in common.made() if p not in before] == []
    with pytest.raises(Exception, match="(?i)not.*exist|cannot"):
        spark.read.parquet(paths[0]).count()
