import os
import subprocess
import sys

from pyspark.sql import functions as F

from histloom.functions.files import exploded, members
from histloom.tables import Scratch, ship

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_members_prune_and_keep_nulls(spark):
    df = spark.createDataFrame([(1, [("a", 1, "x"), (None, 2, "y")]), (2, []), (3, None)], "k int, modified_files array<struct<filename:string,n:int,diff:string>>")
    array, exprs = exploded({"f": lambda m: m["filename"], "n2": lambda m: m["n"] * 2})
    got = df.select("k", array.alias("files")).select("k", F.posexplode("files").alias("pos", "m")).select("k", "pos", *[e.alias(n) for n, e in exprs.items()])
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a", 2), (1, 1, None, 4)]
    assert df.select(F.size(members("diff")).alias("s")).filter("s > 0").count() == 1


def test_scratch_survives_and_drops(spark):
    s = Scratch(spark, "test")
    t = s.save(spark.range(5))
    assert t.count() == 5
    s.drop(t)
    assert not os.path.exists(t._histloom_path.removeprefix("file://"))


def test_shipped_package_is_importable_elsewhere(tmp_path):
    """A driver elsewhere, with the repository on its own path only."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
d = {str(tmp_path)!r}
s.createDataFrame([(1, 'p', '[{{"hash": "h", "modified_files": [{{"filename": "a"}}]}}]')], 'record_id long, project_name string, payload string').write.mode('overwrite').parquet(d + '/raw_records.parquet')
print('ROWS', e.queries()['p7_found'](s, d).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/", env=env, timeout=240)
    assert "ROWS 1" in out.stdout, out.stderr[-1500:]


def test_ship_once(spark):
    ship(spark)
    assert spark.sparkContext._histloom_shipped
    ship(spark)
