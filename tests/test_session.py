import os
import subprocess
import sys

from tideline.session import shared_dir, shared_path, written


def test_folder_of_the_session_is_used(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert shared_path(spark, "a").startswith(shared_dir(spark))


def test_written_table_reads_back(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i long, s string")
    back = written(df, "t")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, "x")]


def test_executors_get_the_package(small, tmp_path):
    """From another folder and without PYTHONPATH, as on a cluster whose executors do not have it."""
    root = __file__.rsplit("/tests/", 1)[0]
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom tideline.session import local_session\nfrom tideline.plans.upkeep import p4_days\nspark = local_session(2, '1g', 2)\nprint('rows', p4_days(spark, {small!r}).count())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]


def test_configured_folder(tmp_path):
    root = __file__.rsplit("/tests/", 1)[0]
    code = (
        f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\nspark = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from tideline.session import shared_dir\nprint('at', shared_dir(spark))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ, capture_output=True, text=True, timeout=300)
    assert f"at file://{tmp_path}/shared" in out.stdout
