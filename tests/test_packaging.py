"""The package must work where neither the workers nor a jar folder know it."""

import os
import subprocess
import sys
import textwrap

import pytest

from orderlens import session
from orderlens.functions.stop_words import ENGLISH

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert sorted(StopWordsRemover.loadDefaultStopWords("english")) == sorted(ENGLISH)


def test_entry_from_another_folder(tmp_path):
    """Import, SQL and a query with a Python stage, without the repository on the workers' path."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as e
        assert e.oracle_sql()
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        assert e.queries()["x2_nearest_vectors"](spark, "/root/testdata/sf0.001").count() > 0
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, timeout=300,
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,1024]")
