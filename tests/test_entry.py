"""The entry module without the optional subpackage, and queries on a session that names no shared folder."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def run(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=600, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


@pytest.mark.parametrize("hidden", ["public_tokenizers", "tokenizers", "skyloom.llm", "corpus_pipeline"])
def test_queries_remain_where_the_subpackage_cannot_be_imported(hidden):
    out = run(f"""
import sys
sys.modules[{hidden!r}] = None
import __spark_entry__ as entry
from skyloom.plans import ORACLES, QUERIES
assert entry.queries() == QUERIES and entry.oracle_sql() == ORACLES
print(len(QUERIES))""")
    assert int(out) > 200


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, "skyloom", "llm")), reason="the subpackage isn't here")
def test_other_errors_of_the_subpackage_are_not_hidden():
    run("""
import sys, types
broken = types.ModuleType("corpus_pipeline")
broken.__getattr__ = lambda name: 1 / 0
sys.modules["corpus_pipeline"] = broken
import __spark_entry__ as entry
try:
    entry.queries()
except ZeroDivisionError:
    pass
else:
    raise SystemExit("hidden")""")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_queries_with_tables_of_their_own_need_no_setting():
    """spark.checkpoint.dir is unset: on a local master a folder stands in, and clean() knows what was put there."""
    names = "s1_partitioned_scan s3_csv_scan k9_score_report r1_recorder r5_scheduled_ingest r6_step_means k5_stream_retention"
    out = run(f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
import os
from skyloom.plans import QUERIES
from skyloom.sources import scratch
for name in {names.split()!r}:
    assert QUERIES[name](spark, {SF!r}).count() > 0, name
there = scratch.folder(spark)
assert os.listdir(there)
scratch.clean(spark)
print(len([x for x in os.listdir(there) if not x.startswith("_")]))""")
    assert out.split()[-1] == "0"
