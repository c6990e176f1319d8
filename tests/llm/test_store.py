import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
OWN_SESSION = """
import glob, sys, time
from pyspark.sql import SparkSession
from tessera.llm.store import CLEANUP, written
d = sys.argv[1]
s = SparkSession.builder.master("local[2]").config("spark.local.dir", d).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", d + "/kept").getOrCreate()
before = s.conf.get(CLEANUP)
df = s.range(1000).groupBy("id").count()
kept = [written(df.join(s.range(k, 2000).hint("merge"), "id"), "table") for k in range(3)]
until = time.time() + 20
while (left := len(glob.glob(d + "/**/shuffle_*.data", recursive=True))) and time.time() < until:
    time.sleep(0.2)
print("left", left, [k.count() for k in kept], s.conf.get(CLEANUP) == before)
"""


def test_shuffles_of_a_written_table_go_with_the_write(tmp_path):
    """In a session with a folder of its own; before, they stayed until the driver's garbage was collected."""
    env = os.environ | {"PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", OWN_SESSION, str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    assert "left 0 [1000, 999, 998] True" in out.stdout, out.stdout + out.stderr[-2000:]


def test_tables_on_the_way_go_once_the_result_is_there(spark):
    from tessera.llm.store import recorded, written, written_alone

    with recorded() as paths:
        got = written_alone(lambda: written(spark.range(5), "way").union(written(spark.range(3), "way")), "result")
    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [False, False, True] and got.count() == 8
