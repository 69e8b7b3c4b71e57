import inspect
import subprocess
import sys

import pyarrow as pa

from upshot.llm import common as C

TASK = """
import numpy as np
from upshot.llm import common as C

def anonymous():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:")) // 1024

cells = [np.ones(60_000, np.uint8) for _ in range(5000)]  # 300 MB of small blocks
keep = cells[49::50]                                      # and some between that stay
del cells
held = anonymous()
assert list(C.lean(iter)([1, 2])) == [1, 2]
print(held - anonymous())
"""


def test_a_task_gives_freed_memory_back():
    got = subprocess.run([sys.executable, "-c", TASK], cwd=C.__file__.rpartition("/upshot/")[0], capture_output=True, text=True, check=True)
    assert int(got.stdout) > 150


def test_groups_keep_their_number_of_arguments(spark):
    def one(t: pa.Table) -> pa.Table:
        return t

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        return a

    assert [inspect.getfullargspec(C.lean_group(f)).args for f in (one, two)] == [["t"], ["a", "b"]]
    df = spark.range(6).selectExpr("id", "id % 2 as k")
    assert df.groupBy("k").applyInArrow(C.lean_group(one), df.schema).count() == 6
    assert df.groupBy("k").cogroup(df.groupBy("k")).applyInArrow(C.lean_group(two), df.schema).count() == 6
