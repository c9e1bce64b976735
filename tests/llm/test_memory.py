import subprocess
import sys

CODE = """
import os
import numpy as np
import pyarrow as pa
from factledger.llm.common import slices

def mb():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

held = [np.ones(12_000) for _ in range(2000)]  # 96 kB each: too small to be mapped on their own
last, pin = mb(), np.ones(12_000)  # what stands at the heap's end keeps the rest
del held
rows = [len(x) for x in slices(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b"])], ["text"])]))]
print(rows, last - mb() > 120)
"""


def test_a_worker_gives_back_what_a_task_has_left_free():
    out = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True)
    assert out.stdout.split("\n")[-2] == "[2] True"
