"""What a worker keeps of a block pair once it is done."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest

from titlesieve.operators import blocks


def private_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.skipif(os.uname().sysname != "Linux", reason="reads /proc")
def test_a_worker_gives_back_the_memory_of_a_block():
    pinned, taken = [], []

    def kernel(left, right):
        small = [np.ones(10_000) for _ in range(2_000)]  # 160 MB
        pinned.append(np.ones(5_000))  # lies behind them, so that they do not leave by themselves
        taken.append(private_mb())
        del small
        return left

    block = pa.table({"x": [1]})
    before = private_mb()
    assert blocks._giving_back(kernel)(block, block) is block
    assert taken[0] - before > 100 and private_mb() - before < 40
