"""Memory of Python workers."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest

from ledgerloom.llm import worker


def _held() -> float:
    """MB of this process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_back_what_a_task_freed():
    """What lasts between freed arrays kept all of them, so that executors ran out of memory in later stages."""
    lasting = []

    def run(batches):
        freed = []
        for _ in range(3000):
            freed.append(np.ones(60_000, dtype=np.uint8))
            lasting.append(np.ones(2_000, dtype=np.uint8))
        yield len(freed)

    before = _held()
    assert list(run([])) == [3000]
    kept = _held() - before
    assert kept > 100  # MB: the allocator holds the gaps
    lasting.clear()
    before = _held()
    assert list(worker.giving_back(run)([])) == [3000]
    assert _held() - before < 50
