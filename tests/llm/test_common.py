import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent.parent

#: A function whose state is many small values with a few late ones above them, which keep the C library from shrinking its heap.
TASK = """
import re
from pathlib import Path
from grovelake.llm.common import tidied

def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

late = []

def run(batches):
    state = [bytes(2000) for _ in range(60_000)]
    for b in batches:
        late.append(bytes(2000))
        yield b

before = held()
assert list(tidied(run)(iter([1, 2]))) == [1, 2]
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_keeps_none_of_a_task_s_memory():
    done = subprocess.run([sys.executable, "-c", TASK], cwd=REPO, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 40, done.stdout
