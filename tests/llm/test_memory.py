"""Python workers live as long as their executor: what a task or an operator has freed must not stay with them."""

import subprocess
import sys

import pytest

_START = """
import gc, sys
import public_tokenizers, pyarrow.parquet as pq
from inkwell.llm import bpe, common, near_copies
if sys.argv[1] == "kept":
    common.KEPT = 1 << 40
texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
"""

_OPERATOR = """
bpe.worker_encoder(public_tokenizers.path("word_bpe_49k.json"), None, 500_000).encode(texts)
gc.collect()
common.worker_state("another")
"""

_TASK = """
import numpy as np
last = []
def run(batches):
    for n in batches:
        blocks = [np.ones(8000) for _ in range(n)]
        last.append(blocks.pop())  # what lies below it stays with the allocator
        yield n
assert list(common.lean(run)([2000, 2000])) == [2000, 2000]
"""


def _after(code: str, kind: str) -> int:
    """MB that a process has after the code."""
    here = __file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", _START + code + "print(common.own_bytes() >> 20)", kind], capture_output=True, text=True, check=True, cwd=here)
    return int(out.stdout)


@pytest.mark.parametrize("code", [_OPERATOR, _TASK], ids=["operator", "task"])
def test_freed_memory_goes_back(code):
    assert _after(code, "lean") < _after(code, "kept") - 16


def test_tasks_of_the_pipeline_are_lean():
    from inkwell.llm import components, kneser_ney, near_copies

    for run in (components._local_forest, kneser_ney._scoring(None, []), near_copies._links(51, 9), near_copies._met(51)):
        assert hasattr(run, "__wrapped__")
