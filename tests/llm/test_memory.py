"""What workers hold between tasks and stages."""

import gc
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import types as T

from tidegrid.llm.batch_bpe import BatchBpe
from tidegrid.llm.store import with_text_column


class Local:
    """As much of a table as ``with_text_column`` needs; its kernel runs in this process."""

    columns = ["text"]
    schema = T.StructType([T.StructField("text", T.StringType())])

    def mapInArrow(self, kernel, schema):
        return list(kernel(iter([pa.record_batch({"text": ["a", None, "bc"]})])))


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_task_gives_back_what_it_freed():
    held = []

    def make():
        blocks = [np.ones(8_000) for _ in range(3_000)]  # 192 MB in small pieces
        held.append(np.ones(8_000))  # lies behind them and stays
        assert len(blocks) == 3_000
        return lambda texts: [float(len(t)) for t in texts]

    gc.collect()
    before = _resident()
    out = with_text_column(Local(), "text", "size", T.DoubleType(), make)
    assert out[0].column(1).to_pylist() == [1.0, 0.0, 2.0] and len(held) == 1
    assert _resident() - before < 60_000_000


def test_runs_are_remembered_in_few_bytes():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        bpe = BatchBpe(f.read())
    draw, letters = np.random.default_rng(3), np.frombuffer(b"abcdefghijklmnop", np.uint8)
    bpe.encode([b"warm up"])
    gc.collect()
    tracemalloc.start()
    try:
        for _ in range(4):
            bpe.encode([b" ".join(letters[row].tobytes() for row in draw.integers(0, 16, (10_000, 6)))])
        gc.collect()
        size = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(bpe.known) > 39_000
    assert size / len(bpe.known) < 100
