"""Codes of stretches that have one representative."""

import numpy as np
import pyarrow as pa

from lexiloom.llm.suffix_dedup import send_stretches


def test_different_stretches_have_different_codes():
    """250,000 different texts of 100 bytes, most with one representative: 32 bits do not part them."""
    head = bytes(np.random.default_rng(1).integers(97, 123, 92, dtype=np.uint8))
    n = 250_000
    texts = [head + b"%08d" % k for k in range(n)]
    seen = set()
    for batch in send_stretches(100, 20240229)(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], names=["doc", "bytes"])])):
        seen.update(zip(batch["k"].to_pylist(), batch["f"].to_pylist()))
    assert len({k for k, _ in seen}) < n // 2
    assert len(seen) == n
