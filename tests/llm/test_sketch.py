"""The spread count-min sketch: never below the truth, and close to it with enough cells."""

from hashlib import md5

import numpy as np
import pyarrow as pa

from veilspark.llm._sketch import Sketch, _packed, _unpacked, opened, sliced


def test_packed_cells():
    rng = np.random.default_rng(3)
    for high in (10, 300, 1 << 24):
        cell = np.unique(rng.integers(0, high, 5000))
        n = rng.integers(1, 400, len(cell))
        got = _unpacked(_packed(cell, n))
        assert got[0].tolist() == cell.tolist() and got[1].tolist() == np.minimum(n, 255).tolist()


def test_levels_never_undercount(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(map(str, rng.zipf(1.3, 200) % 5000)) for _ in range(400)]

    def spread(b):
        return np.array([int.from_bytes(md5(w.encode()).digest()[:8], "little") for t in b.column("text").to_pylist() for w in t.split()], np.uint64)

    count = {}
    for t in texts:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    parts = sliced(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), "test", 20_000)
    for per_key, rows in ((4.0, 2), (0.01, 1)):
        sketch = Sketch(80_000, per_key, rows)
        over = total = 0
        for r in sketch.counted(parts, spread).collect():
            b = opened(pa.py_buffer(bytes(r["held"])))
            words = [w for t in b.column("text").to_pylist() for w in t.split()]
            level = sketch.levels(spread(b), [x.asDict() for x in r["found"]])
            capped = np.floor(np.log2([min(count[w], 255) for w in words]))
            assert (level >= capped).all()
            true = np.floor(np.log2([count[w] for w in words]))
            over, total = over + (level > true).sum(), total + len(words)
        assert total == 80_000 and (over / total < 0.1 or per_key < 1)
