"""What a Python worker takes for a batch: numbers are made of a small part of its texts at a time."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import jaccard_join, quality, words

_WIDTH = quality._features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
_MODEL = quality.Model(np.zeros(_WIDTH), np.ones(_WIDTH), np.full(_WIDTH, 0.01), 0.0, 1.0)
_WEIGHT = np.ones(1 << jaccard_join.SKETCH_BITS, np.int64)


@pytest.fixture(scope="module")
def batch():
    rng = random.Random(3)
    some = ["".join(rng.choice("abcdeABC019.,-é") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    rows = [None, "", *(" ".join(rng.choices(some, k=500)) for _ in range(3000))]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})


STEPS = [lambda b: quality._scored(iter([b]), _MODEL), lambda b: jaccard_join._signatures(iter([b]), 5, 80, _WEIGHT, 4096)]


@pytest.mark.parametrize("step", STEPS, ids=["quality", "near_duplicates"])
def test_memory_of_a_batch(batch, step):
    assert batch.nbytes > 8e6
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in step(batch))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == batch.num_rows and peak < 40e6


def test_parts_change_no_result(batch):
    def made(size):
        return [np.concatenate(x) for x in zip(*((quality._features(data, bounds), part.column(0).to_numpy()) for part, data, bounds in words.chunks(batch, "text", size)), strict=True)]

    (small, ids), (whole, _) = made(words.CHUNK), made(batch.nbytes)
    assert ids.tolist() == list(range(batch.num_rows)) and (small == whole).all()
