"""What training holds on the driver."""

import tracemalloc

import numpy as np
import pyarrow as pa

from basketlens.llm import cotraining


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_fit_makes_no_copy_of_its_rows():
    random = np.random.default_rng(3)
    x, y = random.random((600, 4096), dtype=np.float32), np.arange(600) % 2 * 1.0
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    size = x.nbytes
    model, most = peak(lambda: cotraining.Logistic(steps=3).fit(x, y))
    assert most < 0.5 * size
    assert np.array_equal(model.mean, mean) and np.array_equal(model.scale, scale)


def test_labelled_rows_are_made_dense_once():
    random = np.random.default_rng(4)
    views = [random.integers(0, 4, (500, n)).astype(np.float32) for n in cotraining.SIZES]
    y = np.arange(500) % 2
    cols = [y, np.zeros(500, dtype=np.int64), *map(list, zip(*[(*cotraining.sparse(a), *cotraining.sparse(b)) for a, b in zip(*views)]))]
    told = pa.table(dict(zip(["y", "grp", "a_at", "a", "b_at", "b"], cols)))
    order = np.lexsort((views[0].sum(axis=1), views[1].sum(axis=1), y))
    # Parts of a few rows; the sparse form of random features is as large as the dense one.
    (labels, found), most = peak(lambda: cotraining.ordered(told))
    assert np.array_equal(labels, y[order]) and all(np.array_equal(a, b[order]) for a, b in zip(found, views))
    assert found[0].flags.owndata and most < 5 * views[0].nbytes
    assert cotraining.ordered(told.slice(0, 1)) is None and cotraining.ordered(told.slice(0, 0)) is None
