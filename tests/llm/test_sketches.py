"""Sketches of vectors: they lose no link, and keep rows from blocks where they have none."""

import numpy as np
import pytest
from test_vectors_and_chats import brute

from loomfact.llm import embedding_dedup
from loomfact.llm.embedding_dedup import HALF, linked, near_blocks, sketch


def rows(n, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(n, dims))
    x[: n // 5] = x[n // 5 : 2 * (n // 5)] + 0.37 * rng.normal(size=(n // 5, dims)) * rng.choice([0.5, 1.0], size=(n // 5, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("dims", [3, 40, 64])
def test_products_of_sketches_are_no_less(dims):
    x = rows(400, dims)
    base = np.linalg.qr(np.random.default_rng(0).normal(size=(dims, dims)))[0][:, : embedding_dedup.DIRECTIONS]
    for s in (sketch(x, None).astype(float), sketch(x, base).astype(float)):
        assert (s @ s.T >= x @ x.T - HALF).all()


def test_rows_go_only_where_sketches_leave_a_link(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS", 32)
    monkeypatch.setattr(embedding_dedup, "COLUMNS", 48)
    x, block = rows(300, 64), np.arange(300) % 7
    s = sketch(x, None)
    hit = s.astype(float) @ s.astype(float).T >= 0.93 - HALF
    np.fill_diagonal(hit, False)
    want = np.stack([hit[:, block == k].any(axis=1) for k in range(7)], axis=1)
    a, b = near_blocks(s, block, s, block, 0.93 - HALF, True)
    assert ((a | b) == want).all() and want.mean() < 0.2
    a, b = near_blocks(s[:100], block[:100], s[100:], block[100:], 0.93 - HALF, False)
    assert (a == np.stack([hit[:100, 100:][:, block[100:] == k].any(axis=1) for k in range(7)], axis=1)).all()
    assert (b == np.stack([hit[100:, :100][:, block[:100] == k].any(axis=1) for k in range(7)], axis=1)).all()


@pytest.mark.parametrize("sample", [0, 16_384])
def test_labels_of_several_runs_of_blocks(spark, monkeypatch, sample):
    monkeypatch.setattr(embedding_dedup, "SKETCH_ROWS", 80)
    monkeypatch.setattr(embedding_dedup, "SAMPLE_ROWS", sample)
    data = [(k, v.tolist(), int(k % 10 == 0)) for k, v in enumerate(rows(500, 40))]
    data += [(1000, None, 1), (1001, [0.0] * 40, 0), (1002, [1.0] * 3, 0), (1003, [2.0] * 3, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in linked(df, block_rows=40).collect()}
    assert got == brute(data) and sum(r[1] > 0 for r in got) > 40
