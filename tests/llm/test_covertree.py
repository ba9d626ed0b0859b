"""The dual traversal against all pairs, and the work it takes."""

import numpy as np
import pytest

from loomfact.llm import covertree
from loomfact.llm.covertree import CoverTree, Linker

COSINE = 0.93


def vectors(n, dims, seed):
    """Directions of which a tenth are near copies, a tenth members of one group about as wide as the threshold, and some multiples of one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    tenth = n // 10
    x[:tenth] = x[tenth : 2 * tenth] + 0.08 * rng.normal(size=(tenth, dims))
    x[2 * tenth : 3 * tenth] = x[0] + 0.26 * rng.normal(size=(tenth, dims))
    x[3 * tenth : 3 * tenth + tenth // 2] = x[5]
    x = x[rng.permutation(n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def components(hit):
    root = np.arange(len(hit))
    while True:
        least = np.minimum(root, np.where(hit, root[None, :], len(hit)).min(axis=1))
        if (least == root).all():
            return root
        root = least


@pytest.mark.parametrize(("dims", "leaf", "few"), [(64, 128, 16), (16, 8, 3), (3, 8, 3), (3, 1, 1), (8, 2, 0)])
def test_tree_links_as_all_pairs_do(monkeypatch, dims, leaf, few):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    monkeypatch.setattr(covertree, "FEW", few)
    monkeypatch.setattr(covertree, "ROWS", 32)
    monkeypatch.setattr(covertree, "COLUMNS", 48)
    x = vectors(600, dims, dims)
    weight = np.arange(len(x)) % 4 + 1
    hit = x @ x.T >= COSINE
    np.fill_diagonal(hit, False)
    half = np.arange(len(x)) < 250
    for between in (False, True):
        want = hit & (half[:, None] != half[None, :]) if between else hit
        linker = Linker(x, weight, COSINE)
        if between:
            linker.between(linker.tree(np.flatnonzero(half)), linker.tree(np.flatnonzero(~half)))
        else:
            linker.within(linker.tree(np.arange(len(x))))
        assert (linker.links == want @ weight).all()
        assert (linker.roots(np.arange(len(x))) == components(want)).all()


def test_two_bundles_of_multiples_at_the_threshold_end():
    """Nodes of radius zero cannot be split; their distance is the threshold's, so neither bound decides."""
    x = np.zeros((400, 2))
    x[:200, 0] = 1.0
    x[200:] = [COSINE, np.sqrt(1 - COSINE * COSINE)]
    linker = Linker(x, np.ones(len(x), np.int64), COSINE)
    linker.within(linker.tree(np.arange(len(x))))
    want = (np.einsum("ij,ij->i", x[:1], x[200:201]) >= COSINE).item()
    assert set(linker.links.tolist()) == {399 if want else 199}


def test_unrelated_vectors_are_compared_in_blocks(monkeypatch):
    """Pairs of unrelated vectors by chance nearer than others were compared with every other vector by a call each."""
    calls = []
    for name in ("_compare", "_all", "_hits"):
        one = getattr(Linker, name, None)
        if one:
            monkeypatch.setattr(Linker, name, lambda self, *a, _one=one, **k: (calls.append(1), _one(self, *a, **k))[1])
    x = np.random.default_rng(1).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    Linker(x, np.ones(len(x), np.int64), COSINE).within(CoverTree(x, np.arange(len(x))))
    assert len(calls) < 1000
