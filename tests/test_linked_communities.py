"""Communities hold links and no square of the nodes, and are those of the whole matrix."""

import tracemalloc

import numpy as np

from quorate.operators import structure


def test_links_of_many_nodes_hold_no_square():
    n = 6000  # rings of six: 288 MB as a matrix
    i = np.arange(n)
    j = i // 6 * 6 + (i + 1) % 6
    tracemalloc.start()
    links = structure.Links.of(n, np.r_[i, j], np.r_[j, i], np.ones(2 * n))
    labels = structure.linked_communities(links, 0.5)
    quality = structure.linked_quality(links, labels)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used / 1e6 < 30
    assert np.array_equal(labels, i // 6) and np.isclose(quality, 1 - 1 / 1000)


def test_quality_of_links_is_that_of_the_matrix():
    rng = np.random.default_rng(1)
    w = np.triu(rng.random((15, 15)) * (rng.random((15, 15)) < 0.4), 1)
    w += w.T
    labels = structure.louvain(w, 1.5)
    k = w.sum(1)
    want = ((w - 1.5 * np.outer(k, k) / w.sum()) * (labels[:, None] == labels)).sum() / w.sum()
    assert np.isclose(structure.partition_quality(w, labels, 1.5), want)


def test_a_node_that_gains_nowhere_goes_to_an_empty_community():
    w = np.zeros((4, 4))
    w[0, 1] = w[1, 0] = w[2, 3] = w[3, 2] = 1.0
    assert list(structure.louvain(w, 1.0)) == [0, 0, 1, 1] and list(structure.louvain(w, 50.0)) == [0, 1, 2, 3]
