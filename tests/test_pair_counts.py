"""Pairs counted without being made, against all pairs."""

import random

import numpy as np
import pytest

from ridgeline.operators import graph, links, pair_counts
from tests.test_rays import nodes


@pytest.mark.parametrize("seed,whole", [(1, False), (2, True)])
def test_counts_within_distances(seed, whole):
    rng = np.random.default_rng(seed)
    n = 1500
    place = lambda k: np.round(rng.uniform(0, 1, k) * 40) / 40 if whole else rng.uniform(0, 1, k)
    node = lambda k, start: (np.arange(start, start + k), place(k), place(k), rng.random(k) < 0.4)
    own, other = node(300, 0), node(n, 5000)
    other = tuple(np.concatenate([a, b]) for a, b in zip(other, own))  # a chunk's own nodes are among those around
    edges = np.array([0.05, 0.1, 0.3]) ** 2
    d2 = (other[1] - own[1][:, None]) * (other[1] - own[1][:, None]) + (other[2] - own[2][:, None]) * (other[2] - own[2][:, None])
    pair = (own[0][:, None] != other[0]) & (own[3][:, None] | other[3])
    want = np.stack([((d2 <= e) & pair).sum(axis=1) for e in edges], axis=1)
    assert np.array_equal(pair_counts.within(own, other, edges), want)


def test_edges_of_bins_are_those_of_the_rounded_length():
    edges = pair_counts.bin_edges(1.0, 1000.0, 20)
    place = lambda d2: min(20, int(np.floor(np.sqrt(d2) * 1000.0 / 50.0)) + 1)
    for k, e in enumerate(edges[:-1], 1):
        assert place(e) == k and place(np.nextafter(e, 2.0)) == k + 1
    assert edges[-1] == 1.0


@pytest.mark.parametrize("whole", [False, True])
def test_degrees_and_lengths_are_those_of_the_links(spark, monkeypatch, whole):
    """No link is made for them: the join that would make them is not reached."""
    rng = random.Random(5)
    place = lambda: 50.0 * rng.randrange(-12, 12) if whole else rng.uniform(-600, 600)
    n = nodes(spark, [(place(), place(), 1, rng.random() < 0.5) for _ in range(300)]).cache()
    made = links.link_nodes(n, 250.0).cache()
    want = sorted(map(tuple, graph.degrees(made).collect())), sorted((r.bin, r.n, r.from_m) for r in graph.length_histogram(made, 250.0, 5).collect())
    monkeypatch.setattr(links, "link_nodes", None)
    assert sorted(map(tuple, pair_counts.node_degrees(n, 250.0).collect())) == want[0]
    assert sorted((r.bin, r.n, r.from_m) for r in pair_counts.link_lengths(n, 250.0, 5).collect()) == want[1]
    assert pair_counts.node_degrees(n.limit(0), 250.0).count() == pair_counts.link_lengths(n.limit(0), 250.0, 5).count() == 0
