"""The n-gram join against brute force, with regions so small that all ways of dividing them are used."""

import random

import numpy as np
import pytest

from wardlog.llm import ngram_join as join
from wardlog.llm.joins import components

from .conftest import some_words


def shingles(text, width):
    words = (text or "").split()
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute_force(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def copies(seed, n=90):
    """Unrelated texts, and families of copies with a few to many changed words; common phrases in many."""
    rng = random.Random(seed)
    rows, families = [], [some_words(rng, rng.choice([3, 6, 9, 20, 60, 120])) for _ in range(6)]
    passage = some_words(rng, 25)
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            words = list(rng.choice(families))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                place = rng.randrange(len(words) + 1)
                words[place:place + rng.choice([0, 1, 1])] = some_words(rng, rng.choice([0, 1]))
        elif kind < 0.8:
            words = some_words(rng, rng.randrange(0, 50)) + passage
        else:
            words = some_words(rng, rng.randrange(0, 12), 8)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, width, percent, region_rows", [(1, 4, 85, 4096), (2, 4, 85, 3), (3, 5, 80, 3), (4, 2, 60, 5)])
def test_components(spark, as_docs, seed, width, percent, region_rows):
    rows = copies(seed)
    got = join.ngram_join(as_docs(rows).repartition(3), width, percent, region_rows=region_rows).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, width, percent)


def test_similar_sets_share_a_part():
    rng = np.random.default_rng(5)
    for percent in (85, 80, 50):
        for _ in range(300):
            n = int(rng.integers(1, 80))
            base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            change = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            other = np.unique(np.concatenate([base[change:], rng.integers(0, 2**63, int(rng.integers(0, 2))).astype(np.uint64)]))
            common = len(np.intersect1d(base, other))
            owner, parts = join.part_signatures([base, other], percent)
            if common and 100 * common >= percent * (len(base) + len(other) - common):
                assert set(parts[owner == 0]) & set(parts[owner == 1])


def test_bitmaps_bound_the_difference_from_below():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 900, int(rng.integers(1, 400))).astype(np.uint64)) for _ in range(2))
        a, b = join.mixed(a), join.mixed(b)
        size = min(len(join.bitmap(a)), len(join.bitmap(b)))
        apart = np.bitwise_count(join.folded(join.bitmap(a), size) ^ join.folded(join.bitmap(b), size)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_pivot_regions_lose_no_link():
    rng = random.Random(8)
    bases = [some_words(rng, 40) for _ in range(40)]
    sets = []
    for _ in range(300):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        sets.append(join.gram_set(" ".join(words), 2))
    region = join.ExactRegion(sets, 70)
    region.join(np.arange(len(sets)))
    plain = join.Groups(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 70 * (len(sets[i]) + len(sets[j]) - common):
                plain.join(i, j)
    assert [region.groups.find(i) for i in range(300)] == [plain.find(i) for i in range(300)]


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randrange(10, 60)) for _ in range(30)] + [(3, 3), (900, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(100, 161)} == {100} and got[900] == 100
    assert {got[b] for a, b in edges if a == 7} == {7} and 3 not in got
