import re

import numpy as np
import pytest
import xxhash

from rasterloom.llm import simhash

from .conftest import pairs


def brute_print(text, size=3):
    """Bit by bit, from the definition."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows, distance=3):
    """The least id reachable from each row; all pairs of rows."""
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_documents_against_all_pairs(documents):
    found = rows_of(simhash.near_duplicates(documents))
    assert found == sorted(brute_classes(pairs(documents)), key=str)
    assert len({c for _, _, c in found}) < len(found)  # some documents are near


def test_awkward_rows(awkward):
    assert rows_of(simhash.near_duplicates(awkward)) == sorted(brute_classes(pairs(awkward)), key=str)


def test_one_id_with_two_texts_ties_their_classes(spark):
    rows = [(5, "a b c d e f"), (5, "quite another text with other words"), (9, "quite another text with other words"), (2, "alone here with its own words")]
    found = rows_of(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [c for d, _, c in found if d in (5, 9)] == [5, 5, 5]


def test_empty_table(no_documents):
    assert simhash.near_duplicates(no_documents).collect() == []


@pytest.mark.parametrize("distance", [1, 3])
def test_masks_lose_no_pair(distance):
    rng = np.random.default_rng(3)
    for _ in range(200):
        differing = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
        masks = [0]
        for _ in range(simhash.LEVELS):
            masks = [next(c for c in simhash.child_masks(masks[0], distance) if not differing & c)]
        assert 64 - masks[0].bit_count() <= 16


def ball(n, spread, seed):
    """Distinct fingerprints: a dense ball around one, and chains of single bits."""
    rng = np.random.default_rng(seed)
    centre = int(rng.integers(0, 1 << 63))
    out = {centre}
    while len(out) < n:
        out.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, spread), replace=False)))
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


@pytest.mark.parametrize(("crowd", "held"), [(4096, 1 << 16), (8, 1 << 16), (64, 50)])
def test_links_of_a_crowded_ball(spark, monkeypatch, crowd, held):
    """Crowded buckets split twice, and sweeps over block ends, give the classes of all pairs."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "HELD", held)
    prints = ball(400, 12, 1) + ball(200, 20, 2)
    found = {frozenset(x) for x in simhash.links(spark.createDataFrame([(x,) for x in set(prints)], "fp long"), 3).collect()}
    every = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}

    def classes(edges):
        label = {x: x for x in prints}
        moved = True
        while moved:
            moved = False
            for a, b in map(sorted, edges):
                least = min(label[a], label[b])
                moved |= label[a] != least or label[b] != least
                label[a] = label[b] = least
        return label

    assert classes(found) == classes(every)
