"""SimHash components against all pairs, and the code that finds them."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import awkward, frame, prose, rows_of
from tsforge.llm import golay_simhash as golay


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(prints):
    """(doc_id, fingerprint) -> the same with component_id."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
            label[root(a)] = root(b)
    ids = {}
    for a, (i, _) in enumerate(prints):
        if i is not None:
            ids[root(a)] = min(i, ids.get(root(a), i))
    return sorted(((i, f"{v:016x}", ids.get(root(a))) for a, (i, v) in enumerate(prints)), key=repr)


def test_each_error_pattern_has_its_syndrome():
    patterns = [sum(1 << b for b in c) for n in range(4) for c in itertools.combinations(range(23), n)]
    assert len(patterns) == 2048 == len(set(golay.PATTERNS.tolist()))
    assert set(golay.PATTERNS.tolist()) == set(patterns)
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 23, 500)
    rest = golay.LOW_REST[words & 0xFFF] ^ golay.HIGH_REST[words >> 12]
    assert not golay._remainders(words ^ golay.PATTERNS[rest]).any()


def test_words_two_bits_apart_share_a_codeword():
    rnd = random.Random(2)
    for _ in range(300):
        a = rnd.randrange(1 << 23)
        b = a
        for bit in rnd.sample(range(23), 2):
            b ^= 1 << bit
        found, fresh = golay.codewords(np.array([a, b]))
        assert fresh.sum(axis=1).max() <= 6
        assert set(found[0]) & set(found[1])


def test_all_fingerprints_three_bits_apart_share_a_key():
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    others = [base ^ sum(1 << b for b in c) for n in range(1, 4) for c in itertools.combinations(range(64), n)]
    place, family, key = golay.node_keys(np.array([base, *others], np.uint64))
    own = {(f, k) for p, f, k in zip(place, family, key) if p == 0}
    met = {p for p, f, k in zip(place.tolist(), family, key) if (f, k) in own}
    assert met == set(range(len(others) + 1))
    assert np.bincount(place).max() <= 42


def test_blocks_share_out_the_other_bits():
    for _, mask in golay.FAMILIES:
        while bin(mask).count("1") < 61:
            blocks = golay.blocks_of(mask)
            assert len(blocks) == 4 and all(blocks)
            assert sum(blocks) + mask == (1 << 64) - 1
            mask |= blocks[0]


def texts():
    rnd = random.Random(5)
    docs = awkward()
    for family in range(10):
        words = prose(300 + family, 80).split()
        for _ in range(rnd.randint(2, 10)):
            copy = list(words)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = f"edit{rnd.random()}"
            docs.append((1_000 + len(docs), " ".join(copy)))
    return docs


@pytest.mark.parametrize("cell", [2, 8_192])
def test_near_duplicates(spark, cell):
    docs = texts()
    got = rows_of(golay.near_duplicates(frame(spark, docs), cell=cell))
    assert got == plain([(i, plain_print(t)) for i, t in docs])


@pytest.mark.parametrize("cell", [8, 100])
def test_a_dense_ball_is_dealt_out_again(spark, cell):
    """Fingerprints around one centre share keys by the hundred: links are those of all pairs."""
    rnd = random.Random(7)
    values = {rnd.getrandbits(64) for _ in range(40)}
    centre = rnd.getrandbits(64)
    for _ in range(700):
        values.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(2, 6))))
    prints = [(i, v) for i, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints], "doc_id long, node long")
    found = golay.links(nodes, cell).collect()
    assert all(((r["u"] ^ r["v"]) % (1 << 64)).bit_count() <= 3 for r in found)
    label = {v: v for v in values}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in found:
        label[root(r["u"] % (1 << 64))] = root(r["v"] % (1 << 64))
    groups = {}
    for i, v in prints:
        groups.setdefault(root(v), set()).add(i)
    expected = {}
    for i, _, c in plain(prints):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_no_rows(spark):
    assert golay.near_duplicates(frame(spark, [])).count() == 0
    assert rows_of(golay.near_duplicates(frame(spark, [(None, None), (4, " ")]))) == [(4, "0" * 16, 4), (None, "0" * 16, 4)]
