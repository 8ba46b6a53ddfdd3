"""Phrase collocations against a plain count of every phrase."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tests.llm.helpers import awkward, prose, rows_of
from tsforge.llm import collocations

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "text", "lang", "words", "f", "part", "score")])


def frame(spark, rows):
    return spark.createDataFrame([(None, t, g, "x", "y", "z", "s") for t, g in rows], SCHEMA).repartition(3)


def plain(rows, least, share=100, top=2_000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            found = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(found)
            f.update((lang, found[i : i + m]) for m in range(1, 6) for i in range(len(found) - m + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, words), a in candidates.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    inside[lang, words[i:j]] = max(inside[lang, words[i:j]], a)
    out = []
    for (lang, words), a in candidates.items():
        if (lang, words) in inside and 100 * inside[lang, words] >= share * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), l, r, n[lang]))
    ranks = Counter()
    result = []
    for lang, score, a, phrase, l, r, total in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase.decode(), -a, l, r, total, -score))
    return sorted(result, key=repr)


def corpus():
    rows = [(t, ["en", "fr", None, "und", ""][i % 5]) for i, (_, t) in enumerate(awkward())]
    rows += [(prose(50 + i, 400), "en") for i in range(12)]
    rows += [("New York, new york city; new york\tcity hall. NEW YORK\x0bcity\x0chall", "fr")] * 9
    rows += [("a a a a a a a a a, \x01 b \x01 b! é é. é é", "xx")] * 7
    return rows


@pytest.mark.parametrize("tokens", [50, 1_000_000])
@pytest.mark.parametrize("least, share, top", [(2, 100, 2_000), (5, 60, 7)])
def test_collocations(spark, monkeypatch, tokens, least, share, top):
    monkeypatch.setattr(collocations, "TOKENS", tokens)
    rows = corpus()
    got = rows_of(collocations.collocations(frame(spark, rows), least, share, top))
    assert got == plain(rows, least, share, top)
    assert len(got) > 15


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """Everything gets past bitmaps of 64 bits."""
    monkeypatch.setattr(collocations, "BITMAP_BITS", 64)
    rows = corpus()
    assert rows_of(collocations.collocations(frame(spark, rows), 4)) == plain(rows, 4)


def test_no_rows_and_no_words(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(None, "en"), ("", None), (" .\n", "de")]), 1).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 5, 40])
def test_walk_over_ranges(parts):
    """Counts of shorter phrases and extensions do not depend on where the stream is cut."""
    counts = {}
    for i in range(200):
        words = [str(x) for x in ((i * 7) % 3, (i * 5) % 4, i % 3, i % 2)]
        for m in range(5):
            counts["ab"[i % 2], tuple(words[:m])] = counts.get(("ab"[i % 2], tuple(words[:m])), 0) + 1
    stream = sorted((lang, list(words), f) for (lang, words), f in counts.items())
    cut = -(-len(stream) // parts)
    above, rows = {}, []
    for p in range(parts):
        piece = stream[p * cut : (p + 1) * cut]
        if piece:
            lang, words, _ = piece[0]
            above[p] = [(lang, words[:m], counts[lang, tuple(words[:m])]) for m in range(len(words))]
            rows += [(p, *x) for x in piece]
    merged = {}
    for lang, words, f, under, longer in collocations.walk(iter(rows), above):
        old = merged.get((lang, tuple(words)), (None, None, 0))
        merged[lang, tuple(words)] = (f or old[0], under if under is not None else old[1], max(longer, old[2]))
    assert set(merged) == set(counts)
    for (lang, words), (f, under, longer) in merged.items():
        assert f == counts[lang, words]
        assert under == [counts[lang, words[:m]] for m in range(len(words))]
        assert longer == max((n for (g, w), n in counts.items() if g == lang and w[:-1] == words and w), default=0)


def test_distinct_pairs_are_those_of_a_plain_sort():
    rng = np.random.default_rng(3)
    for most in (1, 5, 1 << 20, (1 << 31) - 1):  # the last ones do not fit beside their places
        for n in (1, 2, 3_000):
            keys = rng.integers(0, most, n) << 32 | rng.integers(0, most, n)
            for got, plain in zip(collocations.distinct_pairs(keys), np.unique(keys, return_index=True, return_inverse=True)):
                assert (got == plain).all()
