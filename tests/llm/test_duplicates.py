"""Exact, near and passage duplicates against plain versions."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SCHEMA, awkward, frame, prose, rows_of
from tsforge.llm import block_naming, components, odd_sketches, sentence_spans
from tsforge.session import shared_root


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("block_bytes", [16, 16_384])
def test_exact_duplicates(spark, block_bytes):
    docs = awkward()
    got = rows_of(block_naming.exact_duplicates(frame(spark), block_bytes=block_bytes))
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append(i)
    kept = sum(r[3] for r in got)
    assert kept == len(groups)
    expected = []
    for i, t in docs:
        ids = [x for x in groups[norm(t)] if x is not None]
        expected.append((i, min(ids) if ids else None, len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r[0] == r[1] for r in got if r[3])


def test_exact_duplicates_keep_rows_and_columns(spark):
    kept = block_naming.keep_first(frame(spark), block_bytes=64)
    assert kept.columns == SCHEMA.names
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(t) for _, t in awkward()})
    assert block_naming.keep_first(frame(spark, [])).count() == 0
    assert block_naming.exact_duplicates(frame(spark, [])).count() == 0


def test_names_tell_blocks_apart_that_share_parts(spark):
    rows = [(i, "ab" * 8 * (i % 4) + "cd" * 8 * (i % 3) + "ef" * (i % 2)) for i in range(48)]
    got = block_naming.exact_duplicates(frame(spark, rows), block_bytes=16)
    texts = {i: t for i, t in rows}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert all(r["keep_id"] == first[texts[r["doc_id"]]] for r in got.collect())


def plain_near(docs, k, threshold=80):
    sets = []
    for _, t in docs:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= threshold * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(docs):
        same = [docs[b][0] for b in range(len(docs)) if root(b) == root(a) and docs[b][0] is not None]
        component = i if not sets[a] else min(same, default=None)
        out.append((i, len(sets[a]), component, i == component))
    return sorted(out, key=repr)


def families() -> list[tuple[int, str]]:
    """Groups of edited copies, some only linked through a third one, and small sets at the very threshold."""
    rnd = random.Random(11)
    docs = []
    for family in range(12):
        words = prose(100 + family, rnd.choice([12, 60, 250])).split()
        for _ in range(rnd.randint(2, 12)):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 60))):
                copy[rnd.randrange(len(copy))] = f"edit{rnd.random()}"
            docs.append((len(docs), " ".join(copy)))
            if rnd.random() < 0.4:
                words = copy  # drift: chains of links
    docs += [(1_000 + i, "a b c d e f g h"[: 15 - 2 * i]) for i in range(4)]
    return docs


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    assert rows_of(odd_sketches.near_duplicates(frame(spark), k)) == plain_near(awkward(), k)
    assert rows_of(odd_sketches.near_duplicates(frame(spark, families()), k)) == plain_near(families(), k)


def test_near_duplicates_in_small_cells(spark, monkeypatch):
    """Buckets larger than a cell are compared in blocks, with the same result."""
    monkeypatch.setattr(odd_sketches, "CELL", 3)
    monkeypatch.setattr(odd_sketches, "_first_pairs", lambda nodes, *_: nodes.selectExpr("node u", "node v").limit(0))
    assert rows_of(odd_sketches.near_duplicates(frame(spark, families()), 4)) == plain_near(families(), 4)


def test_near_duplicates_keep_one_of_each_component(spark):
    kept = odd_sketches.keep_one(frame(spark), k=5)
    assert kept.columns == SCHEMA.names
    expected = {(r[2], r[1] > 0) for r in plain_near(awkward(), 5) if r[1] > 0}
    got = [r for r in kept.collect() if (r["text"] or "").strip()]
    with_id = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert sorted(set(with_id)) == sorted({c for c, _ in expected if c is not None})
    assert sum(1 for r in kept.collect() if not (r["text"] or "").strip()) == 3
    assert odd_sketches.keep_one(frame(spark, [])).count() == 0
    assert odd_sketches.near_duplicates(frame(spark, [])).count() == 0


def test_odd_sketch_estimates_high_similarities():
    rnd = np.random.default_rng(2)
    for share in (0.95, 0.85, 0.6):
        common = rnd.integers(0, 2**63, int(2_000 * share)).astype(np.uint64)
        rest = 2_000 - len(common)
        a, b = (np.concatenate((common, rnd.integers(0, 2**63, rest // 2).astype(np.uint64))) for _ in range(2))
        x, y = (odd_sketches.odd_sketch(odd_sketches.min_hashes(s)) for s in (a, b))
        apart = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        n, bits = odd_sketches.BANDS * odd_sketches.ROWS, odd_sketches.SKETCH_BITS
        estimate = 1 + bits / (4 * n) * np.log(1 - 2 * apart / bits)
        assert abs(estimate - share) < 0.12


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        label[high] = low
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    single = {a for a, b in edges if a == b}
    assert got == {x: root(x) for x in label if x in got}
    assert {x for x in label if x not in got} <= single
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_cleaned(docs):
    """Spans in the order of (doc_id, hash order of equal ids left out): first one stays."""
    seen, out = {}, []
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        hashed, starts, firsts, bounds = sentence_spans.sentences(raw)
        words = re.split(rb"[\x20\x09-\x0D]+", raw.lower().strip())
        gone = set()
        first, end, _ = sentence_spans.spans(hashed, bounds)
        for a, b in zip(first, end):
            key = tuple(words[bounds[a] : bounds[b]])
            if key in seen and seen[key] != (i, raw, a):
                gone |= set(range(a, b))
            seen.setdefault(key, (i, raw, a))
        edges = [*starts[firsts], len(raw)]
        parts = [raw[edges[s] : edges[s + 1]] for s in range(len(firsts)) if s not in gone]
        text = (raw[: edges[0]] + b"".join(parts)).decode() if len(firsts) else t
        out.append((i, text if gone else t, len(gone)))
    return sorted(out, key=repr)


def test_repeated_spans(spark):
    docs = [(i, t) for n, (i, t) in enumerate(awkward()) if not (i == 20 and t.startswith("another")) and i is not None]
    got = sentence_spans.cleaned(frame(spark, docs), removed="gone", where="places")
    assert got.columns[: len(SCHEMA.names)] == SCHEMA.names
    assert rows_of(got.select("doc_id", "text", "gone")) == plain_cleaned(docs)
    removed = {r["doc_id"]: r for r in got.collect()}
    assert removed[24]["gone"] == 0 and removed[25]["gone"] >= 3
    assert removed[19]["text"].strip() == "" and removed[18]["gone"] == 0


def test_passage_inside_other_sentences_is_found(spark):
    passage = prose(77, 80).replace("\n", " ")
    docs = [(i, prose(500 + i, 45).rstrip(".,\n") + " " + passage + " " + prose(600 + i, 45)) for i in range(5)]
    docs += [(50 + i, prose(700 + i, 120)) for i in range(5)]
    rows = {r["doc_id"]: r for r in sentence_spans.cleaned(frame(spark, docs), removed="gone", where="places").collect()}
    assert rows[0]["gone"] == 0 and all(rows[50 + i]["gone"] == 0 for i in range(5))
    for i in range(1, 5):
        kept = rows[i]["text"].split()
        assert len(kept) <= 90 + 30 and prose(500 + i, 45).split()[:30] == kept[:30]


def test_spans_without_ids_and_of_nothing(spark):
    text = prose(1, 100)
    rows = rows_of(sentence_spans.cleaned(frame(spark, [(None, text), (3, text)]), removed="gone", where="places").select("doc_id", "gone"))
    assert dict(rows)[None] == 0 and dict(rows)[3] > 0
    assert sentence_spans.remove_repeats(frame(spark, [])).count() == 0
    assert rows_of(sentence_spans.remove_repeats(frame(spark, [(1, None), (2, "")])).select("doc_id", "text")) == [(1, None), (2, "")]


def test_spans_of_grouped_texts_are_those_of_each_text():
    texts = [(t or "").encode() for _, t in awkward()] + [b"", prose(9, 2_000).encode(), b"\n\n", b"One. two. " * 40]
    row, number, halves = sentence_spans.group_spans(texts)
    for i, raw in enumerate(texts):
        hashed, _, _, bounds = sentence_spans.sentences(raw)
        alone = sentence_spans.spans(hashed, bounds)[2]
        assert np.array_equal(halves[row == i], alone)
        assert np.array_equal(number[row == i], np.arange(len(alone)))
    assert np.array_equal(sentence_spans.group_spans(texts, 1)[2], halves[:, :1])
    column = pa.array([t.decode() for t in texts])
    groups = list(sentence_spans._groups(column))
    assert [t for _, group in groups for t in group] == texts
    assert [begin for begin, _ in groups] == list(np.cumsum([0] + [len(g) for _, g in groups[:-1]]))
    assert list(sentence_spans._groups(column.slice(0, 0))) == []


def test_salted_spans_give_the_same_result(spark, monkeypatch):
    passage = prose(78, 70)
    docs = [(i, f"{prose(800 + i, 40)}\n{passage}\n{prose(900 + i, 40)}") for i in range(60)]
    monkeypatch.setattr(sentence_spans, "HOT_ROWS", 4)
    got = sentence_spans.cleaned(frame(spark, docs), removed="gone", where="places").select("doc_id", "text", "gone")
    assert rows_of(got) == plain_cleaned(docs)
    assert sum(gone > 0 for _, _, gone in rows_of(got)) == 59


def every_run(docs):
    """By all runs of sentences (texts whose sentences end with a full stop only): number of removed words by doc_id."""
    seen, out = {}, {}
    for i, t in sorted(docs):
        parts = [s.split() for s in re.findall(r"[^.]+\.", t)]
        gone = set()
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                run = tuple(w for s in parts[a:b] for w in s)
                if len(run) >= 30:
                    if seen.setdefault(run, (i, a)) != (i, a):
                        gone |= set(range(a, b))
        out[i] = sum(len(parts[s]) for s in gone)
    return out


def plain_sentences(seed, lengths):
    rnd = random.Random(seed)
    return [" ".join(f"w{seed}x{rnd.randrange(10**6)}" for _ in range(n)) + "." for n in lengths]


def test_every_repeated_run_is_removed_whole(spark):
    """Runs longer than the shortest span lose their last sentences too."""
    passage = plain_sentences(1, [14, 12, 12, 13, 4])
    docs = [(i, " ".join(plain_sentences(10 + i, [9, 40]) + passage + plain_sentences(20 + i, [35, 8]))) for i in range(2)]
    rnd = random.Random(5)
    pool = plain_sentences(2, [rnd.randint(1, 16) for _ in range(60)])
    for i in range(10, 40):
        at = rnd.randrange(50)
        docs.append((i, " ".join(plain_sentences(100 + i, [7, 12]) + pool[at : at + rnd.randint(2, 10)] + plain_sentences(200 + i, [3]))))
    rows = {r["doc_id"]: r["text"] for r in sentence_spans.cleaned(frame(spark, docs), removed="gone", where="places").collect()}
    got = {i: len(t.split()) - len(rows[i].split()) for i, t in docs}
    assert got == every_run(docs) and got[1] == 55


@pytest.mark.parametrize("kind", ["bare", "repeating", "prose"])
def test_passages_of_51_words_at_any_offset_are_found(spark, kind):
    """Set into the middle of other sentences, all but the words beside the first and after the last common cut go."""
    docs, at = [], {}
    for n in range(60):
        words = prose(9_000 + n, 51).replace("\n", "").split()
        if kind != "prose":
            words = [re.sub("[.,]", "", w) for w in words]
        if kind == "repeating":
            words = [words[x % 3] for x in range(51)]
        for copy in range(2):
            before, after = (plain_sentences(10 * n + 2 * copy + side + 1_000, [30])[0][:-1].split() for side in range(2))
            k = (7 * n + 11 * copy) % 30
            docs.append((2 * n + copy, " ".join(before[:k] + words + after[: 29 - k] + ["end."])))
            at[2 * n + copy] = (k, 29 - k + 1)
    rows = {r["doc_id"]: r["text"].split() for r in sentence_spans.cleaned(frame(spark, docs), removed="gone", where="places").collect()}
    for i, t in docs:
        k, rest = at[i]
        kept, given = rows[i], t.split()
        if i % 2:
            assert len(kept) <= k + rest + 14 and kept[:k] == given[:k] and kept[-rest:] == given[-rest:]
        elif kind != "repeating":  # a passage that repeats itself loses its own later part
            assert kept == given


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """One large group of near copies beside others, in cells smaller than their buckets; many rows without an id."""
    monkeypatch.setattr(odd_sketches._next_pairs, "__defaults__", (4,))
    rnd = random.Random(4)
    words = prose(77, 70).split()
    docs = []
    for i in range(50):
        copy = list(words)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(len(copy))] = f"edit{rnd.random()}"
        docs.append((i if i % 3 else None, " ".join(copy)))
    docs += families()[:20]
    assert rows_of(odd_sketches.near_duplicates(frame(spark, docs), 5)) == plain_near(docs, 5)
    left = odd_sketches.keep_one(frame(spark, docs), 5)
    assert left.columns == SCHEMA.names
    assert {r["_key"] for r in left.collect()} == {"a"}


def test_few_pairs_of_a_node_are_given_out_at_once():
    """All of them may have to be confirmed: one after the other, each would take a round over the whole buckets."""
    def node(i, label):
        return {"node": bytes([i]), "label": label, "n": 10, "sketch": [0] * 8, "parity": [0] * 32, "failed": None, "side": -1}

    cell = [node(0, b"a"), *(node(i, b"b") for i in range(1, 5))]
    pairs = odd_sketches.joining_pairs(cell, 80, 100)
    assert sorted(pairs) == [(bytes([0]), bytes([i])) for i in range(1, 5)]
    many = [node(i, bytes([i])) for i in range(100)]
    assert 99 <= len(odd_sketches.joining_pairs(many, 80, 100)) <= 100 * odd_sketches.FEW


def test_buckets_of_one_node_are_left_out(spark):
    nodes = spark.createDataFrame([(b"a", [1, 2, 3]), (b"b", [1, 5, 3]), (b"c", [1, 6, 7])], "node binary, bands array<long>")
    found = sorted((r["bucket"], bytes(r["node"]), bytes(r["leader"])) for r in odd_sketches.shared_buckets(nodes).collect())
    assert found == [(1, b"a", b"a"), (1, b"b", b"a"), (1, b"c", b"a"), (3, b"a", b"a"), (3, b"b", b"a")]


def test_components_leave_one_table_behind(spark):
    home = Path(shared_root(spark).removeprefix("file:")) / "tsforge"
    before = set(home.glob("*"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    found = components.components(edges)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(21)}
    assert [p.name[:10] for p in set(home.glob("*")) - before] == ["small-star"]
