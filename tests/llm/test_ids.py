"""Token files, packing, piece encoding and token counts against plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, frame, prose, rows_of
from tsforge.llm import elias_fano, packing, stream_viterbi, token_files, trie_counts
from tsforge.llm.common import worker_state
from tsforge.llm.fast_ids import WordIds
from tsforge.llm.piece_model import PieceModel, marked

LOWER, BYTES = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_ids(path, end):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


@pytest.mark.parametrize("path", [LOWER, BYTES])
def test_word_by_word_ids_are_the_tokenizers(path):
    rnd = random.Random(5)
    letters = list("aBé'sß .,!\n\t  \r\xa0日İΣς0१<|endoftext|>%&ré\x1c\x85\u0301")
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3_000)]
    texts = [*odd, *(t or "" for _, t in awkward())]
    encoder, plain = WordIds(path), plain_ids(path, 0)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == plain(text)[:-1].tolist()


def test_word_cache_keeps_ids_when_it_turns_over(monkeypatch):
    monkeypatch.setattr("tsforge.llm.fast_ids.CACHED_WORDS", 10)
    encoder, plain = WordIds(BYTES), plain_ids(BYTES, 0)
    for text in (prose(3, 200), prose(3, 200), prose(4, 50)):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == plain(text)[:-1].tolist()


@pytest.mark.parametrize("values", [
    [], [0], [5, 5, 5], [-7, -7, 0, 9], [0, 2**62], [-(2**63), 2**63 - 1], list(range(0, 5000, 7)), [3] * 700,
])
def test_elias_fano_round_trip(values):
    array = np.array(values, np.int64)
    read = elias_fano.EliasFano(elias_fano.encode(array))
    assert read.select(0, read.n).tolist() == values
    assert [read[i] for i in range(0, len(values), 97)] == values[::97]
    if values:
        assert read.select(len(values) // 2, len(values)).tolist() == values[len(values) // 2 :]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1_500, 100_000))
    assert 8 * len(elias_fano.encode(ends)) < 13.5 * len(ends)


@pytest.mark.parametrize("shard_ids", [200, 1 << 22])
def test_token_files(spark, shard_ids):
    docs = awkward()
    folder, manifest = token_files.write_shards(frame(spark), LOWER, shard_ids=shard_ids)
    plain = plain_ids(LOWER, token_files.END_ID)
    expected, start = [], 0
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = plain(text)
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows_of(token_files.read_documents(folder, manifest)) == sorted(expected, key=repr)
    assert (manifest.count() > 5) == (shard_ids == 200)


def test_two_writers_of_one_shard(tmp_path):
    """A second attempt starts, writes and ends while the first still writes: the shard is whole at every moment."""
    writers = [token_files.ShardWriter(f"file://{tmp_path}", 3, 2, 100, attempt) for attempt in (7, 8)]
    for writer in writers:
        writer.add(1, b"\x05\x00\x01\x00")
    opened, first = [], writers[0]

    class Meanwhile:
        """Lets the other writer run between the first one's opening of its file and its move."""

        def open_output_stream(self, path):
            opened.append(path)
            return plain.open_output_stream(path)

        def move(self, source, target):
            assert writers[1].close()["file"] == target.rsplit("/", 1)[1]
            token_files.read_shard((tmp_path / "part-0000003-00000.tok").read_bytes())
            plain.move(source, target)

    plain, first.fs = first.fs, Meanwhile()
    assert first.close()["n_ids"] == 2
    assert [p.name for p in tmp_path.iterdir()] == ["part-0000003-00000.tok"] and len(opened) == 1
    ids, bounds, doc_ids, without = token_files.read_shard((tmp_path / "part-0000003-00000.tok").read_bytes())
    assert (ids.tolist(), bounds.select(0, 1).tolist(), doc_ids.tolist(), without) == ([5, 1], [2], [1], 0)


def test_token_files_of_an_empty_table(spark):
    folder, manifest = token_files.write_shards(frame(spark, []), LOWER)
    assert manifest.count() == 0
    assert token_files.read_documents(folder, manifest).count() == 0


def check_packed(rows, size):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


@pytest.mark.parametrize("size", [64, 2_048])
def test_packing(spark, size):
    packed = packing.pack(frame(spark), BYTES, size)
    rows = packed.collect()
    plain = plain_ids(BYTES, packing.END_ID)
    expected = []
    for doc_id, text in awkward():
        ids = plain(text)
        for piece, (start, length) in enumerate(packing.cut(len(ids), size)):
            expected.append((doc_id, piece, start, length, crc(ids[start : start + length])))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    n = check_packed(rows, size)
    assert n <= -(-sum(r["length"] for r in rows) // size) + 2
    by_sequence = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        a = 2 * r["offset"]
        assert bytes(by_sequence[r["sequence_id"]])[a : a + 2 * r["length"]] == bytes(r["ids"])


def test_cut_gives_the_remainder_first():
    assert packing.cut(5, 8) == [(0, 5)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    size = rnd.choice([16, 100, 257])
    histogram = {rnd.randint(1, size): rnd.randint(1, 50) for _ in range(rnd.randint(0, 60))}
    plan = packing.plan_sequences(histogram, size)
    used = defaultdict(int)
    for pattern, times in plan:
        assert sum(pattern) <= size and times > 0
        for length in pattern:
            used[length] += times
    assert dict(used) == histogram


def test_plan_fills_gaps_exactly():
    # One, two and three pieces that complete the long one; nothing is wasted.
    assert packing.plan_sequences({70: 3, 30: 1, 20: 1, 10: 4}, 100) == [((70, 30), 1), ((70, 20, 10), 1), ((70, 10, 10, 10), 1)]


def test_empty_table_packs_to_nothing(spark):
    assert packing.pack(frame(spark, []), BYTES).count() == 0


def plain_viterbi(model, text):
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        score = choice = None
        for start in range(max(0, end - model.longest), end):
            piece = model.pieces.get(text[start:end])
            if piece and (score is None or best[start] + piece[1] > score):
                score, choice = best[start] + piece[1], (start, [piece[0]])
        unknown = best[end - 1] + model.unknown_score
        if score is None or (text[end - 1] not in model.pieces and unknown > score):
            score, choice = unknown, (end - 1, model.character_ids(text[end - 1]))
        best.append(score)
        back.append(choice)
    out, end = [], len(text)
    while end:
        end, ids = back[end]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def test_streaming_viterbi_and_trie_counts(spark):
    model = PieceModel(PIECES)
    docs = [(i, (t or "")[:3_000]) for i, t in awkward()]
    encoded = stream_viterbi.encode_pieces(frame(spark, docs), PIECES)
    expected = [(i, plain_viterbi(model, marked(t))) for i, t in docs]
    assert rows_of(encoded) == sorted(expected, key=repr)
    decoded = stream_viterbi.decode_pieces(encoded, PIECES).select("doc_id", "text")
    assert rows_of(decoded) == sorted(((i, t.replace("▁", " ")) for i, t in docs), key=repr)
    counts = trie_counts.token_counts(frame(spark, docs), PIECES).select("doc_id", "n_tokens")
    assert rows_of(counts) == sorted(((i, len(ids)) for i, ids in expected), key=repr)


def test_encoder_does_not_depend_on_portions_and_forgets():
    model = PieceModel(PIECES)
    text = marked("".join(prose(9, 400).split()) + "x" * 500 + prose(10, 50))
    whole = plain_viterbi(model, text)
    for step in (1, 7, 1_000):
        encoder, ids = stream_viterbi.StreamingEncoder(model), []
        for at in range(0, len(text), step):
            ids += encoder.feed(text[at : at + step])
        assert ids + encoder.finish() == whole
        assert encoder.widest <= 20 * model.longest


def test_trie_counts_when_it_is_emptied_and_for_long_words(monkeypatch):
    model = PieceModel(PIECES)
    monkeypatch.setattr(trie_counts, "MAX_NODES", 40)
    monkeypatch.setattr(trie_counts, "KEPT_LENGTH", 12)
    trie = trie_counts.CountTrie(PIECES)
    for text in (prose(3, 80), "".join(prose(4, 80).split()), "日本" * 20):
        assert trie.count(text)[1] == len(plain_viterbi(model, marked(text)))


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert stream_viterbi.round_trip(empty, PIECES).count() == 0
    assert trie_counts.token_counts(empty, PIECES).count() == 0


def test_library_as_unigram_agrees():
    """The library itself, told that the file is a unigram model, splits words the same way."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:  # the runs of spaces score -1e9, beside which single precision loses the others
        piece.score = max(piece.score, -50_000.0)
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder = stream_viterbi.StreamingEncoder(PieceModel(PIECES))
    for word in {w.strip(".,") for w in prose(12, 400).split()}:
        assert encoder.encode(marked(word)) == library.encode(word)


def test_a_worker_holds_one_cache_of_words():
    for name in ("_first", "_second"):
        worker_state(name, dict, alone=True)["seen"] = name
    assert worker_state("_second", dict, alone=True) == {"seen": "_second"}
    assert worker_state("_first", dict, alone=True) == {}
