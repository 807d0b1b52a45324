import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import packing as P
from tallyframe.llm import planes as B
from tallyframe.llm import tokens as T
from tallyframe.llm.rows import identified, with_ids
from tallyframe.llm.tokens import TokenIds

ODD = ["a  b", "a   b \n c", "\n  b", " x", " ", "  ", "a \x1c b\x1d  c", "it's we'll  'S", "", "  x  y", "<|endoftext|> x", "é \u0301x  Å", "ΑΣ Σ", "1 2  33 4a",
       "a <|endoftext|> b", "a<|endoftext|>", "<|endoftext|><|endoftext|>x y", "<|startoftext|> a <|ENDOFTEXT|> <|endoftext", "<| endoftext |>  b",
       "a\0 b", "\t\t  x\r\n  y", "日本 語  テ", "Ünder, straße. ÀÉ! don't", "x " * 3000]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(name, space):
    coder, library = TokenIds(public_tokenizers.path(name), space, cache_pieces=20), Tokenizer.from_file(public_tokenizers.path(name))
    for text, got in zip(ODD, coder.encode(ODD)):
        assert np.frombuffer(got, coder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def whole(name, rows, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x in rows}


def test_sequences_hold_every_id_once(spark):
    rows = [*enumerate(ODD * 3), (999, None)]
    docs = identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text")
    got = P.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), length=64, ids_too=True).collect()
    for i, ids in whole("byte_bpe_50k.json", rows, 1).items():
        mine = sorted((r for r in got if r["uid"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in mine) == ids.tobytes()
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in mine)
        assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine]])[:-1].tolist()
    filled: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == 64 or n & (n - 1) == 0 for n in filled.values())


def test_hilbert_steps_to_a_neighbour():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = P.hilbert(points, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_shard_round_trip(mode):
    r = np.random.RandomState(1)
    for n in (0, 1, 7, 1000, 4097):
        ids, counts = r.randint(0, 2**32, n).astype("<u4"), np.array([n, 0])
        shard = B.Shard(io.BytesIO(B.shard_bytes(ids, np.array([5, 6]), counts, mode, 512)))
        assert shard.ids(0, n).tolist() == ids.tolist() and shard.counts.tolist() == [n, 0] and shard.doc_ids.tolist() == [5, 6]
        if n > 600:
            assert shard.ids(500, 600).tolist() == ids[500:600].tolist()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_files_hold_all_ids_in_order(spark, mode):
    rows = [(i * 5 % 97, t) for i, t in enumerate(ODD * 3)] + [(99, None)]
    docs = identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text")
    folder, manifest = B.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2, mode=mode)
    got = {r["uid"]: r for r in B.read_ids(folder, manifest, ids_too=True).collect()}
    at = 0
    for i, ids in sorted(whole("word_bpe_49k.json", rows, 2).items()):
        assert bytes(got[i]["ids"]) == ids.tobytes() and (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids))
        at += len(ids)


def test_empty_repeated_and_null_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    none = identified(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert P.packed(none, path).collect() == []
    assert B.read_ids(*B.write_ids(none, path, 1, space_joins=True)).collect() == []
    docs = identified(spark.createDataFrame([(7, "b"), (7, "b"), (None, "n"), (7, "a")], "doc_id long, text string"), "doc_id", "text")
    got = with_ids(docs, P.packed(docs, path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "7", "None"] and sum(r["length"] for r in got) == 8


def test_stages_after_the_encoding_free_the_tokenizer_in_their_workers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    for later, columns in ((P._laid, {"uid": [1], "part": [0], "n_tokens": [2]}), (P._pieces(4, 2, True), {"uid": [1], "at": [0], "n_tokens": [2], "ids": [b"\x05\x00\x01\x00"]})):
        list(T.token_ids(path, True).encode(["some words"]))
        out = list(later(iter([pa.RecordBatch.from_pydict(columns)])))
        assert out[0].num_rows == 1 and not T._loaded
    assert out[0].column("ids")[0].as_py() == b"\x05\x00\x00\x00\x01\x00\x00\x00"


LATIN = ["Ouingon ouingon. OUINGON, ÉÀ éà ß ÿ Þa", "J̌ a ǰ", "İi İ ı", "Á µªº A B\u0085c", "KK Ω Σ ΑΣ.", "Don't DON'T", ""]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_group_of_texts_learns_each_piece_once(name, space):
    coder, library, asked = TokenIds(public_tokenizers.path(name), space), Tokenizer.from_file(public_tokenizers.path(name)), []
    learn = coder.learn
    coder.learn = lambda pieces: (asked.append(sorted(pieces)), learn(pieces))
    texts = (LATIN + ODD) * 10
    for text, got in zip(texts, coder.encode(texts)):
        assert np.frombuffer(got, coder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(asked) == 1 and len(set(asked[0])) == len(asked[0])
    assert ("Ouingon" in coder.known) is space  # capitals are no pieces of their own where the file drops case


def test_groups_and_generations_change_no_ids(monkeypatch):
    monkeypatch.setattr(T, "GROUP_CHARS", 30)
    for name, space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        coder, library = TokenIds(public_tokenizers.path(name), space, cache_pieces=5), Tokenizer.from_file(public_tokenizers.path(name))
        texts = (LATIN + ODD) * 2
        got = [np.frombuffer(g, coder.dtype).tolist() for g in coder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
