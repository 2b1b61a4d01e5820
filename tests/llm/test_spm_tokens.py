import hashlib

import numpy as np
import pytest
import sentencepiece

from tabsmith.llm import spm_tokens as T

RAW = open(T.DEFAULT_MODEL, "rb").read()
TEXTS = [
    "", " ", "  a  b", "\n\n x\n", "日本語 🙂\x00\ttab", "a" * 3000, " \n ", "▁ mark ▁▁x", "x\0y z", "Straße äöü é", "end ", "\r\n",
    "the quick brown fox " * 500, "é ​ ﻿ \U0010ffff", "<s> </s> <unk> <0x41>",
]


@pytest.fixture(scope="module")
def peer():
    return sentencepiece.SentencePieceProcessor(model_proto=RAW)


def test_parsed_model_equals_library(peer):
    m = T.PieceModel.parse(RAW)
    n = peer.get_piece_size()
    assert [p for p, _, _ in m.pieces] == [peer.id_to_piece(i) for i in range(n)]
    assert np.allclose([s for _, s, _ in m.pieces], [peer.get_score(i) for i in range(n)])
    assert [k == T.BYTE for _, _, k in m.pieces] == [peer.is_byte(i) for i in range(n)]
    assert m.kind == T.BPE and m.byte_fallback and m.unk_id == peer.unk_id()


@pytest.mark.parametrize("check", [True, False])
def test_ids_equal_sentencepiece_and_decode_gives_the_text(peer, check):
    codec = T.Codec(RAW, check)
    ids, same = codec.encode(TEXTS)
    assert [i.tolist() for i in ids] == peer.encode(TEXTS) and all(same)
    plain = [t for t in TEXTS if "▁" not in t]  # the marker itself reads as a blank, as in the library
    assert [codec.decode(i) for i in codec.encode(plain)[0]] == plain
    assert codec.whole.decode_batch([i.tolist() for i in ids], skip_special_tokens=False) == [codec.decode(i) for i in ids]
    whole = T.Codec(RAW, check)
    whole.by_part = False
    assert [i.tolist() for i in whole.encode(TEXTS)[0]] == peer.encode(TEXTS)


def test_cache_limit_changes_nothing(peer, monkeypatch):
    monkeypatch.setattr(T, "CACHE_PARTS", 3)
    codec = T.Codec(RAW)
    for part in (TEXTS, TEXTS[::-1]):
        assert [i.tolist() for i in codec.encode(part)[0]] == peer.encode(part)


def test_a_differing_part_is_found_and_mended(peer):
    codec = T.Codec(RAW)
    from tokenizers import Tokenizer, models

    vocab = {p: i for i, (p, _, _) in enumerate(codec.model.pieces)}
    codec.backend = Tokenizer(models.BPE(vocab=vocab, merges=[], unk_token="<unk>", byte_fallback=True))
    ids, same = codec.encode(["the end", "\n"])
    assert [i.tolist() for i in ids] == peer.encode(["the end", "\n"]) and same[0] is False and codec.differing


def _unigram_model():
    """A small unigram model file with byte fallback, written by hand."""

    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + payload

    def block(number, payload):
        size, out = len(payload), b""
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        tag = number << 3 | 2
        head = bytes([tag]) if tag < 128 else bytes([tag & 127 | 128, tag >> 7])
        return head + out + bytes([size]) + payload

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -3.5, 1), ("b", -3.6, 1), ("ab", -4.0, 1), ("▁ab", -5.0, 1), ("aba", -5.5, 1), ("▁b", -6.0, 1)]
    raw = b"".join(block(1, block(1, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    trainer = field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7, 1])
    return raw + block(2, trainer) + block(3, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))


def test_unigram_models_are_rebuilt_too():
    raw = _unigram_model()
    peer, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), T.Codec(raw)
    texts = ["ab aba b", "abab", "", "a é b", "ba\nab", "abaab ab"]
    ids, _ = codec.encode(texts)
    assert codec.model.kind == T.UNIGRAM and [i.tolist() for i in ids] == peer.encode(texts)
    assert [codec.decode(i) for i in ids] == texts


def test_report_and_columns(spark, docs, doc_rows, no_docs, peer):
    got = T.token_report(spark, docs).collect()
    want = []
    for r in doc_rows:
        ids = np.array(peer.encode(r[1] or ""), dtype="<i4")
        want.append((r[0], len(ids), sum(peer.is_byte(int(i)) for i in ids), hashlib.sha256(ids.tobytes()).hexdigest(), True, True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    coded = T.encode_documents(spark, docs)
    back = coded.select("text", "token_ids", T.decode_column(spark, coded["token_ids"]).alias("again")).collect()
    assert coded.columns[: len(docs.columns)] == docs.columns and len(back) == len(doc_rows)
    assert all(r.text == r.again and (r.text is None) == (r.token_ids is None) for r in back)
    assert T.token_report(spark, no_docs).count() == 0 and T.encode_documents(spark, no_docs).count() == 0
