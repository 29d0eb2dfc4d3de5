"""What the transducer keeps: hypotheses that can go on, and words that come back."""

import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers

from barloom.llm import bpe_transducer

RANKS = bpe_transducer.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_no_state_keeps_a_hypothesis_that_cannot_go_on():
    fst = bpe_transducer.Transducer(RANKS)
    for piece in (b" unglaublichkeiten", b"tionauxch", "éaiauxè".encode(), b"aaaaaaaaaaaaaaaaaaaab", bytes(range(256))):
        assert fst.encode(piece) == fst.merged(piece)
    assert all(node.child for state in fst.known for _, _, node in state)


def test_words_that_come_back_are_encoded_once(monkeypatch):
    codec = bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN, chunk_chars=200)
    plain = bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN)
    met, encode = [], codec.fst.encode
    monkeypatch.setattr(codec.fst, "encode", lambda piece: met.append(piece) or encode(piece))
    for i in range(200):
        text = f"xqzvword erntlyst wort{i}ung, é{i}"
        assert codec.encode(text) == plain.encode(text)
    assert met.count(b" erntlyst") == 1 and codec.held < 200 and len(codec.later) < 60 and len(codec.old_later) < 60


def test_states_share_the_nodes_of_their_hypotheses():
    fst, pick = bpe_transducer.Transducer(RANKS, arcs=500), random.Random(5)
    pieces = ["".join(pick.choices(["tion", "eux", "re", "é", "ing", "un", " ", "漢", "a"], k=pick.randint(1, 9))).encode() for _ in range(400)]
    assert [fst.encode(p) for p in pieces] == [fst.merged(p) for p in pieces]
    # what a byte does to the nodes is found out once for all tokens that may stand before, and arcs are forgotten in time
    assert len(fst.shapes) < 0.7 * sum(1 for _ in fst.known) and fst.made < 600


def test_new_words_of_a_text_are_split_in_one_go():
    codec, plain, calls = bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN), bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN), []
    codec.split = SimpleNamespace(findall=lambda text: calls.append(text) or plain.split.findall(text))
    text = " ".join(f"wort{i}ung,é'll\nx{i}" for i in range(200))
    ids, digits = codec.encode(text)
    whole = [i for piece in plain.split.findall(text) for i in plain.fst.encode(piece.encode())]
    assert ids == whole and digits == " ".join(map(str, whole)) and codec.decode(ids) == text and len(calls) == 2


def test_new_words_of_many_texts_are_encoded_side_by_side(monkeypatch):
    pick = random.Random(11)
    parts = ["tion", "eux", "re", "é", "ing", "un", "\n", "漢字", "a", "'ll", "9", "17", ".", "😀", " ", "qu", "Ã", "\r\n\n"]
    texts = [" ".join("".join(pick.choices(parts, k=pick.randint(1, 7))) for _ in range(60)) for _ in range(80)]
    texts += ["", " ", "x", "two  spaces", " begin", "end ", "tab\t next", f"{'long' * 40} {'é漢' * 60}{'!' * 300} b", "a\n b"]
    codec, plain = bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN), bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN)
    alone, encode = [], codec.fst.encode
    monkeypatch.setattr(codec.fst, "encode", lambda piece: alone.append(piece) or encode(piece))
    got = list(codec.encode_all(texts))
    for text, (digits, decoded) in zip(texts, got, strict=True):
        ids = [i for piece in plain.split.findall(text) for i in plain.fst.encode(piece.encode())]
        assert digits == " ".join(map(str, ids)) and decoded == text
    # few pieces went through the transducer by themselves: first words, long pieces, texts that cannot be cut at their spaces
    assert len(codec.later) > 2000 and codec.side is not None and len(alone) < len(codec.later)
    met = len(alone)
    assert list(codec.encode_all(texts)) == got and len(alone) == met


def test_side_by_side_equals_the_definition_for_any_vocabulary():
    # bytes and a few merges, with gaps between the ranks and a token that no merges lead to
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 301, b"abc": 302, b"cab": 305, b"aa": 310, b"aaa": 311, b"xyz": 320, b"abcab": 330}
    fst, pick = bpe_transducer.Transducer(ranks), random.Random(3)
    pieces = [bytes(pick.choices(b"abcxyz\xc3", k=pick.randint(1, 20))) for _ in range(2000)] + [b"xyz", b"abcab", b"axyz"]
    size = np.array([len(p) for p in pieces])
    ids, begins = bpe_transducer.SideBySide(fst).encode(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [[ranks[p]] if p in ranks else fst.merged(p) for p in pieces]
