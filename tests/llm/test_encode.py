"""Ids of plain texts by the byte vocabulary, many new pieces to a library call."""

from __future__ import annotations

import numpy as np

from strata.llm import encode, queries as Q


def test_new_pieces_share_library_calls(monkeypatch):
    rng = np.random.default_rng(4)
    enc = encode.Encoder(Q.tokenizer("byte_bpe_50k.json"))
    calls, tok = [], enc.numbered.tok

    class Counted:
        def encode_batch_fast(self, strings, **options):
            calls.append(len(strings))
            return tok.encode_batch_fast(strings, **options)

    enc.numbered.tok = Counted()
    monkeypatch.setattr(encode, "HELD", 3000)
    letters = [*"abcdefghij", "é", "À", "Ā", "ß", "²"]
    ends = ["", ".", ",", "'s", "'ll", "!!", "7", "\n", "\n\n", "\n\n\n", "  ", "\t", "\xa0", "\0", "\x7f", "×", "ª", "\r\n"]
    for _ in range(4):
        words = ["".join(rng.choice(letters, 7)) + ends[rng.integers(len(ends))] for _ in range(4000)]
        texts = [" ".join(words[a:a + 400]) for a in range(0, 4000, 400)]
        texts[3:3] = ["", " ", "a <|endoftext|> b", "漢字 ab’s", "à\x85b"]
        assert enc.encode(texts) == [enc.whole(t) for t in texts]
        assert len(enc.numbered) < 10_000  # what was held went when the next block began
        assert enc.encode([]) == []
    assert 4 <= len(calls) <= 12 and len(enc.pieces) < 20  # not a call for each piece


def test_plain_texts_cut_as_the_library_does():
    rng = np.random.default_rng(5)
    enc = encode.Encoder(Q.tokenizer("byte_bpe_50k.json"))
    texts = [f"a{c}b {c} 1{c}1'{c}{c}  {c}x'll{c}" for c in map(chr, range(0x250))]
    assert enc.encode(texts) == [enc.whole(t) for t in texts]
    some = [*"astrmdl1²!é\xa0\0ª\r\n\t '", "re", "ve", "ll", "''", "  ", "\n\n", "'s", "don't"]
    for _ in range(300):
        texts = ["".join(rng.choice(some, rng.integers(0, 12))) for _ in range(5)]
        assert enc.encode(texts) == [enc.whole(t) for t in texts]
