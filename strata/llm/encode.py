"""Token ids of whole texts by a public BPE tokenizer, one word at a time.

Both vocabularies split a text into pieces that never reach over certain
places (``word``: white space; ``byte``: before a space that precedes a
character), so a text's ids are those of its stretches between such places,
end to end. Stretches repeat; a memo of their ids spares the library most of
the work. What a memo
forgets costs time only. Texts
with special-token strings or rare separators go to the library whole.

For the byte vocabulary, a block's plain texts are cut into the pattern's
pieces in array steps. Each distinct piece has a number; new ones go to the
library many to a call, between letters that no merge takes, and the texts'
ids are gathered by number.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries held at most, by stretch and by piece.
MEMO, PIECES = 500_000, 600_000
#: Entries held at most when a block begins, for the byte vocabulary, and
#: pieces a library call and a string.
HELD, CALL, STRING = 300_000, 4096, 64
#: A stretch for the byte vocabulary: a word with at most one space before
#: it, or white space as its pattern takes it.
_BYTE_STRETCH = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Python and the library disagree on whether these are white space.
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")

#: Texts of these characters are composed already, lower-case letter by letter
#: and have no character on which Python and the library may disagree.
_PLAIN = re.compile("[^\x1c-\x1f\x85\u0130\u0250-\U0010ffff]*")
#: The pre-tokenizers' patterns as the vocabulary files state them.
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ODD_LATIN = "\x1c\x1d\x1e\x1f\x85"
#: White space that is not one space between words or one line break.
_GAPS = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\xa0", "\0")
#: Marks that end words; both patterns make one a piece of its own there.
_MARKS = (".", ",", ";", ":", "!", "?", ")", "|")


def is_plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _PLAIN.fullmatch(text) is not None
    return not any(c in text for c in _ODD_LATIN)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 characters stand for themselves, the others take the
    next ones from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Results of ``make`` by key."""

    def __init__(self, make, size: int):
        self.make, self.size = make, size

    def __missing__(self, key: str) -> bytes:
        self[key] = value = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.clear()


_LETTERS = _byte_letters()
_LETTER = np.array([ord(_LETTERS[b]) for b in range(256)], "<u2")
#: Plain texts' characters: 0 letter, 1 number, 2 another, 3 white space, 4 the space.
_KIND = np.array([4 if c == " " else 3 if c.isspace() else {"L": 0, "N": 1}.get(unicodedata.category(c)[0], 2)
                  for c in map(chr, range(0x250))], np.uint8)
#: A byte that UTF-8 never has, and a character that is not plain.
_BETWEEN, _BREAK = b"\xc0", "\ue000"
_open: dict[str, Encoder] = {}


def cut_plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of plain texts end to end, where the byte vocabulary's
    pieces start, where texts start and the last ends)."""
    codes = np.frombuffer("".join(texts).encode("utf-16-le"), "<u2")
    off, n = np.cumsum([0, *map(len, texts)]), len(codes)
    first = np.zeros(n + 1, bool)
    first[off] = True
    kind = _KIND[codes]
    white = kind >= 3
    start = first[:n].copy()  # a run starts there, but for one that the space before it belongs to
    start[1:] |= (kind[1:] != kind[:-1]) & ~((kind[:-1] == 4) & ~white[1:]) & ~(white[1:] & white[:-1])
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]  # of white space before a character, the last stands apart
    at = np.flatnonzero(start & (codes == ord("'")))
    at = at[~first[at + 1]]
    if len(at):  # 's 't 'm 'd 're 've 'll
        a, b = codes[at + 1], np.where(first[at + 2], 0, codes[np.minimum(at + 2, n - 1)])
        pair = np.isin(a, [ord("r"), ord("v")]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, 3 * pair)
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        end = at + size
        start[end[end < n]] = True
    return codes, np.flatnonzero(start), off


class Numbered:
    """Distinct pieces (UTF-16) by number, in order of arrival, and their ids
    end to end: piece ``i`` has ``ids[off[i]:off[i + 1]]``."""

    def __init__(self, tok):
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer(tok.model), tok.token_to_id(_LETTERS[_BETWEEN[0]])
        self.clear()

    @staticmethod
    def suits(tok) -> bool:
        """Whether the letter between pieces is a token that no merge takes."""
        letter, vocab = _LETTERS[_BETWEEN[0]], tok.get_vocab(with_added_tokens=False)
        return letter in vocab and not any(letter in v for v in vocab if v != letter)

    def __len__(self) -> int:
        return len(self.number)

    def clear(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.off = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def learn(self) -> None:
        """The ids of the pieces that have a number and none yet."""
        new = [*islice(reversed(self.number), len(self.number) - len(self.off) + 1)][::-1]
        ids, off = [self.ids], [self.off]
        for a in range(0, len(new), CALL):
            strings = []
            for b in range(a, min(a + CALL, len(new)), STRING):
                raw = _BREAK.encode("utf-16-le").join([*new[b:min(b + STRING, a + CALL)], b""]).decode("utf-16-le")
                raw = raw.encode().replace(_BREAK.encode(), _BETWEEN)
                strings.append(_LETTER[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le"))
            coded = self.tok.encode_batch_fast(strings, add_special_tokens=False)
            flat = np.fromiter(chain.from_iterable(c.ids for c in coded), "<u4")
            ends = np.flatnonzero(flat == self.end)
            if len(ends) != len(new[a:a + CALL]):
                raise ValueError("pieces and their ids do not pair")
            ids.append(flat[flat != self.end])
            off.append(off[-1][-1] + ends - np.arange(len(ends)))
        self.ids, self.off = np.concatenate(ids), np.concatenate(off)

    def encode(self, texts: list[str]) -> list[bytes]:
        codes, starts, off = cut_plain(texts)
        edges = 2 * np.append(starts, len(codes)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(codes)]).dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        n = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))[pieces.indices.to_numpy()]
        self.learn()
        ends = np.searchsorted(starts, off[1:])
        first = self.off[n]
        size = self.off[n + 1] - first
        to = np.concatenate([[0], np.cumsum(size)])
        raw = self.ids[np.repeat(first - to[:-1], size) + np.arange(to[-1])].tobytes()
        cut = [0, *(4 * to[ends]).tolist()]
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words = self.tok.normalizer is not None
        self.pattern = _WORD_PIECES if self.words else _BYTE_PIECES
        self.memo, self.pieces = Memo(self.stretch, MEMO), Memo(self.piece, PIECES)
        self.numbered = Numbered(self.tok) if not self.words and Numbered.suits(self.tok) else None

    @classmethod
    def at(cls, path: str) -> Encoder:
        """The tokenizer of this Python worker."""
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stretches(self, text: str) -> list[str]:
        """``text`` cut where its pieces cannot reach over."""
        if self.words:
            return text.split()
        if any(w in text for w in _GAPS) or text[:1].isspace() or text[-1:].isspace():
            return _BYTE_STRETCH.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def piece(self, p: str) -> bytes:
        letters = p.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.tok.model.tokenize(letters)]).tobytes()

    def plain(self, s: str) -> bytes:
        """A stretch of plain characters."""
        if self.words:
            s = s.lower()
        core = s[1:] if s[:1] == " " else s
        if core.isalpha():
            return self.pieces[s]
        if core[-1:] in _MARKS and core[:-1].isalpha():
            return self.pieces[s[:-1]] + self.pieces[s[-1]]
        return b"".join([self.pieces[p] for p in self.pattern.findall(s)])

    def stretch(self, s: str) -> bytes:
        return self.plain(s) if is_plain(s) else self.whole(s)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if self.numbered is not None and len(self.memo) + len(self.pieces) + len(self.numbered) > HELD:
            for held in (self.memo, self.pieces, self.numbered):
                held.clear()
        out, later = [], []
        for t in texts:
            plain = is_plain(t)
            if "<|" in t or (not plain and _ODD.search(t)):
                out.append(self.whole(t))
                continue
            if plain and self.numbered is not None:
                later.append(len(out))
                out.append(b"")
                continue
            self.memo.trim()
            self.pieces.trim()
            self.memo.make = self.plain if plain else self.stretch
            out.append(b"".join(map(self.memo.__getitem__, self.stretches(t))))
        if later:
            for i, ids in zip(later, self.numbered.encode([texts[i] for i in later]), strict=True):
                out[i] = ids
        return out
