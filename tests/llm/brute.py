"""Plain versions of the contracts, and a small table of awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"word{i}" for i in range(40))
NOISE = "Tiea or ingsh nter then blend edouen onstwh re ththention the anha are onen that is of the and by"

#: Clashing names: columns the operators use inside.
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, id long, h long, fp long, "
                            "dig long, tag long, w long, rank long, part int, seq int, component string, piece int, hot int")


def texts() -> list[tuple]:
    rows = [
        (1, f"{PASSAGE} and more of it {NOISE}"), (2, f"Before {PASSAGE} after {NOISE[::-1]}"),
        (3, PASSAGE), (4, PASSAGE), (4, PASSAGE), (5, None), (6, ""), (7, " \t\n\r\x0b\x0c "), (8, "one"), (9, "two words"),
        (None, f"nobody's {PASSAGE}"), (None, None), (10, "a\nb\n\na\n a\nb\nc d e f g h i j\nc d e f g h i j\n"),
        (11, "mail bob.x@example.com, again bob.x@example.com; +1 (017) 555-7713 and 555-7713, 1 (017) 555-7713 twice"),
        (12, "card 4111 1111 1111 1111 not 4111 1111 1111 1112; ip 10.0.0.255 not 10.0.0.256; x@y @ a@b.c"),
        (13, "x" * 40_000 + " " + "ab" * 30_000), (14, NOISE * 600), (15, "ÀÉÎ Straße 漢字 \x1c ſ é <|endoftext|> İΣ"),
        (16, f"{NOISE} {NOISE} idiot"), (17, "same words same words same words same words same words same words"),
        (-3, f"early {PASSAGE[:150]}"), (18, PASSAGE.upper()), (18, "another text under the same id"), (19, "🙂" * 301),
    ]
    return [(i, t, "en", "src0", len(t) if t is not None else None, 7, 7, 7, 7, 7, 7, 7, 7, 7, "c", 7, 7) for i, t in rows]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def tok(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def dedup(docs: list[tuple], k: int = 13) -> Counter:
    """docs: (doc_id, text). Null ids come after all others."""
    big = 1 << 70
    first: dict[tuple, int] = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i:i + k])
            first[g] = min(first.get(g, big), big if d is None else d)
    out: Counter = Counter()
    for d, t in docs:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < (big if d is None else d):
                gone.update(range(i, i + k))
        out[d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    return out


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text: str | None) -> int:
    w = words(lower(text))
    s = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [w] if w else []
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows: list[tuple]) -> Counter:
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, f"{fp[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows))


def rules(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(twice),
            len(w) < 10 or 100 * len(twice) > 20 * len(w))


def base_spans(text: str | None) -> str:
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(out))
