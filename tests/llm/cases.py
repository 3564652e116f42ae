"""A small corpus: plain texts, copies, near copies, leaks, junk, empties, nulls, repeats and ties."""

import random
import re

_R = random.Random(5)
_SYLLABLES = "ba re mi to ku sa ne lo di fu ga pe".split()
_COMMON = "the of and to in is that for".split()


def word() -> str:
    return _R.choice(_COMMON) if _R.random() < 0.4 else "".join(_R.choice(_SYLLABLES) for _ in range(_R.randint(2, 4)))


def prose(n: int) -> str:
    out = []
    for k in range(n):
        w = word()
        out.append(w.capitalize() + (". " if k % 9 == 8 else " ") if k % 9 == 0 else w + (".\n" if k % 27 == 26 else " "))
    return "".join(out).strip()


BENCHMARK = [(k, prose(20 + 3 * k)) for k in range(6)] + [(6, None), (7, ""), (8, "too short"), (9, " ".join(word() for _ in range(9)))]


def _swapped(text: str, every: int) -> str:
    words = text.split(" ")
    return " ".join("changed" if k % every == every // 2 else w for k, w in enumerate(words))


_BASE = [prose(n) for n in (60, 80, 120, 300, 700, 90, 150, 64)]
_SHARED = "\n".join([prose(12).replace("\n", " "), prose(15).replace("\n", " "), prose(30).replace("\n", " ")])
TEXTS = [
    *_BASE,
    _BASE[0], _BASE[0], _BASE[3].upper(), _BASE[3] + " one more word", _swapped(_BASE[4], 200),
    prose(40) + "\n" + BENCHMARK[3][1] + "\n" + prose(40), prose(50) + " " + _swapped(BENCHMARK[5][1], 13) + " " + prose(30),
    prose(30) + "\n" + _SHARED + "\n" + prose(30), prose(20) + "\n\n" + _SHARED + "\n" + prose(10), _SHARED,
    None, "", "   \n\t ", "one", "One two", "ONE TWO THREE", "a b c a b c a b c", "### $$$ ||| " * 40, "nospaces" * 900,
    "über Éclair. ÉCOLE naïve, ok.  double  spaces\tand tabs", "it's they'll <|endoftext|> 12 345 日本語。テスト", "Licensed under CC BY 4.0\nAll rights reserved.",
    "This work is licensed under the GNU General Public License, version 3.\ncc by cc by", "Released under the MIT License.", "x" * 20_000, "wörter " * 3000, "same line here that has twenty words " * 4 + "\n" + "same line here that has twenty words " * 4,
]
DOCUMENTS = [(10 * k + 3, t, "en", f"src{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(TEXTS)]
DOCUMENTS += [DOCUMENTS[2], DOCUMENTS[15], (None, "a text without an id that is long enough", None, "src1", None), (None, None, None, None, None)]

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text) -> str:
    return (text or "").translate(_LOWER)


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")

_N = float("nan")
_INF = float("inf")


def _vector(near=None):
    if near is None:
        return [_R.uniform(-1, 1) for _ in range(64)]
    return [x + _R.uniform(-0.1, 0.1) for x in near]


_HUBS = [_vector() for _ in range(6)]
EMBEDDINGS = [(k, _vector(_R.choice(_HUBS)) if k % 3 else _vector(), _R.randrange(10)) for k in range(420)]
# one vector and its copies are a third of all rows; equal scores, repeated rows and ids, and every kind of row that takes no part
EMBEDDINGS += [(1000 + k, _HUBS[0], k % 3) for k in range(200)] + [EMBEDDINGS[0], EMBEDDINGS[100], EMBEDDINGS[7]] + [(300, _HUBS[1], 4), (None, _HUBS[0], 1), (500, _HUBS[0], None), (600, None, 1), (700, [], 2)]
EMBEDDINGS += [(800, [*_HUBS[0][:63], None], 1), (801, [*_HUBS[0][:63], _N], 1), (802, [_INF, *_HUBS[0][:63]], 1), (900, [-0.0] * 64, 3), (901, [0.5] * 64, 3), (1700, [-0.5] * 64, 3)]

PAGES = [(k, f"http://site/{k}", f"<html>{prose(12)}</html>") for k in range(40)]
PAGES += [(100 - k, f"http://copy/{k}", "<p>one page that has many copies</p>") for k in range(30)] + [PAGES[3], PAGES[3], PAGES[5]]
PAGES += [(200, None, None), (201, "", ""), (None, "http://x y\r\nWARC-Type: evil", "no id"), (None, "ü", "no id"), (202, "http://c", "no id"), (203, "http://d", "über\r\n\r\nWARC/1.1\r\n日本"), (204, "http://e", "x" * 700_000), (205, "http://f", "x" * 700_000)]
