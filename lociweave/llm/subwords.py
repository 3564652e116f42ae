"""Exact subword encoding of whole columns, by distinct pieces.

A text is cut at boundaries that no pre-token crosses, the pieces of a batch are
dictionary-encoded, and the library encodes each distinct piece once. The ids of
a text are those of its pieces, so the result is what the library gives for the
whole text, at a fraction of the work.

Safe boundaries:

* byte-level BPE with its usual pattern: before a single space between two
  non-blank characters. The pattern ends any match there, and a new one starts
  with the space. Special strings hold no blanks, so none is cut.
* word BPE that drops blanks: any ASCII blank. NFC never composes across one.

A piece of Latin letters and one full stop or comma is also two pre-tokens.
"""

from __future__ import annotations

import array
import functools
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lociweave.llm.common import one_thread

#: Pieces a worker remembers, the longest of them in characters, and bytes for one call of the library.
REMEMBERED = 900_000
LONGEST = 40
CALL_BYTES = 1 << 20

#: Words in one text of the library, and what marks a word's last token.
TOGETHER = 64
WORD_END = "</w>"
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch

TAILS = (".", ",")
_LATIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
_SAFE = re.compile(r"(?<=\S)(?= \S)")


@functools.cache
def tokenizer(path: str):
    one_thread()
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def by_bytes(pieces: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """``pieces`` in runs of about ``most`` bytes; a longer piece is a run of its own."""
    run, size = [], 0
    for p in pieces:
        n = 4 * len(p)
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(p)
        size += n
    if run:
        yield run


class _Memory:
    """What the library gives for a piece, remembered up to a bound; past it, the older half is forgotten."""

    def __init__(self, path: str, value: Callable, joined: Callable | None = None):
        """``joined`` gives the values of lower-case Latin words, many in one text."""
        self.tokenizer, self.value, self.joined, self.known = tokenizer(path), value, joined, {}

    def __call__(self, pieces: list[str]) -> list:
        known = self.known
        if len(known) > REMEMBERED:
            for k in list(itertools.islice(known, len(known) // 2)):
                del known[k]
        out = [known.get(p) for p in pieces]
        missing = [i for i, v in enumerate(out) if v is None]
        if self.joined is not None:
            plain = [i for i in missing if _PLAIN(pieces[i])]
            for i, v in zip(plain, self.joined([pieces[i] for i in plain]), strict=True):
                out[i] = v
                if len(pieces[i]) <= LONGEST:
                    known[pieces[i]] = v
            missing = [i for i in missing if out[i] is None]
        at = 0
        for run in by_bytes([pieces[i] for i in missing]):
            for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False):
                i = missing[at]
                out[i] = v = self.value(e)
                if len(pieces[i]) <= LONGEST:
                    known[pieces[i]] = v
                at += 1
        return out


@functools.cache
def _lengths(path: str) -> _Memory:
    return _Memory(path, len)


@functools.cache
def _ids(path: str) -> _Memory:
    return _Memory(path, lambda e: array.array("I", e.ids).tobytes(), _Joined(path))


class _Joined:
    """Word BPE ids of words of letters alone, ``TOGETHER`` of them in one text: each is one pre-token, and its last id ends a word."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith(WORD_END)

    def __call__(self, words: list[str]) -> list[bytes]:
        texts = [" ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        out = []
        for run in by_bytes(texts):
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)])
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out


def forget(path: str) -> None:
    """Drops the word ids that this worker remembers: where each word of a corpus comes once, none comes again."""
    _ids(path).known.clear()


def _cores(pieces: pa.Array, fold: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct cores, core of each piece, tail of each piece or -1) with tails as places in ``TAILS``.

    ``fold``: the tokenizer lowers case, so Latin words are looked up in lower case.
    """
    latin = pc.match_substring_regex(pieces, _LATIN)
    tail = np.full(len(pieces), -1)
    cores = pc.if_else(latin, pc.utf8_lower(pieces), pieces) if fold else pieces
    for k, t in enumerate(TAILS):
        tail[np.asarray(pc.and_(latin, pc.ends_with(pieces, t)))] = k
    cores = pc.if_else(pa.array(tail >= 0), pc.utf8_slice_codeunits(cores, 0, -1), cores)
    coded = cores.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), tail


def _strings(texts: pa.Array) -> pa.Array:
    """64-bit offsets, as the pieces of a batch can pass 2 GB."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def _counted(pieces: pa.Array, count: _Memory) -> np.ndarray:
    cores, at, tail = _cores(pieces, False)
    n = np.array(count(cores), dtype=np.int64).reshape(-1)[at]
    return n + np.append(np.array(count(list(TAILS)), dtype=np.int64), 0)[tail]


def token_counts(texts: pa.Array, path: str) -> np.ndarray:
    """The number of byte-level BPE tokens of each text, null as empty."""
    texts = _strings(texts)
    count = _lengths(path)
    split = pc.split_pattern(texts, " ")
    starts = np.asarray(split.offsets)[:-1] - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    at, pieces = np.asarray(coded.indices), coded.dictionary
    if not len(texts):
        return np.zeros(0, dtype=np.int64)
    plain = np.asarray(pc.and_(pc.equal(pieces, pc.utf8_trim_whitespace(pieces)), pc.not_equal(pieces, "")))
    odd = np.add.reduceat((~plain)[at].astype(np.int64), starts) > 0
    led = np.zeros(len(pieces), dtype=np.int64)
    inner = np.ones(len(at), dtype=bool)
    inner[starts] = False
    used = np.zeros(len(pieces), dtype=bool)
    used[at[inner]] = True
    used &= plain
    led[used] = _counted(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pieces.filter(pa.array(used)), pa.scalar(" ", pa.large_string())), count)
    each = np.where(inner, led[at], 0)
    out = np.add.reduceat(each, starts)
    simple = np.flatnonzero(~odd)
    out[simple] += _counted(pieces.take(pa.array(at[starts[simple]])), count)
    for i in np.flatnonzero(odd):
        text = texts[i].as_py()
        out[i] = sum(count(_SAFE.split(text))) if text else 0
    return out


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Word BPE ids of all texts, joined, and the number of each text's ids; null as empty."""
    texts = _strings(texts)
    if not len(texts):
        return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
    split = pc.ascii_split_whitespace(texts)
    starts = np.asarray(split.offsets)[:-1] - split.offsets[0].as_py()
    counts = np.diff(np.asarray(split.offsets))
    coded = split.flatten().dictionary_encode()
    at = np.asarray(coded.indices)
    cores, core, tail = _cores(coded.dictionary, True)
    memory = _ids(path)
    made = memory(cores)
    sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
    # ids of each distinct piece: its core's, then its tail's
    held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.frombuffer(b"".join(made), dtype="<u4"))).take(pa.array(core)).flatten()
    n = sizes[core]
    pool = np.asarray(held)
    if (tail >= 0).any():
        marks = np.concatenate([np.frombuffer(b, dtype="<u4") for b in memory(list(TAILS))])
        more = np.flatnonzero(tail >= 0)
        pool = np.insert(pool, np.cumsum(n)[more], marks[tail[more]])
        n = n + (tail >= 0)
    ids = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(n))), pa.array(pool)).take(pa.array(at)).flatten()
    ends = np.append(0, np.cumsum(n[at]))
    return np.asarray(ids), ends[starts + counts] - ends[starts]
