"""Exact tokenizer ids at corpus speed.

The byte-level tokenizer first cuts a text into pre-tokens and then merges bytes inside each of them, so the ids of a text are the
concatenated ids of any pieces whose cuts are pre-token cuts. A space between two characters that aren't white space always is such a cut.
Pieces of Latin letters, ASCII digits, punctuation but the apostrophe and single line ends are cut further into runs of one kind, each
of which is one pre-token. Cuts are found in numpy over the bytes of many texts at once, and the tokenizers library encodes each distinct
run, or each distinct piece that holds anything else, once. Texts with white space beyond ASCII or with an added token's string are
encoded whole, as are all texts if a tokenizer file isn't plain byte-level BPE. The ids are the same either way, and the same as of a
plain call with add_special_tokens=False.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beyond ASCII: texts with it are encoded whole.
WIDE_SPACE = "[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Kinds of bytes; the last three are white space.
OTHER, LETTER, MARK, DIGIT, SPACE, LINE, BLANK = range(7)
#: Distinct runs and pieces that a Python worker keeps; those beyond are encoded again for each slice of texts.
KEPT = 200_000


def kinds_of_bytes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = MARK
    for a, b, kind in (("0", "9", DIGIT), ("A", "Z", LETTER), ("a", "z", LETTER), ("'", "'", OTHER)):
        kinds[ord(a) : ord(b) + 1] = kind
    kinds[[9, 11, 12, 13, 28, 29, 30, 31]] = BLANK
    kinds[10], kinds[32] = LINE, SPACE
    return kinds


KINDS = kinds_of_bytes()


def cut_runs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin in the bytes of texts that begin at starts, and whether each is a piece that holds anything but one pre-token."""
    kind = KINDS[raw]
    high = np.flatnonzero(raw >= 0x80)
    if len(high):  # two bytes of a Latin letter: C3 and any but the signs for times and divided by
        lead = high[raw[high] == 0xC3]
        lead = lead[~np.isin(raw[lead + 1], (0x97, 0xB7))]
        kind[lead] = kind[lead + 1] = LETTER
    white = kind >= SPACE
    after, before = np.append(white[1:], True), np.append(False, white[:-1])
    after[starts[starts > 0] - 1] = True  # nothing follows the last byte of a text
    before[starts] = False
    first = (kind == SPACE) & ~before & ~after
    lone = first.copy()
    first[starts] = True
    strange = (kind == OTHER) | (kind == BLANK) | ((kind == SPACE) & ~lone) | ((kind == LINE) & (before | after))
    change = np.append(True, kind[1:] != kind[:-1])
    change[1:] &= ~lone[:-1]
    begin = np.flatnonzero(first | change)
    piece = np.cumsum(first[begin]) - 1
    pieces = begin[first[begin]]
    odd = np.zeros(len(pieces), bool)
    odd[np.searchsorted(pieces, np.flatnonzero(strange), side="right") - 1] = True
    kept = first[begin] | ~odd[piece]
    return begin[kept], odd[piece[kept]]


def byte_names() -> dict[int, str]:
    """The characters by which byte-level vocabularies name the bytes 0 to 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)}


def is_plain(tokenizer) -> bool:
    """Whether a tokenizer is byte-level BPE that cuts texts by the usual pattern and does nothing else."""
    spec = json.loads(tokenizer.to_str())
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    extras = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(byte_level and not spec["normalizer"] and not spec["truncation"] and not spec["padding"] and model["type"] == "BPE" and not any(model.get(k) for k in extras))


class Encoder:
    """Encodes texts to little-endian id bytes; one per Python worker and tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.model, self.names = is_plain(self.tokenizer), self.tokenizer.model, byte_names()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.kept: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Texts by the tokenizer itself."""
        if not texts:
            return []
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, runs: list[str]) -> list[bytes]:
        """The ids of pre-tokens."""
        if not runs:
            return []
        flat, cuts = [], [0]
        for n in "\0".join(runs).encode().decode("latin-1").translate(self.names).split(self.names[0]):
            flat += [t.id for t in self.model.tokenize(n)]
            cuts.append(len(flat))
        raw, width = np.array(flat, self.dtype).tobytes(), self.dtype.itemsize
        return [raw[a * width : b * width] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def known(self, runs: list[str], odd: np.ndarray) -> list[bytes]:
        """The ids of distinct runs, odd ones by the whole tokenizer."""
        out = [self.kept.get(r) for r in runs]
        new = np.array([ids is None for ids in out])
        for own, encode in ((new & ~odd, self.merged), (new & odd, self.ids)):
            places = np.flatnonzero(own).tolist()
            for k, ids in zip(places, encode([runs[k] for k in places]), strict=True):
                out[k] = ids
        if len(self.kept) < KEPT:
            self.kept.update((runs[k], out[k]) for k in np.flatnonzero(new).tolist())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, null as the empty text; no end id is added."""
        column = pa.array([t or "" for t in texts], pa.large_string())
        whole = pc.match_substring_regex(column, WIDE_SPACE)
        for content in self.added:
            whole = pc.or_(whole, pc.match_substring(column, content))
        whole = whole.to_numpy(zero_copy_only=False) | (not self.plain)
        out = dict(zip(own := np.flatnonzero(whole).tolist(), self.ids([texts[k] or "" for k in own]), strict=True))
        if len(out) < len(texts):
            column = pc.if_else(pa.array(whole), "", column)
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = (column.buffers()[2] or pa.py_buffer(b"")).slice(int(at[0]), int(at[-1] - at[0]))
            at = at - at[0]
            if not at[-1]:
                return [out.get(k, b"") for k in range(len(texts))]
            begin, odd = cut_runs(np.frombuffer(data, np.uint8), np.unique(at[:-1][np.diff(at) > 0]))
            runs = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(np.append(begin, at[-1]).astype(np.int64)), data]).dictionary_encode()
            index = runs.indices.to_numpy(zero_copy_only=False)
            strange = np.zeros(len(runs.dictionary), bool)
            strange[index[odd]] = True
            ids = pa.array(self.known(runs.dictionary.to_pylist(), strange), pa.large_binary()).take(runs.indices)
            cuts = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(begin, at)].tolist()
            raw = memoryview(ids.buffers()[2] or b"")
            return [out[k] if k in out else raw[a:b].tobytes() for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        return [out[k] for k in range(len(texts))]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def in_slices(texts: list[str | None], most_chars: int = 2_500_000):
    """(start, end) of runs of texts that together stay near most_chars, so that memory does not follow the batch size."""
    start = n = 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= most_chars:
            yield start, k + 1
            start, n = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
