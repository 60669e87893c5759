"""Exact, fast encoding of Arrow string columns with the ``tokenizers`` library.

The library spends about 10 microseconds on each word, so a batch is cut into
pieces at places where its pre-tokenizer always cuts too, equal pieces are
encoded once, and the ids are gathered back with numpy.  Texts for which such
cuts are not safe (runs of two or more white-space characters, names of special
tokens) go through the library whole, so the ids never differ from
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached pieces a Python worker keeps at most (about 200 bytes each).
CACHE_PIECES = 300_000
#: Text bytes encoded at a time; bounds the worker's memory.
SLICE_BYTES = 4 << 20

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ODD = f"{_SPACE}{{2}}|<\\|"
#: ASCII punctuation but the apostrophe, which starts contractions.
_PUNCT = np.zeros(256, bool)
_PUNCT[np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Second UTF-8 bytes of the letters U+00C0..U+00FF, which follow a byte C3.
_LATIN_LETTER = np.zeros(256, bool)
_LATIN_LETTER[0x80:0xC0] = True
_LATIN_LETTER[[0x97, 0xB7]] = False


def _byte_level() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LEVEL = _byte_level()


def cut_points(data: np.ndarray) -> np.ndarray:
    """Marks the bytes before which a pre-token always ends, in texts without runs of white space: a space, a line
    break and the byte after it, punctuation that follows a letter."""
    cut = (data == 32) | (data == 10)
    cut[1:] |= data[:-1] == 10
    letter = _ASCII_LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _LATIN_LETTER[data[1:]]
    cut[1:] |= letter[:-1] & _PUNCT[data[1:]]
    return cut


def tokenizer_path(name: str) -> str:
    """A path is taken as it is; a bare file name is looked up among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes string arrays; one per vocabulary and Python worker (see :func:`encoder`)."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.drops_space = getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
        self.plain = re.compile("[a-zß-öø-ÿ]+" if self.lower else " ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
        sample = ["straße", "été", "the", "mañana", "owl", "überhaupt"]
        self.direct = self._model(sample) == self._library(sample)

    def _model(self, words: list[str]) -> list[bytes]:
        """Words of plain letters need no normalising or splitting; the library's model takes them as byte-level text."""
        tokenize, code = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        return [array(code, [t.id for t in tokenize(w.encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes() for w in words]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if not self.direct:
            return self._library(pieces)
        plain = [self.plain.fullmatch(x) is not None for x in pieces]
        model, rest = iter(self._model(list(compress(pieces, plain)))), iter(self._library([x for x, p in zip(pieces, plain, strict=True) if not p]))
        return [next(model if p else rest) for p in plain]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("H" if self.dtype.itemsize == 2 else "I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, and the number of ids of each; a null has none."""
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        own = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        bounds = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + n + 1]
        data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cut = cut_points(data) if len(data) else np.zeros(0, bool)
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        if self.drops_space and len(data):
            cut[1:] |= data[:-1] == 32
        if self.lower:
            data = _TO_LOWER[data]
        starts = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        codes, unique, cache = words.indices.to_numpy(), words.dictionary.to_pylist(), self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        if new := [x for x in unique if x not in cache]:
            cache.update(zip(new, self._pieces(new), strict=True))
        coded = [cache[x] for x in unique]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        begin, per = (np.cumsum(size) - size)[codes], size[codes]
        end = np.concatenate([[0], np.cumsum(per)])
        kind = np.int32 if end[-1] < 2**31 and size.sum() < 2**31 else np.int64
        place = np.repeat((begin - end[:-1]).astype(kind), per)
        place += np.arange(end[-1], dtype=kind)
        ids = np.frombuffer(b"".join(coded), self.dtype)[place]
        at = end[np.searchsorted(starts, bounds)]
        lengths = np.diff(at)
        if odd.any():
            cuts = np.split(ids, at[1:-1])
            for i, x in zip(np.flatnonzero(odd), self._library(texts.filter(pa.array(odd)).to_pylist()), strict=True):
                cuts[i] = np.frombuffer(x, self.dtype)
                lengths[i] = len(cuts[i])
            ids = np.concatenate(cuts)
        return ids, lengths


@lru_cache(maxsize=4)
def encoder(name: str) -> PieceEncoder:
    return PieceEncoder(name)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Parts of a batch with about ``most`` bytes of text each; a longer text has a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
