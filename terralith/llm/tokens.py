"""Token ids of whole texts by a word-end BPE, fast through a table of stems already seen.

The tokenizer replaces white space by a space and never joins what stands on both sides of it, so a text's ids are
those of its words (split at ASCII white space) one after the other. It lower-cases, and it cuts between a letter or
digit and a mark, so a word's ids are those of its lower-case stem and of the marks behind it. The distinct words of
a slice of texts are cut so by array operations. Each Python worker keeps the stems it has met (`CACHE_STEMS`) and
asks the tokenizer for new ones only: plain ones many at once, told apart by the word-end mark of their last token,
all others one by one.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import NOT_SPACE, chunks, text_array, words_in

CACHE_STEMS = 600_000
#: Text bytes of one vectorised step.
STEP_BYTES = 4 << 20

#: Marks that are cut off behind an ASCII letter or digit.
MARKS = b".,!?;:\""
WORD_END = "</w>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(MARKS)] = True
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[48:58] = _IS_ALNUM[65:91] = _IS_ALNUM[97:123] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(stem: str) -> bool:
    """One piece to the tokenizer: lower-case Latin letters in composed form."""
    return stem.isalpha() and max(stem) < "\u0250" and stem == stem.lower() and unicodedata.is_normalized("NFC", stem)


class WordTokenizer:
    def __init__(self, path: str, literal: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.stems: dict[bytes, int] = {b"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _store(self, stems: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.stems), len(stems)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[k : k + n] = sizes
        self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.stems.update(zip(stems, range(k, k + n), strict=True))

    def _learn_stems(self, stems: list[bytes]) -> None:
        texts = [x.decode() for x in stems]
        plain = [_plain(t) for t in texts]
        many = [t for t, p in zip(texts, plain, strict=True) if p]
        other = [i for i, p in enumerate(plain) if not p]
        if many:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(many)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(many):
                self._store([t.encode() for t in many], ids, np.diff(last, prepend=-1))
            else:
                other = list(range(len(stems)))
        if other:
            got = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)]
            self._store([stems[i] for i in other], np.array(list(chain.from_iterable(got)), np.uint32), np.array([len(x) for x in got], np.int64))

    def numbers(self, stems: pa.Array) -> np.ndarray:
        """Each stem's number, learnt where it is new."""
        kinds = stems.dictionary_encode()
        known = kinds.dictionary.to_pylist()
        fresh = [x for x in known if x not in self.stems]
        if fresh:
            if len(self.stems) + len(fresh) > CACHE_STEMS:
                self.clear()
                fresh = [x for x in known if x]
            self._learn_stems(sorted(fresh))
        return np.fromiter(map(self.stems.__getitem__, known), np.int64, len(known))[kinds.indices.to_numpy()]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, end to end, and how many each row has."""
        codes, words, rows_at = words_in(data, offs, NOT_SPACE[data])
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        stems, tails = split_marks(*text_array(words))
        number = self.numbers(pa.concat_arrays([stems, tails]))
        entries = np.stack([number[: len(words)], number[len(words) :]], axis=1).ravel()
        flat, sizes = _gathered(self.flat, self.start[entries], self.size[entries])
        sizes = sizes[0::2] + sizes[1::2]  # of each distinct word
        ids, sizes = _gathered(flat, (np.cumsum(sizes) - sizes)[codes], sizes[codes])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[rows_at])


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + size] of each entry, end to end, and the sizes."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])], sizes


def split_marks(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Lower-case stem and the marks behind it, for each word; a word that may hold a special token, which has a case, stays whole."""
    starts, ends = offs[:-1], offs[1:]
    at = np.arange(len(data))
    last = np.maximum.reduceat(np.where(_IS_MARK[data], -1, at), starts)  # of what is no mark
    stop = np.where((last >= 0) & _IS_ALNUM[data[last]], last + 1, ends)
    opens = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # <|
    row = np.searchsorted(offs, opens, side="right") - 1
    special = np.zeros(len(starts), bool)
    special[row[opens + 1 < ends[row]]] = True
    stop = np.where(special, ends, stop)
    sizes = ends - starts
    low = np.where(np.repeat(special, sizes), data, _LOWER[data])
    stem = at < np.repeat(stop, sizes)

    def binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(flat)])

    return binary(low[stem], stop - starts), binary(low[~stem], ends - stop)


_tokenizers: dict[tuple[str, bool], WordTokenizer] = {}


def word_tokenizer(path: str, literal: bool = False) -> WordTokenizer:
    """literal: the strings of special tokens in a text are ordinary text."""
    if (path, literal) not in _tokenizers:
        _tokenizers[path, literal] = WordTokenizer(path, literal)
    return _tokenizers[path, literal]


def token_batches(batches: Iterator[pa.RecordBatch], path: str, end: int, literal: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows with doc_id and text, ids end to end, ids of each row); each row's ids end in `end`."""
    coder = word_tokenizer(path, literal)
    for batch in chunks(batches, "text", STEP_BYTES):
        ids, sizes = coder.encode(*text_array(batch.column("text")))
        yield batch, np.insert(ids, np.cumsum(sizes), end), sizes + 1


def documents_with_tokens(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, n_tokens, ids: the ids as little-endian unsigned 32-bit, compressed (`unpack` gives them back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch, ids, sizes in token_batches(batches, path, end):
            raw = ids.astype("<u4").view(np.uint8)
            stops = 4 * np.cumsum(sizes)
            packed = [pack(planes(raw[a:b])) for a, b in zip((stops - 4 * sizes).tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def planes(raw: np.ndarray) -> bytes:
    """First bytes of all ids, then second ones, and so on; this compresses better."""
    return raw.reshape(-1, 4).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1).T.tobytes(), "<u4")
