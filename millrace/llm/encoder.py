"""Whole-text encoding with the tokenizers library, with a bounded cache of white-space chunks.

The public word-level vocabulary drops white space before it merges, so a text's ids are the
ids of its white-space chunks in turn, and a Latin chunk's are those of its pieces. Pieces repeat;
each distinct one is encoded by the library once per worker while it stays in the cache, where
a chunk that is a piece finds itself; the others are split anew, once a slice of texts. ``Encoder.exact`` is the plain call that
tests compare with. Ids fit 16 bits and travel as little-endian unsigned 16-bit binary.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Bytes of texts at a time where nothing is gained by more of them together.
SLICE = 2 << 20


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known:
    """Ids of strings, in one Arrow array and two of numpy: a Python object for each takes many times their memory, and pins more."""

    def __init__(self):
        self.keys, self.ids, self.ends = pa.array([""], pa.large_string()), np.empty(0, dtype="<u2"), np.zeros(1, dtype="int32")

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key: where its ids start and how many they are; and the places of keys that are not known."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = np.diff(self.ends, prepend=np.int32(0))
        return (self.ends - sizes)[at], sizes[at], np.flatnonzero(at < 0)

    def add(self, keys: list[str], ids: list[bytes]) -> None:
        more = np.cumsum(_sizes(ids), dtype="int32") + self.ends[-1]
        self.keys = pa.concat_arrays([self.keys, pa.array(keys, pa.large_string())])
        self.ids, self.ends = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype="<u2")]), np.concatenate([self.ends, more])


class Encoder:
    """Encodes texts to uint16 ids, without special tokens, an end id appended to each."""

    #: Distinct pieces, and chunks not in Latin letters, kept in a worker, of at most SHORT characters (about 30 bytes each, so
    #: 12 MB in all). Frequent ones come early, so a full cache takes no more.
    CACHE, SHORT = 400_000, 64
    #: Unknown chunks that are Python strings at a time.
    PORTION = 20_000
    #: Chunks of Latin letters, digits and punctuation but '<' (which could start an added token): NFC, one-to-one in lower case.
    LATIN = re.compile(r"[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,64}")
    #: Whether some of many chunks, a line each, has other characters.
    OTHER = re.compile(r"[^\n!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
    #: The vocabulary's pre-tokenizer rule, on those; line ends are pieces.
    RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u024f]+|[0-9]|[^\sa-z0-9\u00df-\u024f]+|\n")
    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.known = Known()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("this vocabulary does not fit 16-bit ids")
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for piece, i in vocabulary.items():
            self.closes[i] = piece.endswith("</w>")

    @classmethod
    def of(cls, path: str, end_id: int = END_ID) -> Encoder:
        """One for each worker process, so that its cache outlives a task."""
        if (path, end_id) not in cls._made:
            cls._made[path, end_id] = cls(path, end_id)
        return cls._made[path, end_id]

    def exact(self, texts: list[str]) -> list[list[int]]:
        """The library's plain call."""
        return [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Encode pieces as one text: each ends with the one id that closes it."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u2")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pieces):
            return self._plain(pieces)
        raw, bounds = ids.tobytes(), [0, *(2 * ends).tolist()]
        return [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def _keep(self, keys: list[str], ids: list[bytes]) -> None:
        room = self.CACHE - len(self.known)
        short = list(islice((i for i, x in enumerate(keys) if len(x) <= self.SHORT), max(0, room)))
        if short:
            self.known.add([keys[i] for i in short], [ids[i] for i in short])

    def _learn(self, missing: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct chunks that are not known: ids, where each one's start and how many they are."""
        parts, plain, is_plain = [pa.array([], pa.large_string())], [], np.zeros(len(missing), dtype=bool)
        for i in range(0, len(missing), self.PORTION):
            latin = _strings(missing.slice(i, self.PORTION))
            if max(map(len, latin)) > 64 or self.OTHER.search("\n".join(latin)):
                fits = list(map(self.LATIN.fullmatch, latin))
                is_plain[i : i + len(fits)] = [x is None for x in fits]
                plain += [c for c, x in zip(latin, fits, strict=True) if x is None]
                latin = [c for c, x in zip(latin, fits, strict=True) if x is not None]
            # a portion's chunks are split at once, by lines
            if latin:
                parts.append(pa.array(self.RULE.findall("\n".join([*latin, ""]).lower()), pa.large_string()))
        words = pa.concat_arrays(parts).dictionary_encode()
        del parts
        line = pc.index(words.dictionary, "\n").as_py()
        starts, sizes, new = self.known.find(words.dictionary)
        new = new[new != line]
        pieces, pool, fresh = _strings(words.dictionary.take(pa.array(new))), self.known.ids, []
        for i in range(0, len(pieces), 2000):
            fresh += self._encode_pieces(pieces[i : i + 2000])
        sizes[new] = _sizes(fresh)
        starts[new] = len(pool) + np.cumsum(sizes[new], dtype="int32") - sizes[new]
        if line >= 0:
            sizes[line] = 0
        index = words.indices.to_numpy(zero_copy_only=False)
        ids, ends = _gathered(np.concatenate([pool, np.frombuffer(b"".join(fresh), dtype="<u2")]), starts[index], sizes[index])
        others = [x for i in range(0, len(plain), 500) for x in self._plain(plain[i : i + 500])]
        self._keep(pieces, fresh)
        self._keep(plain, others)
        size = np.empty(len(missing), dtype="int32")
        size[~is_plain], size[is_plain] = np.diff(ends[index == line], prepend=np.int32(0)), _sizes(others)
        start = np.empty_like(size)
        for of, first in ((~is_plain, 0), (is_plain, len(ids))):
            start[of] = first + np.cumsum(size[of], dtype="int32") - size[of]
        return np.concatenate([ids, np.frombuffer(b"".join(others), dtype="<u2")]), start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) one after another, end ids included, and how many each text has."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words, chunks = lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        del lists
        starts, sizes, missing = self.known.find(words.dictionary)
        pool = self.known.ids
        if len(missing):
            learnt, at, sizes[missing] = self._learn(words.dictionary.take(pa.array(missing)))
            starts[missing] = len(pool) + at
            pool = np.concatenate([pool, learnt])
        index = words.indices.to_numpy(zero_copy_only=False)
        ids, ends = _gathered(pool, starts[index], sizes[index])
        bounds = np.concatenate([[0], ends])[chunks]
        n = np.diff(bounds).astype("int64")
        out = np.empty(len(ids) + len(n), dtype="<u2")
        out[np.arange(len(ids), dtype="int32") + np.repeat(np.arange(len(n), dtype="int32"), n)] = ids
        out[np.cumsum(n + 1) - 1] = self.end_id
        return out, n + 1


def _sizes(ids: list[bytes]) -> np.ndarray:
    """How many ids each has."""
    return np.fromiter(map(len, ids), dtype="int32", count=len(ids)) // 2


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of spans of the pool one after another, and where each span's end."""
    # 32 bits suffice: a slice's texts hold a few MB, and a single text below 2 GB
    ends = np.cumsum(sizes, dtype="int32")
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at), dtype="int32")
    return pool[at], ends


def _strings(chunks: pa.Array) -> list[str]:
    """The values of an array of large strings without white space (no nulls), cut from one string: to_pylist() makes a scalar of each."""
    if not len(chunks):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(chunks)], pa.int64()), chunks)
    return pc.binary_join(whole, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20):
    """Cut a batch so that a slice's texts (null: empty) hold about ``most_bytes`` (a longer text is alone)."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype="int64")
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most_bytes, "right")))
        yield batch.slice(i, j - i)
        i = j


def binaries(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary array of the ids of each text, from encode()'s result."""
    ends = np.concatenate([[0], 2 * np.cumsum(n)]).astype("int64")
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def crc32_u32(ids: bytes | np.ndarray) -> int:
    """Unsigned crc32 of uint16 ids as little-endian unsigned 32-bit integers."""
    values = np.frombuffer(ids, dtype="<u2") if isinstance(ids, (bytes, memoryview)) else ids
    return zlib.crc32(values.astype("<u4").tobytes())
