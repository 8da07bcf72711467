"""Encoding texts chunk by chunk with a bounded cache.

A space or newline between two characters that are not white space always starts a new
match of the splitting pattern of byte-level vocabularies, so a text may be cut before it
and the chunks encoded apart; for vocabularies that drop white space this holds as well.
Longer runs of white space stay inside a chunk. A block of texts is cut on its raw bytes,
equal chunks of the block become one dictionary entry, and only these entries are Python
objects: they are looked up in the cache or encoded, and the ids of all texts are gathered
from them at once.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa

from tessella.llm.words import doc_blocks, text_buffers

Encoder = Callable[[list[str]], list[bytes]]

#: Bytes of text that are encoded at once; a single longer text is one block.
BLOCK_BYTES = 1 << 23
#: Chunks whose ids are gathered at once.
GATHER = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: White space beyond ASCII, as the integers of its UTF-8 bytes.
_WIDE_SPACE = np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in range(128, 0x3001) if chr(c).isspace()))


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether two or three bytes from each position spell white space."""
    n = len(data)
    first, second, third = (data[np.minimum(at + k, n - 1)].astype(np.int64) for k in range(3))
    return np.isin(first << 8 | second, _WIDE_SPACE) | np.isin(first << 16 | second << 8 | third, _WIDE_SPACE)


def cut_places(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts between ``edges`` start, in ascending order."""
    n = len(data)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < n - 1)]
    before, after = data[at - 1], data[at + 1]
    good = ~(_SPACE[before] | _SPACE[after])
    at, before, after = at[good], before[good], after[good]
    odd = np.flatnonzero(np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3)))
    bad = np.zeros(len(at), dtype=bool)
    bad[odd] = _wide_space(data, at[odd] + 1)
    odd = np.flatnonzero(before >= 0x80)
    bad[odd] |= _wide_space(data, at[odd] - 2) & (data[at[odd] - 2] == 0xC2)
    odd = odd[at[odd] >= 3]
    bad[odd] |= _wide_space(data, at[odd] - 3) & (data[at[odd] - 3] >= 0xE1)
    mask = np.zeros(n + 1, dtype=bool)
    mask[at[~bad]] = True
    last = edges[1:] - 1  # a space at the end of a text, or at its start, is not between two characters
    mask[last[last >= 0]] = False
    mask[edges] = True
    return np.flatnonzero(mask[:n])


class ChunkCache:
    """Ids of texts by way of ``encode(chunks) -> list of bytes``, ids as ``dtype``.

    Beyond ``limit`` chunks the newer half is forgotten, so memory is bounded.
    """

    def __init__(self, encode: Encoder, dtype: str = "<u4", limit: int = 900_000) -> None:
        self.encode_chunks, self.dtype, self.limit = encode, np.dtype(dtype), limit
        self.known: dict[str, bytes] = {}

    def _lookup(self, names: list[str]) -> list[bytes]:
        blobs = list(map(self.known.get, names))
        missing = [i for i, b in enumerate(blobs) if b is None]
        if missing:
            if len(self.known) + len(missing) > self.limit:
                # the frequent chunks are among those seen first
                self.known = dict(islice(self.known.items(), self.limit // 2))
            fresh = [names[i] for i in missing]
            for i, name, blob in zip(missing, fresh, self.encode_chunks(fresh)):
                blobs[i] = blob
                if len(self.known) < self.limit:
                    self.known[name] = blob
        return blobs

    def encode_block(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between ``offs`` in a row, and where each text's ids start and end."""
        data, edges = raw[int(offs[0]) : int(offs[-1])], offs - offs[0]
        starts = cut_places(data, edges)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offs), np.int64)
        places = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        blobs = self._lookup(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize
        pool, first = np.frombuffer(b"".join(blobs), self.dtype), np.cumsum(sizes) - sizes
        codes = chunks.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        ids = np.empty(int(ends[-1]), self.dtype)
        for at in range(0, len(codes), GATHER):
            own, lo, hi = codes[at : at + GATHER], int(ends[at]), int(ends[min(at + GATHER, len(codes))])
            ids[lo:hi] = pool[np.repeat(first[own] - ends[at : at + len(own)], sizes[own]) + np.arange(lo, hi)]
        return ids, ends[np.searchsorted(starts, edges)]

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The place of the first text of each block of a string column, the ids of the
        block's texts in a row, and where each text's ids start and end; null counts as empty."""
        raw, offs = text_buffers(column)
        for lo, hi in doc_blocks(offs, BLOCK_BYTES):
            yield lo, *self.encode_block(raw, offs[lo : hi + 1])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; a null text is empty."""
        return [ids[a:b].tobytes() for _, ids, bounds in self.texts(pa.array(texts, pa.string())) for a, b in zip(bounds.tolist(), bounds.tolist()[1:])]


_SYMBOLS = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
#: The printable characters that stand for bytes in the vocabularies' files.
BYTE_CHARS = {b: chr(b) for b in _SYMBOLS} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SYMBOLS)}


def _opened(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def library_encoder(path: str, code: str = "I") -> Encoder:
    """Chunks to id bytes by the tokenizers library."""
    tokenizer = _opened(path)

    def encode(chunks: list[str]) -> list[bytes]:
        return [array(code, e.ids).tobytes() for e in tokenizer.encode_batch(chunks, add_special_tokens=False)]

    return encode


def rank_encoder(path: str, pattern: str) -> Encoder:
    """The same ids for a byte-level vocabulary whose ids follow its merges, from the ranks.

    The ids in the file are the ranks of the merges, so the rank-based library encodes
    alike and spends less on each of the many short chunks.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in BYTE_CHARS.items()}
    ranks = {bytes(back[c] for c in name): i for name, i in model["vocab"].items() if all(c in back for c in name)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    if order != sorted(order):
        raise ValueError(f"the ids of {path} do not follow its merges")
    encode_one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(chunks: list[str]) -> list[bytes]:
        return [array("I", encode_one(c)).tobytes() for c in chunks]

    return encode


_LATIN = re.compile(r"[ \n]?[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
_LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+").findall


def _word_merges(path: str) -> tuple[Callable[[bytes], list[int]], list[int]]:
    """A merger of the bytes of one word, and the ids of its ranks.

    The end of a word is one more byte that no UTF-8 text holds; joining it to the last byte
    ranks before all merges, so that what follows are the merges of the vocabulary.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: bytes([b]) for b, c in BYTE_CHARS.items()}
    end = model["end_of_word_suffix"]

    def name(token: str) -> bytes:
        stem = token.removesuffix(end)
        return b"".join(back[c] for c in stem) + b"\xff" * (stem != token)

    ids: list[int] = []
    ranks: dict[bytes, int] = {}
    vocab = model["vocab"]
    firsts = [(bytes([b]), vocab[c]) for b, c in BYTE_CHARS.items()]
    firsts += [(bytes([b, 255]), vocab[c + end]) for b, c in BYTE_CHARS.items()]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merged = [(name(a) + name(b), vocab[a + b]) for a, b in pairs]
    for token, i in [*((t, i) for t, i in firsts if len(t) == 1), (b"\xff", -1), *((t, i) for t, i in firsts if len(t) == 2), *merged]:
        if token not in ranks:
            ranks[token] = len(ids)
            ids.append(i)
    return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece, ids


def word_encoder(path: str, code: str = "H", limit: int = 300_000) -> Encoder:
    """Chunks to id bytes for the lower-casing vocabulary of words.

    Chunks of ASCII and Latin-1 letters, which normalisation only lower-cases, are split
    here and merged word by word; all others take the tokenizers library's whole path.
    """
    whole = library_encoder(path, code)
    merge, ids = _word_merges(path)
    known: dict[str, bytes] = {}

    def part(text: str) -> bytes:
        out = known.get(text)
        if out is None:
            out = array(code, [ids[r] for r in merge(text.encode() + b"\xff")]).tobytes()
            if len(known) >= limit:
                known.clear()
            known[text] = out
        return out

    def encode(chunks: list[str]) -> list[bytes]:
        return [b"".join(map(part, _LATIN_PARTS(c.strip().lower()))) if _LATIN(c) else whole([c])[0] for c in chunks]

    return encode
