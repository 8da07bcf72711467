"""Byte-level BPE by a lazily determinised transducer, and streaming decoding (operator 5).

A sequence of tokens is what the merges produce exactly if every token re-encodes to itself
and every two neighbours, encoded together, come out as these two. That makes the encoder a
nondeterministic finite-state transducer over bytes: its states are (last token, node of the
vocabulary's trie), and it may end a token wherever the trie holds one that fits its left
neighbour. :class:`Transducer` determinises it lazily: a state is the set of live
alternatives with the tokens each has yet to emit; whatever all alternatives agree on is
emitted. A token is thus emitted after a lookahead that the longest token bounds. Steps
taken once are one dictionary lookup afterwards; the table is emptied when it is full.

:class:`StreamDecoder` turns ids into text as they arrive: an incremental UTF-8 state
machine holds back the bytes of an unfinished character (three at most).

Defined results: a null text is empty and has no tokens; its digests are those of no bytes.
Repeated rows, null ids, clashing extra columns and empty tables need no special case.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.chunks import ChunkCache
from tessella.llm.resident import resident

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_parts(data: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """Plain byte-pair encoding by the merges of a rank below ``below``: join the pair of
    lowest rank, leftmost first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and rank < below and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of plain byte-pair encoding."""
    return [ranks[p] for p in merge_parts(data, ranks)]


class Transducer:
    """Bytes in, tokens out; see the module's docstring."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 250_000) -> None:
        self.ranks, self.limit = ranks, limit
        self.names = {v: k for k, v in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for name, rank in ranks.items():
            node = 0
            for b in name:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][b] = nxt
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = rank
        self.whole: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self._reset()

    def _reset(self) -> None:
        start = (((), -1, 0),)
        self.ids = {start: 0}
        self.states = [start]
        #: By state and byte: the next state and the tokens emitted.
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _whole(self, token: int) -> bool:
        """Whether the merges ever produce ``token``."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = merge(self.names[token], self.ranks) == [token]
        return known

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts of ``token`` that lie at one end while its merges are undone, last first,
        each with the rank of the merge that ends it."""
        known = self.edges[right].get(token)
        if known is None:
            known, until, name = [], 1 << 60, self.names[token]
            while True:
                known.append((name, until))
                if len(name) == 1:
                    break
                until = self.ranks[name]
                name = merge_parts(name, self.ranks, until)[-1 if right else 0]
            self.edges[right][token] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right``, encoded together, come out as these two.

        They do unless, at some time in the course of the merges, the parts at the two
        sides of the boundary join each other before either joins its own neighbour.
        """
        known = self.fits.get(left << 20 | right)
        if known is None:
            a, b = self._edge(left, True), self._edge(right, False)
            i = j = 0
            known = True
            while True:
                joined = self.ranks.get(a[i][0] + b[j][0])
                if joined is not None and joined < a[i][1] and joined <= b[j][1]:
                    known = False
                    break
                last_a, last_b = i + 1 == len(a), j + 1 == len(b)
                if last_a and last_b:
                    break
                if last_b or not last_a and self.ranks[a[i][0]] >= self.ranks[b[j][0]]:
                    i += 1  # the later merge is undone first
                else:
                    j += 1
            if len(self.fits) > 4 * self.limit:
                self.fits.clear()
            self.fits[left << 20 | right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        alive = []
        children, tokens, fits, committed = self.children, self.token, self.fits, True
        for pending, last, node in self.states[state]:
            child = children[node].get(byte)
            if child is None:
                continue
            if children[child]:
                alive.append((pending, last, child))
                committed = committed and bool(pending)
            token = tokens[child]
            if token >= 0 and self._whole(token):
                if last >= 0:
                    known = fits.get(last << 20 | token)
                    if not (self._fits(last, token) if known is None else known):
                        continue
                alive.append(((*pending, token), token, 0))
        out: tuple[int, ...] = ()
        if committed:  # every alternative has tokens to emit; what they share is certain
            first, *others = (p for p, _, _ in alive)
            shared = min(len(first), *map(len, others)) if others else len(first)
            while any(p[:shared] != first[:shared] for p in others):
                shared -= 1
            out = first[:shared]
        reached = tuple((p[len(out) :], last, node) for p, last, node in alive) if out else tuple(alive)
        target = self.ids.get(reached)
        if target is None:
            target = self.ids[reached] = len(self.states)
            self.states.append(reached)
        hit = self.steps[state << 8 | byte] = target, out
        return hit

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one pre-token."""
        direct = self.ranks.get(data)
        if direct is not None:
            return [direct]
        if len(self.states) > self.limit:
            self._reset()
        out: list[int] = []
        state, known = 0, self.steps.get
        for byte in data:
            hit = known(state << 8 | byte)
            if hit is None:
                hit = self._step(state, byte)
            state, emitted = hit
            if emitted:
                out += emitted
        for pending, _, node in self.states[state]:
            if node == 0:
                out += pending
                break
        return out


class StreamDecoder:
    """Ids to text, a piece at a time; ``errors`` replaces what is no UTF-8."""

    def __init__(self, names: dict[int, bytes]) -> None:
        self.names = names
        self.held = b""
        self.known: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        #: Tokens that are whole characters by themselves.
        self.plain: dict[int, str] = {}
        for i, name in names.items():
            text, rest = self._advance(name)
            if not rest and "�" not in text:
                self.plain[i] = text

    @staticmethod
    def _advance(data: bytes) -> tuple[str, bytes]:
        """The text of the finished characters of ``data`` and its unfinished end."""
        need, start, i = 0, 0, 0
        low, high = 0x80, 0xBF
        out = []
        while i < len(data):
            b = data[i]
            if need == 0:
                if b < 0x80:
                    out.append(chr(b))
                    start = i + 1
                elif 0xC2 <= b <= 0xF4:
                    need, start = (1 if b < 0xE0 else 2 if b < 0xF0 else 3), i
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                else:
                    out.append("�")
                    start = i + 1
                i += 1
            elif low <= b <= high:
                need -= 1
                low, high = 0x80, 0xBF
                i += 1
                if need == 0:
                    out.append(data[start:i].decode())
                    start = i
            else:  # the character breaks off; this byte is looked at again
                out.append("�")
                need, start = 0, i
        return "".join(out), data[start:] if need else b""

    def feed(self, i: int) -> str:
        """The text that token ``i`` completes."""
        hit = self.known.get((self.held, i))
        if hit is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            hit = self.known[self.held, i] = self._advance(self.held + self.names[i])
        self.held = hit[1]
        return hit[0]

    def finish(self) -> str:
        rest, self.held = ("�" if self.held else ""), b""
        return rest

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a whole sequence."""
        parts = list(map(self.plain.get, ids))
        if None in parts:
            parts = [self.feed(i) for i in ids]
            parts.append(self.finish())
        return "".join(parts)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.cache = ChunkCache(self._chunks, limit=600_000)
        self.marks: dict[str, bytes] = {}
        self.decoder = StreamDecoder(self.transducer.names)

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token, which is also a chunk if a space starts it."""
        known, limit = (self.cache.known, self.cache.limit) if part[0] == " " else (self.marks, 100_000)
        ids = known.get(part)
        if ids is None:
            ids = array("I", self.transducer.encode(part.encode())).tobytes()
            if len(known) < limit:
                known[part] = ids
        return ids

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        return [b"".join(map(self._part, self.split(c))) for c in chunks]

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.encode(texts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0], dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.decode(list(ids))


def opened(path: str, pattern: str) -> ByteBpe:
    """The coder of a vocabulary file, made once in each worker."""
    return resident(("byte_bpe", path, pattern), lambda: ByteBpe(load_ranks(path), pattern))


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` with the whole token sequence of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = opened(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in coder.encode_bytes(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = opened(path, pattern)
        for batch in batches:
            for first, ids, bounds in coder.cache.texts(batch.column("text")):
                edges = bounds.tolist()
                own = [ids[a:b] for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(own)),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own], pa.string()),
                        pa.array([hashlib.sha256(coder.decode(x.tolist()).encode()).hexdigest() for x in own], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
