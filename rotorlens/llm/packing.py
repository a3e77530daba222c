"""Hierarchical multi-length packing of token ids.

A document's full windows of the longest context stand alone. What remains is routed to the
shortest context that holds it. Each tier packs its pieces (best fit, longest first); gaps in a
window are filled from the shorter tiers, whole pieces first, then the head of a cut one. So every
window is full. A partition's last ids, too few for its tiers, form windows of powers of two.

Steps: windows of one context are dealt to step groups of `step_tokens` ids each, so every group
but a partition's last of a context has the same number of ids.

Memory: each task keeps at most `POOL` pieces per tier. Partitions pack on their own, so nothing is shuffled.

Defined results: null and empty texts give the end id alone; repeated rows are packed each for
itself; a null id stays null; empty tables give no pieces; other columns aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import blocks
from .tokens import encoder

TIERS = (512, 1024, 2048, 4096)
POOL = 512
STEP_TOKENS = 64 * 4096
END_ID = 2


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    total: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:n], self.total),
                Piece(self.doc, self.start + n, self.ids[n:], self.total))


class Packer:
    """Packs pieces as they come; `add` and `finish` yield full windows (context, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        if not tiers or list(tiers) != sorted(set(tiers)) or any(t & (t - 1) or t < 1 for t in tiers):
            raise ValueError("tiers must be rising powers of two")
        self.tiers, self.limit = tiers, pool
        self.pools: list[list[Piece]] = [[] for _ in tiers]

    def _route(self, p: Piece) -> int:
        t = bisect.bisect_left(self.tiers, len(p.ids))
        self.pools[t].append(p)
        return t

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple[int, list[Piece]]]:
        longest, rest = self.tiers[-1], Piece(doc, 0, ids, len(ids))
        while len(rest.ids) >= longest:
            head, rest = rest.cut(longest)
            yield longest, [head]
        if len(rest.ids):
            t = self._route(rest)
            if len(self.pools[t]) >= self.limit:
                yield from self._pack(t)

    def _fill(self, window: list[Piece], gap: int, t: int) -> int:
        """Fill a gap from the pools of tier t and shorter ones; what is left of the gap."""
        for s in range(t, -1, -1):
            pool = self.pools[s]
            while gap and pool:
                fit = max((i for i in range(len(pool)) if len(pool[i].ids) <= gap),
                          key=lambda i: len(pool[i].ids), default=None)
                if fit is None:
                    break
                p = pool.pop(fit)
                window.append(p)
                gap -= len(p.ids)
        if gap:  # no whole piece fits: the head of the shortest one there is
            rest = [(len(p.ids), s, i) for s in range(t + 1) for i, p in enumerate(self.pools[s])]
            if rest:
                _, s, i = min(rest)
                head, tail = self.pools[s].pop(i).cut(gap)
                window.append(head)
                self._route(tail)
                gap = 0
        return gap

    def _pack(self, t: int) -> Iterator[tuple[int, list[Piece]]]:
        size = self.tiers[t]
        pieces = sorted(self.pools[t], key=lambda p: -len(p.ids))
        self.pools[t] = []
        windows: list[list[Piece]] = []
        gaps: list[tuple[int, int]] = []  # (gap, window), sorted
        for p in pieces:
            n = len(p.ids)
            at = bisect.bisect_left(gaps, (n, -1))
            if at < len(gaps):
                gap, w = gaps.pop(at)
                windows[w].append(p)
            else:
                gap, w = size, len(windows)
                windows.append([p])
            bisect.insort(gaps, (gap - n, w))
        for gap, w in gaps:
            own = len(windows[w])
            # tails of cut pieces go to shorter tiers, so the last windows may find nothing: these wait
            left = self._fill(windows[w], gap, max(t - 1, 0)) if gap else 0
            if left:
                for p in windows[w][own:]:
                    self._route(p)
                self.pools[t].extend(windows[w][:own])
            else:
                yield size, windows[w]
        while len(self.pools[t]) >= self.limit:  # nothing shorter to fill with: cut the tier's own pieces
            window: list[Piece] = []
            if self._fill(window, size, t):
                self.pools[t].extend(window)
                break
            yield size, window

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        for t in range(len(self.tiers) - 1, -1, -1):
            yield from self._pack(t)
        rest = [p for pool in self.pools for p in pool]
        self.pools = [[] for _ in self.tiers]
        left = sum(len(p.ids) for p in rest)
        rest.reverse()
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                p = rest.pop()
                if len(p.ids) > gap:
                    p, tail = p.cut(gap)
                    rest.append(tail)
                window.append(p)
                gap -= len(p.ids)
            left -= size
            yield size, window


NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group")


def _pack_partition(doc_id: str, text: str, path: str, end_id: int | None, tiers, pool: int,
                    step_tokens: int, with_ids: bool):
    def run(batches):
        enc, packer, part = encoder(path), Packer(tiers, pool), TaskContext.get().partitionId()
        n_seq, per_context = 0, {}
        docs: list = []
        rows: list[tuple] = []
        ids_out: list[np.ndarray] = []

        def emit(windows):
            nonlocal n_seq
            for size, window in windows:
                seq = part << 33 | n_seq
                n_seq += 1
                k = per_context[size] = per_context.get(size, -1) + 1
                step = part << 33 | size.bit_length() << 27 | k * size // step_tokens
                at = 0
                for p in window:
                    docs.append(p.doc)
                    rows.append((p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total,
                                 seq, at, size, step))
                    if with_ids:
                        ids_out.append(p.ids)
                    at += len(p.ids)

        def batch(kind):
            cols = [pa.array(docs, kind)] + [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 8)]
            if with_ids:
                cols.append(pa.array([i.tolist() for i in ids_out], pa.list_(pa.int32())))
            out = pa.RecordBatch.from_arrays(cols, names=[doc_id, *NAMES] + ["ids"] * with_ids)
            docs.clear(), rows.clear(), ids_out.clear()
            return out

        kind = None
        for b in batches:
            kind = b.column(doc_id).type
            for rb in blocks(b, text, 1 << 20):
                for d, ids in zip(rb.column(doc_id).to_pylist(), enc.encode(rb.column(text))):
                    emit(packer.add(d, ids if end_id is None else np.append(ids, np.uint32(end_id))))
                if rows:
                    yield batch(kind)
        emit(packer.finish())
        if rows:
            yield batch(kind)
    return run


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID,
         tiers: tuple[int, ...] = TIERS, pool: int = POOL, step_tokens: int = STEP_TOKENS,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: its document, place there, checksum, window (`sequence_id`, `offset`, length
    `context`), step group and, unless `with_ids` is off, its token ids.

    `path` names the tokenizer file, present on every machine."""
    schema = T.StructType([docs.schema[doc_id], *(T.StructField(n, T.LongType()) for n in NAMES)])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(doc_id, text).mapInArrow(
        _pack_partition(doc_id, text, path, end_id, tuple(tiers), pool, step_tokens, with_ids), schema)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame) -> DataFrame:
    """All documents packed; digest columns only."""
    return pack(docs, default_tokenizer(), with_ids=False)
