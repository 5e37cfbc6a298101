"""Hierarchical multi-length packing.

Documents become token ids plus an end id. Whole windows of the longest context size
stand alone; what is left of a document is routed to the shortest tier that holds it.
Each tier is packed best-fit decreasing, gaps of longer windows are filled from shorter
tiers (cutting a piece where needed), and windows that stay open are cut into sequences
of power-of-two lengths, which need no padding. Sequences are then dealt into step
groups of equal count and near-equal attention cost.

The whole operator is one narrow pass: no shuffle, and memory is bounded by
``block_tokens`` plus the longest single document. A lost executor's partition is packed
anew with the same result, as nothing depends on anything but the partition's rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import doc_texts

#: Context sizes, powers of two, shortest first.
TIERS = (256, 512, 1024, 2048)
#: Characters on which both tokenizer libraries' regex classes certainly agree.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens long, step_group long"


class Encoder:
    """Ids as the tokenizers library gives them by default, with added tokens found in
    texts.

    ``ranks`` may name the same vocabulary as ranks: texts of plain characters without an
    added token's string then go through the faster library, which yields the same ids
    for them; others don't.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def best_fit(pieces: list[tuple], size: int) -> list[list[tuple]]:
    """Best-fit decreasing: windows of at most size, each a list of (length, doc, start)."""
    windows: list[list[tuple]] = []
    free: list[tuple[int, int]] = []  # sorted (space left, window)
    for piece in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        k = bisect_left(free, (piece[0], -1))
        if k < len(free):
            space, w = free.pop(k)
        else:
            space, w = size, len(windows)
            windows.append([])
        windows[w].append(piece)
        if space > piece[0]:
            insort(free, (space - piece[0], w))
    return windows


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple]]]:
    """(tier, [(length, doc, start), ...]) for each sequence; every id in exactly one."""
    top, out = tiers[-1], []
    pools: dict[int, list[tuple]] = {t: [] for t in tiers}

    def route(length: int, doc: int, start: int) -> None:
        insort(pools[next(t for t in tiers if t >= length)], (length, doc, start))

    for doc, n in enumerate(lengths):
        out.extend((top, [(top, doc, at)]) for at in range(0, n - n % top, top))
        if n % top:
            route(n % top, doc, n - n % top)
    for k in range(len(tiers) - 1, -1, -1):
        size, shorter = tiers[k], tiers[:k][::-1]
        pieces, pools[size] = pools[size], []
        for window in best_fit(pieces, size):
            gap = size - sum(p[0] for p in window)
            while gap:
                for t in shorter:
                    at = bisect_left(pools[t], (gap + 1,))
                    if at:
                        window.append(pools[t].pop(at - 1))
                        break
                else:
                    t = next((t for t in shorter if pools[t]), 0)
                    if not t:
                        break
                    length, doc, start = pools[t].pop()
                    window.append((gap, doc, start))
                    route(length - gap, doc, start + gap)
                gap = size - sum(p[0] for p in window)
            out.extend([(size, window)] if not gap else powers(window, tiers))
    return out


def powers(window: list[tuple], tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """An open window as sequences of power-of-two lengths, longest first."""
    pieces, left = list(window)[::-1], sum(p[0] for p in window)
    while left:
        size = 1 << (left.bit_length() - 1)
        left, part = left - size, []
        need = size
        while need:
            length, doc, start = pieces.pop()
            if length > need:
                pieces.append((length - need, doc, start + need))
                length = need
            part.append((length, doc, start))
            need -= length
        yield next(t for t in tiers if t >= size), part


def step_groups(sequences: list[tuple[int, list[tuple]]], size: int) -> list[int]:
    """A group for each sequence: of one tier, of size sequences at most, cost balanced."""
    groups, base = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}):
        mine = [(sum(p[0] ** 2 for p in part), k) for k, (t, part) in enumerate(sequences) if t == tier]
        n = -(-len(mine) // size)
        heap = [(0, g, 0) for g in range(n)]
        for cost, k in sorted(mine, key=lambda x: (-x[0], x[1])):
            total, g, count = heapq.heappop(heap)
            groups[k] = base + g
            if count + 1 < size:
                heapq.heappush(heap, (total + cost, g, count + 1))
        base += n
    return groups


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, eos: int = 1, tiers: tuple[int, ...] = TIERS, group_size: int = 32, block_tokens: int = 2_000_000, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document; with_ids adds the piece's ids.

    A null text is empty, an empty text is the end id alone, repeated rows are packed
    each for itself, a null doc_id stays null, and an empty table gives no rows.
    Sequence and group ids are unique over all partitions, not gapless.
    """
    schema = COLUMNS + (", ids array<long>" if with_ids else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks, pattern)
        base = TaskContext.get().partitionId() << 33
        seen = [0, 0]

        def flush(block: list[tuple]) -> pa.RecordBatch:
            sequences = plan([len(ids) for _, ids in block], tiers)
            groups = step_groups(sequences, group_size)
            rows = []
            for k, (tier, part) in enumerate(sequences):
                offset, total = 0, sum(p[0] for p in part)
                for length, doc, start in part:
                    doc_id, ids = block[doc]
                    own = ids[start : start + length]
                    row = (doc_id, start, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids), base + seen[0] + k, offset, tier, total, base + seen[1] + groups[k])
                    rows.append((*row, own.tolist()) if with_ids else row)
                    offset += length
            seen[0] += len(sequences)
            seen[1] += max(groups, default=-1) + 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (10 + with_ids)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        block, tokens = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(eos))
                block.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush(block)
                    block, tokens = [], 0
        if block:
            yield flush(block)

    return doc_texts(docs).mapInArrow(pack, schema)
