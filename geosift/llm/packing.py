"""Sum-of-squares online packing of documents into fixed-length windows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe_codec import CHUNK_CHARS, default_ranks, encode_text
from .common import safe_chunks, texts

#: Characters whose class every Unicode version since 8 gives alike; other texts go through the tokenizers library itself.
_UNUSUAL = re.compile(r"[^\u0000-\u052f\u2000-\u206f\u3000-\u30ff\u4e00-\u9fa5]|<\|endoftext\|>")

#: Windows of one stream that are open at once.
MAX_OPEN = 64


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str, tokenizer_path: str, ranks_path: str | None) -> np.ndarray:
    """Ids as the tokenizers library gives them, without added special tokens.

    With ``ranks_path`` (the same vocabulary as ranks) texts of usual characters
    take the faster library, whose ids are the same for them.
    """
    if ranks_path and not _UNUSUAL.search(text):
        return np.array(encode_text(text, ranks_path), np.uint32)
    tok = _tokenizer(tokenizer_path)
    parts = [tok.encode(c, add_special_tokens=False).ids for c in safe_chunks(text, CHUNK_CHARS)]
    return np.array([i for p in parts for i in p], np.uint32)


class SumOfSquares:
    """Open windows by fill level.

    ``levels[h]`` counts the windows filled to ``h``.  An item of size ``s`` goes
    to the level ``h`` (0: a new window) that leaves the sum of the squared
    counts smallest; ties go to the fullest level.  Full windows are closed.
    ``placed`` counts the ids that the rule has placed for good.
    """

    def __init__(self, capacity: int, max_open: int) -> None:
        self.capacity, self.max_open = capacity, max_open
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = self.placed = 0

    def place(self, item: tuple, size: int) -> list[tuple] | None:
        """Put the item in a window; the window's items if that filled it."""
        cap, n = self.capacity, self.levels
        to = np.append(2 * n[size:cap] + 1, 0)  # what raising the new level costs; a full window costs nothing
        start = n[: cap - size + 1]
        cost = np.where(start > 0, to - 2 * start + 1, np.iinfo(np.int64).max)
        if self.n_open < self.max_open:
            cost[0] = to[0]
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        window = self._take(h) if h else []
        window.append(item)
        self.placed += size
        if h + size == cap:
            return window
        n[h + size] += 1
        self.n_open += 1
        self.open.setdefault(h + size, []).append(window)
        return None

    def _take(self, h: int) -> list[tuple]:
        self.levels[h] -= 1
        self.n_open -= 1
        return self.open[h].pop()

    def gap(self) -> int:
        """What the fullest window lacks; nothing while another may be opened."""
        return 0 if self.n_open < self.max_open else self.capacity - int(np.flatnonzero(self.levels)[-1])

    def fullest(self) -> list[tuple]:
        return self._take(self.capacity - self.gap())

    def drain(self) -> Iterator[tuple]:
        """All items of the open windows, fullest first; none stays open."""
        for h in sorted(self.open, reverse=True):
            for window in self.open[h]:
                self.placed -= h
                yield from window
        self.open, self.n_open = {}, 0
        self.levels[:] = 0


def _split(item: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = item
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def pack_items(items: Iterator[tuple], capacity: int = 1024, max_open: int = MAX_OPEN, packer: SumOfSquares | None = None) -> Iterator[list[tuple]]:
    """Windows, each a list of (doc, start, ids, doc_tokens), from items of the same form.

    Whole windows are cut off long items; what is left of each goes through the
    sum-of-squares rule.  At ``max_open`` windows the head of an item that is too
    long for the fullest one fills its gap, and the rule places the rest.  At the
    end the items of the open windows are refilled end to end, cut where a window
    fills; the very last ids go to windows of power-of-two lengths, so that no
    window needs padding.
    """
    packer = packer or SumOfSquares(capacity, max_open)
    for item in items:
        while len(item[2]) >= capacity:
            head, item = _split(item, capacity)
            yield [head]
        if len(item[2]) > (gap := packer.gap()) > 0:
            window = packer.fullest()
            head, item = _split(item, gap)
            yield [*window, head]
        if len(item[2]) and (filled := packer.place(item, len(item[2]))):
            yield filled

    window, room = [], capacity
    for item in packer.drain():
        while len(item[2]) >= room:
            head, item = _split(item, room)
            yield [*window, head]
            window, room = [], capacity
        if len(item[2]):
            window.append(item)
            room -= len(item[2])
    left = capacity - room
    for bit in range(left.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            part, need = [], 1 << bit
            while need:
                head, rest = _split(window[0], min(need, len(window[0][2])))
                part.append(head)
                need -= len(head[2])
                window[:1] = [rest] if len(rest[2]) else []
            yield part


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 0,
    max_open: int = MAX_OPEN,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pack documents into windows of at most ``capacity`` ids; one row per piece.

    Every row of ``docs`` is one document: its ids, then ``end_id``; a null or
    empty text is ``end_id`` alone.  Each partition packs its own stream, so
    nothing is shuffled, the open windows are bounded by ``max_open`` and a lost
    task repeats alone.  sequence_id is unique over all partitions.  A null id
    column stays null; repeated rows are packed apiece; very long texts are
    encoded in chunks and packed whole; other columns are not read; an empty
    table gives no rows.  ``with_ids`` adds the piece's ids.
    """
    tok, ranks = tokenizer_path or default_tokenizer(), ranks_path
    if ranks is None and tokenizer_path is None:
        ranks = default_ranks()
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40

        def items() -> Iterator[tuple]:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.append(token_ids(text, tok, ranks), np.uint32(end_id))
                    yield doc, 0, ids, len(ids)

        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for number, window in enumerate(pack_items(items(), capacity, max_open)):
            offset = 0
            for doc, start, ids, total in window:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((doc, start, len(ids), crc, total, first + number, offset, *([ids.tolist()] if with_ids else [])))
                offset += len(ids)
            if len(rows) >= 4096:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return texts(docs).mapInArrow(run, schema)
