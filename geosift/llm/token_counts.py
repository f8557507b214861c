"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into units at places that no vocabulary piece spans, so merges
never cross them.  Inside a unit the lowest-rank adjacent pair is merged again
and again; the count is the number of initial symbols less the merges, and no
identifiers are made.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from .common import texts

SPACE = "▁"
#: Spaces, then letters or then other characters; no piece of the vocabulary spans two such units.
_LATIN = r"a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u03ff\u0400-\u04ff"
_BY_CLASS = re.compile(f" *[{_LATIN}]+| *[^{_LATIN} ]+| +")
#: Used when some piece joins a letter and another character.
_BY_SPACE = re.compile(r" *[^ ]+| +")
_LETTER = re.compile(f"[{_LATIN}]")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def count_merged(symbols: list[str], rank: dict[str, float]) -> int:
    """Symbols that are left when no adjacent pair has a rank; lowest rank first, ties leftmost."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        if pair in rank:
            heap.append((rank[pair], i, pair))
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or not symbols[i] or symbols[i] + symbols[j] != pair:
            continue  # one side has been merged since
        symbols[i], symbols[j] = pair, ""
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            new = pair + symbols[k]
            if new in rank:
                heapq.heappush(heap, (rank[new], i, new))
        h = before[i]
        if h >= 0:
            new = symbols[h] + pair
            if new in rank:
                heapq.heappush(heap, (rank[new], h, new))
    return left


class UnitCounts(dict):
    """Token counts of units, worked out once and kept up to a bound."""

    def __init__(self, model_path: str, limit: int = 1 << 19) -> None:
        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        self.limit = limit
        mixed = spans_space = False
        for piece in self.rank:
            for a, b in zip(piece, piece[1:]):
                spans_space |= b == SPACE != a
                mixed |= a != SPACE != b and bool(_LETTER.match(a)) != bool(_LETTER.match(b))
        if spans_space:
            raise ValueError("a piece holds a space after another character; texts can't be cut into units")
        self.units = (_BY_SPACE if mixed else _BY_CLASS).findall

    def __missing__(self, unit: str) -> int:
        symbols = list(unit.replace(" ", SPACE))
        # a character without a piece of its own is given as its UTF-8 bytes unless a merge takes it
        n = count_merged(symbols, self.rank)
        n += sum(len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in self.rank)
        if len(self) >= self.limit:
            self.clear()
        if len(unit) <= 64:
            self[unit] = n
        return n

    def of(self, text: str) -> int:
        """Tokens of a whole text; empty text has none."""
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        return sum(map(self.__getitem__, self.units(" " + text)))


@lru_cache(maxsize=2)
def unit_counts(model_path: str) -> UnitCounts:
    return UnitCounts(model_path)


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; null text counts as empty: no tokens.

    Equals the library's counts without begin, end or added special tokens.
    Narrow: no shuffle.  Very long texts are counted whole, unit by unit.
    Repeated rows and rows without a doc_id stay; other columns are not read; an
    empty table gives no rows.
    """
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = unit_counts(path)
        for b in batches:
            rows = b.column(1).to_pylist()
            n = [counts.of(t) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
