"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from a passage of a document in ``rate`` x n edits (rounded down). It is cut into one
piece more than that, so a passage within the budget holds at least one piece unchanged. All pieces are searched for in
the whole text at once (Aho-Corasick); each hit gives the place where the item would lie, places that are close
together make one stretch, and the stretch is verified with Myers' bit-parallel edit distance (any start, any end).
The best passages are taken first, and what lies between the passages taken is verified again until nothing within the
budget is left: a stretch gives a row for each of its passages, which don't overlap. A-Z are lower-cased on both sides.

Items go to the tasks in blocks of at most about ``block_chars`` characters, drawn by a hash of their text, so
what is broadcast is bounded however many items there are. Null and empty texts and items match nothing. An item of
fewer characters than 1 / ``rate`` must occur unchanged. Repeated rows are matched each; items with one
text give a match each. An empty table gives no matches.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import columns_of

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """The least edit distance of ``pattern`` to the parts of ``text`` that end at each place. ``anchored``: parts that
    begin where the text does."""
    m, masks = len(pattern), _masks(pattern)
    full, high, enter = (1 << m) - 1, 1 << (m - 1), int(anchored)
    plus, minus, score = full, 0, m
    out = [m]
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        out.append(score)
        ph = (ph << 1) | enter
        mh <<= 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
    return out


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a part of ``text``, end of the first such part)."""
    out = distances(pattern, text, anchored)
    best = min(out)
    return best, out.index(best)


@dataclass
class Items:
    """Pieces of some items, and the search for them."""

    items: list[tuple]  # (id, lower-cased text)
    rate: float
    search: object = field(default=None)

    def __getstate__(self):
        return self.items, self.rate

    def __setstate__(self, state):
        self.items, self.rate = state
        self.search = None

    def budget(self, text: str) -> int:
        return int(len(text) * self.rate)

    def build(self):
        import ahocorasick

        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(self.items):
            n = self.budget(text) + 1
            cut = [len(text) * k // n for k in range(n + 1)]
            for a, b in zip(cut, cut[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((i, a))
        self.search = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.search.add_word(piece, (len(piece), where))
        self.search.make_automaton()

    def matches(self, text: str | None) -> Iterator[tuple]:
        """(item id, start, end, distance) of each passage of ``text`` that is an item within its budget."""
        if not text or not self.items:
            return
        if self.search is None:
            self.build()
        low, places = text.translate(_LOWER), {}
        for last, (size, where) in self.search.iter(low):
            for i, at in where:
                places.setdefault(i, []).append(last + 1 - size - at)
        for i, at in places.items():
            item_id, item = self.items[i]
            k, n = self.budget(item), len(item)
            at.sort()
            first = 0
            for j in range(1, len(at) + 1):
                if j == len(at) or at[j] - at[j - 1] > n:
                    yield from self._verify(item_id, item, k, low, max(at[first] - k, 0), at[j - 1] + n + k)
                    first = j

    def _verify(self, item_id, item: str, k: int, low: str, lo: int, hi: int) -> Iterator[tuple]:
        n, hi = len(item), min(hi, len(low))
        taken, at = [], low.find(item, lo, hi)
        while at >= 0:
            taken.append((at, at + n))
            yield item_id, at, at + n, 0
            at = low.find(item, at + n, hi)
        gaps = _between(taken, lo, hi)
        while gaps:
            a, b = gaps.pop()
            if b - a < n - k:
                continue
            taken = []
            for distance, end in sorted((d, end) for end, d in enumerate(distances(item, low[a:b]), a) if d <= k):
                j = bisect_left(taken, (end,))  # so many passages taken start before the end
                before = taken[j - 1][1] if j else a
                if end - before < n - k:
                    continue
                back = low[max(a, end - n - k):end][::-1]
                start = end - myers(item[::-1], back, anchored=True)[1]
                if before <= start < end:
                    insort(taken, (start, end))
                    yield item_id, start, end, distance
            if taken:
                gaps += _between(taken, a, b)


def _between(taken: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """What sorted ranges leave of lo..hi."""
    return list(zip([lo, *(b for _, b in taken)], [*(a for a, _ in taken), hi], strict=True))


def item_blocks(benchmark: DataFrame, rate: float, block_chars: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    d = columns_of(benchmark, id_col, text_col).toDF("id", "text").where("length(text) > 0")
    total = d.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        rows = d.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()  # block_chars characters on average
        yield Items(sorted(((r[0], r[1].translate(_LOWER)) for r in rows), key=str), rate)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = 4 << 20, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col``, ``item_col``, start, end (characters) and distance of each passage that is an item within its budget."""
    d = columns_of(docs, id_col, text_col).toDF("id", "text")
    spark, id_type, item_type = docs.sparkSession, docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("item", item_type), T.StructField("start", T.LongType()),
                           T.StructField("end", T.LongType()), T.StructField("distance", T.LongType())])
    arrow = to_arrow_schema(schema)
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, rate, block_chars, item_col, item_text):
        items = spark.sparkContext.broadcast(block)

        def run(batches, items=items):
            for batch in batches:
                rows = [(i, *m) for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True) for m in items.value.matches(text.as_py())]
                columns = list(zip(*rows, strict=True)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        out = out.union(d.mapInArrow(run, schema))
    return out.toDF(id_col, item_col, "start", "end", "distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = 4 << 20, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for block in item_blocks(benchmark, rate, block_chars, item_col, item_text):
        items = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, items=items):
            for batch in batches:
                clean = [next(items.value.matches(text.as_py()), None) is None for text in batch.column(batch.schema.get_field_index(text_col))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
