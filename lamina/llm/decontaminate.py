"""Benchmark decontamination: pigeonhole pieces find places, Myers' bit-parallel distance verifies them from piece to whole item."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lean, text_slices, written

WORD = re.compile(r"\w+")
#: Edits allowed for each character of an item.
ERROR_RATE = 0.10
#: Characters of items matched in one pass over the documents; more items take more passes.
BLOCK_CHARS = 1 << 20


def normal(text: str | None) -> str:
    """Words in lower case with one space between them."""
    return " ".join(WORD.findall((text or "").lower()))


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    """Edits allowed in an item of this length: the whole share, rounded down, fewer than would leave a piece empty."""
    return max(0, min(int(error_rate * length), length - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) that cover the item; an occurrence within k edits leaves one of them whole."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(pattern: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Smallest edit distance of pattern to any substring of text, and the first end of one: (distance, end)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (~(xv | up) & full)
        minus = up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _within(pattern: str, masks: dict[str, int], text: str, k: int) -> bool:
    """Whether myers() would find the pattern with at most k edits; ends as soon as that is known."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    spare = k - m + len(text)  # steps left in which the score may stay
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        if down & top:
            score -= 1
            if score <= k:
                return True
        else:
            rise = 1 if up & top else 0
            score += rise
            spare -= 1 + rise
            if spare < 0:
                return False
        up, down = up << 1 & full, down << 1 & full
        plus = down | (~(xv | up) & full)
        minus = up & xv
    return score <= k


@lru_cache(1 << 13)
def _node_masks(part: str) -> dict[str, int]:
    return _masks(part)


@lru_cache(1 << 13)
def _shares(part: str, count: int) -> tuple[str, ...]:
    """part cut into count pieces; count - 1 edits leave one of them whole."""
    return tuple(part[len(part) * i // count : len(part) * (i + 1) // count] for i in range(count))


def _path(leaf: int, count: int) -> list[tuple[int, int]]:
    """Ranges of pieces around a leaf, smallest first and without the whole, in a tree that halves count pieces."""
    lo, hi, out = 0, count, []
    while hi - lo > 1:
        if hi - lo < count:
            out.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if leaf < mid else (mid, hi)
    return out[::-1]


def _automaton(items: list[tuple[int, str, int]]):
    import ahocorasick

    places: dict[str, list[tuple[int, int, int]]] = {}
    for n, (_, text, k) in enumerate(items):
        for leaf, (offset, piece) in enumerate(pieces(text, k)):
            places.setdefault(piece, []).append((n, offset, leaf))
    found = ahocorasick.Automaton()
    for piece, where in places.items():
        found.add_word(piece, (len(piece), where))
    found.make_automaton()
    return found


class _Finder:
    """Occurrences of a block of items in one text after another."""

    def __init__(self, block: list[tuple[int, str, int]]):
        self.block, self.automaton = block, _automaton(block)
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def __call__(self, text: str) -> Iterator[tuple]:
        """(item id, distance, start, stop) of each item found, at its closest occurrence."""
        text = normal(text)
        seen: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset, leaf in where:
                begin = end + 1 - size - offset
                if begin in seen.get(n, ()):
                    continue
                if self._grows(n, leaf, begin, text) if self.block[n][2] else _whole_words(text, begin, end + 1):
                    seen.setdefault(n, set()).add(begin)
        for n, begins in seen.items():
            name, item, k = self.block[n]
            if n not in self.masks:
                self.masks[n] = (_masks(item), _masks(item[::-1]))
            forth, back = self.masks[n]
            best = None
            for a, b in _windows(sorted(begins), len(item), k, len(text)):
                distance, stop = myers(item, forth, text[a:b])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, a + stop)
            if best:
                distance, stop = best
                yield name, distance, stop - _reach(item[::-1], back, text[max(0, stop - len(item) - k) : stop][::-1], distance), stop

    def _grows(self, n: int, leaf: int, begin: int, text: str) -> bool:
        """Whether each range of pieces around a found one also occurs there, with fewer edits than it has pieces.

        Lossless: k edits leave, in one half of any range of j pieces with fewer than j edits, fewer edits than that half
        has pieces, so an occurrence of the item has a piece for which this holds at every level.
        """
        _, item, k = self.block[n]
        count, size, found = k + 1, len(item), True
        for lo, hi in _path(leaf, count):
            a, b, edits = size * lo // count, size * hi // count, hi - lo - 1
            part = item[a:b]
            near = text[max(0, begin + a - edits) : max(0, begin + b + edits)]
            if part in near:
                continue
            if found:  # a first test without arithmetic: the piece is whole, so the edits are in the rest of the range
                start, stop, found = size * leaf // count, size * (leaf + 1) // count, False
                if not any(x in near for x in _shares(item[stop:b] if start == a else item[a:start], edits + 1)):
                    return False
            if not _within(part, _node_masks(part), near, edits):
                return False
        return True


def _whole_words(text: str, start: int, stop: int) -> bool:
    return (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " ")


def _item_blocks(items: DataFrame, item_id: str, item_text: str, error_rate: float) -> Iterator[tuple[list[tuple[int, str, int]], bool]]:
    """Blocks of items and whether each is the last; the driver holds two blocks at most."""
    block, size, ready = [], 0, None
    for name, text in items.select(item_id, item_text).where(F.col(item_id).isNotNull()).toLocalIterator():
        if own := normal(text):
            if size >= BLOCK_CHARS:
                if ready:
                    yield ready, False
                ready, block, size = block, [], 0
            block.append((name, own, budget(len(own), error_rate)))
            size += len(own)
    if ready:
        yield ready, False
    if block:
        yield block, True


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """Benchmark items inside whole document texts, within each item's edit budget.

    Returns one row for each document row and item found: (id_col, item_id, distance int, start int, stop int), with
    the closest occurrence (ties: the first) as code points of the normalised text (words in lower case, single
    spaces). Null and empty texts or items, and items with a null id, match nothing; an item repeated under another id is reported under each;
    repeated document rows each get their rows. An item too short for an edit is found as whole words only. Only the named columns are read.

    Documents are never shuffled. Items pass through the driver in blocks of BLOCK_CHARS characters, each of which is sent with the tasks
    of one pass over the documents; with more than one block each pass is written before the next begins. So memory of
    driver and workers holds a block or two, while the number of passes is that of the blocks: benchmarks are small beside the corpus.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_id}` {item_type}, distance int, start int, stop int"

    def matcher(block: list[tuple[int, str, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _Finder(block)
            for batch in batches:
                for rows, texts in text_slices(batch, 1):
                    out = [(at, *hit) for at, text in enumerate(texts.to_pylist()) for hit in finder(text)]
                    if out:
                        cols = list(zip(*out))
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_arrow), *(pa.array(c, pa.int32()) for c in cols[2:])], [id_col, item_id, "distance", "start", "stop"])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(items.schema[item_id].dataType)
    rows = docs.select(id_col, text_col)
    parts = []
    for block, last in _item_blocks(items, item_id, item_text, error_rate):
        part = rows.mapInArrow(lean(matcher(block)), schema)
        parts.append(part if last else written(part, "items"))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _windows(begins: list[int], length: int, k: int, limit: int) -> list[tuple[int, int]]:
    """Stretches of text that hold every occurrence begun within k of a place, overlapping ones joined."""
    out: list[list[int]] = []
    for b in begins:
        a, z = max(0, b - k), min(limit, b + length + k)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _reach(pattern: str, masks: dict[str, int], text: str, distance: int) -> int:
    """Length of the shortest prefix of text at this edit distance from pattern."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus = down | (~(xv | up) & full)
        minus = up & xv
        if score <= distance:
            return j + 1
    return len(text)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs, with all columns, in whose text find_items() would find nothing; nothing is shuffled.

    Null and empty texts hold nothing and stay, as do repeated rows and rows with a null id; columns may have any name. Blocks of
    items pass as in find_items(): what a pass keeps is written before the next one.
    """
    at, columns, schema = docs.columns.index(text_col), docs.columns, docs.schema

    def matcher(block: list[tuple[int, str, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _Finder(block)
            for batch in batches:
                for rows, texts in text_slices(batch, at):
                    yield rows.filter(pa.array([next(finder(t), None) is None for t in texts.to_pylist()], pa.bool_())).rename_columns(columns)

        return run

    for block, last in _item_blocks(items, item_id, item_text, error_rate):
        docs = docs.mapInArrow(lean(matcher(block)), schema)
        docs = docs if last else written(docs, "decontaminated")
    return docs
