"""Benchmark decontamination: passages of benchmark items found in documents within an edit budget.

Texts are reduced to lower-case letters and digits with single spaces. An item of m
characters may occur with up to k edits. Such an occurrence keeps at least
m - q + 1 - qk of the item's q-grams (the q-gram lemma), all on k + 1 neighbouring
diagonals, so it lies whole in one of the overlapping bands of 2(k + 1) diagonals. Bands
with fewer shared q-grams are left out unseen; the others are verified by alignment
within the band. An item too short for a q-gram is found where it is a whole document.
Documents are only read, never shuffled; items go to the executors in blocks of bounded
size, one pass over the documents for each block.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.shingles import mix
from shelfmark.scratch import cut

Q = 10
EDIT_RATE = 0.08
#: Characters of items that go to the executors at once; larger benchmarks take several passes.
BLOCK_CHARS = 4_000_000
#: Normalised characters of documents searched at once.
CHUNK_CHARS = 500_000
#: Rows of documents that are kept or left out at once.
SLICE_ROWS = 1000
#: Pairs of a text's q-gram and an item's equal one that are held at once.
MOST_PAIRS = 250_000

SCHEMA = "doc_id long, item_id long, start long, end long, edits int"
_SPACE, _STOP = np.uint32(32), np.uint32(1)
_K = np.uint64(0x9E3779B97F4A7C15)
_COST = np.int64(1 << 32)


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point -> its lower case if it is a letter or digit, else a space."""
    out = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their places in the text) of the folded text with single inner spaces."""
    codes = _fold()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = codes != _SPACE
    keep[1:] |= codes[:-1] != _SPACE
    at = np.flatnonzero(keep)
    if len(at) and codes[at[-1]] == _SPACE:
        at = at[:-1]
    if len(at) and codes[at[0]] == _SPACE:
        at = at[1:]
    return codes[at], at


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on, by doubling: two halves make one of twice the length."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        part, power, k = mix(codes.astype(np.uint64)), _K, 1
        whole, done = None, 0
        while True:
            if q & k:
                if whole is None:
                    whole, done = part, k
                else:
                    n = len(codes) - done - k + 1
                    whole = whole[:n] * power + part[done : done + n]
                    done += k
            if 2 * k > q:
                return whole
            n = len(codes) - 2 * k + 1
            part, power, k = part[:n] * power + part[k : k + n], power * power, 2 * k


def edit_budget(m: int, q: int, rate: float) -> int:
    """Edits allowed in an item of m characters: the rate, as far as the lemma still asks for a shared q-gram; -1 if m < q."""
    return min(int(rate * m), (m - q) // q) if m >= q else -1


class Index:
    """The q-grams of a block of items, and their places."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float):
        self.q = q
        texts = [(i, normalise(t)[0]) for i, t in items]
        self.items = [(i, c, edit_budget(len(c), q, rate)) for i, c in texts if len(c) >= q]
        self.short: dict[bytes, list[int | None]] = {}
        for i, c in texts:
            if 0 < len(c) < q:
                self.short.setdefault(c.tobytes(), []).append(i)
        grams = [qgrams(c, q) for _, c, _ in self.items]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.place = (np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64))[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> np.uint64(42)] = True
        self.k = np.array([k for *_, k in self.items], np.int64)
        self.m = np.array([len(c) for _, c, _ in self.items], np.int64)
        self.need = self.m - q + 1 - q * self.k

    def regions(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) of each band of diagonals that shares enough q-grams with its item."""
        empty = np.empty(0, np.int64)
        grams = qgrams(text, self.q)
        at = np.flatnonzero(self.bits[grams >> np.uint64(42)])
        if not len(at) or not len(self.keys):
            return empty, empty
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        hit = self.keys[key] == grams[at]
        at, key = at[hit], key[hit]
        n = self.count[key]
        ends = np.cumsum(n)
        parts, counts = [], []
        first = 0
        while first < len(at):  # a q-gram that an item repeats meets every place of it: a bounded number of pairs at a time
            base = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + MOST_PAIRS, "right")))
            part, count = np.unique(self._bands(at[first:last], key[first:last], n[first:last]), return_counts=True)
            parts.append(part)
            counts.append(count)
            first = last
        code, which = np.unique(np.concatenate(parts), return_inverse=True) if parts else (empty, empty)
        shared = np.bincount(which, np.concatenate(counts), len(code)) if parts else empty
        item, band = code >> 40, code & ((1 << 40) - 1)
        enough = shared >= self.need[item]
        return item[enough], band[enough]

    def _bands(self, at: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The two bands, numbered with their item, of each pair of a place in the text and an equal q-gram of an item."""
        entry = np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.owner[entry]
        diagonal = np.repeat(at, n) - self.place[entry] + int(self.m.max())  # never negative
        band = diagonal // (self.k[item] + 1)
        return np.concatenate([item * (1 << 40) + band, item * (1 << 40) + np.maximum(band - 1, 0)])

    def verify(self, text: np.ndarray, item: int, bands: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, edits) in ``text`` of the best alignment of each band within the budget."""
        pattern, k = self.items[item][1], int(self.k[item])
        m, width = len(pattern), 4 * (k + 1)
        low = bands * (k + 1) - int(self.m.max()) - (k + 1)  # the band, with k + 1 diagonals more on each side
        column = np.arange(width, dtype=np.int64)
        cells = low[:, None] + column  # row 0: text position before which a match would start
        padded = np.concatenate([text, np.full(1, _STOP, np.uint32)])
        inside = (cells >= 0) & (cells <= len(text))
        far = _COST * (m + width + 1)
        start = np.where(inside, cells, 0)
        state = np.where(inside, start, far)  # cost * _COST + start
        for i in range(m):
            place = cells + i
            there = (place >= 0) & (place < len(text))
            same = there & (padded[np.where(there, place, len(text))] == pattern[i])
            diagonal = state + np.where(same, 0, _COST)
            up = np.full_like(state, far)
            up[:, :-1] = state[:, 1:] + _COST  # the item's character has no counterpart
            best = np.minimum(np.where(there, diagonal, far), up)
            state = np.minimum.accumulate(best - column * _COST, axis=1) + column * _COST  # characters only in the text
        found = []
        for row in range(len(bands)):
            at = int(np.argmin(state[row]))
            edits, begin = divmod(int(state[row, at]), int(_COST))
            if edits <= k:
                found.append((begin, int(min(low[row] + at + m, len(text))), edits))
        return found


def _disjoint(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping matches of one item, the one with fewest edits, then the first."""
    out: list[tuple[int, int, int]] = []
    for s, e, d in sorted(set(found), key=lambda x: (x[2], x[0], x[1])):
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, d))
    return sorted(out)


def search(index: Index, docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, item_id, start, end, edits) of the items' passages in the documents."""
    out: list[tuple] = []

    def flush(chunk: list[tuple]) -> None:
        bounds = np.cumsum([0, *(len(c) + 1 for _, c, _ in chunk)])
        text = np.concatenate([x for _, c, _ in chunk for x in (c, np.full(1, _STOP, np.uint32))])
        items, bands = index.regions(text)
        where = bands * (index.k[items] + 1) - int(index.m.max()) + index.k[items] + 1 if len(items) else items
        # a region's document: the one that holds its middle
        doc = np.clip(np.searchsorted(bounds, where + index.m[items] // 2, "right") - 1, 0, len(chunk) - 1) if len(items) else items
        for d, i in sorted(set(zip(doc.tolist(), items.tolist()))):
            mine = (doc == d) & (items == i)
            name, codes, at = chunk[d]
            shift = int(bounds[d])
            k = int(index.k[i])
            found = index.verify(codes, i, _shifted(bands[mine], shift, k, int(index.m.max())))
            for s, e, edits in _disjoint(found):
                if e > s:
                    out.append((name, index.items[i][0], int(at[s]), int(at[e - 1]) + 1, edits))

    chunk, size = [], 0
    for name, text in docs:
        codes, at = normalise(text)
        if len(codes) < index.q:
            if len(codes) and (same := index.short.get(codes.tobytes())):
                out += [(name, i, int(at[0]), int(at[-1]) + 1, 0) for i in same]
            continue
        chunk.append((name, codes, at))
        size += len(codes) + 1
        if size >= CHUNK_CHARS:
            flush(chunk)
            chunk, size = [], 0
    if chunk:
        flush(chunk)
    return out


def _shifted(bands: np.ndarray, shift: int, k: int, offset: int) -> np.ndarray:
    """The bands of a document's own coordinates that together cover bands of the chunk's."""
    first = (bands * (k + 1) - shift - offset + offset) // (k + 1)
    return np.unique(np.concatenate([first, first + 1]))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_CHARS characters (a longer item is a block)."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if row[1]:
            if block and size + len(row[1]) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((row[0], row[1]))
            size += len(row[1])
    if block:
        yield block


def _passes(benchmark: DataFrame, item_col: str, text_col: str, one: Callable[[list[tuple]], DataFrame]) -> list[DataFrame]:
    """``one(block)`` for each block of items; of several, each is a table before the next block is fetched, so the driver holds one."""
    blocks = _blocks(benchmark, item_col, text_col)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return [one(first)] if first else []
    return [cut(one(block), "pass") for block in chain((first, second), blocks)]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    rate: float = EDIT_RATE,
) -> DataFrame:
    """doc_id, item_id, start, end, edits of every passage of a document that holds a whole item within its edit budget.

    start and end are character positions in the document's own text; edits is the edit
    distance between the folded passage and item, at most ``edit_budget``. Overlapping
    matches of one item count once, the closest. An item shorter than q folded characters
    is found where it is all that a document says, as a string that short occurs by chance
    elsewhere; null and empty texts match nothing. Repeated rows of either table give
    repeated rows; a null id is returned as null. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one(block: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block, q, rate)
            for batch in batches:
                rows = search(index, zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "start", "end", "edits"])

        return source.mapInArrow(run, SCHEMA)

    found = _passes(benchmark, item_col, item_text_col, one)
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    rate: float = EDIT_RATE,
) -> DataFrame:
    """The rows of ``docs`` in whose own text no passage was found, as ``find_passages`` finds them.

    Each row is judged alone, so null and repeated ids make no difference, and columns may
    have any names. No shuffle: each block of items is one pass that leaves out the rows
    it finds, and of several blocks each reads what the one before left.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    # a text that is a column as it stands is read from the row, so that a batch holds it once
    at = docs.columns.index(text_col) if dict(docs.dtypes).get(text_col) == "string" else None
    left = docs.select(row) if at is not None else docs.select(row, F.col(text_col).cast("string").alias("text"))
    schema = left.schema
    for number, block in enumerate(_blocks(benchmark, item_col, item_text_col)):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block, q, rate)
            for batch in batches:
                for part in (batch.slice(k, SLICE_ROWS) for k in range(0, batch.num_rows, SLICE_ROWS)):
                    texts = part.column(1) if at is None else part.column(0).field(at)
                    hit = {row for row, *_ in search(index, enumerate(t.as_py() for t in texts))}
                    yield part.filter(pa.array([k not in hit for k in range(part.num_rows)], pa.bool_()))

        left = (cut(left, "pass") if number else left).mapInArrow(run, schema)
    return left.select("row.*")
