"""Benchmark decontamination: an FM-index over each shard of the training texts, searched backwards for test windows."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadprep.llm.shards import ascii_lower_table, joined, slices

WINDOW = 10
#: Words of benchmark text that one broadcast block holds; a larger benchmark is searched in several blocks.
BLOCK_WORDS = 1_000_000
#: Every so many positions of a shard one suffix position is stored.
SAMPLE = 8
#: Text bytes of one shard.
SHARD_BYTES = 4 << 20

_NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = ascii_lower_table(bytes(b for b in _NOT_WORD if not 65 <= b <= 90))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split_words(text: str | None) -> list[bytes]:
    """Words of a text after A-Z are lower-cased: runs of digits, a-z and characters beyond ASCII."""
    return (text or "").encode().translate(_LOWER).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for shift in range(bits - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            packed = np.packbits(np.concatenate([ones, np.zeros(64 - len(ones) % 64, bool)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            self.levels.append((packed, before, int(len(ones) - before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        first = np.zeros_like(at)
        for level, shift in zip(self.levels, range(self.bits - 1, -1, -1)):
            bit = (symbol >> shift & 1).astype(bool)
            a, b = self._ones(level, first), self._ones(level, at)
            first, at = np.where(bit, level[2] + a, first - a), np.where(bit, level[2] + b, at - b)
        return at - first

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(at)
        for level in self.levels:
            bit = (level[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a = self._ones(level, at)
            out, at = out << 1 | bit, np.where(bit, level[2] + a, at - a)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence that ends with 0, where each 0 is a sentinel of its own, smaller than all symbols
    and ordered by position. Groups of suffixes that begin alike are sorted anew by what follows, twice as far each time."""
    n = len(symbols)
    found = np.flatnonzero(symbols)
    narrow = symbols[found].astype(np.uint16) if symbols.max() < 1 << 16 else symbols[found]  # 16 bits sort by radix
    order = np.concatenate([np.flatnonzero(symbols == 0), found[np.argsort(narrow, kind="stable")]])
    ordered = symbols[order]
    fresh = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (ordered[1:] == 0)])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    while True:
        alone = fresh & np.concatenate([fresh[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] << 32 | rank[at + step]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        fresh[slots] = new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        step *= 2


class FMIndex:
    """Backward search over the words of one shard. Symbols are 1 to n_symbols; 0 separates and never matches."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        self.last = WaveletMatrix(symbols[order - 1], max(1, int(n_symbols).bit_length()))
        # a suffix after a separator is always sampled: the walk to the left can't pass a separator
        sampled = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.sample = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of suffixes that begin with each phrase; phrases are right-aligned and padded with 0 on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1]):
            live = live[(lengths[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - k]
            low[live] = self.starts[c] + self.last.rank(c, low[live])
            high[live] = self.starts[c] + self.last.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: walk left to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            c = self.last.symbol(rows[open_])
            rows[open_] = self.starts[c] + self.last.rank(c, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.sample[self.sample_rank[rows]] + steps


def by_name(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def benchmark_windows(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict:
    """Distinct windows of benchmark items as symbol rows, and the items that each belongs to."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(text)]
        for i in range(max(min(len(ids), 1), len(ids) - window + 1)):
            owners[tuple(ids[i : i + window])].add(item)
    phrases = np.zeros((len(owners), window), np.int64)
    for row, ids in zip(phrases, owners):
        row[window - len(ids) :] = ids
    return {"vocabulary": vocabulary, "phrases": phrases, "lengths": np.count_nonzero(phrases, axis=1), "owners": [by_name(x) for x in owners.values()]}


def find_windows(texts: list[str | None], block: dict) -> list[tuple[int, list[int], list[int], list[str]]]:
    """For each text of a shard: number of words, starts and ends of merged runs of hit words, items found."""
    get, parts = block["vocabulary"].get, []
    n_words = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = split_words(text)
        n_words[i] = len(words)
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    symbols = np.concatenate(parts) if parts else np.zeros(1, np.int32)
    bounds = np.concatenate([[0], np.cumsum(n_words + 1)])
    out: list = [(int(n), [], [], []) for n in n_words]
    if not len(block["phrases"]) or not symbols.any():
        return out
    index = FMIndex(symbols, len(block["vocabulary"]))
    low, high = index.search(block["phrases"], block["lengths"])
    counts = high - low
    if not counts.any():
        return out
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    at = index.locate(rows)
    cover = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + block["lengths"][phrase], -1)
    hit = np.concatenate([[0], np.cumsum(cover)[:-1] > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(hit))
    begin, end = edges[0::2], edges[1::2]
    text_of = np.searchsorted(bounds, begin, "right") - 1
    for t, b, e in zip(text_of.tolist(), (begin - bounds[text_of]).tolist(), (end - bounds[text_of]).tolist()):
        out[t][1].append(b)
        out[t][2].append(e)
    pairs = np.unique((np.searchsorted(bounds, at, "right") - 1) * len(counts) + phrase)
    items = defaultdict(set)
    for t, p in zip((pairs // len(counts)).tolist(), (pairs % len(counts)).tolist()):
        items[t].update(block["owners"][p])
    for t, found in items.items():
        out[t][3].extend(by_name(found))
    return out


def merge_spans(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The union of word runs, as sorted runs that don't overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [x[0] for x in out], [x[1] for x in out]


def excise(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without these runs of words and what stands between their words."""
    if not starts:
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join(out) + text[at:]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, remove: bool = False) -> DataFrame:
    """Occurrences of benchmark windows in every whole text, found in an FM-index for each shard of texts.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is `window`
    consecutive words of an item of `benchmark` (item_id, text), or the whole item if it has fewer words. Adds columns
    to `docs`: _n_words, _hit_starts and _hit_ends (merged runs of word numbers, end exclusive), _items (sorted ids as
    strings; a null at the end stands for all items without an id, whose windows are hits like others); input columns of these names are replaced. With `remove`, text_col loses the merged runs. Null texts and
    null items have no words; a benchmark without words hits nothing; repeated rows stay rows. The benchmark is
    broadcast in blocks of about `block_words` words (one item is never cut), each block a map over the texts: no
    shuffle of texts, memory bounded by a shard (SHARD_BYTES or one longer text) and a block.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in ("_n_words", "_hit_starts", "_hit_ends", "_items")]
    size = F.coalesce(F.length("text"), F.lit(0))
    n_blocks = 1 + int((benchmark.agg(F.sum(size)).first()[0] or 0) // (6 * block_words))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    none = F.array().cast("array<long>")
    out = docs.select(*columns, F.lit(0).cast("long").alias("_n_words"), none.alias("_hit_starts"), none.alias("_hit_ends"), F.array().cast("array<string>").alias("_items"))
    schema = out.schema
    for k in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()  # bounded by block_words
        block = spark.sparkContext.broadcast(benchmark_windows([(r[0], r[1]) for r in rows], window))

        def run(batches, block=block, last=k == n_blocks - 1):
            for part in slices(batches, text_col, SHARD_BYTES):
                texts = part.column(text_col).to_pylist()
                found = find_windows(texts, block.value)
                if n_blocks > 1:
                    before = zip(*(part.column(c).to_pylist() for c in ("_hit_starts", "_hit_ends", "_items")))
                    found = [(n, *merge_spans(a + s, b + e), by_name({*i, *x})) for (n, s, e, i), (a, b, x) in zip(found, before)]
                arrays = {c: part.column(c) for c in columns}
                if remove and last:
                    arrays[text_col] = pa.array([t if t is None else excise(t, f[1], f[2]) for t, f in zip(texts, found)], part.schema.field(text_col).type)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
                new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*arrays.values(), *new], names=[*columns, "_n_words", "_hit_starts", "_hit_ends", "_items"])

        out = out.mapInArrow(run, schema)
    return out


def remove_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with text_col as find_contamination leaves it; rows, order of columns and other values stay, whatever the
    columns are called."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = find_contamination(docs.toDF(*names), benchmark, names[docs.columns.index(text_col)], window, remove=True)
    return found.select(*names).toDF(*docs.columns)


def hit_words() -> Column:
    return F.aggregate(F.zip_with("_hit_starts", "_hit_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of `docs` (see find_contamination)."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark).drop("text")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_hit_starts") > 0).alias("contaminated"),
    )
