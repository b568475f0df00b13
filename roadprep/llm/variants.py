"""Spelling variants: words one edit apart, found by rolling hashes of their one-letter deletions."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadprep.llm.scratch import settled
from roadprep.llm.shards import ascii_lower_table, mix, slices

MIN_LENGTH = 5
MIN_COUNT = 3
#: One occurrence in so many loses a letter, by a hash.
TYPO_EVERY = 97
#: A form has at least so many times the word's occurrences.
RATIO = 2
#: Words that a task counts before it hands them on; it bounds memory, not the result.
HELD_WORDS = 200_000
#: Longer words meet by hashes alone and are compared afterwards: a row for each position that carries the word would
#: take the square of its length.
LONG = 64

_LOWER = ascii_lower_table()
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def typed(word: str, doc_id) -> str:
    """The word as it counts in a document: by the hash of both it loses one code point, or none. A null id is an empty one."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % TYPO_EVERY:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all texts; summed within tasks first, so that a frequent word is few rows."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)  # a shorter run gives no word of that length

    def batch(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                found = Counter(runs.findall((text or "").encode().translate(_LOWER).decode()))
                for word, n in found.items():
                    word = typed(word, doc_id)
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    words = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the word, position) of every word's deletions, and of each word itself with position -1.

    A running sum of letters times powers is the prefix hash of every word; what follows the deleted letter is one
    power lower. All words are one array, so that a batch takes a few passes of numpy, whatever their lengths.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(_U)
    n = len(letters)
    power, inverse = np.full(n + 1, _BASE, _U), np.full(n + 1, _INVERSE, _U)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    sums = np.zeros(n + 1, _U)
    np.cumsum(mix(letters + _U(1)) * power[:n], out=sums[1:])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(n)
    first, last = starts[owner], ends[owner]
    shorter = (sums[at] - sums[first]) + (sums[last] - sums[at + 1]) * _U(_INVERSE)
    shorter = mix(shorter * inverse[first] + (last - first - 1).astype(_U))
    whole = mix((sums[ends] - sums[starts]) * inverse[starts] + lengths.astype(_U))
    keys = np.concatenate([whole, shorter]).view(np.int64)
    return keys, np.concatenate([np.arange(len(words)), owner]), np.concatenate([np.full(len(words), -1), at - first])


def _keys(words: DataFrame, schema: str, columns) -> DataFrame:
    """Rows of deletion keys of words (word, n); `columns` makes the other columns from the word numbers."""

    def run(batches):
        for batch in batches:
            for part in slices([batch], "word", 1 << 17):
                if part.num_rows:
                    key, owner, at = deletion_keys(part.column("word").to_pylist())
                    for a in range(0, len(key), 1 << 16):
                        b = slice(a, a + (1 << 16))
                        rest = columns(part, pa.array(owner[b]))
                        yield pa.RecordBatch.from_arrays([pa.array(key[b]), pa.array(at[b].astype(np.int32)), *rest.values()], names=["key", "at", *rest])

    return words.mapInArrow(run, schema)


def _group(rows: list[tuple[int, str, int]]):
    """(word, near words, the best one's n, the best one) for words (at, word, n) under one key, by their strings.

    Under one deleted string the words of a position differ in that letter only, so there are at most as many as letters;
    a word that is the string itself is near to all. The two best words give everyone's best other, so no pair is made.
    """
    by_string = defaultdict(list)
    for at, word, n in rows:
        by_string[word if at < 0 else word[:at] + word[at + 1 :]].append((at, -n, word))
    for found in by_string.values():
        if len(found) == 1:
            continue
        whole = [x for x in found if x[0] < 0]
        longer = {x[1:] for x in found if x[0] >= 0}
        if whole and longer:
            n, word = whole[0][1:]
            best = min(longer)
            yield word, len(longer), -best[0], best[1]
            for _, w in longer:
                yield w, 1, -n, word
        same = defaultdict(list)
        for at, n, word in found:
            if at >= 0:
                same[at].append((n, word))
        for members in same.values():
            if len(members) > 1:
                one, two = sorted(members)[:2]
                for n, word in members:
                    best = two if (n, word) == one else one
                    yield word, len(members) - 1, -best[0], best[1]


def near_summaries(keys: DataFrame) -> DataFrame:
    """word, near, best_n, best for every word and key (key, at, word, n) that has near words.

    Keys are dealt by their leading bits and sorted within their partition (the sort can spill), then streamed: a batch
    waits only with its last key, whose rows are bounded by letters and lengths.
    """

    def run(batches):
        kept = None
        for batch in batches:
            batch = batch if kept is None else pa.concat_batches([kept, batch])
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            kept = batch.slice(int(starts[-1]))
            yield _summary(batch, starts)
        if kept is not None:
            yield _summary(kept, np.array([0, kept.num_rows]))

    def _summary(batch, starts):
        sizes = np.diff(starts)
        rows = batch.slice(0, int(starts[-1])).filter(pa.array(np.repeat(sizes > 1, sizes)))
        rows = list(zip(*(rows.column(c).to_pylist() for c in ("at", "word", "n"))))
        out, a = [], 0
        for size in sizes[sizes > 1].tolist():
            out += _group(rows[a : a + size])
            a += size
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "near", "best_n", "best"])

    radix = F.shiftrightunsigned("key", 48)
    return keys.repartition(radix).sortWithinPartitions("key").mapInArrow(run, "word string, near long, best_n long, best string")


def near_long(words: DataFrame) -> DataFrame:
    """The same for pairs with a word over LONG code points: they meet by keys without strings and are compared once."""
    long = words.filter(F.length("word") >= LONG).withColumn("id", F.sha2("word", 256))
    keys = settled(_keys(long, "key long, at int, id string", lambda part, owner: {"id": part.column("id").take(owner)}))
    one = F.col("a.id") < F.col("b.id")
    same = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.at") == F.col("b.at")) & one).filter("a.at >= 0")
    other = keys.filter("at < 0").alias("a").join(keys.filter("at >= 0").alias("b"), "key")
    pairs = same.select("a.id", F.col("b.id").alias("other")).union(other.select("a.id", F.col("b.id").alias("other"))).distinct()
    pairs = pairs.union(pairs.select("other", "id"))
    both = pairs.join(long, "id").join(long.select(F.col("id").alias("other"), F.col("word").alias("best"), F.col("n").alias("best_n")), "other")
    both = both.filter((F.greatest(F.length("word"), F.length("best")) > LONG) & (F.levenshtein("word", "best", 1) == 1))
    return both.select("word", F.lit(1).cast("long").alias("near"), "best_n", "best")


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """word, root from (word, form): n at least doubles from a word to its form, so chains are short; every round halves them."""
    up = settled(forms.select("word", F.col("form").alias("root")))
    hops = 1
    while hops * 2 <= max(2, largest).bit_length():
        hops *= 2
        upper = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = settled(up.join(upper, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    return up.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text).

    Words are runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, some with a letter less (`typed`),
    of at least `min_length` code points and `min_count` occurrences n. Near words differ by one inserted, deleted or
    replaced code point. The form is the near word of largest n, the smallest in code-point order of equal ones, if it
    has `ratio` times the word's n at least, else null; root follows forms to the last, the word itself without one.
    Null and empty texts have no words; repeated rows count as often as they are there; other columns are not read.
    """
    words = settled(vocabulary(docs, min_length, min_count))
    short = words.filter(F.length("word") <= LONG)
    keys = _keys(short, "key long, at int, word string, n long", lambda part, owner: {"word": part.column("word").take(owner), "n": part.column("n").take(owner)})
    near = near_summaries(keys)
    if not words.filter(F.length("word") > LONG).isEmpty():
        near = near.union(near_long(words))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    out = settled(out)
    largest = out.agg(F.max("n")).first()[0] or 0
    root = roots(out.filter("form IS NOT NULL"), largest)
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
