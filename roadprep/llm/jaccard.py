"""Exact Jaccard self-join on word n-grams: universe partition, pigeonhole, one-deletion neighbourhoods, verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.llm.scratch import settled
from roadprep.llm.shards import ascii_lower_table, hash_spans, joined, mix, slices, word_spans

SHINGLE = 4
#: Two sets link when PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Documents (in expectation) on which the allocation of segments is based; it changes the cost, not the result.
SAMPLE_DOCS = 1_000
#: Cost of a needless pair against that of an index entry: sketches reject most pairs within the join.
PAIR_COST = 0.2
#: Ids up to which a semi-join broadcasts them (8 bytes each); beyond it the texts are shuffled.
BROADCAST_IDS = 2_000_000
#: Entries with up to so many documents are searched for one that sizes and sketches let link; those of larger ones all
#: go on to the comparison by rare elements. It changes the cost, not the result.
SCAN_ROWS = 64

_LOWER = ascii_lower_table()
_WORD_BYTE = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_U = np.uint64
_EMPTY = _U(0x5851F42D4C957F2D)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams; of the whole sequence if it has fewer words."""
    if not texts:
        return []
    data, bounds = joined([(t or "").encode() for t in texts], _LOWER)
    starts, ends = word_spans(data, _WORD_BYTE)
    words = hash_spans(data, starts, ends)
    first = np.searchsorted(starts, bounds)  # word number at which each text begins
    grams = np.zeros(len(words), _U)
    n = len(words) - size + 1
    if n > 0:
        for k in range(size):
            grams[:n] = mix(grams[:n] * _U(0x2545F4914F6CDD1D) + words[k : k + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            h = np.full(1, b - a, _U)
            for k in range(a, b):
                h = mix(h * _U(0x9E6C63D0876A9A47) + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of two linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


@dataclass(frozen=True)
class Scheme:
    """How sets up to `high` (the larger of a pair) are indexed: `equal` segments count 1 towards the pigeonhole where
    their contents agree, `deletion` segments count 2 where they differ by one element at most. `spare` is what a set
    may lose to segments without content and still share an indexed segment with every partner."""

    low: int
    high: int
    equal: int
    deletion: int
    spare: int


def poisson_tail(mean: float, beyond: int) -> float:
    """P(X > beyond)."""
    term = total = math.exp(-mean)
    for k in range(1, beyond + 1):
        term *= mean / k
        total += term
    return max(0.0, 1.0 - total)


def allocate(low: int, high: int, n_docs: float, shared: float, percent: int = PERCENT) -> Scheme:
    """The cheapest scheme for a band of sizes.

    The cost is the number of index entries of the band's sets and the number of pairs that share an entry without
    need, by the chance `shared` that an element of one set is in another: a segment with few elements is cheap to
    index and often shared, one-deletion neighbourhoods have larger segments and more entries. The pigeonhole needs
    equal + 2 * deletion > most_different + spare.
    """
    need = most_different(high, high, percent) + 1
    best = None
    for deletion in sorted({0, 1, 2, need // 8, need // 4, need // 2}):
        for spare in (0, 1, 2, 3, 4, 6, 8):
            equal = max(0, need + spare - 2 * deletion)
            if equal + deletion == 0 or need + spare < 2 * deletion:
                continue
            mean = high / (equal + deletion)
            none = math.exp(-mean)
            lost = poisson_tail(equal * none + deletion * none * (1 + mean), spare)
            same = math.exp(-mean * (1 - shared)) - none
            near = same * (1 + mean) ** 2 * 0.5
            pairs = n_docs * (equal * same + deletion * min(1.0, near)) + n_docs * lost * lost * (equal + deletion)
            cost = equal + deletion * (1 + mean) + PAIR_COST * pairs
            if best is None or cost < best[0]:
                best = (cost, Scheme(low, high, equal, deletion, spare))
    return best[1]


def bands(largest: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Ranges of sizes such that linked sets are in the same range or in neighbouring ones."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


class Index:
    """Segment signatures of sets."""

    def __init__(self, largest: int, n_docs: int, shared: float, percent: int = PERCENT):
        self.percent = percent
        self.bands = bands(largest * 100 // percent + 1, percent)
        self.lows = [b[0] for b in self.bands]
        self.schemes = [allocate(*b, n_docs / 20, shared, percent) if most_different(b[1], b[1], percent) else None for b in self.bands]

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """Signatures of one set, in the scheme of its own band and in that of the next one, where its larger partners are."""
        n = len(tokens)
        if not n:
            return np.zeros(0, _U)
        own = int(np.searchsorted(self.lows, n, "right")) - 1
        out = []
        for k in (own, own + 1):
            if k < len(self.bands) and self.schemes[k] is not None and 100 * n >= self.percent * self.lows[k]:
                out.append(self._one(tokens, k, self.schemes[k]))
        return np.concatenate(out) if out else np.zeros(0, _U)

    @staticmethod
    def _one(tokens: np.ndarray, number: int, scheme: Scheme) -> np.ndarray:
        m = scheme.equal + scheme.deletion
        segment = ((tokens >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)  # tokens are sorted: so are the segments
        value = mix(tokens ^ _U(0xD6E8FEB86659FD93))
        size = np.bincount(segment, minlength=m)
        running = np.concatenate([np.zeros(1, _U), np.cumsum(value)])
        ends = np.cumsum(size)
        content = running[ends] - running[ends - size]
        key = mix(np.arange(m, dtype=_U) * _U(0xA0761D6478BD642F) + _U(number * 0x9E3779B9 + 1))
        parts = [mix(content[size > 0] + key[size > 0])]
        lossy = int((size[: scheme.equal] == 0).sum()) + 2 * int((size[scheme.equal :] <= 1).sum())
        if scheme.deletion:
            of = segment[(segment >= scheme.equal) & (size[segment] > 1)]
            parts.append(mix(content[of] - value[(segment >= scheme.equal) & (size[segment] > 1)] + key[of]))
        if lossy > scheme.spare:  # a set like this can share no more than segments without content with a set like it
            bare = np.concatenate([size[: scheme.equal] == 0, size[scheme.equal :] <= 1])
            parts.append(mix(_EMPTY + key[bare]))
        return np.unique(np.concatenate(parts))


#: Words of 64 bits in a sketch of every set, and of the sets in candidate pairs.
SKETCH = 4
WIDE = 64


def _digest(tokens: np.ndarray) -> list[int]:
    """Two 64-bit sums that stand for the set, and a sketch: bit k is the parity of the elements that end in k."""
    parity = np.bincount((tokens & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    sketch = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)
    sums = np.array([tokens.sum(dtype=_U), mix(tokens ^ _U(0x94D049BB)).sum(dtype=_U)], _U).view(np.int64)
    return [*sums.tolist(), *sketch.tolist()]


def profile(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, d1, d2, sketch (a struct of longs) for each row of docs (doc_id, text)."""
    names = ["d1", "d2", *(f"s{k}" for k in range(SKETCH))]

    def run(batches):
        for part in slices(batches):
            sets = shingle_sets(part.column("text").to_pylist(), size)
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in range(len(names)))], names=["doc_id", "n_shingles", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, " + ", ".join(f"{n} long" for n in names))
    return out.select("doc_id", "n_shingles", "d1", "d2", F.struct(*names[2:]).alias("sketch"))


def sharing(docs: DataFrame, rows: int, size: int = SHINGLE) -> float:
    """The chance that an element of one document is in another one, on a bounded sample of about SAMPLE_DOCS texts."""

    def run(batches):
        for part in slices(batches):
            for s in shingle_sets(part.column("text").to_pylist(), size):
                yield pa.RecordBatch.from_arrays([pa.array(s[:: max(1, len(s) // 64)].view(np.int64))], names=["token"])

    drawn = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_DOCS / max(1, rows)) * (1 << 20)))
    seen = drawn.select("text").distinct().mapInArrow(run, "token long").groupBy("token").count()
    total, pairs = seen.agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1))).first()
    return float(pairs or 0) / (float(total) * min(rows, SAMPLE_DOCS)) if total else 0.0


def entries(docs: DataFrame, index: Index, size: int = SHINGLE) -> DataFrame:
    """(sig, doc_id) rows of the index. Equal sets within one slice of a task give one document's entries only."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for part in slices(batches):
            ids, sigs, seen = part.column("doc_id").to_pylist(), [], set()
            owners = []
            for i, s in zip(ids, shingle_sets(part.column("text").to_pylist(), size)):
                key = tuple(_digest(s)[:2])
                if i is None or key in seen:
                    continue
                seen.add(key)
                sigs.append(shared.value.signatures(s))
                owners.append(np.full(len(sigs[-1]), i, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["sig", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "sig long, doc_id long")


def shared_entries(index_rows: DataFrame) -> DataFrame:
    """(sig, doc_id, first) for signatures that more than one document has; `first` is the smallest of them.

    Each partition is sorted by signature (the sort can spill) and streamed: memory does not grow with a signature's rows.
    """

    def run(batches):
        last_sig, last_doc, first, open_ = None, 0, 0, False  # open_: the last row's signature was already given out
        for batch in batches:
            sig, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            start = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
            at = np.maximum.accumulate(np.where(start, np.arange(len(sig)), -1))
            lead = np.where(at >= 0, doc[np.maximum(at, 0)], first)
            single = start & np.concatenate([start[1:], [False]])
            single[-1] = False
            keep = ~single
            # the last row of a batch waits if it begins a signature; it is given out if the next batch goes on with it
            waits = bool(start[-1])
            if waits:
                keep[-1] = False
            head = not start[0] and not open_
            sigs, docs_, leads = sig[keep], doc[keep], lead[keep]
            if head:
                sigs, docs_, leads = np.concatenate([[last_sig], sigs]), np.concatenate([[last_doc], docs_]), np.concatenate([[first], leads])
            last_sig, last_doc, first, open_ = sig[-1], doc[-1], lead[-1], not waits
            if len(sigs):
                yield pa.RecordBatch.from_arrays([pa.array(sigs.astype(np.int64)), pa.array(docs_.astype(np.int64)), pa.array(leads.astype(np.int64))], names=["sig", "doc_id", "first"])

    return index_rows.repartition("sig").sortWithinPartitions("sig", "doc_id").mapInArrow(run, "sig long, doc_id long, first long")


def possible(n1: Column, s1: Column, n2: Column, s2: Column, percent: int = PERCENT) -> Column:
    """No linked pair fails this: the sizes are near enough and the sketches differ in no more bits than the sets may."""
    differ = sum((F.bit_count(s1[f"s{k}"].bitwiseXOR(s2[f"s{k}"])) for k in range(SKETCH)), F.lit(0))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * differ <= (100 - percent) * (n1 + n2))


def _of_documents(ids: DataFrame, docs: DataFrame, column: str, make, size: int) -> DataFrame:
    """doc_id, n (set size) and what `make` gives for the set, for each text of the documents in ids (doc_id)."""
    ids = settled(ids.distinct())
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def run(batches):
        for part in slices(batches):
            sets = shingle_sets(part.column("text").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([make(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", column])

    return texts.mapInArrow(run, f"doc_id long, n long, {column} array<long>")


def _wide(tokens: np.ndarray) -> np.ndarray:
    parity = np.bincount((tokens & _U(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _differ(a: str, b: str) -> Column:
    """Bits in which two wide sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _with_both(pairs: DataFrame, sides: DataFrame, column: str) -> DataFrame:
    for k in ("a", "b"):
        pairs = pairs.join(sides.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col(column).alias(f"{column}_{k}")), k)
    return pairs


def verify(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of document ids whose whole shingle sets link.

    A wide sketch of each set rules out most pairs that don't link; only the sets of the others are brought together.
    """

    def ids(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))

    near = _with_both(pairs, settled(_of_documents(ids(pairs), docs, "wide", _wide, size)), "wide")
    near = settled(near.filter((100 + percent) * _differ("wide_a", "wide_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct())
    both = _with_both(near, _of_documents(ids(near), docs, "tokens", lambda s: s, size), "tokens").withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    return both.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b").distinct()


def with_partner(mixed: DataFrame, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Of entries (sig, node, n, sketch, label), those whose signature has another label.

    In signatures of up to SCAN_ROWS rows only those stay that have a row of another label with which sizes and sketches
    let them link; sets that are too large for the short sketch are asked by the wide one. Each row is given out once.
    """
    labels = mixed.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("rows")).filter("l <> m")
    mixed = settled(mixed.join(labels.select("sig", "rows"), "sig"))
    few = mixed.filter(F.col("rows") <= SCAN_ROWS)

    def others(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"{c}_2") for c in ("sig", "n", "label", *columns)))

    unlike = (F.col("sig") == F.col("sig_2")) & (F.col("label") != F.col("label_2"))
    met = possible(F.col("n"), F.col("sketch"), F.col("n_2"), F.col("sketch_2"), percent)
    few = settled(few.join(others(few, "sketch"), unlike & met, "left_semi"))
    long = next(n for n in range(1, 1 << 20) if most_different(n, n, percent) >= 24 * SKETCH)
    large = few.filter(100 * F.col("n") >= percent * long)
    wide = _of_documents(large.select(F.col("node").alias("doc_id")), docs, "wide", _wide, size).select(F.col("doc_id").alias("node"), "wide", F.col("n").alias("n_text"))
    large = settled(large.join(wide, (large["node"] == wide["node"]) & (large["n"] == wide["n_text"])).select(large["*"], "wide"))
    near = (100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2")) & ((100 + percent) * _differ("wide", "wide_2") <= (100 - percent) * (F.col("n") + F.col("n_2")))
    large = large.filter(F.col("n") >= long).join(others(large, "wide"), unlike & near, "left_semi")
    return mixed.filter(F.col("rows") > SCAN_ROWS).union(few.filter(F.col("n") < long)).union(large.drop("wide"))


def rare_pairs(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of nodes (node, n, sketch, label) with different labels, among them all whose sets link.

    All elements of these sets are put in one order, the rarest first. The first element that two linked sets share has
    so few elements of either set before it that the rest of both can still hold what they must share. So near copies
    that don't link, as each has too many elements of its own, meet nowhere: the number of pairs does not follow the
    square of their group. Under each element only rows outside its most frequent label are compared with the others.
    """
    # made twice, once to count and once to rank: a table of all elements would take as much disk as either shuffle
    each = _of_documents(nodes.select(F.col("node").alias("doc_id")), docs, "tokens", lambda s: s, size).select(F.col("doc_id").alias("node"), "n", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1")
    of_node = Window.partitionBy("node", "n")
    # elements that no other set has come first: they need no row, only their number
    before = F.col("n") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("times", "token")) - 1
    ranked = each.join(counts, "token").withColumn("rest", F.col("n") - before)
    ranked = ranked.filter(100 * F.col("rest") >= percent * F.col("n")).select("token", "node", "n", "rest")
    ranked = settled(ranked.join(nodes.select("node", "sketch", "label"), "node"))
    heads = ranked.groupBy("token", "label").count().groupBy("token").agg(F.max_by("label", "count").alias("most"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    mixed = settled(ranked.join(heads, "token"))
    left, right = (mixed.select(F.col("token").alias(f"token{k}"), "most", *(F.col(c).alias(f"{c}{k}") for c in ("node", "n", "rest", "sketch", "label"))) for k in (1, 2))
    n = F.col("n1") + F.col("n2")
    enough = ((100 + percent) * F.col("rest1") >= percent * n) & ((100 + percent) * F.col("rest2") >= percent * n)
    unlike = (F.col("label1") != F.col("label2")) & ((F.col("label2") == F.col("most")) | (F.col("node1") < F.col("node2")))
    met = left.filter("label1 <> most").join(right.drop("most"), (F.col("token1") == F.col("token2")) & unlike & enough & possible(F.col("n1"), F.col("sketch1"), F.col("n2"), F.col("sketch2"), percent))
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links reach. Alternating stars; each round halves the way to the root."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u")
        edges = settled(linked.select("u", F.col("m").alias("v")).union(linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
    return edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the connected components of documents with near-equal shingle sets.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased; a set holds the distinct
    `size`-word runs of the whole text. Sets link when 100 * intersection >= percent * union. Null or empty texts have
    the set size 0 and are alone; repeated rows and equal texts are in one component; a null doc_id has a null
    component. doc_id must be an integer; a document in several rows with different texts has the links of each.

    1. Documents with equal sets become one node, the smallest doc_id.
    2. Each set's tokens fall into segments of the hash range; segments' contents (and contents less one element, where
       allocated) are the index. Linked sets share an entry (see Scheme), whatever their content.
    3. Every entry's documents are verified against its smallest one, and the links' components are formed.
    4. Where documents share an entry but no component yet, those of them that share a rare element too (rare_pairs)
       are verified as well, so that no link is lost.
    """
    docs = docs.select("doc_id", "text")
    rows = settled(profile(docs, size))
    nodes = settled(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").cast("long").alias("node"), F.first("sketch").alias("sketch")))
    n_docs, largest = nodes.agg(F.count("*"), F.max("n_shingles")).first()
    # copies of another document need no index entries; those that one task sees are left out by `entries` in any case
    owner = rows.filter("n_shingles > 0").join(nodes, ["n_shingles", "d1", "d2"]).select(F.col("doc_id").cast("long").alias("doc_id"), "node", F.col("n_shingles").alias("n"), nodes["sketch"]).distinct()
    owner = settled(owner)
    copies = owner.filter("doc_id <> node").select("doc_id").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").distinct()
    indexed = docs.filter("doc_id IS NOT NULL")
    if copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        indexed = indexed.join(F.broadcast(copies), "doc_id", "left_anti")
    found = settled(shared_entries(entries(indexed, Index(largest or 0, n_docs, sharing(docs, n_docs, size), percent), size)))

    def with_nodes(pairs: DataFrame) -> DataFrame:
        for c in ("first", "doc_id"):
            side = owner.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "sketch")))
            pairs = pairs.join(side, c)
        return pairs

    def linkable(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of nodes (a, b) that sizes and sketches don't rule out."""
        pairs = pairs.filter((F.col("node_first") != F.col("node_doc_id")) & possible(*(F.col(f"{x}_{c}") for c in ("first", "doc_id") for x in ("n", "sketch")), percent))
        return pairs.select(F.least("node_first", "node_doc_id").alias("a"), F.greatest("node_first", "node_doc_id").alias("b")).distinct()

    pairs = settled(with_nodes(found.select("first", "doc_id").filter("first <> doc_id").distinct()))
    stars = settled(linkable(pairs))
    links = settled(verify(stars, docs, percent, size))
    labels = settled(components(links))

    def label_of(column: str) -> DataFrame:
        return labels.select(F.col("node").alias(column), F.col("label").alias(f"label_{column}"))

    def labelled(pairs: DataFrame) -> DataFrame:
        for c in ("node_first", "node_doc_id"):
            pairs = pairs.join(label_of(c), c, "left").withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
        return pairs.filter(F.col("label_node_first") != F.col("label_node_doc_id"))

    # entries whose documents, beside the one that the others were verified against, are not all in one component
    apart = settled(labelled(pairs).select("first").distinct())
    if not apart.isEmpty():
        mixed = found.join(apart, "first", "left_semi").filter("first <> doc_id").join(owner, "doc_id").join(label_of("node"), "node", "left")
        mixed = settled(mixed.select("sig", "node", "n", "sketch", F.coalesce("label_node", "node").alias("label")))
        rest = settled(with_partner(mixed, docs, percent, size).select("node", "n", "sketch", "label").distinct())
        cross = settled(rare_pairs(rest, docs, percent, size).join(stars, ["a", "b"], "left_anti"))
        if not cross.isEmpty():
            more = settled(verify(cross, docs, percent, size))
            if not more.isEmpty():
                labels = settled(components(links.union(more)))

    named = nodes.join(labels, "node", "left").select("n_shingles", "d1", "d2", F.coalesce("label", "node").alias("component_id"))
    out = rows.join(named, ["n_shingles", "d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id").cast("long"))).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row of each component of rows, that with the smallest doc_id, null last; columns stay as they were.

    Rows are what is compared: one id on several texts joins nothing, and copies under any ids are one component.
    Null and empty texts are alone, so each of their rows stays. Where ids are unique, as they should be, they name the
    rows; else the rows are written once with numbers of their own.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        first = settled(jaccard_components(docs, percent, size).filter("doc_id = component_id").select("doc_id"))
        small = first.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return docs.join(F.broadcast(first) if small else first, "doc_id", "left_semi").select(*docs.columns)
    row = next(n for n in (f"row_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = settled(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), percent, size).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    first = rows.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(settled(first), row, "left_semi").select(*docs.columns)
