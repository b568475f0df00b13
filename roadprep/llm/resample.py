"""Importance resampling towards a target distribution of hashed n-grams, in two Arrow passes."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.llm.scratch import bounded_batches, settled
from roadprep.llm.shards import slices

BUCKETS = 10_000
#: Features are runs of 1 to ORDER words.
ORDER = 1
SEED = 2024
MIN_WORDS = 20
#: Percent of the documents with MIN_WORDS words that are drawn.
SHARE = 10
#: Features whose buckets a worker remembers; it changes the cost, not the result.
KNOWN_FEATURES = 200_000

#: A-Z become lower case, every ASCII character that is in no word becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """The bucket of a feature's bytes, remembered."""

    def __init__(self, buckets: int = BUCKETS):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_FEATURES:
            self.clear()
        out = zlib.crc32(feature) % self.buckets
        if len(feature) <= 64:
            self[feature] = out
        return out

    def of(self, texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets of all texts' features, text after text, and each text's numbers of features and of words."""
        found, features, words = [], [], []
        for text in texts:
            own = (text or "").encode().translate(_TABLE).split()
            words.append(len(own))
            for k in range(2, order + 1):
                own += [b" ".join(run) for run in zip(*(own[i : words[-1]] for i in range(k)))]
            features.append(len(own))
            found.append(np.fromiter(map(self.__getitem__, own), np.int64, len(own)))
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        return at, np.array(features, np.int64), np.array(words, np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features of all texts by bucket: a vector for each partition, merged by a tree of reductions."""

    def run(batches):
        of, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for part in slices(batches):
            counts += np.bincount(of.of(part.column("text").to_pylist(), order)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    context = docs.sparkSession.sparkContext
    with bounded_batches(docs.sparkSession):
        vectors = docs.select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
        none = context.parallelize([np.zeros(buckets, np.int64)], 1)  # a table may have no partition
        return vectors.union(none).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of both distributions) of each bucket, with one count added everywhere."""
    n, all_s, all_t = len(source), float(source.sum() + len(source)), float(target.sum() + len(source))
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * all_s / ((float(source[k]) + 1) * all_t))) for k in range(n)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """A Gumbel variate in thousandths that depends on the id only; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def run(batches):
        of = Buckets(len(shared.value))
        for part in slices(batches):
            at, features, words = of.of(part.column("text").to_pylist(), order)
            owner = np.repeat(np.arange(len(features)), features)
            # whole numbers below 2^53: the sums are exact
            sums = np.bincount(owner, weights=shared.value[at], minlength=len(features)).astype(np.int64)
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            score = weight + np.array([noise(i, seed) for i in part.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (features, words, weight, score))], names=["doc_id", "n_features", "n_words", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_features long, n_words long, weight long, score long")


def with_draw(rows: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """`rows` with `rank`: 1, 2, 3 ... by descending score and ascending doc_id for the drawn ones, else null.

    Scores are whole numbers of a bounded range (gains and noise are logarithms in thousandths), so counts by score are
    a small table of any input; it gives the score that is still drawn, and how many rows stand above each score. Only
    rows from that score on are shuffled, by score, of which the noise gives none more than one row in 2,700.
    """
    pool = rows.filter(F.col("n_words") >= min_words)
    wanted = share * pool.count() // 100
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    heads = pool.groupBy("score").count().select("score", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("above")).filter(F.col("above") < wanted)
    heads = settled(heads)
    last = heads.agg(F.min("score")).first()[0]
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = (F.col("n_words") >= min_words) & (F.col("score") >= last)
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features"))
    ranked = rows.filter(high).join(heads, "score").withColumn("rank", (F.col("above") + inside).cast("long"))
    ranked = ranked.select(*rows.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return ranked.union(rows.filter(~high).select("*", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs (doc_id, text), drawn towards `target` (text).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; features are runs of 1 to `order`
    words, joined by a space, in the bucket crc32 mod `buckets`. A document's weight is the floored mean of its
    features' gains, 0 without features (null and empty texts); its score adds Gumbel noise of the id. Of those with
    `min_words` words the highest `share` percent are drawn, without replacement; equal scores by doc_id, null last.
    Rows of one id have the same noise; repeated rows are rows and get ranks of their own. Other columns are not read.

    Both passes are maps of the texts; what moves is a vector a partition, and the small rows of the highest scores.
    """
    gain = gains(bucket_counts(docs, buckets, order), bucket_counts(target, buckets, order))
    return with_draw(settled(scored(docs, gain, order, seed)), share, min_words).drop("n_words")


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with their columns as they were."""
    picked = settled(resample(docs, target, **parameters).filter("rank IS NOT NULL").select("doc_id"))
    return docs.join(picked, docs["doc_id"].eqNullSafe(picked["doc_id"]), "left_semi")
