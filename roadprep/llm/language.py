"""Language identification with a presence string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.llm.shards import slices

#: Byte n-grams of 2 to MAX_N bytes are hashed into this many presence bits.
BUCKETS = 1 << 15
MAX_N = 4
#: Distinct labelled texts of each language that the classifier is fitted on at most, and landmarks among them.
FIT_ROWS = 400
LANDMARKS = 32
RIDGE = 1e-2
#: Rows of one matrix product.
BLOCK_ROWS = 256

UNDETERMINED = "und"
# the letters of has_letter, and the ASCII signs that `presence` takes for spaces, as Spark needs them
_SPARK_LETTER = r"[\p{L}\p{Nl}\p{No}]"
_NO_WORD = "".join(chr(b) for b in range(1, 128) if not (97 <= b <= 122 or 65 <= b <= 90 or b in (32, 39)))
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))
_SEEDS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)  # odd multipliers, one for each n


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def presence(text: str, out: np.ndarray) -> None:
    """Sets out[k] = 1 for the bucket k of each n-gram of the whole text, lower-cased, other signs than letters as spaces."""
    data = np.frombuffer((" " + text.lower() + " ").encode().translate(_SPACED), np.uint8).astype(np.uint32)
    gram = data
    for n in range(2, MAX_N + 1):
        gram = (gram[:-1] << np.uint32(8)) | data[n - 1 :]
        out[(gram * np.uint32(_SEEDS[n - 2])) >> np.uint32(17)] = 1


@dataclass
class Classifier:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits, a row for each landmark
    weights: np.ndarray  # landmarks x languages

    def __post_init__(self):
        self._matrix = None

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Shared n-grams over the geometric mean of both numbers of n-grams."""
        if self._matrix is None:
            bits = np.unpackbits(self.landmarks, axis=1)[:, :BUCKETS].astype(np.float32)
            self._matrix = np.ascontiguousarray((bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))).T)
        return (x @ self._matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def __getstate__(self):
        return {"languages": self.languages, "landmarks": self.landmarks, "weights": self.weights, "_matrix": None}

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for first in range(0, len(rows), BLOCK_ROWS):
            block = rows[first : first + BLOCK_ROWS]
            x = np.zeros((len(block), BUCKETS), np.float32)
            for row, i in zip(x, block):
                presence(texts[i], row)
            margins = self.kernel(x) @ self.weights
            best = margins.argmax(1)
            for i, k, m in zip(block, best.tolist(), margins[np.arange(len(block)), best].tolist()):
                out[i] = (self.languages[k], round(min(1.0, max(0.0, (m + 1) / 2)), 6))
        return out


def solve(labels: list[str], bits: np.ndarray, landmarks_each: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """Fits the classifier on packed presence rows; the first rows of each language are its landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return Classifier([], np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((0, 0), np.float32))
    labels_array = np.array(labels)
    chosen = np.concatenate([np.flatnonzero(labels_array == x)[:landmarks_each] for x in languages])
    model = Classifier(languages, bits[chosen], np.zeros((len(chosen), len(languages)), np.float32))
    k = np.concatenate([model.kernel(np.unpackbits(bits[i : i + BLOCK_ROWS], axis=1)[:, :BUCKETS].astype(np.float32)) for i in range(0, len(bits), BLOCK_ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = k @ root
    y = np.where(labels_array[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.array([1.0 / (labels_array == x).sum() for x in languages])[np.searchsorted(languages, labels_array)]
    gram = (z * weight[:, None]).T @ z + ridge * np.eye(z.shape[1]) / len(languages)
    model.weights = (root @ np.linalg.solve(gram, (z * weight[:, None]).T @ y)).astype(np.float32)
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Classifier:
    """Fits on a bounded sample: the `fit_rows` distinct texts of each non-null language with the smallest hashes.

    Every language with a letter in a text is learned. Texts that differ in signs and digits only count as one, so that
    copies neither hide a language nor add rows. Spark ranks the hashes in each task before it does so over all; texts
    are turned into presence bits by the tasks, and the driver gets BUCKETS / 8 bytes for each sampled text.
    """
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(_SPARK_LETTER))
    plain = F.concat(F.lit(" "), F.translate(F.lower("text"), _NO_WORD, " " * len(_NO_WORD)), F.lit(" "))
    labelled = labelled.withColumn("h", F.xxhash64(F.regexp_replace(plain, f" {{{MAX_N},}}", " " * MAX_N)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = labelled.select("lang", "h").distinct().withColumn("k", rank).filter(F.col("k") <= fit_rows).drop("k")

    def bits(batches):
        seen: set[tuple[str, int]] = set()  # of the sampled texts: bounded like the sample
        for part in slices(batches):
            rows = []
            for lang, h, text in zip(*(part.column(c).to_pylist() for c in ("lang", "h", "text"))):
                if (lang, h) not in seen and has_letter(text):
                    seen.add((lang, h))
                    x = np.zeros(BUCKETS, np.uint8)
                    presence(text, x)
                    rows.append((lang, np.packbits(x).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "bits"])

    drawn = labelled.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text").mapInArrow(bits, "lang string, bits binary").distinct()
    rows = sorted((r[0], bytes(r[1])) for r in drawn.collect())
    # in the order of a hash, so that landmarks are no particular texts
    rows.sort(key=lambda r: (hash_bits(r[1]), r))
    return solve([r[0] for r in rows], np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), BUCKETS // 8))


def hash_bits(bits: bytes) -> int:
    import zlib

    return zlib.crc32(bits)


def predict(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in `keep`, lang_pred and score (0 to 1) for each row, from its whole text alone.

    `und` with score 0 if the text is null, empty or has no letter, or nothing was learned. Repeated rows stay rows.
    Map-only; the broadcast model has LANDMARKS rows of BUCKETS / 8 bytes for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))

    def run(batches):
        for part in slices(batches, "_text"):
            found = shared.value.predict(part.column("_text").to_pylist())
            arrays = [part.column(c) for c in (id_col, *keep)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema if f.name != "_text")
    return small.mapInArrow(run, f"{schema}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text mod 3 is 1), lang_pred, score; fitted on the rows not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    return predict(docs, fit(docs.filter(~F.col("held_out"))), keep=("held_out",))
