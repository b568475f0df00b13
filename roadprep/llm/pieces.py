"""Sentencepiece encoding and decoding: one depth-first pass over the trie of distinct marked words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadprep.llm.shards import slices
from roadprep.llm.tokens import WordCounter

#: Text bytes of one slice: its distinct words form one trie.
SLICE = 4 << 20
#: Encoded words, and pairs of pieces with a known verdict, that a Python worker keeps at most.
MEMO_WORDS = 300_000
MEMO_PAIRS = 400_000
MARK = "▁"

_codecs: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encodes with the forward table of a pair-merging model, shared by words with a common prefix.

    The forward state of a prefix is the last piece of its encoding. Piece t may follow piece s exactly if the model
    merges the string s + t into these two pieces, and of the pieces that end a prefix exactly one may follow the last
    piece of what is before it. So the table is filled from left to right, and what two words share is filled once.
    Of a word's table the pieces are read backwards, as in Viterbi's algorithm. A best sum of scores, which is
    Viterbi's usual criterion, is not what this kind of model encodes: its scores are ranks of merges.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.surface = [p.replace(MARK, " ").encode() for p in self.pieces]
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.surface[i] = bytes([int(p[3:5], 16)])
            elif model.is_control(i) or model.is_unknown(i):
                self.surface[i] = b""
            else:
                self.ids[p], self.rank[p] = i, model.get_score(i)
        self.ends = {p[k:] for p in self.ids for k in range(len(p))}
        self.follows: dict[tuple[str, str], bool] = {}
        self.places: dict[str, int] = {}
        self.reset()
        self.library = model
        # whether words can be encoded alone, and whether this kind of model merges pairs: on words made of its pieces
        plain = sorted(p[1:] for p in self.ids if re.fullmatch(f"{MARK}[^{MARK}\n]+", p))[:: max(1, len(self.ids) // 2_000)]
        words = sorted({MARK + a + b for a, b in zip(plain, plain[1:])})
        flat: list[int] = []
        self.splits = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids)
        self.splits = self.splits and bool(self.encode_sorted(words, flat)) and flat == [i for w in words for i in model.encode(w[1:])]

    def reset(self) -> None:
        self.places.clear()
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.all_ids = np.zeros(0, np.int32)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string: the best pair is merged first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: str, piece: str) -> bool:
        known = self.follows.get((before, piece))
        if known is None:
            if len(self.follows) >= MEMO_PAIRS:
                self.follows.clear()
            known = self.follows[before, piece] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return known

    def encode_sorted(self, words: list[str], flat: list[int]) -> list[int]:
        """Adds the piece ids of each marked word to `flat` and returns their numbers; sorted words share the table of
        their common prefix."""
        lengths: list[int] = []
        last: list[str] = [""]  # last[i]: the last piece of the first i characters
        previous = ""
        ids, ends, follows = self.ids, self.ends, self.follows
        for word in words:
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                best = word[i - 1]
                for k in range(i - 1, -1, -1):
                    piece = word[k:i]
                    if piece not in ends:
                        break
                    if piece in ids:
                        before = last[k]
                        known = follows.get((before, piece))
                        if known or (known is None and self.may_follow(before, piece)):
                            best = piece
                            break
                last.append(best)
            previous = word
            out, i = [], len(word)
            while i:
                piece = last[i]
                i -= len(piece)
                found = ids.get(piece)
                if found is None:
                    out.extend(self.byte_ids[b] for b in reversed(piece.encode()))
                else:
                    out.append(found)
            out.reverse()
            flat += out
            lengths.append(len(out))
        return lengths

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text begins in it and the last ends."""
        if not self.splits:  # words of this vocabulary can't be encoded alone: the library does
            each = [np.array(self.library.encode(t) if t else [], np.int32) for t in texts]
            return np.concatenate(each) if each else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        per_text = [WordCounter.words(t) if t else [] for t in texts]
        distinct = set()
        for words in per_text:
            distinct.update(words)
        missing = distinct.difference(self.places)
        if len(self.places) + len(missing) > MEMO_WORDS:
            self.reset()
            missing = distinct
        if missing:
            words = sorted(missing)
            flat: list[int] = []
            # a word that its line feed leads has no space mark
            lengths = self.encode_sorted([w if w.startswith("\n") else MARK + w.replace(" ", MARK) for w in words], flat)
            self.places.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words))))
            self.lengths = np.concatenate([self.lengths, np.array(lengths, np.int64)])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.all_ids = np.concatenate([self.all_ids, np.array(flat, np.int32)])
        counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
        place = np.fromiter((self.places[w] for words in per_text for w in words), np.int64, int(counts.sum()))
        sizes = self.lengths[place]
        ends = np.cumsum(sizes)
        flat = self.all_ids[np.repeat(self.starts[place] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, bounds

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes put together, without the one space that encoding puts first."""
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids (array<int>), exact for each row: the piece ids of the whole text as the library gives them.

    `exact` says that the decoded ids are the text again (with U+2581, which the model writes for a space, as a space).
    A null or empty text has no ids and is exact. Repeated rows stay rows; other columns are not read. Map-only; memory
    is bounded by a slice of texts, or one longer text, and the two memos. A model that does not merge pairs, or whose
    pieces reach over the start of a word, is found out when a worker loads it, and the library encodes whole texts.
    """

    def run(batches):
        for part in slices(batches, "_text", SLICE):
            model, texts = codec(model_path), part.column("_text").to_pylist()
            ids, bounds = model.encode(texts)
            exact = [model.decode(ids[a:b].tolist()) == (t or "").replace(MARK, " ") for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds), pa.int64()), lists, pa.array(exact)], names=[id_col, "n_tokens", "ids", "exact"])

    small = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return small.mapInArrow(run, f"`{id_col}` {small.schema[0].dataType.simpleString()}, n_tokens long, ids array<int>, exact boolean")


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text for each row of ids; null ids give a null text, no ids an empty one."""

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else codec(model_path).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    small = encoded.select(F.col(id_col), F.col(ids_col).alias("_ids"))
    return small.mapInArrow(run, f"`{id_col}` {small.schema[0].dataType.simpleString()}, text string")
