"""Token counts without tokenizing every word: whole-token shortcut."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadprep.llm.shards import slices

#: Words with known counts that one Python worker keeps at most, besides the proven whole tokens.
MEMO_WORDS = 1_000_000

_counters: dict[str, WordCounter] = {}


class WordCounter:
    """Counts of words for one sentencepiece model that merges pairs.

    The model writes a space as U+2581 and puts one before the text. The constructor proves from the vocabulary that
    (a) no piece has a space mark after another character, so no merge reaches over the start of a run of spaces,
    (b) no piece holds a line feed, so merges stop there too, and (c) which vocabulary strings encode alone as one
    token. Words proven in (c) count 1 without any merge; other words are merged by the library once and remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (self.model.is_byte, self.model.is_control, self.model.is_unknown)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not any(f(i) for f in special)]
        self.splits = not any(re.search("[^▁]▁|\n", p) for p in pieces)
        words = [p[1:] for p in pieces if re.match("▁[^▁]", p)]
        # a word at the start of a line has no space mark of its own: it is kept with its line feed, which is a byte token
        words += ["\n" + p for p in pieces if not p.startswith("▁")]
        alone = self.model.encode(words, num_threads=1)
        self.whole = {w: len(ids) - w.startswith("\n") for w, ids in zip(words, alone) if len(ids) == 1 + 2 * w.startswith("\n")}
        self.whole[""] = 1  # a space mark with no word after it
        self.memo = dict(self.whole)

    @staticmethod
    def words(text: str) -> list[str]:
        """The independent parts of a text: words without their one space mark, or with the line feed before them."""
        out = []
        for n, line in enumerate(text.replace("▁", " ").split("\n")):
            parts = line.split(" ")
            if n:
                out.append("\n" + parts[0])
                parts = parts[1:]
            if "" in parts:
                spaces = ""
                for p in parts:
                    if p:
                        out.append(spaces + p)
                    spaces = "" if p else spaces + " "
                if spaces:
                    out.append(spaces[1:])
            else:
                out += parts
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.splits:  # a vocabulary without the proofs (a) and (b) is counted by the library alone
            return [len(ids) for ids in self.model.encode([t or "" for t in texts], num_threads=1)]
        per_text = [self.words(t) if t else [] for t in texts]
        distinct = set()
        for words in per_text:
            distinct.update(words)
        missing = distinct.difference(self.memo)
        if len(self.memo) + len(missing) > MEMO_WORDS + len(self.whole):
            self.memo = dict(self.whole)
            missing = distinct.difference(self.memo)
        missing = list(missing)
        for w, ids in zip(missing, self.model.encode(missing, num_threads=1)):
            self.memo[w] = len(ids) - w.startswith("\n")
        return [sum(map(self.memo.__getitem__, words)) for words in per_text]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every whole text as the sentencepiece model at `model_path` gives them, without begin or end tokens.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), a row for each input row. A null text
    counts as empty: 0 bytes, 0 tokens. Other columns are not read. Map-only: no shuffle, memory bounded by a slice of
    texts, or one text that is longer, and by MEMO_WORDS.
    """

    def run(batches):
        if model_path not in _counters:
            _counters[model_path] = WordCounter(model_path)
        for part in slices(batches, "_text"):
            counts = _counters[model_path].count(part.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column("_bytes"), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.col(text_col)
    small = docs.select(F.col(id_col), text.alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"))
    kind = small.schema[0].dataType.simpleString()
    return small.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
