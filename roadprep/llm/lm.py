"""Language-model scores of all texts by an n-gram model of the training texts, in shards of Elias-Fano tries."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from roadprep.llm.elias_fano import WORD_BITS, NgramTrie, dequantise, quantise
from roadprep.llm.scratch import settled
from roadprep.llm.shards import ascii_lower_table, hash_spans, joined, mix, slices, word_spans

#: Text bytes of one batch of documents, and of the corpus for each shard of the model.
BATCH_BYTES = 12 << 20
SHARD_BYTES = 12 << 20
#: What a document adds to its text's bytes there, and batches that a file of the table of tokens holds at most.
ROW_BYTES, FILE_BATCHES = 32, 8
#: Levels of the model, as answers name them.
WORDS, PAIRS, TRIPLES = 1, 2, 3
#: What the lower order counts for beside a context's own count; chosen on training documents held back from training
#: (crc32 modulo 5 is 2), where a few counts, as for rare contexts, did worse than no context at all.
PRIORS = {PAIRS: 128.0, TRIPLES: 64.0}
#: Tokens of a context for each part that its successors are dealt into: no shard holds a frequent word's successors.
SPLIT_TOKENS = 1 << 18
#: The two words before a token are a context where the training texts hold them so often, however large the corpus is. Other
#: tokens keep the second level's value.
CONTEXT_COUNT = 2
#: If set, a context is also needed once in so many training tokens: a smaller model, whose contexts depend on the corpus' size.
CONTEXT_TOKENS: int | None = None

_LOWER = ascii_lower_table()
_WORD_BYTE = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_U = np.uint64
#: The answer to a batch that alone has a pair: its own count is the count. No probability has this code.
SOLE = 65535
_ZSTD = pa.Codec("zstd", 1)
#: Contexts are hashes of 56 bits: the steps between sorted ones take a byte less.
_CONTEXT = ~_U(255)
#: Stand for the end and the start of a text; hashes of words, or of their numbers, are as likely to equal them as each other.
_END, _START = _U(0x1D8E4E27C47D124F), _U(0xEB44ACCAB455D165)


def _tokens_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("batch", pa.int64()), ("bytes", pa.int64()), ("texts", pa.int64()), ("ids", pa.list_(kind)), ("held", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("ranks", pa.binary()), ("places", pa.binary())])


def _encode(kind: pa.DataType):
    """Cuts a partition into batches of nearly equal size, about BATCH_BYTES at most but for one long text: a row for each, with
    its distinct words as rising 64-bit hashes, their ranks by frequency, and the rank of each token's word."""
    schema = _tokens_schema(kind)

    def row(parts, number):
        words, place = distinct(np.concatenate([p[3] for p in parts]))
        order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = pa.concat_arrays([p[0].cast(kind) for p in parts])
        held, sizes = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        values = (number, sum(p[4] for p in parts), int((~held).sum()), np.packbits(held).tobytes(), pack(sizes), pack_rising(words), pack(rank), pack(rank[place]))
        columns = [pa.array([v], t) for v, t in zip(values, [f.type for f in schema if f.name != "ids"])]
        columns.insert(3, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for part in chain(slices(batches), [None]):
            if part is not None:
                data, bounds = joined([(t or "").encode() for t in part.column("text").to_pylist()], _LOWER)
                starts, ends = word_spans(data, _WORD_BYTE)
                first = np.searchsorted(starts, bounds)
                hashes = np.insert(hash_spans(data, starts, ends), first[1:], _END)
                size = len(data) + ROW_BYTES * part.num_rows
                parts.append((part.column("doc_id"), np.array(part.column("held_out").to_pylist(), bool), np.diff(first) + 1, hashes, size))
                held += size
            while parts and (part is None or held >= 2 * BATCH_BYTES):
                limit, taken, now = held / (-(-held // BATCH_BYTES)), 0, 0
                while taken < len(parts) and (not taken or now + parts[taken][4] / 2 <= limit):
                    now, taken = now + parts[taken][4], taken + 1
                yield row(parts[:taken], number)
                number, parts, held = number + 1, parts[taken:], held - now

    return run


class Batch:
    """The tokens of a batch of documents, with an end after each text. Words stand for themselves by mixed numbers from the
    shards' answers; one that no other batch has is `sole`, with a number of its own here."""

    def __init__(self, table: pa.Table):
        row = table.slice(0, 1)
        cell = {n: row.column(n)[0].as_py() for n in ("batch", "held", "sizes", "ranks", "places")}
        self.number, self.ids = cell["batch"], row.column("ids").combine_chunks().flatten()
        self.sizes = unpack(cell["sizes"]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held_out = np.unpackbits(np.frombuffer(cell["held"], np.uint8), count=len(self.sizes)).astype(bool)
        self.train = np.repeat(~self.held_out, self.sizes)
        ranks = unpack(cell["ranks"]).astype(np.int64)
        known = np.empty(len(ranks), np.int32)
        known[ranks] = np.arange(len(ranks))
        self.place = known[unpack(cell["places"]).astype(np.int32)]  # of each token's word among the rising hashes

    def learn(self, told: pa.Table, texts: int) -> None:
        """From the shards' answers: training counts of each token's word and of the word before it, `texts` for the start of
        a text; the number of each token's word, and whether it or the word before it is sole. Shards are ranges of hashes."""
        rows = _of_level(told, WORDS)
        counts, numbers = (np.concatenate([unpack(x) for x in rows.column(c).to_pylist()]) for c in ("data", "ids"))
        sole = numbers == 0
        numbers[sole] = _U(1 << (WORD_BITS - 1)) + np.flatnonzero(sole).astype(_U)
        self.n, self.successors, self.words = counts.astype(np.int64)[self.place], numbers[self.place], mix(numbers)[self.place]
        self.n_before = self._moved(self.n, texts)
        self.before = self._moved(self.words, _START)
        self.sole = sole[self.place]
        self.sole |= self._moved(self.sole, False)

    def _moved(self, values: np.ndarray, first) -> np.ndarray:
        """Each token's value from the token before it; `first` at the start of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def pairs(self, n_shards: int, split: int) -> Level:
        return Level(self, np.arange(len(self.words)), self.before, self.n_before, self.sole, n_shards, split)

    def triples(self, code: np.ndarray, sole: np.ndarray, least: int, n_shards: int, split: int) -> Level:
        """The tokens whose two words before are a context, with its count: that of the pair that ends one token earlier.

        The count is taken from the pair's code, which every batch has alike: exact below some thousands, then as near as codes
        are. Three words of which two neighbours are no other batch's are none of its either.
        """
        held = self._moved(np.rint(dequantise(code) * (self.n_before + PRIORS[PAIRS])).astype(np.int64), 0)
        at = np.flatnonzero(held >= least)
        return Level(self, at, self._moved(mix(self.before) + self.words, _START)[at], held[at], (sole | self._moved(sole, False))[at], n_shards, split)


class Level:
    """The tokens `at` after their contexts: what is asked of the shards, and what is this batch's alone and counted here."""

    def __init__(self, batch: Batch, at: np.ndarray, before: np.ndarray, n_before: np.ndarray, sole: np.ndarray, n_shards: int, split: int):
        self.batch, self.at, self.before, self.n_before, self.sole = batch, at, before, n_before, sole
        shared = ~sole
        self.pairs = Pairs(before[shared], n_before[shared], batch.words[at[shared]], batch.successors[at[shared]], n_shards, split)

    def asked(self) -> pa.Table:
        return self.pairs.asked(self.batch.number, self.batch.train[self.at[~self.sole]])

    def told(self, table: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The code of each token, and whether no other batch has its pair."""
        code, sole = np.zeros(len(self.at), np.uint16), self.sole.copy()
        code[~sole] = self.pairs.told(table, level)
        sole |= code == SOLE
        own = np.flatnonzero(sole)
        known, place = distinct(mix(self.before[own]) + self.batch.words[self.at[own]])
        counts = np.bincount(place[self.batch.train[self.at[own]]], minlength=len(known))[place]
        code[own] = 0
        own, counts = own[counts > 0], counts[counts > 0]
        code[own] = coded(counts, self.n_before[own], PRIORS[level])
        return code, sole


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def ranges(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Where each shard's range of rising 64-bit keys begins, and the end."""
    bounds = np.arange(1, n_shards, dtype=_U) * _U((1 << 64) // n_shards - (n_shards == 1))
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def small_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each; those above 254 follow in eight."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def read_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


class Pairs:
    """The distinct (context, successor) pairs of a batch. A context with many tokens is cut into parts by ranges of its
    successors' hashes; parts are contexts of their own. They rise in the order of shards, numbers of successors in each."""

    def __init__(self, before: np.ndarray, n_before: np.ndarray, words: np.ndarray, successors: np.ndarray, n_shards: int, split: int):
        parts = (n_before // split + 1).astype(_U)
        keys, many = mix(before), np.flatnonzero(parts > 1)
        keys[many] += ((words[many] >> _U(32)) * parts[many] >> _U(32)) * _U(0x9E3779B97F4A7C15)
        contexts, number = distinct(mix(keys) & _CONTEXT)
        key, self.place = distinct(number.astype(_U) << _U(WORD_BITS) | successors)  # less than 2^24 contexts in a batch
        self.contexts, self.words = contexts, key & _U((1 << WORD_BITS) - 1)
        self.sizes = np.bincount((key >> _U(WORD_BITS)).astype(np.int64), minlength=len(contexts))
        self.totals = np.zeros(len(contexts), np.int64)
        self.totals[number] = n_before
        self.starts = ranges(contexts, n_shards)  # of each shard's contexts
        self.word_starts = np.concatenate([[0], np.cumsum(self.sizes)])[self.starts]

    def asked(self, batch: int, train: np.ndarray) -> pa.Table:
        """A row for each shard with contexts: what is asked of it and told to it, counts from the tokens of `train`."""
        counts, words = np.bincount(self.place[train], minlength=len(self.words)), steps(self.words, self.sizes)
        columns: dict[str, list] = {n: [] for n in _PAIRS.names}
        for s in np.flatnonzero(np.diff(self.starts)).tolist():
            (c, d), (e, f) = ((x[s], x[s + 1]) for x in (self.starts, self.word_starts))
            values = (batch, s, pack_rising(self.contexts[c:d]), pack(self.totals[c:d]), pack(self.sizes[c:d]), pack(words[e:f]), pack(counts[e:f]))
            for n, v in zip(_PAIRS.names, values):
                columns[n].append(v)
        return pa.table(columns, schema=_PAIRS)

    def told(self, table: pa.Table, level: int) -> np.ndarray:
        """The code of each token from the shards' answers. Shards are ranges of contexts: their order is that of pairs."""
        codes = [unpack(x) for x in _of_level(table, level).column("data").to_pylist()]
        return (np.concatenate(codes).astype(np.uint16) if codes else np.zeros(0, np.uint16))[self.place]


def _of_level(told: pa.Table, level: int) -> pa.Table:
    return told.filter(pa.compute.equal(told.column("level"), level)).sort_by("shard")


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on: how many, then the planes of their bytes, lowest first, as many as the largest takes, each
    compressed where that is shorter. Small and frequent numbers take little room."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    out = [len(values).to_bytes(4, "little")]
    for plane in np.ascontiguousarray(values.astype(_U).view(np.uint8).reshape(-1, 8)[:, :width].T):
        raw = plane.tobytes()
        small = _ZSTD.compress(raw, asbytes=True) if len(raw) > 32 else raw
        small = min(raw, small, key=len)  # what is as long as before is not compressed
        out += [len(small).to_bytes(4, "little"), small]
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    n, at, k = int.from_bytes(data[:4], "little"), 4, 0
    out = np.zeros((n, 8), np.uint8)
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        plane = data[at + 4 : end]
        out[:, k] = np.frombuffer(plane if len(plane) == n else _ZSTD.decompress(plane, n, asbytes=True), np.uint8)
        at, k = end, k + 1
    return out.view(_U).ravel()


def pack_rising(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys: the first, and the steps between two."""
    return keys[:1].tobytes() + pack(np.diff(keys))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data, _U, 1), unpack(data[8:])]), dtype=_U)


def steps(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words that rise in each context, as steps from the one before; a context's first stays."""
    first = np.cumsum(sizes) - sizes
    out = np.diff(words, prepend=_U(0))
    out[first] = words[first]
    return out


def from_steps(out: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    first = np.cumsum(sizes) - sizes
    sums = np.cumsum(out, dtype=_U)
    return sums - np.repeat(sums[first] - out[first], sizes)


_WORDS = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
_PAIRS = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("contexts", pa.binary()), ("totals", pa.binary()), ("sizes", pa.binary()), ("successors", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("level", pa.int64()), ("data", pa.binary()), ("ids", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _ask_words(n_shards: int):
    """A batch's distinct words with their training counts: a row for each shard that it has words for."""

    def ask(table):
        batch, known = Batch(table), unpack_rising(table.column("words")[0].as_py())
        counts = np.bincount(batch.place[batch.train], minlength=len(known))
        starts = ranges(known, n_shards)
        rows = np.flatnonzero(np.diff(starts)).tolist()
        return pa.RecordBatch.from_pydict(
            {"batch": [batch.number] * len(rows), "shard": rows, "words": [pack_rising(known[starts[s] : starts[s + 1]]) for s in rows], "counts": [small_counts(counts[starts[s] : starts[s + 1]]) for s in rows]},
            schema=_WORDS,
        )

    def run(batches):
        for part in batches:
            for i in range(part.num_rows):
                yield ask(pa.table(part.slice(i, 1)))

    return run


def _tell_words(n_shards: int):
    """The sums of all batches' counts, and a number from 1 on for each word, small for frequent ones, to each batch in the
    order asked; 0 for a word that one batch alone has."""

    def run(key, table):
        rows = table.to_pydict()
        each = [unpack_rising(k) for k in rows["words"]]
        known, total, place = _merged(each, [read_counts(c, len(k)) for k, c in zip(each, rows["counts"])])
        number = np.empty(len(known), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(known)) * n_shards + key[0].as_py() + 1
        number[np.bincount(place, minlength=len(known)) == 1] = 0
        ends = np.cumsum([len(k) for k in each])[:-1]
        data, ids = ([pack(x) for x in np.split(y[place], ends)] for y in (total, number))
        n = len(rows["batch"])
        return pa.table({"batch": rows["batch"], "shard": rows["shard"], "level": [WORDS] * n, "data": data, "ids": ids, "types": [int((total > 0).sum())] * n, "tokens": [int(total.sum())] * n}, schema=_TOLD)

    return run


def _ask_pairs(n_shards: int, texts: int, split: int):
    """A batch's distinct contexts, with their counts in the training texts, and successors, with the pairs' counts in it."""

    def run(key, table, told):
        if not table.num_rows:
            return _PAIRS.empty_table()
        batch = Batch(table)
        batch.learn(told, texts)
        return batch.pairs(n_shards, split).asked()

    return run


def _ask_triples(n_shards: int, texts: int, split: int, least: int):
    """As _ask_pairs, where the context is the two words before and has `least` training tokens."""

    def run(key, table, told):
        if not table.num_rows:
            return _PAIRS.empty_table()
        batch = Batch(table)
        batch.learn(told, texts)
        code, sole = batch.pairs(n_shards, split).told(told, PAIRS)
        return batch.triples(code, sole, least, n_shards, split).asked()

    return run


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All batches' keys of a shard: distinct ones, the sum of their counts, the place of each."""
    known, place = distinct(np.concatenate(keys))
    total = np.zeros(len(known), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return known, total, place


def _tell_pairs(level: int):
    """Builds a shard of the model and looks up in it what each batch asked for; SOLE for what it alone asked for."""

    def run(key, table):
        rows = table.to_pydict()
        contexts = [unpack_rising(c) for c in rows["contexts"]]
        sizes = [unpack(x).astype(np.int64) for x in rows["sizes"]]
        successors = [from_steps(unpack(x), n) for x, n in zip(rows["successors"], sizes)]
        counts = np.concatenate([unpack(x) for x in rows["counts"]]).astype(np.int64)
        every, number = distinct(np.concatenate(contexts))
        whole = np.zeros(len(every), np.int64)
        whole[number] = np.concatenate([unpack(x) for x in rows["totals"]])  # the same from every batch
        pair, place = distinct(np.repeat(number, np.concatenate(sizes)).astype(_U) << _U(WORD_BITS) | np.concatenate(successors))
        total = np.bincount(place, counts, len(pair)).astype(np.int64)
        own, word = (pair >> _U(WORD_BITS)).astype(np.int64), pair & _U((1 << WORD_BITS) - 1)
        seen = total > 0
        held = np.bincount(own[seen], minlength=len(every))
        trie = NgramTrie(every[held > 0], held[held > 0], word[seen], smoothed(total[seen], whole[own[seen]], PRIORS[level]))
        codes = np.minimum(trie.lookup(every, np.bincount(own, minlength=len(every)), word), SOLE - 1)
        codes[np.bincount(place, minlength=len(pair)) == 1] = SOLE
        data = [pack(x) for x in np.split(codes[place], np.cumsum([len(w) for w in successors])[:-1])]
        n = len(data)
        return pa.table({"batch": rows["batch"], "shard": rows["shard"], "level": [level] * n, "data": data, "ids": [b""] * n, "types": [0] * n, "tokens": [0] * n}, schema=_TOLD)

    return run


def smoothed(n_pair: np.ndarray, n_before: np.ndarray, prior: float) -> np.ndarray:
    """A successor's own part of its probability after a context; prior / (n_before + prior) is left to the lower order."""
    return n_pair / (n_before + prior)


def coded(n_pair: np.ndarray, n_before: np.ndarray, prior: float) -> np.ndarray:
    """Codes of counts above 0, as a shard's trie would give them."""
    return np.minimum(quantise(smoothed(n_pair, n_before, prior)), SOLE - 1)


def unigram(n: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Probability with half a count for each type and one unknown."""
    return (n + 0.5) / (tokens + 0.5 * (types + 1))


def after(code: np.ndarray, n_before: np.ndarray, lower: np.ndarray, prior: float) -> np.ndarray:
    """Probability after a context: the trie's part, and what the context leaves times the lower order's. Over all words and
    one unknown it adds up to 1 where the lower order's does."""
    return dequantise(code) + prior / (n_before + prior) * lower


def _scores(n_shards: int, texts: int, split: int, least: int, totals: tuple[int, int], kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(key, docs, told):
        if not docs.num_rows:
            return schema.empty_table()
        batch = Batch(docs)
        batch.learn(told, texts)
        n, n_before = batch.n, batch.n_before
        code, sole = batch.pairs(n_shards, split).told(told, PAIRS)
        alone = unigram(n, *totals)
        model = after(code, n_before, alone, PRIORS[PAIRS])
        triples = batch.triples(code, sole, least, n_shards, split)
        model[triples.at] = after(triples.told(told, TRIPLES)[0], triples.n_before, model[triples.at], PRIORS[TRIPLES])
        sums = [np.add.reduceat(x, batch.starts) for x in ((n > 0).astype(np.int64), np.log10(alone), np.log10(model))]
        return pa.table([batch.ids.cast(kind), batch.held_out, batch.sizes, sums[0], np.full(len(batch.sizes), totals[0]), sums[1], sums[2]], schema=schema)

    return run


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`.

    Tokens are words (runs of characters other than space and U+0009 to U+000D, A-Z lower-cased) and an end. The model
    learns from the rows where `held_out` is false, in three levels: p(w) with half a count for each; after a word v,
    (n(v, w) + a * p(w)) / (n(v) + a); after the two words u, v, where these are a context (CONTEXT_COUNT),
    (n(u, v, w) + b * p(w | v)) / (n(u, v) + b), elsewhere p(w | v); PRIORS holds a and b. The tries' parts are quantised;
    over all words and one unknown each level adds up to 1 but for that. A null or empty text is an end alone; repeated
    rows count and are scored each; with no training rows all tokens are unknown. Other columns are not read.

    The rows of each partition form batches, read once: ranks of words in place of texts lie in a table. A batch asks for the
    training counts of its distinct words; with these for the probabilities of its distinct pairs; with these for those of its
    distinct triples. Shards of hashes add the counts of all batches up, build their tries and answer in the order asked. Words
    get numbers by frequency, which stand for them in what is asked. What one batch alone has is not asked about again: a pair
    with a word, or a triple with a pair, that no other batch holds is counted where it is. So a frequent word costs one entry
    for each batch; a frequent context is dealt over several shards by its successors; a shard that a batch has nothing for
    gets no row. Shuffled are ranks, once, packed questions and answers. Tasks hold one batch or one shard, whose numbers grow
    with the corpus.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType
    tokens = f"batch long, bytes long, texts long, ids array<{kind.simpleString()}>, held binary, sizes binary, words binary, ranks binary, places binary"
    docs = settled(docs.mapInArrow(_encode(to_arrow_type(kind)), tokens), maxRecordsPerFile=FILE_BATCHES)
    n_batches, size, texts = docs.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "texts"))).first()
    n_batches, n_shards = max(1, n_batches), 1 + size // SHARD_BYTES
    words = docs.mapInArrow(_ask_words(n_shards), ddl(_WORDS))
    words = settled(words.groupBy("shard").applyInArrow(_tell_words(n_shards), ddl(_TOLD)))
    totals = words.select("shard", "tokens", "types").distinct().agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    docs, words = docs.drop("words").repartition(n_batches, "batch"), words.repartition(n_batches, "batch")
    pairs = docs.groupBy("batch").cogroup(words.groupBy("batch")).applyInArrow(_ask_pairs(n_shards, texts, SPLIT_TOKENS), ddl(_PAIRS))
    told = words.union(pairs.groupBy("shard").applyInArrow(_tell_pairs(PAIRS), ddl(_TOLD)).repartition(n_batches, "batch"))
    least = CONTEXT_COUNT if CONTEXT_TOKENS is None else max(CONTEXT_COUNT, totals[0] // CONTEXT_TOKENS)
    triples = docs.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_ask_triples(n_shards, texts, SPLIT_TOKENS, least), ddl(_PAIRS))
    told = told.union(triples.groupBy("shard").applyInArrow(_tell_pairs(TRIPLES), ddl(_TOLD)).repartition(n_batches, "batch"))
    out = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_scores(n_shards, texts, SPLIT_TOKENS, least, tuple(totals), to_arrow_type(kind)), out)


def lm_report(docs: DataFrame) -> DataFrame:
    """score_documents with the rows held out whose crc32 of doc_id as text is 1 modulo 5."""
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
