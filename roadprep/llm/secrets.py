"""Secret scans: fixed patterns, and a character convolutional network over every candidate with its surroundings."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadprep.llm.shards import joined, slices, word_spans

KINDS = ("assign", "access", "hex")
#: Rounds over all training windows. In each, every piece of about PIECE_WINDOWS windows is learned from in a task.
ROUNDS = 12
PIECE_WINDOWS = 4_096
#: Parts of the windows, in twentieths by a hash: the first are learned from, then those that calibrate, set thresholds, measure.
PARTS = (12, 15, 18, 20)
#: Steps of one in the output, by which calibration and thresholds count windows; outputs beyond OUTER count as that.
STEPS, OUTER = 64, 30
#: Windows of each label that it is trained on at least: where the documents have fewer, made-up ones are added.
FILL_CANDIDATES = 240
#: Share of held-out findings that the threshold has to keep.
RECALL = 0.98
#: Labelled windows of each label below which `train` fits nothing; `fit` always fills up to more than that.
LEAST_FINDINGS = 24
#: A candidate is a run of value characters of this length with a letter and a digit.
LEAST_CANDIDATE = 16
BEFORE, VALUE, AFTER = 20, 44, 8

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_HINTS = (b"passw", b"secret", b"token", b"api")
_SAME = bytes(range(256))


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_DIGIT = _class("0123456789")
_HEXDIGIT = _class("0123456789abcdef")
_LETTERS = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_VALUE = _DIGIT | _LETTERS | _class("+/_.=-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns, each leftmost and without overlaps in its kind, too short ones dropped."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def findings(texts: list[str | None]) -> list[tuple[list[tuple[str, int, int]], list[tuple[int, int]]]]:
    """For each text the base spans and the candidates' spans, in code points.

    The patterns run over a text only if a scan of its bytes shows a keyword's part, AKIA or 32 hex digits in a row.
    """
    raw = [(t or "").encode() for t in texts]
    data, bounds = joined(raw, _SAME)
    out: list = [([], []) for _ in texts]
    if not texts:
        return out
    starts, ends = word_spans(data, _HEXDIGIT)
    hexed = np.searchsorted(bounds, starts[ends - starts >= 32], "right") - 1
    flagged = set(hexed.tolist())
    for i, b in enumerate(raw):
        low = b.lower()
        if b"AKIA" in b or any(h in low for h in _HINTS):
            flagged.add(i)
    for i in flagged:
        out[i][0].extend(base_spans(texts[i]))
    starts, ends = word_spans(data, _VALUE)
    long = ends - starts >= LEAST_CANDIDATE
    starts, ends = starts[long], ends[long]
    for table in (_DIGIT, _LETTERS):
        before = _running(table[data])
        has = before[ends] > before[starts]
        starts, ends = starts[has], ends[has]
    # candidates are ASCII: bytes are code points inside them; before them, a code point has one byte that continues none
    owner = np.searchsorted(bounds, starts, "right") - 1
    points = _running((data & 0xC0) != 0x80)
    first = points[starts] - points[bounds[owner]]
    for i, a, n in zip(owner.tolist(), first.tolist(), (ends - starts).tolist()):
        out[i][1].append((a, a + n))
    return out


def _running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def apart(candidates: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The candidates that no base span overlaps; `base` is sorted by start."""
    if not base or not candidates:
        return candidates
    starts = np.array([s[1] for s in base])
    ends = np.maximum.accumulate([s[2] for s in base])  # the farthest end of the spans so far
    spans = np.array(candidates)
    k = np.searchsorted(starts, spans[:, 1], "left")  # spans that begin before a candidate's end
    hit = (k > 0) & (ends[np.maximum(k - 1, 0)] > spans[:, 0])
    return [c for c, h in zip(candidates, hit.tolist()) if not h]


def value_span(text: str, span: tuple[str, int, int]) -> tuple[int, int]:
    """Where the secret itself stands in a base span."""
    if span[0] == "assign" and (m := _ASSIGN.match(text, span[1])):
        return m.span(2)
    return span[1], span[2]


def encode_window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the characters before, in and after a candidate, each part at a fixed place.

    0 is padding, 1 to 95 printable ASCII, 96 white space, 97 other; a candidate longer than VALUE keeps both its ends
    (the network's view; the span itself stays whole).
    """
    value = text[start:end]
    if len(value) > VALUE:
        value = value[: VALUE // 2] + value[-(VALUE // 2) :]
    view = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + value.ljust(VALUE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    codes = np.frombuffer(view.encode("utf-32-le"), np.uint32)
    return np.where(codes == 0, 0, np.where((codes == 32) | ((codes >= 9) & (codes <= 13)), 96, np.where((codes > 32) & (codes < 127), codes - 31, 97))).astype(np.uint8)


def encode_windows(text: str, places: list[tuple[int, int]]) -> np.ndarray:
    """encode_window of many candidates of one text, a row for each."""
    if len(places) < 8:
        return np.stack([encode_window(text, a, b) for a, b in places]) if places else np.zeros((0, BEFORE + VALUE + AFTER), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.where((points == 32) | ((points >= 9) & (points <= 13)), 96, np.where((points > 32) & (points < 127), points - 31, np.where(points == 0, 0, 97))).astype(np.uint8)
    start, end = np.array(places).T[..., None]
    long, j = end - start > VALUE, np.arange(VALUE)
    value = np.where(long & (j >= VALUE // 2), end - VALUE + j, start + j)
    at = np.concatenate([start - BEFORE + np.arange(BEFORE), np.where(long | (value < end), value, -1), end + np.arange(AFTER)], axis=1)
    inside = (at >= 0) & (at < len(codes))
    return np.where(inside, codes[np.where(inside, at, 0)], 0).astype(np.uint8)


def shape(codes: np.ndarray) -> np.ndarray:
    """What a candidate's value is made of: 0 hex digits in lower case, 1 capitals and digits, 2 anything else."""
    v = codes[:, BEFORE : BEFORE + VALUE].astype(np.int64) + 31
    plain = (v == 31) | ((v >= 48) & (v <= 57))
    hexed, capital = (plain | ((v >= a) & (v <= b)) for a, b in ((97, 102), (65, 90)))
    return np.where(hexed.all(1), 0, np.where(capital.all(1), 1, 2))


@dataclass
class CharCNN:
    """Embedding, one convolution, mean over the value and maximum over its surroundings, logistic output."""

    embed: np.ndarray  # 98 x e
    kernel: np.ndarray  # (width * e) x filters
    bias: np.ndarray
    out: np.ndarray  # 2 * filters + 1
    scale: tuple[float, float] = (1.0, 0.0)  # calibration of the logit
    thresholds: tuple[float, ...] = (1.1, 1.1, 1.1)  # by shape
    measured: tuple[float, float] = (0.0, 0.0)  # recall and precision on findings and candidates kept for that alone
    seen: int = 0  # windows that it was fitted on, calibrated, given thresholds or measured with

    WIDTH = 5

    @classmethod
    def fresh(cls, rng, size: int = 10, filters: int = 24) -> CharCNN:
        return cls(rng.normal(0, 0.3, (98, size)), rng.normal(0, 0.2, (cls.WIDTH * size, filters)), np.zeros(filters), rng.normal(0, 0.1, 2 * filters + 1))

    def forward(self, codes: np.ndarray):
        x = self.embed[codes] * (codes > 0)[..., None]
        n, length, e = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n * (length - self.WIDTH + 1), self.WIDTH * e)
        act = np.maximum(view @ self.kernel + self.bias, 0).reshape(n, length - self.WIDTH + 1, -1)
        inside = slice(BEFORE, BEFORE + VALUE - self.WIDTH + 1)
        outside = np.r_[0 : BEFORE - self.WIDTH + 1, BEFORE + VALUE : act.shape[1]]
        pooled = np.concatenate([act[:, inside].mean(1) * 3, act[:, outside].max(1), np.ones((n, 1))], axis=1)
        return view, act, inside, outside, pooled, pooled @ self.out

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """The output alone: what a character adds at each place of the kernel is looked up, in single precision."""
        embed = self.embed * (np.arange(len(self.embed)) > 0)[:, None]
        tables = [(embed @ k).astype(np.float32) for k in np.split(self.kernel, self.WIDTH)]
        steps = codes.shape[1] - self.WIDTH + 1
        outside = np.r_[0 : BEFORE - self.WIDTH + 1, BEFORE + VALUE : steps]
        bias, out, rows = self.bias.astype(np.float32), self.out.astype(np.float32), [np.zeros(0, np.float32)]
        for i in range(0, len(codes), 256):
            part = codes[i : i + 256]
            act = bias + tables[0][part[:, :steps]]
            for k in range(1, self.WIDTH):
                act += tables[k][part[:, k : k + steps]]
            np.maximum(act, 0, out=act)
            pooled = np.concatenate([act[:, BEFORE : BEFORE + VALUE - self.WIDTH + 1].mean(1) * 3, act[:, outside].max(1)], axis=1)
            rows.append(pooled @ out[:-1] + out[-1])
        return np.concatenate(rows)

    def of_output(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * np.asarray(z, float) + self.scale[1], -OUTER, OUTER)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.of_output(self.logits(codes))

    def accepts(self, codes: np.ndarray) -> np.ndarray:
        return self.probability(codes) >= np.array(self.thresholds)[shape(codes)]

    def step(self, codes: np.ndarray, y: np.ndarray, adam: dict, rate: float) -> None:
        view, act, inside, outside, pooled, z = self.forward(codes)
        n, steps, filters = act.shape
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g_pool = d[:, None] * self.out[None, :]
        g_act = np.zeros_like(act)
        g_act[:, inside] += (g_pool[:, :filters] * 3 / (inside.stop - inside.start))[:, None, :]
        where = outside[act[:, outside].argmax(1)]
        rows, cols = np.arange(n)[:, None], np.arange(filters)[None, :]
        g_act[rows, where, cols] += g_pool[:, filters : 2 * filters]
        g_act = (g_act * (act > 0)).reshape(n * steps, filters)
        g_view = (g_act @ self.kernel.T).reshape(n, steps, self.WIDTH, -1)
        g_x = np.zeros((*codes.shape, self.embed.shape[1]))
        for k in range(self.WIDTH):
            g_x[:, k : k + steps] += g_view[:, :, k]
        g_embed = np.zeros_like(self.embed)
        np.add.at(g_embed, codes, g_x * (codes > 0)[..., None])
        adam["t"] = adam.get("t", 0) + 1
        for name, g in (("embed", g_embed), ("kernel", view.T @ g_act), ("bias", g_act.sum(0)), ("out", pooled.T @ d)):
            m, v = adam.get(name, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            adam[name] = m, v
            setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(v / (1 - 0.999 ** adam["t"])) + 1e-8))


def learned(model: CharCNN, codes: np.ndarray, labels: np.ndarray, k: int, rng) -> CharCNN:
    """The model after round k over these windows; steps get shorter from round to round.

    Half of the findings are shown once more with the text around an unlabelled candidate, so that a value is known by
    itself.
    """
    model, adam = replace(model), {}
    x, y = codes, labels.astype(float)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if len(good) and len(bad):
        masked = x[rng.choice(good, -(-len(good) // 2), replace=False)]
        other = x[rng.choice(bad, len(masked))]
        masked[:, :BEFORE], masked[:, BEFORE + VALUE :] = other[:, :BEFORE], other[:, BEFORE + VALUE :]
        x, y = np.concatenate([x, masked]), np.concatenate([y, np.ones(len(masked))])
    for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
        model.step(x[i], y[i], adam, 0.01 * (1 - k / ROUNDS))
    return model


def outputs(model: CharCNN, codes: np.ndarray, labels: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Distinct (part, label, shape, step of the output) rows and how many windows have each."""
    steps = np.floor(np.clip(model.logits(codes).astype(float), -OUTER, OUTER) * STEPS).astype(np.int64)
    rows, n = np.unique(np.stack([parts, labels, shape(codes), steps], axis=1).astype(np.int64), axis=0, return_counts=True)
    return np.column_stack([rows, n])


def calibrated(model: CharCNN, counts: np.ndarray, recall: float = RECALL) -> CharCNN:
    """The model with scale, thresholds and measures from `outputs` of all windows of the parts 1, 2 and 3.

    The threshold of each shape of value is the highest step of the output that keeps `recall` of its findings in part 2,
    of all findings where it has fewer than 20.
    """
    part, label, kind, step, n = counts.T
    own = part == 1
    z, t, w = (step[own] + 0.5) / STEPS, label[own], n[own] / max(1, n[own].sum())
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt scaling with a pull to the identity
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = a - 0.05 * (((p - t) * z * w).sum() + 0.01 * (a - 1)), b - 0.05 * (((p - t) * w).sum() + 0.01 * b)
    true = (part == 2) & (label == 1)

    def lowest(own: np.ndarray) -> int:
        order = own[np.argsort(step[own], kind="stable")]
        return int(step[order[np.searchsorted(np.cumsum(n[order]), int((1 - recall) * n[own].sum()), "right")]])

    each = [np.flatnonzero(true & (kind == k)) for k in range(3)]
    least = np.array([lowest(x if n[x].sum() >= 20 else np.flatnonzero(true)) for x in each])
    edge = np.where(least > -OUTER * STEPS, least / STEPS, -np.inf)
    model = replace(model, scale=(float(max(a, 0.05)), float(b)))
    good, known = (part == 3) & (step >= least[kind]), (part == 3) & (label == 1)
    both = n[good & known].sum()
    return replace(model, thresholds=tuple(model.of_output(edge).tolist()), measured=(float(both / max(1, n[known].sum())), float(both / max(1, n[good].sum()))), seen=model.seen + int(n.sum()))


def train(codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, seed: int = 7) -> CharCNN | None:
    """Fits on 60 % of the labelled candidates; 15 % calibrate the output, 15 % set the thresholds, 10 % measure the result.
    None if there are too few of either label."""
    if labels.sum() < LEAST_FINDINGS or (1 - labels).sum() < LEAST_FINDINGS:
        return None
    rng, parts = np.random.default_rng(seed), np.zeros(len(labels), np.int64)
    for k in (0, 1):  # both labels in all parts
        own = rng.permutation(np.flatnonzero(labels == k))
        parts[own] = np.searchsorted(PARTS, np.arange(len(own)) * PARTS[-1] // len(own), "right")
    model = CharCNN.fresh(rng)
    for k in range(ROUNDS):
        model = learned(model, codes[parts == 0], labels[parts == 0], k, rng)
    rest, model = parts > 0, replace(model, seen=int((parts == 0).sum()))
    return calibrated(model, outputs(model, codes[rest], labels[rest], parts[rest]), recall)


def _packed(key, table):
    """A piece in one row, its windows in an order of their own."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("label", "codes", "part"))))
    columns = b"".join(r[1] for r in rows), bytes(r[0] for r in rows), bytes(r[2] for r in rows)
    return pa.table({"piece": [key[0].as_py()], **{c: [x] for c, x in zip(("codes", "labels", "parts"), columns)}}, schema=_PIECE)


_PIECE = pa.schema([("piece", pa.int64()), ("codes", pa.binary()), ("labels", pa.binary()), ("parts", pa.binary())])


def _pieces(batches):
    """(piece, codes, labels, parts) of each row of `_packed`."""
    for batch in batches:
        for r in batch.to_pylist():
            labels, parts = (np.frombuffer(r[c], np.uint8).astype(np.int64) for c in ("labels", "parts"))
            yield r["piece"], np.frombuffer(r["codes"], np.uint8).reshape(len(labels), -1), labels, parts


def train_on_all(windows: DataFrame, n: int, recall: float = RECALL, seed: int = 7) -> CharCNN:
    """As `train`, for `n` rows of label and codes of any number, all of which are learned from or counted.

    Rows fall into pieces and parts by a hash. A round is a job: each piece is learned from in a task, the next round starts
    from the mean of what they have learned, weighted by their windows. Tasks add up whole numbers, so that the order of
    rows, tasks and sums makes no difference. The driver holds a model for each task.
    """
    spark = windows.sparkSession
    part = F.pmod(F.xxhash64("codes", F.lit("part")), F.lit(PARTS[-1]))
    part = sum(((part >= at).cast("int") for at in PARTS[:-1]), F.lit(0))
    piece = F.pmod(F.xxhash64("codes"), F.lit(1 + n // PIECE_WINDOWS))
    rows = windows.select("label", "codes", part.alias("part"), piece.alias("piece"))
    pieces = rows.groupBy("piece").applyInArrow(_packed, "piece long, codes binary, labels binary, parts binary").persist()
    model = CharCNN.fresh(np.random.default_rng(seed))
    names = ("embed", "kernel", "bias", "out")
    try:
        for k in range(ROUNDS):
            shared = spark.sparkContext.broadcast(model)

            def run(batches, k=k, shared=shared):
                total = weight = 0
                for number, codes, labels, parts in _pieces(batches):
                    own = parts == 0
                    if own.any():
                        new = learned(shared.value, codes[own], labels[own], k, np.random.default_rng([seed, k, number]))
                        flat = np.concatenate([getattr(new, x).ravel() for x in names])
                        total, weight = total + np.rint(flat * (1 << 24)).astype(np.int64) * int(own.sum()), weight + int(own.sum())
                if weight:
                    yield pa.RecordBatch.from_pydict({"weight": pa.array([weight], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

            total = weight = 0
            for r in pieces.mapInArrow(run, "weight long, total binary").collect():
                total, weight = total + np.frombuffer(r.total, np.int64), weight + r.weight
            shared.destroy()
            if weight:
                old = [getattr(model, x) for x in names]
                new = np.split(total / weight / (1 << 24), np.cumsum([x.size for x in old])[:-1])
                model = replace(model, **{x: v.reshape(o.shape) for x, v, o in zip(names, new, old)}, seen=weight)

        def counted(batches):
            for _, codes, labels, parts in _pieces(batches):
                rest = parts > 0
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in outputs(model, codes[rest], labels[rest], parts[rest]).T], names=["part", "label", "kind", "step", "n"])

        found = pieces.mapInArrow(counted, "part long, label long, kind long, step long, n long")
        counts = found.groupBy("part", "label", "kind", "step").agg(F.sum("n")).orderBy("part", "label", "kind", "step").collect()
    finally:
        pieces.unpersist()
    return calibrated(model, np.array([list(r) for r in counts]), recall)


def made_up(label: int, n: int, seed: int = 11) -> list[bytes]:
    """Windows that stand in for labels that the documents lack: the prior of a corpus with few of them.

    Findings are the patterns' own forms with values drawn evenly (an assignment, an access key, hex digits); others
    are words and numbers joined as in names of files, hosts and identifiers.
    """
    rng = np.random.default_rng(seed + label)
    words = "the page main user data file site week list order image index value report story public summer number".split()

    def drawn(chars: str, least: int, most: int) -> str:
        return "".join(rng.choice(list(chars), rng.integers(least, most + 1)))

    out = []
    for k in range(n):
        before, after = (" ".join(rng.choice(words, 3)) for _ in range(2))
        if not label:
            parts = [*rng.choice(words, rng.integers(3, 7)), str(rng.integers(1, 3000))]
            value = str(rng.choice(list("./_-"))).join(parts[i] for i in rng.permutation(len(parts))).ljust(LEAST_CANDIDATE, "s")
        elif k % 3 == 0:
            before += f" {rng.choice(['password', 'secret', 'token', 'api_key'])}{rng.choice([' = ', ': ', '='])}"
            value = drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", LEAST_CANDIDATE, 40)
        else:
            value = "AKIA" + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 16) if k % 3 == 1 else drawn("0123456789abcdef", 32, 64)
        before += "" if label and k % 3 == 0 else " "
        out.append(encode_window(f"{before}{value} {after}", len(before), len(before) + len(value)).tobytes())
    return out


def fit(docs: DataFrame, text_col: str = "text", most: int | None = None) -> CharCNN | None:
    """Labels by the patterns: base findings against other candidates of all documents, every distinct window of them.

    Windows are made by the tasks and stay there (`train_on_all`); with `most`, the network is trained on the driver on that
    many of each label by a hash. A label with fewer than FILL_CANDIDATES is filled up with made-up windows. None only if
    no document has a finding or a candidate: then there is nothing that a network could find.
    """

    def windows(batches):
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            kept: set[tuple[int, bytes]] = set()
            for t, (base, candidates) in zip(texts, findings(texts)):
                for label, places in ((1, [value_span(t, s) for s in base]), (0, apart(candidates, base))):  # t is null: neither
                    kept.update((label, w.tobytes()) for w in encode_windows(t, places))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.binary())], names=["label", "codes"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(windows, "label int, codes binary").distinct().persist()
    try:
        counts = {r.label: r.n for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return None
        rows = [(label, w) for label in (0, 1) for w in made_up(label, FILL_CANDIDATES - min(counts.get(label, 0), most or FILL_CANDIDATES))]
        if most is None:
            made = docs.sparkSession.createDataFrame(rows, "label int, codes binary")
            return train_on_all(found.union(made), sum(counts.values()) + len(rows))
        rows += [(r.label, bytes(r.codes)) for label in (0, 1) for r in found.filter(F.col("label") == label).orderBy(F.xxhash64("codes"), "codes").limit(most).collect()]
        return train(np.stack([np.frombuffer(r[1], np.uint8) for r in rows]), np.array([r[0] for r in rows]))
    finally:
        found.unpersist()


def spans(texts: list[str | None], model: CharCNN | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; what only the network finds has the kind cnn.

    Every candidate that no base span overlaps is scored, those of many texts at once; candidates don't overlap each
    other. Time and memory are linear in the texts.
    """
    found = findings(texts)
    out = [(base, list(base)) for base, _ in found]
    waiting: list[tuple[int, list[tuple[int, int]]]] = []

    def score():
        if waiting:
            good = model.accepts(np.concatenate([encode_windows(texts[i], places) for i, places in waiting]))
            rows = [(i, a, b) for i, places in waiting for a, b in places]
            for k in np.flatnonzero(good).tolist():
                out[rows[k][0]][1].append(("cnn", *rows[k][1:]))
            waiting.clear()

    if model is not None:
        for i, (base, candidates) in enumerate(found):
            places = apart(candidates, base)
            if places:
                waiting.append((i, places))
            if sum(len(p) for _, p in waiting) >= 4_096:
                score()
        score()
    for _, every in out:
        every.sort(key=lambda x: (x[1], (*KINDS, "cnn").index(x[0])))
    return out


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by `mark`."""
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def measured(docs: DataFrame, text_col: str = "text") -> tuple[float, float]:
    """Recall and precision of the network on labelled windows of `docs` that nothing else was fitted on: of the patterns'
    findings against the other candidates, by which it has learned. (0, 0) if nothing was learned."""
    model = fit(docs, text_col)
    return model.measured if model is not None else (0.0, 0.0)


def secret_report(docs: DataFrame, model: CharCNN | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_cnn for each row; the network is fitted if not given.

    Null texts are empty. An empty table gives no rows and trains nothing; repeated rows stay rows; other columns are
    not read. Map-only but for the training windows, which are taken from all documents in a pass of its own.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)

    def run(batches):
        for part in slices(batches):
            found = spans(part.column("text").to_pylist(), shared.value)
            counts = [pa.array([sum(s[0] == k for s in f[1]) for f in found], pa.int64()) for k in (*KINDS, "cnn")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, *(pa.array([listed(f[k]) for f in found], pa.string()) for k in (0, 1))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_cnn long, base string, spans string")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_cnn")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span found in text_col replaced by a mark; rows, order of columns and other values stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col))
    schema = docs.schema

    def run(batches):
        for part in slices(batches, text_col):
            texts = part.column(text_col).to_pylist()
            clean = [t if t is None else redact(t, f[1]) for t, f in zip(texts, spans(texts, shared.value))]
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    return docs.mapInArrow(run, schema)
