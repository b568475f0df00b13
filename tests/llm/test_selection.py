"""Resampling, spelling variants, shards and the choice of one row among near copies, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import TRICKY, documents, empty, shuffled_words
from pyspark.sql import functions as F

from roadprep.llm import jaccard, resample, scratch, sharding, variants

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# -- resampling


def drawn_by_hand(rows, target, order, buckets, share=10, least=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall(low(text))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)], len(w)

    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in features(x)[0])
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, f, n in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    long = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(long[: share * len(long) // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("order", [1, 2])
def test_resampling_equals_brute_force(spark, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ÄÖ äö Z9 9z")], "doc_id long, text string"))
    got = resample.resample(rows.repartition(7), target, buckets=97, order=order, share=30)
    expected = drawn_by_hand([tuple(r) for r in rows.collect()], [r.text for r in target.collect()], order, 97, 30)
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert sum(r[4] is not None for r in expected) > 20


def test_draw_with_ties_and_repeats(spark):
    rows = [(i, 5, 20 + (i % 3 > 0), 1, 100 * (i % 4)) for i in range(60)] + [(None, 5, 30, 1, 300), (3, 5, 30, 1, 300)]
    table = spark.createDataFrame(rows, "doc_id long, n_features long, n_words long, weight long, score long")
    got = resample.with_draw(table, share=50, min_words=21).collect()
    pool = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[2] >= 21)
    ranks = {r.rank: (-r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None}
    assert [ranks[k + 1] for k in range(len(ranks))] == pool[: len(pool) // 2] and len(got) == len(rows)
    assert resample.with_draw(table, share=1, min_words=99).filter("rank IS NOT NULL").isEmpty()


def test_resampling_of_odd_rows(spark):
    target = documents(spark)
    out = resample.resample(documents(spark), target)
    assert Counter(r.doc_id for r in out.collect()) == Counter([*range(len(TRICKY)), 0, None])
    assert out.filter("doc_id = 0").select("n_features", "weight").distinct().collect() == [(0, 0)]
    assert resample.resample(empty(spark), target).count() == 0 and resample.resample(documents(spark), target.limit(0)).count() == len(TRICKY) + 2
    kept = resample.drawn_documents(documents(spark), target, min_words=1, share=50)
    assert kept.columns == documents(spark).columns and 0 < kept.count() < len(TRICKY) + 2


def test_features_that_are_not_remembered(monkeypatch):
    monkeypatch.setattr(resample, "KNOWN_FEATURES", 3)
    of = resample.Buckets(1000)
    words = shuffled_words(5, 200) + ["x" * 100]
    at, features, n = of.of([" ".join(words), None, ""], 3)
    assert features.tolist() == [201 + 200 + 199, 0, 0] and n.tolist() == [201, 0, 0] and len(of) <= 3
    assert at[:201].tolist() == [zlib.crc32(w.encode()) % 1000 for w in words]


# -- spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def variants_by_hand(rows, least=3):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[a-zÀ-ÿ]+", low(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 5
    count = {w: n for w, n in count.items() if n >= least}
    beside = defaultdict(list)
    for a, b in itertools.combinations(count, 2):
        if near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    form = {w: min(beside[w], key=lambda v: (-count[v], v)) for w in count if beside[w]}
    form = {w: v for w, v in form.items() if count[v] >= 2 * count[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(beside[w]), count.get(form.get(w))) for w, n in count.items())


def test_variants_equal_brute_force(spark):
    r = random.Random(3)
    bases = ["reference", "aabbaabb", "zürich", "b" * 70, "ab" * 32, "ab" * 32 + "a", "over÷×y"]
    texts = []
    for i in range(400):
        words = [r.choice(bases) for _ in range(r.randrange(1, 12))]
        if i % 2:
            k, w = r.randrange(len(words)), ""
            w = words[k]
            p, c = r.randrange(len(w)), r.choice("abzé")
            words[k] = r.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :]])
        texts.append(r.choice([" ", "-", "9"]).join(words).title() if i % 3 else ", ".join(words))
    texts += [" ".join(["aaaaa"] * 50), "aaaab " * 20 + "aaabb " * 8 + "aabbb " * 4 + "abbbb " * 3, None, ""]
    docs = frame(spark, texts).union(spark.createDataFrame([(None, "aaabb reference"), (0, texts[0])], "doc_id long, text string"))
    got = sorted(tuple(x) for x in variants.spelling_variants(docs.repartition(5)).collect())
    assert got == variants_by_hand([tuple(x) for x in docs.collect()])
    assert any(x[2] not in (x[0], x[1]) for x in got) and any(len(x[0]) > 64 and x[4] for x in got)


def test_variants_stream_over_small_batches(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD_WORDS", 5)
    docs = frame(spark, [" ".join(shuffled_words(i, 60, 200)) + " " + " ".join(w + "xx" for w in shuffled_words(i, 60, 200)) for i in range(30)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(tuple(x) for x in variants.spelling_variants(docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == variants_by_hand([tuple(x) for x in docs.collect()]) and sum(x[4] for x in got) > 100


def test_equal_keys_of_other_strings_are_told_apart():
    rows = [(0, "xabcd", 5), (0, "yabcd", 9), (1, "qqqqq", 7), (-1, "abcd", 4), (0, "unlike", 3)]
    assert sorted(variants._group(rows)) == [("abcd", 2, 9, "yabcd"), ("xabcd", 1, 4, "abcd"), ("xabcd", 1, 9, "yabcd"), ("yabcd", 1, 4, "abcd"), ("yabcd", 1, 5, "xabcd")]


def test_deletion_keys_are_those_of_the_strings():
    words = ["reference", "aabbaa", "éèêë", "b" * 300]
    keys, owner, at = variants.deletion_keys(words)
    assert len(keys) == len(words) + sum(map(len, words))
    cut = [words[o] if p < 0 else words[o][:p] + words[o][p + 1 :] for o, p in zip(owner.tolist(), at.tolist())]
    alone = dict(zip(cut, keys.tolist()))
    assert all(alone[c] == k for c, k in zip(cut, keys.tolist())) and len(set(keys.tolist())) == len(set(cut))
    again, _, where = variants.deletion_keys(cut)
    assert again[where < 0].tolist() == keys.tolist()


def test_variants_of_odd_rows(spark):
    got = {r.word: r.n for r in variants.spelling_variants(documents(spark), min_count=1).collect()}
    assert got["twice"] == 2 and got["wörds"] == 1 and "日本語" not in got
    assert variants.spelling_variants(empty(spark)).count() == 0


# -- shards


def shards_by_hand(rows, shards=16, nodes=64):
    place = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    docs = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows]
    total, n, groups = sum(d[1] for d in docs), len(docs), defaultdict(list)
    for d in docs:
        groups[d[3]].append(d)
    slices = defaultdict(list)
    for key, own in groups.items():
        pieces = max(-(-sum(d[1] for d in own) * shards * 8 // total), -(-len(own) * shards * 8 // n))
        for d in own:
            name = f"{key}/{zlib.crc32(str('' if d[0] is None else d[0]).encode()) % pieces}" if pieces > 1 else key
            slices[place(name) >> 18].append(d)
    ring = sorted((place(f"{s}/{k}"), s) for s in range(shards) for k in range(nodes))
    size = {x: sum(d[1] for d in own) for x, own in slices.items()}
    left, open_, out = set(slices), set(range(shards)), {}
    while left:
        at = defaultdict(list)
        for x in left:
            live = [(p, s) for p, s in ring if s in open_]
            at[next((s for p, s in live if p >= x << 18), live[0][1])].append(x)
        mean, closing = sum(size[x] for x in left) / len(open_), []
        for s, own in at.items():
            if sum(size[x] for x in own) >= mean:
                closing.append(s)
                run = 0
                for x in sorted(own, key=lambda x: (-size[x].bit_length(), x)):
                    if run + size[x] / 2 <= mean or len(open_) == 1:
                        out[x] = s
                    run += size[x]
        open_ -= set(closing)
        left -= set(out)
    result = []
    for s in range(shards):
        own = [d for x in sorted(x for x in out if out[x] == s) for d in sorted(slices[x], key=lambda d: (d[0] is not None, d[0] or 0, d[2], d[1]))]
        result += [(d[0], d[1], d[2], "bytes", s, k, None) for k, d in enumerate(own)]
    return result


def test_shards_equal_brute_force(spark):
    r = random.Random(1)
    texts = ["x" * int(math.exp(r.uniform(0, 7))) + str(i) for i in range(900)] + ["a copy"] * 600 + ["another"] * 9 + [None] * 5 + ["", "ü" * 900]
    docs = frame(spark, texts).union(spark.createDataFrame([(None, "no id"), (3, texts[3])], "doc_id long, text string")).repartition(5)
    got = [tuple(x) for x in sharding.shard_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(shards_by_hand([tuple(x) for x in docs.collect()]), key=repr)


def test_shards_are_near_equal_gapless_and_keep_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    big = docs.union(docs.filter("doc_id % 9 = 0").select(F.col("doc_id") + 10**6, F.lit("the same text under many ids " * 40), "lang", "source", "n_chars"))
    for table, most in ((docs, 1), (big, 30)):
        rows = sharding.shard_documents(table).collect()
        load, slots, where = Counter(), defaultdict(list), defaultdict(set)
        for x in rows:
            load[x.shard] += x["size"]
            slots[x.shard].append(x.slot)
            where[x.text_crc32, x["size"]].add(x.shard)
        assert len(rows) == table.count() and len(load) == 16
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(load.values()) < 1.02 * min(load.values())
        assert sum(len(s) > 1 for s in where.values()) <= most  # a group over an eighth of a shard is cut


def test_a_shard_more_moves_little(spark):
    """Of what stays where it was, more than half: a new shard takes a seventeenth, the bound moves some more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = ({r.doc_id: r.shard for r in sharding.shard_documents(docs, n).collect()} for n in (16, 17))
    assert sum(one[i] == two[i] for i in one) > 0.5 * len(one)


def test_shards_of_odd_rows(spark):
    rows = sharding.shard_documents(documents(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter([*range(len(TRICKY)), 0, None]) and {r.law for r in rows} == {"bytes"}
    assert sharding.shard_documents(empty(spark)).count() == 0
    plan = sharding.shard_documents(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- one row of each group


def test_rows_are_kept_whatever_their_ids(spark):
    a, b, d, e = (" ".join(shuffled_words(k, 40)) for k in range(4))
    near_a = a.replace(a.split()[-1], "other")
    rows = [(7, a), (7, b), (3, d), (9, d), (9, e), (1, near_a), (None, d), (None, "a text without an id " * 3), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row_0 int")
    kept = jaccard.keep_first(docs, 70, 2)
    assert kept.columns == docs.columns
    assert sorted(r.row_0 for r in kept.collect()) == [1, 2, 4, 5, 7, 8, 9, 10]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        applicationId, master = "elsewhere", "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())
