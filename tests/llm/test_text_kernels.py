"""Numpy parts against brute force, without Spark."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from roadprep.llm import decontaminate, elias_fano, extract, jaccard, language, lm, pieces, secrets, shards, tokens
from roadprep.llm.queries import tokenizer

ALPHABET = [" ", "  ", "\n", "a", "the", "▁", "é", "\t", "\r", "<s>", "日", "\0", "x.", "▁▁", " \n", "ing", "tion", "😀", "1", "(", "##"]


def random_texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer())


def test_token_counts_equal_the_library(library):
    texts = random_texts(4000, 1) + ["", "word " * 5000]
    counter = tokens.WordCounter(tokenizer())
    assert counter.splits
    assert counter.count([None, *texts]) == [0, *(len(x) for x in library.encode(texts, num_threads=1))]


def test_pieces_equal_the_library_and_decode(library):
    texts = random_texts(4000, 2) + ["Many words, and more of them; thirteen-and-a-half (in all)."]
    codec = pieces.codec(tokenizer())
    ids, bounds = codec.encode(texts)
    for text, a, b, want in zip(texts, bounds[:-1], bounds[1:], library.encode(texts, num_threads=1)):
        assert ids[a:b].tolist() == want
        assert codec.decode(want) == text.replace("▁", " ")


def test_hashes_depend_on_the_word_only():
    data, bounds = shards.joined([b"ab abc ab", b"abc"], shards.ascii_lower_table())
    starts, ends = shards.word_spans(data, ~np.isin(np.arange(256), [32]))
    h = shards.hash_spans(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and bounds.tolist() == [0, 10, 14]


def test_windows_equal_brute_force():
    r = random.Random(3)
    words = ["w%d" % i for i in range(12)]
    items = [(str(i), " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(30)] + [("n", None)]
    texts = [" ".join(r.choice([*words, "zz"]) for _ in range(r.randint(0, 80))) for _ in range(60)] + [None, ""]
    texts += texts[:5]
    found = decontaminate.find_windows(texts, decontaminate.benchmark_windows(items, 4))
    for text, (n, starts, ends, got) in zip(texts, found):
        w = decontaminate.split_words(text)
        hit, names = [False] * len(w), set()
        for item, t in items:
            v = decontaminate.split_words(t)
            for i in range(max(min(len(v), 1), len(v) - 3)):
                win = v[i : i + 4]
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit[k : k + len(win)] = [True] * len(win)
                        names.add(item)
        covered = [False] * len(w)
        for a, b in zip(starts, ends):
            covered[a:b] = [True] * (b - a)
        assert (n, covered, got) == (len(w), hit, sorted(names))


def test_excise_and_merge():
    assert decontaminate.excise("One, TWO three. Four five!", [1, 3], [2, 4]) == "One,  three.  five!"
    assert decontaminate.merge_spans([5, 0, 2], [7, 3, 4]) == ([0, 5], [4, 7])


def test_elias_fano_and_trie():
    r = np.random.default_rng(0)
    for n, universe in ((0, 9), (1, 1), (50, 60), (3000, 1 << 32)):
        values = np.sort(r.integers(0, universe, n).astype(np.uint64))
        ef = elias_fano.EliasFano.build(values, universe)
        if n:
            assert (ef[np.arange(n)] == values).all()
        asked = r.integers(0, universe, 500).astype(np.uint64)
        assert (ef.successor(asked)[0] == np.searchsorted(values, asked)).all()
    pairs, counts = np.unique(np.stack([r.integers(1, 40, 5000), r.integers(0, 300, 5000)]), axis=1, return_counts=True)
    contexts, sizes = np.unique(pairs[0], return_counts=True)
    hashed = np.sort(r.integers(0, 1 << 63, 41).astype(np.uint64) * np.uint64(2))
    whole = np.bincount(pairs[0], counts)
    p = counts / (whole[pairs[0]] + 2.0)
    trie = elias_fano.NgramTrie(hashed[contexts], sizes, pairs[1].astype(np.uint64), p)
    exact = {(c, w): x for c, w, x in zip(*pairs.tolist(), p.tolist())}
    asked = sorted({(c, w) for c in range(41) for w in r.integers(0, 400, 90).tolist()})
    codes = trie.lookup(hashed, np.bincount([c for c, _ in asked], minlength=41), np.array([w for _, w in asked], np.uint64))
    for pair, x in zip(asked, elias_fano.dequantise(codes)):
        assert x == 0.0 if pair not in exact else abs(x / exact[pair] - 1) < 2e-4
    none = elias_fano.NgramTrie(hashed[:0], sizes[:0], np.zeros(0, np.uint64), p[:0])
    assert not none.lookup(hashed[:2], np.array([1, 1]), np.array([1, 2], np.uint64)).any()


def test_counts_above_one_byte_survive():
    counts = np.array([0, 1, 254, 255, 256, 10**9])
    assert (lm.read_counts(lm.small_counts(counts), len(counts)) == counts).all()
    for keys in ([5], [0, 1], [3, 1 << 40, (1 << 64) - 1], range(7, 10**6, 999)):
        keys = np.array(list(keys), np.uint64)
        assert (lm.unpack_rising(lm.pack_rising(keys)) == keys).all()


def test_packed_numbers_survive_and_are_small():
    r = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [1, 255, 256, 1 << 40], [(1 << 64) - 1, 0], r.integers(0, 1 << 63, 500), r.zipf(1.5, 5_000)):
        values = np.array(list(values), np.uint64)
        assert (lm.unpack(lm.pack(values)) == values).all()
    sizes = np.array([3, 1, 1_000, 2])
    words = np.concatenate([np.sort(r.choice(5_000, n, replace=False)) for n in sizes]).astype(np.uint64)
    assert (lm.from_steps(lm.steps(words, sizes), sizes) == words).all()
    assert len(lm.pack(lm.steps(words, sizes))) < 1.2 * len(words)


@pytest.mark.parametrize("shared, n_docs", [(0.0, 1000), (0.05, 10**6), (0.5, 10**5)])
def test_linked_sets_share_an_entry(shared, n_docs):
    r = np.random.default_rng(5)
    index, linked = jaccard.Index(1200, n_docs, shared), 0
    for _ in range(1500):
        n = int(r.integers(1, 40)) if r.random() < 0.5 else int(r.integers(20, 900))
        a = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        most = int(0.17 * n) + 1
        b = np.unique(np.concatenate([r.permutation(a)[r.integers(0, most + 1) :], r.integers(0, 1 << 64, r.integers(0, most + 1), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        union = len(a) + len(b) - common
        if len(b) and 100 * common >= 85 * union and common < union:
            linked += 1
            assert len(np.intersect1d(index.signatures(a), index.signatures(b)))
    assert linked > 200


def test_shingles_equal_brute_force():
    texts = [None, "", " ", "a", "A b", "a b c d", "a b c d a b c d", "A\tB c\x0bD e"]
    sizes = [len(s) for s in jaccard.shingle_sets(texts)]
    assert sizes == [0, 0, 0, 1, 1, 1, 4, 2]
    a, b = jaccard.shingle_sets(["A b", "a  B"])
    assert (a == b).all()


def test_base_secrets():
    text = 'xx PassWord: "abcd1234" token=short, secret: token: abcdefghijk AKIA' + "A" * 12 + " " + "0f" * 16 + " " + "0f" * 15
    got = [(k, text[a:b]) for k, a, b in secrets.base_spans(text)]
    assert got == [("assign", 'PassWord: "abcd1234'), ("access", "AKIA" + "A" * 12), ("hex", "0f" * 16)]
    assert [f[0] for f in secrets.findings([text, None, ""])] == [secrets.base_spans(text), [], []]
    assert secrets.redact(text, secrets.base_spans(text)).count("[SECRET]") == 3


def test_network_learns_what_secrets_look_like():
    r = random.Random(1)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    good = ["key is " + "".join(r.choice(chars) for _ in range(r.randint(24, 40))) + " so" for _ in range(300)]
    bad = ["write to " + ".".join(r.choice(["mail", "post", "web", "site7", "example"]) for _ in range(5)) + "1.com now" for _ in range(300)]
    spans = [re.search(r"[A-Za-z0-9.]{16,}", t).span() for t in good + bad]
    codes = np.stack([secrets.encode_window(t, *s) for t, s in zip(good + bad, spans)])
    labels = np.array([1] * 300 + [0] * 300)
    model = secrets.train(codes, labels)
    found = model.accepts(codes)
    assert min(model.measured) >= 0.9  # recall and precision on what it was neither fitted nor calibrated on
    assert found[:300].mean() > 0.9 and found[300:].mean() < 0.02
    assert secrets.train(codes[:3], labels[:3]) is None


def test_language_kernel_held_out():
    samples = {"en": "the of and to in is that for with this", "de": "der die und das ist nicht mit von auch für", "fr": "le la les des est que pour dans une avec"}
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(v.split()) for _ in range(40))) for k, v in samples.items() for _ in range(40)]
    bits = []
    for _, t in rows:
        x = np.zeros(language.BUCKETS, np.uint8)
        language.presence(t, x)
        bits.append(np.packbits(x))
    model = language.solve([k for k, _ in rows], np.array(bits))
    fresh = [(k, " ".join(r.choice(v.split()) for _ in range(25))) for k, v in samples.items() for _ in range(10)]
    got = model.predict([t for _, t in fresh] + [None, "", "123 !!"])
    assert [g[0] for g in got] == [k for k, _ in fresh] + ["und"] * 3
    assert all(0 <= g[1] <= 1 for g in got)
    assert language.solve([], np.zeros((0, language.BUCKETS // 8), np.uint8)).predict(["words"]) == [("und", 0.0)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="layout with-sidebar"><div id=sidebar>side</div>
<div class="post-12 content"><h1>T &amp; x</h1><!-- <p>gone</p> --><p>Hello <span class="ad-slot">AD</span> world<br>again
<p>two &lt;b&gt; <b>bold</b>!&nbsp;end<ul><li>one<li>two</ul><form>f<input></form><div class="comments"><p>c1</div></div></div><footer>f</footer></body></html>"""


def test_main_text_of_a_page():
    page = extract.Page(PAGE)
    assert page.tags[page.best()] == "div" and page.paths[page.best()] == extract.step(page.paths[page.parent[page.best()]], "div", ["content", "post"])
    assert page.text([]) == "T & x\n\nHello world again\n\ntwo <b> bold! end\n\none\n\ntwo"
    assert page.text(["/html/body/none"]) == page.text([])
    for broken in ("", "<", "plain words", "<p", "<div><p>a<div>b", "<script>x", "<!-- open", "</div></p>z", '<a href="x>y'):
        extract.Page(broken).text([])
    assert extract.Page("plain &amp; words").text([]) == "plain & words"


def test_crc_rule():
    assert zlib.crc32(b"123456789") == 0xCBF43926  # what crc32() of Spark gives for the same text


def test_hostile_pages_take_linear_time():
    import time

    for html in ('<a x="' * 170_000, "<div>" * 100_000 + "text", "<div class=a>" * 100_000 + "<p>text" + "</div>" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<!" * 500_000, '<script x="' * 90_000):
        began = time.perf_counter()
        extract.Page(html).text([])
        assert time.perf_counter() - began < 5


def test_tags_end_outside_quotes():
    found = [html[a:b] for html in ['<a t="x>y">1</a><b>2<!-- <i> --><script a="b>c"><p></script >4<c d=">5'] for a, b, *_ in extract.tokens(html)]
    assert found == ['<a t="x>y">', "</a>", "<b>", "<!-- <i> -->", '<script a="b>c"><p></script >', '<c d=">']


def test_main_text_of_made_pages():
    """Articles of known blocks among menus, adverts, forms and comments, in templates and nestings of all kinds."""
    import random

    r = random.Random(7)
    words = "time year people way day man thing woman life child world school state family student group country problem hand part".split()
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    for i in range(150):
        blocks = [sentence(5).rstrip(".")] + [" ".join(sentence(r.randint(12, 30)) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 8))]
        inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b.replace(' day ', ' <b>day</b> ')}</p>" for b in blocks[1:])
        around = r.choice(["<article>{}</article>", "<main><article class='post-{}'>{{}}</article></main>".format(i), "<div class='content'>{}</div>", "<div id=main><div class='body entry'>{}</div></div>", "<section><div><div class=story>{}</div></div></section>"])
        junk = ["<nav><ul><li><a href=#>Home</a><li>News</ul></nav>", "<div class='sidebar'><p>" + sentence(8) + "</p></div>", "<footer>All rights</footer>", "<form><label>Mail</label><input></form>", "<script>var a = '<p>no</p>';</script>", "<style>p {}</style>", "<div class=cookie-notice>" + sentence(6) + "</div>", "<div id=comments><p>" + sentence(15) + "</p></div>", "<div class='ad'>Buy</div>", "<!-- <p>hidden</p> -->"]
        r.shuffle(junk)
        k = r.randint(0, len(junk))
        html = f"<html><head><title>T</title></head><body>{''.join(junk[:k])}{around.format(inner)}{''.join(junk[k:])}</body></html>"
        assert extract.Page(html).text([]) == "\n\n".join(blocks), html


def test_language_margins_equal_a_dense_solution():
    r = np.random.default_rng(6)
    texts, labels = [], []
    for lang, alphabet in (("a", "abcde"), ("b", "cdefg"), ("c", "efghi")):
        for _ in range(12):
            texts.append(" ".join("".join(r.choice(list(alphabet), 4)) for _ in range(10)))
            labels.append(lang)
    grams = []
    for t in texts:
        out = np.zeros(language.BUCKETS, np.uint8)
        language.presence(t, out)
        grams.append(set(np.flatnonzero(out).tolist()))
    model = language.solve(labels, np.packbits(np.stack([[k in g for k in range(language.BUCKETS)] for g in grams]).astype(np.uint8), axis=1), landmarks_each=12)
    kernel = np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in grams] for x in grams])
    # all rows are landmarks: ridge regression in the kernel's own feature space, rows weighted by 1 / rows of the language
    values, vectors = np.linalg.eigh(kernel)
    z = vectors[:, values > 1e-6 * values.max()] * np.sqrt(values[values > 1e-6 * values.max()])
    y = np.array([[1.0 if x == k else -1.0 for k in "abc"] for x in labels])
    weights = np.linalg.solve(z.T @ z / 12 + language.RIDGE / 3 * np.eye(z.shape[1]), z.T @ y / 12)
    margins = z @ weights
    got = model.predict(texts)
    for i, (lang, score) in enumerate(got):
        best = int(margins[i].argmax())
        assert lang == "abc"[best] and abs(score - min(1.0, max(0.0, (margins[i, best] + 1) / 2))) < 1e-3
