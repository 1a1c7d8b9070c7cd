import collections
import math
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import katz, langid, ngram_join, page_text, quality_model, quality_rules
from tests.llm.test_text import EDGE, WORD, docs, stats_oracle


def test_binomial():
    for n, p in ((1, 0.5), (20, 0.1), (300, 0.02), (10_000, 0.01)):
        for k in {0, 1, n // 10, n // 3, n - 1, n}:
            if k < n and n <= 300:
                want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality_rules.certified(0, 1000, 0.01, 0.001) and not quality_rules.certified(0, 100, 0.01, 0.001) and not quality_rules.certified(0, 0, 0.5, 0.5)


def labelled(spark, n=600):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        words = [word() for _ in range(60)]
        rows.append((i, " ".join(words) + "." if good else " | ".join(w + "#" for w in words), "en" if i % 2 else "de", "s", 0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_rules(spark):
    d, labels = labelled(spark, 2400)
    cuts = quality_rules.fit_cutoffs(quality_rules.measure(d), labels, risk=0.1)
    assert cuts.by_stratum["en"]["symbols"] <= 0.05
    kept = {r["doc_id"] for r in quality_rules.keep_good(d, labels, risk=0.1).collect()}
    assert kept == {i for i in range(2400) if i % 4}
    e = docs(spark)
    out = quality_rules.judge(e, labels)
    texts = [x["text"] for x in e.collect()]
    for r, t in zip(out.collect(), texts):
        s = stats_oracle(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == s
        assert r["base_failed"] == (s[0] < 20 or 100 * s[4] > 30 * s[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(e.limit(0), labels.limit(0)).count() == 0
    assert quality_rules.keep_good(e, labels.limit(0)).columns == e.columns


def test_cutoffs_keep_their_promise():
    """With many good texts beyond a cutoff it isn't certified."""
    assert not quality_rules.certified(60, 1000, 0.05, 0.01) and quality_rules.certified(20, 1000, 0.05, 0.01)


def test_quality_model(spark):
    d, labels = labelled(spark)
    got = {r["doc_id"]: r for r in quality_model.classify(d, labels).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in held]) > 0.97
    e = docs(spark)
    assert quality_model.classify(e, labels).where("score between 0 and 1").count() == e.count()
    assert {r["score"] for r in quality_model.classify(e, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(e.limit(0), labels.limit(0)).count() == 0
    assert quality_model.keep_good(d, labels).columns == d.columns


def test_additive_model_learns_pairs():
    r = np.random.default_rng(0)
    x = np.zeros((4000, 15))
    x[:, :2] = r.random((4000, 2))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    m = quality_model.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9 and any({a, b} == {0, 1} for a, b, _ in m.pairs)


LANGS = {"xx": "the of and to in is that for it was on are as with".split(), "yy": "der die und ein von zu das mit sich ist nicht über größe".split(), "zz": "le la les des et un une que pour dans être à ça".split()}


def test_langid(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(LANGS[k], k=12)), k, "s", 0) for i, k in enumerate(list(LANGS) * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(d)
    got = {x["doc_id"]: x for x in langid.predict(d, model).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert held and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    e = docs(spark)
    for x, t in zip(langid.predict(e, model).collect(), [y["text"] for y in e.collect()]):
        assert (x["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= x["score"] <= 1
    assert langid.train(d.limit(0)) is None and langid.identify(e.limit(0)).count() == 0
    assert {x["lang_pred"] for x in langid.predict(d, None).collect()} == {"und"}
    for n in (2, 3, 5, 9, 20):
        m = langid.codewords(n)
        assert len({tuple(x) for x in m}) == n and (abs(m.sum(0)) < n).all()


def jaccard_oracle(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(near):
            for j in js:
                root[i] = root[j] = min(root[i], root[j])
    return near, root


def near_rows(seed=2):
    r = random.Random(seed)
    base = [[f"w{r.randrange(500)}" for _ in range(80)] for _ in range(12)]
    rows = []
    for b in base:
        rows.append(" ".join(b))
        for _ in range(r.randrange(4)):
            c = list(b)
            for _ in range(r.randrange(4)):
                c[r.randrange(80)] = "new"
            rows.append(" ".join(c))
    return list(enumerate(rows + ["a b", "a b", "", None, "a b c d e", "a b c d e"] + [" ".join(base[0])] * 3))


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 4])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_rows()
    near, root = jaccard_oracle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' fp", "1 n_links")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.classes(d).collect()}
    assert got == {i: (root[i], len(near[i])) for i, _ in rows}
    kept = ngram_join.keep_one(d)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and kept.columns == d.columns


def test_ngram_join_chain(spark, monkeypatch):
    """A long chain of texts, each alike its neighbours only, is verified bucket by bucket; so is every pair of a cluster, once."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(12)
    words = [f"c{i}" for i in range(900)]
    rows = [" ".join(words[i : i + 100]) for i in range(0, 800, 6)] + [" ".join(words[i : i + 100]) for i in (0, 60)]
    base = [f"d{i}" for i in range(120)]
    rows += [" ".join("x" if k == r.randrange(120) else w for k, w in enumerate(base)) for _ in range(30)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    near, root = jaccard_oracle(rows)
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect()}
    assert got == {i: (root[i], len(near[i])) for i, _ in rows} and max(collections.Counter(root).values()) > 100


def test_ngram_join_edges(spark):
    e = docs(spark)
    got = ngram_join.classes(e)
    assert got.count() == e.count() and ngram_join.classes(e.limit(0)).count() == 0
    kept = ngram_join.keep_one(e).collect()
    words = [tuple(WORD.findall(r["text"] or "")) for r in e.collect()]
    assert collections.Counter(tuple(WORD.findall(r["text"] or "")) for r in kept if WORD.findall(r["text"] or "")) == collections.Counter({w: 1 for w in words if w})
    assert sum(not WORD.findall(r["text"] or "") for r in kept) == sum(not w for w in words)


def test_verify_dense_equals_sparse():
    r = np.random.default_rng(3)
    pool = np.sort(r.integers(0, 2**62, 300).astype(np.uint64))
    sets = [np.unique(r.choice(pool[:80], 60)) for _ in range(60)]
    bands = np.zeros((60, 2), np.int64)
    all_ = np.arange(60)
    hit = ngram_join.verify(sets, bands, all_, all_, 0.6)
    for i in range(60):
        for j in range(60):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert hit[i, j] == (j > i and both >= 0.6 * (len(sets[i]) + len(sets[j]) - both))


def test_bands():
    b, r = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 192


LOW = {i: i + 32 for i in range(65, 91)}


def good_turing(counts, k=5):
    """Katz's discounts, by his formula; half a count off where it gives none that is proper."""
    n = collections.Counter(counts)
    d = {r: 1 - 0.5 / r for r in range(1, k + 1)}
    if all(n[r] for r in range(1, k + 2)) and (k + 1) * n[k + 1] != n[1]:
        common = (k + 1) * n[k + 1] / n[1]
        proper = {r: ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, k + 1)}
        d = proper if all(0 < x < 1 for x in proper.values()) else d
    return lambda c: d.get(c, 1.0) * c


def katz_oracle(rows):
    """Plain dictionaries and recursion; checks on the way that every history's probabilities add up to one."""
    words = lambda t: [w.translate(LOW) for w in WORD.findall(t or "")] + ["</>"]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    learnt = [words(t) for (_, t), h in zip(rows, held) if not h]
    grams = [collections.Counter(tuple(s[i - n : i + 1]) for x in learnt for s in [["<>", "<>", *x]] for i in range(2, len(s))) for n in range(3)]
    used = [good_turing(g.values()) for g in grams]
    uni = grams[0]
    n, v = sum(uni.values()), len(uni)
    freed = 1 - sum(map(used[0], uni.values())) / n if n else 1.0
    other = max(freed, 1 / (n + 1))
    after = [collections.defaultdict(dict) for _ in range(3)]
    for k in (1, 2):
        for g, c in grams[k].items():
            after[k][g[:-1]][g[-1]] = c
    weights = {}

    def p(g):
        k = len(g) - 1
        if k == 0:
            return (1 - other) / (1 - freed) * used[0](uni[g]) / n if uni[g] else other
        own = after[k].get(g[:-1])
        if not own:
            return p(g[1:])
        size = sum(own.values())
        bare = all(c > 5 for c in own.values())
        if g[-1] in own:
            return used[k](own[g[-1]]) / size * (size / (size + 1) if bare else 1)
        if g[:-1] not in weights:
            left = 1 / (size + 1) if bare else 1 - sum(map(used[k], own.values())) / size
            weights[g[:-1]] = left / (1 - sum(p((*g[1:-1], w)) for w in own))
        return weights[g[:-1]] * p(g[1:])

    for h in [*list(after[1])[:40], *list(after[2])[:40]]:
        assert sum(p((*h, w)) for (w,) in uni) + p((*h, object())) == pytest.approx(1)
    out = []
    for (i, t), h in zip(rows, held):
        w = words(t)
        s = ["<>", "<>", *w]
        score = sum(math.log10(p(tuple(s[j - 2 : j + 1]))) for j in range(2, len(s))) if n else 0.0
        out.append((i, h, len(w), sum((x,) in uni for x in w), n, round(sum(math.log10((uni[x,] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5), round(score, 5)))
    return collections.Counter(out)


def katz_rows(got):
    return collections.Counter((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 5), round(x["score"], 5)) for x in got.collect())


def katz_texts(seed=6, n=150):
    r = random.Random(seed)
    return [" ".join(r.choices([f"w{i}" for i in range(30)], [1 / (i + 1) for i in range(30)], k=r.randrange(25))) for _ in range(n)] + EDGE + ["The the THE"] * 3


@pytest.mark.parametrize("tokens, hot", [(katz.BUCKET_TOKENS, katz.HOT), (300, 0.0), (40, 0.0), (40, 0.05)])
def test_katz(spark, tokens, hot):
    """However n-grams are dealt, every one counts."""
    d = spark.createDataFrame(list(enumerate(katz_texts())) + [(None, "w1 w2")], "doc_id long, text string").selectExpr("*", "'x' score", "1 block", "2 piece")
    assert katz_rows(katz.scores(d, tokens, hot)) == katz_oracle([(x["doc_id"], x["text"]) for x in d.collect()])


@pytest.mark.parametrize("size", [7, 40, 300])
def test_katz_texts_in_pieces(spark, size):
    rows = list(enumerate(katz_texts(9, 40) + [" " * 50 + "w1", "w1" + " " * 50, " " * 30 + "w1" + "\n" * 30 + "w2 w3", "w" * 90 + " w1 w2"]))
    assert sum(len(x) for x in pieces_of(rows, size)) > 40
    got = katz.scores(spark.createDataFrame(rows, "doc_id long, text string"), 100, block_bytes=size)
    assert katz_rows(got) == katz_oracle(rows)


def pieces_of(rows, size):
    """Pieces hold all words in order, and the two before."""
    import pyarrow as pa

    for _, text in rows:
        words, out = [], []
        for texts, _, lead, ends, whole in katz.pieces(pa.array([text], pa.string()), size):
            w = WORD.findall(texts[0].as_py().decode())
            assert w[:lead] == words[-2:][:lead] and lead == (0 if whole else min(2, len(words)))
            words += w[lead:]
            out.append(ends)
        assert words == WORD.findall(text or "") and out == [False] * (len(out) - 1) + [True]
        yield out


def test_katz_rare_and_frequent(spark):
    """Pairs that occur twice in half a million tokens stay in the table; a word pair and a first word with a large share."""
    rows = [(i, "a b c " * 800 + "x y z " * (i in (3, 40)) + "b x " * (i in (50, 51))) for i in range(220)]
    assert katz_rows(katz.scores(spark.createDataFrame(rows, "doc_id long, text string"), 20_000)) == katz_oracle(rows)


def test_katz_equal_blocks(spark):
    d = spark.createDataFrame([(i, "a b c") for i in range(30)], "doc_id long, text string").coalesce(1)
    assert katz_rows(katz.scores(d.unionAll(d).unionAll(d))) == katz_oracle([(i, "a b c") for i in range(30)] * 3)
    same = spark.createDataFrame([(None, "a a a a")] * 9, "doc_id long, text string")
    assert katz_rows(katz.scores(same.unionAll(same))) == katz_oracle([(None, "a a a a")] * 18)


def test_katz_without_training(spark):
    d = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(x["n_known"], x["train_tokens"], x["score"]) for x in katz.scores(d).collect()} == {(0, 0, 0.0)}
    assert katz.scores(d.limit(0)).count() == 0


def test_pages(spark):
    field = page_text.default_field()
    bad = total = 0
    for html, spans in page_text.made_pages(150, 99):
        page = page_text.blocks(html)
        want = [any(a <= b.start < z for a, z in spans) for b in page]
        bad += sum(a != b for a, b in zip(field.decode(page), want))
        total += len(page)
    assert bad < 0.03 * total
    html = '<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p>Some  text\n with <b>bold</b> words, and more of them.<p>Second one &copy here.<script>x</script></article><div id="comments"><p>I like it.</p></div><footer>&copy; x</footer>'
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", html), (None, "u", "<div>" * 3000 + "deep")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' text", "1 n_chars")
    got = {r["page_id"]: r for r in page_text.extract(p).collect()}
    assert got[1]["text"] == "A & B\nSome text with bold words, and more of them.\nSecond one © here." == got[5]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == got[4]["text"] == "" and page_text.extract(p.limit(0)).count() == 0


@pytest.mark.parametrize("start", ["<body><p>", "<p>", "<body>", "", "<img src=x>", "\n<meta name=m>\n<div>"])
def test_head_without_end_tag(start):
    page = page_text.blocks(f"<!DOCTYPE html><html><head> <title>t</title><link href=x>\n<script>a</script><noscript>n</noscript>{start}One two.<p>Three.")
    assert [b.text for b in page] == ["One two.", "Three."]


def test_made_heads():
    assert {"</head>" in html for html, _ in page_text.made_pages(60, 3)} == {True, False}


def test_field_probabilities_match_brute_force():
    """Viterbi finds the best labelling of all."""
    page = page_text.blocks("<nav><a href=x>a</a></nav><article><p>One two three.</p><p>Four.</p></article><footer>f</footer>")
    field = page_text.default_field()
    unary = [sum(field.weights.get(x, 0.0) for x in f) for f in page_text.features(page)]
    score = lambda y: field.start * y[0] + sum(u * b for u, b in zip(unary, y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
    every = [[k >> i & 1 for i in range(len(page))] for k in range(1 << len(page))]
    assert [int(x) for x in field.decode(page)] == max(every, key=score)
