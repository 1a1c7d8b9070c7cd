import collections
import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import aligning
from tests.llm.test_text import EDGE, docs

MORE = ["a▁b", "<|endoftext|> x <s></s>", "  x　 y  z", "  a\n\n b\t c  ", "don't I'M we'll", "=" * 300 + "-" * 77, "aaaa" * 400, "12345 6,789.00", "日本語テスト" * 30, "\x00a\x1f b\x85 c", "🙂🙃 é̈"]


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) and the groups, from the libraries' own results."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = aligning.tokenizer_paths()
    a_lib, b_lib = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_lib.encode_special_tokens = True
    letters = {c: bytes([b]) for b, c in enumerate(aligning.byte_letters())}
    found = []
    for text in texts:
        spaced = (" " + (text or "")).encode()
        a_ids = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b_lib.encode(text) if text else []
        a = [b"".join(letters[c] for c in a_lib.id_to_token(i)) for i in a_ids]
        b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b_ids)]
        if not text or b"".join(a) != spaced or b"".join(b) != spaced:
            found.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a]).tolist(), np.cumsum([len(x) for x in b]).tolist()
        groups, start = [], 0
        for stop in sorted(set(ends_a) & set(ends_b)):
            groups.append((start, stop, [i for i, e in zip(a_ids, ends_a) if start < e <= stop], [i for i, e in zip(b_ids, ends_b) if start < e <= stop]))
            start = stop
        found.append(groups)
    held, best = collections.Counter(), collections.Counter()
    links = [[(x, y) for _, _, p, q in groups for x in p for y in q] for groups in found]
    for one in links:
        held.update(set(one))
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for groups, one in zip(found, links):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for _, _, p, q in groups)
        rows.append((sum(len(g[2]) for g in groups), sum(len(g[3]) for g in groups), len(groups), len(one), sum(held[k] == best[k[0]] for k in one), sum(held[k] for k in one), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows, found, held, best


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("window", "step"), [(aligning.WINDOW, aligning.STEP), (64, 100), (7, 3)])
def test_aligned_by_brute_force(spark, window, step):
    """With windows and steps so small that documents, and groups, go on from step to step."""
    r = random.Random(2)
    texts = EDGE + MORE + ["".join(r.choices(["the ", "cat", "s ", "é", "▁", "\n", "  ", "1", "日", "naïve ", "."], weights=[9, 9, 9, 3, 0.1, 2, 2, 2, 1, 5, 3], k=r.randrange(1, 150))) for _ in range(60)]
    d = docs(spark, texts).repartition(3).cache()
    rows = d.collect()
    want, _, held, best = brute([x["text"] for x in rows])
    got = aligning.aligned(d, window=window, step=step).collect()
    key = lambda x: str(x)
    assert sorted([(x["doc_id"], *(x[c] for c in COLUMNS)) for x in got], key=key) == sorted([(x["doc_id"], *w) for x, w in zip(rows, want)], key=key)
    if window == 64:
        table = {(x["a_id"], x["b_id"]): (x["n"], x["best"]) for x in aligning.link_table(d).collect()}
        assert table == {k: (n, n == best[k[0]]) for k, n in held.items()}


def test_groups(spark):
    texts = ["the naïve cat's 1234 日本", "a  b\n\nc", None, "▁", "x" * 500]
    d = docs(spark, texts)
    _, found, _, _ = brute([x["text"] for x in d.collect()])
    for step in (4, aligning.STEP):
        got = collections.Counter((x["start"], x["stop"], tuple(x["a"]), tuple(x["b"])) for x in aligning.groups(d, window=5, step=step).collect())
        assert got == collections.Counter((s, e, tuple(p), tuple(q)) for groups in found for s, e, p, q in groups)


def test_large_groups_and_ids():
    """A group of very many links, and ids beyond what shares one number."""
    v = aligning.Vocabulary([b"aaa", b"aa"]), aligning.Vocabulary([b"aaaaa", b"aaaaaaa"])
    m = aligning.Machine(v)
    n_a, n_b = 3500, 2100
    m.step(np.array([5, 5]), [9, 9], np.array([0, 0]), np.array([0, 1]), np.concatenate([np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)]), np.array([n_a, n_b]))
    d = m.open
    assert d.sums.tolist() == [n_a, n_b, 700, 700 * 15] and d.codes.tolist() == [0] and d.times.tolist() == [700 * 15]
    m = aligning.Machine(v)  # 201 * 2 + 3 bytes against 81 * 5: ends meet seldom
    a = np.array([1] * 201 + [0])
    m.step(np.array([1, 1]), [1, 1], np.array([0, 0]), np.array([0, 1]), np.concatenate([a, np.zeros(81, np.int64)]), np.array([202, 81]))
    ends_a, ends_b = np.cumsum(v[0].size[a]), np.arange(5, 406, 5)
    assert m.open.sums[2] == len(set(ends_a.tolist()) & set(ends_b.tolist())) and m.open.sums[3] == m.open.times.sum()
    own, code, times = aligning.Machine._distinct(np.array([0, 0, 1], np.uint64), np.array([1 << 60, 1 << 60, 5], np.uint64))
    assert own.tolist() == [0, 1] and code.tolist() == [1 << 60, 5] and times.tolist() == [2, 1]
    aligning.LISTED, before = 4, aligning.LISTED
    try:
        small = aligning.Machine(v)
        small.step(np.array([1, 1]), [1, 1], np.array([0, 0]), np.array([0, 1]), np.concatenate([a, np.zeros(81, np.int64)]), np.array([202, 81]))
    finally:
        aligning.LISTED = before
    assert small.open.codes.tolist() == m.open.codes.tolist() and small.open.times.tolist() == m.open.times.tolist()


def test_long_and_empty(spark):
    long = ("word and naïve 12\n" * 200_000) + "end"
    d = spark.createDataFrame([(1, long), (2, ""), (3, None)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in aligning.aligned(d).collect()}
    assert got[1]["n_groups"] > 1_000_000 and got[2]["groups_sha256"] == got[3]["groups_sha256"] == "" and got[2]["n_a"] == got[3]["count_sum"] == 0
    a = aligning.ByteEncoder(aligning.tokenizer_paths()[0])
    text = (" " + long).encode()
    assert a.text(text).tolist() == a.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert aligning.aligned(d.limit(0)).count() == 0
