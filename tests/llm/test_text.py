import collections
import hashlib
import io
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import chat, jpeg, langid, packing, pieces, textbatch
from graphloom.llm.textstats import NAMES, text_stats
from graphloom.llm.wordtable import WordTable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \n\t", "a", "a\n\na\na b", "é" * 10, "x " * 100, "one two three four five six seven eight " * 3, "日本語 テスト🙂 x", "a\x1cb\x85c", "#* | <x>", "w" * 5000, " lead", "trail \n", "a  b   c", "a \n b"]


def docs(spark, texts=EDGE, **more):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # clashing names of later columns, repeated rows, a null id
    from pyspark.sql import functions as F

    d = d.unionAll(d.limit(2)).unionAll(d.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    for c in ("score", "kept", "n_words", "fp", "bands", "stats", "g", "row", "block", "feature"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def stats_oracle(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_stats():
    r = random.Random(3)
    texts = EDGE + ["".join(r.choices(["a ", "b ", "\n", "é", "#"], k=r.randrange(120))) for _ in range(200)]
    s = text_stats(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(s[n][i]) for n in NAMES[:5]) == stats_oracle(t), t
    assert len(text_stats(pa.array([], pa.string()))["n_words"]) == 0


def test_pieces_equal_the_library():
    e = pieces.encoder(pieces.model_path())
    r = random.Random(5)
    texts = EDGE + ["▁x", "x▁ y", "a▁", "<s> </s>", "<0x0A>", " " * 40 + "q"] + ["".join(r.choices(list("ab ▁\n.é日"), k=r.randrange(60))) for _ in range(300)]
    for row, ids, sizes in e.texts(pa.array(texts, pa.string())):
        ends = np.cumsum(sizes)
        for i, n in enumerate(sizes):
            assert ids[ends[i] - n : ends[i]].tolist() == e.library.encode(texts[row + i] or "")
    assert e.repaired == 0


def test_piece_digests(spark):
    d = docs(spark)
    sp = pieces.encoder(pieces.model_path()).library
    got = pieces.digests(d).collect()
    assert len(got) == d.count()
    for r, t in zip(got, [x["text"] for x in d.collect()]):
        ids = sp.encode(t or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.digests(d.limit(0)).count() == 0 and pieces.encoded(d).count() == len(got)


def test_repairs_are_counted(spark, monkeypatch):
    """A wrong agenda's ids are replaced by the library's and counted by text, also where a segment is known already."""
    right = pieces.PieceEncoder.merge
    monkeypatch.setattr(pieces.PieceEncoder, "merge", lambda self, text: right(self, text)[:-1] if text.endswith("bad") else right(self, text))
    e = pieces.PieceEncoder(pieces.model_path())
    texts = ["bad good bad", "good", None, "bad", "fine bad" * 2]
    for _ in range(2):
        for row, ids, sizes in e.texts(pa.array(texts)):
            assert row == 0 and ids.tolist() == [i for t in texts for i in e.library.encode(t or "")] and e.repaired_of.tolist() == [2, 0, 0, 1, 1]
    pieces._encoders["broken"] = e
    long = "bad good " * (pieces.LONG // 8)
    run = next(iter(e.texts(pa.array([long]))))
    assert e.repaired_of.tolist() == [pieces.LONG // 8] and run[1].tolist() == e.library.encode(long)


def test_word_ids_equal_the_library():
    e = packing.encoder(packing.tokenizer_path())
    r = random.Random(7)
    texts = EDGE + ["I'M don't we've 'sat it's", "H̱a K̈ ẖ.", "<|endoftext|> x", "don't. it's, 's. ...", "ĸŉſ straße ÿŸ İ"] + ["".join(r.choices(["a", "B", "'s", ".", ",", " ", "é", "1", "́", "!"], k=r.randrange(40))) for _ in range(300)]
    for row, ids, sizes in e.texts(pa.array(texts, pa.string())):
        ends = np.cumsum(sizes)
        for i, n in enumerate(sizes):
            assert ids[ends[i] - n : ends[i]].tolist() == [*e.tokenizer.encode(texts[row + i] or "", add_special_tokens=False).ids, packing.END]


def test_packing(spark):
    d = docs(spark, EDGE + ["word " * 9000, "many words of all kinds " * 700])
    got = packing.pack(d).toPandas()
    e = packing.encoder(packing.tokenizer_path()).tokenizer
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= packing.CAPACITY and s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist()
    want = collections.Counter()
    for r in d.select("doc_id", "text").collect():
        ids = [*e.encode(r["text"] or "", add_special_tokens=False).ids, packing.END]
        for s, n in packing.cuts(len(ids), packing.CAPACITY, packing.MAX_PART):
            want[r["doc_id"] if r["doc_id"] is not None else -1, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n])), len(ids)] += 1
    assert collections.Counter(zip(got.doc_id.fillna(-1).astype(int), got.start, got.length, got.ids_crc32, got.doc_tokens)) == want
    assert packing.pack(d.limit(0)).count() == 0


def test_differencing():
    r = np.random.default_rng(1)
    for n, k in ((1, 1), (1, 3), (5, 2), (40, 7), (200, 16)):
        sizes = r.integers(1, 500, n)
        window, most = packing.differencing(sizes, k)
        sums = np.bincount(window, sizes, k)
        assert sums.sum() == sizes.sum() and sums.max() == most and window.max() < k
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2)[1] == 16  # the method's result; the best is 15
    sizes = r.integers(1, 513, 3000)
    sums = np.bincount(packing.pack_parts(sizes), sizes)
    assert sums.max() <= 4096 and sizes.sum() / (4096 * len(sums)) > 0.98
    for sizes in (np.ones(524_288, np.int64), r.integers(1, 30, 40_000), r.integers(1, 200, 6000)):  # a group of tiny parts
        tracemalloc.start()
        sums = np.bincount(packing.pack_parts(sizes), sizes)
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()
        assert sums.max() <= 4096 and sizes.sum() / (4096 * len(sums)) > 0.98
    assert packing.bundles(np.array([1, 300, 200, 50, 127, 100, 90])).tolist() == [0, 2, 3, 0, 0, 0, 1]


def test_many_empty_texts(spark):
    from pyspark.sql import functions as F

    got = packing.pack(spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")))
    r = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("windows")).first()
    assert r["n"] == 1_000_000 and r["most"] <= 4096 and r["windows"] <= 250


def _exif_free_baseline():
    """A 16 x 16 colour image with 2 x 2 subsampling and no restarts, written by hand: flat luminance blocks 10, 60, 200, 250."""
    dc = bytes([0, *jpeg.DC_BITS, *jpeg.DC_SYMBOLS])
    head = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, bytes([0, 8] + [1] * 63))
    head += jpeg._segment(0xC0, struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += jpeg._segment(0xC4, dc) + jpeg._segment(0xC4, bytes([0x10, *jpeg.AC_BITS, *jpeg.AC_SYMBOLS])) + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    codes, bits, last = jpeg._codes(jpeg.DC_BITS, jpeg.DC_SYMBOLS), "", 0
    for v in (10, 60, 200, 250):
        d = v - 128 - last
        last = v - 128
        n = abs(d).bit_length()
        c, size = codes[n]
        bits += f"{c:0{size}b}" + (f"{d if d >= 0 else d + (1 << n) - 1:0{n}b}" if n else "") + "0"
    for _ in range(2):
        c, size = codes[0]
        bits += f"{c:0{size}b}0"
    bits += "1" * (-len(bits) % 8)
    return head + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_jpeg():
    r = np.random.default_rng(2)
    payloads = [jpeg.payload(x) for x in (b"", b"a", r.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"\xff" * 576, bytes([0, 255]) * 3000, r.integers(0, 9, 400_000, dtype=np.uint8).tobytes())]
    for p, t in zip(payloads, jpeg.thumbnails(jpeg.encode(payloads))):
        assert b"".join(x.tobytes() for _, _, x in t) == p
    assert len(jpeg.payload(b"a" * 576)) == 576 and len(jpeg.payload(b"")) == 576
    [(w, h, t)] = jpeg.thumbnails([_exif_free_baseline()])[0]
    assert (w, h, t.tolist()) == (16, 16, [[10, 60], [200, 250]])
    assert jpeg.thumbnails([b"", b"\xff\xd8\xff", jpeg.encode(payloads[:1])[0][:60]]) == [None] * 3
    Image = pytest.importorskip("PIL.Image")
    assert np.array(Image.open(io.BytesIO(jpeg.encode(payloads[2:3])[0])))[::8, ::8].tobytes() == payloads[2]


def test_jpeg_digests(spark):
    d = docs(spark)
    got = jpeg.digests(d).collect()
    for r, t in zip(got, [x["text"] for x in d.collect()]):
        p = jpeg.payload((t or "").encode())
        assert r["n_bytes"] == len((t or "").encode()) and r["payload_bytes"] == len(p) and r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-32:])
    back = jpeg.read_thumbnails(jpeg.media(d)).select("n_bytes", "read_back.*", "feature").toDF("n", "w", "h", "thumbnail", "f", "g").collect()
    assert all(x["f"] == x["g"] for x in back) and jpeg.digests(d.limit(0)).count() == 0


def test_chat(spark):
    f = chat.Formatter(chat.INSTRUCT)
    r = random.Random(1)
    alphabet = ["\\", *chat.INSTRUCT.controls, "<", "[", "/", "s>", "INST]", "a", "\n", " ", "é"]
    for _ in range(3000):
        t, role = "".join(r.choices(alphabet, k=r.randrange(8))), r.choice(["user", "assistant", "system", "", "tool", "".join(r.choices(alphabet, k=3))])
        assert [x[:2] for x in f.read("".join(x for x, _ in f.segments(role, t)))] == [(role, t)]
    for _ in range(1500):  # whole conversations, in pieces cut anywhere
        turns = [(r.choice(["user", "assistant", "system", "", "tool", "</s>[INST"]), "".join(r.choices(alphabet, k=r.randrange(7)))) for _ in range(r.randrange(6))]
        segments = [x for role, t in turns for x in f.segments(role, t)]
        text, reader, back = "".join(x for x, _ in segments), chat.Reader(f), []
        at = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(5)))
        for i, j in zip([0, *at], [*at, len(text)]):
            back += reader.feed(text[i:j])
        back += reader.end()
        assert [x[:2] for x in back] == turns == [x[:2] for x in f.read(text)]
        assert [f.unescape(text[a:b]) for role, _, a, b in back if role in f.template.loss] == [f.unescape(x) for x, loss in segments if loss]
    for wrong in ("x", "<s>[INST] a", "<s>[INST] a</s>", " a <s>", "<<SYS>>\na</s>"):
        with pytest.raises(ValueError, match="template|control"):
            f.read(wrong)
    with pytest.raises(ValueError, match="slot"):
        chat.Formatter(chat.Template(("<s>",), {"user": ("<s>", chat.TEXT, "\n")}, frozenset(), {}))
    chat.POUR, before = 1, chat.POUR
    rows = [(1, 0, "user", "</s>[INST] ok"), (1, 1, "assistant", "a\\b"), (2, 0, "assistant", None), (2, None, None, "x"), (2, 0, "assistant", None), (None, 0, "user", ""), (3, 0, "user", "q"), (3, 1, "user", "q")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' n_turns", "'x' place")
    got = {x["conv_id"]: x for x in chat.digests(c).collect()}
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"] and got[2]["n_turns"] == 3
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n</s>[INST] ok\nassistant\na\\b\n").hexdigest() and got[1]["loss_sha256"] == hashlib.sha256(b"a\\b").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\nassistant\n\nassistant\n\n").hexdigest()
    assert [x["state"] for x in chat.segments(c).where("conv_id = 3 AND part = 0").orderBy("place").collect()] == ["user", "broken"]
    assert chat.digests(c.limit(0)).count() == 0
    chat.POUR = before


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    """Long texts are encoded in pieces and runs; the result is that of the whole."""
    r = random.Random(17)
    text = "".join(r.choices(["many ", "Words,", " of é ", "\n\n", "日本 ", "  x", "don't. "], k=400_000))
    assert len(text.encode()) > 2 * (1 << 20)
    a, b = packing.encoder(packing.tokenizer_path()), pieces.encoder(pieces.model_path())
    for module in (packing, pieces):
        monkeypatch.setattr(module, "LONG", 1 << 16)
    monkeypatch.setattr(pieces, "RUN", 1 << 12)
    monkeypatch.setattr(jpeg, "RUN", 24 * 8184)
    [(_, ids, _)] = a.texts(pa.array([text]))
    assert ids.tolist() == [*a.tokenizer.encode(text, add_special_tokens=False).ids, packing.END]
    [(_, ids, _)] = b.texts(pa.array([text]))
    want = b.library.encode(text)
    assert ids.tolist() == want
    assert b.digest(ids) == (hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(b.library.decode(want).encode()).hexdigest())
    [(_, texts, stored, thumbs)] = jpeg._stored(pa.array([text]))
    p = jpeg.payload(text.encode())
    assert stored == jpeg.encode([p]) and b"".join(x.tobytes() for _, _, x in thumbs[0]) == p
    monkeypatch.undo()
    d = spark.createDataFrame([(1, text), (2, text), (3, "a")], "doc_id long, text string")
    assert {x["doc_id"]: x["n_tokens"] for x in pieces.digests(d).collect()} == {1: len(want), 2: len(want), 3: 1}
    assert packing.pack(d).agg({"length": "sum"}).first()[0] == 2 * (len(a.tokenizer.encode(text, add_special_tokens=False).ids) + 1) + 2


def test_counts_of_long_texts_in_runs(monkeypatch):
    """Statistics, word hashes and grams of a long text in runs, with words longer than a run, are those of the whole."""
    r = random.Random(23)
    long = " ".join("".join(r.choices("abcdefé\n.#", k=r.randrange(1, 9))) for _ in range(3000)) + " " + "w" * 7000 + " " + "xy" * 900 + " end"
    whole, grams = text_stats(pa.array([long])), [langid.counts(pa.array([t]))[0] for t in (long, "ab" * 600)]
    b = textbatch.TextBatch(pa.array([long, "a b"]))
    h = b.hashes(*b.words())
    monkeypatch.setattr(textbatch, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(textbatch, "LONG_BYTES", 1000)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 1000)
    got = text_stats(pa.array([long]))
    assert all(np.array_equal(got[k], whole[k]) for k in NAMES) and tuple(int(got[n][0]) for n in NAMES[:5]) == stats_oracle(long)
    assert np.array_equal(b.hashes(*b.words()), h)
    assert all(np.array_equal(langid.counts(pa.array([t]))[0], g) for t, g in zip((long, "ab" * 600), grams))


def test_damaged_scans():
    r = np.random.default_rng(4)
    [good] = jpeg.encode([jpeg.payload(r.integers(0, 256, 20_000, dtype=np.uint8).tobytes())])
    cut = [good[: len(good) * k // 10] for k in range(1, 10)]
    over = [good[:k] + bytes(700) + good[k + 700 :] for k in (1000, 5000, 9000)]
    assert jpeg.thumbnails([*cut, *over, good])[:-1] == [None] * 12 and jpeg.thumbnails([*cut, good])[-1] is not None


def block_oracle(data):
    """Bytes of a stream of flat blocks, by reading its bits one by one."""
    out, i = [], data.index(b"\xff\xda") + 10
    codes = {(length, code): symbol for symbol, (code, length) in jpeg._codes(jpeg.DC_BITS, jpeg.DC_SYMBOLS).items()}
    for row in re.split(rb"\xff[\xd0-\xd9]", data[i:])[:-1]:
        bits, at, value = "".join(f"{b:08b}" for b in row.replace(b"\xff\0", b"\xff")), 0, 128
        for _ in range(jpeg.ACROSS):
            size = next(n for n in range(1, 17) if (n, int(bits[at : at + n], 2)) in codes)
            length = codes[size, int(bits[at : at + size], 2)]
            extra = bits[at + size : at + size + length]
            value += 0 if not length else int(extra, 2) if extra[0] == "1" else int(extra, 2) - (1 << length) + 1
            at += size + length + 1  # the end of the block is one bit
            out.append(value)
    return bytes(out)


def test_stream_bit_by_bit():
    r = np.random.default_rng(6)
    for n in (1, 576, 3000):
        p = jpeg.payload(r.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert block_oracle(jpeg.encode([p])[0]) == p


def test_word_table_smaller_than_a_text():
    """More distinct words at once than the table holds."""
    r = np.random.default_rng(5)
    h = r.integers(0, 200, 1000).astype(np.uint64)
    table = WordTable(np.uint32, slots_log2=4)
    for part in (h[:3], h, h[:7], h[::-1]):
        words = lambda at: [[int(x)] * (int(x) % 3 + 1) for x in part[at]]  # noqa: B023, E731
        got, sizes = table.encode(part, words)
        assert got.tolist() == [x for y in words(np.arange(len(part))) for x in y] and sizes.tolist() == [int(x) % 3 + 1 for x in part]
