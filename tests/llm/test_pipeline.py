"""Each stage of the pipeline against plain Python over what the stage before it kept."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import packing, quality_model, quality_rules
from tests.llm.test_models import jaccard_oracle
from tests.llm.test_text import WORD, stats_oracle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __stats string, __key string, score int"


def corpus():
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(2, 9)))
    texts, labels = [], []
    for i in range(900):
        words = [word() for _ in range(r.randrange(30, 70))]
        good = i % 4 > 0
        texts.append(" ".join(words) + "." if good else " | ".join(w + "#!" for w in words))
        labels.append((i, int(good), 0))
    texts += [None, "", " \n ", "too few words", "one two three four five six seven eight " * 9, texts[1], texts[1] + " end", texts[2], "x" * 5000]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "clash", "k", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[5], "en", None, None, None, None, None), (7, texts[7], "en", "s", 1, "c", "k", 1), (7, texts[7], "en", "s", 1, "c", "k", 1)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_model", "ngram_join", "packing"]
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    count = lambda df: collections.Counter(tuple(r) for r in df.collect())
    (_, rules), (_, model), (_, join), (_, pack) = corpus_pipeline.STAGES

    first = rules(spark, docs, folder)
    cutoffs = quality_rules.fit_cutoffs(quality_rules.measure(docs), labels).by_stratum
    assert cutoffs["en"] and len(first.columns) == len(docs.columns)

    def passes(r):
        s = {k: int(v[0]) for k, v in quality_rules.text_stats(pa.array([r["text"]], pa.string())).items()}
        assert tuple(s[n] for n in quality_rules.NAMES[:5]) == stats_oracle(r["text"])
        if s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]:
            return False
        value = lambda sql: eval(sql.replace("greatest", "max"), {"max": max}, s)
        return not any(value(quality_rules.RULES[name][0]) > c for name, c in cutoffs.get(r["lang"], {}).items())

    assert count(first) == collections.Counter(tuple(r) for r in docs.collect() if passes(r)) and first.count() < docs.count()

    learnt = quality_model.train(first.select("doc_id", quality_model.features_of("text").alias("x")), labels)
    second = model(spark, first, folder)
    score = lambda t: learnt.score(quality_model.features(pa.array([t], pa.string())))[0]
    assert count(second) == collections.Counter(tuple(r) for r in first.collect() if score(r["text"]) >= quality_model.CUTOFF)

    third = join(spark, second, folder)
    rows = sorted(second.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    _, root = jaccard_oracle([(i, r["text"]) for i, r in enumerate(rows)])
    assert count(third) == collections.Counter(tuple(rows[i]) for i in sorted(set(root))) and third.columns == docs.columns

    got = pack(spark, third, folder).toPandas()
    e = packing.encoder(packing.tokenizer_path()).tokenizer
    size = {r["doc_id"]: len(e.encode(r["text"], add_special_tokens=False).ids) + 1 for r in third.collect()}
    assert got.groupby("doc_id")["length"].sum().to_dict() == size and got.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY

    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, whole[key].to_numpy().tolist())) == sorted(map(tuple, got[key].to_numpy().tolist()))


def test_empty_tables(spark, folder, tmp_path):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for name, d, lab in (("none", docs.limit(0), labels.limit(0)), ("unlabelled", docs, labels.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        lab.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0
    kept = corpus_pipeline.STAGES[0][1](spark, docs, f"{tmp_path}/unlabelled")
    assert kept.count() == sum(s[0] >= 20 and 100 * s[4] <= 30 * s[0] for s in (stats_oracle(r["text"]) for r in docs.collect()))


def test_language_decoding_by_hand():
    """Loss-weighted decoding and the tables' scores, entry by entry."""
    from graphloom.llm import langid

    r = np.random.default_rng(3)
    code = langid.codewords(4)
    m = langid.Coded(["a", "b", "c", "d"], code, r.normal(size=(6, code.shape[1])), r.normal(size=code.shape[1]), r.random(code.shape[1]) + 0.5, 0.1)
    x = r.normal(size=(20, 6))
    best, top, gap = m.decode(x)
    for i in range(20):
        margin = [sum(x[i, k] * m.weights[k, b] for k in range(6)) + m.bias[b] for b in range(code.shape[1])]
        loss = [sum(m.bit_weight[b] * np.log(1 + np.exp(-code[j, b] * margin[b])) for b in range(code.shape[1])) for j in range(4)]
        share = sorted(np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum())
        assert best[i] == int(np.argmin(loss)) and top[i] == pytest.approx(share[-1]) and gap[i] == pytest.approx(share[-1] - share[-2])
    y = (r.random(300) > 0.5).astype(float)
    z = r.normal(size=(300, 15)) + y[:, None]
    t = quality_model.fit(z, y)
    for i in range(50):
        total = t.bias + sum(table[sum(e <= z[i, j] for e in edges)] for j, (edges, table) in enumerate(zip(t.edges, t.tables)))
        total += sum(table[sum(e <= z[i, a] for e in t.coarse[a]), sum(e <= z[i, b] for e in t.coarse[b])] for a, b, table in t.pairs)
        assert t.score(z[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_cutoffs_by_brute_force(spark):
    """The chosen set is the last of the first run of certified sets, counted over distinct texts; repeated rows and copies under other ids change nothing."""
    rows, labels = corpus()
    rows += [(100_000 + i, *r[1:]) for i, r in enumerate(rows[:40])]  # copies, labelled like their originals, but for one
    labels += [(100_000 + i, q if i else 1 - q, 0) for i, (_, q, _) in enumerate([next((x for x in labels if x[0] == r[0]), (0, 0, 0)) for r in rows[:40]])]
    d = spark.createDataFrame(rows, SCHEMA)
    got = quality_rules.fit_cutoffs(quality_rules.measure(d), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    lowest = {}
    for i, q, _ in labels:
        lowest[i] = min(q, lowest.get(i, q))
    verdicts = collections.defaultdict(set)
    for r in rows:
        if r[0] in lowest:
            verdicts[r[2], r[1] or ""].add(lowest[r[0]])
    strata = collections.defaultdict(list)
    for (stratum, text), seen in verdicts.items():
        if min(seen) == 1:
            strata[stratum].append({k: int(v[0]) for k, v in quality_rules.text_stats(pa.array([text], pa.string())).items()})
    for stratum, stats in strata.items():
        want = {}
        for cutoffs in quality_rules.SETS:
            hit = sum(any(eval(quality_rules.RULES[n][0].replace("greatest", "max"), {"max": max}, s) > c for n, c in cutoffs.items()) for s in stats)
            if not (hit < len(stats) * quality_rules.RISK and quality_rules.binomial_cdf(hit, len(stats), quality_rules.RISK) <= quality_rules.DELTA / len(strata)):
                break
            want = cutoffs
        assert got.by_stratum[stratum] == want
    assert {(s, n) for s, _, n, _, _ in got.evidence} == {(s, len(x)) for s, x in strata.items()}
    again = quality_rules.fit_cutoffs(quality_rules.measure(d.unionAll(d).unionAll(d)), spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int"))
    assert again.by_stratum == got.by_stratum and sorted(again.evidence, key=str) == sorted(got.evidence, key=str)
    assert WORD.findall("a b") == ["a", "b"] and zlib.crc32(b"") == 0


def test_labelled_texts_alone_are_read_twice(spark, folder):
    """The features that teach are computed above the join with the labelled ids."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    for df in (quality_rules.measure(quality_rules.with_ids(docs.select("doc_id", "lang", "text"), quality_rules.marks_of(labels))), quality_model.with_ids(docs.select("doc_id", "text"), quality_model.teachers(labels)).select("doc_id", quality_model.features_of("text"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("ArrowEvalPython") < plan.index("LeftSemi")
