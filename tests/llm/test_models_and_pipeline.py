"""Held-out accuracy of the classifiers; the pipeline and its guard."""

import dataclasses
import random

import numpy as np

import pytest

pytest.importorskip("barloom.llm.queries")

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from barloom.llm import labelled, quality_model, toxicity  # noqa: E402

from .conftest import SCHEMA, words  # noqa: E402


@pytest.fixture(scope="module")
def labelled_docs(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(900):
        ws = words(rng, rng.randrange(20, 120), 300)
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(["zog", "blarg", "vex"], 2):
                ws.insert(rng.randrange(len(ws)), w)
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(ws))
            ws[at : at + 40] = [f"{w}$$$" for w in words(rng, 40)]
        rows.append((i, " ".join(ws), None, None, None, "x", 1))
        marks.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (None, "zog vex", None, None, None, None, None)]
    marks += [(900, None, None), (None, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_model, "quality")])
def test_classifier(labelled_docs, module, label):
    docs, labels = labelled_docs
    model = module.train(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == 903
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r["doc_id"] is not None}
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert len(held) > 200 and all(0 <= r["score"] <= 1 for r in rows)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    assert right > 0.93, right
    again = module.score(docs, module.train(docs, labels)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("vocabulary", [300, 4000])
def test_toxic_pairs_of_innocent_terms(spark, vocabulary):
    """The label is whether two words come both or not at all; neither tells anything alone."""
    rng = random.Random(vocabulary)
    rows, marks = [], []
    for i in range(3_600):
        ws = words(rng, 60, vocabulary)
        both = [w for w in ("group", "insult") if rng.random() < 0.5]
        for w in both:
            ws.insert(rng.randrange(len(ws)), w)
        rows.append((i, " ".join(ws)))
        marks.append((i, int(len(both) != 1)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    alone = toxicity.train(docs, labels, how=toxicity.Fitting(wald=float("inf")))
    right = {}
    for name, m in (("machine", machine), ("weights", alone)):
        held = [r for r in toxicity.score(docs, m).collect() if r["held_out"]]
        right[name] = sum((r["score"] >= 0.5) == marks[r["doc_id"]][1] for r in held) / len(held)
    assert right["machine"] > 0.9 and right["weights"] < 0.65, right


def test_vectors_only_where_they_pay():
    """Labels that single terms explain, or nothing does: the machine is the weights alone."""
    rng = random.Random(2)
    for rule in (lambda ws: int("bad" in ws), lambda ws: rng.randrange(2)):
        texts = [[*words(rng, 30, 500), *(["bad"] if rng.random() < 0.3 else [])] for _ in range(900)]
        label = np.array([rule(ws) for ws in texts], float)
        packed = [np.unique([hash_of(w) for w in ws]).astype("<i4").tobytes() for ws in texts]
        made, alone = toxicity.fit(label, packed), toxicity.fit(label, packed, toxicity.Fitting(wald=float("inf")))
        assert made.living == 0 and made.bias == alone.bias and np.array_equal(made.weight, alone.weight)


def hash_of(word):
    import zlib

    return zlib.crc32(word.encode()) % (1 << toxicity.BITS)


def test_attention_finds_a_bad_passage(spark):
    """One passage of broken words in a long document decides; the mean over passages does not."""
    rng = random.Random(12)
    rows, marks = [], []
    for i in range(1_500):
        ws = words(rng, 48 * 12, 4000)
        if bad := i % 2:
            at = 48 * rng.randrange(12)
            ws[at : at + 48] = ["".join(rng.choice("bcdfgk") for _ in range(5)) for _ in range(48)]
        rows.append((i, " ".join(ws)))
        marks.append((i, 1 - bad))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    net = quality_model.train(docs, labels)
    right = {}
    for name, n in (("attention", net), ("mean", dataclasses.replace(net, w=net.w | {"a": net.w["a"] * 0}))):
        held = [r for r in quality_model.score(docs, n).collect() if r["held_out"]]
        right[name] = sum(r["predicted"] == marks[r["doc_id"]][1] for r in held) / len(held)
    assert right["attention"] > 0.95 and right["attention"] > right["mean"], right


def test_classifier_without_labels(labelled_docs, no_docs):
    docs, labels = labelled_docs
    for module in (toxicity, quality_model):
        model = module.train(docs, labels.limit(0))
        assert module.score(docs, model).count() == 903
        assert module.score(no_docs, model).count() == 0


def test_training_rows_leave_the_held_out_fold(spark, labelled_docs):
    import zlib

    docs, labels = labelled_docs
    got = labels.filter("doc_id is not null").select("doc_id", labelled.fold(labels["doc_id"]).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in got)
    assert labelled.training_rows(docs, labels, "toxic", 50).count() == 50


def test_stages(spark, docs, corpus, tmp_path):
    rows = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, "")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{i}")
        rows = spark.read.parquet(f"{tmp_path}/{i}")
        if i == 2:
            kept = {r["doc_id"] for r in rows.collect()}
    copies = {i for i, t, *_ in corpus if (t or "").split() == corpus[0][1].split()}
    assert len(copies) > 2 and len(kept & copies) <= 1
    assert {31, 32, 33} <= kept  # clean and alone
    assert rows.count() > 0


def test_every_stage_by_hand(spark, docs, corpus, tmp_path):
    """What each stage keeps of what the one before kept, against plain Python on the same rows."""
    import re
    from collections import Counter, defaultdict

    import pyarrow as pa

    from barloom.llm import mixing, quality_rules
    from barloom.llm.tokens import RunEncoder

    from .test_operators import WORD, shingles

    outs, rows = [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, "").write.parquet(f"{tmp_path}/{i}")
        rows = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append(rows)
    ruled, exact, near, mixed, packed = outs
    texts = {i: t or "" for i, t, *_ in corpus}
    sources = {i: s for i, _, _, s, *_ in corpus}

    def good(t):
        ws = WORD.findall(t)
        windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        twice = {i + k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(5)}
        return len(ws) >= 10 and 100 * len(twice) <= 20 * len(ws) and quality_rules.measure(pa.array([t]))["in_bands"][0]

    want = {i for i, t in texts.items() if good(t)}
    assert {r["doc_id"] for r in ruled.collect()} == want and 50 < len(want) < len(texts)

    groups = defaultdict(list)
    for i in want:
        groups[re.sub(r"[\x20\x09-\x0D]", "", texts[i])].append((-len(texts[i]), i))
    want = {min(g)[1] for g in groups.values()}
    assert {r["doc_id"] for r in exact.collect()} == want

    sets, root = {i: shingles(texts[i]) for i in want}, {i: i for i in want}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in want:
        for b in want:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i for i in want if find(i) == i}
    assert {r["doc_id"] for r in near.collect()} == want

    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.mix(near.select(*corpus_pipeline.COLUMNS))).collect()}
    got = Counter()
    for r in mixed.collect():
        own, part = WORD.findall(texts[r["doc_id"]]), WORD.findall(r["text"])
        got[r["doc_id"]] += len(part)
        assert r["source"] == sources[r["doc_id"]] and not Counter(part) - Counter(own)
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in taken.items() if n}

    import public_tokenizers

    enc = RunEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    tokens = Counter()
    for r in mixed.collect():
        tokens[r["doc_id"], len(enc.encode(r["text"], add_special_tokens=False).ids) + 1] += 1
    pieces = packed.collect()
    whole = Counter()
    for r in pieces:
        if r["start"] + r["length"] == r["doc_tokens"]:
            whole[r["doc_id"], r["doc_tokens"]] += 1
    assert whole == tokens
    assert sum(r["length"] for r in pieces) == sum(n * k for (_, n), k in tokens.items())
    filled = Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert [n for _, n in sorted(filled.items())][:-1] == [2048] * (len(filled) - 1)


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Of copies with and without ids one stays and its near copy goes with it or stays for it; nothing comes of nothing."""
    counts = []
    for k, start in enumerate((odd_docs, no_docs)):
        rows = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, rows, "").write.parquet(f"{tmp_path}/{k}-{i}")
            rows = spark.read.parquet(f"{tmp_path}/{k}-{i}")
            counts.append(rows.count())
    assert counts[:2] == [5, 2] and 1 <= counts[2] <= 2 and counts[3] >= 1 and counts[4] >= counts[3] and counts[5:] == [0] * 5
    kept = spark.read.parquet(f"{tmp_path}/0-1").collect()
    assert sorted(len(r["text"].split()) for r in kept) == [60, 61]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
