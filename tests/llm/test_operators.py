"""Every operator against a brute-force version, and on nulls, repeats, ties, empty tables and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import zstandard

pytest.importorskip("barloom.llm.queries")

from barloom.llm import exact_dedup, fuse_filter, mixing, near_dedup, packing, pii, quality_rules, substring_dedup, token_counts  # noqa: E402
from barloom.llm.tokens import RunEncoder  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(docs, corpus):
    got = by_id(exact_dedup.dedup(docs))
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, *_ in corpus}
    groups = {}
    for i, t, *_ in corpus:
        groups.setdefault(norm[i], []).append((-len(t or ""), i))
    assert len(got) == len(corpus)
    for i, r in got.items():
        own = groups[norm[i]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own)[1], len(own), min(own)[1] == i)
        assert r["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 30_000):
        keys = rng.integers(-(2**62), 2**62, n)
        f = fuse_filter.build(keys)
        assert f.may_hold(keys).all()
        assert f.may_hold(rng.integers(-(2**62), 2**62, 20_000)).mean() < 0.001


def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def test_near_duplicates(docs, corpus):
    sets = {i: shingles(t) for i, t, *_ in corpus}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = by_id(near_dedup.near_duplicates(docs))
    for i, s in sets.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), find(i), find(i) == i), i


@pytest.mark.parametrize("split", [near_dedup.SPLIT, 20])
def test_near_duplicates_dense_group(spark, monkeypatch, split):
    """Many edits of one text, most pairs near the threshold; also with the group in parts."""
    import random

    from .conftest import edited, words

    monkeypatch.setattr(near_dedup, "SPLIT", split)
    rng = random.Random(3)
    base = words(rng, 120, 10**6)
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 8)))) for i in range(160)]
    sets = {i: shingles(t) for i, t in rows}
    root = dict.fromkeys(sets)
    for i in sets:
        root[i] = i
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_substring_dedup(docs, corpus):
    got = by_id(substring_dedup.with_digest(substring_dedup.remove_repeats(docs)))
    seen = set()
    for i, t, *_ in sorted(corpus):
        ws = WORD.findall(t or "")
        gone = set()
        for k in range(len(ws) - 19):
            key = tuple(ws[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(ws), len(gone)), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def luhn(d):
    return sum((int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9)) for k, c in enumerate(reversed(d))) % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(re.sub(r"\D", "", x)) <= 19 and luhn(re.sub(r"\D", "", x))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(re.sub(r"\D", "", x)) <= 15),
}


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in KINDS.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_pii_base(spark, docs, corpus):
    tricky = ["a@b.c_x@d.e.f g@h", "1.2.3.4.5.6.7.8 01.002.0003.255 1.1.1.256", "+1 (2) 345-67.89- 0 ++49 12345678", "4111-1111 1111 1111 4111111111111111111", "é😀 u@v.w", "9" * 5000 + "." + "a." * 5000 + "b@c" + ".d" * 5000]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    want = {i: base_spans(t) for i, t, *_ in corpus} | {1000 + i: base_spans(t) for i, t in enumerate(tricky)}
    got = by_id(pii.report(pii.find(both)))
    for i, spans in want.items():
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, spans, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s.startswith(k + ":") for s in spans) for k in KINDS]


def test_pii_disclosing_terms(spark):
    rows = [(i, f"call zanzibar desk at ops{i % 2}@acme.example.com today number {i}") for i in range(6)] + [(100 + i, f"nothing to see in today file {i}") for i in range(60)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got, texts = by_id(pii.report(found)), by_id(pii.sanitised(found))
    assert all("term:5:13" in got[i]["spans"] for i in range(6))  # zanzibar
    assert all(got[100 + i]["n_term"] == 0 for i in range(60))
    assert "zanzibar" not in texts[0]["text"] and "[EMAIL]" in texts[0]["text"] and "today" in texts[0]["text"]


def test_pii_terms_of_whole_documents(spark):
    """Rare values and far terms, against counts by brute force; every place of a term is masked."""
    import math
    import random

    rng = random.Random(4)
    common = [f"common{i}" for i in range(30)]
    name = {i: f"Name{i}"[:4] + "abcdefghij"[i % 10] * 3 for i in range(10)}
    texts = {}
    for i in range(300):
        ws = rng.choices(common, k=40)
        if i < 24:
            k = i if i < 4 else 4 + i % 6
            ws = [name[k % 10], "wrote", *ws, f"box{k}@h{k % 3}.example.org", *rng.choices(common, k=30), name[k % 10]]
        texts[i] = " ".join(ws)
    texts[300] = None
    found = pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4))
    term = re.compile(r"\w{3,}")
    holds = {i: {t.lower() for t in term.findall(x or "")} for i, x in texts.items()}
    entity = {i: {f"box:{m[1]}", f"h:{m[2]}"} for i, x in texts.items() if (m := re.search(r"(box\d+)@(h\d)", x or ""))}
    n, rule, want = len(texts), pii.Disclosure(), {}
    for i, own in entity.items():
        at = re.search(r"\S+@\S+", texts[i]).span()
        for m in term.finditer(texts[i]):
            t, best = m[0].lower(), -1.0
            for c in own:
                docs_c = [j for j in entity if c in entity[j]]
                p = sum(t in x for x in holds.values()) / n
                p_tc = (sum(t in holds[j] for j in docs_c) + rule.prior * p) / (len(docs_c) + rule.prior)
                best = max(best, math.log(p_tc / p) / math.log(n / len(docs_c)))
            if best >= rule.generalise and not (m.start() < at[1] and m.end() > at[0]):
                want.setdefault(i, set()).add(f"term:{m.start()}:{m.end()}")
    got = by_id(pii.report(found))
    assert {i: {s for s in r["spans"].split(",") if s.startswith("term")} for i, r in got.items() if r["n_term"]} == want
    assert all(f"term:0:{len(name[i])}" in want[i] for i in range(4))  # far from an address that one document holds
    masked = by_id(pii.sanitised(found))
    assert not any(name[i] in masked[i]["text"] for i in range(4)) and common[0] in " ".join(masked[i]["text"] for i in range(24))


def test_quality_rules(docs, corpus):
    got = by_id(quality_rules.score(docs))
    for i, t, *_ in corpus:
        t = t or ""
        ws = WORD.findall(t)
        grams = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        twice = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 5)} if len(grams) < 2000 else None
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want, i
        if twice is not None:
            assert r["n_repeat_words"] == len(twice)
            assert r["base_failed"] == (len(ws) < 10 or 100 * len(twice) > 20 * len(ws))
        assert not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_compression_bands():
    import random

    import pyarrow as pa

    from .conftest import words

    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(4000))
    noise = " ".join(noise[i : i + 5] for i in range(0, 4000, 5))
    fine = " ".join(words(rng, 800))
    m = quality_rules.measure(pa.array([fine, "abc " * 200 + fine[:10], noise + " " + fine]), quality_rules.Bands(whole=((float("inf"), 1.5, 4.0),), chunk_bytes=4_096, bad_share=0.5))
    assert list(m["in_bands"]) == [True, False, True]
    zip_ = zstandard.ZstdCompressor(level=3)
    for text, ratio in zip((fine, "abc " * 200 + fine[:10], noise + " " + fine), m["ratio"], strict=True):
        assert ratio == len(text) / len(zip_.compress(text.encode()))


@pytest.mark.parametrize("n", [200, 500, 1_800, 4_800, 9_000, 24_000, 120_000])
def test_production_bands(n):
    import base64
    import random

    import pyarrow as pa

    from .conftest import words

    rng = random.Random(n)
    printable = "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    printable = " ".join(printable[i : i + 5] for i in range(0, n, 5))[:n]
    coded = base64.b64encode(rng.randbytes(n)).decode()
    coded = "\n".join(coded[i : i + 76] for i in range(0, n, 76))[:n]
    clean = " ".join(words(rng, n // 5))[:n]
    m = quality_rules.measure(pa.array([printable, coded, clean]))
    assert list(m["in_bands"]) == [False, False, True], m["ratio"]
    if n >= 1_800:
        twice = (clean[: n // 2] + " ") * 2
        assert not quality_rules.measure(pa.array([twice if n < 9_000 else (clean[:900] + " ") * (n // 900)]))["in_bands"][0]


@pytest.mark.parametrize("n", [6_000, 20_000, 80_000, 300_000])
def test_noise_in_part_of_a_text(n):
    """Noise at the end, in the middle and in one place after another; one odd chunk is let pass, clean text too."""
    import random
    import string

    import pyarrow as pa

    from .conftest import words

    rng = random.Random(n)
    clean = " ".join(words(rng, n // 4))
    for k in (int(share * n) for share in (0.2, 0.3, 0.4, 0.5)):
        if k < 1_500:  # may be one odd chunk
            continue
        noise = "".join(rng.choice(string.ascii_letters + string.digits + " ") for _ in range(k))
        half = (n - k) // 2
        parts = "".join(clean[i * (n - k) // 2 : (i + 1) * (n - k) // 2] + noise[i * k // 2 : (i + 1) * k // 2] for i in range(2))
        m = quality_rules.measure(pa.array([clean[: n - k] + noise, clean[:half] + noise + clean[half : n - k], parts]))
        assert not m["in_bands"].any(), k
    assert list(quality_rules.measure(pa.array([clean[:n], clean[: n - 800] + noise[:800]]))["in_bands"]) == [True, True]


def test_fitted_bands(spark):
    import random

    from .conftest import words

    rng = random.Random(3)
    texts = [" ".join(words(rng, 300)) for _ in range(20)] + [None, ""]
    bands = quality_rules.fitted(spark.createDataFrame([(t,) for t in texts], "text string"))
    zip_ = zstandard.ZstdCompressor(level=3)
    own = {}
    for t in texts[:20]:
        for part in (t.encode(), *(t.encode()[i : i + 1024] for i in range(0, len(t), 1024))):
            k = next(i for i, (below, _, _) in enumerate(quality_rules.Bands().whole) if len(part) < below)
            own.setdefault(k, []).append(len(part) / len(zip_.compress(part)))
    for k, (below, lo, hi) in enumerate(bands.whole):
        plain = quality_rules.Bands().whole[k]
        assert (below, lo, hi) == plain if k not in own or plain[2] == float("inf") else abs(lo - 0.75 * min(own[k])) + abs(hi - 1.35 * max(own[k])) < 1e-12
    import pyarrow as pa

    assert quality_rules.measure(pa.array(texts[:20]), bands)["in_bands"].all()


def test_chunk_bands_reach_the_tail():
    import random

    import pyarrow as pa

    from .conftest import words

    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(3_000))
    fine = " ".join(words(rng, 2_000))[:4_096]
    m = quality_rules.measure(pa.array([fine + noise, noise + fine, fine + fine[::-1][:50]]), quality_rules.Bands(chunk_bytes=4_096, bad_share=0.5))
    assert m["bad_chunks"][0] == 3_000 / 7_096 and m["bad_chunks"][1] > 0.5 and m["bad_chunks"][2] == 0
    assert list(m["in_bands"]) == [False, False, True]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_run_encoder(tokenizer, corpus):
    import public_tokenizers

    enc = RunEncoder(public_tokenizers.path("word_bpe_49k.json"))
    hard = ["It's İstanbul ΣΑΣ éÉ é x y \x1c z<|endoftext|>q <|startoftext|> 'reading ''s ½ ² ǅ ﬁ 한국 ١٢ a_b-c​d", "́abc d́ Å", "l'été 'LL can'T", "", " \n", "ĲŽ ŉ ƻ…"]
    for t in [*hard, *(t or "" for _, t, *_ in corpus)]:
        assert np.frombuffer(enc.encode(t.encode()), np.uint16).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


@pytest.mark.parametrize("length", [16, 2048])
def test_packing(docs, corpus, tokenizer, length):
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in corpus}
    pieces = packing.pack(docs, length=length)
    rows = packing.with_crc(pieces).collect()
    for i, own in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(own))
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    full = max(ends)
    assert all(v == length for k, v in ends.items() if k != full) and ends[full] <= length
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(pieces).collect()}
    assert whole == ends


def test_token_counts(docs, corpus, tokenizer):
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in corpus]
    out = token_counts.answers(token_counts.histogram(token_counts.lengths(docs)))
    for r in out.collect():
        k = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["docs_at_most"]) == (n.count(k), sum(x >= k for x in n), sum(x <= k for x in n))
        assert (r["tokens_at_least"], r["truncated_total"]) == (sum(x for x in n if x >= k), sum(min(x, k) for x in n))
    got = {r["context_limit"]: r["truncated_total"] for r in token_counts.at_limits(out, [0, 7, 100, 10**6]).collect()}
    assert got == {k: sum(min(x, k) for x in n) for k in (0, 7, 100, 10**6)}
    assert {r["share"]: r["n_tokens"] for r in token_counts.quantiles(out, [0.5, 1.0]).collect()} == {0.5: sorted(n)[-(-len(n) // 2) - 1], 1.0: max(n)}


def test_mixing(docs, corpus):
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus}
    mixed = mixing.mix(docs, block=32, per_shard=50)
    got = by_id(mixing.taken(mixed))
    per = {}
    for i, _, _, s, *_ in corpus:
        assert got[i]["size"] == sizes[i] and got[i]["taken"] <= 2 * sizes[i]
        p = per.setdefault(s, [0, 0, got[i]["target"], got[i]["source_size"]])
        p[0] += sizes[i]
        p[1] += got[i]["taken"]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    want = mixing.targets([per[s][0] for s in order])
    for s, t in zip(order, want, strict=True):
        assert per[s][0] == per[s][3] and abs(per[s][2] - t) < 1e-6
        assert per[s][1] == int(t)
    assert abs(sum(want) - 1.5 * sum(sizes.values())) < 1e-6
    again = by_id(mixing.taken(mixing.mix(docs.repartition(2), block=32, per_shard=50)))
    assert {i: r["taken"] for i, r in again.items()} == {i: r["taken"] for i, r in got.items()}
    texts = {}
    for r in mixing.mixed_documents(docs, mixed).collect():
        texts[r["doc_id"]] = texts.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert texts == {i: r["taken"] for i, r in got.items() if r["taken"]}


def test_permutation():
    for n in (1, 2, 3, 10, 257, 5000):
        p = mixing.Permutation(n, 7, n)
        out = p(np.arange(n))
        assert sorted(out) == list(range(n)) and (p(out, inverse=True) == np.arange(n)).all()


def test_mixing_keeps_rows_without_or_with_one_id(spark, corpus):
    """Null and repeated ids: every row's words come out, by its own text."""
    rows = [(None if i % 3 == 0 else i % 5, t, "en", None if i % 4 == 0 else "s", len(t or ""), "x", 1) for i, t, *_ in corpus[:60]]
    rows += rows[:4] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, bucket int").repartition(3)
    mixed = mixing.mix(docs, block=16, per_shard=50)
    taken = mixing.taken(mixed)
    assert taken.count() == len(rows) and mixed.rows.select("source_no", "run", "nth").distinct().count() == len(rows)
    copies = mixed.rows.groupBy("key_1", "key_2").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("own")).collect()
    assert max(r["n"] for r in copies) >= 4 and all(r["n"] == r["own"] for r in copies)
    out = [(r["doc_id"], len(WORD.findall(r["text"]))) for r in mixing.mixed_documents(docs, mixed).collect()]
    want = {}
    for r in taken.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for i, n in out:
        got[i] = got.get(i, 0) + n
    assert got == {i: n for i, n in want.items() if n} and None in got
    again = mixing.taken(mixing.mix(docs.repartition(7), block=16, per_shard=50))
    assert sorted(map(str, again.collect())) == sorted(map(str, taken.collect()))


def test_mixing_of_many_sources(spark, monkeypatch):
    """More sources than a chunk holds; targets as those of the plain function."""
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 90:03}") for i in range(400)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8, per_shard=64)
    sizes, got = {}, {}
    for r in mixing.taken(mixed).collect():
        key = rows[r["doc_id"]][2]
        sizes[key] = sizes.get(key, 0) + r["size"]
        got.setdefault(key, [0, r["target"]])[0] += r["taken"]
    want = mixing.targets([sizes[k] for k in sorted(sizes)])
    for k, t in zip(sorted(sizes), want, strict=True):
        assert abs(got[k][1] - t) < 1e-6 and got[k][0] == int(got[k][1] + 1e-9)
    per = {r["shard"]: r["count"] for r in mixed.slots.groupBy("shard").count().collect()}
    assert sorted(per) == list(range(len(per))) and all(n == 64 for s, n in per.items() if s < len(per) - 1)


def test_split_is_a_multinomial_within_the_counts():
    rng, counts = np.random.default_rng(3), np.array([5, 100, 0, 45])
    draws = np.array([mixing._split(counts, 75, rng) for _ in range(3_000)])
    assert (draws.sum(axis=1) == 75).all() and (draws <= counts).all()
    assert abs(draws[:, 1].mean() / 100 - draws[:, 3].mean() / 45) < 0.02


def test_exact_dedup_of_an_id_with_two_texts(spark):
    """The texts of a repeated or missing id meet their own copies, on either side."""
    rows = [(1, "a b"), (1, "other"), (2, "ab"), (3, "oth er"), (None, "null one"), (None, "nullone"), (None, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for side in ("text like '% %'", "true", "coalesce(doc_id, 0) = 1"):
        got = exact_dedup.dedup(docs, snapshot=F.coalesce(F.expr(side), F.lit(False))).collect()
        sizes = sorted((r["text_sha256"], r["group_size"]) for r in got)
        norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
        assert sizes == sorted((hashlib.sha256(t.encode()).hexdigest(), norm.count(t)) for t in norm), side


def test_second_hash_is_not_made_from_the_first():
    """Windows of equal first hash, forced by equal sums, differ in the second."""
    from barloom.llm import textkernel

    text = b" ".join(b"%d" % (i * i % 997) for i in range(400))
    words = textkernel.Tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    first = np.arange(300)
    a, b = (words.run_hash(first, first + 20, nth=k) for k in (0, 1))
    words._sums[0] = np.zeros_like(words._sums[0])  # all first hashes equal now
    assert len(np.unique(words.run_hash(first, first + 20))) == 1
    assert len(np.unique(words.run_hash(first, first + 20, nth=1))) == len(np.unique(a)) == len(np.unique(b))
    assert (words.hashes(0) != words.hashes(1)).all()


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of several blocks and segments between short ones, and one word longer than a segment."""
    import random

    rng = random.Random(8)
    body = " ".join(f"x{rng.randrange(5000)}" for _ in range(380_000))
    assert len(body) > 2 << 20
    rows = [(0, "short one here"), (1, body), (2, body[100_000:101_000] + " tail"), (3, "y" * (3 << 19) + " end of it"), (4, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_long_texts(long_docs, tokenizer):
    rows, docs = long_docs
    near, cut, rules = by_id(near_dedup.near_duplicates(docs)), by_id(substring_dedup.with_digest(substring_dedup.remove_repeats(docs))), by_id(quality_rules.score(docs))
    pieces, seen, got = packing.pack(docs).collect(), set(), {}
    for r in pieces:
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for i, t in rows:
        ws = WORD.findall(t or "")
        assert near[i]["n_shingles"] == len(shingles(t)) and rules[i]["n_words"] == len(ws)
        gone = set()
        for k in range(len(ws) - 19):
            key = tuple(ws[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        assert (cut[i]["n_words"], cut[i]["n_removed"]) == (len(ws), len(gone)), i
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(x for _, x in sorted(got[i])), "<u4").tolist() == ids


def test_packing_and_counts_of_nulls_and_repeats(odd_docs, tokenizer):
    texts = [r["text"] or "" for r in odd_docs.collect()]
    n = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = packing.pack(odd_docs, length=32).collect()
    assert sum(r["length"] for r in rows) == sum(n) + len(n)
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == sorted(k + 1 for k in n)
    hist = {r["n_tokens"]: r["n_docs"] for r in token_counts.histogram(token_counts.lengths(odd_docs)).collect()}
    assert hist == {k: n.count(k) for k in n}


OPERATORS = {
    "exact": exact_dedup.dedup,
    "near": near_dedup.near_duplicates,
    "substring": substring_dedup.remove_repeats,
    "pii": lambda d: pii.report(pii.find(d)),
    "sanitised": lambda d: pii.sanitised(pii.find(d)),
    "packing": packing.pack,
    "mixing": lambda d: mixing.taken(mixing.mix(d)),
    "rules": quality_rules.score,
    "counts": lambda d: token_counts.answers(token_counts.histogram(token_counts.lengths(d))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, no_docs):
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", [k for k in OPERATORS if k not in ("packing", "counts")])
def test_nulls_and_repeats(name, odd_docs):
    assert OPERATORS[name](odd_docs).count() == odd_docs.count()


def test_repeats_keep_their_words(odd_docs):
    rows = substring_dedup.remove_repeats(odd_docs).collect()
    assert {(r["n_words"], r["n_removed"]) for r in rows if r["doc_id"] == 1} == {(60, 0)}
    assert {(r["n_words"], r["n_removed"]) for r in rows if r["doc_id"] == 2} == {(61, 60)}
