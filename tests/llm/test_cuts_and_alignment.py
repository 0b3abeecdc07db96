"""Substring removal by suffix arrays, tokenizer alignment and fill-in-the-middle against brute-force versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("barloom.llm.queries")

from barloom.llm import alignment, fill_in_middle, suffix_array, suffix_dedup  # noqa: E402


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def marked(spark, corpus):
    extra = ["a<P>b", "<S>", "x<M", "<P", "😀😁" * 50, "é\x00\n" * 40, "$1\\2<P" * 9, "z" * 200_000]
    rows = [(i, t) for i, t, *_ in corpus] + [(1000 + i, t) for i, t in enumerate(extra * 4)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_fill_in_middle(marked):
    rows, docs = marked
    made = fill_in_middle.transform(docs)
    got, digests, forms = by_id(made), by_id(fill_in_middle.with_digests(made)), Counter()
    for i, t in rows:
        t = t or ""
        n, d = len(t), hashlib.sha256(f"1:{i}".encode()).hexdigest()
        h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        form = "plain" if not n or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        p, m, s = t[:a], t[a:b], t[b:]
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        r = got[i]
        assert (r["n"], r["form"], r["output"]) == (n, form, out), i
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (a, b - a))
        assert (digests[i]["output_sha256"], digests[i]["restored_sha256"]) == (sha(out), sha(t))
        forms[form] += 1
    assert len(got) == len(rows) and min(forms[x] for x in ("plain", "psm", "spm")) > 5


def test_fill_in_middle_units_and_marks(spark):
    docs = spark.createDataFrame([(i, f"one two  three{i} four ") for i in range(40)], "doc_id long, text string")
    made = fill_in_middle.transform(docs, unit=r"(?:[^ ]++ *+)", marks=("[p]", "[s]", "[m]"), middle_percent=100, suffix_first_percent=50)
    back = made.withColumn("back", fill_in_middle.restored(made.output, made.form, ("[p]", "[s]", "[m]"))).collect()
    assert {r["n"] for r in back} == {4} and {r["form"] for r in back} == {"psm", "spm"}
    assert all(r["back"] == f"one two  three{r['doc_id']} four " for r in back)
    for r in back:
        cut = r["output"].split("[p]")[1].split("[s]")[0].split("[m]")[0]
        assert cut == "" or cut.endswith(" ")


def test_fill_in_middle_odd_rows(odd_docs, no_docs):
    got = fill_in_middle.with_digests(fill_in_middle.transform(odd_docs))
    assert got.count() == odd_docs.count() and got.columns[0] == "doc_id"
    assert {r["form"] for r in got.filter("doc_id = 4 or doc_id = 3").collect()} == {"plain"}
    assert fill_in_middle.transform(no_docs).count() == 0


def test_merge_path():
    rng = np.random.default_rng(3)
    for na, nb in ((0, 0), (1, 1), (40, 7), (300, 500), (5, 900)):
        top = 1000
        a = np.unique(np.append(rng.integers(1, top, na), top))[: max(na, 0)] if na else np.zeros(0, np.int64)
        b = np.unique(np.append(rng.integers(1, top, nb), top)) if nb else np.zeros(0, np.int64)
        if na:
            a = np.unique(np.append(a, top))
        common = np.intersect1d(a, b)
        want = np.searchsorted(a, common) + 1, np.searchsorted(b, common) + 1
        for step in (1, 2, 3, 7, 64, 5000):
            i, j = alignment.diagonals(a, b, step)
            assert (i + j == np.arange(0, len(a) + len(b) + step, step).clip(max=len(a) + len(b))).all()
            got = alignment.groups(a, b, step)
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1]), (na, nb, step)
            pieces = [alignment.merged_piece(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
            links = {tuple(x) for p, _ in pieces for x in p.T.tolist()}
            starts = lambda e: np.append(0, e[:-1])
            sa, sb = starts(a) if na else a, starts(b) if nb else b
            assert links == {(x, y) for x in range(len(a)) for y in range(len(b)) if max(sa[x], sb[y]) < min(a[x], b[y])}


def _tokens(text):
    """Ids and bytes of both tokenizers over the whole text, as the contract has them."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(_tokens, "made"):
        a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        _tokens.made = a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        _tokens.of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in own)}
    a, b = _tokens.made
    x = a.encode(" " + text, add_special_tokens=False)
    y = b.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
    return x.ids, [bytes(_tokens.of[c] for c in t) for t in x.tokens], y, bytes_b


def brute_alignment(rows):
    found, holders = {}, Counter()
    for i, t in rows:
        ids_a, bytes_a, ids_b, bytes_b = _tokens(t) if t else ([], [], [], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found[i] = None
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, x, y = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(e, x) + 1, ends_b.index(e, y) + 1
            groups.append((ids_a[x:p], ids_b[y:q]))
            x, y = p, q
        links = Counter((u, v) for g in groups for u in g[0] for v in g[1])
        holders.update(links.keys())
        found[i] = ids_a, ids_b, groups, links
    best = defaultdict(int)
    for (u, _), n in holders.items():
        best[u] = max(best[u], n)
    out = {}
    for i, f in found.items():
        if f is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        ids_a, ids_b, groups, links = f
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        n_best = sum(n for k, n in links.items() if holders[k] == best[k[0]])
        out[i] = (len(ids_a), len(ids_b), len(groups), sum(links.values()), n_best, sum(n * holders[k] for k, n in links.items()), text)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, corpus, monkeypatch, small):
    if small:
        monkeypatch.setattr(alignment, "CHUNK", 3000)
    odd = ["a  b\n c", "  x ", " ", "▁a", "ﬁ① ", "\x00a", "<s><0x0A></s> <|endoftext|>", "　a  b  c", "été naïve — “x” 漢字かな交じり文 😀👩‍👩‍👧 end", "don't  we'll\t\t\n\n\n x", "a" * 3000, "x1y2" * 400, "é é é ñ ü " * 30]
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t, *_ in corpus] + [(2000 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_alignment(rows)
    got = by_id(alignment.align(docs))
    digests = by_id(alignment.with_digest(alignment.align(docs, texts=False))) if not small else {}
    assert len(got) == len(rows)
    for i, w in want.items():
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == w, i
        if digests:
            assert digests[i]["groups_sha256"] == (sha(w[6]) if w[0] else "")


def test_alignment_large_groups(spark, monkeypatch):
    """Groups beyond the listing limit go by their distinct ids."""
    monkeypatch.setattr(alignment, "AT_ONCE", 4)
    rng = np.random.default_rng(1)
    ids_a, ids_b = rng.integers(0, 9, 60), rng.integers(0, 9, 50)
    ga, gb = np.array([2, 30, 31, 60]), np.array([1, 20, 21, 50])
    first, doc = (np.append(0, ga[:-1]), np.append(0, gb[:-1])), np.array([0, 0, 1, 1])
    got = alignment._listed(ids_a, ids_b, first, (ga - first[0], gb - first[1]), doc, 10)
    want = Counter((int(doc[g]), int(ids_a[x] * 10 + ids_b[y])) for g in range(4) for x in range(first[0][g], ga[g]) for y in range(first[1][g], gb[g]))
    assert dict(zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), strict=True)) == want


def test_alignment_odd_rows(odd_docs, no_docs):
    got = alignment.align(odd_docs)
    assert got.count() == odd_docs.count()
    assert {(r["n_a"], r["groups"]) for r in got.filter("doc_id = 3 or doc_id = 4").collect()} == {(0, "")}
    assert alignment.align(no_docs).count() == 0


@pytest.mark.parametrize("thick", [suffix_array.THICK, 0])
def test_suffix_array(monkeypatch, thick):
    """Also with the recursion carried to the end; short strings of few symbols, runs and repeats."""
    monkeypatch.setattr(suffix_array, "THICK", thick)
    rng = np.random.default_rng(0)
    for k in range(300):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(0, 80)).astype(np.uint8)
        t = np.tile(t[: max(1, len(t) // 7)], 9) if k % 3 == 0 and len(t) else t
        b, order = t.tobytes(), suffix_array.suffix_array(t)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        common = suffix_array.common_prefixes(t, order, 20)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            same = next((x for x, (u, v) in enumerate(zip(b[i:], b[j:], strict=False)) if u != v), min(len(b) - i, len(b) - j))
            assert common[i] == min(same, 20)


def brute_removal(texts, length=200):
    places = defaultdict(list)
    raw = {i: (t or "").encode() for i, t in texts}
    for i, b in raw.items():
        for x in range(len(b) - length + 1):
            places[b[x : x + length]].append((i, x))
    gone = {i: np.zeros(len(b), bool) for i, b in raw.items()}
    for found in places.values():
        if len(found) > 1:
            for i, x in found:
                gone[i][x : x + length] = True
    out = {}
    for i, b in raw.items():
        g = gone[i]
        out[i] = len(b), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~g])
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, corpus, monkeypatch, small):
    """With small limits too: shards of few keys, keys dealt again by window, texts in parts, batches of few rows."""
    if small:
        for name, value in (("SHARD", 2000), ("WIDE", 3), ("SETTLE", 20_000), ("_SEGMENT", 5000)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(9)
    passage = " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))
    texts = [(i, t) for i, t, *_ in corpus]
    texts += [(3000 + i, f"{'x%d ' % rng.randrange(10**9) * 9}{passage} {rng.random()} tail {i}") for i in range(30)]
    texts += [(3100, "é" * 99), (3101, "é" * 100), (3102, "é" * 100), (3103, "ab" * 900), (3104, "z" * 199), (3105, "z" * 199), (3106, "y" * 201), (3107, passage[:199]), (3108, passage[1:201])]
    texts += [(3200, "".join(chr(97 + rng.randrange(26)) for _ in range(12_000)) + passage)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert len(got) == len(texts)
    for i, want in brute_removal(texts).items():
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want, i


def test_suffix_dedup_long_text(spark):
    """A text of several segments, with a copy of its end in another."""
    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, 2_300_000).astype(np.uint8).tobytes().decode()
    texts = [(1, long), (2, "start " + long[1_048_000:1_049_000] + " end"), (3, long[-300:])]
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")))
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2, 3)] == [(1300, 2), (1000, 1), (300, 1)]
    assert bytes(got[2]["kept"]) == b"start  end" and bytes(got[1]["kept"]) == (long[:1_048_000] + long[1_049_000:-300]).encode()


def test_suffix_dedup_odd_rows(odd_docs, no_docs):
    """Repeated rows and rows without an id remove each other's text; nulls are empty."""
    got = suffix_dedup.with_digest(suffix_dedup.remove_repeats(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    long = [r for r in got if r["n_bytes"] > 0]
    assert len(long) == 5 and all(r["n_removed"] == min(x["n_bytes"] for x in long) for r in long)
    assert {(r["n_removed"], r["kept_sha256"]) for r in got if not r["n_bytes"]} == {(0, sha(""))}
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
