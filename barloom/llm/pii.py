"""Personal data by patterns, and the terms that give it away by co-occurrence.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. For
every protected entity c (a value found) and every term t of the documents that hold it,
document counts over the whole corpus give the information content IC(c) = log(N / n_c) and
the pointwise mutual information PMI(c; t) = log(p(t | c) / p(t)). A term whose PMI reaches
a share of the entity's IC discloses it (Sanchez and Batet, "C-sanitized", 2016): beyond
``generalise`` it is replaced by its shape, beyond ``remove`` it is taken out, wherever it
stands in a document that holds the entity. Few documents say little, so p(t | c) is
smoothed by ``prior`` documents drawn from the whole corpus: (n_ct + prior p(t)) / (n_c + prior).

Entities of the same documents have the same counts and are one class. A term of larger
p(t) than p(c) ** ``generalise`` of the most frequent entity cannot disclose any, as
p(t | c) is at most 1, and is left out before pairs are made.

All of it is DataFrame functions. Match positions come from splitting a text by the
pattern: running sums of the lengths between and of matches, in code points. The patterns
use possessive quantifiers and start only at the edge of a run, or where the last match
ended, which finds the same leftmost matches in linear time and constant stack.

Null text counts as empty. Rows are known by id and text, so rows that repeat or have no id
get their own text's result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot hold a match.
_NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}
_TERM = r"[\p{L}\p{N}_]{3,}+"


@dataclass(frozen=True)
class Disclosure:
    """``prior`` documents that smooth a pair's counts; shares of IC."""

    prior: float = 1.0
    generalise: float = 0.8
    remove: float = 0.95


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), add)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    part = F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255)
    n = F.length(_digits(match))
    return (
        F.when(kind == 0, True)
        .when(kind == 1, part)
        .when(kind == 2, F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False))
        .otherwise(n.between(8, 15))
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def matches(rows: DataFrame) -> DataFrame:
    """Valid base spans: doc_id, text_key, kind, start, end, match."""
    text = F.col("text")

    def of(i: int) -> Column:
        pattern = F.lit(_PATTERNS[KINDS[i]])
        found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, _PATTERNS[KINDS[i]], -1)
        none = F.array().cast("array<string>")
        has = _NEEDS[KINDS[i]](text)
        return F.struct(F.lit(i).alias("kind"), F.when(has, found).otherwise(none).alias("found"), F.when(has, gaps).otherwise(none).alias("gaps"))

    kinds = rows.select("doc_id", "text_key", F.explode(F.array(*map(of, range(len(KINDS))))).alias("k")).filter(F.size("k.found") > 0)
    n = F.size("k.found")
    each = F.arrays_zip(F.col("k.found").alias("match"), F.slice("k.gaps", F.lit(1), n).alias("before"))
    one = kinds.select("doc_id", "text_key", F.col("k.kind").alias("kind"), F.posexplode(each).alias("pos", "m"))
    one = one.select("doc_id", "text_key", "kind", "pos", F.col("m.match").alias("match"), F.length("m.before").alias("skip"), F.length("m.match").alias("len"))
    one = one.dropDuplicates(["doc_id", "text_key", "kind", "pos"])
    order = Window.partitionBy("doc_id", "text_key", "kind").orderBy("pos")
    end = F.sum(F.col("skip") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    return placed.filter(_valid(F.col("kind"), F.col("match"))).select("doc_id", "text_key", "kind", "start", "end", "match")


def entities() -> Column:
    """What a span protects: its value and its group."""
    digits = _digits(F.col("match"))
    value = F.when(F.col("kind") >= 2, digits).otherwise(F.lower("match"))
    group = (
        F.when(F.col("kind") == 0, F.regexp_extract(F.lower("match"), "@(.*)", 1))
        .when(F.col("kind") == 1, F.substring_index("match", ".", 2))
        .when(F.col("kind") == 2, F.left(digits, F.lit(6)))
        .otherwise(F.left(digits, F.lit(4)))
    )
    return F.array(F.concat_ws(":", "kind", value), F.concat_ws(":", "kind", F.lit("group"), group))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def term_counts(rows: DataFrame) -> DataFrame:
    """Documents that hold each term."""
    return rows.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def classes(base: DataFrame) -> DataFrame:
    """The classes of entities that each document holds: doc_id, text_key, class, n_c."""
    each = base.select("doc_id", "text_key", F.explode(entities()).alias("entity")).distinct()
    of = each.groupBy("entity").agg(F.bit_xor(F.xxhash64("doc_id", "text_key")).alias("class"), F.count(F.lit(1)).alias("n_c"))
    return each.join(of, "entity").select("doc_id", "text_key", "class", "n_c").distinct()


def holding(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Each document that holds an entity, once: doc_id, text_key, text, its classes."""
    text = F.col("text")
    maybe = None
    for kind in KINDS:
        one = _NEEDS[kind](text) & text.rlike(_PATTERNS[kind])
        maybe = one if maybe is None else maybe | one
    lists = held.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("class", "n_c")).alias("classes"))
    found = rows.filter(maybe)
    return found.join(lists, _same(found, lists)).select(found["doc_id"], found["text_key"], "text", "classes").dropDuplicates(["doc_id", "text_key"])


def occurrences(rows: DataFrame, texts: DataFrame, held: DataFrame, rule: Disclosure) -> DataFrame:
    """Terms with the classes they share a document with: doc_id, text_key, term, n_t, class, n_c, n."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(held.agg(F.max("n_c").alias("most")))
    most = F.col("n") * F.pow(F.col("most") / F.col("n"), F.lit(rule.generalise))
    rare = term_counts(rows).crossJoin(F.broadcast(total)).filter(F.col("n_t") <= most + 1e-6).select("term", "n_t", "n")
    terms = texts.select("doc_id", "text_key", "classes", F.explode(_terms(F.col("text"))).alias("term"))
    return terms.join(rare, "term").select("doc_id", "text_key", "term", "n_t", "n", F.inline("classes"))


def disclosing(near: DataFrame, rule: Disclosure) -> DataFrame:
    """Pairs (class, term) with the share of the entities' information content that the term reveals."""
    pairs = near.groupBy("class", "n_c", "term", "n_t", "n").agg(F.count(F.lit(1)).alias("n_ct"))
    ic = F.log(F.col("n") / F.col("n_c"))
    p = F.col("n_t") / F.col("n")
    pmi = F.log((F.col("n_ct") + rule.prior * p) / (F.col("n_c") + rule.prior) / p)
    return pairs.filter(ic > 0).select("class", "n_c", "term", (pmi / ic).alias("reveals")).filter(F.col("reveals") >= rule.generalise)


def places(texts: DataFrame) -> DataFrame:
    """Every term of a text with its place in code points: doc_id, text_key, term, start, end."""
    words, gaps = F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.split("text", _TERM, -1)
    each = F.arrays_zip(words.alias("word"), F.slice(gaps, F.lit(1), F.size(words)).alias("gap"))
    one = texts.select("doc_id", "text_key", F.posexplode(each).alias("pos", "w"))
    one = one.select("doc_id", "text_key", "pos", F.lower("w.word").alias("term"), F.length("w.word").alias("len"), F.length("w.gap").alias("skip"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("pos")
    end = F.sum(F.col("skip") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return one.withColumn("end", end).select("doc_id", "text_key", "term", (F.col("end") - F.col("len")).alias("start"), "end")


@dataclass
class Found:
    """``base``: valid spans; ``terms``: spans of disclosing terms, with ``action``; ``rows``: the documents."""

    rows: DataFrame
    base: DataFrame
    terms: DataFrame


def find(docs: DataFrame, rule: Disclosure = Disclosure(), scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text") -> Found:
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    rows = keyed(docs, id_col, text_col)
    base = scratch.table(matches(rows), "base")
    held = scratch.table(classes(base), "held")
    texts = scratch.table(holding(rows, held), "texts")
    near = scratch.table(occurrences(rows, texts, held, rule), "near")
    pairs = scratch.table(disclosing(near, rule), "pairs")
    said = scratch.table(near.join(pairs, ["class", "n_c", "term"]).groupBy("doc_id", "text_key", "term").agg(F.max("reveals").alias("reveals")), "said")
    at = places(texts)
    hit = at.join(said, _same(at, said) & (at["term"] == said["term"])).select(at["doc_id"], at["text_key"], "start", "end", "reveals")
    spans = base.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    hit = hit.join(spans, _same(hit, spans)).select(hit["doc_id"], hit["text_key"], "start", "end", "reveals", "taken")
    free = ~F.exists("taken", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    action = F.when(F.col("reveals") >= rule.remove, "remove").otherwise("generalise")
    return Found(rows, base, scratch.table(hit.filter(free).select("doc_id", "text_key", "start", "end", "reveals", action.alias("action")), "terms"))


def _named(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (*KINDS, "term"))), kind + 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _named(s["kind"]), s["start"], s["end"])), ",")


def _spans(found: Found) -> DataFrame:
    """Per document with any: all spans, in order of kind and place."""
    every = found.base.select("doc_id", "text_key", "kind", "start", "end", F.lit("replace").alias("action")).unionByName(
        found.terms.select("doc_id", "text_key", F.lit(len(KINDS)).alias("kind"), "start", "end", "action")
    )
    return every.groupBy(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "action"))).alias("all"))


def _beside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,action:string>>")
    on = rows["doc_id"].eqNullSafe(spans["span_id"]) & (rows["text_key"] == spans["span_key"])
    return rows.join(spans, on, "left").withColumn("all", F.coalesce("all", none))


def report(found: Found) -> DataFrame:
    """One row per input row: counts, the digest of the base spans and all spans."""
    beside = _beside(found.rows.select("doc_id", "text_key"), _spans(found))
    base = F.filter("all", lambda s: s["kind"] < len(KINDS))

    def count(kind: int, name: str) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")

    counts = [count(i, k) for i, k in enumerate((*KINDS, "term"))]
    return beside.select("doc_id", *counts[:-1], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), counts[-1])


def sanitised(found: Found) -> DataFrame:
    """One row per input row with its text: base spans become [KIND], disclosing terms their
    shape (letters and digits masked) or nothing. Of overlapping spans the first counts."""
    beside = _beside(found.rows, _spans(found))
    in_order = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["action"].alias("action"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        cut = F.substring(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        shape = F.regexp_replace(F.regexp_replace(cut, r"\p{L}", "x"), r"\p{N}", "0")
        new = F.when(s["kind"] < len(KINDS), F.concat(F.lit("["), F.upper(_named(s["kind"])), F.lit("]"))).when(s["action"] == "remove", F.lit("")).otherwise(shape)
        before = F.substring(F.col("text"), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))
        moved = F.struct(F.concat(a["out"], before, new).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= a["at"], moved).otherwise(a)

    tail = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, F.length("text")))
    return beside.select("doc_id", F.aggregate(in_order, start, step, tail).alias("text"))
