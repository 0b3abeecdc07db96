"""Fill-in-the-middle by counted quantifiers.

``regexp_count`` gives the number n of a text's units; the row's own pattern then takes
the prefix, the middle and the suffix in a single match, with the possessive groups
``((?:unit){a}+)((?:unit){b-a}+)(.*+)``, and the replacement puts them in the order of the
form. Possessive quantifiers never give back what they took, so a match is one pass without
backtracking, whatever the length of the text. Units are counted in runs of 4,096 and the
rest one by one, so that no array as long as the text is built.

All of it is DataFrame functions in one projection: no shuffle, no Python worker.

The forms: ``psm`` is prefix, suffix, middle behind their marks, ``spm`` suffix, prefix,
middle, ``plain`` the text itself. Null text counts as empty; an empty text and one that
holds a mark are plain. A null id is the empty word in the draws. Rows may repeat; equal
ids draw equal cuts. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many take part, and of 100 that do so many put the suffix first.
MIDDLE_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
#: One code point; any other unit must match at every place of a text.
CODE_POINT = r"(?s:.)"
RUN = 4096
_ALL = r"(?s:.*+)"


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four integers below 2^32 of a document, from the digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def units(text: Column, unit: str = CODE_POINT) -> Column:
    """The number of units of a text."""
    run = rf"(?:{unit}){{{RUN}}}+"
    rest = F.regexp_extract(text, rf"\A(?:{run})*+({_ALL})\z", 1)
    return F.regexp_count(text, F.lit(run)).cast("long") * RUN + F.regexp_count(rest, F.lit(unit))


def _pattern(a: Column, b: Column, unit: str) -> Column:
    return F.format_string(rf"\A((?:{unit}){{%d}}+)((?:{unit}){{%d}}+)({_ALL})\z", a, b - a)


def _orders(prefix: str, suffix: str, middle: str) -> tuple[str, str]:
    return f"{prefix}$1{suffix}$3{middle}$2", f"{suffix}$3{prefix}$1{middle}$2"


def transform(
    docs: DataFrame,
    unit: str = CODE_POINT,
    middle_percent: int = MIDDLE_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    seed: int = 1,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    ``marks`` are those of the prefix, suffix and middle, without ``$`` and backslashes.
    """
    psm, spm = _orders(*marks)
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = draws(F.col(id_col), seed)
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), units(text, unit).alias("n"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1)))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.col("text").contains(mark)
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= middle_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first_percent, "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    docs = docs.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    cut = F.regexp_replace("text", _pattern(F.col("a"), F.col("b"), unit), F.when(F.col("form") == "spm", spm).otherwise(psm))
    whole = F.col("form") == "plain"
    return docs.select(
        "doc_id",
        "n",
        "form",
        F.when(~whole, F.col("a")).alias("prefix_chars"),
        F.when(~whole, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(whole, F.col("text")).otherwise(cut).alias("output"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text again. No part holds a mark, so each mark's first place is where it was put."""
    p, s, m = map(re.escape, marks)
    part = r"((?s:.*?))"
    psm = F.regexp_replace(output, rf"\A{p}{part}{s}{part}{m}({_ALL})\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"\A{s}{part}{p}{part}{m}({_ALL})\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def with_digests(made: DataFrame) -> DataFrame:
    """Digests of the output, and of the text restored from output and form alone."""
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
