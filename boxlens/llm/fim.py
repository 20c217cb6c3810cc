"""Operator 12: fill-in-the-middle documents by counted, possessive quantifiers.

``regexp_count`` gives the number n of units of a text.  The two cuts a <= b are drawn from the
document's id, and one match of a pattern made for the row, with the possessive groups
``unit{a}`` and ``unit{b - a}`` and the rest, captures prefix, middle and suffix; the
replacement puts them in the order of the row's form.  Possessive groups are matched in a loop
without backtracking, so the work is linear in the text and its depth constant, however long it is.

All of it is column expressions on one row: one narrow pass over the documents, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT = 10          # of the documents stay plain
SPM_PERCENT = 20            # of the others have the suffix first
SEED = 1


def _draw(hashed: Column, k: int) -> Column:
    """The k-th group of eight hex digits as a number."""
    return F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with the columns n (units of the text), form (plain, psm, spm), output, and
    prefix_chars and middle_chars (code points; null if plain) added, replacing columns of these names.

    Every whole text takes part.  A null or empty text, one that holds a marker, and a tenth of the
    others by the draw are plain: output is the text itself (null: empty).  The draws depend on
    the seed and the doc_id only, so repeated rows give equal outputs; a null doc_id is drawn like
    an empty one.  doc_id may be of any type that casts to string."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")     # no name can clash below
    d = docs.select(own, text.alias("text"), hashed.alias("h"))
    d = d.select("_row", "text", "h", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"))
    cuts = [F.pmod(_draw(F.col("h"), k), F.col("n") + 1) for k in (0, 1)]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (_draw(F.col("h"), 2) % 100 >= 100 - PLAIN_PERCENT)
    d = d.select("_row", "text", "n", F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"),
                 F.when(plain, "plain").when(_draw(F.col("h"), 3) % 100 < SPM_PERCENT, "spm").otherwise("psm").alias("form"))
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), F.col("a"), F.lit(rf"}}+)((?:{UNIT}){{"), F.col("b") - F.col("a"), F.lit(r"}+)(.*)\z"))
    order = F.when(F.col("form") == "psm", F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")).otherwise(F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
    d = d.select("_row", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(
        F.regexp_replace("text", pattern, order)).alias("output"))
    prefix, middle, _ = parts(F.col("output"), F.col("form"))
    added = ["n", "form", "output", "prefix_chars", "middle_chars"]
    return d.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in added], "n", "form", "output",
                    F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"))


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """(prefix, middle, suffix) of an output; null for the form plain.  The text holds no
    marker, so each marker is found where the transformation put it."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.when(form != "plain", F.substring_index(output, MIDDLE, -1))
    first, second = ([F.substring_index(head, mark, k) for k in (1, -1)] for mark in (SUFFIX, PREFIX))
    # psm: <P> prefix <S> suffix; spm: <S> suffix <P> prefix; the leading marker has three characters
    prefix = F.when(form == "psm", F.substring(first[0], len(PREFIX) + 1, 2**31 - 1)).when(form == "spm", second[1])
    suffix = F.when(form == "psm", first[1]).when(form == "spm", F.substring(second[0], len(SUFFIX) + 1, 2**31 - 1))
    return prefix, middle, suffix


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    return F.when(form == "plain", output).otherwise(F.concat(*(lambda p, m, s: (p, m, s))(*parts(output, form))))


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of
    the text restored from it."""
    t = transform(docs.select("doc_id", "text"), seed)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"),
                    _sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
