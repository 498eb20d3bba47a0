"""Names, keys and tolerant JSON as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters and their transliteration.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))


def transliterated(text: Column) -> Column:
    for letter, plain in UMLAUTS:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return text


def slug(text: Column) -> Column:
    """Transliterate, write runs of other characters as one underscore, strip them at the ends."""
    return F.regexp_replace(F.regexp_replace(transliterated(text), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def norm_key(text: Column) -> Column:
    """Lower case, transliterated, ASCII letters and digits only: names that fold together are one key."""
    return F.regexp_replace(F.lower(transliterated(text)), r"[^a-z0-9]", "")


def first_match(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that fits; the order is part of the meaning."""
    out = F.lit(default)
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def sha_prefix(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def hash_fold(text: Column, folds: int) -> Column:
    """Fold of a name: the first eight hex digits of its SHA-256 modulo the folds."""
    return (F.conv(sha_prefix(text, 8), 16, 10).cast("bigint") % folds).cast("int")


def trailing_index(text: Column) -> Column:
    """The number in `name(7)` or `name_7`, else null."""
    for_pattern = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(for_pattern(r"\((\d+)\)$"), for_pattern(r"_(\d+)$")).cast("int")


def json_object(text: Column) -> Column:
    """The first `{...}` block without inner braces, code fences taken off; null if there is none."""
    plain = F.regexp_replace(text, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(plain, r"\{[^{}]*\}", 0), F.lit(""))


BRACE = re.compile(r"[{}]")


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_candidates(texts: pd.Series) -> pd.Series:
    """Every balanced `{...}` block of a reply, in order, code fences taken off (null: none)."""

    def blocks(text: str | None) -> list[str]:
        plain, depth, begin, found = re.sub(r"```(?:json)?", "", text or ""), 0, 0, []
        for brace in BRACE.finditer(plain):  # between braces nothing is looked at
            if brace[0] == "{":
                begin = brace.start() if depth == 0 else begin
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0:
                    found.append(plain[begin : brace.end()])
        return found

    return texts.map(blocks)


def first_valid(candidates: Column, schema: str, keys: list[str]) -> Column:
    """The first candidate that parses and has every key as a number; null if none does."""
    parsed = F.transform(candidates, lambda c: F.from_json(c, schema))
    whole = F.filter(parsed, lambda p: F.forall(F.array(*[p[k] for k in keys]), lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.try_element_at(whole, F.lit(1))


def reply_notes(reply: Column, shares: list[str], diameters: list[str], off: float = 1.0) -> Column:
    """Notes on a parsed reply: sum_pct of its shares, whether they sum to 100 within `off`, and whether its diameters rise (monotone_d)."""
    total = sum((reply[s] for s in shares[1:]), reply[shares[0]])
    rising = F.lit(True)
    for low, high in zip(diameters, diameters[1:]):
        rising = rising & (reply[low] <= reply[high])
    return F.struct(total.alias("sum_pct"), (F.abs(total - 100) <= off).alias("whole"), rising.alias("monotone_d"))


def letter_family(name: Column) -> Column:
    """The first letter, upper case, with the first digit after it: `Hill-27b` is H2; null without both."""
    found = F.regexp_extract(name, r"(\p{L})[^\p{N}]*(\p{N})", 0)
    return F.nullif(F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, -1, 1)), F.lit(""))


def rectangle(packed: Column) -> Column:
    """`x0,y0,x1,y1` as a struct of integers; null unless it has four of them."""
    part = F.transform(F.split(packed, ","), lambda p: F.trim(p).try_cast("int"))
    named = F.struct(*[F.get(part, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return F.when((F.size(part) == 4) & F.forall(part, lambda p: p.isNotNull()), named)


def sample_token(name: Column, ids: Column) -> Column:
    """The first of an array of ids that a name holds as a whole token (between characters that are no letters or digits)."""
    padded = F.concat(F.lit("_"), F.regexp_replace(name, r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.get(F.filter(ids, lambda i: F.contains(padded, F.concat(F.lit("_"), i, F.lit("_")))), F.lit(0))


def stripped_name(name: Column, prefix: str) -> Column:
    """A name without a leading pattern and without a closing `(n)`."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, f"^(?:{prefix})", ""), r"\s*\(\d+\)$", ""))


def without_nul(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\0"), F.lit("")))


def first_token(text: Column) -> Column:
    return F.substring_index(F.trim(text), " ", 1)


def destination(root: str, sample: Column, path: Column) -> Column:
    """Where a file belongs: a folder a sample, under the file's own name."""
    return F.concat_ws("/", F.lit(root), slug(sample), F.substring_index(path, "/", -1))


def retried(first: Column, second: Column) -> list[Column]:
    """[retry_fired, recovered, value] of a reply that is asked for once more if there is none."""
    fired = first.isNull()
    return [fired, fired & second.isNotNull(), F.coalesce(first, second)]
