"""Spelling variants against all pairs of words compared one by one, and on odd rows."""

import re
import zlib
from collections import Counter

import pytest

from siltstone.llm import queries, spelling


def apart_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(counts):
    """The contract word by word: every word against every other."""
    near = {w: [v for v in counts if apart_by_one(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def found(spark, df, **options):
    return {r["word"]: tuple(r)[1:] for r in spelling.variants(df, **options).collect()}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def test_query_word_by_word(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == plain_counts(map(tuple, rows)) and len(got) > 300
    assert found(spark, frame(spark, got)) == plain_variants(got)


def test_query_against_its_sql(same_rows):
    same_rows(queries.QUERIES["op13_spelling_variants"], queries.ORACLE["op13_spelling_variants"])


@pytest.mark.parametrize("block", [3, 4_000])
def test_every_edit_of_a_word_is_met_in_blocks_of_any_size(spark, block):
    word = "anñaelà"
    edits = {word: 99} | {word[:k] + word[k + 1 :]: 2 + k for k in range(len(word))}
    for c in "aeézaß÷Àå":  # letters that share a bit of the place mask among them
        edits |= {word[:k] + c + word[k + 1 :]: 3 for k in range(len(word))} | {word[:k] + c + word[k:]: 5 for k in range(len(word) + 1)}
    edits[word] = 99
    assert found(spark, frame(spark, edits), block=block) == plain_variants(edits)


def test_forms_are_followed_to_the_root(spark):
    chain = {"abcde" + "x" * k: 2 ** (20 - k) for k in range(20)}
    got = found(spark, frame(spark, chain))
    assert got == plain_variants(chain) and {r[1] for r in got.values()} == {"abcde"}
    tied = {"abcde": 3, "abcdf": 8, "abcdg": 8, "abcdé": 8, "zzzzz": 4}
    assert found(spark, frame(spark, tied)) == plain_variants(tied)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word"), (None, "Letter LETTER letter"), (4, "Éclair éclair Éclair Éclair"), (4, "Éclair"), (5, "longword " * 200_000), (6, "x" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as word", "2 as n", "3 as run", "4 as id", "5 as key")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == plain_counts(rows) == {"letter": 3, "Éclair": 4, "longword": 200_000}
    assert found(spark, spelling.word_counts(df)) == plain_variants(got)
    assert spelling.variants(spelling.word_counts(df.where("false"))).count() == 0
