"""Language identification: letters, Kneser-Ney by dictionaries, calibration that is alike at every size."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import language


@pytest.mark.parametrize(("text", "letter"), [(None, False), ("", False), ("½ ²", False), ("①②③", False), ("Ⅷ", False), ("12 _ !", False), ("½a", True), ("①é", True), ("日", True), ("ʰ", True), ("_x", True)])
def test_letters_are_letters_only(text, letter):
    assert language.has_letter(text) is letter


def plain_models(texts, order=4):
    """One language's Kneser-Ney counts in dictionaries: (grams by length, followers by context)."""
    grams = [Counter() for _ in range(order + 1)]
    for text in texts:
        for word in language.words_of(text):
            s = language.START * (order - 1) + word.decode() + language.END
            for i in range(order - 1, len(s)):
                for n in range(1, order + 1):
                    grams[n][s[i - n + 1 : i + 1]] += 1
    for n in range(1, order):  # lower orders: different symbols seen before
        before = defaultdict(set)
        for longer in grams[n + 1]:
            before[longer[1:]].add(longer[0])
        grams[n] = Counter({g: len(s) for g, s in before.items()})
    return grams


def plain_entropy(grams, base, text, order=4):
    total, symbols = 0.0, 0
    for word in language.words_of(text):
        s = language.START * (order - 1) + word.decode() + language.END
        for i in range(order - 1, len(s)):
            p = base
            for n in range(1, order + 1):
                context = s[i - n + 1 : i]
                once, twice = (sum(c == k for c in grams[n].values()) for k in (1, 2))
                discount = once / (once + 2 * twice) if once and twice else 0.5
                own = [c for g, c in grams[n].items() if g[:-1] == context]
                if own:
                    p = max(0.0, grams[n].get(s[i - n + 1 : i + 1], 0) - discount) / sum(own) * (1 if s[i - n + 1 : i + 1] in grams[n] else 0) + discount * len(own) / sum(own) * p
            total -= math.log(p)
            symbols += 1
    return total / max(1, symbols)


def corpus(r, letters, rows, start):
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 5)))
    return [(start + k, " ".join(word() for _ in range(r.randint(1, 12)))) for k in range(rows)]


def test_entropies_by_dictionaries(spark):
    r = random.Random(11)
    rows = [(i, t, "aa") for i, t in corpus(r, "abcdé", 30, 0)] + [(i, t, "bb") for i, t in corpus(r, "cdefg", 30, 100)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    plain = {lang: plain_models([t for _, t, own in rows if own == lang]) for lang in ("aa", "bb")}
    base = 1 / len({g for grams in plain.values() for g in grams[1]})
    new = [(k, t) for k, t in corpus(r, "abcdefgx", 25, 0)] + [(99, "Abc"), (98, "½")]
    got = {x["doc_id"]: x for x in language.identify(spark.createDataFrame(new, "doc_id bigint, text string"), learned, keep={"doc_id": "doc_id"}).collect()}
    for k, t in new:
        each = {lang: plain_entropy(grams, base, t) for lang, grams in plain.items()}
        if k == 98:
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
        else:
            assert got[k]["entropy"] == pytest.approx(min(each.values()), rel=1e-4) and got[k]["lang_pred"] == min(each, key=each.get)


def test_a_language_of_one_text_and_a_bound_on_languages(spark):
    r = random.Random(12)
    rows = [(i, t, "aa") for i, t in corpus(r, "abcde", 200, 0)] + [(i, t, "bb") for i, t in corpus(r, "mnopq", 200, 1_000)] + [(5_000, "uvw xyz uvw", "cc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language.learn(docs)
    assert learned[0].langs == ["aa", "bb", "cc"] and math.isinf(learned[2]["cc"]) and math.isfinite(learned[2]["aa"])
    got = language.identify(docs, learned, keep={"lang": "lang"})
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert language.learn(docs, most_langs=2)[0].langs == ["aa", "bb"]
