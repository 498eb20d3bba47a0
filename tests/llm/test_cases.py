"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, compression, knn, language, language_model, packing, pieces, quality_rules, simhash, toxicity, url_filter

NAMES = ["score", "kept", "lang_pred", "fp", "row", "words", "n_words", "rank", "piece", "length", "offset", "verdict", "id", "__row"]
LONG = "lorem ipsum dolor " * 20_000
TEXTS = [None, "", "   \n\t ", "one", "Same text, twice over.", "Same text, twice over.", LONG, "x" * 30_000, "1234 !!! ---", "caf\u00e9 \U0001d518 \u65e5\u672c"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, "en" if k % 2 else None) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({n: F.lit("clash") for n in NAMES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id bigint, y int")


def runs(odd, labels):
    marked = odd.withColumn("target", F.col("doc_id") % 2 == 0)
    path = pieces.default_model()
    return {
        "pieces": lambda d: pieces.decode(pieces.encode(d, path), path),
        "language_model": lambda d: language_model.score(d, language_model.fit(d, d.where("doc_id % 2 = 0")), keep={"doc_id": "doc_id"}),
        "quality_rules": lambda d: quality_rules.verdicts(d, [F.col("doc_id")]),
        "quality_kept": lambda d: quality_rules.kept_rows(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.learn(marked, labels, "y", steps=5), keep={"doc_id": "doc_id"}),
        "toxicity_kept": lambda d: toxicity.kept_rows(d, {"level": 0.1}),
        "simhash": lambda d: simhash.near_duplicates(d),
        "distinct": lambda d: simhash.distinct_rows(d),
        "packing": lambda d: packing.pack_documents(d, packing.default_vocabulary(), with_ids=True),
        "language": lambda d: language.identify(d, language.learn(odd), keep={"doc_id": "doc_id"}),
        "compression": lambda d: compression.score(d, compression.learn(odd, labels, "y"), keep={"doc_id": "doc_id"}),
    }


@pytest.mark.parametrize("name", ["pieces", "language_model", "quality_rules", "quality_kept", "toxicity", "toxicity_kept", "simhash", "distinct", "packing", "language", "compression"])
def test_odd_rows_and_empty_tables(name, odd, labels):
    work = runs(odd, labels)[name]
    rows = work(odd).collect()
    if name not in ("pieces", "packing", "quality_kept", "distinct"):
        assert len(rows) == odd.count()
    if name in ("quality_kept", "distinct", "toxicity_kept"):
        assert work(odd).columns == odd.columns
    assert work(odd.where("false")).count() == 0


def test_defined_values_of_odd_rows(odd, labels):
    work = runs(odd, labels)
    by_id = lambda name: {r["doc_id"]: r for r in work[name](odd).collect() if r["doc_id"] not in (None, 4)}
    losses = by_id("language_model")
    assert all(tuple(losses[k])[1:] == (0, 0.0, 0.0, 0.0) for k in (0, 1, 2)) and losses[6]["n_words"] == 60_000
    rules = by_id("quality_rules")
    assert all(rules[k]["base_failed"] and not rules[k]["kept"] and rules[k]["n_words"] == 0 for k in (0, 1, 2))
    assert rules[6]["n_repeat_words"] == 60_000 and rules[7]["word_chars"] == 30_000
    prints = by_id("simhash")
    assert all((prints[k]["fingerprint"], prints[k]["component_id"]) == ("0" * 16, 0) for k in (0, 1, 2))
    langs = by_id("language")
    assert all((langs[k]["lang_pred"], langs[k]["score"]) == ("und", 0.0) for k in (0, 1, 2, 8)) and langs[9]["lang_pred"] == "en"
    assert all(by_id(name)[0]["score"] == by_id(name)[1]["score"] for name in ("toxicity", "compression"))
    packed = by_id("packing")
    assert all((packed[k]["length"], packed[k]["ids"]) == (1, [1]) for k in (0, 1, 2))
    segmented = {r["doc_id"]: r for r in work["pieces"](odd).collect()}
    assert (segmented[0]["decoded"], segmented[0]["score"], segmented[1]["decoded"]) == ("", 0.0, "")


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('61ff62') as string) as text, 'en' as lang union all select 2L, 'plain words here', 'en'")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, y int")
    marked = df.withColumns({n: F.lit("clash") for n in NAMES})
    for name, work in runs(marked, labels).items():
        assert name in ("quality_kept", "toxicity_kept") or work(marked).count() >= 1, name


def test_an_id_with_many_texts_and_both_labels_is_one_drawn_document(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id bigint, y int")
    sample, rows = common.labelled_sample(docs, labels, "y", 100)
    assert [(y, t) for y, _, t in sample] == [(0, "other"), (1, "text 0")] and rows == {0: 1, 1: 1}


def test_models_without_labels(spark, odd, labels):
    none = labels.where("false")
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(odd, none, "y")).collect()} == {0.0}
    assert {r["score"] for r in compression.score(odd, compression.learn(odd, none, "y")).collect()} == {0.5}
    assert {r["score"] for r in compression.score(odd, compression.learn(odd, labels.where("y = 1"), "y")).collect()} == {1.0}
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(odd.where("false"))).collect()} == {"und"}


def test_distinct_keeps_one_row_of_a_class(spark):
    rows = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "other words here now"), (None, "other words here now"), (7, None), (9, "")]
    kept = simhash.distinct_rows(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == [("2", "a b c d"), ("7", "None"), ("None", "other words here now")]


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/x?y#z"), (6, "https://a.example.com/en/" + "q" * 50_000), (6, "x://fr.net/fr/1"), (7, "http://com/en"), (8, "http://spamhost.org/a"), (9, "http://a.com?x=/en/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "rule": F.lit(3), "canonical": F.lit(4)})
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()]
    assert got == [
        (1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "", None, "allow"), (5, "www.example.com", "www.example.com/en/", "allow"),
        (6, "a.example.com", "example.com/en/", "block"), (6, "fr.net", "net/fr/", "block"), (7, "com", "com/", "allow"), (8, "spamhost.org", None, "block"), (9, "a.com", None, "allow"),
    ]
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [0.5, -0.5]) for k in range(6)] + [(20, [1.0, 0.0]), (21, None), (22, []), (23, [nan, 1.0]), (24, [inf, 1.0]), (25, [None, 1.0]), (26, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({n: F.lit(0) for n in ("cell", "d", "v", "score", "is_query")})
    got = [tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect()]
    tied = 32 * 32 * 2
    assert got == [(0, 1, 1, tied), (0, 2, 2, tied), (0, 3, 3, tied), (0, 4, 4, tied), (20, 1, 0, 2048), (20, 2, 1, 2048), (20, 3, 2, 2048), (20, 4, 3, 2048)]
    assert knn.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert knn.top_k(df, F.col("vec_id") < 0).count() == 0


def test_vectors_of_the_commonest_length_take_part(spark):
    rows = [(k, [1.0, 0.0, 0.5]) for k in range(1, 260)] + [(k, [1.0, k / 1000]) for k in range(260, 860)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    got = knn.top_k(df, F.col("vec_id") % 100 == 0, k=2).collect()
    assert {r["query_id"] for r in got} == {300, 400, 500, 600, 700, 800} and min(r["vec_id"] for r in got) >= 260
