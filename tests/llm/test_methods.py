"""Every operator against a brute-force version, SQL, a round trip or held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import common, compression, knn, language, language_model, packing, pieces, quality_rules, simhash, toxicity, url_filter
from siltstone.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE[name])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def every_segmentation(lattice, text):
    marked = "".join(pieces.MARK + c for c in text.split(" ")) if text else ""
    found = []

    def go(at, score, ids):
        if at == len(marked):
            found.append((score, tuple(ids)))
        for end in range(at + 1, min(len(marked), at + lattice.longest) + 1):
            s = lattice.score.get(marked[at:end], lattice.unknown if end == at + 1 else None)
            if s is not None:
                go(end, score + s, ids + lattice.ids_of(marked[at:end]))

    go(0, 0.0, [])
    return sorted(found, key=lambda x: -x[0])


def test_nbest_against_all_segmentations():
    import sentencepiece

    path = pieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder, r = pieces.Encoder(path, 4), random.Random(5)
    for _ in range(150):
        text = "".join(r.choice("the  an. é日𝔘in\n") for _ in range(r.randint(0, 9)))
        ours, everything = encoder.encode([text])[0], every_segmentation(encoder.lattice, text)
        assert [s for s, _ in ours] == pytest.approx([s for s, _ in everything[:4]])
        assert len({tuple(i) for _, i in ours}) == len(ours) and {tuple(i.tolist()) for _, i in ours} <= {i for _, i in everything}
        assert all(sp.decode(i.tolist()) == text for _, i in ours)


def test_combinations_from_the_best_down():
    r = random.Random(8)
    options = [sorted(((-r.randrange(6) / 2, None) for _ in range(4)), reverse=True) for _ in range(5)]
    every = sorted(((sum(o[k][0] - o[0][0] for o, k in zip(options, way, strict=True)), way) for way in itertools.product(range(4), repeat=5)), key=lambda x: (-x[0], x[1]))
    assert pieces.best_ways(options, 200) == every[:200]


def test_encode_and_decode_whole_documents(spark, sf):
    out = QUERIES["op1_sentencepiece_nbest"](spark, sf)
    assert out.where("not round_trip").count() == 0
    worse = out.groupBy("doc_id").agg(F.max_by("score", "rank").alias("last"), F.min_by("score", "rank").alias("first")).where("last > first")
    assert worse.count() == 0


# 2


def test_losses_against_dictionaries(spark):
    texts = ["a b a c", "b b a", "", None, "c a b z"]
    goal = ["a b a b", "q a b"]
    frame = lambda rows: spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id int, text string")
    models = language_model.fit(frame(texts), frame(goal), vocabulary=4)
    got = {r["doc_id"]: r for r in language_model.score(frame(texts), models, keep={"doc_id": "doc_id"}).collect()}
    split = [[w if w in ("a", "b", "c", "q") else "?" for w in (t or "").split()] for t in texts + goal]
    ranked = Counter(w for t in texts + goal for w in (t or "").split())
    kept = {w for w, _ in sorted(ranked.items(), key=lambda x: (-x[1], x[0]))[:4]}
    split = [[w if w in kept else "?" for w in (t or "").split()] for t in texts + goal]
    sides = {"background_loss": split[: len(texts)], "target_loss": split[len(texts) :]}
    pool = Counter(w for t in split for w in t)
    total = sum(pool.values()) + 5
    for name, own in sides.items():
        word = Counter(w for t in own for w in t)
        pair = Counter(x for t in own for x in zip(["^", *t], t, strict=False))
        context = Counter(h for t in own for h in ["^", *t][:-1] if t)
        n, a, k = sum(word.values()), language_model.UNIGRAM_PRIOR, language_model.CONTEXT_PRIOR
        for i, t in enumerate(split[: len(texts)]):
            losses = []
            for h, w in zip(["^", *t], t, strict=False):
                p = (word[w] + a * (pool[w] + 1) / total) / (n + a)
                losses.append(-np.log((pair[h, w] + k * p) / (context[h] + k)))
            assert got[i][name] == pytest.approx(np.mean(losses) if losses else 0.0, abs=1e-4)


def test_losses_of_more_words_than_a_bounded_table_holds(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{k}" for k in range(a, a + 7_000)) for a in range(0, 70_000, 7_000)] + [f"the end {k % 7} w{k}" for k in range(9)]
    texts += [" ".join(f"w{r.randrange(70_000)}" for _ in range(300)) for _ in range(20)] + ["twice " * 50, texts[0], "the end"]
    goal = [texts[3], "w1 w2 w1 w2 new"]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    docs = frame(texts)
    models = language_model.fit(docs, frame(goal))
    got = {x["doc_id"]: x for x in language_model.score(docs, models, keep={"doc_id": "doc_id"}).collect()}
    apart = {x["doc_id"]: x for x in language_model.score(frame(texts[5:]), models, keep={"doc_id": "doc_id"}).collect()}
    assert len(got) == len(texts)
    pool = Counter(w for t in texts + goal for w in t.split())
    total, a, k = sum(pool.values()) + len(pool) + 1, language_model.UNIGRAM_PRIOR, language_model.CONTEXT_PRIOR
    for name, own in {"background_loss": texts, "target_loss": goal}.items():
        word = Counter(w for t in own for w in t.split())
        pair = Counter(x for t in own for x in zip(["^", *t.split()], t.split(), strict=False))
        context = Counter(h for t in own for h in ["^", *t.split()][:-1])
        n = sum(word.values())
        for i, t in enumerate(texts):
            p = [(pair[h, w] + k * (word[w] + a * (pool[w] + 1) / total) / (n + a)) / (context[h] + k) for h, w in zip(["^", *t.split()], t.split(), strict=False)]
            assert got[i][name] == pytest.approx(-np.log(p).mean(), abs=1e-7)
            assert i < 5 or apart[i - 5][name] == got[i][name]


def test_target_of_cross_entropy_is_the_good_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = {r[0] for r in labels.where("quality = 1").select("doc_id").collect()}
    own = sorted(r["text"] for r in docs.collect() if r["doc_id"] in good)
    target = language_model.labelled(docs, labels.where("quality = 1").select("doc_id").distinct())
    assert sorted(r["text"] for r in target.collect()) == own
    got = {r["doc_id"]: r["target_loss"] for r in QUERIES["op2_cross_entropy_difference"](spark, sf).collect()}
    models = language_model.fit(docs, spark.createDataFrame([(t,) for t in own], "text string"))
    assert got == {r["doc_id"]: r["target_loss"] for r in language_model.score(docs, models, keep={"doc_id": "doc_id"}).collect()}


def plain_losses(texts, goal):
    """[(background, target)] of each text from dictionaries of all words and bigrams."""
    split, other = ([(t or "").encode().lower().split() for t in side] for side in (texts, goal))
    pool = Counter(w for t in split + other for w in t)
    total, a, k = sum(pool.values()) + len(pool) + 1, language_model.UNIGRAM_PRIOR, language_model.CONTEXT_PRIOR
    sides = []
    for own in (split, other):
        word, pair, context = Counter(w for t in own for w in t), Counter(), Counter()
        for t in own:
            pair.update(zip(["^", *t], t, strict=False))
            context.update(["^", *t][:-1] if t else [])
        n = sum(word.values())
        loss = lambda h, w: -np.log((pair[h, w] + k * (word[w] + a * (pool[w] + 1) / total) / (n + a)) / (context[h] + k))  # noqa: B023, E731
        sides.append([np.mean([loss(h, w) for h, w in zip(["^", *t], t, strict=False)]) if t else 0.0 for t in split])
    return list(zip(*sides, strict=True))


def test_cross_entropy_query_against_dictionaries(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    good = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id").collect()}
    plain = plain_losses([r["text"] for r in rows], [r["text"] for r in rows if r["doc_id"] in good])
    got = {r["doc_id"]: r for r in QUERIES["op2_cross_entropy_difference"](spark, sf).collect()}
    for r, (background, target) in zip(rows, plain, strict=True):
        own = got[r["doc_id"]]
        assert (own["background_loss"], own["target_loss"], own["score"]) == pytest.approx((background, target, target - background), abs=1e-7)


def test_blocks_and_counting_tasks_do_not_change_losses(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = language_model.fit(docs, docs.where("doc_id % 3 = 0"))
    run = lambda **o: {r["doc_id"]: tuple(r) for r in language_model.score(docs, models, keep={"doc_id": "doc_id"}, **o).collect()}
    whole = run()
    monkeypatch.setattr(language_model, "BLOCK", 20_000)
    assert run(places=9) == whole


def test_another_second_reading_fails_the_job(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    moved = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([f"{t} {random.random()}" for t in b.column(0).to_pylist()])], names=["text"]) for b in batches), "text string")
    with pytest.raises(Exception, match="other partitions"):
        language_model.score(moved, language_model.fit(moved, moved)).collect()


# 3


def test_a_dear_rule_of_few_rejections_comes_last(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    dear = quality_rules.Rule("dear", "aggregate(transform(words, w -> length(regexp_replace(reverse(w), '[aeiou]+|(b|c)+d', ''))), 0, (a, x) -> a + x) < 0")
    orders = [[r.name for r in quality_rules.cascade(docs, rules=(dear, *quality_rules.RULES))] for _ in range(2)]
    assert orders[0][-1] == orders[1][-1] == "dear"
    assert quality_rules.cascade(docs, rules=(dear, *quality_rules.RULES))[0].name in ("duplicate_lines", "symbols", "tables", "shouting")


def test_kept_rows_are_those_of_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r["doc_id"] for r in quality_rules.kept_rows(docs).collect()} == {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, sf).where("kept").collect()}


def test_cascade_order_does_not_change_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda rules: {r[0] for r in quality_rules.kept_rows(docs, rules=rules).select("doc_id").collect()}
    assert ids(quality_rules.RULES) == ids(quality_rules.RULES[::-1])
    assert {r.name for r in quality_rules.cascade(docs)} == {r.name for r in quality_rules.RULES}


# 4


def test_gradients_against_differences():
    r = np.random.default_rng(0)
    network = toxicity.Network({b"aa": 1, b"bb": 2})
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    words = [b"aa", b"bb", b"cc"]
    codes = r.integers(-1, 3, (5, toxicity.WINDOW))
    y = np.array([0, 1, 0, 1, 1], float)
    g, _ = network.gradients(words, codes, y)

    def loss():
        z = network.run(network.products(network.inputs(words)[0]), codes)
        return np.mean(np.logaddexp(0, z) - y * z)

    for name in ("A", "v", "o", "c", "Wf", "Ub", "bf", "gram", "word"):
        at, grad = g[name] if isinstance(g[name], tuple) else (np.arange(len(g[name])), g[name])
        w = network.w[name]
        row = int(at[len(at) // 2])
        index = (row,) if w.ndim == 1 else (row, 1)
        keep = w[index]
        w[index] = keep + 1e-4
        up = loss()
        w[index] = keep - 1e-4
        down = loss()
        w[index] = keep
        own = grad[list(at).index(row)]
        assert (own if w.ndim == 1 else own[1]) == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=1e-5)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 1000])
    text, first = toxicity.windows(counts)
    for k, n in enumerate(counts):
        own = first[text == k]
        assert own[0] == 0 and own[-1] + toxicity.WINDOW >= n and (np.diff(own) == toxicity.STRIDE).all()


def test_one_toxic_window_marks_a_long_text():
    r = random.Random(1)
    clean = lambda n: b" ".join(r.choice([b"sun", b"tree", b"river", b"stone", b"cloud", b"green"]) for _ in range(n))
    texts = [clean(80) + (b" grobwort " + clean(20) if k % 2 else b"") for k in range(120)]
    network = toxicity.Network({b"sun": 1})
    network.train([toxicity.words_of(t) for t in texts], np.array([k % 2 for k in range(120)]), steps=150)
    logit, n = toxicity.Scorer(network).windows_of([clean(3000), clean(1500) + b" grobwort " + clean(1500)], best=True)
    assert logit[0] < 0 < logit[1] and n[0] == -(-(3000 - 32) // 16) + 1


def held_out_auc(out, labels, column):
    rows = [(r["score"], r[column]) for r in out.where("held_out").join(labels, "doc_id").collect()]
    scores, truth = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    ranks = np.unique(scores, return_inverse=True)[1].astype(float)
    ranks = np.array([(np.searchsorted(np.sort(ranks), x, "left") + np.searchsorted(np.sort(ranks), x, "right") + 1) / 2 for x in ranks])
    good = truth == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()


def test_toxicity_query_on_held_out_documents(spark, sf):
    folder = sf.replace("0.001", "0.1")
    out = QUERIES["op4_toxicity"](spark, folder).persist()
    rows = out.collect()
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert held_out_auc(out, spark.read.parquet(f"{folder}/labels.parquet"), "toxic") > 0.93
    out.unpersist()


# 5


def test_hot_fingerprints_are_split_and_lose_nothing(spark, monkeypatch):
    rows = [(k if k % 2 else None, "a b c d e" if k % 3 == 0 else f"w{k} x{k * 7} y{k * 13} z{k * 29}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = sorted(map(str, simhash.near_duplicates(docs).collect()))
    asked = []
    monkeypatch.setattr(simhash, "hot_keys", lambda counts, key: asked.append(common.hot_keys(counts, key, least=100)) or asked[-1])
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == plain
    kept = [r["text"] for r in simhash.distinct_rows(docs).collect()]
    assert kept.count("a b c d e") == 1 and all(len(hot) == 1 for hot in asked)


def test_smallest_id_of_each_class(spark, sf):
    got = simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    value = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    distinct = sorted(set(value.values()))
    root = {v: v for v in distinct}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for k, v in value.items():
        least[top(v)] = min(k, least.get(top(v), k))
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: least[top(v)] for k, v in value.items()}


def plain_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert all(got[r["doc_id"]] == f"{plain_fingerprint(r['text']):016x}" for r in rows)


def test_links_and_classes_against_all_pairs(spark):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(12)]
    values = [0, 1, 3, 7, 15, 31, (1 << 64) - 1]
    for c in centres:
        for _ in range(25):
            for _ in range(r.randint(0, 4)):
                c ^= 1 << r.randrange(64)
            values.append(c)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    close = {(max(a, b), min(a, b)) for a in signed for b in signed if 0 < ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    assert {tuple(x) for x in simhash.links(nodes).collect()} == close
    root = {v: v for v in signed}
    for _ in signed:
        for u, v in close:
            root[u] = root[v] = min(root[u], root[v])
    found = simhash.classes(nodes.withColumn("doc_id", F.monotonically_increasing_id())).collect()
    ids = {x["fp"]: x["component_id"] for x in found}
    assert len({(root[v], ids[v]) for v in signed}) == len(set(root.values())) == len(set(ids.values()))


# 6


def test_automaton_against_regular_expressions():
    r = random.Random(3)
    globs = ["".join(r.choice(["a", "b", "/", ".", "?", "*", "**"]) for _ in range(r.randint(0, 8))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["".join(r.choice("ab/.") for _ in range(r.randint(0, 12))) for _ in range(300)] + [""]
    hits = url_filter.Automaton(globs).match([t.encode() for t in texts])
    for k, g in enumerate(globs):
        pattern = re.compile(url_filter.like_regex(g))
        assert [bool(pattern.fullmatch(t)) for t in texts] == hits[:, k].tolist(), g


# 7


def test_ids_against_the_tokenizer_on_whole_texts(spark, sf):
    path = packing.default_vocabulary()
    extra = ["<|ENDOFTEXT|> a<|endoftext|>. it's I'LL €. é. é. 12.5!! !!'s", "İ. ǅ! क़, x.y", "don't\tstop\x0b\x0cnow", "ﬁ ½ ²."]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + extra
    known = packing.WordIds(path)
    for text, encoded in zip(texts, packing.tokenizer(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(known.text_ids(text.encode()), "<u4").tolist() == encoded.ids


def test_packing_places_every_token_once(spark, sf):
    out = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), packing.default_vocabulary(), with_ids=True).toPandas()
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 4096
    for _, own in out.sort_values("piece").groupby("doc_id"):
        assert own["start"].tolist() == [4096 * k for k in range(len(own))] and (own["length"].iloc[:-1] == 4096).all()
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c and len(i) == n for i, c, n in zip(out["ids"], out["ids_crc32"], out["length"], strict=True))
    assert out["sequence_id"].nunique() <= 1.03 * out["length"].sum() / 4096 + 1


def test_placing_against_the_sum_of_squares():
    r = np.random.default_rng(4)
    sizes = r.integers(1, 21, 300)
    number, offset = packing.Packer(20).place(sizes)
    fill: dict[int, int] = {}
    for size, own, at in zip(sizes, number, offset, strict=True):
        gaps = Counter(20 - f for f in fill.values() if f < 20)
        after = {}
        for gap in {*[g for g in gaps if g >= size], 20}:
            new = gaps.copy()
            if gap < 20:
                new[gap] -= 1
            if gap > size:
                new[gap - size] += 1
            after[gap] = sum(n * n for n in new.values())
        chosen = 20 - fill.get(own, 0)
        assert at == fill.get(own, 0) and after[chosen] == min(after.values())
        fill[own] = fill.get(own, 0) + size


def test_equal_pieces_are_dealt_evenly(spark):
    for ids in ("id", "cast(null as bigint)"):
        pieces = spark.range(9_000).selectExpr(f"{ids} as doc_id", "cast(100 as bigint) as length")
        packed = packing.pack(pieces, chunk=3_000)
        sizes = [r["count"] for r in packed.groupBy((F.col("sequence_id") / 2**32).cast("int")).count().collect()]
        assert sum(sizes) == 9_000 and max(sizes) < 3_600
        assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


# 8


def test_rows_that_share_an_id_are_queries_and_candidates_of_their_own(spark):
    df = spark.createDataFrame([(20, [1.0]), (20, [2.0]), (7, [3.0])], "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0, k=2).collect())
    assert got == [(20, 1, 7, 64 * 192), (20, 1, 7, 128 * 192), (20, 2, 20, 64 * 128), (20, 2, 20, 64 * 128)]


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(1500, 8)) * r.choice([0.1, 1.0, 3.0], (1500, 1))
    v[300:800] = v[300]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    usual, (knn.CHUNK, knn.QUERY_CHUNK) = (knn.CHUNK, knn.QUERY_CHUNK), (200, 15)  # several chunks and groups
    try:
        got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in knn.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()}
    finally:
        knn.CHUNK, knn.QUERY_CHUNK = usual
    q = np.floor(64 * v.astype(np.float32).astype(np.float64)).astype(np.int64)
    for a in range(0, 1500, 20):
        s = q @ q[a]
        best = sorted((k for k in range(1500) if k != a), key=lambda k: (-s[k], k))[:7]
        assert [got[a, n + 1] for n in range(7)] == [(k, s[k]) for k in best]


# 9


def test_probabilities_sum_to_one():
    counts = language.gram_counts(Counter({"abca": 3, "cab": 2, "bb": 1})).assign(lang="x")
    models = language.Models(counts)
    letters = sorted(set("abc")) + [language.END]
    for before in ("", "a", "ab", "ca", "zz"):
        # the score of a word ends with its end mark; single steps are differences of prefixes
        symbols = [language.START * 3 + before + c for c in letters]
        total = 0.0
        for text in symbols:
            s = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
            h, end, p = language.gram_hashes(s), np.array([len(s) - 1]), np.full((1, 1), models.base)
            for n in range(1, 5):
                term = models.terms[n - 1][models.find(models.grams[n - 1], h[n][end])]
                p = term + models.weights[n - 1][models.find(models.contexts[n - 1], h[n - 1][end - 1])] * p
            total += float(p[0, 0])
        assert total == pytest.approx(1.0, abs=1e-9)


def test_language_of_held_out_documents(spark, sf):
    out = language.op9_language_id(spark, sf.replace("0.001", "0.01"))
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    right = out.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


# 10


def test_quality_of_held_out_documents(spark, sf):
    folder = sf.replace("0.001", "0.1")
    out = compression.op10_compression_quality(spark, folder).where("held_out")
    met = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert met.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.97


def test_the_size_difference_carries_the_score(spark, sf):
    folder = sf.replace("0.001", "0.1")
    out = compression.op10_compression_quality(spark, folder).withColumn("score", F.col("size_difference"))
    assert held_out_auc(out, spark.read.parquet(f"{folder}/labels.parquet"), "quality") > 0.98


def test_dictionaries_learn_from_whole_texts():
    filler = " ".join(f"plain{k % 50}" for k in range(3_000)).encode()
    texts = [filler + f" tail-{k % 7}-of-junk".encode() * 200 for k in range(40)]
    found = compression.train_dictionary(texts, train_bytes=400_000)
    assert b"of-junk" in found


def test_calibration_keeps_the_labels_shares(spark):
    r = random.Random(4)
    make = lambda y: " ".join(r.choice(["fine", "calm", "plain"] if (r.random() < 0.7) == bool(y) else ["junk", "spam", "noise"]) for _ in range(12))
    rows = [(k, make(k % 10 != 0), int(k % 10 != 0)) for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    share = {}
    for size in (200, 5_000):
        learned = compression.learn(docs, docs.select("doc_id", "y"), "y", sample_docs=size)
        share[size] = compression.score(docs, learned).agg(F.avg("score")).first()[0]
    assert share[5_000] == pytest.approx(0.9, abs=0.03) and share[200] == pytest.approx(0.9, abs=0.05)


def test_a_rare_language_changes_only_its_own_limit(spark):
    r = random.Random(6)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 7)))
    rows = [(k, " ".join(word("abcdefg" if k % 2 else "mnopqrs") for _ in range(20)), "aa" if k % 2 else "mm") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    rare = spark.createDataFrame([(k, " ".join(word("uvwxyz") for _ in range(20)), "zz") for k in range(900, 905)], docs.schema)
    alone, with_rare = (language.learn(d)[2] for d in (docs, docs.unionAll(rare)))
    assert set(with_rare) == {"aa", "mm", "zz"} and np.isfinite(with_rare["zz"])
    assert all(with_rare[k] == pytest.approx(alone[k], rel=0.02) for k in alone)
