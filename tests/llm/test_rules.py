"""The cascade: counts in their own branches, a steady order, a sample over all files."""

import random

from pyspark.sql import functions as F

from siltstone.llm import quality_rules
from siltstone.llm.quality_rules import RULES, Rule

FINE = " ".join(f"plain{k} words" for k in range(40))


def test_a_rule_makes_its_count_only_of_texts_that_reach_it(spark, monkeypatch):
    """A count that fails when it is made: of short texts, and after a rule that rejects, it never is."""
    monkeypatch.setitem(quality_rules.COUNTS, "n_symbols", "length(raise_error('counted'))")
    monkeypatch.setattr(quality_rules, "cascade", lambda docs, text_col, rules, sample_rows: list(rules))
    docs = spark.createDataFrame([(1, "too short"), (2, None), (3, FINE + " refuse")], "doc_id bigint, text string")
    trap = (Rule("first", "words[size(words) - 1] = 'refuse'"), *[r for r in RULES if r.name == "symbols"])
    assert quality_rules.kept_rows(docs, rules=trap).count() == 0
    plan = quality_rules.kept_rows(docs, rules=RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raise_error") == 1  # in the CASE alone


def test_written_out_counts_give_the_counted_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted = quality_rules.measured(docs, keep=[F.col("doc_id")])
    differ = [F.count_if(F.expr(f"({r.rejects}) <> {quality_rules.alone(r)}")) for r in RULES]
    assert set(counted.agg(*differ).first()) == {0}


def test_the_order_stays_the_same_under_noise(spark, sf, monkeypatch):
    """Five calls whose clock is off by up to a sixth either way."""
    docs, r = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), random.Random(1)
    cost = {"symbols": 640, "duplicate_lines": 100, "long_words": 90, "short_words": 90, "shouting": 145, "tables": 130, "few_letters": 345}
    told = {quality_rules.alone(rule): 50 + cost[rule.name] for rule in RULES}
    monkeypatch.setattr(quality_rules, "seconds", lambda sample, condition, rounds: told.get(condition, 50) * r.uniform(0.85, 1.15))
    orders = {tuple(rule.name for rule in quality_rules.cascade(docs)) for _ in range(5)}
    assert orders == {("duplicate_lines", "shouting", "symbols", "tables", "long_words", "short_words", "few_letters")}


def test_near_ratios_go_by_name():
    rated = [(100.0, "d"), (60.0, "b"), (20.0, "c"), (1.0, "a"), (0.9, "e")]
    assert quality_rules.by_ratio(rated, 4.0) == ["b", "c", "d", "a", "e"]
    noisy = [(r * f, n) for (r, n), f in zip(rated, (0.8, 1.2, 1.1, 1.2, 0.8), strict=True)]
    assert quality_rules.by_ratio(noisy, 4.0) == ["b", "c", "d", "a", "e"]


def test_the_sample_is_drawn_over_all_rows(spark):
    docs = spark.range(0, 8_000, 1, 16).select(F.concat(F.lit("source "), F.expr("id div 1000"), F.lit(" text "), "id").alias("text")).unionAll(spark.range(4_000).select(F.lit("one text")))
    got = [r[0] for r in quality_rules.sampled(docs, "text", 200).collect()]
    assert len(got) == len(set(got)) == 200 and {t.split()[1] for t in got if t != "one text"} == set("01234567")
