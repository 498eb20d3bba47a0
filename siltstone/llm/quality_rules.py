"""Quality rules as a short-circuit cascade of column expressions.

The rules read one array of words a text. Each rule's selectivity is counted on a bounded sample of
texts and its cost, with the counts that it reads, timed in one task that evaluates it over the sample again
and again; the rules are tried in order of rejections per cost in one CASE, which stops at the first that
rejects. The order changes the time only: a text is kept if no rule rejects it. Rules whose ratios lie within
a factor of `CLOSE` of the next go by name, so that the order doesn't change with the clock's noise. Where only
the kept rows are asked for, every count is made inside its rule's own branch, so of no text that an earlier
rule rejects, and the dearest of all, the repeated windows, last. Where the counts are asked for
too, they are made once and the rules read them.

The sample is about `sample_rows` different texts of under SAMPLE_BYTES, picked by a hash over all files; it
decides the order, never a verdict.

Words are `[^\\x20\\x09-\\x0D]+`. Windows of three words are compared by their 64-bit hash with the
neighbouring position kept, sorted within the row, so no row leaves its partition and no text is cut.

Defined cases: null and empty texts have no words and fail the base rules; repeated rows each get
their verdict; very long texts are judged whole; there is nothing to tie; an empty table gives an empty
result; other columns are carried or dropped, never read.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import read

MIN_WORDS = 50
#: Rows of the sample that costs and selectivities are estimated on, bytes of its longest text, rounds of a timing, and the factor within which ratios are equal.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS, CLOSE = 400, 65_536, 6, 2.7


@dataclass(frozen=True)
class Rule:
    """name, and the SQL condition over (text, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines) that rejects."""

    name: str
    rejects: str


#: Thresholds per 100 words or lines.
RULES = (
    Rule("symbols", "100 * n_symbols > 40 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
    Rule("shouting", "200 * size(filter(words, w -> endswith(w, '!!'))) > 50 * n_words"),
    Rule("tables", "100 * size(filter(words, w -> w = '|')) > 25 * n_words"),
    Rule("few_letters", "4 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < length(text)"),
)

WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
HASHES = "if(n_words < 3, cast(array() as array<bigint>), transform(sequence(1, n_words - 2), i -> xxhash64(words[i - 1], words[i], words[i + 1])))"
#: Starts of the windows found twice or more, in order: sorted by hash, equal neighbours are repeats.
STARTS = """if(size(array_distinct(hashes)) = size(hashes), cast(array() as array<int>), array_sort(
  transform(filter(transform(sorted, (s, i) -> struct(s.p as p,
      coalesce(s.h = get(sorted, i - 1).h, false) or coalesce(s.h = get(sorted, i + 1).h, false) as again)),
    x -> x.again), x -> x.p)))"""
COVERED = "aggregate(starts, struct(0 as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)"


def barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that filters stay above. Pushed below it, a filter would repeat the whole expressions of the columns it reads, and theirs in turn."""
    return df.select("*", F.explode(F.array(value)).alias(name))


#: The base counts but that of repeated windows, over text, words and the lines with a word.
COUNTS = {
    "word_chars": "length(array_join(words, ''))",
    "n_symbols": "length(regexp_replace(text, '[^#*$%&|<>]', ''))",
    "n_lines": "size(lines)",
    "n_dup_lines": "(size(lines) - size(array_distinct(lines)))",
}
LINES = r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"


def alone(rule: Rule) -> str:
    """The rule's condition with the counts it reads written out; the lines are bound once."""
    condition = re.sub(rf"\b({'|'.join(COUNTS)})\b", lambda m: COUNTS[m[0]], rule.rejects)
    return f"exists(array({LINES}), lines -> {condition})" if re.search(r"\blines\b", condition) else f"({condition})"


def worded(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Columns `keep`, text, words and n_words."""
    out = docs.select(*(keep or []), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return out.withColumn("words", F.expr(WORDS)).withColumn("n_words", F.size("words").cast("int"))


def measured(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Columns `keep`, text, words and all base counts but that of the repeated windows."""
    out = worded(docs, text_col, keep).withColumn("lines", F.expr(LINES))
    return out.withColumns({c: F.expr(e).cast("int" if c == "n_lines" else "long") for c, e in COUNTS.items()}).drop("lines")


def with_repeats(out: DataFrame) -> DataFrame:
    """The base count of words in repeated windows, by measured()'s words."""
    out = out.withColumn("hashes", F.expr(HASHES))
    out = out.withColumn("sorted", F.expr("array_sort(transform(hashes, (h, i) -> struct(h, i as p)))"))
    out = out.withColumn("starts", F.expr(STARTS)).drop("hashes", "sorted")
    return out.withColumn("n_repeat_words", F.expr(COVERED).cast("long")).drop("starts")


SHORT, REPETITIVE = f"n_words < {MIN_WORDS}", "100 * n_repeat_words > 50 * n_words"


def seconds(sample: DataFrame, condition: str, rounds: int) -> float:
    """Time of a job of one task that evaluates a condition on every row `rounds` times."""
    again = sample.withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).where(f"if({condition}, __round, -__round) > 0")  # reads the round, so it isn't done once for all rounds
    began = time.perf_counter()
    again.count()
    return time.perf_counter() - began


def sampled(docs: DataFrame, text_col: str, sample_rows: int) -> DataFrame:
    """(text) of about `sample_rows` different texts in one partition, drawn by their hash over the whole table."""
    text = F.col(text_col).cast("string")
    share = int(min(1.0, 2 * sample_rows / max(1, docs.count())) * (1 << 40))
    drawn = docs.where((F.pmod(F.xxhash64(text, F.lit("sample")), F.lit(1 << 40)) < share) & (F.octet_length(text) < SAMPLE_BYTES)).select(text.alias("text")).distinct()
    return docs.sparkSession.createDataFrame([tuple(r) for r in drawn.orderBy(F.xxhash64("text")).limit(sample_rows).collect()], "text string").coalesce(1)


def by_ratio(rated: list[tuple[float, str]], close: float = CLOSE) -> list[str]:
    """Names by falling ratio; runs of ratios within a factor of `close` of the one before go by name."""
    groups: list[list[tuple[float, str]]] = []
    for ratio, name in sorted(rated, key=lambda x: (-x[0], x[1])):
        if groups and groups[-1][-1][0] < close * ratio:
            groups[-1].append((ratio, name))
        else:
            groups.append([(ratio, name)])
    return [name for group in groups for name in sorted(name for _, name in group)]


def cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> list[Rule]:
    """The rules by rejections per cost on a sample of at most `sample_rows` texts."""
    sample = worded(sampled(docs, text_col, sample_rows)).where(f"not ({SHORT})").persist()
    try:
        counted = sample.agg(F.count(F.lit(1)), *[F.count_if(F.expr(alone(r))) for r in rules]).first()
        conditions = ["n_words < 0", *map(alone, rules)]
        idle, *times = (min(own) for own in zip(*[[seconds(sample, c, rounds) for c in conditions] for _ in range(3)], strict=True))  # in turn, so that no rule alone meets a busy machine
        costs = [max(t - idle, idle / 16) for t in times]
    finally:
        sample.unpersist()
    rated = [((n + 0.5) / max(1, counted[0]) / cost, r.name) for r, n, cost in zip(rules, counted[1:], costs, strict=True)]
    named = {r.name: r for r in rules}
    return [named[name] for name in by_ratio(rated)]


def in_order(first: str, conditions: list[str]) -> Column:
    """True where neither `first` nor a condition holds; stops at the first that does."""
    case = " ".join(f"when {c} then false" for c in conditions)
    return F.expr(f"case when {first} then false {case} else true end")


def verdicts(docs: DataFrame, keep: list[Column], text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns `keep`, the base counts, base_failed and kept of every row."""
    ordered = cascade(docs, text_col, rules, sample_rows)
    out = with_repeats(measured(docs, text_col, keep)).withColumn("base_failed", F.expr(f"{SHORT} or {REPETITIVE}"))
    out = barrier(out, "kept", in_order("base_failed", [r.rejects for r in ordered]))
    return out.withColumn("n_words", F.col("n_words").cast("long")).drop("text", "words", "n_lines")


def kept_rows(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The input's rows that all rules keep, with the input's columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    ordered = cascade(docs, text_col, rules, sample_rows)
    left = barrier(worded(docs, text_col, [row]), "__kept", in_order(SHORT, [alone(r) for r in ordered])).where("__kept")
    left = barrier(with_repeats(left.select("__row", "words", "n_words")), "__kept", ~F.expr(REPETITIVE)).where("__kept")
    return left.select("__row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "documents"), [F.col("doc_id")])


ORACLE = r"""
with base as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents
), numbered as (
  select row_number() over () as r, * from base
), grams as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select r, words, unnest(range(1, len(words) - 1)) as i from numbered)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1
), covered as (
  select r, count(distinct i + k) as n_repeat_words from twice, (values (0), (1), (2)) as t(k) group by r
), counted as (
  select doc_id, text, words, cast(len(words) as bigint) as n_words,
         cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from numbered left join covered using (r)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
)
select doc_id, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words, base_failed,
       not (base_failed or 100 * n_symbols > 40 * n_words or 100 * n_dup_lines > 40 * n_lines
            or word_chars > 14 * n_words or 2 * word_chars < 3 * n_words
            or 200 * len(list_filter(words, lambda w: ends_with(w, '!!'))) > 50 * n_words
            or 100 * len(list_filter(words, lambda w: w = '|')) > 25 * n_words
            or 4 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < length(text)) as kept
from judged
"""
