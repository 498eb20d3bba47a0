"""Spelling variants: words one edit apart, met by bands of letter-parity masks.

A mask holds the parity of each letter's count in a word. Inserting or deleting a letter flips one bit,
replacing one flips two, so of three bands of a mask some stay equal. The length filter tells which kind
of edit is looked for, and with it which mask serves best:
- lengths apart by one: bits are letters, dealt to the bands by their number. The one flip leaves two
  bands equal; the longer word is met under its length, the shorter under its length plus one.
- equal lengths: bits are letters at their places, dealt to the bands by the place. Both flips are in one
  band; the two others stay equal.
So words are joined where length and two of three bands are equal, and a pair is kept if the third band
differs in at most two bits and the words are at an edit distance of one. A pair that differs in no bit
(two letters that share one) is taken at the first two bands only, so each pair comes once. Keys of more
than `BLOCK` words are cut into blocks, and each pair of blocks meets in a task of its own.

A word's form is its commonest near word if that is at least twice as common; since counts double with
every step, forms are followed to the root in a few rounds of pointer jumping.

Defined cases: null texts have no words, a null id is written as nothing before the colon; very long texts
are read whole; repeated rows count again; of near words equally common the first in code-point order is
taken; bytes that are no UTF-8 end a run; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, forget, in_blocks, read, sent, valid_text

SHORTEST, LEAST_COUNT = 5, 3
#: One of so many (document, run) pairs loses a letter.
SLIPS = 97
#: Words of one key that meet in a task; more are cut into blocks of about this many.
BLOCK = 4_000

# The letters' code points, numbered 0 .. 25 (a-z) and 26 .. 89 (U+00C0 .. U+00FF).
NUMBER = "if({c} < 192, {c} - 97, {c} - 166)"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, shortest: int = SHORTEST, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of `shortest` or more code points that occur at least `least` times."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(valid_text(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"),
    )
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    hashed = runs.select("id", low.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.expr("int(h % length(run))")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def parity(bits: str) -> str:
    """SQL of the exclusive or of an array of masks."""
    return f"aggregate({bits}, 0L, (a, x) -> a ^ x)"


def with_masks(words: DataFrame) -> DataFrame:
    """words with length, by_letter and by_place: arrays of the three bands of each mask."""
    code = NUMBER.format(c="ascii(substring(word, i, 1))")
    numbered = words.withColumn("length", F.length("word")).withColumn("codes", F.expr(f"transform(sequence(1, length), i -> {code})"))
    letter = [parity(f"transform(codes, c -> if(c % 3 = {k}, shiftleft(1L, int(c div 3)), 0L))") for k in range(3)]
    place = [parity(f"transform(codes, (c, i) -> if(i % 3 = {k}, shiftleft(1L, (c + 31 * i) % 63), 0L))") for k in range(3)]
    return numbered.withColumn("by_letter", F.expr(f"array({', '.join(letter)})")).withColumn("by_place", F.expr(f"array({', '.join(place)})")).drop("codes")


def keyed(words: DataFrame, longer: bool) -> DataFrame:
    """(key, kind, rest, word): a word under its length and two bands, of either mask; `rest` is the third band.

    Kinds 0 .. 2 are of equal lengths, 3 .. 5 of lengths apart by one, where `longer` tells the side.
    """
    rows = []
    for kind in range(6):
        bands = "by_place" if kind < 3 else "by_letter"
        rest = 2 - kind % 3
        one, two = (k for k in range(3) if k != rest)
        length = "length" if kind < 3 or longer else "length + 1"
        rows.append(f"struct(xxhash64({kind}, {length}, {bands}[{one}], {bands}[{two}]) as key, {kind} as kind, {bands}[{rest}] as rest)")
    return words.select("word", F.expr(f"inline(array({', '.join(rows)}))")).select("key", "kind", "rest", "word")


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) of all pairs of words at an edit distance of one, each pair once; words: a checkpointed (word, length, by_letter, by_place)."""
    shorter, longer = keyed(words, False), keyed(words, True)
    sizes = longer.groupBy("key").count().unionAll(shorter.where("kind >= 3").groupBy("key").count()).groupBy("key").agg(F.sum("count").alias("rows"))
    hot = sent(checkpointed(sizes.where(F.col("rows") > block)))
    a, b = (in_blocks(side, hot, ["key"], "word", block).alias(name) for side, name in ((shorter, "a"), (longer, "b")))
    c = F.col
    met = (
        (c("a.key") == c("b.key")) & (c("a.lo") == c("b.lo")) & (c("a.hi") == c("b.hi")) & (c("a.kind") == c("b.kind"))
        & (F.bit_count(c("a.rest").bitwiseXOR(c("b.rest"))) <= 2)
        & ((c("a.rest") != c("b.rest")) | (c("a.kind") == 0))
        & ((c("a.own") != c("b.own")) | (c("a.lo") == c("a.hi")))
        & ((c("a.kind") >= 3) | (c("a.word") < c("b.word")))
        & F.expr("levenshtein(a.word, b.word, 1) = 1")
    )
    return a.join(b, met).select(c("a.word").alias("a"), c("b.word").alias("b"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of a checkpointed table (word, form) without rings: where the forms end, by pointer jumping."""
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if known is not forms and "moved" in known.columns:
            forget(known)
        known = jumped
        if known.where("moved").isEmpty():
            return known.drop("moved")


def variants(counts: DataFrame, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    words = checkpointed(with_masks(counts))
    pairs = near_pairs(words.select("word", "length", "by_letter", "by_place"), block)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))))
    numbered = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    first: Column = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    best = numbered.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("first"))
    fits = F.expr(f"-first.n >= {ratio} * n")
    judged = words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("first.near")).alias("form"), F.when(fits, -F.col("first.n")).alias("form_n")
    )
    judged = checkpointed(judged)
    roots = followed(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(read(spark, sf_dir, "documents")))


ORACLE = r"""
with recursive bits as (
  select list(c order by i) as t
  from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), counted as (
  select coalesce(cast(doc_id as varchar), '') as id, run, count(*) as c from runs group by all
), coded as (
  select run, c, flatten(list_transform(string_split(id || ':' || run, ''), lambda s: case when unicode(s) < 128 then [cast(unicode(s) as bigint)] else [195, unicode(s) - 64] end)) as b
  from counted
), hashed as (
  select run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as h from coded, bits
), words as (
  select case when h % 97 = 0 then left(run, cast(h % length(run) as integer)) || substr(run, cast(h % length(run) as integer) + 2) else run end as word, sum(c) as n
  from hashed group by 1 having length(word) >= 5 and n >= 3
), less as (
  select word, i, left(word, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)
), near as (
  select a.word, b.word as near from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select less.word, w.word from less join words w on w.word = rest
  union select w.word, less.word from less join words w on w.word = rest
), ranked as (
  select near.word, near, w.n as near_n, count(*) over (partition by near.word) as n_near, row_number() over (partition by near.word order by w.n desc, near) as place
  from near join words w on w.word = near
), formed as (
  select words.word, cast(words.n as bigint) as n, coalesce(n_near, 0) as n_near,
         case when near_n >= 2 * words.n then near end as form, cast(case when near_n >= 2 * words.n then near_n end as bigint) as form_n
  from words left join ranked on ranked.word = words.word and place = 1
), walk as (
  select word, word as at, form as next from formed
  union all select walk.word, walk.next, formed.form from walk join formed on formed.word = walk.next
)
select formed.word, formed.form, walk.at as root, formed.n, n_near, form_n
from formed join walk on walk.word = formed.word and walk.next is null
"""
