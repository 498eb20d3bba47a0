"""Helpers that the corpus operators share: batches of bounded size, word numbering, checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time (one longer text is a batch of its own).
BATCH_BYTES = 2_000_000
#: Words that a Python worker remembers; beyond it the memory is cleared and filled anew.
WORDS_KEPT = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of spark.checkpoint.dir.

    Without that setting a temporary folder serves, but only in one process, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siltstone-checkpoint-"))
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpointed frame that nothing reads any more (a rerun of a finished stage included)."""
    sc = df.sparkSession.sparkContext
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cuts(batch: pa.RecordBatch, ends: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part adds about `size` to the running sums `ends`, or is one row."""
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def slices(batch: pa.RecordBatch, text: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `size` bytes of text, or one row."""
    return cuts(batch, np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)), size)


def text_blocks(batches: Iterator[pa.RecordBatch], text: str, size: int, part: str) -> Iterator[tuple[tuple[int, int], Iterator[pa.RecordBatch]]]:
    """((part, number), slices) of consecutive blocks of rows that hold `size` bytes of text or one row more.

    Where a block ends depends on the rows alone, not on the batches they come in. part: the column
    with the number of the partition.
    """
    held: list[pa.RecordBatch] = []
    filled, number, own = 0, 0, -1
    for batch in batches:
        if batch.num_rows:
            own = batch.column(part)[0].as_py()
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + size - filled, side="left")) + 1
            piece = batch.slice(start, min(stop, batch.num_rows) - start)
            held += slices(piece, text)
            filled += int(ends[min(stop, batch.num_rows) - 1] - before)
            if stop <= batch.num_rows:
                yield (own, number), held
                held, filled, number = [], 0, number + 1
            start = stop
    if held:
        yield (own, number), held


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is the empty text."""
    return pc.fill_null(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()), b"").to_pylist()


def valid_text(column: str) -> Column:
    """A text column in which bytes that are no UTF-8 are written as U+FFFD: what every operator here reads."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def map_texts(
    df: DataFrame,
    text: str,
    fields: str,
    start: Callable[[], Callable[[pa.Array], dict[str, object]]],
    keep: dict[str, str] | None = None,
) -> DataFrame:
    """Add columns that are computed from a text column alone, batch by batch.

    keep: {output name: input column} of the columns carried along (a `struct("*")` under one
    name carries whole rows, so their names can't clash with the new ones). fields: DDL of the new
    columns. start() runs once a task and gives a function from a text array to {field: values}.
    """
    keep = keep or {}
    carried = [F.col(column).alias(name) for name, column in keep.items()]
    source = df.select(*carried, valid_text(text).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, "__text"):
                added = work(part.column("__text"))
                arrays = [part.column(name) for name in keep] + [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in added.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added])

    return source.mapInArrow(run, ", ".join([*kinds, fields]))


class WordNumbers(dict):
    """Numbers words in order of their first sight; `fresh()` lists those not yet handed out."""

    def __init__(self, most: int = WORDS_KEPT):
        super().__init__()
        self.most, self.given = most, 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def room(self) -> bool:
        """Forget all words if there are more than `most`; True if that happened."""
        if len(self) <= self.most:
            return False
        self.clear()
        self.given = 0
        return True

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def fresh(self) -> list[bytes]:
        if self.given == len(self):
            return []
        new = list(self)[self.given :]
        self.given = len(self)
        return new


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`, run k holding counts[k] of them (empty runs: 0)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def hot_keys(counts: DataFrame, key: str, share: int = 1000, least: int = 10_000) -> list:
    """The values of `key` with at least `least` and over 1/`share` of all rows, so fewer than `share`; counts: (key, count)."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    if total < least:
        return []
    return [r[0] for r in counts.where((F.col("count") >= least) & (F.col("count") * share > total) & F.col(key).isNotNull()).select(key).collect()]


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: list, salts: int = 64) -> DataFrame:
    """rows joined with a table by `key`; rows of the `hot` values are dealt by number over `salts` tasks, and their lines of the table repeated there."""
    if not hot:
        return rows.join(table, key)
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    left = rows.withColumn("__number", number).withColumn("__salt", F.when(F.col(key).isin(hot), F.col("__number")).otherwise(0)).drop("__number")
    right = table.withColumn("__salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"]).drop("__salt")


#: Hot keys up to which their list is sent to all tasks (some 40 bytes each); beyond, it is joined by shuffle.
SENT_KEYS = 250_000


def sent(table: DataFrame) -> DataFrame | None:
    """A checkpointed table of keys, marked to be sent to all tasks if it has at most SENT_KEYS rows; None if it has none."""
    n = table.count()
    return None if not n else F.broadcast(table) if n <= SENT_KEYS else table


def in_blocks(rows: DataFrame, sizes: DataFrame | None, keys: list[str], row: str, block: int) -> DataFrame:
    """rows with own, lo and hi, so that two tables of a hot key meet in many tasks.

    sizes: (keys, rows) of the keys with more than `block` rows. A row of such a key belongs to one of its
    blocks (`own`, by the hash of column `row`) and goes once to each pair (lo, hi) of that block and another or
    itself; rows of two blocks meet in one pair, rows of one block are to be matched where lo = hi only.
    """
    if sizes is None:
        return rows.withColumns({"own": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    parts = F.coalesce(F.ceil(F.col("rows") / block).cast("int"), F.lit(1))
    dealt = rows.join(sizes, keys, "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(row), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("rows", "parts", "other")


def bucket(column: str, n: int) -> object:
    """crc32 of an id as text, modulo n: the split between learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """[(label, half 0 or 1, text)] of about `per_class` documents of each label, and rows by label.

    labels: (id, label) of the rows to learn from. Ids are drawn by their hash from the small label
    table, so documents meet a broadcast list of bounded size; only drawn texts are shuffled. An id
    with both labels has label 1; of an id's texts the smallest counts; rows without id have no label.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    rows = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    if not rows:
        return [], rows
    share = F.create_map(*[F.lit(x) for k, n in sorted(rows.items()) for x in (k, min(1.0, per_class / n))])
    draw = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1_000_000)) / F.lit(1_000_000)
    drawn = known.where(draw < share[F.col("__y")])
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), valid_text(text_col).alias("__text"))
    half = F.pmod(F.xxhash64(id_col, F.lit("half")), F.lit(2)).cast("int")
    met = texts.join(F.broadcast(drawn), id_col)  # 2 per_class ids in expectation
    met = met.groupBy(id_col, "__y").agg(F.min("__text").alias("__text")).select("__y", half.alias("half"), "__text")
    return sorted(map(tuple, met.collect())), rows


def row_weights(labels: np.ndarray, drawn: list[int], rows: dict[int, int]) -> np.ndarray:
    """What each row of a sample stands for: its class's rows over those drawn, 1 on average.

    So a calibration keeps the labels' own shares, whatever the rates at which classes were drawn.
    """
    share = {k: rows[k] / max(1, drawn.count(k)) for k in rows}
    each = np.array([share[int(k)] for k in labels])
    return each / each.mean()
