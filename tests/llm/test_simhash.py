"""Links of fingerprints that share a half, whatever the limits at which keys are cut."""

import itertools
import random

import pytest

from siltstone.llm import simhash


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(n, seed):
    """Fingerprints of one low half, of one high half and of none, with pairs at 1 to 3 bits in and across the halves."""
    r = random.Random(seed)
    out = {(r.getrandbits(32) << 32) | 0x9ABCDEF0 for _ in range(n)} | {(0xFFFF0001 << 32) | r.getrandbits(32) for _ in range(n)} | {r.getrandbits(64) for _ in range(n)}
    for x in list(out):
        for _ in range(2):
            y = x
            for b in r.sample(range(64), r.randint(1, 3)):
                y ^= 1 << b
            out.add(y)
    return sorted(out)


@pytest.mark.parametrize(("most", "block"), [(4_000, 4_000), (20, 4_000), (20, 3), (1, 1)])
def test_no_link_is_lost_or_made_up(spark, most, block):
    found = fingerprints(60, 1)
    want = {(max(signed(a), signed(b)), min(signed(a), signed(b))) for a, b in itertools.combinations(found, 2) if (a ^ b).bit_count() <= 2}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in found], "fp bigint"), most, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_a_half_shared_by_very_many_is_met_in_parts(spark):
    n, r = 50_000, random.Random(2)
    found = {(r.getrandbits(32) << 32) | 7 for _ in range(n)}
    near = {x ^ (1 << r.randrange(32, 64)) for x in list(found)[:500]}
    nodes = spark.createDataFrame([(signed(x),) for x in sorted(found | near)], "fp bigint")
    keys = simhash.shared_keys(nodes, simhash.SHARED)
    assert keys.count() == 33
    got = {tuple(r) for r in simhash.links(nodes).collect()}
    every, want = found | near, set()
    for x in every:
        for a in range(32, 64):
            for b in range(a, 64):
                y = x ^ (1 << a) ^ ((1 << b) if b > a else 0)
                if y in every:
                    want.add((max(signed(x), signed(y)), min(signed(x), signed(y))))
    assert got == want and len(want) >= 500


def test_used_checkpoints_are_deleted(spark, tmp_path):
    from siltstone.llm import common

    df = common.checkpointed(spark.range(10))
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    assert df.count() == 10
    common.forget(df)
    common.forget(spark.range(3))  # nothing to delete
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
