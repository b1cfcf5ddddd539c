"""The prefix trie of conversations against a trie that is built turn by turn."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import prefix_trie

CONV = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(convs):
    if not convs:
        return []
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for n in nodes:
        if n:
            children[n[:-1]] = children.get(n[:-1], 0) + 1
    for n, members in nodes.items():
        own = (len(members) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] = saved.get(n[:d], 0) + own
            leaves[n[:d]] = leaves.get(n[:d], 0) + (n not in children)
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children.get(n, 0), leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n)).encode()).hexdigest())
        for n, m in nodes.items())


def rows_of(rng, n):
    rows = []
    for c in [*range(-6, n), 10_000_000_000]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 8, 14])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice([None, "user", "assistant"]) if rng.random() < 0.1 else "user", rng.choice(["a", "a", "ä b", "", None, "ccc"])))
    return rows + rows[:3] + [(None, 1, "user", "x")] * 5


def got_of(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == columns
    return sorted(df.collect(), key=lambda r: tuple((x is not None, x) for x in r))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("partitions, seed", [(1, 1), (7, 2), (40, 3)])
def test_trie(spark, tmp_path, partitions, seed):
    """In one block, in some, and in more than there are classes in places."""
    rng = random.Random(seed)
    rows = rows_of(rng, 120)
    df = spark.createDataFrame(rows, CONV)
    for c in ("key", "block", "l", "d", "conv", "bytes"):  # names that the operator uses inside
        df = df.withColumn(c, F.lit(7))
    path = str(tmp_path / "conversations.parquet")
    df.write.parquet(path)
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = got_of(prefix_trie.op12_conversation_trie(spark, str(tmp_path)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in got] == order(trie(rebuilt(rows)))


def test_trie_of_few(spark):
    one = prefix_trie.conversation_trie(spark, spark.createDataFrame([(4, 1, "user", "x"), (4, 2, "user", "yy")], CONV))
    assert [r[:7] for r in got_of(one)] == [(4, 0, None, 1, 1, 1, 0), (4, 1, 4, 1, 1, 1, 0), (4, 2, 4, 1, 0, 1, 0)]
    assert prefix_trie.conversation_trie(spark, spark.createDataFrame([], CONV)).isEmpty()
    empty = spark.createDataFrame([(3, []), (5, [])], "conv_id long, turns array<struct<digest: string, bytes: long>>")
    assert [r[:7] for r in got_of(prefix_trie.prefix_trie(spark, empty))] == [(3, 0, None, 2, 0, 1, 0)]


def test_trie_of_long_and_common_conversations(spark):
    """One of 20,000 turns, 3000 that are alike, 3000 that share their first turn only."""
    long = spark.range(20_000).select(F.lit(0).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    alike = spark.range(3000).select((F.col("id") + 1).alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("0").alias("text"))
    star = alike.withColumn("conv_id", F.col("conv_id") + 3000)
    star = star.unionByName(star.withColumn("turn", F.lit(2).cast("long")).withColumn("text", F.concat(F.lit("t"), F.col("conv_id").cast("string"))))
    got = prefix_trie.conversation_trie(spark, long.unionByName(alike).unionByName(star))
    assert got.count() == 1 + 20_000 + 3000
    first = got.filter("depth = 1").collect()
    assert [tuple(r)[:7] for r in first] == [(0, 1, 0, 6001, 3001, 3001, 6000)]
    assert first[0].ends_sha256 == hashlib.sha256(",".join(map(str, range(1, 3001))).encode()).hexdigest()


def test_nearest_smaller():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(-1, 5) for _ in range(rng.randrange(0, 12))]
        before, after = prefix_trie.nearest_smaller(x)
        for i, v in enumerate(x):
            assert before[i] == max((j for j in range(i) if x[j] < v), default=-1)
            assert after[i] == min((j for j in range(i + 1, len(x)) if x[j] < v), default=len(x))
