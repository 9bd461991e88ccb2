"""What reaches the candidates of near-dup's stars and of its completion."""

import random

from pyspark.sql import functions as F

from tidemark.llm import near_dup, setjoin


def test_groups_of_the_same_nodes_are_one(spark):
    rows = spark.createDataFrame([(k, n) for k in (1, 2, 3) for n in (10, 20)] + [(4, 10), (4, 30), (5, 7)], "key long, node long")
    got = sorted(map(tuple, near_dup.star_pairs(rows).select("key", "node", "center").collect()))
    assert got == [(1, 10, 10), (1, 20, 10), (4, 10, 10), (4, 30, 10)]


def test_pairs_of_long_prefixes_meet_at_few_keys_and_all_links_are_met(spark, monkeypatch):
    r, sets = random.Random(5), {}
    for k in range(30):  # of each three one pair above the threshold, and two of about 0.55
        own = r.sample(range(10**9), 300)
        sets[3 * k], sets[3 * k + 1] = own, own[r.choice([1, 20, 40]) :] + r.sample(range(10**9), 40)
        sets[3 * k + 2] = own[:213] + r.sample(range(10**9), 87)
    frame = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, s array<string>")
    hashed = frame.select("id", F.transform("s", lambda x: F.xxhash64(x)).alias("h"))
    levels = F.array_repeat(F.lit(0).cast("tinyint"), setjoin.BINS)  # no token is rarer than another, so unlike sets meet too
    nodes = setjoin.tokens(hashed, F.col("h"), levels, "t").select("id", *[v.alias(k) for k, v in setjoin.described(F.col("t"), 75).items()]).localCheckpoint()
    rows, meetings = [], setjoin.meetings
    monkeypatch.setattr(setjoin, "meetings", lambda *args: rows.append(meetings(*args).localCheckpoint()) or rows[-1])
    every, few = ({(r["a"], r["b"]) for r in setjoin.join(nodes, 75, once=o)[0].collect()} for o in (False, True))
    share = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    links = {(a, b) for a in sets for b in sets if a < b and share(a, b) >= 0.75}
    assert len(links) == 30 and links <= few <= every
    assert 5 * rows[1].count() < rows[0].count()


def test_links_at_hot_keys_are_met(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT", 2)
    r = random.Random(6)
    stem = r.sample(range(10**9), 60)
    sets = {i: stem[: r.randint(45, 60)] + r.sample(range(10**9), r.randint(0, 18)) for i in range(40)}
    frame = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, s array<string>")
    hashed = frame.select("id", F.transform("s", lambda x: F.xxhash64(x)).alias("h"))
    levels = F.array_repeat(F.lit(0).cast("tinyint"), setjoin.BINS)
    monkeypatch.setattr(setjoin, "level_of", lambda count: 0)
    nodes = setjoin.tokens(hashed, F.col("h"), levels, "t").select("id", *[v.alias(k) for k, v in setjoin.described(F.col("t"), 75).items()]).localCheckpoint()
    pairs, hot = setjoin.join(nodes, 75, once=True)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    if hot is not None:
        found |= {(r["a"], r["b"]) for r in setjoin.self_join(hot, 75, 3, None).collect()}
    share = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    links = {(a, b) for a in sets for b in sets if a < b and share(a, b) >= 0.75}
    assert len(links) > 50 and links <= found
