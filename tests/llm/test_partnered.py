"""Which rows of a key are left before line dedup makes pairs, and how many pairs it makes of near-copies."""

import random

from pyspark.sql import functions as F

from tidemark.llm import line_dedup, setjoin


def test_near_copies_of_one_line_make_few_pairs(spark, monkeypatch):
    r, rows = random.Random(3), []
    stem = [f"s{k}" for k in range(40)]
    for i in range(80):  # near-copies of each other, and as many lines that are like nothing
        own = list(stem)
        own[r.randrange(40)] = f"x{i}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(f"y{i}_{k}" for k in range(39)) + " s1")]
    made, met = [], line_dedup.met
    def counted(*args):
        pairs = met(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_dedup, "met", counted)
    got = {x["doc_id"]: x["n_removed"] for x in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i % 2 == 0 and i > 0) for i, _ in rows}
    assert sum(made) < 5 * 80


def test_rows_without_a_partner_go_and_all_links_are_left(spark):
    r, sets = random.Random(4), {}
    common = [f"c{k}" for k in range(30)]
    for n in (3, 20, 33, 60, 100, 129, 250, 500):
        for k in range(6):
            own = [f"{n}_{k}_{j}" for j in range(n - n // 8)] + r.sample(common, min(30, n // 8))
            at = len(sets)
            sets[at], sets[at + 1] = own, own[max(1, n // 9) :] + ["new"]
    frame = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, s array<string>")
    hashed = frame.select("id", F.transform("s", lambda x: F.xxhash64(x)).alias("h"))
    levels = F.array_repeat(F.lit(0).cast("tinyint"), setjoin.BINS)
    described = setjoin.described(F.col("t"), 75, fine=True)
    nodes = setjoin.tokens(hashed, F.col("h"), levels, "t").select("id", *[v.alias(k) for k, v in described.items()]).localCheckpoint()
    kept = setjoin.partnered_rows(nodes, 75)
    keys = {}
    for x in kept.collect():
        keys.setdefault(x["id"], set()).add(x["key"])
    share = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    links = [(a, a + 1) for a in range(0, len(sets), 2) if share(a, a + 1) >= 0.75]
    assert len(links) > 30 and all(keys[a] & keys[b] for a, b in links)
    assert set(keys) <= {x for link in links for x in link} | {i for i, s in sets.items() if len(s) > 480}


def test_rows_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d\nx y {i % 3}") for i in range(30)], "doc_id long, text string")
    lines, _ = line_dedup.line_sets(docs)
    nodes, _ = line_dedup.line_nodes(lines)
    (rows,) = [setjoin.partnered(rows, 75, shared) for shared, rows, _ in setjoin.keys(nodes, 75)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1 and plan.count("+- Exchange hashpartitioning(key") == 1
