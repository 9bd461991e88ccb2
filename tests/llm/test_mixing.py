"""Mixing against plain loops: shares, cheapest flow, and what each document gives."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.queries import op11_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, sources array<string>, SIZE int"


def plain_targets(sizes, weights, wanted, passes=3):
    """By bisection of the share of one weight."""
    low, high = 0.0, 1e15
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(passes * s, w * mid) for s, w in zip(sizes, weights)) < wanted else (low, mid)
    return [min(passes * s, w * high) for s, w in zip(sizes, weights)]


def plain_cheapest(patterns, quotas, passes):
    """Least cost of a largest flow: word by word, each along the cheapest path, found by relaxing all arcs."""
    arcs = []
    nodes = 2 + len(patterns) + len(quotas)
    add = lambda a, b, room, cost: arcs.extend([[a, b, room, cost], [b, a, 0, -cost]])
    for k, (members, size) in enumerate(patterns):
        for again in range(passes):
            add(0, 2 + k, size, again * again)
        for i in members:
            add(2 + k, 2 + len(patterns) + i, passes * size, 0)
    for i, quota in enumerate(quotas):
        add(2 + len(patterns) + i, 1, quota, 0)
    size = total = 0
    while True:
        far, back = [float("inf")] * nodes, [None] * nodes
        far[0] = 0
        for _ in range(nodes):
            for e, (a, b, room, cost) in enumerate(arcs):
                if room and far[a] + cost < far[b]:
                    far[b], back[b] = far[a] + cost, e
        if far[1] == float("inf"):
            return size, total
        at = 1
        while at:
            arcs[back[at]][2] -= 1
            arcs[back[at] ^ 1][2] += 1
            at = arcs[back[at]][0]
        size, total = size + 1, total + far[1]


@pytest.mark.parametrize("seed", range(12))
def test_targets_and_flow(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, 40, 300]) for _ in range(r.randint(1, 7))]
    weights = [r.randint(1, 3) for _ in sizes]
    got = mixing.share(sizes, weights, sum(sizes))
    assert sum(got) == sum(sizes) and all(t <= 3 * s for t, s in zip(got, sizes))
    assert [float(t) for t in got] == pytest.approx(plain_targets(sizes, weights, sum(sizes)))
    names = range(r.randint(1, 4))
    patterns = [(m, r.randint(0, 9)) for n in range(1, len(names) + 1) for m in itertools.combinations(names, n) if r.random() < 0.7]
    quotas = [r.randint(0, 40) for _ in names]
    sent = mixing.route(patterns, quotas)
    into = collections.Counter()
    cost = 0
    for (members, size), flows in zip(patterns, sent):
        assert sum(flows) <= 3 * size and min(flows, default=0) >= 0
        cost += sum(k * k * max(0, min(size, sum(flows) - k * size)) for k in range(3))
        for i, f in zip(members, flows):
            into[i] += f
    assert all(into[i] <= quotas[i] for i in names)
    assert (sum(into.values()), cost) == plain_cheapest(patterns, quotas, 3)


def key(doc_id, seed=mixing.SEED):
    return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:15], 16)


def rows_of(r, n):
    texts = [None, "", " \n", "one", "two words", *(" ".join(["w"] * r.choice([1, 3, 17, 400])) for _ in range(n)), "long " * 30_000]
    out = [(i, t, r.choice(["a", "b", "c", "é", None]), [s for s in "abc" if r.random() < 0.5] or r.choice([None, []]), 7) for i, t in enumerate(texts)]
    return out + [out[7]] * 40 + [(None, "no id at all", "a", ["a"], 1)] * 30 + [(None, "no id", "b", ["a", "b"], 1)]


def test_one_source_each(spark):
    """Null and repeated ids, null, empty and long texts, a null source, a column that clashes; every row as the plain order says."""
    rows = rows_of(random.Random(3), 80)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.digest(docs.repartition(7)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r[1]) for r in rows if r[2] == s) for s in names]
    targets = plain_targets(sizes, [1 + i % 3 for i in range(len(names))], sum(sizes))
    want = []
    for s, whole, target in zip(names, sizes, targets):
        left = int(target + 1e-6)
        own = sorted((key(r[0]), size(r[1]), r[0] if r[0] is not None else -1) for r in rows if r[2] == s)
        taken = [0] * len(own)
        for _ in range(3):
            for i, (_, n, _) in enumerate(own):
                taken[i] += min(n, left)
                left -= min(n, left)
        want += [(d, n, whole, t) for (_, n, d), t in zip(own, taken)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == sorted(want)
    by = collections.defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(targets[names.index(r["source"])])
    assert all(-1e-6 <= t - by[s] < 1 for s, t in zip(names, targets))
    again = mixing.digest(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_overlapping_sources_and_texts(spark):
    rows = rows_of(random.Random(5), 60)
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs, F.col("sources"), {"a": 5, "b": 1})
    got, plan = mixed.documents.collect(), {r["source"]: r for r in mixed.plan.sources.collect()}
    assert len(got) == len(rows) and plan["a"]["weight"] == 5 and plan["c"]["weight"] == 3
    into = collections.Counter()
    for r in got:
        assert sum(p["words"] for p in r["parts"]) == r["n_taken"] <= 3 * r["size"]
        assert all(p["source"] in r["sources"] for p in r["parts"])
        into.update({p["source"]: p["words"] for p in r["parts"]})
    assert all(into[s] == r["taken"] <= r["quota"] for s, r in plan.items())
    texts = mixing.materialize(docs, mixed).collect()
    assert sum(len(WORD.findall(r["text"])) for r in texts) == sum(into.values())
    held = {(r[0], r[1] or "") for r in rows}
    whole = [r for r in texts if (r["doc_id"], r["text"]) in held]
    assert len(texts) - len(whole) <= mixed.plan.stretches.count() and max(r["repetition"] for r in texts) <= 3


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.digest(empty).count() == 0
    assert mixing.materialize(empty, mixing.mix(empty, F.col("sources"))).count() == 0
    blank = mixing.digest(spark.createDataFrame([(1, None, "a", None, 0), (2, "", None, None, 0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2


def test_query(spark):
    got = op11_mixing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs)
