"""Line deduplication as the query and the pipeline run it: words as tokens, lines of any length."""

import random

from tidemark.llm import line_dedup


def texts(rows, spark):
    return {r["doc_id"]: r["text"] for r in line_dedup.stage(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_short_copies_go(spark):
    rows = [(1, "Read more\nx\n \nfirst line here"), (2, "read more\n\nX\nother"), (3, "Read  more")]
    assert texts(rows, spark) == {1: rows[0][1], 2: "\nother", 3: ""}
    kept = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["removed"] for r in kept.collect()} == {1: [], 2: [0, 2], 3: [0]}


def test_near_copies_by_words_go(spark):
    r = random.Random(5)
    rows = []
    for i in range(120):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(1, 14))]
        rows.append((2 * i, " ".join(words)))
        words[r.randrange(len(words))] = "changed"  # up to five shingles, one word
        rows.append((1001 + 2 * i, " ".join(words)))
    seen, want = [], {}
    for i, t in sorted(rows):
        s = set(t.split())
        want[i] = "" if any(100 * len(s & x) >= 75 * len(s | x) for x in seen) else t
        seen.append(s)
    assert texts(rows, spark) == want and 60 < sum(t == "" for t in want.values())
