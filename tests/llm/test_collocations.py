"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(rows, max_n=4, least=30, contained=80, top=2000):
    f = collections.Counter()
    n = collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for words in pieces(text):
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, max_n + 1):
                    if i + m <= len(words):
                        f[lang, tuple(words[i : i + m])] += 1
    found = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    gone = set()
    for (lang, words), c in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = lang, words[i : i + m]
                if 100 * c >= contained * found[part]:
                    gone.add(part)
    out = collections.defaultdict(list)
    for (lang, words), a in found.items():
        if (lang, words) not in gone:
            cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def corpus():
    r = random.Random(11)
    vocab = ["The", "of", "café", "zoo", "a\x01", "\x01\x02", "\x00\x01\x00", "a", "b", "x-1", "É", "naïve", "n" * 300]
    sentence = "the very common passage of words that all share"
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "? "]) for _ in range(r.randint(1, 60)))) for _ in range(400)]
    rows += [("en", sentence + ", " + r.choice(vocab))] * 90 + [("fr", "Un deux. " * 20_000), ("en", None), ("en", ""), (None, " \n.."), ("de", "...")]
    return rows


@pytest.mark.parametrize("share, chunk", [(256, 24 << 20), (5, 3000), (40, 200)])
def test_against_plain_counts(spark, monkeypatch, share, chunk):
    """Whatever counts as hot, and however a task's texts are divided: all rows of every language."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    rows = corpus()
    docs = spark.createDataFrame([(t, lang, 1, "x") for lang, t in rows], "text string, lang string, w1 int, Phrase string").repartition(5)
    got = collocations.collocations(docs, share=share)
    assert sorted(tuple(x) for x in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain(rows)


def test_top_and_ties(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(docs, max_n=3, least=5, contained=60, top=7)
    assert sorted(tuple(x) for x in got.collect()) == plain(rows, 3, 5, 60, 7)


def test_stack_over_batches():
    """Rows in one batch or one by one: the same counts."""
    r = random.Random(2)
    rows = sorted({("en", *(r.choice("abc") for _ in range(k)), *[""] * (3 - k)) for k in (1, 2, 3) for _ in range(30)}, reverse=True)
    n = [r.randint(1, 9) for _ in rows]
    want = collections.Counter()
    for (_, *words), c in zip(rows, n):
        for m in range(1, 4):
            if words[m - 1]:
                want[" ".join(words[:m])] += c
    for size in (1, 2, 5, len(rows)):
        stack, found = collocations.Stack(3, 1), []
        for i in range(0, len(rows), size):
            suffixes = pa.array([collocations.JOINT.join(row) for row in rows[i : i + size]])
            held, ended = stack.push(suffixes, np.array(n[i : i + size]), np.zeros(len(suffixes), dtype=int))
            found += [(p, c) for _, p, _, c in held] + list(zip(ended.column("phrase").to_pylist(), ended.column("f").to_pylist()))
        found += [(p, c) for _, p, _, c in stack.close()]
        assert len(found) == len(want) and dict(found) == want


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    rare = spark.createDataFrame([("en", "only a few words")], "lang string, text string")
    assert collocations.collocations(rare).count() == 0
    assert collocations.collocations(rare.withColumn("lang", F.lit(None).cast("string")), least=1).select("lang").distinct().collect()[0][0] == "und"
