"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import attention, decontamination, language_id, license_scan, line_dedup, lm_scoring, near_dup, packing, quality_rules, setjoin, sharding, shingles, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ba be bi bo da de di do fa fe ka ke la le ma me na ne pa pe ra re sa se ta te".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def text(r, n):
    return " ".join(word(r) + ("\n" if r.random() < 0.03 else "") for _ in range(n))


def odd_texts():
    r = random.Random(5)
    long = text(r, 60_000)
    return [None, "", " \n\t ", "one", "Two words", "a b c d", "x" * 5000, long, "tail  <|endoftext|> spaces \n  and\ttabs é ü ß", "¡Hola! ¿qué?  dos", " lead", "a  b  c", "9 + 9 = 18"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean texts, copies, near copies in chains, shared passages; ids with a gap and a null, one column that clashes."""
    r = random.Random(7)
    texts = odd_texts() + [text(r, r.randint(5, 120)) for _ in range(60)]
    base = text(r, 150).split(" ")
    for k in range(12):  # variants of variants: neighbours are alike, the ends aren't
        base = list(base)
        base[r.randrange(len(base))] = word(r)
        base[r.randrange(len(base))] = word(r)
        texts.append(" ".join(base))
    passage = text(r, 40)
    texts += [text(r, 30) + "\n" + passage + "\n" + text(r, 30) for _ in range(10)]
    texts += [texts[20]] * 4 + [texts[25].upper()]
    rows = [(i * 2, t, ["en", "fr", None][i % 3], "src0" if i % 3 else f"src{i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int").repartition(5)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_tokens int")


# ---- token counts and packing


def test_token_counts_equal_the_library(corpus):
    model = Tokenizer.from_file(JSON)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(corpus, JSON).collect()}
    for i, t in texts_of(corpus).items():
        want = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((t or "").encode()), want > 512)


def test_safe_splits_add_up():
    model, r = Tokenizer.from_file(JSON), random.Random(1)
    own = token_counts.PartCounter(JSON)
    pieces = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "12", "!", " ", "é", "<|endoftext|>", "\r\n", "　"]
    cases = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    assert own.counts(cases) == [len(x.ids) for x in model.encode_batch_fast(cases, add_special_tokens=False)]


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, docs = sentencepiece.SentencePieceProcessor(model_file=path), spark.createDataFrame([(1, "Hello  there"), (2, None)], "doc_id long, text string")
    assert rows_of(token_counts.count_tokens(docs, path), "doc_id", "n_tokens") == [(1, len(model.encode("Hello  there"))), (2, 0)]


def test_packing_round_trip(corpus):
    model = Tokenizer.from_file(JSON)
    packed = packing.pack_documents(corpus, JSON, RANKS)
    rows = packed.collect()
    ids = collections.defaultdict(dict)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        ids[r["doc_id"]][r["start"]] = r["ids"]
    for i, t in texts_of(corpus).items():
        whole = [x for s in sorted(ids[i]) for x in ids[i][s]]
        assert whole == [*model.encode(t or "", add_special_tokens=False).ids, 0]
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) * 1024 - total < 1024 + 0.05 * total
    laid = packing.sequences(packed).collect()
    assert {len(r["ids"]) for r in laid} == {1024} and sum(r["n_tokens"] for r in laid) == total


def test_packing_without_ranks_and_long_texts():
    a, b = packing.Encoder(JSON, RANKS), packing.Encoder(JSON)
    for t in odd_texts():
        assert a.ids(t or "").tolist() == b.ids(t or "").tolist() == Tokenizer.from_file(JSON).encode(t or "", add_special_tokens=False).ids
    with pytest.raises(ValueError):
        packing.Encoder(JSON, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_best_fit_decreasing_is_tightest():
    r = random.Random(3)
    for _ in range(60):
        window = r.choice([5, 31, 100, 1024])
        lengths = sorted((r.randint(1, window) for _ in range(r.randint(0, 150))), reverse=True)
        where, offsets = packing.best_fit_decreasing(np.array(lengths, dtype=np.int64), window)
        left = []
        for need, k, offset in zip(lengths, where.tolist(), offsets.tolist(), strict=True):
            fitting = [x for x in left if x >= need]
            assert window - offset == (min(fitting) if fitting else window)
            if k == len(left):
                left.append(window)
            left[k] -= need


# ---- sharding


def test_shards_are_even_gapless_and_reproducible(spark, corpus):
    got = sharding.digest(corpus, 24).collect()
    n = len(got)
    counts = collections.Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sorted(r["row_number"] for r in got) == sorted(r["position"] for r in got) == list(range(n))
    again = sharding.digest(corpus.repartition(11), 24)
    assert rows_of(again, "doc_id", "shard", "slot") == sorted((r["doc_id"], r["shard"], r["slot"]) for r in got)
    for i, t in texts_of(corpus).items():
        r = next(x for x in got if x["doc_id"] == i)
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "rows"
    assert sharding.shard_documents(corpus, 3).columns[: len(corpus.columns)] == corpus.columns


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_for_every_size(spark, n):
    rows = spark.range(n).select(F.col("id").alias("row_number"), F.lit(n).cast("long").alias("n_rows"))
    got = [r["position"] for r in sharding.permute(rows, 1).collect()]
    assert sorted(got) == list(range(n))


def test_repeated_rows_get_slots_of_their_own(spark):
    rows = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 30, "doc_id long, text string")
    got = sharding.digest(rows, 4).collect()
    assert sorted(r["row_number"] for r in got) == list(range(80))
    assert {collections.Counter(r["shard"] for r in got)[s] for s in range(4)} == {20}


# ---- near duplicates, shingles, line dedup


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def test_shingle_hashes_count_sets(corpus):
    texts = texts_of(corpus)
    for i, s in shingle_sets(texts).items():
        assert len(shingles.shingle_set(texts[i])) == len(s)
    part = shingles.PART_BYTES
    try:
        shingles.PART_BYTES = 64
        for t in texts.values():
            cut = shingles.word_hashes(t or "")
            shingles.PART_BYTES = part
            assert cut.tolist() == shingles.word_hashes(t or "").tolist()
            shingles.PART_BYTES = 64
    finally:
        shingles.PART_BYTES = part


def components_of(sets, percent=75):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(keys[a]), find(keys[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(corpus):
    sets = shingle_sets(texts_of(corpus))
    want = components_of(sets)
    got = {r["doc_id"]: r for r in near_dup.find_components(corpus).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len({r["component_id"] for r in got.values()}) < len(got)
    left = near_dup.stage(corpus)
    assert left.columns == corpus.columns and {r["doc_id"] for r in left.collect()} == {i for i in sets if want[i] == i}


def test_missed_links_are_found_by_the_prefix_join(spark, corpus):
    """With all documents in one open group, all links come from the completion."""
    own = near_dup.sketches(corpus)
    nodes = own.filter("n_shingles > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")).cache()
    links = near_dup.missed_links(corpus, nodes.select("node", F.col("node").alias("label")), nodes, 75)
    labels = {r["node"]: r["label"] for r in near_dup.components(links).collect()}
    node_of = {r["doc_id"]: r["node"] for r in own.collect()}
    sets = shingle_sets(texts_of(corpus))
    want = components_of(sets)
    for a in sets:
        for b in sets:
            if sets[a] and sets[b]:
                same = labels.get(node_of[a], node_of[a]) == labels.get(node_of[b], node_of[b])
                assert same == (want[a] == want[b])


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (None, a + " more"), (3, a), (3, a), (None, b), (None, b), (5, c), (5, b + " x"), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.find_components(docs).collect())
    assert got == {(7, 3, False): 1, (None, 3, False): 1, (3, 3, True): 2, (None, 5, False): 2, (5, 5, True): 2, (None, None, True): 1, (9, 9, True): 2}
    left = collections.Counter((r["doc_id"], r["text"]) for r in near_dup.stage(docs).collect())
    assert left == {(3, a): 1, (5, c): 1, (5, b + " x"): 1, (None, None): 1, (9, ""): 2}


def test_sketch_estimates():
    r = np.random.default_rng(1)
    assert near_dup.expected_miss() < 1e-5
    for share in (0.2, 0.75, 0.95):
        both = r.integers(0, 2**63, 2000, dtype=np.uint64)
        n = int(2000 * share)
        rest = (2000 - n) // 2
        a, b = np.concatenate([both[:n], both[n : n + rest]]), np.concatenate([both[:n], both[n + rest : n + 2 * rest]])
        got, filled = near_dup.estimate(near_dup.sketch(a)[None], near_dup.sketch(b)[None])
        assert abs(got[0] - share) < 0.12 and filled[0] == near_dup.REGISTERS


def removed_by_hand(texts, percent=75):
    seen, out = [], {}
    for i in sorted(texts):
        out[i] = []
        for k, line in enumerate((texts[i] or "").split("\n")):
            w = WORD.findall(line.lower())
            s = set(w)
            if s:
                if any(100 * len(s & x) >= percent * len(s | x) for x in seen):
                    out[i].append(k)
                seen.append(s)
    return out


def test_line_dedup_equals_brute_force(spark, corpus):
    r = random.Random(11)
    line = text(r, 30).replace("\n", "").split(" ")
    variants = []
    for _ in range(25):  # one line in many variants: more than a node meets at once
        own = list(line)
        own[r.randrange(len(own))] = word(r)
        variants.append(" ".join(own))
    more = spark.createDataFrame([(1001 + 2 * i, f"{text(r, 8)}\n{v}\n\nshort line", "en", "s", 0) for i, v in enumerate(variants)], corpus.schema)
    docs = corpus.unionByName(more)
    texts = texts_of(docs)
    want = removed_by_hand(texts)
    got = {r["doc_id"]: r for r in line_dedup.deduplicate(docs).collect()}
    for i, t in texts.items():
        assert got[i]["removed"] == want[i]
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert got[i]["text"] == left
    assert sum(map(len, want.values())) > 25 and line_dedup.stage(docs).columns == docs.columns


def test_line_dedup_completion_finds_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT", 1)  # keys of one, two and three tokens, and all that stars leave
    r = random.Random(2)
    stem = text(r, 12).replace("\n", "")
    docs = []
    for i in range(40):  # lines that share a stem but are unlike, and late copies of them with one more word
        docs.append((i, f"{stem} {text(r, 14)}".replace("\n", "")))
    docs += [(100 + i, f"{docs[3 * i][1]} more") for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.deduplicate(frame).collect()}
    assert got == removed_by_hand(dict(docs)) and sum(map(len, got.values())) == 12


# ---- quality, language


def stats_by_hand(t):
    w, t = WORD.findall(t or ""), t or ""
    c, s = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            s |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(s))


def test_quality_statistics(spark, corpus):
    docs = corpus.unionByName(spark.createDataFrame([(9001, "a b c a b c a", "en", "s", 1), (9003, "x x x x", "en", "s", 1), (9005, "a b c\na b c\n \n##", "en", "s", 1)], corpus.schema))
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.statistics(docs).collect()}
    assert got == {i: stats_by_hand(t) for i, t in texts_of(docs).items()}


def test_decision_list_learns_a_threshold(spark):
    r = random.Random(4)
    rows = [(i, " ".join(word(r) + ("###" if i % 4 == 0 else "") for _ in range(60 + i % 40))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(240) if i % 5], "doc_id long, quality int")
    found, rules = quality_rules.judge(docs, labels)
    assert {r["doc_id"]: r["kept"] for r in found.collect()} == {i: i % 4 != 0 for i, _ in rows}
    assert len(rules) == 1 and "symbols_per_word" in str(rules[0])
    assert {r["doc_id"] for r in quality_rules.filter_documents(docs, rules).collect()} == {i for i, _ in rows if i % 4}
    nothing, none = quality_rules.judge(docs, labels.filter("quality = 1"))
    assert none == [] and nothing.filter("kept").count() == 240


def test_language_id(spark):
    r = random.Random(8)
    kinds = {"aa": "ba be bi bo bu".split(), "zz": "xo xu zo zu ço".split()}
    rows = [(i, lang, " ".join("".join(r.choice(s) for _ in range(3)) for _ in range(r.randint(3, 80)))) for i, (lang, s) in enumerate(list(kinds.items()) * 150)]
    rows += [(900, "aa", None), (901, None, "123 456 !"), (902, "zz", ""), (903, None, "ba be bi BO BU ba")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(g["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= g["score"] <= 1 for i, g in got.items())
    assert all(got[i]["lang_pred"] == lang for i, lang, t in rows[:300])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert {r["doc_id"] for r in language_id.keep_identified(docs).collect()} == {i for i, _, _ in rows} - {900, 901, 902}
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.collect()} == {("und", 0.0)}


# ---- scoring


def test_scores_sum_to_one_and_base_equals_counts(spark):
    r = random.Random(6)
    vocabularies = [[word(r) for _ in range(80)], [word(r).upper() + "é" for _ in range(80)]]  # a text's words are of one kind
    rows = [(i, " ".join(r.choice(vocabularies[i % 2]) for _ in range(r.randint(0, 90))).title() if i % 9 else None) for i in range(300)] + [(5000, " ".join(word(r) + "q" for _ in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, JSON, RANKS).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(g["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert g["score"] < 0 and math.isfinite(g["score"])
    test = [i for i in tokens if held[i]]
    assert sum(got[i]["score"] for i in test) > sum(got[i]["base_score"] for i in test)


def test_types_sum_to_one():
    r = np.random.default_rng(3)
    size = 60
    head_n, head_v = np.zeros(size), np.zeros(size)
    words = [(int(r.integers(0, 30)), int(r.integers(1, 9))) for _ in range(200)]  # head and count of each known word
    for h, c in words:
        head_n[h] += c
        head_v[h] += 1
    corpus = lm_scoring.Corpus(int(head_n.sum()) + 7, len(words) + 1, 7, head_n, head_v)
    by_id = head_n.copy()
    by_id[-1] = 7
    vocabulary = attention.Vocabulary.from_counts(by_id)
    p = r.random(attention.UNITS)
    p[np.bincount(vocabulary.unit, minlength=attention.UNITS) == 0] = 0
    p /= p.sum()
    a = p[vocabulary.unit] * 10**vocabulary.share
    mix, d = lm_scoring.MIX, lm_scoring.DISCOUNT
    known = sum(mix * (c - d) / corpus.total + (1 - mix) * a[h] * (c - d) / head_n[h] for h, c in words)
    end = mix * (7 - d) / corpus.total + (1 - mix) * a[-1]
    unknown = mix * d * corpus.distinct / corpus.total + (1 - mix) * (p @ corpus.unknown_by_unit(vocabulary))
    assert math.isclose(known + end + unknown, 1, rel_tol=1e-9)


def test_attention_gradients_and_windows():
    r = np.random.default_rng(2)
    stream, owner = r.integers(0, attention.UNITS, 150), np.repeat([0, 1, 2], [70, 1, 79])
    net = attention.Net.new(np.bincount(stream, minlength=attention.UNITS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs, seen, targets, n = attention.windows(stream, owner, 5)
    weight = (np.arange(targets.size) < n).reshape(targets.shape)
    _, g = net.gradients(inputs, seen, targets, weight)
    for k in net.p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        kept = net.p[k][at]
        losses = []
        for step in (1e-4, -1e-4):
            net.p[k][at] = kept + step
            losses.append(net.gradients(inputs, seen, targets, weight)[0])
        net.p[k][at] = kept
        assert math.isclose(g[k][at], (losses[0] - losses[1]) / 2e-4, rel_tol=1e-3)
    # a place sees its own text's past only: what follows it changes nothing
    own, _ = attention.score(net, stream, owner, 5, np.ones(attention.UNITS))
    changed = stream.copy()
    changed[100:] = 3
    again, mean = attention.score(net, changed, owner, 5, np.ones(attention.UNITS))
    assert np.allclose(own[:100], again[:100]) and np.allclose(mean, 0, atol=1e-6)
    tail, _ = attention.score(net, stream[71:], owner[71:], 5, np.ones(attention.UNITS))
    assert np.allclose(own[71 : 71 + attention.CONTEXT], tail[: attention.CONTEXT], atol=1e-5)


# ---- licenses and benchmark


def test_license_scan(spark):
    assert (1 - license_scan.least_similarity()) ** license_scan.BANDS < 1e-5
    r = random.Random(9)
    mit = license_scan.TEMPLATES["MIT"][2]
    cut = mit.split(" ")
    cut = " ".join(cut[: len(cut) * 85 // 100])
    rows = [(1, f"{text(r, 300)} {mit} {text(r, 50)}"), (2, f"{text(r, 7)} {cut}"), (3, text(r, 500)), (4, None), (5, ""), (6, "released under the mit license"), (7, " ".join(mit.split(" ")[:30])), (8, f"{text(r, 40)}\nLicensed under CC BY-NC 4.0.")]
    got = {(x["doc_id"], x["license"], x["template"]): x for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT", 2), (2, "MIT", 2), (6, "MIT", 0), (8, "CC-BY-NC-4.0", 0)}
    assert got[1, "MIT", 2]["containment"] == 1.0 and 0.75 <= got[2, "MIT", 2]["containment"] < 0.9
    words = [w for w in re.split(r"[^A-Za-z0-9]+", rows[0][1]) if w]
    assert words[got[1, "MIT", 2]["first_word"] : got[1, "MIT", 2]["end_word"]] == [w for w in re.split(r"[^A-Za-z0-9]+", mit) if w]


def test_license_recall_against_exact_containment(spark):
    """Every window of every text against every template, by sets: bands alone find all of them."""
    r = random.Random(12)
    templates = {f"L{k}": [text(r, r.choice([5, 6, 9, 17, 40, 130, 400])).replace("\n", " ")] for k in range(25)}
    rows = [(-1, None), (-2, ""), (-3, "one two"), (-4, templates["L3"][0]), (-4, templates["L3"][0])]
    for i in range(120):
        words = text(r, r.randint(0, 500)).split()
        for own in r.sample(sorted(templates), r.randint(0, 3)):
            held = templates[own][0].split()
            held = held[: max(5, round(len(held) * r.choice([1, 0.9, 0.8, 0.7, 0.4])))]
            at = r.randint(0, len(words))
            words[at:at] = held
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame([(k, v[0]) for k, v in templates.items()] + [("L0", templates["L0"][0]), (None, "a b c d e f")], "license string, text string")
    got = collections.Counter((x["doc_id"], x["license"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=table).collect())
    five = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    want = collections.Counter()
    for i, t in rows:
        s = five([w.lower() for w in re.split(r"[^A-Za-z0-9]+", t or "") if w])
        for name, (x,) in templates.items():
            own = set(five([w.lower() for w in re.split(r"[^A-Za-z0-9]+", x) if w]))
            c = 1 << (len(own) - 1).bit_length()
            if any(100 * len(own & set(s[k : k + 2 * c])) >= 75 * len(own) for k in range(0, len(s), c)):
                want[i, name] += 1
    assert got == want and len(want) > 60


def test_decontamination(spark):
    item = "A train travels 120 km in 2 hours while Anna waits 120 minutes. How fast does the train go for Anna?"
    bench = spark.createDataFrame([(1, item), (2, "plain words without any placeholder in this question at all"), (3, None), (4, "hi there"), (1, item)], "item_id long, text string")
    rows = [
        (1, "Intro. A train travels 90 km in 3 hours while Maria waits 90 minutes. How fast does the train go for Maria? End."),
        (2, "A train travels 90 km in 3 hours while Maria waits 80 minutes. How fast does the train go for Bob? x"),
        (3, "Nothing here"), (4, None), (5, "well plain words without any placeholder in this question at all ok"), (6, item), (7, "Hi there!"), (8, ""),
        (9, "plain words without any placeholder"), (None, item), (6, item), (10, "He said hi there and left."),
        (11, "A train travels 90 km in 3 hours while Maria waits 80 minutes. How fast does the train go for Bob? Then: a train travels 90 km in 3 hours while Maria waits 90 minutes. How fast does the train go for Maria?"),
        (12, "A train travels one hundred and five km in twenty-two hours while Eve waits one hundred and five minutes. How fast does the train go for Eve?"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(1, 1): 5, (5, 2): 0, (6, 1): 0, (7, 4): 0, (10, 4): 0, (11, 1): 5, (12, 1): 5}
    left = decontamination.stage(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {2, 3, 4, 8, 9, None}


def test_stages_keep_columns_of_any_name(spark, corpus):
    docs = corpus.select("doc_id", "text", "lang", F.lit("a").alias("removed"), F.lit("b").alias("score"), F.lit("c").alias("n_words"), F.lit("d").alias("label"), F.lit("e").alias("item_id"), F.lit("f").alias("kept"))
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for out in (language_id.keep_identified(docs), line_dedup.stage(docs), near_dup.stage(docs), decontamination.stage(docs, bench), quality_rules.filter_documents(docs, [])):
        assert out.columns == docs.columns
        assert {tuple(r)[3:] for r in out.collect()} <= {("a", "b", "c", "d", "e", "f")}


# ---- empty tables, all operators


def test_empty_tables(spark):
    docs = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        token_counts.count_tokens(docs, JSON), packing.digest(docs, JSON, RANKS), sharding.digest(docs), near_dup.find_components(docs), line_dedup.deduplicate(docs),
        quality_rules.judge(docs, labels)[0], language_id.identify(docs), license_scan.scan(docs), decontamination.find_leaks(docs, bench), lm_scoring.score_documents(docs, JSON, RANKS),
    ):
        assert df.collect() == []


def test_native_plans_have_no_python(spark, corpus):
    plans = [sharding.digest(corpus), line_dedup.deduplicate(corpus), quality_rules.statistics(corpus), decontamination.find_leaks(corpus, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))]
    for df in plans:
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_prefix_lengths(spark):
    got = spark.range(1, 60).select("id", setjoin.prefix_length(F.col("id"), 75).alias("p")).collect()
    assert all(r["p"] == r["id"] - math.ceil(r["id"] * 0.75) + 1 for r in got)


# ---- whole subword stream, all training texts


def test_attention_scores_every_subword(spark):
    model = Tokenizer.from_file(JSON)
    pieces = collections.defaultdict(list)
    r = random.Random(8)
    for w in sorted({word(r) for _ in range(3000)}):
        ids = model.encode(" " + w, add_special_tokens=False).ids
        pieces[ids[0], len(ids)].append(w)
    same = max((v for k, v in pieces.items() if k[1] > 2), key=len)  # words alike in their first subword and length
    a, b = same[: len(same) // 2], same[len(same) // 2 :]
    docs = [(i, " ".join(r.choice(a) for _ in range(60))) for i in range(120)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    docs += [(held[0], " ".join(a)), (held[1], " ".join(b[: len(a)]))]
    got = {x["doc_id"]: x for x in lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), JSON, RANKS).collect()}
    assert got[held[0]]["attention_score"] > got[held[1]]["attention_score"] + 1
    found = lm_scoring.words_of(["Bakelomi é  x", "", "x"])
    own = lm_scoring.stream_of(found, 7, JSON, RANKS)
    want = [[*model.encode(" " + w, add_special_tokens=False).ids] for w in ("bakelomi", "é", "x")]
    assert own.ids.tolist() == [*want[0], *want[1], *want[2], 7, 7, *want[2], 7] and own.first.tolist() == np.cumsum([0, len(want[0]), len(want[1]), len(want[2]), 1, 1, len(want[2])]).tolist()


def test_attention_learns_order_from_one_long_text(spark):
    r = random.Random(12)
    cycle = list(dict.fromkeys(word(r) for _ in range(12)))
    long = " ".join(cycle * 1500)  # the only text with an order
    loose = [" ".join(r.choice(cycle) for _ in range(60)) for _ in range(60)]
    mixed = cycle * 5
    r.shuffle(mixed)
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    own = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [*enumerate(loose), (own, long), (held[0], " ".join(cycle * 5)), (held[1], " ".join(mixed))]
    got = {x["doc_id"]: x["attention_score"] for x in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), JSON, RANKS).collect()}
    assert got[held[0]] > 0.75 * got[held[1]]


def test_learner_goes_on_in_slabs(monkeypatch):
    r = np.random.default_rng(4)
    stream, owner = np.tile(r.integers(0, attention.UNITS, 40), 60), np.repeat([0, 1], 1200)
    start = attention.Net.new(np.bincount(stream, minlength=attention.UNITS))
    monkeypatch.setattr(attention, "SLAB", 8)
    learner = attention.Learner(start, batch=4)
    learner.learn(stream, owner, 5)
    assert learner.n == len(stream)
    before, after = (attention.score(x, stream, owner, 5, np.ones(attention.UNITS))[0].sum() for x in (start, learner.net))
    assert after > 0.9 * before
    again = start.filled(learner.net.flat())
    assert all((again.p[k] == v).all() for k, v in learner.net.p.items())


def test_op6_query_equals_brute_force_statistics_and_rules(spark):
    """The registered query on its whole table: statistics by hand, and the verdict of the rules that its own labels teach."""
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = texts_of(docs)
    got = {r["doc_id"]: r for r in queries.op6_quality_rules(spark, sf).collect()}
    _, rules = quality_rules.judge(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(got) == set(texts) and rules.stopped in ("no gain", "imprecise", "limit")

    def features(t):
        w, t = WORD.findall(t or ""), t or ""
        lines, n = [x for x in t.split("\n") if WORD.search(x)], stats_by_hand(t)
        upper = sum(unicodedata.category(ch) == "Lu" for ch in t)
        share = lambda a, b: a / b if b else 0.0
        return {"n_words": n[0], "symbols_per_word": share(n[2], n[0]), "dup_line_share": share(n[3], len(lines)), "repeat_share": share(n[4], n[0]), "word_length": share(n[1], n[0]), "upper_share": share(upper, n[1]), "distinct_share": share(len(set(w)), n[0]), "words_per_line": share(n[0], len(lines))}

    for i, t in texts.items():
        n = stats_by_hand(t)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        f = features(t)
        fires = any(all((f[c.feature] > c.threshold) == c.above for c in rule.conditions) for rule in rules)
        assert tuple(got[i][c] for c in quality_rules.BASE) == n and (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed and not fires)


def test_op7_and_op9_queries_equal_plain_search(spark):
    """The registered queries on their whole tables: license lines found by word windows, benchmark items by whole words."""
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = texts_of(spark.read.parquet(f"{sf}/documents.parquet"))
    squeeze = lambda t: " ".join(w for w in re.split(r"[^a-z0-9\u0080-￿]+", (t or "").lower()) if w)
    docs = {i: f" {squeeze(t)} " for i, t in texts.items()}
    got = {(r["doc_id"], r["license"], r["template"]): r["containment"] for r in queries.op7_license_scan(spark, sf).collect()}
    whole = {(i, name, k) for i, d in docs.items() for name, own in license_scan.TEMPLATES.items() for k, t in enumerate(own) if f" {squeeze(t)} " in d}
    assert {k for k, v in got.items() if v == 1} == whole
    items = {r["item_id"]: f" {squeeze(r['text'])} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    leaks = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, sf).collect()}
    assert {(i, k) for i, d in docs.items() for k, t in items.items() if t in d} <= leaks
    five = lambda d: {tuple(w) for w in zip(*[d.split()[k:] for k in range(5)], strict=False)}
    for i, k in leaks:  # what is found shares most of the item's words in order
        assert 2 * len(five(docs[i]) & five(items[k])) >= len(five(items[k]))


def test_op8_query_learns_from_its_own_part_only(spark):
    """Held-out accuracy on the whole small table, and predictions that ignore the labels of held-out documents."""
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, sf).collect()}
    assert set(got) == set(langs) and all(g["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= g["score"] <= 1 for i, g in got.items())
    test = [i for i, (lang, t) in langs.items() if got[i]["held_out"] and lang and got[i]["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == langs[i][0] for i in test) >= 0.9 * len(test) > 0
    hidden = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    again = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(hidden.select("doc_id", "text", "lang")).collect()}
    assert again == {i: g["lang_pred"] for i, g in got.items()}
