"""Slot values of decontamination against a plain check, both ways: copies in other dress are found, inconsistent ones aren't."""

import itertools
import re

import pytest

from tidemark.llm import decontamination

ITEMS = {
    1: "a farmer keeps 12 hens in the yard and sells eggs at 12, then he counts all the hens and finds 12.",
    2: "April went to the market with a basket, and when the rain began to fall the neighbours saw that April had left it on the wall.",
    3: "The tank holds 1,200 liters of water; a pump moves 40 liters each minute, how long until the 1,200 liters are gone?",
}


def filled(item, values):
    """The item with its numbers replaced in order."""
    it = iter(values)
    return re.sub(r"\d[\d,]*\d|\d", lambda m: next(it), item)


def consistent(ours, theirs):
    return len(set(zip(ours, theirs))) == len(set(ours)) == len(set(theirs))


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()}


def test_copies_in_other_dress(spark):
    dressed = []
    for i, text in ITEMS.items():
        bare = re.sub(r"(?<=\d),(?=\d)", "", text)
        dressed += [(i, text), (i, re.sub(r"[.,;?]", "", bare)), (i, text.replace(" ", "  ")), (i, text.replace(", ", ",\n")), (i, f"Before it. {text} After it."), (i, text.replace(".", " ."))]
    got = found(spark, [t for _, t in dressed])
    assert {(k, i) for k, (i, _) in enumerate(dressed)} <= got


def test_numbers_as_the_plain_check_says(spark):
    cases = [(1, v) for v in itertools.product(("30", "31"), repeat=3)] + [(1, ("30", "31", "32")), (1, ("12", "12", "12")), (1, ("7,", "7", "7"))]
    cases += [(3, v) for v in itertools.product(("900", "25"), repeat=3)]
    got = found(spark, [filled(ITEMS[i], v) for i, v in cases])
    ours = {i: [x.strip(",").replace(",", "") for x in re.findall(r"\d[\d,]*\d|\d", t)] for i, t in ITEMS.items()}
    want = {(k, i) for k, (i, v) in enumerate(cases) if consistent(ours[i], [x.strip(",") for x in v])}
    assert got == want


@pytest.mark.parametrize("names, leaks", [(("June", "June"), True), (("June", "August"), False), (("April", "April"), True)])
def test_names_that_open_a_sentence(spark, names, leaks):
    first, second = ITEMS[2].split("saw that April")
    text = first.replace("April", names[0]) + "saw that " + names[1] + second
    assert ((0, 2) in found(spark, [text])) == leaks
