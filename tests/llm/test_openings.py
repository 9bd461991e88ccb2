"""Benchmark items whose names open sentences."""

from tidemark.llm import decontamination


def test_names_that_open_sentences(spark):
    item = "Maria buys 12 apples at the market. Maria gives 5 of them to her brother and keeps the rest. How many apples does Maria keep?"
    teens = "They saw {} birds on the lake and then {} more birds near the shore of it."
    bench = spark.createDataFrame([(1, item), (2, teens.format("13", "61")), (3, "hi there")], "item_id long, text string")
    other = item.replace("Maria", "Olga").replace("12", "40").replace("5", "9")
    rows = [(1, "Intro: " + other), (2, other.replace("Olga gives", "Boris gives")), (3, "So. " + teens.format("fourteen", "one")), (4, "Hi there!"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()} == {(1, 1), (3, 2), (4, 3)}
