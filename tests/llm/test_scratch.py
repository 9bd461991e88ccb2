"""Tables of a scratch go with it, kept ones stay."""

from pathlib import Path

import pytest

from tidemark.llm.common import cut_table, scratch
from tidemark.shared import shared_dir


def tables(spark):
    found = Path(shared_dir(spark).removeprefix("file:")) / "tidemark"
    return set(found.iterdir()) if found.exists() else set()


def test_scratch(spark):
    before = tables(spark)
    with scratch(spark) as keep:
        one = cut_table(spark.range(5))
        with scratch(spark) as inner:
            two = inner(one.selectExpr("id + 1 as id"))
            cut_table(two)
        assert len(tables(spark) - before) == 2  # what the inner one kept is the outer one's
        three = keep(two.filter("id > 2"))
    assert len(tables(spark) - before) == 1 and three.count() == 3
    with pytest.raises(ValueError), scratch(spark):
        cut_table(spark.range(2))
        raise ValueError
    assert len(tables(spark) - before) == 1
