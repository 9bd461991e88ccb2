"""Token counts of whole texts, by batch encoding in an Arrow function that returns lengths only.

A text is split at safe boundaries: a space between two characters that are not white space. The tokenizer's
pre-tokenization always starts a new piece there, so counts of the parts add up to the count of the text; a text of any
length is never encoded in one call unless it has no such boundary. Parts recur, so each task keeps a bounded table of
counts and encodes only parts that it hasn't met, in calls of about `call_bytes` bytes.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings inside a text are encoded as the library
does by default; repeated rows give repeated rows; an empty table gives an empty result; other columns stay, and input
columns named like an added one are replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Entries of a task's table of counts; when full, it starts again.
CACHE_PARTS = 250_000
#: Longer parts are not kept in the table.
CACHE_PART_CHARS = 200
#: Bytes that one call of the tokenizer gets, about.
CALL_BYTES = 1 << 20

_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_counters: dict[str, PartCounter] = {}


def split_safely(text: str) -> list[str]:
    """Parts whose token counts add up to the text's: the first as it is, each other one with a space put before it."""
    return text.split(" ") if "  " not in text else _BOUNDARY.split(text)


class PartCounter:
    """Counts tokens with one tokenizer file; one for each Python worker."""

    def __init__(self, path: str, call_bytes: int = CALL_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.call_bytes, self.known = path, call_bytes, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: map(len, model.encode(texts, num_threads=1))
            self.splits = False  # its normalizer sees white space as a whole
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: (len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False))
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            #: Only this pre-tokenizer, without a normalizer, is known to start a piece at every boundary.
            self.splits = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel"

    def encoded(self, texts: list[str]) -> Iterator[int]:
        """Counts of the texts, encoded in batches of about as many bytes."""
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= self.call_bytes:
                yield from self.encode(texts[start : i + 1])
                start, held = i + 1, 0
        if start < len(texts):
            yield from self.encode(texts[start:])

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return list(self.encoded(texts))
        out, start, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= 8 * self.call_bytes or i == len(texts) - 1:
                out += self._counts(texts[start : i + 1])
                start, held = i + 1, 0
        return out

    def _counts(self, texts: list[str]) -> list[int]:
        parts = [split_safely(t) for t in texts]
        firsts = list(self.encoded([p[0] for p in parts]))
        if len(self.known) > CACHE_PARTS:
            self.known = {}
        known, new = self.known, set()
        for p in parts:
            new.update(p[1:])
        new = [x for x in new if x not in known]
        extra = dict(zip(new, self.encoded([" " + x for x in new]), strict=True))
        long = {x: n for x, n in extra.items() if len(x) > CACHE_PART_CHARS}
        known.update((x, n) for x, n in extra.items() if x not in long)
        if long:
            known = known | long
        return [n + sum(map(known.__getitem__, p[1:])) for n, p in zip(firsts, parts, strict=True)]


def counter(path: str) -> PartCounter:
    if path not in _counters:
        _counters[path] = PartCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit (n_tokens > limit); only the text column goes to Python."""

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(tokenizer_path)
        for batch in batches:
            yield pa.array(np.asarray(own.counts(batch.to_pylist()), dtype=np.int64))

    text = text_of(f"`{text_col}`")
    added = {"n_bytes": F.octet_length(text).cast("long"), "n_tokens": n_tokens(text)}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*added, "over_limit"}]
    return docs.select(*kept, *[v.alias(k) for k, v in added.items()]).withColumn("over_limit", F.col("n_tokens") > limit)
