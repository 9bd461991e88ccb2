"""Language identification by string kernels.

A text's features are the distinct byte n-grams of lengths 1 to 3 of its lower-cased letters (a blended spectrum with
presence, not counts), hashed to `DIMS` places. Landmark documents span a Nyström space; one-versus-rest kernel ridge
regression in it gives one weight vector for each language. A batch is scored by two matrix products: presence by
landmarks, kernel values by weights.

It learns from a bounded sample: of each language at most about `per_lang` labelled documents, taken by a hash of their id
over the whole table; of them at most `landmarks` become landmarks. Only presence bits of the sample (DIMS / 8 bytes each)
reach the driver. Every document is scored, on its whole text.

Defined results: null, empty or letterless text gives `und` with score 0, and so does every text where nothing could be
learned (no labelled rows); equal scores go to the language first in order; repeated rows give repeated rows; other
columns stay, and input columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, text_of, without

DIMS = 1 << 14
#: Bounds of the sample: documents for each language, and landmarks in all.
PER_LANG = 300
LANDMARKS = 64
RIDGE = 1e-2
UNKNOWN = "und"
#: Rows of one presence matrix.
BLOCK = 256

#: Lower-case ASCII; everything that is not part of a letter (digits, punctuation, white space, controls) becomes one space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)
_M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def places(text: str) -> np.ndarray:
    """Where the text's n-grams fall, repeats included."""
    b = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]  # runs of spaces count once
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    return np.concatenate([b, (two * _M2) >> shift, (three * _M3) >> shift])


def presence(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        row[places(text)] = 1
    return out


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # presence rows, each over the root of its sum
    weights: np.ndarray  # landmark by language
    bias: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = presence(texts)
        kernel = (x @ self.landmarks.T) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return kernel @ self.weights + self.bias


def _normal(bits: np.ndarray) -> np.ndarray:
    """Presence rows of packed bits, each over the root of its sum."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression in the Nyström space of landmarks taken from the languages in turn; rows are packed bits."""
    langs = sorted(set(labels))
    y = np.array([[1.0 if lab == lang else -1.0 for lang in langs] for lab in labels])
    by_lang = [[i for i, lab in enumerate(labels) if lab == lang] for lang in langs]
    turns = [rows[k] for k in range(max(map(len, by_lang))) for rows in by_lang if k < len(rows)]
    own = _normal(bits[turns[:landmarks]]).astype(np.float64)
    values, vectors = np.linalg.eigh(own @ own.T)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    # some rows at a time: the driver never holds the whole matrix
    phi = np.concatenate([_normal(bits[k : k + 32]).astype(np.float64) @ own.T for k in range(0, len(bits), 32)]) @ root
    weight = np.array([1 / lab_n for lab_n in (len(by_lang[langs.index(lab)]) for lab in labels)])
    weight *= len(labels) / weight.sum()
    mean_phi, mean_y = np.average(phi, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    centred = (phi - mean_phi) * weight[:, None]
    solved = np.linalg.solve(centred.T @ (phi - mean_phi) + ridge * len(labels) * np.eye(phi.shape[1]), centred.T @ (y - mean_y))
    return Model(langs, own.astype(np.float32), (root @ solved).astype(np.float32), (mean_y - mean_phi @ solved).astype(np.float32))


def sample(labelled: DataFrame, per_lang: int = PER_LANG) -> tuple[np.ndarray, list[str]]:
    """Presence rows as packed bits, and languages, of about per_lang documents of each language, chosen by a hash of their id."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros((0, DIMS // 8), dtype=np.uint8), []
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30))
    limits = [F.when((F.col("lang") == lang) & (at < min(1.0, per_lang / n) * (1 << 30)), True) for lang, n in sorted(counts.items())]
    chosen = labelled.filter(F.coalesce(*limits, F.lit(False)))

    def packed_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(presence([t.as_py()]) > 0).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(packed, pa.binary())], names=["key", "lang", "bits"])

    rows = chosen.select(F.xxhash64("doc_id", "text").alias("key"), "lang", "text").mapInArrow(packed_bits, "key long, lang string, bits binary").collect()
    rows = sorted(rows, key=lambda r: (r["key"], r["lang"], r["bits"]))
    taken: dict[str, int] = {}
    kept = []
    for r in rows:  # the hash gives about per_lang; this makes it the bound
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_lang:
            kept.append(r)
    bits = np.frombuffer(b"".join(r["bits"] for r in kept), dtype=np.uint8).reshape(-1, DIMS // 8)
    return bits, [r["lang"] for r in kept]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model | None:
    """A model from the rows of docs that are not held out and have a language and a letter in their text."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    bits, labels = sample(usable.select("doc_id", "lang", "text"), per_lang)
    return fit(bits, labels, landmarks) if labels else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. Only the text goes to Python."""
    kept = without(docs, "lang_pred", "score")
    if model is None:
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:int,score:double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            best, certain = [np.empty(0, np.int32)], [np.empty(0)]
            for start in range(0, len(batch), BLOCK):
                f = own.score(batch.slice(start, BLOCK).to_pylist())
                top = f.argmax(axis=1)
                share = np.clip((f.astype(np.float64) + 1) / 2, 0, 1)
                best.append(top.astype(np.int32))
                certain.append(share.max(axis=1) / np.maximum(share.sum(axis=1), 1e-9))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(best)), pa.array(np.concatenate(certain))], names=["lang", "score"])

    text = F.col(f"`{text_col}`")
    langs = F.array(*[F.lit(x) for x in model.langs])
    found = kept.withColumn("__found", F.when(has_letter(text), scored(text_of(text))))
    return found.withColumns(
        {"lang_pred": F.coalesce(F.get(langs, F.col("__found.lang")), F.lit(UNKNOWN)), "score": F.coalesce(F.col("__found.score"), F.lit(0.0))}
    ).drop("__found")


def identify(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> DataFrame:
    """docs with held_out, lang_pred and score, by a model learned from their own labelled rows."""
    model = learn(docs, per_lang, landmarks)
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> DataFrame:
    """The documents whose language could be identified, with the columns that docs has."""
    model = learn(docs, per_lang, landmarks)
    return shielded(docs, ("doc_id", "text", "lang"), lambda d: predict(d, model).filter(F.col("lang_pred") != UNKNOWN))
