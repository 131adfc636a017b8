"""Language identification by nearest centroids.

* Features: runs of 1 to 3 letters (characters other than letters become one blank), counted in 2^13 hashed places,
  1 + log of the count, times the inverse document frequency of the sample, normalised to length 1.
* Fit: at most ``sample`` labelled documents a language (those of the least hash of id and text), chosen by Spark without their
  texts; each language's vectors are clustered into up to ``clusters`` centroids by cosine (spherical k-means on the bounded
  sample, one task a language).
* Prediction: the language of the centroid with the highest cosine, over whole texts. A text whose best cosine is below
  its language's ``reject`` quantile of the sample is marked as rejected.

A null text or one without letters is ``und`` with score 0. A null id or language is not learned from. With
nothing to learn from, all is ``und``. Repeated rows are judged alike; ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, stored
from .rolling import mix

PLACES = 1 << 13
_CHUNK = 1 << 20
_PARTS = 1024
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether it's a letter; made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def counts(text: str) -> np.ndarray | None:
    """Counts of the hashed runs of letters, or None without a letter. Long texts go in chunks."""
    out, seen, tail = np.zeros(PLACES, dtype=np.float32), False, np.array([32], dtype=np.uint32)
    for at in range(0, len(text), _CHUNK):
        c = np.frombuffer(text[at:at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _is_letter()[c]
        seen = seen or bool(letter.any())
        c = np.where(letter, c, np.uint32(32))
        blank = c == 32
        again = blank.copy()
        again[1:] &= blank[:-1]
        again[0] &= tail[-1] == 32
        c = np.concatenate([tail, c[~again]])
        new = len(tail)  # runs that end behind the tail are new
        x = c.astype(np.uint64)
        pairs = (x[:-1] << np.uint64(21)) | x[1:]
        triples = (pairs[:-1] << np.uint64(21)) | x[2:]
        runs = [x[new:][x[new:] != 32], pairs[new - 1:] | np.uint64(1 << 62), triples[max(new - 2, 0):] | np.uint64(1 << 63)]
        for r in runs:
            out += np.bincount((mix(r) >> np.uint64(51)).astype(np.int64), minlength=PLACES)
        tail = c[-2:].astype(np.uint32)
    return out if seen else None


def _vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with letters, their vectors)."""
    rows, vectors = [], []
    for i, text in enumerate(texts):
        if text and (c := counts(text)) is not None:
            rows.append(i)
            vectors.append(c)
    if not rows:
        return np.empty(0, dtype=np.int64), np.empty((0, PLACES), dtype=np.float32)
    v = np.array(vectors)
    hit = v > 0
    v[hit] = 1 + np.log(v[hit])
    v *= idf
    return np.array(rows), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # the cosine below which each centroid's language rejects

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        out = [("und", 0.0, True)] * len(texts)
        rows, v = _vectors(texts, self.idf)
        if len(rows) and len(self.languages):
            cosine = v @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, b, row in zip(rows.tolist(), best.tolist(), cosine, strict=True):
                score = float(min(max(row[b], 0.0), 1.0))
                out[i] = (self.languages[b], score, score < self.least[b])
        yield from out


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the vectors farthest from those chosen before."""
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen]
    for _ in range(20):
        own = (v @ c.T).argmax(axis=1)
        new = np.array([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c


def _sample(labelled: DataFrame, sample: int) -> DataFrame:
    """lang, text of the ``sample`` rows of each language with the least hash of id and text, ties by id and the text's other
    hash. Only ids and hashes go through the window; whole texts are read again for the rows chosen alone."""
    key = [F.xxhash64("id", "text").alias("h"), F.col("id"), F.xxhash64("text", F.lit(1)).alias("th")]
    order = ["h", "id", "th"]
    chosen = labelled.select("lang", *key, (F.spark_partition_id() % _PARTS).alias("part"))
    for by in (["lang", "part"], ["lang"]):  # first within parts of the table, so that no task gets the rows of all
        chosen = chosen.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("turn") <= sample)
    chosen = chosen.groupBy("lang", "h", "id", "th").agg(F.count("*").cast("int").alias("copies"))
    chosen = stored(chosen, "op10-chosen")  # its size is known then, so Spark broadcasts it if it's small
    rows = labelled.select("lang", "text", *key).join(chosen, ["lang", "h", "id", "th"])
    rows = rows.groupBy("lang", "h", "id", "th").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))  # a key's rows are alike
    return rows.select("lang", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def fit(labelled: DataFrame, sample: int = 300, clusters: int = 4, reject: float = 0.01, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model:
    """``labelled``: rows to learn from. ``sample`` bounds the rows of a language that are used, and so what one task
    holds: sample x 32 KB. The driver gets ``clusters`` vectors a language and one number a place."""
    d = columns_of(labelled, id_col, text_col, lang_col).toDF("id", "text", "lang").where("id is not null and lang is not null and text is not null")

    def run(batches):
        for batch in batches:
            lang, places, values = [], [], []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (c := counts(text)) is not None:
                    at = np.flatnonzero(c)
                    lang.append(name)
                    places.append(at.tolist())
                    values.append(c[at].tolist())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "places": pa.array(places, pa.list_(pa.int32())),
                                              "n": pa.array(values, pa.list_(pa.float32()))})

    rows = stored(_sample(d, sample).mapInArrow(run, "lang string, places array<int>, n array<float>"), "op10-sample")
    having = rows.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()  # at most PLACES rows
    df = np.zeros(PLACES)
    for r in having:
        df[r["place"]] = r["n"]
    idf = (np.log((1 + rows.count()) / (1 + df)) + 1).astype(np.float32)

    def centres(key, table):
        pairs = sorted(zip(table.column("places").to_pylist(), table.column("n").to_pylist(), strict=True))
        v = np.zeros((len(pairs), PLACES), dtype=np.float32)
        for i, (at, n) in enumerate(pairs):
            v[i, at] = 1 + np.log(np.array(n, dtype=np.float32))
        v *= idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        c = _clusters(v, clusters)
        low = float(np.quantile((v @ c.T).max(axis=1), reject))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "k": pa.array(range(len(c)), pa.int32()),
                         "centre": pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary()), "low": pa.array([low] * len(c), pa.float64())})

    found = rows.groupBy("lang").applyInArrow(centres, "lang string, k int, centre binary, low double").collect()
    found.sort(key=lambda r: (r["lang"], r["k"]))
    at = [np.frombuffer(r["centre"], dtype=np.float32) for r in found]
    return Model([r["lang"] for r in found], np.array(at) if at else np.empty((0, PLACES), dtype=np.float32), idf, np.array([r["low"] for r in found]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score (cosine with the nearest centroid) and rejected of each document."""
    d = columns_of(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages vectors of 32 KB

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score, rejected = zip(*shared.value.predict(part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                                 names=["id", "lang_pred", "score", "rejected"])

    return d.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
