"""Language identification by nearest centroids with rejection by distance (operator 6).

A text becomes a vector of its byte n-grams (two and three bytes of the lower-case text, everything but
letters is one blank), hashed to ``dims`` places: log(1 + count) times inverse document frequency, scaled to
length one. Document frequencies are counted over all learning rows. For each language a bounded sample of
``fit_rows`` learning rows (those whose ids hash lowest) is clustered into ``clusters`` centroids by spherical
k-means in a task of its own. A text has the language of the centroid with the largest cosine; its score is
that cosine. A text is rejected if its cosine lies under the floor of its language and length: for each class of
lengths (doubling from ``SHORTEST`` characters) windows of the sample are compared with their language's centroids, and
the floor is ``FLOOR_PART`` of the ``FLOOR_SHARE`` quantile, so no single odd row moves it. A text shorter than all
classes has its part of the first floor. Texts of which under ``LEAST_LETTERS`` of the visible bytes are letters (hex dumps,
tables of numbers) are rejected too, from ``FULL_CHARS`` characters on: their few letters say nothing about a language.

The model has languages x clusters x dims numbers whatever the corpus; it is the only thing that the driver
gathers. Odd input: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is any text
if there is nothing to learn from; rows without language are not learnt from; a null doc_id is neither held
out nor learnt from; repeated rows are repeated; other columns are ignored.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifecurve.llm.common import map_slices, ready, slices

DIMS = 4096
FIT_ROWS = 400
CLUSTERS = 4
FULL_CHARS = 64
#: Classes of length, and the floor of each.
SHORTEST, CLASSES = 12, 8
FLOOR_SHARE, FLOOR_PART, FLOOR_ROWS = 0.01, 0.65, 10
LEAST_LETTERS = 0.45
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of the n-grams: lower-case ASCII letters and everything beyond ASCII; the rest is blank.
FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
AT_ONCE = 256


def gram_counts(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Counts of hashed n-grams: one row per text."""
    folded = []
    for t in texts:
        raw = FOLD[np.frombuffer(b" " + t.lower().encode() + b" ", np.uint8)]
        folded.append(raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))])
    sizes = np.array([len(f) for f in folded])
    whole, owner = np.concatenate(folded).astype(np.uint32), np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros(len(texts) * dims, np.int64)
    for n, seed in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if len(whole) < n:
            continue
        code = whole[: len(whole) - n + 1].copy()
        for k in range(1, n):
            code = code << np.uint32(8) | whole[k : len(whole) - n + 1 + k]
        place = ((code * np.uint32(seed)) >> np.uint32(16)) % np.uint32(dims)
        own = owner[: len(code)] == owner[n - 1 :]
        out += np.bincount(owner[: len(code)][own] * dims + place[own], minlength=len(out))
    return out.reshape(len(texts), dims)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(gram_counts(texts, len(idf)).astype(np.float32)) * idf)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the row nearest the mean and then the rows farthest from those chosen."""
    centres = [rows[int(np.argmax(rows @ rows.mean(axis=0)))]]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[int(np.argmin(np.max(rows @ np.array(centres).T, axis=1)))])
    now = np.array(centres)
    for _ in range(rounds):
        mine = np.argmax(rows @ now.T, axis=1)
        now = unit(np.array([rows[mine == c].sum(axis=0) if (mine == c).any() else now[c] for c in range(len(now))]))
    return now


@dataclass
class Model:
    """Centroids (one row each) with their languages, and per centroid the least cosine accepted in each class of length."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections."""
        langs, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        known = [k for k, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        for at in range(0, len(known), AT_ONCE):
            some = known[at : at + AT_ONCE]
            mine = [texts[k] for k in some]
            cosine = vectors(mine, self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            score = np.clip(cosine[np.arange(len(some)), best], 0.0, 1.0)
            scores[some] = score
            sizes = np.array([len(t) for t in mine])
            least = self.floors[best, np.clip(length_class(sizes), 0, CLASSES - 1)] * np.minimum(1.0, sizes / SHORTEST)
            rejected[some] = (score < least) | ((sizes >= FULL_CHARS) & (letter_share(mine) < LEAST_LETTERS))
            for k, b in zip(some, best.tolist(), strict=True):
                langs[k] = self.langs[b]
        return langs, scores, rejected


def length_class(sizes: np.ndarray) -> np.ndarray:
    """How often a length has doubled since ``SHORTEST``."""
    return np.floor(np.log2(np.maximum(sizes, 1) / SHORTEST) + 1e-9).astype(int)


def letter_share(texts: list[str]) -> np.ndarray:
    """Part of the visible bytes of each text that are letters (or beyond ASCII)."""
    out = np.ones(len(texts))
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        seen = np.count_nonzero(raw > 32)
        out[k] = np.count_nonzero(((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)) / seen if seen else 1.0
    return out


def floors(texts: list[str], idf: np.ndarray, centroids: np.ndarray) -> list[float]:
    """The least cosine accepted in each class of length: one window of each text that is long enough."""
    out, last = [], 0.0
    for k in range(CLASSES):
        n = SHORTEST << k
        windows = [t[(at := zlib.crc32(t.encode()) % (len(t) - n + 1)) : at + n] for t in texts if len(t) >= n]
        windows = [w for w in windows if LETTER.search(w)]
        if len(windows) >= FLOOR_ROWS:
            nearest = np.concatenate([np.max(vectors(windows[at : at + AT_ONCE], idf) @ centroids.T, axis=1) for at in range(0, len(windows), AT_ONCE)])
            last = FLOOR_PART * float(np.quantile(nearest, FLOOR_SHARE))
        out.append(last)
    return out


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(
    docs: DataFrame, *, dims: int = DIMS, fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Learn from the rows with a language whose id is not held out."""
    learn = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learn = learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def frequencies(batches):
        total, n = np.zeros(dims, np.int64), 0
        for part in slices(batches):
            all_texts = [t for t in part.column("text").to_pylist() if t]
            for at in range(0, len(all_texts), AT_ONCE):
                some = all_texts[at : at + AT_ONCE]
                total += (gram_counts(some, dims) > 0).sum(axis=0)
                n += len(some)
        yield pa.RecordBatch.from_pydict({"place": pa.array([*range(dims), -1], pa.int32()), "n": pa.array([*total.tolist(), n], pa.int64())})

    counted = map_slices(learn.select("text"), frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen = dict(map(tuple, counted))
    idf = np.log((1 + seen.get(-1, 0)) / (1 + np.array([seen.get(k, 0) for k in range(dims)]))).astype(np.float32) + 1

    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rates = {r["lang"]: min(1.0, (2.0 * fit_rows + 50) / r["n"]) for r in sizes.collect()}
    if not rates:
        return Model(idf, [], np.zeros((0, dims), np.float32), np.zeros((0, CLASSES)))
    rate = F.element_at(F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v * (1 << 40)))]), F.col("lang"))
    near = learn.withColumn("mark", mark).where(F.col("mark") < rate)
    first = Window.partitionBy("lang").orderBy("mark", "doc_id", F.xxhash64("text"))
    sample = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= fit_rows).select("lang", "text")

    def centroids(key, table):
        texts = [t for t in table.column("text").to_pylist() if LETTER.search(t)]
        if not texts:
            return pa.table({"lang": [], "centroid": [], "floors": []}, schema=out)
        rows = vectors(texts, idf)
        found = cluster(rows, clusters)
        least = [floors(texts, idf, found)] * len(found)
        return pa.table({"lang": [key[0].as_py()] * len(found), "centroid": [c.astype("<f4").tobytes() for c in found], "floors": least}, schema=out)

    out = pa.schema([("lang", pa.string()), ("centroid", pa.binary()), ("floors", pa.list_(pa.float64()))])
    rows = sample.groupBy("lang").applyInArrow(centroids, "lang string, centroid binary, floors array<double>").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    found = np.array([np.frombuffer(r["centroid"], "<f4") for r in rows]).reshape(len(rows), dims)
    return Model(idf, [r["lang"] for r in rows], found, np.array([r["floors"] for r in rows]).reshape(len(rows), CLASSES))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, in one pass without a shuffle."""

    def run(batches):
        for part in slices(batches):
            langs, scores, rejected = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(langs), pa.array(scores), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).alias("text"))
    return map_slices(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""

    ready(docs.sparkSession)

    @F.pandas_udf("boolean")
    def keep(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column), bool)
        values = [v if isinstance(v, str) else None for v in column]
        for at in range(0, len(values), AT_ONCE):
            out[at : at + AT_ONCE] = ~model.predict(values[at : at + AT_ONCE])[2]
        return pd.Series(out)

    return docs.where(keep(F.col(text_col)))
