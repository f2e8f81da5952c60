"""SpotSigs document fingerprints (operator 7).

A spot is a common word (an anchor) and the chain of the next ``chain`` content words after it. Each spot is
hashed to 32 bits; the set of a text's spots is its fingerprint, written as base64 of the sorted numbers
(little-endian). Sets lie in classes by length: two sets of Jaccard likeness t or more have lengths of a
ratio of t at least, so only neighbouring classes can match; ``likeness`` gives up as soon as lengths, or
what is left of the shorter set, cannot reach the asked likeness any more.

``fingerprint_edits`` pairs each document with the next one in order of doc_id. The table is dealt once by
ranges of doc_id; the first document of a range is copied to the range before (the very first to the last),
so every task finds each document's follower next to it.

``similar_documents`` compares the fingerprints of a whole table: sets are dealt by their rarest spots and by length class
(the smaller of two sets goes to its own class and the next, the larger to its own), so only sets of equal and
neighbouring classes that share a spot of their prefixes meet; each such pair is verified by the pruned ``likeness``.

Odd input: null and empty texts have the fingerprint of no words; a text without any spot has one spot, its
words; a null doc_id comes before all others; equal doc_ids are ordered by text; a single document follows
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.llm.common import map_slices, materialize, numbered_once, slices, texts
from lifecurve.llm.components import components
from lifecurve.llm.prefix import can_reach, prefixes

CHAIN = 3
#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have in is it not of on or that the this to was were with "
    "als auch auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al como con de del el en es la las lo los más no para por que se su un una y".split()
)
WORD = re.compile(r"\w+")
RANGE_ROWS, LEAST_ROWS = 1 << 16, 1 << 11


def spots(text: str, chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct spots of a text."""
    content: list[str] = []
    marks: list[tuple[str, int]] = []
    for word in WORD.findall(text.lower()):
        if word in ANCHORS:
            marks.append((word, len(content)))
        else:
            content.append(word)
    crc = zlib.crc32
    found = {crc(f"{word} {' '.join(content[k : k + chain])}".encode()) for word, k in marks if k < len(content)}
    if not found:
        found = {crc(("\n" + " ".join(WORD.findall(text.lower()))).encode())}
    return np.sort(np.fromiter(found, np.uint32, len(found)))


def fingerprint(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def length_class(n: int, least: float = 0.8) -> int:
    """Class of a set's length: sets of a likeness of ``least`` or more lie in equal or neighbouring classes."""
    return int(np.floor(np.log(max(n, 1)) / -np.log(least) + 1e-9))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 as soon as it is surely below ``least``."""
    short, long_ = (a, b) if a.size <= b.size else (b, a)
    if not short.size or short.size < least * long_.size:
        return 0.0
    shared, step = 0, 256
    for k in range(0, short.size, step):
        part = short[k : k + step]
        at = np.searchsorted(long_, part)
        shared += int((long_[np.minimum(at, long_.size - 1)] == part).sum())
        most = shared + short.size - k - part.size
        if most < least * (a.size + b.size - most):
            return 0.0
    return shared / (a.size + b.size - shared)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(docs: DataFrame, id_col: str) -> list[int]:
    """Lower bounds of all ranges but the first, from the ids alone."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("double").alias("id"))
    n = rows.count()
    count = max(-(-n // RANGE_ROWS), min(-(-n // LEAST_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if count < 2:
        return []
    cuts = rows.approxQuantile("id", [k / count for k in range(1, count)], 0.1 / count)
    return sorted({int(c) for c in cuts})


def fingerprint_edits(docs: DataFrame, *, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_spots, length_class."""
    bounds = ranges(docs, id_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def place(doc):
        return 0 if doc is None else bisect_right(bounds, doc)

    # The ranges in use and their first ids: one row each, as many as there are bounds.
    place_col = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    heads = source.select("doc_id", F.when(F.col("doc_id").isNull(), 0).otherwise(place_col).alias("range"))
    firsts = dict(map(tuple, heads.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))["doc_id"].alias("first")).collect()))
    used = sorted(firsts)
    # The range before each one, and the ids that open a range. The first range is copied to the last.
    before = {r: used[k - 1] for k, r in enumerate(used)}

    def deal(batches):
        for part in slices(batches):
            ids, all_texts = part.column("doc_id").to_pylist(), texts(part, "text")
            rows = [(place(d), False, d, t) for d, t in zip(ids, all_texts, strict=True)]
            rows += [(before[r], True, d, t) for r, _, d, t in rows if firsts[r] == d]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=["range", "guest", "doc_id", "text"])

    def walk(batches):
        feed = (r for b in slices(batches) for r in zip(*[b.column(k).to_pylist() for k in ("range", "guest", "doc_id", "text")], strict=True))
        now, held, out, size = next(feed, None), None, [], 0
        while now is not None:
            range_no, guest, doc, text = now
            if guest:  # guests of a range come after its own rows, the least first; one follower is enough
                now = next(feed, None)
                continue
            own = held if held is not None else spots(text, chain)
            now = next(feed, None)
            if now is not None and now[0] == range_no:
                follower = now[3]
                next_spots = spots(follower, chain)
                held = None if now[1] else next_spots
            else:
                raise RuntimeError("a range has no follower")
            changed = edited(text, follower)
            changed_spots = spots(changed, chain)
            out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(own), fingerprint(changed_spots), likeness(own, changed_spots), likeness(own, next_spots), own.size, length_class(own.size)))
            size += own.size + changed_spots.size
            if len(out) >= 256 or size > 1 << 19:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int32()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots", "length_class"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = map_slices(source, deal, "range int, guest boolean, doc_id long, text string").repartition(len(bounds) + 1, "range")
    runs = dealt.sortWithinPartitions("range", "guest", "doc_id", "text")
    return map_slices(
        runs, walk,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long, length_class int",
    )


def signatures(rows: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(_row, doc_id, digest, size, spots) of every row of (_row, doc_id, text), written once."""

    def run(batches):
        for part in slices(batches):
            found = [spots(t, chain) for t in texts(part, "text")]
            digests = [hashlib.blake2b(f.astype("<u4").tobytes(), digest_size=16).digest() for f in found]
            cells = [part.column("_row"), part.column("doc_id"), pa.array(digests, pa.binary()), pa.array([f.size for f in found], pa.int64()), pa.array([f.astype(np.int64).tolist() for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, names=["_row", "doc_id", "digest", "size", "spots"])

    return materialize(map_slices(rows.select("_row", "doc_id", "text"), run, "_row long, doc_id long, digest binary, size long, spots array<long>"))


def similar_sets(nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness), a < b: all pairs of different sets of ``nodes`` (node, size, spots) with this likeness or more."""
    # ``length_class`` as a column.
    cls = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(-np.log(least)) + 1e-9).cast("int")
    facts = nodes.select("node", "size", cls.alias("cls"))
    prefix = materialize(prefixes(nodes.select("node", F.explode("spots").alias("sh")), facts, least))
    x = prefix.where("indexed").withColumn("to", F.explode(F.array(F.col("cls"), F.col("cls") + 1))).alias("x")
    y = prefix.alias("y")
    on = (F.col("x.sh") == F.col("y.sh")) & (F.col("x.to") == F.col("y.cls")) & can_reach(least)
    met = x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def verify(batches):
        for part in slices(batches):
            sets = [[np.array(v, np.int64) for v in part.column(c).to_pylist()] for c in ("left", "right")]
            found = [likeness(a, b, least) for a, b in zip(*sets, strict=True)]
            good = pa.array([f >= least for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good), pa.array(found, pa.float64()).filter(good)], names=["a", "b", "likeness"])

    left, right = (nodes.select(F.col("node").alias(n), F.col("spots").alias(s)) for n, s in (("a", "left"), ("b", "right")))
    return map_slices(met.join(left, "a").join(right, "b").select("a", "b", "left", "right"), verify, "a long, b long, likeness double")


def similar_documents(docs: DataFrame, least: float = 0.8, *, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, n_links) of every row: the smallest doc_id reachable over likenesses, and the links of its fingerprint.

    Rows of equal fingerprints are one set, so copies make no pairs. Null ids are never the smallest beside others.
    """
    numbered, row = numbered_once(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "_row")
    signed = signatures(numbered.withColumnRenamed(row, "_row"), chain)
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    sets = materialize(signed.groupBy("digest").agg(lowest.alias("low"), F.first("size").alias("size"), F.first("spots").alias("spots")).withColumn("node", F.col("low._row")))
    pairs = materialize(similar_sets(sets.select("node", "size", "spots"), least))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(pairs.select("a", "b")).select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = sets.select("digest", "low", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = placed.groupBy("root").agg(F.min("low").alias("first"))
    named = placed.join(lows, "root").join(ends, "node", "left").select("digest", F.col("first.doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("doc_id", "digest").join(named, "digest").drop("digest")
