"""Groups of near copies: texts whose sets of word shingles have a Jaccard likeness of 0.8 or more.

1. A text becomes the set of its shingles of ``words_each`` words (A-Z in lower case, split at blanks; fewer words
   are one shingle). Rows of equal sets are one node.
2. Operator 4 links nodes whose fingerprints over the same shingles differ in ``max_distance`` bits or fewer, by the
   generalised pigeonhole principle (``simhash.links``). That is exact in bits, but a pair of likeness 0.8 may differ in more.
3. So ``BANDS`` x ``EACH`` minimum hashes per node bring the rest: two nodes that share a band are candidates. A pair of
   likeness 0.8 shares none with a chance of (1 - 0.8^5)^32 = 3e-6, a closer pair with less.
4. One bit of each minimum hash is kept. Two nodes of likeness t differ in (1 - t) / 2 of them on average, so ``radius``
   gives a number of bits that a pair at the threshold passes with a chance below 1e-7; with the sizes of the sets it
   thins out candidates of the bands.
5. Whatever is left is verified on the texts: exact Jaccard of both sets of 64-bit shingle hashes.
6. Verified pairs become components. Buckets of up to ``pair_limit`` nodes give all their pairs. A larger bucket first
   compares each node with the bucket's smallest, then, where it still holds several components, in ``PIVOT_ROUNDS`` rounds
   with ``PIVOTS`` nodes picked by hash, so that the members of a large group join it by a few comparisons each. Nodes of
   large buckets that are still apart are then joined by the rarest shingles of their sets (``prefix_pairs``): no pair of
   the likeness is left out, and neither a large group of near copies nor a passage that many texts share gives the
   square of its size.

Odd input: texts without words have the empty set and are copies of each other; a null doc_id is never the smallest
of a group with other ids; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.llm import simhash
from lifecurve.llm.common import map_slices, materialize, numbered_once, slices, texts, without_leftovers
from lifecurve.llm.components import components
from lifecurve.llm.prefix import can_reach, prefixes
from lifecurve.llm.simhash import shingles

WORDS_EACH, LEAST = 5, 0.8
BANDS, EACH = 32, 5
HASHES = BANDS * EACH
LONGS = -(-HASHES // 64)
PAIR_LIMIT = 32
#: Bits in which the fingerprints of operator 4 may differ.
MAX_DISTANCE = 2
#: Nodes of a large bucket with which its other components are compared, and how often others are picked.
PIVOTS, PIVOT_ROUNDS = 4, 2
#: Pairs that one copy of a text serves.
SALT_PAIRS = 256
_DRAWN = np.random.Generator(np.random.PCG64(42))
FACTORS = _DRAWN.integers(0, 1 << 63, HASHES, dtype=np.uint64)[:, None] << np.uint64(1) | np.uint64(1)
SHIFTS = _DRAWN.integers(0, 1 << 63, HASHES, dtype=np.uint64)[:, None]


def shingle_set(text: str, words_each: int = WORDS_EACH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(np.array(shingles(text, words_each), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted sets; empty ones are equal."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    shared = np.intersect1d(a, b, assume_unique=True).size
    return shared / (a.size + b.size - shared)


def minima(found: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over a set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for k in range(0, found.size, 1024):
        low = np.minimum(low, ((FACTORS * found[None, k : k + 1024] + SHIFTS) >> np.uint64(32)).min(axis=1))
    return low.astype("<u4")


def radius(least: float = LEAST, chance: float = 1e-7) -> int:
    """Bits of ``HASHES`` in which a pair of this likeness differs at most, but for the given chance."""
    p = (1 - least) / 2
    left, r = 1.0, -1
    while left > chance and r < HASHES:
        r += 1
        left -= math.comb(HASHES, r) * p**r * (1 - p) ** (HASHES - r)
    return r


def signatures(rows: DataFrame, words_each: int = WORDS_EACH) -> DataFrame:
    """(_row, doc_id, digest, size, fp, bits, keys) of every row of (_row, doc_id, text); fp is operator 4's fingerprint."""

    def run(batches):
        for part in slices(batches):
            digests, sizes, fps, bits, keys = [], [], [], [], []
            for text in texts(part, "text"):
                hashed = np.array(shingles(text, words_each), np.uint64)
                found = np.unique(hashed)
                fps.append(simhash.of_hashes(hashed))
                low = minima(found)
                digests.append(hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest())
                sizes.append(found.size)
                bits.append(np.packbits(np.resize(low & 1, LONGS * 64) * (np.arange(LONGS * 64) < HASHES), bitorder="little").view("<i8").tolist())
                bands = low.reshape(BANDS, EACH)
                keys.append(np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist())
            cells = [part.column("_row"), part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, names=["_row", "doc_id", "digest", "size", "fp", "bits", "keys"])

    return map_slices(rows, run, "_row long, doc_id long, digest binary, size long, fp long, bits array<long>, keys array<long>")


def verified(pairs: DataFrame, said: DataFrame, words_each: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least this likeness; ``said`` is (node, text).

    The text of a node a with many partners is copied, so its pairs are spread over as many keys as they need.
    """

    def run(batches):
        last: dict[int, np.ndarray] = {}

        def set_of(node, text):
            if node not in last:
                if len(last) > 64:
                    last.clear()
                last[node] = shingle_set(text, words_each)
            return last[node]

        for part in slices(batches):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            good = [jaccard(set_of(x, s), set_of(y, t)) >= least for x, y, s, t in zip(a, b, texts(part, "left"), texts(part, "right"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(good)), part.column("b").filter(pa.array(good))], names=["a", "b"])

    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_PAIRS).cast("int").alias("copies"))
    dealt = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    left = said.join(copies, said["node"] == copies["a"]).select("a", F.col("text").alias("left"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    right = said.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = dealt.join(right, "b").join(left, ["a", "salt"])
    return map_slices(both.select("a", "b", "left", "right"), run, "a long, b long")


def prefix_pairs(nodes: DataFrame, said: DataFrame, alike, *, words_each: int = WORDS_EACH, least: float = LEAST) -> DataFrame:
    """(a, b): every pair of ``nodes`` (node, root, size and what ``alike`` needs) of different roots that can have this likeness.

    Sets meet by an element of their prefixes (``prefix``); sizes and the places of the shingle say whether the rest can
    make up the overlap. Only shingles that sets of different roots have are joined.
    """

    def spread(batches):
        for part in slices(batches):
            found = [shingle_set(t, words_each) for t in texts(part, "text")]
            counts = np.array([f.size for f in found], np.int64)
            node = np.repeat(part.column("node").to_numpy(), counts)
            for k in range(0, len(node), 1 << 18):
                sh = np.concatenate(found)[k : k + (1 << 18)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[k : k + len(sh)]), pa.array(sh)], names=["node", "sh"])

    rows = materialize(map_slices(said.join(nodes.select("node"), "node", "left_semi").select("node", "text"), spread, "node long, sh long"))
    prefix = materialize(prefixes(rows, nodes, least))
    mixed = prefix.groupBy("sh").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sh")
    prefix = prefix.join(mixed, "sh", "left_semi")
    x, y = prefix.where("indexed").alias("x"), prefix.alias("y")
    on = (F.col("x.sh") == F.col("y.sh")) & (F.col("x.root") != F.col("y.root")) & can_reach(least) & alike
    met = x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return met.distinct()


def fingerprint_pairs(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) of nodes (_row, fp): those that operator 4 links, one node standing for each fingerprint, and the others of the same one."""
    hubs = materialize(nodes.groupBy("fp").agg(F.min("_row").alias("hub")))
    near = simhash.links(hubs.select("fp"), max_distance)
    near = near.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b")
    same = nodes.join(hubs, "fp").where("_row <> hub").select(F.col("hub").alias("a"), F.col("_row").alias("b"))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same).distinct()


def links(
    nodes: DataFrame, rows: DataFrame, *, words_each: int = WORDS_EACH, least: float = LEAST, pair_limit: int = PAIR_LIMIT,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(a, b) of nodes: verified pairs that connect all pairs of the likeness which operator 4 links or which share a band."""
    close = materialize(fingerprint_pairs(nodes, max_distance))
    keys = nodes.select(F.col("_row").alias("node"), F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("hub")).where("k > 1")
    facts = nodes.select(F.col("_row").alias("node"), "size", *[F.col("bits")[k].alias(f"bits{k}") for k in range(LONGS)])
    shared = materialize(keys.join(sizes, "key").join(facts, "node"))
    used = shared.select("node").union(close.select("a")).union(close.select("b")).distinct()
    said = materialize(rows.select(F.col("_row").alias("node"), "text").join(used, "node", "left_semi"))
    most = radius(least)
    differ = sum((F.bit_count(F.col(f"x.bits{k}").bitwiseXOR(F.col(f"y.bits{k}"))) for k in range(1, LONGS)), F.bit_count(F.col("x.bits0").bitwiseXOR(F.col("y.bits0"))))
    alike = (differ <= most) & (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * F.lit(least - 1e-9))

    def pairs(members: DataFrame) -> DataFrame:
        x, y = members.alias("x"), members.alias("y")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & alike
        return x.join(y, on).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    def apart(found: DataFrame) -> DataFrame:
        """The nodes of large buckets that hold several components, with their own."""
        roots = components(found).select(F.col("a").alias("node"), F.col("b").alias("root"))
        placed = materialize(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return materialize(placed.join(mixed, "key", "left_semi").select("key", "node", "root", "size", *bits))

    def pivot_pairs(left: DataFrame, turn: int) -> DataFrame:
        """Each node with the pivots of its buckets that another component has: at most ``PIVOTS`` rows a bucket and node."""
        picked = [F.min(F.struct(F.xxhash64("node", F.lit(turn * PIVOTS + k)).alias("h"), "node", "root", "size", *bits)) for k in range(PIVOTS)]
        pivots = left.groupBy("key").agg(F.array(*picked).alias("p")).select("key", F.explode("p").alias("p")).select("key", "p.*").drop("h").distinct()
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & alike
        return left.alias("x").join(pivots.alias("y"), on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    bits = [f"bits{k}" for k in range(LONGS)]
    large = shared.where(F.col("k") > pair_limit)
    stars = large.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    tried = materialize(pairs(shared.where(F.col("k") <= pair_limit)).union(stars).union(close).distinct())
    found = materialize(verified(tried, said, words_each, least))
    if large.isEmpty():
        return found
    left = apart(found)
    for turn in range(PIVOT_ROUNDS):
        fresh = materialize(pivot_pairs(left, turn).join(tried, ["a", "b"], "left_anti"))
        more = materialize(verified(fresh, said, words_each, least))
        if more.isEmpty():
            break
        tried, found = tried.union(fresh), found.union(more)
        left = apart(found)
    nodes_left = materialize(left.drop("key").distinct())
    still = prefix_pairs(nodes_left, said, alike, words_each=words_each, least=least).join(tried, ["a", "b"], "left_anti")
    return found.union(materialize(verified(materialize(still), said, words_each, least)))


def near_copies(rows: DataFrame, *, words_each: int = WORDS_EACH, **options) -> DataFrame:
    """(_row, first_row) of every row of (_row, doc_id, text): first_row has the smallest doc_id of the group."""
    signed = materialize(signatures(rows, words_each))
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    groups = materialize(signed.groupBy("digest").agg(lowest.alias("low")).select("digest", "low", F.col("low._row").alias("node")))
    nodes = signed.join(groups.select(F.col("node").alias("_row")), "_row", "left_semi").select("_row", "size", "fp", "bits", "keys")
    roots = components(links(nodes, rows, words_each=words_each, **options)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = placed.groupBy("root").agg(F.min("low").alias("first"))
    named = placed.join(lows, "root").select("digest", F.col("first._row").alias("first_row"))
    return signed.select("_row", "digest").join(named, "digest").select("_row", "first_row")


@without_leftovers
def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those in a group with an earlier one; rows are numbered once, in a table of their own."""
    numbered, row = numbered_once(docs, "_near_row")
    rows = numbered.select(F.col(row).alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stay = near_copies(rows, **options).where(F.col("_row") == F.col("first_row")).select(F.col("_row").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)


__all__ = ["fingerprint_pairs", "jaccard", "links", "minima", "near_copies", "one_of_each", "prefix_pairs", "radius", "shingle_set", "signatures"]
