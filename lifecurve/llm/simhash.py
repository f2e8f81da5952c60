"""SimHash near-duplicates by the generalised pigeonhole principle (operator 4).

Fingerprints of 64 bits are linked at ``max_distance`` or fewer differing bits.

1. One statistic over all distinct fingerprints (64 x 64 counts of bits set together) says which bits are
   correlated; correlated bits go to the same partition.
2. If two fingerprints differ in at most d bits, then for thresholds t_1..t_m of the m partitions with the
   sum d - m + 1 some partition differs in at most its t_i bits (-1: the partition is not probed). For each
   m the numbers of equal values in each partition are counted over all fingerprints, and a dynamic program
   picks the thresholds of the least estimated candidates and probes; the cheapest m is used.
3. Fingerprints that share a probed value are candidates. Buckets of up to ``pair_limit`` members are
   verified pair by pair, which is linear in the members. A larger bucket would be quadratic: its members
   emit themselves and their one-bit neighbours instead (for greater distances: all within half of it), and
   whoever shares such a midpoint is within ``max_distance``, so linking each with the smallest is exact.
4. Links become components; nothing but counts of fixed size reaches the driver.

Odd input: null, empty and wordless texts have fingerprint zero and are linked like any other; a null
doc_id is never the smallest of a component with other ids; repeated rows are repeated; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifecurve.llm.common import map_slices, materialize, numbered_once, slices, texts, without_leftovers
from lifecurve.llm.components import components

BITS = 64
MAX_PARTS = 4
PAIR_LIMIT = 32
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str, words_each: int = 3, seed: int = 42) -> list[int]:
    """Hashes of the text's shingles in their order; a text without words has none."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    n = min(words_each, len(words))
    spans = zip((ends - lengths + 1)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans]


def fingerprint(text: str, words_each: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text as an unsigned number."""
    return of_hashes(shingles(text, words_each, seed))


def of_hashes(hashed) -> int:
    """The fingerprint of shingle hashes, repeats included; zero without any."""
    if not len(hashed):
        return 0
    ones, step = np.zeros(BITS, np.int64), 1 << 14
    for k in range(0, len(hashed), step):
        bits = np.unpackbits(np.array(hashed[k : k + step], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(_row, doc_id, fp) of every row; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for part in slices(batches):
            fps = np.array([fingerprint(t, words_each) for t in texts(part, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("doc_id"), pa.array(fps)], names=["_row", "doc_id", "fp"])

    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row.alias("_row"))
    return map_slices(rows, run, "_row long, doc_id long, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all rows: 64 x 64, the diagonal counts each bit."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for part in batches:
            v = part.column("fp").to_numpy(zero_copy_only=False).view("<u8").copy()
            for k in range(0, v.size, 1 << 14):
                bits = np.unpackbits(v[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.astype(np.int64).ravel())], names=["cell", "n"])

    cells = map_slices(fps.select("fp"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for cell, n in cells:
        out[cell] = n
    return out.reshape(BITS, BITS)


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` partitions of about equal width, correlated ones together."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    linked = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = -(-len(left) // (parts - k))
        group = [max(left, key=lambda b: (linked[b, left].sum() - linked[b, b], -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (linked[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def within(counts: np.ndarray, n: int, bits: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0..most of the bits, bits taken as independent."""
    exact = np.zeros(len(bits) + 1)
    exact[0] = 1.0
    for b in bits:
        f = counts[b, b] / max(n, 1)
        differ = 2 * f * (1 - f)
        exact[1:] = exact[1:] * (1 - differ) + exact[:-1] * differ
        exact[0] *= 1 - differ
    return np.cumsum(exact)[: most + 1].tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the least cost whose sum is ``total``; costs[i][t] for t >= 0, -1 costs nothing."""
    best = {0: (0.0, [])}
    for row in costs:
        more: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                new = (cost + (row[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t not in more or new < more[used + t]:
                    more[used + t] = new
        best = more
    return best[total]


def plan(fps: DataFrame, n: int, max_distance: int) -> list[tuple[list[int], int]]:
    """Partitions to probe, each with its threshold, from counts over all distinct fingerprints."""
    counts = bit_counts(fps)
    layouts = {m: group_bits(counts, n, m) for m in range(1, MAX_PARTS + 1)}
    values = [(m, i, value_of(F.col("fp"), bits)) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), v.alias("v")) for m, i, v in values])).alias("x")).select("x.*")
    same = rows.groupBy("m", "i", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = {(m, i): p for m, i, p in same.groupBy("m", "i").agg(F.sum(F.expr("n * (n - 1) / 2"))).collect()}
    choices = []
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            near = within(counts, n, bits, max_distance)
            ball = np.cumsum([math.comb(len(bits), t) for t in range(max_distance + 1)])
            costs.append([max(pairs.get((m, i), 0.0), 1.0) * near[t] / max(near[0], 1e-300) + n * float(ball[t]) for t in range(max_distance + 1)])
        cost, chosen = allocate(costs, max_distance - m + 1)
        choices.append((cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def mask_of(bits) -> int:
    """Bits as a signed long."""
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def value_of(fp, bits: list[int]):
    return fp.bitwiseAND(F.lit(mask_of(bits)))


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of up to ``most`` of the bits."""
    return [mask_of(c) for t in range(most + 1) for c in combinations(bits, t)]


def moved(value: Column, masks: list[int]) -> Column:
    """The value under each mask, as an array; the masks are one literal."""
    if len(masks) == 1:
        return F.array(value.bitwiseXOR(F.lit(masks[0])))
    given = F.from_json(F.lit(str(masks)), "array<bigint>")
    return F.transform(given, lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame, max_distance: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b) of distinct fingerprints that connect all which differ in ``max_distance`` bits or fewer.

    Small buckets give every such pair; for large ones the links reach the same components.
    ``max_distance`` is even, as midpoints of large buckets need it.
    """
    if max_distance % 2:
        raise ValueError("max_distance must be even")
    n = fps.count()
    probes = plan(fps, n, max_distance)
    probed = reduce(DataFrame.union, [fps.select("fp", F.lit(i).alias("part"), F.explode(moved(value_of(F.col("fp"), bits), flips(bits, t))).alias("key")) for i, (bits, t) in enumerate(probes)])
    sizes = probed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(probed.join(sizes, ["part", "key"]))
    small = shared.where(F.col("n") <= pair_limit).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    first = small.select("fps", F.explode("fps").alias("a"))
    near = first.select("a", F.explode("fps").alias("b")).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance))
    crowd = shared.where(F.col("n") > pair_limit).select("fp").distinct()
    half = flips(list(range(BITS)), max_distance // 2)
    middle = crowd.select("fp", F.explode(moved(F.col("fp"), half)).alias("mid"))
    hubs = middle.groupBy("mid").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    starred = middle.join(hubs, "mid").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return near.union(starred)


def near_duplicates(docs: DataFrame, *, max_distance: int = 2, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(_row, doc_id, fp, component_id, first_row) of every row.

    component_id: the smallest doc_id reachable over links; first_row: the row that has it.
    """
    rows = materialize(fingerprints(docs, words_each=words_each, id_col=id_col, text_col=text_col, row_col=row_col))
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    fps = materialize(rows.groupBy("fp").agg(lowest.alias("low")))
    roots = components(links(fps.select("fp"), max_distance)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    placed = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = placed.groupBy("root").agg(F.min("low").alias("low"))
    named = placed.select("fp", "root").join(lows, "root").select("fp", F.col("low.doc_id").alias("component_id"), F.col("low._row").alias("first_row"))
    return rows.join(named, "fp").select("_row", "doc_id", "fp", "component_id", "first_row")


def hex16(fp):
    """A signed long's bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@without_leftovers
def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those near an earlier one: the first row of each component stays."""
    numbered, row = numbered_once(docs, "_op4_row")
    found = near_duplicates(numbered, row_col=row, **options)
    stay = found.where(F.col("_row") == F.col("first_row")).select(F.col("_row").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)


__all__ = ["allocate", "fingerprint", "fingerprints", "group_bits", "hex16", "links", "near_duplicates", "of_hashes", "one_of_each", "plan", "shingles"]
