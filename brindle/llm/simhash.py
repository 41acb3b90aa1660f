"""SimHash near-duplicate detection with pigeonring filtering.

A text's words are its runs of other than ASCII white space, A-Z lower-cased; its features are all shingles of n words,
repeats included (fewer words: the whole sequence). A fingerprint bit is 1 if it is set in over half the XXH64 values.

Two fingerprints link at `radius` or fewer differing bits. The 64 bits form a ring of m segments. By the pigeonring
principle, a pair within the radius has a start from which every chain of 1, 2, ... m consecutive segments has at most
its proportional share of the radius in differences. At least m - radius segments are equal, so each distinct
fingerprint goes to one bucket for every choice of so many segments; in a bucket, pairs must pass the chains and then
the full Hamming check. Buckets give spanning links only, never all pairs; connected components join the links.

Copies: documents of one fingerprint count once from the start, so a group of exact copies costs one row. A bucket
holds distinct fingerprints that agree in all key bits; a large one is searched breadth first, each newly reached
fingerprint against those not reached yet. Nothing is capped or left out.

With a wide radius, chance pairs appear among very many documents. Then a second 64-bit fingerprint, of hashes with
another seed, must agree too: at most `check` of its bits may differ. The number of segments follows from the number of
distinct fingerprints, so that buckets stay small; it doesn't change which pairs link.

Nulls and edge cases: a null or wordless text has fingerprint zero and links like any other; a null doc_id gets a
component but never names one, unless it has no other member (then null); repeated rows give repeated rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import near_sets
from brindle.llm.common import settled, stored, table
from brindle.llm.components import components

SEED, CHECK_SEED = 42, 43
BITS = 64
PART = 1 << 15  # shingles whose bits are unpacked at once
SMALL = 24  # buckets up to this size are compared pair by pair, all buckets of a batch together


def fingerprint(text: str | None, n: int, seed: int = SEED) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(n, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(BITS, np.int64), len(last)
    for at in range(0, total, PART):
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(first[at : at + PART], last[at : at + PART], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, n: int, checked: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) per row, or (doc_id, fp, other); fingerprints as signed 64-bit integers."""
    seeds = {"fp": SEED} | ({"other": CHECK_SEED} if checked else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [pa.array([fingerprint(x.as_py(), n, seed) for x in batch.column(1)], pa.int64()) for seed in seeds.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *prints], ["doc_id", *seeds])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in seeds))


def segments_for(count: int, radius: int) -> int:
    """The least number of segments whose keys have more bits than the count of fingerprints."""
    bits = max(16, count.bit_length() + 1)
    return next((m for m in range(radius + 2, 24) if BITS * (m - radius) // m >= bits), 24)


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments of the 64 bits, their widths as even as can be."""
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(m: int, radius: int) -> list[int]:
    """The key bits of every choice of m - radius segments, as signed 64-bit integers."""
    out = []
    for kept in combinations(segments(m), m - radius):
        bits = sum(((1 << w) - 1) << s for s, w in kept)
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def linked(x: np.ndarray, m: int, radius: int) -> np.ndarray:
    """Of XORs of fingerprints: which pass the pigeonring chains and the full Hamming check."""
    diff = [np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int16) for s, w in segments(m)]
    ring = np.zeros(x.shape, bool)
    for start in range(m):
        chain, so_far = np.zeros(x.shape, np.int16), np.ones(x.shape, bool)
        for length in range(1, m + 1):
            chain = chain + diff[(start + length - 1) % m]
            so_far &= chain * m <= length * radius
            if not so_far.any():
                break
        ring |= so_far
    ring[ring] = np.bitwise_count(x[ring]) <= radius
    return ring


class Bucket:
    """Links between fingerprints (rows of one or two numbers)."""

    def __init__(self, m: int, radius: int, check: int | None):
        self.m, self.radius, self.check = m, radius, check

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a ^ b
        found = linked(x[..., 0], self.m, self.radius)
        if self.check is not None:
            found[found] = np.bitwise_count(x[found][:, 1]) <= self.check
        return found

    def reach(self, fps: np.ndarray) -> Iterator[np.ndarray]:
        """Spanning links of one bucket, breadth first: rows of both ends."""
        left = fps
        while len(left):
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                a, front = front[:64], front[64:]
                near = self.near(a[:, None], left[None, :])
                got = near.any(axis=0)
                if got.any():
                    yield np.concatenate([left[got], a[near.argmax(axis=0)[got]]], axis=1)
                    front, left = np.concatenate([front, left[got]]), left[~got]

    def links(self, keys: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
        """Links within runs of equal keys; a spanning set for large runs, pairs for small ones."""
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(keys)])
        small = np.repeat(np.where((sizes > 1) & (sizes <= SMALL), starts, -1), sizes)
        for d in range(1, min(SMALL, int(sizes.max(initial=1)))):
            at = np.flatnonzero((small[d:] == small[:-d]) & (small[d:] >= 0))
            if not at.size:
                break
            ok = at[self.near(fps[at], fps[at + d])]
            yield np.concatenate([fps[ok], fps[ok + d]], axis=1)
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            yield from self.reach(fps[s : s + n])


def links(fps: DataFrame, radius: int, m: int, check: int | None = None) -> DataFrame:
    """(a, b), structs of the columns of fps: links that span every group of near fingerprints. fps: distinct fp (and other)."""
    spark, names = fps.sparkSession, fps.columns
    ends = [f"{side}_{c}" for side in "ab" for c in names]
    bucket = Bucket(m, radius, check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray):
            got = [np.zeros((0, len(ends)), np.uint64), *bucket.links(rows[:, :2], rows[:, 2:].view(np.uint64))]
            pairs = np.concatenate(got).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(len(ends))], ends)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            if held and (held[0][0, :2] != rows[0, :2]).any():
                yield emit(np.concatenate(held))
                held = []
            if new.size:  # all but the last bucket is complete
                cut_at = int(new[-1]) + 1
                yield emit(np.concatenate([*held, rows[:cut_at]]))
                held = [rows[cut_at:]]
            else:
                held.append(rows)
        if held:
            yield emit(np.concatenate(held))

    keyed = fps.select(*names, F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(k)) for k in masks(m, radius)))).alias("choice", "part"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "choice", "part").sortWithinPartitions("choice", "part", *names)
    found = dealt.select("choice", "part", *names).mapInArrow(run, ", ".join(f"{c} bigint" for c in ends))
    return found.select(*(F.struct(*(F.col(f"{side}_{c}").alias(c) for c in names)).alias(side) for side in "ab"))


def near_duplicates(docs: DataFrame, n: int, radius: int = 0, check: int | None = None, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest doc_id reachable over links.

    With a similarity, links are by the Jaccard similarity of the shingle sets, and fp is the hash of a set.
    """
    if similarity is not None:
        rows, roots = near_sets.groups(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n, similarity)
        named = rows.join(roots, "s", "left").select(F.col("_id").alias("doc_id"), F.col("s").alias("fp"), F.coalesce("root", "s").alias("_root"))
        return named.join(named.groupBy("_root").agg(F.min("doc_id").alias("component_id")), "_root").select("doc_id", "fp", "component_id")
    prints = stored(with_fingerprint(docs, n, check is not None, doc_id, text))
    own = prints.columns[1:]
    reps = stored(prints.groupBy(*own).agg(F.min("doc_id").alias("rep")))
    found = links(reps.select(*own), radius, segments_for(reps.count(), radius), check)
    roots = components(found, "a", "b").select(*(F.col(f"node.{c}").alias(c) for c in own), "root")
    named = roots.join(reps, own)
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    linked_reps = named.join(least, "root").select(*own, "least")
    label = reps.join(linked_reps, own, "left").select(*own, F.coalesce("least", "rep").alias("component_id"))
    # stored, so that the join reads both sides anew and Spark can split a fingerprint that many documents share
    return prints.join(stored(label), own).select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, links at two or fewer differing bits, over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"), n=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of the pipeline's stage: a Jaccard similarity of 0.8 or more of the sets of five-word shingles.
STAGE = {"n": 5, "similarity": 0.8}


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates the row of the least doc_id (nulls last, ties by the text's hash), columns unchanged.

    Rows are told apart by doc_id and text together, so rows that share a doc_id, or have none, stay if they are unlike.
    """
    own = ["_id", "_h", "_g"]

    def representatives() -> DataFrame:
        rows, roots = near_sets.groups(docs, **STAGE)
        counted = rows.join(roots, "s", "left").groupBy(F.coalesce("root", "s").alias("_root"), *own).agg(F.count(F.lit(1)).alias("n"))
        first = counted.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), *own, "n")).alias("r"))
        return first.select(*(F.col(f"r.{c}").alias(f"r{c}") for c in own), F.col("r.n").alias("n"))

    found = settled(docs.sparkSession, representatives)
    same = [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in own]
    marked = near_sets.identified(docs)
    kept = marked.join(found.where("n = 1"), same, "left_semi").select(*docs.columns)
    repeats = found.where("n > 1")
    if not repeats.limit(1).count():
        return kept
    return kept.unionByName(marked.join(repeats, same, "left_semi").dropDuplicates(own).select(*docs.columns))


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict = {}
