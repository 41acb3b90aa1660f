"""Groups of documents whose sets of n-word shingles have a Jaccard similarity of a threshold or more, without loss.

Words and shingles are those of simhash; sets hold 64-bit hashes, and a set is known by the 64-bit hash of its sorted
hashes, so documents of one set count once.

1. SimHash. The sets' long fingerprints meet by the pigeonring search of rings.py: buckets by ring segments, chains, full
   Hamming check. What passes is decided by its whole sets, made anew from its texts.
2. The rest. No radius has all pairs of a similarity, and two fingerprints within it may agree on no segment. So all sets
   are also put in one order of shingles. Two sets of the threshold t have a shingle in common among the first
   |x| - ceil(t |x|) + 1 of each (prefix filtering), so each set goes to the buckets of these, where those meet that the
   first search left in different groups. Any fixed order is right; rare shingles first keep buckets small, so shingles
   that a sample of documents often has come last, by their count there, the others by hash.
   A sample misses passages that a few documents in a thousand share, so each row of a bucket also bounds what its set can
   have in common with any other, by the counted shingles that sets of other groups have too (bounded).

Pairs of either kind of bucket are candidates only if their sizes allow the threshold, and the parities of their shingles
over BITMAP bits (beside fingerprints RING_BITMAP) differ in no more bits than the sets may (a lower bound of their
symmetric difference). Distinct pairs then meet the same bound over as many bits as the sets have shingles, as it says
nothing of sets that are large for their bits. What passes is decided by its whole sets. Large groups don't need all
pairs: in the first search STARS rounds compare each set with one of its bucket, then all pairs of a bucket follow that
aren't connected yet, of which those of its largest component meet only the others. Nothing is capped or left out.

A bucket of more than SPLIT sets is dealt out: in a star round to blocks that follow from the round, so that sets of
two blocks meet in another; for all pairs to each two of its blocks. A task holds two blocks at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import rings
from brindle.llm.common import release, stored
from brindle.llm.components import components

SEED = 42
BITMAP, RING_BITMAP, WIDE = 512, 256, 1 << 15
FEW = 250_000  # sets whose texts are looked up by broadcast
STARS = 2
SAMPLE, SAMPLE_SHARE = 20_000, 1 / 64  # documents whose shingles are counted for the order: the greater of both
OFTEN, LISTED = 3, 250_000  # counts in the sample from which a shingle comes late, and how many do at most
CROSS = 1 << 20  # pairs of a bucket that are compared at once
SPLIT = 8192  # sets of a bucket, about, that a task holds
SMALL = 16  # buckets up to this size compare all their sets at once


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(n, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(whole[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(last)))


def name_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def least(n: int, t: Fraction) -> int:
    """How many of n shingles a set must share at least to reach t."""
    return -(-n * t.numerator // t.denominator)


def prefix(found: np.ndarray, t: Fraction, late: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingles by which a set is found: the first ones in the order. late: sorted shingles that come last, by count."""
    k = len(found) - least(len(found), t) + 1 if len(found) else 0
    if not len(late):
        return found[:k]
    at = np.minimum(np.searchsorted(late, found), len(late) - 1)
    hit = late[at] == found
    early = found[~hit][:k]
    if len(early) == k:
        return early
    rest, often = found[hit], count[at[hit]]
    return np.concatenate([early, rest[np.lexsort((rest, often))][: k - len(early)]])


def parities(found: np.ndarray, bits: int = BITMAP) -> bytes:
    return np.packbits(np.bincount((found >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def wide(found: np.ndarray) -> bytes:
    """Parities over a power of two of bits, at least the count of shingles up to WIDE."""
    return parities(found, max(64, min(WIDE, 1 << max(len(found) - 1, 0).bit_length())))


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference, by wide parities; the longer ones are folded."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum(dtype=np.int64))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _id, _h, _g: rows that agree in them have one doc_id and one text."""
    return docs.select("*", F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_h"), F.xxhash64(F.lit(SEED), F.col(text), F.col(text).isNull()).alias("_g"))


def order_of(docs: DataFrame, n: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come late, sorted, and their counts in a sample of docs."""
    total = docs.count()
    share = min(1.0, max(SAMPLE / max(total, 1), SAMPLE_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), n) for x in batch.column(0)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["x"])

    # by the text's hash, so that exact copies are drawn as one
    drawn = docs.where((F.xxhash64(F.col(text)) % 1_000_000 + 1_000_000) % 1_000_000 < int(share * 1_000_000)).select(text)
    counts = drawn.mapInArrow(run, "x bigint").groupBy("x").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "x").limit(LISTED).toArrow()
    late, count = rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy()
    by = np.argsort(late)
    return late[by], count[by]


def compared(s: np.ndarray, size: np.ndarray, root: np.ndarray, side: np.ndarray, rest: np.ndarray, left: np.ndarray, before: np.ndarray, bits: np.ndarray, t: Fraction, seed: int | None, radius: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b) of one bucket: pairs of different roots that may reach t; of two sides only those across.

    With a radius, bits are a fingerprint and parities, else parities. rest, left, before: see bounded.
    """
    p, q = t.numerator, t.denominator
    prints, parity = np.split(bits, [0 if radius is None else rings.WORDS], axis=1)

    def across(these: np.ndarray, those: np.ndarray, once: bool = False) -> Iterator[pa.RecordBatch]:
        step = max(1, CROSS // max(1, len(those) * bits.shape[1]))
        for h in range(0, len(these), step):
            x, y = these[h : h + step, None], those[None, :]
            # an intersection of at least (|x| + |y|) t / (1 + t)
            both = np.maximum(np.minimum(rest[x], left[y]), np.minimum(rest[y], left[x]))
            ok = (root[x] != root[y]) & (before[x] != before[y]) & (both * (q + p) >= (size[x] + size[y]) * p)
            if once:
                ok &= s[x] < s[y]
            i, j = np.nonzero(ok)
            i, j = these[h : h + step][i], those[j]
            if radius is not None:
                passed = rings.linked(prints[i] ^ prints[j], radius)
                i, j = i[passed], j[passed]
            # symmetric difference of at most (|x| + |y|) (1 - t) / (1 + t)
            near = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64) * (q + p) <= (size[i] + size[j]) * (q - p)
            i, j = s[i[near]], s[j[near]]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    if seed is not None:
        rank = s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed * 0x5851F42D4C957F2D)
        yield from across(np.array([int(rank.argmin())]), np.arange(len(s)))
        return
    if len(s) <= SMALL and (side == side[0]).all():
        yield from across(np.arange(len(s)), np.arange(len(s)), once=True)
        return
    names, count = np.unique(root, return_counts=True)
    main = root == names[count.argmax()]  # the largest component's sets needn't meet one another
    if (side == side[0]).all():
        yield from across(np.flatnonzero(~main), np.flatnonzero(~main), once=True)
        yield from across(np.flatnonzero(~main), np.flatnonzero(main))
    else:
        first = side == side.min()
        yield from across(np.flatnonzero(first & ~main), np.flatnonzero(~first))
        yield from across(np.flatnonzero(first & main), np.flatnonzero(~first & ~main))


def candidates(buckets: DataFrame, hot: DataFrame | None, t: Fraction, seed: int | None, radius: int | None = None) -> DataFrame:
    """(a, b), distinct with a < b, of buckets (key, s, size, bits, root): pairs of different roots that may reach t.

    Buckets may have rest, left and before (bounded); else the sizes bound intersections.
    hot: (key, blocks) of the buckets that are dealt out. seed: pairs of every set with one of its bucket or block, which
    follows from the seed; None: all pairs. radius: of the fingerprints that bits begin with, if they do.
    """
    bounds = [c for c in ("rest", "left", "before") if c in buckets.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, part = rows.column("key").to_numpy(), rows.column("part").to_numpy()
            columns = [rows.column(c).to_numpy().astype(np.int64) for c in ("s", "size", "root", "side")]
            columns += [rows.column(c).to_numpy().astype(np.int64) for c in bounds] or [columns[1], columns[1], columns[0]]
            columns.append(np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(key), -1))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[starts[1:], len(key)]
            several = np.minimum.reduceat(columns[2], starts) != np.maximum.reduceat(columns[2], starts)
            for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                yield from compared(*(c[a:b] for c in columns), t, seed, radius)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if (key[-1], part[-1]) != (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()):  # all but the last bucket is complete
                rows = pa.Table.from_batches(held)
                last = (rows.column("key").to_numpy() == key[-1]) & (rows.column("part").to_numpy() == part[-1])
                cut_at = int(np.flatnonzero(last)[0])
                if cut_at:
                    yield from pairs(rows.slice(0, cut_at))
                held = rows.slice(cut_at).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    whole = F.lit(0).cast("long")
    if hot is None:
        placed = buckets.withColumn("part", whole).withColumn("side", whole)
    else:
        named = buckets.join(hot, "key", "left").withColumn("side", F.coalesce(F.pmod(F.xxhash64(F.lit(seed or 0), "s"), "blocks"), whole))
        if seed is None:
            meets = F.transform(F.sequence(whole, F.col("blocks") - 1), lambda k: F.least(k, "side") * F.col("blocks") + F.greatest(k, "side"))
            placed = named.withColumn("part", F.explode(F.when(F.col("blocks").isNotNull(), meets).otherwise(F.array(whole))))
        else:
            placed = named.withColumn("part", F.col("side"))
    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.select("key", "part", "s", "size", "root", "side", *bounds, "bits").repartition(n, "key", "part").sortWithinPartitions("key", "part", "s")
    return sorted_rows.mapInArrow(run, "a bigint, b bigint").distinct()


def met(pairs: DataFrame, sides: DataFrame, value: str) -> DataFrame:
    """(a, b, x, y): pairs with the value of both ends. sides: one row per s."""
    left, right = (sides.select(F.col("s").alias(end), F.col(value).alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, n: int, t: Fraction, text: str) -> DataFrame:
    """Those of pairs (a, b) whose whole sets reach t. rows: _id, _h, _g, s, size, wide of docs."""
    p, q = t.numerator, t.denominator

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                d = apart(np.frombuffer(x["wide"], np.uint8), np.frombuffer(y["wide"], np.uint8))
                keep.append(d * (q + p) <= (x["size"] + y["size"]) * (q - p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), n) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["s", "set"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * q >= (len(x) + len(y) - both) * p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def ends_of(pairs: DataFrame) -> DataFrame:
        return stored(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct())

    bits = rows.join(ends_of(pairs), "s", "left_semi").groupBy("s").agg(F.first(F.struct("size", "wide")).alias("bits"))
    pairs = stored(met(pairs, stored(bits), "bits").mapInArrow(possible, "a bigint, b bigint"))
    counted = rows.join(ends_of(pairs), "s", "left_semi").groupBy("s", "_id", "_h", "_g").agg(F.count(F.lit(1)).alias("n"))
    least_row = counted.groupBy("s").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_h", "_g", "n")).alias("r"))
    # stored, so that its size is known before the texts would be shuffled
    one = stored(least_row.select("s", *(F.col(f"r.{c}").alias(f"r{c}") for c in ("_id", "_h", "_g")), F.col("r.n").alias("n")))
    texts = identified(docs, text=text).select("_id", "_h", "_g", F.col(text).alias("_text"))
    same = [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in ("_id", "_h", "_g")]
    known = texts.join(F.broadcast(one) if one.count() <= FEW else one, same).select("s", "_text").mapInArrow(sets, "s bigint, set binary")
    if one.where("n > 1").limit(1).count():  # rows that repeat
        known = known.dropDuplicates(["s"])
    return stored(met(pairs, stored(known), "set").mapInArrow(decide, "a bigint, b bigint"))


class Rounds:
    """Links found so far, and the components that they make."""

    def __init__(self, rows: DataFrame, docs: DataFrame, n: int, t: Fraction, text: str):
        self.rows, self.docs, self.n, self.t, self.text = rows, docs, n, t, text
        self.links, self.roots = None, None

    def rooted(self, sets: DataFrame) -> DataFrame:
        """sets with the roots of their components so far."""
        if self.roots is None:
            return sets.withColumn("root", F.col("s"))
        return sets.join(self.roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))

    def add(self, sets: DataFrame, hot: DataFrame, seed: int | None, radius: int | None) -> None:
        """Adds the links within buckets between sets (s, size, bits, and key or keys of buckets) that aren't connected."""
        marked = sets if "root" in sets.columns else self.rooted(sets)
        if "keys" in marked.columns:
            marked = marked.withColumn("key", F.explode("keys"))
        pairs = stored(candidates(marked, hot if hot.limit(1).count() else None, self.t, seed, radius))
        new = confirmed(pairs, self.rows, self.docs, self.n, self.t, self.text)
        release(self.rows.sparkSession)
        self.links = new if self.links is None else self.links.unionByName(new)
        self.roots = stored(components(self.links, "a", "b"))


def groups(docs: DataFrame, n: int, similarity: float, text: str = "text", split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (_id, _h, _g, s), and (s, root) of every set that has a near one; doc_id is the column of this name."""
    t = Fraction(str(similarity))
    spark = docs.sparkSession
    listed = spark.sparkContext.broadcast(order_of(docs, n, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, count = listed.value
        for batch in batches:
            found = [shingles(x.as_py(), n) for x in batch.column(3)]
            new = [
                pa.array([name_of(x) for x in found], pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([rings.fingerprint(x) + parities(x, RING_BITMAP) for x in found], pa.binary()),
                pa.array([parities(x) for x in found], pa.binary()),
                pa.array([wide(x) for x in found], pa.binary()),
                pa.array([prefix(x, t, late, count).view(np.int64) for x in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], ["_id", "_h", "_g", "s", "size", "ring", "bits", "wide", "keys"])

    own = identified(docs, text=text).select("_id", "_h", "_g", text)
    kind = dict(own.dtypes)["_id"]
    rows = stored(own.mapInArrow(run, f"_id {kind}, _h bigint, _g bigint, s bigint, size bigint, ring binary, bits binary, wide binary, keys array<bigint>"))
    rounds = Rounds(rows, docs, n, t, text)

    ringed = stored(rows.select("s", "size", F.col("ring").alias("bits")).dropDuplicates(["s"]))
    keyed = rings.with_keys(ringed, ringed.count())
    hot = stored(rings.crowded(keyed, split))
    for seed in [*range(1, STARS + 1), None]:
        rounds.add(keyed, hot, seed, rings.radius_for(t))

    sets = rows.select("s", "size", "keys").dropDuplicates(["s"])
    shared = bounded(rounds.rooted(_shared(sets.select(F.posexplode("keys").alias("at", "key"), "s", "size"))), t)
    bits = rows.select("s", "bits").dropDuplicates(["s"])
    buckets = stored(shared.join(bits.join(shared.select("s").distinct(), "s", "left_semi"), "s"))
    hot = stored(buckets.where(F.col("place") >= split).groupBy("key").agg((F.floor(F.max("place") / split) + 1).alias("blocks")))
    release(spark)
    rounds.add(buckets.drop("place"), hot, None, None)
    return rows.select("_id", "_h", "_g", "s"), rounds.roots.withColumnRenamed("node", "s")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (key, s, size, at) whose key another row has too, with their place among those of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row seen, its place, and whether another has its key: it waits for its successor
        names = ["key", "s", "size", "at", "place"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if before is not None:
                rows = np.concatenate([before[0], rows])
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.r_[before is not None and before[2], same] | np.r_[same, False]
            run_of = np.cumsum(np.r_[0, ~same])
            starts = np.flatnonzero(np.r_[True, ~same])
            place = np.arange(len(rows)) - starts[run_of] + np.where(run_of == 0, before[1] if before is not None else 0, 0)
            before = rows[-1:], int(place[-1]), bool(keep[-1])
            rows, place = rows[:-1][keep[:-1]], place[:-1][keep[:-1]]
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(4)), pa.array(place)], names)
        if before is not None and before[2]:
            yield pa.RecordBatch.from_arrays([*(pa.array(before[0][:, k]) for k in range(4)), pa.array([before[1]])], names)

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.select("key", "s", "size", F.col("at").cast("long")).repartition(n, "key").sortWithinPartitions("key")
    return stored(rows.mapInArrow(run, "key bigint, s bigint, size bigint, at bigint, place bigint"))


def bounded(rooted: DataFrame, t: Fraction) -> DataFrame:
    """The rows of rooted (key, s, size, at, place, root) whose key sets of another root have too, with rest, left, before.

    at is the key's place in the set's order. Let it be the first shingle that two sets of different roots have in common.
    Then all they have in common is among the left ones from there on, of each of them. Up to the end of the prefix that
    ends first, it is in both prefixes, so of that prefix only shingles in such rows count: rest is these from there on and
    the set's shingles behind its prefix. So the intersection is at most the one's rest and the other's left, for either
    one. Pairs that share earlier shingles meet in the bucket of the first one, and need not pass in others: they don't
    where before, the key of the set's row before (its first row has s), is the same too, as that bucket had them.
    """
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rows = rooted.join(several, "key", "left_semi")
    order = Window.partitionBy("s").orderBy("at")
    later = F.count(F.lit(1)).over(Window.partitionBy("s")) - F.row_number().over(order) + 1
    behind = F.floor((F.col("size") * t.numerator + (t.denominator - 1)) / t.denominator) - 1
    before = F.coalesce(F.lag("key").over(order), "s")
    return stored(rows.select("key", "s", "size", "place", "root", (later + behind).alias("rest"), (F.col("size") - F.col("at")).alias("left"), before.alias("before")))
