"""Long SimHash fingerprints of shingle sets, and the pigeonring search for pairs at a wide radius.

A fingerprint has WORDS words of 64 bits; a bit is 1 if it is set in over half of the shingles' hashes. The first word is of
the hashes themselves, the others of the hashes mixed with another constant each. Two sets of the Jaccard similarity t
differ in a share of arccos(2t / (1 + t)) / pi of the bits, 0.15 for 0.8; the radius is this mean and SIGMAS deviations
more. 64 bits don't tell such pairs from chance ones, 256 do.

Buckets: the bits form a ring of segments, and each fingerprint goes to one bucket for each of them, by its value there. The
segments get wider with the count of fingerprints, so that buckets keep their size and there are at most BITS // LEAST of
them. In a bucket, pairs must pass the pigeonring chains: of the WORDS words on the ring there is a start from which every
chain of 1, 2, ... words has at most its proportional share of the radius in differences; the whole ring's chain is the
full Hamming check. A pair within the radius that agrees on no segment meets in no bucket, so what this search
gives is a part; near_sets adds the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 4
BITS = 64 * WORDS
SIGMAS = 4
LEAST = 8  # bits of a segment
CROWD = 6  # buckets have about 2 to this power of fingerprints
PART = 1 << 13  # shingles whose bits are unpacked at once


def mixed(found: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a word of the fingerprint."""
    if not word:
        return found
    x = found + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(found: np.ndarray) -> bytes:
    """Of distinct hashes; no hashes give zeros."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), PART):
        part = found[at : at + PART]
        rows = np.stack([mixed(part, word) for word in range(WORDS)], axis=1).view(np.uint8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(found), bitorder="little").tobytes()


def radius_for(t: Fraction) -> int:
    share = acos(2 * t / (1 + t)) / pi
    return min(BITS, ceil(BITS * share + SIGMAS * sqrt(BITS * share * (1 - share))))


def cuts(count: int) -> list[int]:
    """Bounds of the ring's segments for so many fingerprints."""
    m = BITS // min(48, max(LEAST, count.bit_length() - CROWD))
    return [BITS * k // m for k in range(m + 1)]


def segment_keys(prints: list[bytes], bounds: list[int]) -> np.ndarray:
    """Each fingerprint's number of its bucket for each segment."""
    bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").astype(np.int64)
    return np.stack([(bits[:, a:b] << np.arange(b - a)).sum(axis=1) + (k << 52) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))], axis=1)


def with_keys(sets: DataFrame, count: int) -> DataFrame:
    """(s, size, bits, keys) of sets (s, size, bits): the numbers of the buckets by the fingerprint that bits begins with."""
    bounds = cuts(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = segment_keys([x[: BITS // 8] for x in batch.column(2).to_pylist()], bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["s", "size", "bits", "keys"])

    return sets.select("s", "size", "bits").mapInArrow(run, "s bigint, size bigint, bits binary, keys array<bigint>")


def crowded(keyed: DataFrame, split: int) -> DataFrame:
    """(key, blocks) of the buckets with more than split fingerprints."""
    counted = keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split)
    return counted.select("key", (F.floor((F.col("n") - 1) / split) + 1).alias("blocks"))


def linked(x: np.ndarray, radius: int) -> np.ndarray:
    """Of XORs of fingerprints (rows of WORDS numbers): the places of those that pass the chains and the full Hamming check."""
    differ = np.bitwise_count(x).astype(np.int32)
    at = np.flatnonzero((differ * WORDS <= radius).any(axis=1))  # chains of one word
    differ, share = differ[at], radius * np.arange(1, WORDS + 1)
    ring = np.zeros(len(at), bool)
    for start in range(WORDS):
        ring |= (np.cumsum(np.roll(differ, -start, axis=1), axis=1) * WORDS <= share).all(axis=1)
    return at[ring]
