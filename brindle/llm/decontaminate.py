"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A word is a maximal run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A pattern is a
window of `window` consecutive words of a benchmark item; an item with fewer words, but not none, is one pattern.
The symbols of the search are words, as numbers of the benchmark's vocabulary: the shift table is keyed by the last two
words under the search position and tells how far no pattern can end; a word of no pattern skips all windows over it. A
zero shift leads to the suffix bucket, whose entries are in order of a hash of the pattern's first words, and direct
comparison confirms an occurrence. Patterns of one length have a search of their own, so short items don't shorten the
shifts of the others.

The benchmark is cut on the executors into pieces of at most PIECE words that overlap by a window, so that no item is
too large; the pieces are dealt to passes of about PASS_BYTES, whose compact tables are broadcast. A benchmark of one
pass takes one scan of the documents, a map without shuffle. With more, each pass gives only the hits, by the text's
hash; they are merged and joined to the documents (broadcast if counted at most FEW), so no text is stored.

Nulls and edge cases: a null text has no words; a null item_id is written as the empty string; repeated items count
once; repeated documents give repeated rows; an empty benchmark leaves every document clean; columns of docs called
n_words, n_hit or items are replaced.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import stored, table

WINDOW = 10
PIECE = 10_000  # words
PASS_BYTES = 8 << 20  # of benchmark text, for each scan of the documents
FEW = 250_000  # texts with hits that may be broadcast

#: Bytes to words: letters and digits stay, A-Z become lower case, other ASCII separates; bytes of non-ASCII characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


_ODD_A, _ODD_B = 0x9E3779B1, 0x85EBCA77


def _block_key(a: int, b: int, mask: int) -> int:
    """The place of two words in the tables; with the same arithmetic for numbers and arrays of 64 bits."""
    return ((a * _ODD_A + b * _ODD_B) >> 9) & mask


class Patterns:
    """Tables for patterns of one length m, given as the rows of an array of word numbers and the number of each one's item."""

    def __init__(self, windows: np.ndarray, owner: np.ndarray):
        n, self.m = windows.shape
        self.mask = (1 << max(8, n.bit_length())) - 1
        wide = windows.astype(np.int64)
        b = self.m - 2
        suffix = self._keys(wide, b) if b >= 0 else wide[:, 0] & self.mask
        prefix = (self._keys(wide, 0, (1 << 31) - 1) if b >= 0 else wide[:, 0]).astype(np.int32)
        order = np.lexsort((*windows.T[::-1], prefix, suffix))
        windows, owner, suffix, prefix = windows[order], owner[order], suffix[order], prefix[order]
        first = np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)]
        which = np.cumsum(first) - 1
        pairs = np.unique(np.stack([which, owner], axis=1), axis=0)
        self.words = np.ascontiguousarray(windows[first], np.int32).tobytes()
        self.prefix = array("i", prefix[first].tobytes())
        self.starts = array("i", np.searchsorted(suffix[first], np.arange(self.mask + 2)).astype(np.int32).tobytes())
        self.owners = pairs[:, 1].astype(np.int32)
        self.owned = array("i", np.searchsorted(pairs[:, 0], np.arange(int(first.sum()) + 1)).astype(np.int32).tobytes())
        far = self.m - 1
        shift = np.full(self.mask + 1, min(max(far, 1), 255), np.uint8)
        for end in range(2, self.m + 1):  # smaller shifts come last
            shift[self._keys(wide, end - 2)] = min(self.m - end, 255)
        if self.m == 1:
            shift[suffix] = 0
        self.shift = shift.tobytes()

    def _keys(self, windows: np.ndarray, at: int, mask: int | None = None) -> np.ndarray:
        return _block_key(windows[:, at], windows[:, at + 1], self.mask if mask is None else mask)

    def search(self, words: array, hit: bytearray, found: set[int]) -> None:
        """Marks the words of every occurrence in hit and adds the numbers of the owners to found. words: -1 for those of no pattern."""
        m, mask, shift, starts, prefix = self.m, self.mask, self.shift, self.starts, self.prefix
        text, patterns, size, n, at = words.tobytes(), self.words, 4 * self.m, len(words), self.m
        while at <= n:
            b = words[at - 1]
            if b < 0:
                at += m
                continue
            if m > 1:
                a = words[at - 2]
                if a < 0:
                    at += m - 1
                    continue
                key = _block_key(a, b, mask)
            else:
                key = b & mask
            step = shift[key]
            if step:
                at += step
                continue
            start = at - m
            head = words[start]
            if head >= 0 and (m == 1 or words[start + 1] >= 0):
                want = _block_key(head, words[start + 1], (1 << 31) - 1) if m > 1 else head
                lo = bisect_left(prefix, want, starts[key], starts[key + 1])
                hi = bisect_right(prefix, want, lo, starts[key + 1])
                own = text[4 * start : 4 * at]
                for k in range(lo, hi):
                    if patterns[k * size : (k + 1) * size] == own:
                        hit[start:at] = b"\x01" * m
                        found.update(self.owners[self.owned[k] : self.owned[k + 1]].tolist())
                        break  # patterns are distinct
            at += 1


class WuManber:
    """A search for patterns (name, words): a vocabulary, and tables for each length."""

    def __init__(self, patterns: Iterable[tuple[str, Iterable[bytes]]], window: int | None = None):
        """window: a pattern of more words stands for all its windows."""
        self.vocabulary: dict[bytes, int] = {}
        numbers: dict[str, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for name, words in patterns:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
            if not len(ids):
                continue
            m = min(len(ids), window or len(ids))
            own = np.lib.stride_tricks.sliding_window_view(ids, m)
            rows.setdefault(m, []).append(own)
            owners.setdefault(m, []).append(np.full(len(own), numbers.setdefault(name, len(numbers)), np.int32))
        self.names = list(numbers)
        self.tables = [Patterns(np.concatenate(rows[m]), np.concatenate(owners[m])) for m in sorted(rows)]

    def search(self, words: list[bytes], hit: bytearray, found: set[str]) -> None:
        """Marks the words of every occurrence in hit and adds the names of the owners to found."""
        get = self.vocabulary.get
        numbers, ids = set(), array("i", [get(w, -1) for w in words])
        for table in self.tables:
            table.search(ids, hit, numbers)
        found.update(self.names[k] for k in numbers)


def pieces(window: int):
    """Of batches (item, text): (item, number, size, words), words joined by spaces; pieces of an item overlap so that each window is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, bytes]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for k, at in enumerate(range(0, max(1, len(words) - window + 1) if words else 0, PIECE)):
                    part = b" ".join(words[at : at + PIECE + window - 1])
                    out.append(("" if item is None else item, k, len(part), part))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["item", "number", "size", "words"])

    return run


def _runs(hit: bytearray) -> list[int]:
    """Starts and stops, in turn, of what is marked."""
    out, at = [], hit.find(1)
    while at >= 0:
        stop = hit.find(0, at)
        stop = len(hit) if stop < 0 else stop
        out += [at, stop]
        at = hit.find(1, stop)
    return out


_NEW = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType())}
_HASH = "struct<a:bigint,b:bigint>"


def _mark(text: str | None) -> dict[str, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass")), "<i8")
    return {"a": int(both[0]), "b": int(both[1])}


def _replaced(batch: pa.RecordBatch, out: list[tuple], drop: tuple[str, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()))
    rest = [c for c in batch.schema.names if c not in (*drop, *_NEW)]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in rest), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], [*rest, *_NEW])


def _scan(tables, text: str, drop: tuple[str, ...]):
    """Of batches of documents: n_words, n_hit and items, by the only pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = tables.value
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.names.index(text)):
                words = words_of(x.as_py())
                hit, found = bytearray(len(words)), set()
                searcher.search(words, hit, found)
                out.append((len(words), hit.count(1), sorted(found)))
            yield _replaced(batch, out, drop)

    return run


def _find(tables):
    """Of batches (text): (hash, runs, items) of the texts with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = tables.value
        for batch in batches:
            out = []
            for x in batch.column(0):
                words = words_of(x.as_py())
                hit, found = bytearray(len(words)), set()
                searcher.search(words, hit, found)
                if found:
                    out.append((_mark(x.as_py()), _runs(hit), sorted(found)))
            kinds = (pa.struct([("a", pa.int64()), ("b", pa.int64())]), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["hash", "runs", "items"])

    return run


def _merge(text: str, drop: tuple[str, ...]):
    """Of batches of documents with _runs and _items of all passes: n_words, n_hit and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names = [], batch.schema.names
            for x, runs, items in zip(*(batch.column(names.index(c)) for c in (text, "_runs", "_items")), strict=True):
                n = len(words_of(x.as_py()))
                hit, at = bytearray(n), runs.as_py() or []
                for start, stop in zip(at[::2], at[1::2], strict=True):
                    hit[start:stop] = b"\x01" * (stop - start)
                out.append((n, hit.count(1), sorted(items.as_py() or [])))
            yield _replaced(batch, out, drop)

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", keep_text: bool = False
) -> DataFrame:
    """Every row of docs, its text column replaced by n_words, n_hit and items (ids, as sorted strings). With keep_text the text stays."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("words"))
    cut_up = stored(bench.where(F.col("words").isNotNull()).mapInArrow(pieces(window), "item string, number bigint, size bigint, words binary").dropDuplicates(["item", "words"]))
    passes = max(1, math.ceil((cut_up.agg(F.sum("size")).first()[0] or 0) / PASS_BYTES))

    def tables(k: int):
        # pieces are small, so a pass holds about its share of the benchmark's bytes, and what is collected is bounded
        part = cut_up if passes == 1 else cut_up.where(F.pmod(F.xxhash64("item", "number", "words"), F.lit(passes)) == k)
        return spark.sparkContext.broadcast(WuManber(((r["item"], bytes(r["words"]).split()) for r in part.select("item", "words").toLocalIterator()), window))

    docs = docs.drop(*(c for c in _NEW if c != text))
    drop = () if keep_text else (text,)
    schema = T.StructType([f for f in docs.schema if f.name not in (*drop, *_NEW)] + [T.StructField(c, kind) for c, kind in _NEW.items()])
    if passes == 1:
        return docs.mapInArrow(_scan(tables(0), text, drop), schema)
    found = []
    for k in range(passes):
        own = docs.select(text).mapInArrow(_find(tables(k)), f"hash {_HASH}, runs array<int>, items array<string>")
        found.append(stored(own.groupBy("hash").agg(F.first("runs").alias("runs"), F.first("items").alias("items"))))
    every = reduce(DataFrame.unionByName, found).groupBy("hash").agg(F.flatten(F.collect_list("runs")).alias("_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))
    merged = stored(every.withColumnRenamed("hash", "_hit_hash"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_mark(x.as_py()) for x in batch.column(batch.schema.names.index(text))]
            yield batch.append_column("_hash", pa.array(marks, pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    left = docs.drop("_hash", "_hit_hash", "_runs", "_items")
    left = left.mapInArrow(marked, T.StructType([*left.schema.fields, *T.StructType.fromDDL(f"_hash {_HASH}").fields]))
    right = F.broadcast(merged) if merged.count() <= FEW else merged
    met = left.join(right, F.col("_hash") == F.col("_hit_hash"), "left").drop("_hash", "_hit_hash")
    return met.mapInArrow(_merge(text, (*drop, "_runs", "_items")), schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words inside an occurrence of a benchmark window, items that occur, and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, columns unchanged."""
    return contamination(docs, benchmark, keep_text=True).where("n_hit = 0").select(*docs.columns)


QUERIES = {"op7_decontaminate": op7_decontaminate}

ORACLE_SQL = {
    "op7_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bp AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS pat
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), occ AS (
  SELECT d.doc_id, d.i, b.k, b.item
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM bp) WHERE len(w) >= k)) d
  JOIN bp b ON b.k = d.k AND b.pat = d.s
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
