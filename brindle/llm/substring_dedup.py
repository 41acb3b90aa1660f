"""Repeated passages of words, found at difference-cover anchors.

A window is `WINDOW` consecutive words of one document; a word goes if a window over it also starts in a document with a
smaller id. With a difference cover D of the period v, any two positions have a shift below v that brings both onto
cover positions (modulo v). So sequences of WINDOW - v + 1 words are hashed at cover positions only, and any two equal
windows share an aligned anchor. An anchor that occurs in two documents extends to all windows that contain it; these
are compared by 128 bits of hash over all their words, and all but those of the smallest id are repeats.

Hashes travel in packed blobs by bucket, and so do the answers, by a bucket of their documents. Each task first sorts
what it has: of a hash that it sees in several documents, one record stands for all, so a passage that a third of the
documents share costs a record per flush of a task, not one per document. Buckets and partitions grow in number with the
text, not in size. The texts move twice, to meet the answers about them; nothing about all documents reaches the driver.

Nulls and edge cases: a null or empty text has no words (kept_sha256 of the empty string); a row with null doc_id loses
nothing and takes nothing from others; rows that repeat a doc_id are judged each by its own text against other ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import dealt, release, settled, stored, table, text_bytes

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)  # every difference modulo 7 is one of two cover positions
SPAN = WINDOW - PERIOD + 1  # words under an anchor
FLUSH = 1 << 19  # records that a task sorts at once
BUCKET_BYTES = 8 << 20  # of text, for each bucket
PARTITION_BYTES = 64 << 20  # of text, for each partition of an exchange, which takes several buckets

_ODD_A, _ODD_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

ID = np.dtype([("doc", "<i8"), ("text", "<u8")])
RECORD = np.dtype([("hash", "<u8"), ("more", "<u8"), ("at", "<i4"), ("many", "?")])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """A hash of every n consecutive values."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out *= odd
        out += h[k : k + len(out)]
    out ^= out >> np.uint64(29)
    out *= odd
    out ^= out >> np.uint64(32)
    return out


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a document's anchors."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(h) - SPAN + 1)
    at = at[np.isin(at % PERIOD, COVER)]
    return rolled(h, SPAN, _ODD_A)[at], at


def windows(h: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes and the positions of the windows that contain an anchor at one of hits."""
    n = len(h) - WINDOW + 1
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.maximum(hits - (PERIOD - 1), 0), 1)
    np.add.at(mark, np.minimum(hits + 1, n), -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    a = rolled(h, WINDOW, _ODD_A)[at]
    b = rolled(h * _ODD_B ^ (h >> np.uint64(31)), WINDOW, _ODD_B)[at]
    return a, b, at


class Sender:
    """Collects (id, hashes, positions) of a task and packs them into blobs by bucket; answers what it can itself."""

    def __init__(self, buckets: int, homes: int, wide: bool):
        self.buckets, self.homes, self.wide, self.parts, self.n = buckets, homes, wide, [], 0

    def add(self, doc: int, text: int, a: np.ndarray, b: np.ndarray | None, at: np.ndarray) -> bool:
        if len(a):
            self.parts.append((doc, text, a, b, at))
            self.n += len(a)
        return self.n >= FLUSH

    def flush(self) -> pa.RecordBatch:
        """Rows (bucket, payload) to send; what is answered here has the bucket -1 - home."""
        ids = np.array([(d, t) for d, t, *_ in self.parts], ID)
        counts = [len(p[2]) for p in self.parts]
        owner = np.repeat(np.arange(len(ids)), counts)
        rec = np.zeros(self.n, RECORD)
        rec["hash"] = np.concatenate([p[2] for p in self.parts])
        rec["at"] = np.concatenate([p[4] for p in self.parts])
        if self.wide:
            rec["more"] = np.concatenate([p[3] for p in self.parts])
        self.parts, self.n = [], 0
        doc = ids["doc"][owner]
        order = np.lexsort((doc, rec["more"], rec["hash"])) if self.wide else np.lexsort((doc, rec["hash"]))
        rec, owner, doc = rec[order], owner[order], doc[order]
        first = _first(rec)
        run = np.cumsum(first) - 1
        least, most = doc[first], np.maximum.reduceat(doc, np.flatnonzero(first))
        if self.wide:  # windows: all but the least id are repeats; the least id's are sent
            told, sent = doc != least[run], doc == least[run]
        else:  # anchors: of those in several documents all are answered, and one is sent for them
            several = (least != most)[run]
            told, sent = several, ~several | first
            rec["many"] = several
        answers = [(-1 - home, x) for home, x in _answers(ids, owner[told], rec["at"][told], self.homes)]
        return _rows(answers + _blobs(ids, owner[sent], rec[sent], self.buckets, self.wide))


def _first(rec: np.ndarray) -> np.ndarray:
    """Of sorted records: whether the hash differs from the one before."""
    return np.r_[True, (rec["hash"][1:] != rec["hash"][:-1]) | (rec["more"][1:] != rec["more"][:-1])]


def _blobs(ids: np.ndarray, owner: np.ndarray, rec: np.ndarray, buckets: int, wide: bool) -> list[tuple[int, bytes]]:
    to = (rec["hash"] >> np.uint64(17)) % np.uint64(buckets)
    order = np.lexsort((rec["at"], owner, to))
    to, owner, rec = to[order], owner[order], rec[order]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, int)
    out = []
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = owner[s:e]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        head = np.array([e - s, len(new)], "<u4").tobytes()
        lengths = np.diff(np.r_[new, e - s]).astype("<u4")
        r = rec[s:e]
        body = [head, ids[own[new]].tobytes(), lengths.tobytes(), r["at"].astype("<i4").tobytes(), np.packbits(r["many"]).tobytes(), r["hash"].tobytes()]
        out.append((int(to[s]), b"".join(body + [r["more"].tobytes()] * wide)))
    return out


def _unpacked(blob: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    n, k = np.frombuffer(blob, "<u4", 2)
    n, k, at = int(n), int(k), 8
    ids = np.frombuffer(blob, ID, k, at)
    at += 16 * k
    lengths = np.frombuffer(blob, "<u4", k, at)
    at += 4 * k
    rec = np.zeros(n, RECORD)
    rec["at"] = np.frombuffer(blob, "<i4", n, at)
    at += 4 * n
    rec["many"] = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n)
    at += (n + 7) // 8
    rec["hash"] = np.frombuffer(blob, "<u8", n, at)
    if wide:
        rec["more"] = np.frombuffer(blob, "<u8", n, at + 8 * n)
    return np.repeat(ids, lengths), rec


def _rows(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["bucket", "payload"])


def _answers(ids: np.ndarray, owner: np.ndarray, at: np.ndarray, homes: int) -> list[tuple[int, bytes]]:
    """Positions by document, packed by the home of the document."""
    order = np.argsort(owner, kind="stable")
    owner, at = owner[order], at[order]
    new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    rows, lengths = ids[owner[new]], np.diff(np.r_[new, len(at)])
    home = (rows["text"] >> np.uint64(7)) % np.uint64(homes)
    out = []
    for h in np.unique(home).tolist():
        own = np.flatnonzero(home == h)
        places = np.concatenate([at[new[i] : new[i] + lengths[i]] for i in own.tolist()])
        head = np.array([len(places), len(own)], "<u4").tobytes()
        out.append((h, b"".join([head, rows[own].tobytes(), lengths[own].astype("<u4").tobytes(), places.astype("<i4").tobytes()])))
    return out


SENT = "bucket int, payload binary"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Of rows (bucket, payload) sorted by bucket: each bucket's blobs; a negative bucket's one by one."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket < 0:
                yield bucket, [blob.as_py()]
                continue
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(blob.as_py())
    if held:
        yield now, held


def _answer(wide: bool, homes: int):
    """Of hashes by bucket: the repeats, by their document's home."""

    def decided(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [_unpacked(b, wide) for b in blobs]
        ids, rec = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        doc = ids["doc"]
        order = np.lexsort((doc, rec["more"], rec["hash"])) if wide else np.lexsort((doc, rec["hash"]))
        ids, rec, doc = ids[order], rec[order], doc[order]
        first = _first(rec)
        run, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        least = doc[starts]
        if wide:
            told = doc != least[run]
        else:
            several = (least != np.maximum.reduceat(doc, starts)) | np.logical_or.reduceat(rec["many"], starts)
            told = several[run] & ~rec["many"]
        rows, owner = np.unique(ids[told], return_inverse=True)
        return _rows(_answers(rows, owner, rec["at"][told], homes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            yield _rows([(-1 - bucket, blobs[0])]) if bucket < 0 else decided(blobs)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of answers by home: one row per document."""
    for _, blobs in _by_bucket(batches):
        ids, lengths, places = [], [], []
        for blob in blobs:
            n, k = map(int, np.frombuffer(blob, "<u4", 2))
            ids.append(np.frombuffer(blob, ID, k, 8))
            lengths.append(np.frombuffer(blob, "<u4", k, 8 + 16 * k))
            places.append(np.frombuffer(blob, "<i4", n, 8 + 20 * k))
        rows, owner = np.unique(np.repeat(np.concatenate(ids), np.concatenate(lengths)), return_inverse=True)
        order = np.argsort(owner, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(rows)))]
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(places)[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc"]), pa.array(rows["text"].astype(np.int64)), lists], ["doc_id", "text_hash", "at"])


def _exchanged(sent: DataFrame, wide: bool, n: int, homes: int) -> DataFrame:
    """(doc_id, text_hash, at) per document: all answers, from the tasks themselves and from the buckets."""
    answers = dealt(sent, n).sortWithinPartitions("bucket").mapInArrow(_answer(wide, homes), SENT)
    return dealt(answers, n).sortWithinPartitions("bucket").mapInArrow(_gather, "doc_id bigint, text_hash bigint, at array<int>")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at) of documents with repeated windows, at their first words. docs: doc_id bigint, text."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES + 1)
    buckets = max(n, size // BUCKET_BYTES + 1)  # and as many homes of documents

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, buckets, False)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found, at = anchors(word_hashes(words_of(text)))
                if sender.add(doc, text_hash(text), found, None, at):
                    yield sender.flush()
        if sender.n:
            yield sender.flush()

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, buckets, True)
        for batch in batches:
            for doc, text, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                a, b, at = windows(word_hashes(words_of(text)), hits.values.to_numpy(zero_copy_only=False).astype(np.int64))
                if sender.add(doc, text_hash(text), a, b, at):
                    yield sender.flush()
        if sender.n:
            yield sender.flush()

    named = docs.where("doc_id is not null and text is not null")
    hits = stored(_exchanged(named.mapInArrow(send_anchors, SENT), False, n, buckets))
    release(spark)
    met = _met(named, hits, "inner").select("doc_id", "text", "at")
    return _exchanged(met.mapInArrow(send_windows, SENT), True, n, buckets)


def _met(docs: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    """docs with their answers; the texts aren't sorted, as the answers are the hashed side. A text's hash tells apart rows that repeat an id."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [text_hash(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(at, np.uint64).view(np.int64))], [*batch.schema.names, "_hash"])

    right = answers.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), "at").hint("shuffle_hash")
    left = docs.select("doc_id", "text").mapInArrow(hashed, "doc_id bigint, text string, _hash bigint")
    return left.join(right, (left.doc_id == right._doc) & (left._hash == right._text), how)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, at in zip(batch.column(1), batch.column(2), strict=True):
            words = words_of(text.as_py())
            n = len(words)
            if at.is_valid:
                mark = np.zeros(n + 1, np.int32)
                starts = at.values.to_numpy(zero_copy_only=False)
                np.add.at(mark, starts, 1)
                np.add.at(mark, starts + WINDOW, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]
            kept = b" ".join(words)
            out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        names = ["n_words", "n_removed", "kept_sha256", "kept"]
        arrays = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of docs (doc_id bigint, text)."""
    docs = docs.select("doc_id", "text")
    removed = settled(docs.sparkSession, lambda: repeats(docs))
    release(docs.sparkSession)
    return _met(docs, removed, "left").select("doc_id", "text", "at").mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows over all documents."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}

ORACLE_SQL = {
    "op8_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), m AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (s) WHERE doc_id > first_doc),
k AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
}
