"""Removal of repeated byte strings, by a suffix array over anchored suffixes with deep-shallow sorting.

A window is WINDOW consecutive bytes of one document; every byte under a window that also starts elsewhere goes.

1. Anchors. Of each window, the GRAM with the least hash (leftmost of equals) is its anchor, so equal windows have the
   same anchor at the same offset, and a document has an anchor about every 180 bytes. An anchor's windows are dealt into
   PARTS ranges of offsets; the bytes that all windows of a range have in common (gram and neighbourhood) are its key,
   the bytes that any of them covers its context. Ranges meet by the hash of their key, so a gram that occurs in very
   many surroundings is split by these; equal contexts are repeats of one another. Each task first sorts what it has, and
   one record stands for all equal contexts that it has seen, so exact copies and passages shared by many documents cost
   a record per flush of a task.
2. Suffixes. A range whose context is the only one of its kind, but not the only one of its key, needs comparison.
   The suffixes that begin at such anchors, and their reversed prefixes, are each sorted: multikey quicksort on 8-byte
   keys to SHALLOW bytes, then a blind trie for each group of longer common prefixes. With both orders and the lengths
   of common prefixes, two windows at offset o are equal if the anchors' suffixes are in one class at depth WINDOW - o and
   their prefixes in one class at depth o.
3. Removal. The spans found in 1 and 2 meet their document.

Nulls and edge cases: a null text counts as empty; texts under WINDOW bytes lose nothing; rows with a null doc_id are
left as they are and take nothing from others; every other row is a document of its own, so of rows that repeat a doc_id
with its text each has all its windows elsewhere too; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import dealt, release, settled, stored, table, text_bytes

WINDOW, GRAM = 400, 48
GRAMS = WINDOW - GRAM + 1  # in a window
PARTS = 2  # ranges of a window's offsets
SHALLOW = 64
SMALL_SORT = 24  # groups up to this size go to the trie at once
BLOCK = 1 << 20  # windows whose anchors are sought at once
FLUSH = 1 << 18  # anchors that a task sorts at once
BUCKET_BYTES = 16 << 20  # of text, for each bucket
PARTITION_BYTES = 128 << 20  # of text, for each partition of an exchange, which takes several buckets

#: Bounds of the ranges: of range i, offsets CUTS[i] to CUTS[i + 1] - 1.
CUTS = [GRAMS * i // PARTS for i in range(PARTS + 1)]

ANCHOR = np.dtype([("doc", "<i8"), ("text", "<u8"), ("hash", "<u8"), ("c1", "<u8"), ("c2", "<u8"), ("at", "<i4"), ("lo", "<u2"), ("hi", "<u2"), ("many", "?")])

_ODD = 0x9E3779B97F4A7C15
_POWER = np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK + WINDOW, _ODD, np.uint64)])
_INVERSE = np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK + WINDOW, pow(_ODD, -1, 1 << 64), np.uint64)])


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def gram_hashes(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _POWER[: len(data)], out=sums[1:])
    x = (sums[GRAM:] - sums[:-GRAM]) * _INVERSE[: len(data) - GRAM + 1]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the least and largest offset of its windows."""
    buf, n = np.frombuffer(data, np.uint8), len(data) - WINDOW + 1
    out = []
    for s0 in range(0, max(n, 0), BLOCK):
        h = gram_hashes(buf[s0 : s0 + min(BLOCK, n - s0) + WINDOW - 1])
        low = np.uint64((1 << 21) - 1)
        least, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= GRAMS:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        least = np.minimum(least[: len(least) - (GRAMS - size)], least[GRAMS - size :])
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        at = at[first]
        out.append((h[at], at + s0, at - last, at - first))
    if not out:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def key_of(data: bytes, at: int, part: int) -> int:
    """The hash of what all windows of an anchor's range have in common."""
    return xxhash.xxh3_64_intdigest(data[at - CUTS[part] : at - CUTS[part + 1] + 1 + WINDOW], part)


def anchor_records(doc: int, data: bytes) -> np.ndarray:
    _, at, lo, hi = anchors(data)
    ranges = []
    for part in range(PARTS):
        a, b = np.maximum(lo, CUTS[part]), np.minimum(hi, CUTS[part + 1] - 1)
        has = a <= b
        ranges.append((at[has], a[has], b[has], np.full(int(has.sum()), part)))
    at, lo, hi, part = (np.concatenate(x) for x in zip(*ranges, strict=True))
    rec = np.zeros(len(at), ANCHOR)
    places = at.tolist()
    keys = [key_of(data, a, p) for a, p in zip(places, part.tolist(), strict=True)]
    rec["doc"], rec["text"], rec["hash"], rec["at"], rec["lo"], rec["hi"] = doc, xxhash.xxh3_64_intdigest(data), keys, at, lo, hi
    digest = xxhash.xxh3_128_digest
    both = b"".join(digest(data[a:b]) for a, b in zip((at - hi).tolist(), (at - lo + WINDOW).tolist(), strict=True))
    pairs = np.frombuffer(both, "<u8").reshape(-1, 2)
    rec["c1"], rec["c2"] = pairs[:, 0], pairs[:, 1]
    return rec


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _rows(rec: np.ndarray, values: np.ndarray, kind: str) -> dict:
    """A row per document: (doc_id, text_hash, kind, values)."""
    order = np.lexsort((rec["at"], rec["text"], rec["doc"]))
    rec, values = rec[order], values[order]
    new = np.flatnonzero(_changes(rec["doc"], rec["text"])) if len(rec) else np.zeros(0, int)
    width = values.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(rec)] * width, pa.int32()), pa.array(values.reshape(-1), pa.int32()))
    return {"doc_id": pa.array(rec["doc"][new]), "text_hash": pa.array(rec["text"][new].view(np.int64)), "kind": pa.array([kind] * len(new), pa.string()), "at": lists}


def _spans(rec: np.ndarray) -> np.ndarray:
    """Start and stop of what the windows of anchors cover."""
    at, lo, hi = (rec[c].astype(np.int64) for c in ("at", "lo", "hi"))
    return np.stack([at - hi, at - lo + WINDOW], axis=1)


def _places(rec: np.ndarray) -> np.ndarray:
    return np.stack([rec[c].astype(np.int64) for c in ("at", "lo", "hi")], axis=1)


TOLD = "doc_id bigint, text_hash bigint, kind string, at array<int>"


def _sorted(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rec = rec[np.lexsort((rec["c2"], rec["c1"], rec["hash"]))]
    return rec, _changes(rec["hash"], rec["c1"], rec["c2"])


def send_anchors(buckets: int):
    """Rows to send (bucket, payload), and rows that the task answers itself (bucket -1)."""
    at_once = FLUSH

    def flushed(parts: list[np.ndarray]) -> pa.RecordBatch:
        rec, first = _sorted(np.concatenate(parts))
        starts = np.flatnonzero(first)
        many = (np.diff(np.r_[starts, len(rec)]) > 1)[np.cumsum(first) - 1]
        told = _rows(rec[many], _spans(rec[many]), "gone")
        rec["many"] |= many
        rec = rec[first]
        to = (rec["hash"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.lexsort((rec["at"], rec["text"], rec["doc"], to))
        rec, to = rec[order], to[order]
        cuts = np.r_[np.flatnonzero(_changes(to)), len(rec)]
        blobs = [(int(to[s]), rec[s:e].tobytes()) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        n, k = len(told["doc_id"]), len(blobs)
        rows = {"bucket": pa.array([-1] * n + [b for b, _ in blobs], pa.int32()), "payload": pa.array([None] * n + [x for _, x in blobs], pa.binary())}
        return pa.RecordBatch.from_pydict(rows | {c: pa.concat_arrays([x, pa.nulls(k, x.type)]) for c, x in told.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.append(anchor_records(doc, bytes_of(text.as_py())))
                n += len(parts[-1])
                if n >= at_once:
                    yield flushed(parts)
                    parts, n = [], 0
        if n:
            yield flushed(parts)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(blob.as_py())
    if held:
        yield held


def meet_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gone: spans of repeats. ask: anchors to be compared by their suffixes."""
    for blobs in _by_bucket(batches):
        rec, first = _sorted(np.concatenate([np.frombuffer(b, ANCHOR) for b in blobs]))
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        many = ((np.diff(np.r_[starts, len(rec)]) > 1) | np.logical_or.reduceat(rec["many"], starts))[run]
        gone = many & ~rec["many"]
        group = np.flatnonzero(_changes(rec["hash"]))
        # a key with several contexts, of which at least one is the only one of its kind
        mixed = (np.add.reduceat(first.astype(int), group) > 1) & np.logical_or.reduceat(~many, group)
        ask = mixed[np.cumsum(_changes(rec["hash"])) - 1] & first
        for part in (_rows(rec[gone], _spans(rec[gone]), "gone"), _rows(rec[ask], _places(rec[ask]), "ask")):
            yield pa.RecordBatch.from_pydict(part)


def send_contexts(buckets: int):
    """Of documents with anchors to compare: (bucket, payload), each anchor's place and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, list[bytes]] = {}
            for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = bytes_of(text.as_py())
                mark = xxhash.xxh3_64_intdigest(data)
                places = asked.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3)
                for at, lo, hi in places.tolist():
                    key = key_of(data, at, bisect_right(CUTS, lo) - 1)
                    rec = np.array([(doc, mark, key, 0, 0, at, lo, hi, False)], ANCHOR)
                    out.setdefault((key >> 20) % buckets, []).append(rec.tobytes() + data[at - hi : at - lo + WINDOW])
            packed = {b: np.array([len(x) for x in parts], "<u4") for b, parts in out.items()}
            blobs = [np.uint32(len(parts)).tobytes() + packed[b].tobytes() + b"".join(parts) for b, parts in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "payload"])

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Sorts strings with long common prefixes: inner nodes know only where their strings first differ."""

    def __init__(self, texts: list[bytes], first: int):
        self.texts, self.root = texts, [first]  # a leaf is a list of equal strings; an inner node is (depth, {byte: node})

    def add(self, i: int) -> None:
        text, node = self.texts[i], self.root
        while isinstance(node, tuple):  # blind descent, then one comparison
            depth, children = node
            node = children.get(text[depth] if depth < len(text) else -1) or next(iter(children.values()))
        other = self.texts[node[0]]
        same = common(text, other)
        if same == len(text) == len(other):
            node.append(i)
            return
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < same:
            parent, key = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][key]
        byte = text[same] if same < len(text) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][byte] = [i]
            return
        fork = (same, {byte: [i], (other[same] if same < len(other) else -1): node})
        if parent is None:
            self.root = fork
        else:
            parent[1][key] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                out += node
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(texts: list[bytes]) -> np.ndarray:
    """The order of the strings: multikey quicksort to SHALLOW bytes, blind tries beyond and for small groups."""
    n = len(texts)
    head = np.frombuffer(b"".join(t[:SHALLOW].ljust(SHALLOW, b"\0") for t in texts), ">u8").reshape(n, SHALLOW // 8)
    out, stack = [], [(np.arange(n), 0)]
    while stack:
        group, word = stack.pop()
        if len(group) <= SMALL_SORT or word == head.shape[1]:
            own = group.tolist()
            if own:
                trie = BlindTrie(texts, own[0])
                for i in own[1:]:
                    trie.add(i)
                out += trie.order()
            continue
        keys = head[group, word]
        pivot = np.sort(keys[:: max(1, len(keys) // 9)])[len(keys[:: max(1, len(keys) // 9)]) // 2]
        stack += [(group[keys > pivot], word), (group[keys == pivot], word + 1), (group[keys < pivot], word)]
    return np.array(out, np.int64)


def ranks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each string's rank, and the common prefix of each rank's string with the one before."""
    order = deep_shallow(texts)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = order.tolist()
    return rank, np.array([0, *(common(texts[a], texts[b]) for a, b in zip(own, own[1:], strict=False))], np.int64)


def equal_windows(lo: np.ndarray, hi: np.ndarray, left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, anchors) of windows that two or more anchors have. left: reversed prefixes; right: suffixes."""
    (rank_l, lcp_l), (rank_r, lcp_r) = ranks(left), ranks(right)
    for o in range(int(lo.min()), int(hi.max()) + 1):
        on = np.flatnonzero((lo <= o) & (o <= hi))
        if len(on) < 2:
            continue
        key = np.cumsum(lcp_r < WINDOW - o)[rank_r[on]] * (len(lo) + 1) + np.cumsum(lcp_l < o)[rank_l[on]]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.r_[False, same] | np.r_[same, False]
        if twice.any():
            yield o, on[order[twice]]


def compare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gone: spans of windows that two of the bucket's anchors have."""
    for blobs in _by_bucket(batches):
        heads, left, right = [], [], []
        for blob in blobs:
            n = int(np.frombuffer(blob, "<u4", 1)[0])
            at = 4 + 4 * n
            for size in np.frombuffer(blob, "<u4", n, 4).tolist():
                rec = np.frombuffer(blob, ANCHOR, 1, at)
                text = blob[at + ANCHOR.itemsize : at + size]
                heads.append(rec)
                hi = int(rec["hi"][0])
                left.append(text[:hi][::-1])
                right.append(text[hi:])
                at += size
        rec = np.concatenate(heads)
        found, offsets = [], []
        for o, at in equal_windows(rec["lo"].astype(np.int64), rec["hi"].astype(np.int64), left, right):
            found.append(at)
            offsets.append(np.full(len(at), o))
        if found:
            who, o = np.concatenate(found), np.concatenate(offsets)
            order = np.lexsort((o, who))
            who, o = who[order], o[order]
            first = np.flatnonzero(_changes(who, o - np.arange(len(o))))
            last = np.r_[first[1:], len(o)] - 1
            own = rec[who[first]]
            place = own["at"].astype(np.int64)
            yield pa.RecordBatch.from_pydict(_rows(own, np.stack([place - o[last], place - o[first] + WINDOW], axis=1), "gone"))


def _met(docs: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = np.array([xxhash.xxh3_64_intdigest(bytes_of(x.as_py())) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mark.view(np.int64))], ["doc_id", "text", "_hash"])

    right = answers.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), "at").hint("shuffle_hash")
    left = docs.mapInArrow(hashed, "doc_id bigint, text string, _hash bigint")
    return left.join(right, (left.doc_id == right._doc) & (left._hash == right._text), how).select("doc_id", "text", "at")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("at")).alias("at"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at): starts and stops, in turn, of what is repeated; they may overlap. docs: doc_id bigint, text."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES + 1)
    buckets = max(n, size // BUCKET_BYTES + 1)
    named = docs.where("doc_id is not null and text is not null")
    sent = stored(named.mapInArrow(send_anchors(buckets), f"bucket int, payload binary, {TOLD}"))
    asked = dealt(sent.where("bucket >= 0").select("bucket", "payload"), n).sortWithinPartitions("bucket")
    answers = stored(asked.mapInArrow(meet_anchors, TOLD))
    release(spark)
    ask = _met(named, _grouped(answers.where("kind = 'ask'").select("doc_id", "text_hash", "at")), "inner")
    contexts = dealt(ask.mapInArrow(send_contexts(buckets), "bucket int, payload binary"), n).sortWithinPartitions("bucket")
    compared = contexts.mapInArrow(compare_contexts, TOLD)
    told = sent.where("bucket < 0").select("doc_id", "text_hash", "at")
    return _grouped(told.unionByName(answers.where("kind = 'gone'").select("doc_id", "text_hash", "at")).unionByName(compared.select("doc_id", "text_hash", "at")))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, at in zip(batch.column(1), batch.column(2), strict=True):
            data = bytes_of(text.as_py())
            gone, spans, kept = 0, 0, data
            if at.is_valid:
                bounds = at.values.to_numpy(zero_copy_only=False).reshape(-1, 2)
                mark = np.zeros(len(data) + 1, np.int32)
                np.add.at(mark, bounds[:, 0], 1)
                np.add.at(mark, bounds[:, 1], -1)
                out_of = np.cumsum(mark[:-1]) > 0
                gone, spans = int(out_of.sum()), int((np.diff(np.r_[0, out_of.astype(np.int8)]) == 1).sum())
                kept = np.frombuffer(data, np.uint8)[~out_of].tobytes()
            out.append((len(data), gone, spans, hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "replace")))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        arrays = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, text) per row of docs (doc_id bigint, text).

    kept: the remaining bytes; text: the same as a string, with U+FFFD for a character of which a part went.
    """
    docs = docs.select("doc_id", "text")
    spans = settled(docs.sparkSession, lambda: repeated_spans(docs))
    release(docs.sparkSession)
    return _met(docs, spans, "left").mapInArrow(_without, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, text string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400-byte strings over all documents; text is what remains."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE_SQL: dict = {}
