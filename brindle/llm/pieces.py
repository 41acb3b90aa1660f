"""SentencePiece encoding and decoding: N-best segmentation by Viterbi forward scores and backward A* search.

Pieces and scores come from a public model file (a path, read on every worker). As the model prescribes, spaces become
U+2581 and one is put in front of the text. The lattice of a text has an edge for every piece that matches; a character
that no single-character piece covers is written as its UTF-8 bytes, at the model's least score less UNKNOWN_PENALTY.

The forward pass gives the best score of every prefix. It is the exact remaining cost for a search from the end of the
text backwards, so A* takes the segmentations off its queue in order of score, without expanding a node in vain.

No piece goes on behind a U+2581 that follows another character, nor over a character that is in no piece. So the
lattice falls into parts at these places, words mostly. Each distinct part of a batch is segmented once, and the N best
of a text are the N best sums over its parts: a heap over the parts' losses against their best. If a model has pieces
across such places, the text is one part.

The scores are those of the model file; nothing is estimated here. In a file of byte-pair merges they are ranks, not log
probabilities. The search is exact for the sums of whatever scores there are, so with such a file its best segmentation
is the one of the least sum of ranks, which need not be what merging in order of rank gives: the ids are segmentations
into the model's pieces, but not always the ones that the library's own encoder picks.

Alternatives say where they differ from the best ids: expanded() gives their whole ids. `exact` comes from decoding the
whole ids of a document and comparing with its text.

A map over texts: no shuffle, and memory is bounded by a batch and a cache of CACHE parts.

Nulls and edge cases: a null text gives null ids and null text when decoded; an empty text has no pieces and one
segmentation of score 0; equal scores are ordered by the search, the same way each time; repeated rows give repeated rows.
Decoding gives back exactly the text that was encoded, whichever segmentation is taken.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
UNKNOWN_PENALTY = 10.0
CACHE, CACHE_LETTERS = 300_000, 8 << 20  # distinct parts and their letters that a task keeps; an idle worker holds none
SPACE = "▁"
OWN_SPACE = "\udfff"  # stands for a U+2581 of the text itself while it is segmented; no text holds a lone surrogate

TOGETHER = 32  # parts up to this length are segmented together with others of their length
_ODD_A, _ODD_B, _ODD_C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9

Segmentation = tuple[float, tuple[int, ...]]


class Vocabulary:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.score: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.score[piece] = (i, sp.get_score(i))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.score))
        # pieces of nothing but U+2581 may have a score far below all others; it doesn't count for unknown characters
        self.unknown = min(s for p, (_, s) in self.score.items() if p.strip(SPACE)) - UNKNOWN_PENALTY
        self.known = set("".join(self.score))
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.score) and "\n" not in self.known
        # of every string that begins a piece: its edge (score, ids) if it is a piece itself, else None
        self.table: dict[str, tuple[float, tuple[int, ...]] | None] = {p[:k]: None for p in self.score for k in range(1, len(p))}
        self.table |= {p: (s, (i,)) for p, (i, s) in self.score.items()}
        self._index()

    def parts(self, text: str) -> list[str]:
        """Parts of a text whose spaces are U+2581 that no piece reaches across."""
        return _PARTS.findall(text) if self.apart else [text] if text else []

    def lattice(self, part: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """Of each end, its edges (start, score, ids) and the forward Viterbi score."""
        n, table, longest = len(part), self.table, self.longest
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        forward = [0.0] + [float("-inf")] * n
        for i in range(n):
            so_far, single = forward[i], False
            for j in range(i + 1, min(n, i + longest) + 1):
                hit = table.get(part[i:j], 0)
                if hit:
                    edges[j].append((i, *hit))
                    if so_far + hit[0] > forward[j]:
                        forward[j] = so_far + hit[0]
                    single |= j == i + 1
                elif hit == 0:
                    break
            if not single:
                ids = tuple(self.byte[b] for b in restored(part[i]))
                edges[i + 1].append((i, self.unknown, ids))
                forward[i + 1] = max(forward[i + 1], so_far + self.unknown)
        return edges, forward

    def n_best(self, part: str, n: int) -> list[Segmentation]:
        """The n best segmentations, best first."""
        edges, forward = self.lattice(part)
        # an entry of the queue: (-(score so far + exact best of the rest), order, place, score so far, ids from place on as a chain)
        queue: list = [(-forward[-1], 0, len(part), 0.0, None)]
        order, out, push, pop = 0, [], heapq.heappush, heapq.heappop
        while queue:
            _, _, at, so_far, chain = pop(queue)
            if at:
                for i, s, own in edges[at]:
                    order += 1
                    push(queue, (-(forward[i] + s + so_far), order, i, so_far + s, (own, chain)))
                continue
            ids: list[int] = []
            while chain:
                ids += chain[0]
                chain = chain[1]
            out.append((so_far, tuple(ids)))
            if len(out) == n:
                break
        return out

    def best(self, part: str) -> tuple[tuple[int, ...], float, float]:
        """The best segmentation, its score, and how much the next best loses: the least loss of a path over an edge off the best path."""
        edges, forward = self.lattice(part)
        n = len(part)
        total, at, chain, used = forward[n], n, [], {}
        while at:
            for edge in edges[at]:
                if forward[edge[0]] + edge[1] == forward[at]:
                    break
            used[at] = edge
            chain.append(edge[2])
            at = edge[0]
        chain.reverse()
        backward, least = [float("-inf")] * n + [0.0], float("inf")
        for j in range(n, 0, -1):
            rest, own = backward[j], used.get(j)
            for edge in edges[j]:
                i, s, _ = edge
                if s + rest > backward[i]:
                    backward[i] = s + rest
                if edge is not own and total - forward[i] - s - rest < least:
                    least = total - forward[i] - s - rest
        return tuple(i for ids in chain for i in ids), total, max(least, 0.0)

    def _index(self) -> None:
        """Pieces by a hash of their letters, in two tables: the second has those whose place in the first is taken."""
        entries = sorted((len(p), p) for p in self.score)
        hashes = np.array([self._hash(p) for _, p in entries], np.uint64)
        assert len(set(hashes.tolist())) == len(entries)
        self.keys = np.r_[np.uint64(0), hashes]  # entry 0 is none
        self.key_id = np.array([-1, *(self.score[p][0] for _, p in entries)], np.int32)
        self.key_score = np.array([-np.inf, *(self.score[p][1] for _, p in entries)])
        self.first, over = np.zeros(1 << 19, np.int32), []
        for k, h in enumerate(hashes.tolist(), 1):
            place = (h * _ODD_A % (1 << 64)) >> 45
            if self.first[place]:
                over.append((k, h))
            else:
                self.first[place] = k
        # a multiplier that gives those whose place was taken a place each
        self.odd = next(odd for odd in range(_ODD_B, _ODD_B + 1000, 2) if len({(h * odd % (1 << 64)) >> 44 for _, h in over}) == len(over))
        self.second = np.zeros(1 << 20, np.int32)
        for k, h in over:
            self.second[(h * self.odd % (1 << 64)) >> 44] = k

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _ODD_C + ord(c) + 1) % (1 << 64)
        return h

    def _entries(self, h: np.ndarray) -> np.ndarray:
        at = self.first[(h * np.uint64(_ODD_A)) >> np.uint64(45)]
        miss = np.flatnonzero(self.keys[at] != h)
        if miss.size:
            other = self.second[(h[miss] * np.uint64(self.odd)) >> np.uint64(44)]
            at[miss] = np.where(self.keys[other] == h[miss], other, 0)
        return at

    def best_of_many(self, parts: list[str]) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """best() of each part: the same forward and backward passes, for all parts of one length at once."""
        ids: list[tuple[int, ...]] = [()] * len(parts)
        score, loss = np.zeros(len(parts)), np.zeros(len(parts))
        by_length: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            by_length.setdefault(len(part), []).append(k)
        for size, members in by_length.items():
            one_by_one = members
            if size <= TOGETHER and len(members) >= 8:
                found, total, least, sure = self._together([parts[k] for k in members], size)
                for k, own, known in zip(members, found, sure.tolist(), strict=True):
                    if known:
                        ids[k] = own
                score[members], loss[members] = total, least
                one_by_one = [k for k, known in zip(members, sure.tolist(), strict=True) if not known]
            for k in one_by_one:
                ids[k], score[k], loss[k] = self.best(parts[k])
        return ids, score, loss

    @np.errstate(invalid="ignore")  # of parts with a letter that is no piece, which are left to best()
    def _together(self, parts: list[str], size: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
        """ids, score and loss of parts of one length; the last says which have only letters that are pieces."""
        n = len(parts)
        letters = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        forward, came = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int32)
        forward[0] = 0.0
        edge: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        sure = np.ones(n, bool)
        for i in range(size):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                h = h * np.uint64(_ODD_C) + letters[j - 1]
                at = self._entries(h)
                if j == i + 1:
                    sure &= at > 0
                own = self.key_score[at]
                edge[i, j] = own, at
                reach = forward[i] + own
                better = np.flatnonzero(reach > forward[j])
                forward[j][better] = reach[better]
                came[j][better] = i
        total, rows = forward[size], np.arange(n)
        used = np.zeros((size + 1, n), bool)
        used[size] = True
        backward = np.full((size + 1, n), -np.inf)
        backward[size] = 0.0
        least, taken = np.full(n, np.inf), np.zeros((size + 1, n), np.int32)
        for j in range(size, 0, -1):
            used[came[j][used[j]], rows[used[j]]] = True
            for i in range(j - 1, max(-1, j - self.longest - 1), -1):
                own, at = edge[i, j]
                rest = own + backward[j]
                np.maximum(backward[i], rest, out=backward[i])
                best = used[j] & (came[j] == i)
                taken[j][best] = self.key_id[at[best]]
                lost = total - (forward[i] + rest)
                lost[best] = np.inf
                np.fmin(least, lost, out=least)
        flat, counts = taken.T[:, 1:][used.T[:, 1:]].tolist(), used[1:].sum(axis=0).tolist()
        found, at = [], 0
        for c in counts:
            found.append(tuple(flat[at : at + c]))
            at += c
        return found, total, np.maximum(least, 0.0), sure

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids)[1:].decode("utf-8")


_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@cache
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def prepared(text: str) -> str:
    return SPACE + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE) if text else ""


def restored(part: str) -> bytes:
    """The bytes of a prepared text's part."""
    return part.replace(SPACE, " ").replace(OWN_SPACE, SPACE).encode()


def best_sums(losses: list[list[float]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n least sums of one loss of each list (each begins with 0 and rises): (sum, {list: choice other than 0}).

    Lists are taken in order of their second loss; a combination's successors raise its last choice, add the next list,
    or move a last choice of 1 on to the next list, so each is made once.
    """
    able = sorted((k for k, x in enumerate(losses) if len(x) > 1), key=lambda k: (losses[k][1], k))[: max(0, n - 1)]
    out: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    queue = [(losses[able[0]][1], ((0, 1),))] if able else []
    while queue and len(out) < n:
        total, chosen = heapq.heappop(queue)
        out.append((total, {able[k]: c for k, c in chosen}))
        k, c = chosen[-1]
        own = losses[able[k]]
        if c + 1 < len(own):
            heapq.heappush(queue, (total - own[c] + own[c + 1], (*chosen[:-1], (k, c + 1))))
        if k + 1 < len(able):
            step = losses[able[k + 1]][1]
            heapq.heappush(queue, (total + step, (*chosen, (k + 1, 1))))
            if c == 1:
                heapq.heappush(queue, (total - own[1] + step, (*chosen[:-1], (k + 1, 1))))
    return out


def encoded(text: str, n: int, vocab: Vocabulary) -> list[Segmentation]:
    """The n best segmentations of one text."""
    found = [vocab.n_best(p, n) for p in vocab.parts(prepared(text))]
    best = sum(f[0][0] for f in found)
    sums = best_sums([[f[0][0] - s for s, _ in f] for f in found], n)
    return [(best - loss, tuple(i for k, f in enumerate(found) for i in f[chosen.get(k, 0)][1])) for loss, chosen in sums]


class Parts:
    """Best segmentations of distinct parts, numbered; starts anew when it holds too much."""

    def __init__(self, vocab: Vocabulary, n: int):
        self.vocab, self.n = vocab, n
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.letters = 0
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)  # ids of the best ones, one after another
        self.score, self.loss = np.zeros(0), np.zeros(0)  # of the best, and how much the next best loses

    def numbers(self, texts: list[str | None]) -> list[tuple[list[str], list[int]] | None]:
        """Parts and their numbers, of each text."""
        if len(self.number) > CACHE or self.letters > CACHE_LETTERS:
            self.clear()
        number, get, split = self.number, self.number.get, self.vocab.parts
        rows: list[tuple[list[str], list[int]] | None] = []
        new: list[str] = []
        for text in texts:
            if text is None:
                rows.append(None)
                continue
            parts = split(prepared(text))
            row = list(map(get, parts))
            if None in row:
                for k, i in enumerate(row):
                    if i is None:
                        i = get(parts[k])
                        if i is None:
                            i = number[parts[k]] = len(number)
                            new.append(parts[k])
                        row[k] = i
            rows.append((parts, row))
        if new:
            ids, score, loss = self.vocab.best_of_many(new)
            bytes_of = self.vocab.bytes_of
            for k, (own, part) in enumerate(zip(ids, new, strict=True)):
                if b"".join([bytes_of[x] for x in own]) != restored(part):  # other letters with a piece's hash
                    ids[k], score[k], loss[k] = self.vocab.best(part)
            self.letters += sum(map(len, new))
            self.flat = np.concatenate([self.flat, np.fromiter((i for own in ids for i in own), np.int32)])
            self.sizes = np.concatenate([self.sizes, np.array([len(own) for own in ids], np.int32)])
            self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        return rows

    def others(self, part: str, ids: tuple[int, ...]) -> list[Segmentation]:
        """The best segmentation (ids) and those that follow it, n together."""
        found = self.vocab.n_best(part, self.n)
        rest = [f for f in found if f[1] != ids]
        return [(found[0][0], ids), *rest[: self.n - 1]]


ALTERNATIVE = pa.struct([("score", pa.float64()), ("at", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int32())))])
OUT = "ids array<int>, score double, alternatives array<struct<score:double,at:array<int>,size:array<int>,ids:array<array<int>>>>, exact boolean"


def _encode_batch(texts: list[str | None], parts: Parts) -> dict[str, pa.Array]:
    """ids and score of the best segmentation; the others as what stands for size ids from at on; whether decoding gives the text back."""
    rows, n, bytes_of = parts.numbers(texts), parts.n, parts.vocab.bytes_of
    starts = np.cumsum(parts.sizes) - parts.sizes
    ids, scores, others, exact = [], [], [], []
    for row, text in zip(rows, texts, strict=True):
        if row is None:
            for column in (ids, scores, others, exact):
                column.append(None)
            continue
        pieces, own = row[0], np.array(row[1], np.int64)
        count = parts.sizes[own]
        last = np.cumsum(count)
        ids.append(parts.flat[np.arange(int(count.sum())) + np.repeat(starts[own] - (last - count), count)])
        scores.append(float(parts.score[own].sum()))
        exact.append(b"".join(map(bytes_of.__getitem__, ids[-1].tolist()))[1:] == text.encode())
        # only the parts whose next best loses least can differ in the n best
        loss = parts.loss[own]
        near = np.sort(np.argpartition(loss, n)[:n]) if len(own) > n else np.arange(len(own))
        near = near[np.argsort(loss[near], kind="stable")][: max(0, n - 1)]
        near = near[np.isfinite(loss[near])].tolist()
        found = [parts.others(pieces[k], tuple(ids[-1][last[k] - count[k] : last[k]].tolist())) for k in near]
        alternatives = []
        for less, chosen in best_sums([[f[0][0] - s for s, _ in f] for f in found], n)[1:]:
            picks = sorted((near[k], found[k][c][1]) for k, c in chosen.items())
            alternatives.append({"score": scores[-1] - less, "at": [int(last[k] - count[k]) for k, _ in picks], "size": [int(count[k]) for k, _ in picks], "ids": [list(x) for _, x in picks]})
        others.append(alternatives)
    bounds = np.r_[0, np.cumsum([0 if x is None else len(x) for x in ids])].astype(np.int32)
    values = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int32()), mask=pa.array([x is None for x in ids]))
    return {"ids": lists, "score": pa.array(scores, pa.float64()), "alternatives": pa.array(others, pa.list_(ALTERNATIVE)), "exact": pa.array(exact, pa.bool_())}


def expanded(ids: str = "ids", alternatives: str = "alternatives") -> str:
    """SQL: the whole ids of each alternative, in their order."""
    before = f"slice({ids}, 1, if(size(x.at) > 0, x.at[0], 0))"
    rest = f"slice({ids}, x.at[i] + x.size[i] + 1, if(i + 1 < size(x.at), x.at[i + 1], size({ids})) - x.at[i] - x.size[i])"
    return f"transform({alternatives}, x -> flatten(concat(array({before}), flatten(transform(x.ids, (y, i) -> array(y, {rest}))))))"


SUB_BATCH = 4 << 20  # characters segmented at once


def encode(docs: DataFrame, model: str = MODEL, n: int = N_BEST, text: str = "text") -> DataFrame:
    """docs, its text replaced by ids, score, alternatives and exact (columns of these names are replaced)."""
    new = ["ids", "score", "alternatives", "exact"]
    kept = [f for f in docs.schema.fields if f.name not in (text, *new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(vocabulary(model), n)
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(text))
            sizes = np.cumsum([len(x.as_py() or "") for x in column])
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + SUB_BATCH, "right")))
                part = batch.slice(at, to - at)
                out = _encode_batch(part.column(names.index(text)).to_pylist(), parts)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(f.name)) for f in kept), *out.values()], [*(f.name for f in kept), *out])
                at = to

    schema = type(docs.schema)([*kept])
    for f in type(docs.schema).fromDDL(OUT):
        schema = schema.add(f)
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """rows with decoded: the text of their ids. An id that the model doesn't have is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else vocab.decode(x) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    rows = rows.drop("decoded")
    return rows.mapInArrow(run, type(rows.schema)([*rows.schema.fields]).add("decoded", "string"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's best segmentation, and the alternatives that follow it."""
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "ids", "alternatives", "exact")


def tokenised(docs: DataFrame) -> DataFrame:
    """Of each document its id and columns but for the text, with ids, n_pieces, score and whether decoding gives the text back."""
    return encode(docs).withColumn("n_pieces", F.size("ids").cast("long")).drop("alternatives")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE_SQL: dict = {}
