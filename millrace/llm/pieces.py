"""N-best segmentation into the pieces of a public SentencePiece vocabulary.

The lattice of a text has a node at every byte and an edge for every piece; a
space is the vocabulary's word mark, and one is put before the text. Characters
without a piece of their own get edges for their bytes. As no piece reaches
from other bytes into a space, the lattice falls apart at the beginnings of
space runs; each chunk between them is solved once per task and kept.

A forward Viterbi pass, done for many new chunks at once, gives every node the
exact score of its best prefix. A backward A-star search uses these as its
heuristic, so that it pops segmentations in order of total score; as every open
path's priority is the exact score of the best segmentation that it leads to, only as many paths
as are still asked for stay open. Of a text only the ``n - 1`` chunks whose
second-best segmentations lose least can differ from the best in its ``n`` best,
so the search runs for those chunks alone, and the text's ``n`` best come from theirs.

Chunks of over ``LONG`` bytes (texts without spaces) are walked one by one in a
few bytes of memory for each byte, their edges made where they are needed.

The vocabulary's ranks are turned into log probabilities by Zipf's law,
``-log(rank + 2)``; a byte costs ``BYTE``. Between equal scores the segmentation
whose last differing piece is longer wins.

Defined cases: a null text has no pieces and decodes to an empty text; an empty
text is the single word mark; a literal U+2581 is coded as bytes, so that every
valid text decodes to itself; repeated rows are coded alike; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, tidy

BYTE = -14.0
MARK = "▁"
CHUNK = re.compile(rb" +[^ ]*")
#: Chunks that a task keeps, bytes of chunks that are solved at once, and bytes from which on a chunk is walked.
KEPT, GROUP, LONG = 120_000, 1 << 18, 1 << 12
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """A hash table from (node, byte) to node, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        again = np.flatnonzero((found != keys) & (found >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & self.mask
            found = self.keys[slot[again]]
            hit = found == keys[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out


@dataclass
class Vocabulary:
    """Pieces as bytes by id (None: not for texts), scores, and the ids of single bytes."""

    pieces: list
    scores: np.ndarray
    byte_ids: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: list = []
        byte_ids = np.full(256, -1, np.int32)
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            pieces.append(model.id_to_piece(i).replace(MARK, " ").encode() if plain else None)
        return cls.of(pieces, byte_ids)

    @classmethod
    def of(cls, pieces: list, byte_ids: np.ndarray) -> Vocabulary:
        crossing = [p for p in pieces if p and b" " in p.lstrip(b" ")]
        if crossing:
            raise ValueError(f"pieces reach over a space: {crossing[:3]}")
        rank = np.cumsum([p is not None for p in pieces]) - 1
        return cls(pieces, -np.log(np.maximum(rank, 0) + 2.0), byte_ids)

    @cached_property
    def trie(self) -> tuple[Table, np.ndarray]:
        """Steps between nodes, from node and byte, and the piece that ends at each node (or -1)."""
        steps: dict[int, int] = {}
        ends = [-1]
        for i, p in enumerate(self.pieces):
            node = 0
            for c in p or b"":
                node = steps.setdefault(node << 8 | c, len(ends))
                if node == len(ends):
                    ends.append(-1)
            if p:
                ends[node] = i
        return Table(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps))), np.array(ends, np.int32)

    @cached_property
    def by_spelling(self) -> tuple[dict[bytes, int], list[int], list[int]]:
        """Ids of pieces by their bytes, and the length of the longest by first and by last byte."""
        ids = {p: i for i, p in enumerate(self.pieces) if p}
        first, last = [0] * 256, [0] * 256
        for p in ids:
            first[p[0]], last[p[-1]] = max(first[p[0]], len(p)), max(last[p[-1]], len(p))
        return ids, first, last

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes in a row, with start and length by id."""
        whole = [p or b"" for p in self.pieces]
        for c, i in enumerate(self.byte_ids):
            if i >= 0:
                whole[i] = bytes([c])
        size = np.array([len(p) for p in whole])
        return np.frombuffer(b"".join(whole), np.uint8), np.cumsum(size) - size, size

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell, without the space put before the text."""
        data, start, size = self.spelled
        n = size[ids]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[ids], n)
        return data[place].tobytes()[1:]

    def lattice(self, chunks: list[bytes]) -> Lattice:
        return Lattice(self, chunks)


class Lattice:
    """Edges and forward scores of many chunks side by side; chunk i has nodes ``first[i]`` to ``last[i]``."""

    def __init__(self, vocabulary: Vocabulary, chunks: list[bytes]):
        table, ends = vocabulary.trie
        data = np.frombuffer(b"".join(chunks), np.uint8)
        size = np.array([len(c) for c in chunks])
        n = len(chunks)
        byte_end = np.cumsum(size)
        owner = np.repeat(np.arange(n), size)
        # Node ids: one more than bytes in every chunk.
        self.first = byte_end - size + np.arange(n)
        self.last = self.first + size
        starts, stops, ids = [], [], []
        at = np.flatnonzero((data & 0xC0) != 0x80)
        state, depth = np.zeros(len(at), np.int64), 0
        single = np.zeros(len(data), bool)  # bytes of characters that have a piece
        width = np.diff(np.append(at, len(data)))
        while len(at):
            state = table.get(state << 8 | data[at + depth])
            live = state >= 0
            at, state, width = at[live], state[live].astype(np.int64), width[live]
            depth += 1
            piece = ends[state]
            hit = piece >= 0
            starts.append(at[hit])
            stops.append(at[hit] + depth)
            ids.append(piece[hit])
            if depth <= 4:
                whole = at[hit & (width == depth)]
                for k in range(depth):
                    single[whole + k] = True
            on = at + depth < byte_end[owner[at]]
            at, state, width = at[on], state[on], width[on]
        bare = np.flatnonzero(~single)
        starts.append(bare)
        stops.append(bare + 1)
        ids.append(vocabulary.byte_ids[data[bare]])
        score = [vocabulary.scores[i] for i in ids[:-1]] + [np.full(len(bare), BYTE)]
        start, stop, self.id, score = (np.concatenate(x) for x in (starts, stops, ids, score))
        chunk = owner[start]
        self.chunk, self.score = chunk, score
        self.start, self.stop = start + chunk, stop + chunk
        order = np.lexsort((self.start, self.stop, self.stop - self.first[chunk]))
        for name in ("id", "chunk", "score", "start", "stop"):
            setattr(self, name, getattr(self, name)[order])
        self._forward(int(self.last[-1]) + 1 if n else 0)

    def _forward(self, nodes: int) -> None:
        """Best score of a path from the chunk's start to each node, and its last edge."""
        self.best = np.full(nodes, -np.inf)
        self.best[self.first] = 0
        self.edge = np.full(nodes, -1)
        depth = self.stop - self.first[self.chunk]
        bound = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        for a, b in zip(bound, bound[1:], strict=False):
            if a == b:
                continue
            total = self.best[self.start[a:b]] + self.score[a:b]
            head = np.flatnonzero(np.diff(self.stop[a:b], prepend=-1))
            top = np.maximum.reduceat(total, head)
            tied = np.where(total == np.repeat(top, np.diff(np.append(head, b - a))), np.arange(a, b), len(self.stop))
            node = self.stop[a:b][head]
            self.best[node] = top
            self.edge[node] = np.minimum.reduceat(tied, head)

    def solved(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk: ids of the best path as int32 bytes, their number, its score, and what the second best loses."""
        n = len(self.first)
        node, on = self.last.copy(), np.arange(n)
        path = np.zeros(len(self.best), bool)
        taken, whose = [], []
        while len(on):
            path[node] = True
            e = self.edge[node]
            taken.append(e)
            whose.append(on)
            node = self.start[e]
            more = node > self.first[on]
            node, on = node[more], on[more]
        whose, taken = np.concatenate(whose[::-1]), np.concatenate(taken[::-1])
        order = np.argsort(whose, kind="stable")
        ids = self.id[taken[order]].astype(np.int32)
        count = np.bincount(whose, minlength=n)
        data, end = ids.tobytes(), np.cumsum(count) * 4
        loss = self.best[self.stop] - self.best[self.start] - self.score
        loss[taken] = np.inf
        loss[~path[self.stop]] = np.inf
        gap = np.full(n, np.inf)
        np.minimum.at(gap, self.chunk, loss)
        return [data[b - 4 * c : b] for b, c in zip(end.tolist(), count.tolist(), strict=True)], count, self.best[self.last], gap

    @cached_property
    def by_chunk(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.chunk, kind="stable")
        return order, np.searchsorted(self.chunk[order], np.arange(len(self.first) + 1))

    def n_best(self, chunk: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a chunk: scores and ids."""
        order, bound = self.by_chunk
        mine = order[bound[chunk] : bound[chunk + 1]]
        mine = mine[np.isfinite(self.best[self.start[mine]])]
        into: dict[int, list[tuple[int, float, int]]] = {}
        for e in mine.tolist():
            into.setdefault(int(self.stop[e]), []).append((int(self.start[e]), float(self.score[e]), int(self.id[e])))
        return backward(int(self.first[chunk]), int(self.last[chunk]), self.best, lambda node: into.get(node, ()), n)


def backward(first: int, last: int, best: np.ndarray, into, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best paths from ``first`` to ``last`` by A-star from the end; ``into(node)`` gives edges (start, score, id)."""
    order = itertools.count()
    # Totals that are equal but for rounding go by node, so that ties are followed to the start.
    open_: list = [(round(-float(best[last]), 6), last, next(order), 0.0, None)]
    found: list = []
    while open_ and len(found) < n:
        _, node, _, behind, path = open_.pop(0)
        if node == first:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            found.append((behind, tuple(ids)))
            continue
        for start, score, piece in into(node):
            total = behind + score
            bisect.insort(open_, (round(-(float(best[start]) + total), 6), start, next(order), total, (piece, path)))
        del open_[n - len(found) :]
    return sorted(found, key=lambda x: -x[0])


class Walk:
    """One long chunk: forward scores and last edges in flat arrays, edges made anew in the search."""

    def __init__(self, vocabulary: Vocabulary, chunk: bytes):
        self.vocabulary, self.data = vocabulary, chunk
        known, longest, _ = vocabulary.by_spelling
        scores, n = vocabulary.scores.tolist(), len(chunk)
        best = np.full(n + 1, -np.inf)
        start, piece = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int32)
        best[0] = 0
        #: Bytes of characters that have no piece of their own.
        self.bare = bytearray(n)
        values = best.tolist()
        at = 0
        for i in range(n):
            if i == at:  # a character begins
                at = i + 1
                while at < n and chunk[at] & 0xC0 == 0x80:
                    at += 1
                if chunk[i:at] not in known or at - i > 4:
                    self.bare[i:at] = b"\1" * (at - i)
            here = values[i]
            if here == -np.inf:
                continue
            edges = [(i + 1, BYTE, int(vocabulary.byte_ids[chunk[i]]))] if self.bare[i] else []
            if chunk[i] & 0xC0 != 0x80:
                for stop in range(i + 1, min(i + longest[chunk[i]], n) + 1):
                    if (name := known.get(chunk[i:stop])) is not None:
                        edges.append((stop, scores[name], name))
            for stop, score, name in edges:
                if here + score > values[stop]:
                    values[stop], start[stop], piece[stop] = here + score, i, name
        self.best, self.start, self.piece = np.array(values), start, piece

    def ids(self) -> np.ndarray:
        out, node = [], len(self.data)
        while node:
            out.append(self.piece[node])
            node = self.start[node]
        return np.array(out[::-1], np.int32)

    def into(self, node: int) -> Iterator[tuple[int, float, int]]:
        known, _, longest = self.vocabulary.by_spelling
        for start in range(max(0, node - longest[self.data[node - 1]]), node):
            name = known.get(self.data[start:node])
            if name is not None and self.data[start] & 0xC0 != 0x80:
                yield start, float(self.vocabulary.scores[name]), name
        if self.bare[node - 1]:
            yield node - 1, BYTE, int(self.vocabulary.byte_ids[self.data[node - 1]])

    def n_best(self, n: int) -> list[tuple[float, tuple[int, ...]]]:
        return backward(0, len(self.data), self.best, lambda node: (e for e in self.into(node) if self.best[e[0]] > -np.inf), n)


def grouped(chunks: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of chunks of about ``GROUP`` bytes together."""
    at = np.cumsum([len(c) + 1 for c in chunks]) // GROUP if chunks else np.zeros(0, int)
    for part in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(at)) + 1):
        if len(part):
            yield chunks[part[0] : part[-1] + 1]


class Encoder:
    """Encodes texts, keeping the chunks it has solved."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.count, self.score, self.gap = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.searched: dict[bytes, list] = {}

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        """Chunks without their first space."""
        if b"  " not in text and not text.startswith(b" ") and not text.endswith(b" "):
            return text.split(b" ")
        return [c[1:] for c in CHUNK.findall(b" " + text)]

    def _learn(self, new: list[bytes]) -> None:
        for group in grouped([c for c in new if len(c) < LONG]):
            self._keep(group, *self.vocabulary.lattice([b" " + c for c in group]).solved())
        for chunk in (c for c in new if len(c) >= LONG):
            walk = Walk(self.vocabulary, b" " + chunk)
            ids = walk.ids()
            two = walk.n_best(2)
            gap = two[0][0] - two[1][0] if len(two) > 1 else np.inf
            self._keep([chunk], [ids.tobytes()], np.array([len(ids)]), walk.best[-1:], np.array([gap]))

    def _keep(self, chunks: list[bytes], ids: list[bytes], count: np.ndarray, score: np.ndarray, gap: np.ndarray) -> None:
        self.place.update(zip(chunks, range(len(self.ids), len(self.ids) + len(chunks)), strict=True))
        self.ids += ids
        self.count, self.score, self.gap = (np.concatenate(x) for x in ((self.count, count), (self.score, score), (self.gap, gap)))

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[float], list[list[tuple[int, int, bytes]]]]]:
        """For each text the ids of its best segmentation, the scores of its ``n`` best, and how the others differ from the best.

        Of each other one the stretches that it has instead: (place in the best, how many ids go, ids instead), the last first.
        """
        split = [self.chunks(t) for t in texts]
        if len(self.ids) > KEPT:
            self._forget()
        if len(self.searched) > KEPT // 4:
            self.searched = {}
        place = self.place
        new = {c for cs in split for c in cs if c not in place}
        if new:
            self._learn(sorted(new))
        get, ids = self.place.__getitem__, self.ids
        places = [np.array(list(map(get, cs))) for cs in split]
        near = [self._near(at).tolist() for at in places]
        self._search(sorted({c for cs, at in zip(split, near, strict=True) for c in (cs[k] for k in at) if c not in self.searched}))
        for cs, at, unsure in zip(split, places, near, strict=True):
            sums: list = [(0.0, ())]
            for k in unsure:
                sums = sorted((loss + more, (*picked, j)) for loss, picked in sums for j, (more, _) in enumerate(self.searched[cs[k]]))[: self.n]
            top = float(self.score[at].sum())
            end = np.cumsum(self.count[at])
            others = []
            for _, picked in sums[1:]:
                edits = [(int(end[k] - self.count[at[k]]), int(self.count[at[k]]), self.searched[cs[k]][j][1]) for k, j in zip(unsure, picked, strict=True) if j]
                others.append(sorted(edits, reverse=True))
            yield np.frombuffer(b"".join([ids[i] for i in at.tolist()]), np.int32), [top - loss for loss, _ in sums], others

    def _near(self, at: np.ndarray) -> np.ndarray:
        """Which chunks of a text lose least in their second best."""
        gap, want = self.gap[at], self.n - 1
        k = np.argpartition(gap, want - 1)[:want] if len(gap) > want > 0 else np.arange(min(len(gap), want))
        return k[np.isfinite(gap[k])]

    def _search(self, new: list[bytes]) -> None:
        for part in grouped([c for c in new if len(c) < LONG]):
            lattice = self.vocabulary.lattice([b" " + c for c in part])
            self._remember(part, [lattice.n_best(i, self.n) for i in range(len(part))])
        for chunk in new:
            if len(chunk) >= LONG:
                self._remember([chunk], [Walk(self.vocabulary, b" " + chunk).n_best(self.n)])

    def _remember(self, chunks: list[bytes], found: list[list[tuple[float, tuple[int, ...]]]]) -> None:
        """Losses and ids of the chunks' best segmentations, that of the forward pass first."""
        spelled, meant = [], []
        for chunk, paths in zip(chunks, found, strict=True):
            best = self.ids[self.place[chunk]]
            rest = [(paths[0][0] - s, np.array(ids, np.int32).tobytes()) for s, ids in paths]
            self.searched[chunk] = ([(0.0, best)] + [x for x in rest if x[1] != best])[: self.n]
            spelled += [ids for _, ids in self.searched[chunk]]
            meant.append((b" " + chunk) * len(self.searched[chunk]))
        if self.vocabulary.decode(np.frombuffer(b"".join(spelled), np.int32)) != b"".join(meant)[1:]:
            raise ValueError("a segmentation spells another text")


def encoder_of(kept, n: int) -> Encoder:
    """One encoder a worker process for each vocabulary, so that tasks share what is solved."""
    vocabulary = kept.value
    known = vocabulary.__dict__.setdefault("_encoders", {})
    return known.setdefault(n, Encoder(vocabulary, n))


EDITS = "array<array<struct<at:int,drop:int,ids:array<int>>>>"


def encode(documents: DataFrame, vocabulary: Vocabulary, n: int = 4, key: str = "doc_id", text: str = "text", with_others: bool = True) -> DataFrame:
    """``key, n_pieces, scores, ids, round_trip`` and, unless left out, ``others``.

    ``scores`` has the log probabilities of the ``n`` best segmentations (fewer
    if there are fewer) and ``ids`` the best one, of which ``round_trip`` says
    that it decodes to the whole text. ``others`` has the second to the last
    as edits of the best, the last place first: at ``at``, ``drop`` ids make
    way for ``ids``. :func:`segmentations` spells them out.
    """
    vocabulary.trie, vocabulary.spelled  # noqa: B018  built once, here
    kept = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = documents.schema[key].dataType.simpleString()
    edit = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(kept, n)
        for part in slices(batches, 1, 1 << 19):
            texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            coded = encoder.encode([t for t in texts if t is not None])
            best, scores, others = zip(*(next(coded) if t is not None else (np.zeros(0, np.int32), [], []) for t in texts), strict=True)
            same = [encoder.vocabulary.decode(x) == (t or b"") for x, t in zip(best, texts, strict=True)]
            columns = [part.column(0), pa.array(list(map(len, best)), pa.int64()), pa.array(scores, pa.list_(pa.float64())), lists(best), pa.array(same)]
            if with_others:
                columns.append(pa.array([[[(at, drop, np.frombuffer(ids, np.int32)) for at, drop, ids in edits] for edits in each] for each in others], edit))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_pieces", "scores", "ids", "round_trip", "others"][: len(columns)])

    return documents.select(key, text).mapInArrow(tidy(work), f"`{key}` {kind}, n_pieces bigint, scores array<double>, ids array<int>, round_trip boolean" + f", others {EDITS}" * with_others)


def segmentations(encoded: DataFrame, name: str = "segmentations") -> DataFrame:
    """Adds the ids of all segmentations of ``encoded`` (ids, others, scores) in order, none for rows without scores."""
    cut = lambda ids, e: F.concat(F.slice(ids, 1, e["at"]), e["ids"], F.slice(ids, e["at"] + e["drop"] + 1, F.size(ids)))
    rest = F.transform("others", lambda edits: F.aggregate(edits, F.col("ids"), cut))
    return encoded.withColumn(name, F.when(F.size("scores") == 0, F.array().cast("array<array<int>>")).otherwise(F.concat(F.array("ids"), rest)))


def lists(rows: Sequence[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def decode(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of rows with ``ids``; null ids give an empty text."""
    kept = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kind = encoded.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept.value.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(tidy(work), f"`{key}` {kind}, text string")
