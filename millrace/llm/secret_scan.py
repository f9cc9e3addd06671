"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags every token of every text as begin, inside or outside of a
secret. Tokens are runs of letters and digits (and bytes beyond ASCII) and runs
of one punctuation sign, so that a secret with signs in it is a chain of tokens
and what stands before it (``key``, ``=``, a quote) are tokens of the chain too.
Features are the token's shape and spelling, the tokens around it, the stretch
without spaces that it stands in, key words and assignment signs before it, and
the file. A chain is a line, or about ``CHAIN`` tokens of a longer one, cut at a space; Viterbi
decoding, over ``WINDOW`` characters at once, runs on every chain that the tokens' own weights do not already show to
be outside throughout (:meth:`Field.undecided`, exact).

It is trained by maximum likelihood on at most ``runs`` lines with a secret and
``runs`` without one, from a sample of about ``sample_docs`` documents, both chosen by hash.
A token counts as secret if a fixed pattern covers it, other than as the name
that is assigned to. As these labels alone would teach the patterns again, each
line, with a secret or without, is used again with a value of another make under
another name and assigned in another way, and each line without one again with
a key word before one of its words, as outside.

Defined cases: a null or empty text has no spans; offsets are code points, ends
exclusive; base spans of one kind never overlap, spans of different kinds may; a
span of the field is reported only where it meets no base span; without any
marked token the field adds nothing; repeated rows are scanned alike; other
columns pass through :func:`redact` unchanged.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import padded_slice, sampled, slices, tidy
from millrace.session import written

# The base patterns, their kinds in order, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Words that announce a secret, anywhere in a token or as a token of their own.
CUES = (*WORDS, b"passphrase", b"credential", b"pwd", b"private_key")
WHOLE_CUES = (b"key", b"pin", b"pass", b"auth", b"login", b"code")
#: Names and signs that training puts in the patterns' place.
NAMES = ("passphrase", "credential", "pwd", "pin", "auth", "login", "private key", "access code", "my key", "db_pass", "PASSPHRASE", "signing key")
SIGNS = ("=", ": ", " = ", " is ", ":", ' = "', ": '", " was ", " ")
LETTERS, NUMBERS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
CHAIN = 64
#: Characters of texts whose tokens a task holds at once.
WINDOW = 1 << 18
#: Bytes of a line that training takes.
LINE_BYTES = 1500
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
BUCKETS = 1 << 16
N_FEATURES = 19
_byte = np.arange(256)
DIGIT = (_byte >= 48) & (_byte <= 57)
UPPER = (_byte >= 65) & (_byte <= 90)
SMALL = (_byte >= 97) & (_byte <= 122)
FAR = _byte >= 128
HEXES = DIGIT | ((_byte >= 97) & (_byte <= 102))
LOWER = np.where(UPPER, _byte + 32, _byte).astype(np.uint8)
#: 0 space, 1 part of a word, 2 a sign; and letters by kind.
CLASS = np.where(_byte <= 32, 0, np.where(DIGIT | UPPER | SMALL | FAR, 1, 2)).astype(np.int8)
SORT = (SMALL + 2 * UPPER + 3 * DIGIT + 4 * FAR).astype(np.int8)
_PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.random.default_rng(6).integers(1, 1 << 63, N_FEATURES, dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def base_spans(text: str, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and kind; flags say which may occur."""
    found = []
    if assign:
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        found += [(2, m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[1], s[0]))


def secret_part(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """Start and end of a base span without the name that is assigned to."""
    kind, start, end = span
    return (ASSIGN.match(text, start).start(2) if KINDS[kind] == "assign" else start), end


def word_key(word: bytes) -> np.uint64:
    """The spelling hash of a token."""
    data = LOWER[np.frombuffer(word, np.uint8)].astype(np.uint64) + np.uint64(1)
    return np.add.reduce(data * _PLACES[np.arange(len(data)) & 63])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


#: Inside follows begin or inside only.
FORBIDDEN = np.zeros((3, 3))
FORBIDDEN[OUTSIDE, INSIDE] = -1e9


@dataclass
class Field:
    """Weights: ``emit[feature, tag]`` and ``move[tag, tag]``, and bits of letter pairs in prose."""

    emit: np.ndarray
    move: np.ndarray
    pairs: np.ndarray

    def scores(self, feats: Iterable[np.ndarray]) -> np.ndarray:
        """Of each token and tag, from one feature's buckets after another."""
        out = None
        for row in feats:
            out = self.emit[row] if out is None else out + self.emit[row]
        return out

    def undecided(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which chains (by first token) may have a best path that is not outside throughout.

        A stretch of k other tags has k + 1 other moves, at most 2 k; if every
        token's own weights prefer outside by more than two moves can gain, the
        path with the stretch outside is better.
        """
        gain = max(0.0, 2 * float(self.move.max() - self.move[OUTSIDE, OUTSIDE]))
        weak = score[:, OUTSIDE] - score[:, :OUTSIDE].max(1) <= gain
        return np.flatnonzero(np.logical_or.reduceat(weak, first)) if len(first) else first

    def tags(self, score: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Viterbi tags of chains of ``size`` tokens from ``first``, with outside on both sides."""
        out: list = [None] * len(first)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), 512):
            mine = order[at : at + 512]
            longest = int(size[mine[0]])
            best = score[first[mine]] + self.move[OUTSIDE]
            back = np.zeros((longest, len(mine), 3), np.int8)
            for t in range(1, longest):
                on = np.flatnonzero(size[mine] > t)
                step = best[on, :, None] + self.move
                back[t, on] = step.argmax(1)
                best[on] = step.max(1) + score[first[mine[on]] + t]
            last = (best + self.move[:, OUTSIDE]).argmax(1)
            for row, chain in enumerate(mine):
                tags = np.empty(size[chain], np.int8)
                tags[-1] = last[row]
                for t in range(size[chain] - 1, 0, -1):
                    tags[t - 1] = back[t, row, tags[t]]
                out[chain] = tags
        return out


def train(feats: np.ndarray, tags: np.ndarray, first: np.ndarray, pairs: np.ndarray, epochs: int = 6, rate: float = 0.15, decay: float = 2e-5, seed: int = 3) -> Field:
    """Maximum likelihood over batches of chains of like length, with forward and backward passes.

    ``feats`` is (feature, token), ``first`` has each chain's first token.
    """
    rng = np.random.default_rng(seed)
    size = np.diff(np.append(first, len(tags)))
    by_size = np.argsort(size, kind="stable")
    groups = [by_size[at : at + 64] for at in range(0, len(by_size), 64)]
    emit, move = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    seen_emit, seen_move = np.full_like(emit, 1e-2), np.full_like(move, 1e-2)
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            chains = groups[g]
            n, length = len(chains), size[chains]
            longest = int(length.max())
            place = np.minimum(first[chains][:, None] + np.arange(longest), len(tags) - 1)
            live = np.arange(longest) < length[:, None]
            mine = feats[:, place]
            score, trans = emit[mine].sum(0), move + FORBIDDEN
            ahead, behind = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
            ahead[:, 0] = score[:, 0] + trans[OUTSIDE]
            for t in range(1, longest):
                ahead[:, t] = score[:, t] + log_sum(ahead[:, t - 1, :, None] + trans, 1)
            for t in range(longest - 1, -1, -1):
                after = np.broadcast_to(trans[:, OUTSIDE], (n, 3))
                if t + 1 < longest:
                    go = log_sum(trans[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                    after = np.where((t + 1 < length)[:, None], go, after)
                behind[:, t] = after
            total = log_sum(ahead[:, 0] + behind[:, 0], 1)
            chance = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
            gold = (tags[place][..., None] == np.arange(3)) & live[..., None]
            lost = gold - chance
            path = np.hstack([np.full((n, 1), OUTSIDE), np.where(live, tags[place], OUTSIDE), np.full((n, 1), OUTSIDE)])
            moved = np.zeros((3, 3))
            expected = np.zeros((3, 3))
            expected[OUTSIDE] += chance[:, 0].sum(0)
            expected[:, OUTSIDE] += chance[np.arange(n), length - 1].sum(0)
            for t in range(longest + 1):
                on = t <= length
                np.add.at(moved, (path[on, t], path[on, t + 1]), 1)
            for t in range(1, longest):
                on = t < length
                pair = ahead[on, t - 1, :, None] + trans + (score[on, t] + behind[on, t])[:, None, :] - total[on, None, None]
                expected += np.exp(pair).sum(0)
            flat = mine[:, live].ravel()
            part = lost[live]
            grad = np.stack([np.bincount(flat, np.tile(part[:, tag], len(mine)), BUCKETS) for tag in range(3)], axis=1) / n - decay * emit
            seen_emit += grad**2
            emit += rate * grad / np.sqrt(seen_emit)
            grad = (moved - expected) / n
            seen_move += grad**2
            move += rate * grad / np.sqrt(seen_move)
    return Field(emit.astype(np.float32), (move + FORBIDDEN).astype(np.float32), pairs)


def spread(values: np.ndarray, number: int) -> np.ndarray:
    """Buckets of a feature's values."""
    return (((values.astype(np.uint64) ^ _SALTS[number]) * _MULTIPLIER) >> np.uint64(48)).astype(np.int32)


def file_features(sizes: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.char.str_len(sizes.astype(str)) if len(sizes) else sizes, digits * 50 // np.maximum(sizes, 1)


def windows(text: str) -> Iterator[str]:
    """A long text in parts of about ``WINDOW`` characters, cut behind a line end, in longer lines behind a space."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > WINDOW:
            end = text.rfind("\n", at + 1, at + WINDOW) + 1 or text.rfind(" ", at + 1, at + WINDOW) + 1 or at + WINDOW
        yield text[at:end]
        at = end


class Slice:
    """What one slice of texts holds: candidates for the patterns, and tokens in chains for the field."""

    def __init__(self, column: pa.Array):
        self.column = column
        # A line end stands before every text.
        self.data, self.first = padded_slice(column, 10)
        self.low = LOWER[self.data].tobytes()

    def _doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def _holding(self, text: bytes, words: tuple[bytes, ...]) -> np.ndarray:
        docs = len(self.column)
        found = np.zeros(docs, bool)
        for w in words:
            at = text.find(w)
            while at >= 0:
                doc = int(np.searchsorted(self.first, at, side="right")) - 1
                found[doc] = True
                nxt = int(self.first[doc + 1]) if doc + 1 < docs else len(text)
                at = text.find(w, nxt)
        return found

    def base(self) -> dict[int, list[tuple[int, int, int]]]:
        """Base spans of the texts that have any."""
        assign, access = self._holding(self.low, WORDS), self._holding(self.data.tobytes(), (b"AKIA",))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], HEXES[self.data], [False])).view(np.int8)))
        hexes = np.zeros(len(self.column), bool)
        hexes[self._doc(edge[::2][edge[1::2] - edge[::2] >= 24])] = True
        some = np.flatnonzero(assign | access | hexes)
        found = {int(i): base_spans(self.column[int(i)].as_py(), assign[i], access[i], hexes[i]) for i in some}
        return {i: spans for i, spans in found.items() if spans}

    def tokens(self) -> None:
        """Sets tokens ``a`` to ``b``, their chains' first tokens and sizes."""
        d = self.data
        kind = CLASS[d]
        new = np.zeros(len(d), bool)
        new[1:] = (kind[1:] != 0) & ((kind[1:] != kind[:-1]) | ((kind[1:] == 2) & (d[1:] != d[:-1])))
        ends = np.zeros(len(d), bool)
        ends[:-1] = (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | ((kind[:-1] == 2) & (d[1:] != d[:-1])))
        if len(d):
            ends[-1] = kind[-1] != 0
        self.a, self.b = np.flatnonzero(new), np.flatnonzero(ends) + 1
        line = np.cumsum(d == 10)[self.a]
        heads = np.flatnonzero(np.diff(line, prepend=-1))
        within = np.arange(len(line)) - np.repeat(heads, np.diff(np.append(heads, len(line))))
        self.line, self.within = line, within
        self.glued = np.zeros(len(line), bool)
        self.glued[1:] = self.a[1:] == self.b[:-1]
        # A chain ends at a space, if one comes within four times its length.
        stretch = np.flatnonzero(~self.glued)
        start = within[stretch][np.cumsum(~self.glued) - 1] if len(line) else within
        cut = (line * len(line) + start // CHAIN) * len(line) + (within - start) // (4 * CHAIN)
        self.chain = np.flatnonzero(np.diff(cut, prepend=-1))
        self.size = np.diff(np.append(self.chain, len(line)))

    def features(self, pairs: np.ndarray, file: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """Buckets of all tokens, one feature after another; ``file`` has size and share of digits by text if these are parts of other texts."""
        d, a, b, line = self.data, self.a, self.b, self.line
        n = len(a)
        size = b - a
        total = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        sums = [total(m[d]) for m in (SMALL, UPPER, DIGIT, FAR, HEXES)]
        turns = np.zeros(len(d), bool)
        turns[1:] = (SORT[d[1:]] != SORT[d[:-1]]) & (CLASS[d[1:]] == 1) & (CLASS[d[:-1]] == 1)
        turned = total(turns)
        low = LOWER[d].astype(np.int64) - 97
        letters = (low[1:] >= 0) & (low[1:] < 26) & (low[:-1] >= 0) & (low[:-1] < 26)
        cost = np.zeros(len(d))
        cost[1:][letters] = pairs[low[:-1][letters], low[1:][letters]]
        costs, paired = np.concatenate(([0.0], np.cumsum(cost))), np.concatenate(([0, 0], np.cumsum(letters, dtype=np.int32)))
        inner = np.minimum(a + 1, b)
        odd = np.clip(((costs[b] - costs[inner]) / np.maximum(paired[b] - paired[inner], 1) * 2).astype(np.int64), 0, 19)
        odd[paired[b] - paired[inner] == 0] = 20
        small, upper, digit, far, hexes = (s[b] - s[a] for s in sums)
        sign = CLASS[d[a]] == 2
        shape = (small > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (far > 0) + 16 * sign
        full = np.flatnonzero(CLASS[d] != 0)
        head = np.searchsorted(full, a)
        spell = np.zeros(n, np.uint64)
        if n:
            offset = full - np.repeat(a, size)
            spell = np.add.reduceat((LOWER[d[full]].astype(np.uint64) + np.uint64(1)) * _PLACES[offset & 63], head)
        known = np.where(size <= 20, spell, np.uint64(0))

        def moved(values: np.ndarray, by: int) -> np.ndarray:
            """Values of the token ``by`` places before (or behind), 0 beyond the line."""
            out = np.zeros_like(values)
            if by > 0 and n > by:
                out[by:] = np.where(line[by:] == line[:-by], values[:-by], 0)
            elif by < 0 and n > -by:
                out[:by] = np.where(line[:by] == line[-by:], values[-by:], 0)
            return out

        cue = np.isin(known, np.array([word_key(w) for w in WHOLE_CUES]))
        for w in CUES:
            at = self.low.find(w)
            places = []
            while at >= 0:
                places.append(at)
                at = self.low.find(w, at + len(w))
            if places:
                cue[np.searchsorted(a, places, side="right") - 1] = True
        index = np.arange(n)

        def since(mask: np.ndarray, most: int) -> np.ndarray:
            """How many tokens ago in the line the last of ``mask`` stands: 1 to ``most``, else 0."""
            last = np.maximum.accumulate(np.where(mask, index, -1)) if n else index
            before = np.concatenate(([-1], last[:-1])) if n else last
            ago = index - before
            return np.where((before >= 0) & (ago <= most) & (ago <= self.within), ago, 0)

        assigned = since(sign & np.isin(d[a], list(b"=:")), 3)
        cued = np.where(cue, 7, since(cue, 6))
        glued = self.glued
        behind = np.zeros(n, bool)
        if n:
            behind[:-1] = glued[1:]
        signs = np.where(sign, d[a], 1).astype(np.int64)
        stretch = np.flatnonzero(~glued)
        of = np.cumsum(~glued) - 1
        low_end = a[stretch] if n else a
        high_end = b[np.append(stretch[1:], n) - 1] if n else b
        long = high_end - low_end
        whole = ((sums[0][high_end] - sums[0][low_end]) > 0) + 2 * ((sums[1][high_end] - sums[1][low_end]) > 0) + 4 * ((sums[2][high_end] - sums[2][low_end]) > 0)
        bends = np.minimum((turned[high_end] - turned[low_end]) * 8 // np.maximum(long, 1), 7)
        doc = self._doc(a)
        if file is None:
            sizes = np.diff(np.append(self.first, len(d)))
            digits = sums[2][np.append(self.first[1:], len(d))] - sums[2][self.first]
            file = file_features(sizes, digits)
        columns = (
            lambda: np.zeros(n, np.int64),
            lambda: np.where(sign, 64 + signs, np.minimum(size, 32)),
            lambda: (shape * 8 + np.minimum(turned[b] - turned[inner], 7)) * 16 + np.minimum(size // 3, 9),
            lambda: digit * 5 // np.maximum(size, 1) * 16 + np.minimum(size // 2, 15),
            lambda: (hexes == size) * 64 + np.minimum(size, 40),
            lambda: known,
            lambda: moved(known, 1),
            lambda: moved(known, 2),
            lambda: moved(known, -1),
            lambda: ((glued * 256 + glued * moved(signs, 1)) * 2 + behind) * 256 + behind * moved(signs, -1),
            lambda: cued * 4 + assigned,
            lambda: cued * 32 + shape,
            lambda: odd * 16 + np.minimum(size // 3, 9),
            lambda: (np.minimum(long, 47) // 3 * 8 + whole)[of] * 8 + bends[of] if n else index,
            lambda: (whole[of] * 8 + cued) * 4 + assigned if n else index,
            lambda: file[0][doc],
            lambda: file[1][doc],
            lambda: (odd * 8 + cued) * 2 + (assigned > 0),
            lambda: moved(known, 1) * np.uint64(3) + moved(known, 2),
        )
        for k, column in enumerate(columns):
            yield spread(column(), k)

    def added(self, field: Field, file: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, list[tuple[int, int]]]:
        """Spans of the field by text, as code points."""
        self.tokens()
        if not len(self.a):
            return {}
        score = field.scores(self.features(field.pairs, file))
        chains = field.undecided(score, self.chain)
        out: dict[int, list] = {}
        last = None
        for chain, tags in zip(chains, field.tags(score, self.chain[chains], self.size[chains]), strict=True):
            start = int(self.chain[chain])
            for t in np.flatnonzero(tags != OUTSIDE):
                token = start + int(t)
                spans = out.setdefault(int(self._doc(self.a[token])), [])
                # A secret that goes on over the end of a chain is one.
                goes_on = tags[t] == INSIDE or (t == 0 and last == token - 1 and self.line[token] == self.line[last] and self.a[token] == self.b[last])
                if goes_on and spans:
                    spans[-1][1] = int(self.b[token])
                else:
                    spans.append([int(self.a[token]), int(self.b[token])])
                last = token
        return {doc: self.points(doc, spans) for doc, spans in out.items()}

    def points(self, doc: int, spans: list) -> list[tuple[int, int]]:
        """Byte places of the slice as code points of a text."""
        start = int(self.first[doc]) + 1
        body = self.data[start : max(e for _, e in spans)]
        point = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
        return [(int(point[x - start]), int(point[y - start])) for x, y in spans]


def all_spans(column: pa.Array, field: Field | None) -> dict[int, list[tuple[int, int, int]]]:
    """By text: base spans, and those that the field adds."""
    base = Slice(column).base()
    added: dict[int, list[tuple[int, int]]] = {}
    at = 0
    for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), 0, WINDOW) if field is not None else ():
        if part.num_rows == 1 and len(text := part.column(0)[0].as_py() or "") > WINDOW:
            data, start = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), 0
            file = file_features(np.array([len(data) + 1]), np.array([int(DIGIT[data].sum())]))
            for window in windows(text):
                found = Slice(pa.array([window], pa.large_string())).added(field, file)
                added.setdefault(at, []).extend((a + start, b + start) for a, b in found.get(0, ()))
                start += len(window)
        else:
            added |= {at + doc: spans for doc, spans in Slice(part.column(0)).added(field).items()}
        at += part.num_rows
    out = {}
    for doc in sorted(base.keys() | added.keys()):
        mine = base.get(doc, [])
        fresh = [(3, a, b) for a, b in added.get(doc, []) if not any(x < b and a < y for _, x, y in mine)]
        if mine or fresh:
            out[doc] = sorted(mine + fresh, key=lambda x: (x[1], x[0]))
    return out


def value_of(rng: random.Random) -> str:
    """A secret of some make."""
    of = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    both = LETTERS + LETTERS.upper()
    makes = (
        lambda: of("0123456789abcdef", 12, 23),
        lambda: of(both + NUMBERS, 8, 40),
        lambda: of(both, 8, 24),
        lambda: of(LETTERS, 8, 20),
        lambda: of(NUMBERS, 4, 12),
        lambda: of(LETTERS + NUMBERS, 6, 16),
        lambda: rng.choice("-_.:").join(of(both + NUMBERS, 4, 8) for _ in range(rng.randint(2, 5))),
        lambda: "".join(of(both + NUMBERS, 2, 6) + rng.choice("!@#$%^&*+/") for _ in range(rng.randint(2, 4))) + of(NUMBERS, 1, 3),
        lambda: of(both + NUMBERS + "+/", 24, 48) + rng.choice(("", "=", "==")),
    )
    return rng.choice(makes)()


def with_secret(line: str, spans: list[tuple[int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The line with a secret of another make and name in place of one of its own, or before one of its words."""
    if spans:
        start, end = rng.choice(spans)
        if m := re.search(r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?$""", line[:start]):
            start = m.start()
        rest = line[end:].lstrip("\"'")
    else:
        start = rng.choice([m.start() for m in re.finditer(r"(?<!\S)\S", line)])
        rest = " " + line[start:]
    intro, value = rng.choice(NAMES) + rng.choice(SIGNS), value_of(rng)
    if rng.random() < 0.15:  # without a name; long ones only
        intro, value = "", "".join(rng.choice(LETTERS + LETTERS.upper() + NUMBERS) for _ in range(rng.randint(20, 40)))
    quote = intro[-1:] if intro[-1:] in "\"'" else ""
    at = start + len(intro)
    return line[:start] + intro + value + quote + rest, [(at, at + len(value))]


def with_cue(line: str, rng: random.Random) -> str:
    """A line without secrets with a key word before one of its words."""
    at = rng.choice([m.start() for m in re.finditer(r"(?<!\S)\S", line)])
    return line[:at] + rng.choice((*NAMES, "password", "secret", "token", "api key")) + rng.choice((" ", " is ", ", ", ". ", " was ")) + line[at:]


def examples(column: pa.Array) -> Iterator[tuple[str, list[tuple[int, int]], int, int]]:
    """Lines to learn from: (line, spans of secrets, the text's size in digits, its share of digits)."""
    s = Slice(column)
    base = s.base()
    for doc in range(len(column)):
        text = column[doc].as_py()
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        digits = sum(map(data.count, map(bytes, [[c] for c in b"0123456789"])))
        file = len(str(len(data) + 1)), digits * 50 // (len(data) + 1)
        secrets = [secret_part(text, x) for x in base.get(doc, [])]
        at, plain, odd = 0, None, None
        for line in text.split("\n"):
            # A part of about CHAIN tokens of a longer line.
            mine = [(a - at, b - at) for a, b in secrets if at <= a and b <= at + len(line)]
            for low in range(0, max(len(line), 1), 300) if len(line) > 300 else (0,):
                cut = line if len(line) <= 300 else line[max(low - 30, 0) : low + 300]
                shift = 0 if len(line) <= 300 else max(low - 30, 0)
                inside = [(a - shift, b - shift) for a, b in mine if shift <= a and b <= shift + len(cut)]
                if len(cut) > LINE_BYTES or not cut.strip() or any(a < shift + len(cut) and b > shift for a, b in mine) != bool(inside):
                    continue
                if inside:
                    yield (cut, inside, *file)
                else:
                    rank = xxhash.xxh64_intdigest(cut.encode("utf-8", "surrogatepass"))
                    plain = min(plain or (rank, cut), (rank, cut))
                    if re.search(r"[0-9]|[a-z][A-Z]", cut):
                        odd = min(odd or (rank, cut), (rank, cut))
            at += len(line) + 1
        for found in (plain, odd if odd != plain else None):
            if found:
                yield (found[1], [], *file)


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 40000, runs: int = 3000) -> Field | None:
    """A field trained on lines of a bounded sample, or None if no token is marked."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    chosen = sampled(rows, "key", sample_docs, rows.count()).select("text")
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            found = [(line, [{"a": a, "b": b} for a, b in spans], size, digits) for line, spans, size, digits in examples(part.column(0))]
            if found:
                line, spans, size, digits = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(line, pa.string()), pa.array(spans, span), pa.array(size, pa.int32()), pa.array(digits, pa.int32())], names=["line", "spans", "size", "digits"])

    each = chosen.mapInArrow(tidy(lines), "line string, spans array<struct<a:int,b:int>>, size int, digits int").withColumn("rank", F.xxhash64("line"))
    once = written(each.groupBy("line").agg(F.min(F.struct("rank", "spans", "size", "digits")).alias("x")).select("line", "x.*"), "lines")
    best = lambda some: once.filter(some).orderBy("rank", "line").limit(runs)
    marked, plain = (best(some).collect() for some in ("size(spans) > 0", "size(spans) = 0"))  # ``runs`` short lines each
    if not marked:
        return None
    counts = np.ones((26, 26))
    for r in plain:
        low = LOWER[np.frombuffer(r.line.encode("utf-8", "surrogatepass"), np.uint8)].astype(int) - 97
        ok = (low[1:] >= 0) & (low[1:] < 26) & (low[:-1] >= 0) & (low[:-1] < 26)
        np.add.at(counts, (low[:-1][ok], low[1:][ok]), 1)
    pairs = -np.log2(counts / counts.sum(1, keepdims=True))
    texts, secrets, files = [], [], []
    for r in marked + plain:
        spans = [(x.a, x.b) for x in r.spans]
        rng = random.Random(xxhash.xxh64_intdigest(r.line.encode("utf-8", "surrogatepass")))
        for line, places in ((r.line, spans), with_secret(r.line, spans, rng), (r.line, spans) if spans else (with_cue(r.line, rng), [])):
            texts.append(line.replace("\n", " "))
            secrets.append(places)
            files.append((r.size, r.digits))
    parts = [labelled(pairs, texts[at : at + 1000], secrets[at : at + 1000], files[at : at + 1000]) for at in range(0, len(texts), 1000)]
    size = np.concatenate([size for *_, size in parts])
    return train(np.concatenate([feats for feats, *_ in parts], axis=1), np.concatenate([tags for _, tags, _ in parts]), np.cumsum(size) - size, pairs)


def labelled(pairs: np.ndarray, texts: list[str], secrets: list[list[tuple[int, int]]], files: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and tags of the tokens of lines, and the sizes of their chains."""
    s = Slice(pa.array(texts, pa.large_string()))
    s.tokens()
    feats = np.stack(list(s.features(pairs, tuple(np.array(files).T))))
    tags = np.full(len(s.a), OUTSIDE, np.int8)
    doc = s._doc(s.a)
    bound = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, places in enumerate(secrets):
        for x, y in places:
            low, high = (int(s.first[i]) + 1 + len(texts[i][:k].encode("utf-8", "surrogatepass")) for k in (x, y))
            t = np.arange(bound[i], bound[i + 1])
            t = t[(s.a[t] < high) & (s.b[t] > low)]
            tags[t] = INSIDE
            tags[t[:1]] = BEGIN
    return feats, tags, s.size


def scan(documents: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans array<struct<kind, start, end>>`` for every row."""
    kept = documents.sparkSession.sparkContext.broadcast(field)
    kind = documents.schema[key].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = all_spans(part.column(1), kept.value)
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found.get(i, ())] for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(struct))], names=[key, "spans"])

    return documents.select(key, text).mapInArrow(tidy(work), f"`{key}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(key, *(count(k) for k in KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by the first span's kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for k, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = b
    return "".join(out) + text[at:]


def redact(documents: DataFrame, field: Field | None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns, secrets in ``text`` replaced; ``length``, if present, follows the new text."""
    kept = documents.sparkSession.sparkContext.broadcast(field)
    names = documents.columns
    at = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = kept.value
        for part in slices(batches, at):
            columns = list(part.columns)
            if found := all_spans(part.column(at), field):
                texts = part.column(at).to_pylist()
                for i, spans in found.items():
                    texts[i] = redacted(texts[i], spans)
                columns[at] = pa.array(texts, part.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = documents.mapInArrow(tidy(work), documents.schema)
    return out.withColumn(length, F.length(text).cast(documents.schema[length].dataType)) if length in names else out
