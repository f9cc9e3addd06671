"""Lines of two texts aligned by longest common subsequence."""

from __future__ import annotations

import numpy as np


def reach(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``, by bits of one integer."""
    at: dict[int, int] = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    open_ = full
    for x in a:
        meet = open_ & at.get(x, 0)
        open_ = ((open_ + meet) | (open_ - meet)) & full
    bits = np.unpackbits(np.frombuffer(open_.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` in a longest common subsequence with ``b``: halves by halves, in memory that grows with the lines."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        low, high, first, last = work.pop()
        if low == high or first == last:
            continue
        if high - low == 1:
            if a[low] in b[first:last]:
                out.append(low)
            continue
        mid = (low + high) // 2
        total = reach(a[low:mid], b[first:last]) + reach(a[mid:high][::-1], b[first:last][::-1])[::-1]
        cut = first + int(total.argmax())
        work += [(low, mid, first, cut), (mid, high, cut, last)]
    return out


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Which lines of ``a`` are in a longest common subsequence with ``b``."""
    shared = np.zeros(len(a), bool)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        shared[head] = True
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        shared[len(a) - 1 - tail] = True
        tail += 1
    # Lines that the other page lacks cannot align; without them little is left.
    inner_b = b[head : len(b) - tail]
    known_a, known_b = set(a[head : len(a) - tail]), set(inner_b)
    left = [i for i in range(head, len(a) - tail) if a[i] in known_b]
    right = [x for x in inner_b if x in known_a]
    if left and right:
        code = {x: k for k, x in enumerate(dict.fromkeys(right))}
        for k in aligned([code[a[i]] for i in left], [code[x] for x in right]):
            shared[left[k]] = True
    return shared
