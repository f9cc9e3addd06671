"""Text functions: search terms, citations, headings, sizes and budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search ignores, and how many terms it takes.
STOP_WORDS = ("src", "js", "jsx", "ts", "tsx", "test", "tests", "backend", "frontend", "users", "workspace")
MAX_TERMS = 60
CITATION = r"\[E:([^\]]{1,400})\]"


def search_terms(query: Column) -> Column:
    """Distinct lower-case terms of over one byte in order, without stop words."""
    words = F.filter(F.transform(F.split(query, r"[^\p{L}\p{N}_]+"), F.lower), lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(words), 1, MAX_TERMS)


def terms_of(query: str) -> tuple[str, ...]:
    """The same of one query, on the driver."""
    words = (w.lower() for w in re.split(r"[^\w]+", query))
    return tuple(dict.fromkeys(w for w in words if len(w.encode()) > 1 and w not in STOP_WORDS))[:MAX_TERMS]


def folded(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def names_label(message: Column, label: str) -> Column:
    """Whether ``label`` stands in a message by itself: B1 neither in AB1 nor in B12 nor in B1.2."""
    return message.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(label)}(?![0-9.])")


def heading_key(heading: Column) -> Column:
    """A heading without its number, spaces and punctuation, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(heading, r"^\s*(?:[0-9]+[.)]?)+\s*", ""), r"[^\p{L}\p{N}]+", ""))


def is_bounded(text: Column, most: int) -> Column:
    """Whether a text is neither blank nor of over ``most`` bytes."""
    return (F.trim(text) != "") & (F.octet_length(text) <= most)


def safe_error(text: Column) -> Column:
    return F.when(text.contains("://"), "request failed; details withheld").otherwise(F.left(text, F.lit(1000)))


def estimate(request_bytes: Column, density: int = 100) -> Column:
    """Tokens that a request may take: bytes and 256 more, by hundredths of a byte a token."""
    return F.ceil((request_bytes + 256) * 100 / max(density, 100)).cast("bigint")


def _between(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high)).cast("bigint")


def summary_maximum(limit: Column) -> Column:
    """Bytes of a summary for a request of ``limit`` bytes."""
    return _between(F.floor(limit / 6), 4000, 48_000)


def accepted_summary(asked: Column, limit: Column) -> Column:
    """Bytes up to which a summary is taken: twice what was asked, within a third of the request."""
    return F.greatest(asked, F.least(2 * asked, F.floor(limit / 3))).cast("bigint")


def graph_budget(space: Column) -> Column:
    return F.least(F.floor(space / 8), F.lit(12_000)).cast("bigint")


def section_ceiling(leaves: Column) -> Column:
    """Sections at most, 256 where the number of leaves is unknown."""
    return F.coalesce(_between(3 * leaves, 32, 256), F.lit(256).cast("bigint"))


def branch_target(leaves: Column) -> Column:
    return _between(F.floor(leaves / 4), 8, 256)


def content_dropped(size: Column, visible: Column) -> Column:
    """Whether an answer of ``size`` bytes is too short for its visible tokens' bytes."""
    return (visible >= 1000) & (size * 10 < visible * 12)


def reasoning_dominated(reasoning: Column, output: Column) -> Column:
    return reasoning * 100 >= output * 75


def packing_limit(context: Column, output: Column, safety: int, overhead: Column, density: int = 100, ceiling: int = 200_000) -> Column:
    """Bytes of evidence that fit a context window beside margin, output and overhead."""
    room = F.least(context, F.lit(ceiling))
    margin = F.ceil(room * min(safety, 90) / 100).cast("bigint")
    free = F.greatest(room - margin - output, F.lit(0)).cast("bigint")
    scaled = F.floor(F.floor(free * density / 100) * 100 / 125).cast("bigint")
    return F.greatest(scaled - overhead, F.lit(0)).cast("bigint")


def _valid(text: Column, start: Column, size: Column, step: int) -> Column:
    """The bytes from ``start`` (0-based), ``size`` long, without up to three bytes of a cut character at the front (step 1) or the end (step -1)."""
    data = text.cast("binary")
    tries = [F.substring(data, start + 1 + (k if step > 0 else 0), F.greatest(size - k, F.lit(0))).cast("string") for k in range(4)]
    return F.coalesce(*(F.when(F.is_valid_utf8(t), t) for t in tries))


def tail(text: Column, most: Column | int) -> Column:
    """The last ``most`` bytes, from the beginning of a character."""
    size = F.least(F.octet_length(text), F.lit(most) if isinstance(most, int) else most)
    return _valid(text, F.octet_length(text) - size, size, 1)


def excerpt(text: Column, limit: Column | int, gap: str = "\n[… excerpt …]\n") -> Column:
    """Head and tail of a text within ``limit`` bytes; empty if the gap alone does not fit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    room = (limit - len(gap.encode())).cast("int")
    head = F.floor(F.greatest(room, F.lit(0)) / 2).cast("int")
    both = F.concat(_valid(text, F.lit(0), head, -1), F.lit(gap), tail(text, F.greatest(room, F.lit(0)) - head))
    return F.when(F.octet_length(text) <= limit, text).when(room < 0, "").otherwise(both)


def without_overlap(text: Column, more: Column, least: int = 32, most: int = 8000) -> Column:
    """``more`` without the longest start, of ``least`` to ``most`` bytes, that ``text`` ends with; joined to ``text``."""
    # Only places where the end of the text has the first bytes of what follows are tried.
    end, key = F.right(text, F.lit(most)), F.left(more, F.lit(least // 4))
    sizes = F.sequence(F.least(F.length(end), F.length(more), F.lit(most)), F.lit(0), F.lit(-1))
    fits = F.filter(sizes, lambda n: (n > 0) & (F.substring(end, F.length(end) - n + 1, F.length(key)) == key) & (F.octet_length(F.left(more, n)) >= least) & (F.octet_length(F.left(more, n)) <= most) & end.endswith(F.left(more, n)))
    shared = F.coalesce(F.get(fits, F.lit(0)), F.lit(0))
    rest = F.substring(more, shared + 1, F.length(more))
    return F.when(shared > 0, F.concat(text, rest)).otherwise(F.concat(text, F.lit("\n\n"), more))


def planning_limit(room: Column, reductions: Column) -> Column:
    """Bytes of planning evidence: 48,000 at most, halved by every reduction."""
    return F.floor(F.least(room, F.lit(48_000)) / F.pow(F.lit(2), reductions)).cast("bigint")


def evidence_share(room: Column, failures: Column, mandatory: Column, branches: Column) -> Column:
    """What retrieved and branch passages of a section request each get: 80,000 bytes at most, halved by every failure, in equal shares."""
    base = F.floor(F.least(room, F.lit(80_000)) / F.pow(F.lit(2), failures))
    return F.floor(base / (1 + mandatory.cast("int") + branches.cast("int"))).cast("bigint")


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix of two strings; of a group's least and greatest, that of the group."""
    shared = F.aggregate(F.sequence(F.lit(0), F.least(F.length(low), F.length(high))), F.lit(0), lambda n, k: F.when(F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k), k).otherwise(n))
    return F.substring(low, F.lit(1), shared)
