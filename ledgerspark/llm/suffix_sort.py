"""External induced sorting of suffixes with common-prefix values.

The text is a sequence of small integers. Suffixes of local minima (S*) are
named by their substrings, sorted by recursion on the names, and induce the
order of all descending (L) suffixes, which induce that of all ascending (S)
ones. Order is kept by priority queues whose tuples carry the suffix and its
longest common prefix with the one before; a tuple's priority is its first
symbol and then the order of arrival, so a queue is a first-in-first-out spool
per symbol. Spools go to unlinked temporary files when their buffers are full.
Common prefixes of induced neighbours are one more than the least common prefix
between their sources, cut off at ``cap``.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Callable

import numpy as np

#: Tuples handled at once, bytes of buffers before they go to disk, and names sorted in memory.
BLOCK = 1 << 20
BUFFER = 64 << 20
IN_MEMORY = 1 << 22

TUPLE = np.dtype([("at", np.int64), ("lcp", np.int32)])


class Spools:
    """First-in-first-out queues of tuples by symbol, on disk beyond a bounded buffer."""

    def __init__(self, buffer: int = BUFFER) -> None:
        self.buffer, self.held = buffer, 0
        self.parts: dict[int, list] = defaultdict(list)
        self.file = None

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        part = np.empty(len(at), TUPLE)
        part["at"], part["lcp"] = at, lcp
        self.parts[symbol].append(part)
        self.held += part.nbytes
        if self.held > self.buffer:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for k, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[k] = (self.file.tell(), len(part))
                    self.file.write(part.tobytes())
        self.held = 0

    def take(self, symbol: int, last: bool = False) -> np.ndarray | None:
        """The next tuples of a symbol (the last ones, if ``last``), about a block."""
        parts = self.parts.get(symbol)
        got, size = [], 0
        while parts and (size < BLOCK or not got):
            part = parts.pop() if last else parts.pop(0)
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(part[1] * TUPLE.itemsize), TUPLE)
            else:
                self.held -= part.nbytes
            got.append(part)
            size += len(part)
        if not got:
            return None
        return np.concatenate(got[::-1] if last else got)


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one (type S). The end is the least of all."""
    n = len(text)
    out = np.zeros(n, bool)
    if n > 1:
        change = np.flatnonzero(text[1:] != text[:-1])
        ends = np.append(change, n - 1)
        up = np.append(text[change] < text[change + 1], False)
        out[:] = np.repeat(up, np.diff(np.append(-1, ends)))
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """The common prefixes of suffix pairs, ``cap`` at most."""
    n, out, live = len(text), np.zeros(len(a), np.int32), np.arange(len(a))
    wide = text.astype(np.uint16) if text.dtype.itemsize <= 2 else None
    step = 4 if wide is not None else 1
    if wide is not None:  # four symbols at a time
        padded = np.concatenate([wide, np.zeros(4, np.uint16)])
        words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 1, 8), (2, 1))
    at = 0
    while len(live) and at < cap:
        x, y = a[live] + at, b[live] + at
        fits = np.maximum(x, y) + step <= n
        if wide is not None:
            same = np.zeros(len(live), bool)
            same[fits] = np.ascontiguousarray(words[x[fits]]).view(np.uint64)[:, 0] == np.ascontiguousarray(words[y[fits]]).view(np.uint64)[:, 0]
        else:
            same = np.zeros(len(live), bool)
            same[fits] = text[x[fits]] == text[y[fits]]
        stop = live[~same]
        if len(stop):  # the rest symbol by symbol
            run, u, v = stop, a[stop] + at, b[stop] + at
            for k in range(step):
                ok = (np.maximum(u, v) + k < n)
                ok[ok] = text[u[ok] + k] == text[v[ok] + k]
                run, u, v = run[ok], u[ok], v[ok]
                out[run] = at + k + 1
        live = live[same]
        at += step
        out[live] = at
    return np.minimum(out, cap)


def _names(text: np.ndarray, up: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The rank of each S* substring (equal ones the same), by symbol and type, several symbols a word."""
    n, m = len(text), len(stars)
    bits = int(2 * int(text.max()) + 2).bit_length()
    per = max(1, 63 // bits)
    length = np.append(np.diff(stars) + 1, n - stars[-1] + 1)
    name = np.zeros(m, np.int64)
    live, word = np.arange(m), 0
    while len(live):
        key = np.zeros(len(live), np.uint64)
        for k in range(per):
            at = stars[live] + word * per + k
            inside = (word * per + k < length[live]) & (at < n)
            at = np.where(inside, at, 0)
            key = key << np.uint64(bits) | np.where(inside, 2 * text[at].astype(np.int64) + up[at] + 1, 0).astype(np.uint64)
        order = np.lexsort((key, name[live]))
        who, key = live[order], key[order]
        group = name[who]
        new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        start = np.flatnonzero(new)
        # A name is the place of a group's first member; subgroups move on within it.
        base = np.append(True, group[1:] != group[:-1])
        shift = np.arange(len(who)) - np.maximum.accumulate(np.where(base, np.arange(len(who)), 0))
        name[who] = group + np.repeat(shift[start], np.diff(np.append(start, len(who))))
        size = np.repeat(np.diff(np.append(start, len(who))), np.diff(np.append(start, len(who))))
        word += 1
        live = who[(size > 1) & (length[who] > word * per)]
    return name


def _by_doubling(names: np.ndarray, depth: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of a short sequence in order, in memory; ``depth``: names that matter, all if None.

    After the order the ranks by the first 1, 2, 4, ... names, equal where those are."""
    n = len(names)
    order = np.argsort(names)
    rank, live, step = np.empty(n, np.int64), order, 1
    new = np.append(True, names[order][1:] != names[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks = [rank.astype(np.int32)]
    while step < (depth or n):
        size = np.bincount(rank, minlength=n)
        live = live[size[rank[live]] > 1]
        if not len(live):
            break
        after = np.where(live + step < n, rank[np.minimum(live + step, n - 1)], -1)
        live = live[np.argsort(rank[live] * (n + 1) + after + 1)]
        after, group = np.where(live + step < n, rank[np.minimum(live + step, n - 1)], -1), rank[live]
        base = np.append(True, group[1:] != group[:-1])
        new = base | np.append(True, after[1:] != after[:-1])
        places = np.arange(len(live))
        rank[live] = group + np.maximum.accumulate(np.where(new, places, 0)) - np.maximum.accumulate(np.where(base, places, 0))
        ranks.append(rank.astype(np.int32))
        step *= 2
    return np.argsort(rank), ranks


def _common_by_ranks(text: np.ndarray, stars: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], cap: int) -> np.ndarray:
    """The common prefixes of neighbouring S* suffixes: by names as far as those are equal, then by symbols."""
    n = len(stars)
    a, b = order[:-1].copy(), order[1:].copy()
    start = stars[a]
    for k in range(len(ranks) - 1, -1, -1):
        same = np.flatnonzero((np.maximum(a, b) < n) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)]))
        a[same] += 1 << k
        b[same] += 1 << k
    # Past the last name there is none to compare; no pair gets there, for the last name occurs once.
    out = np.minimum(stars[a] - start, cap).astype(np.int32)
    rest = np.flatnonzero(out < cap)
    out[rest] = np.minimum(out[rest] + common_prefix(text, stars[a[rest]], stars[b[rest]], cap), cap)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order."""
    out: list[np.ndarray] = []
    induced_order(text, 1, lambda at, lcp: out.append(at.copy()))
    return np.concatenate(out)[::-1] if out else np.zeros(0, np.int64)


class _Inducer:
    """Turns a scan of sorted suffixes into queues of their predecessors, with common prefixes."""

    def __init__(self, text: np.ndarray, up: np.ndarray, want_up: bool, symbols: int, cap: int, queues: Spools) -> None:
        self.text, self.up, self.want_up, self.cap, self.queues = text, up, want_up, cap, queues
        self.since = np.full(symbols, 0, np.int32)  # least common prefix since the last tuple of each symbol
        self.fresh = np.ones(symbols, bool)

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Takes the next suffixes of the scan; lcp: with the one before."""
        if not len(at):
            return
        before = at - 1
        ok = before >= 0
        safe = np.where(ok, before, 0)
        ok &= self.up[safe] == self.want_up
        who = np.flatnonzero(ok)
        whole = int(lcp.min())
        if not len(who):
            np.minimum(self.since, whole, out=self.since)
            return
        symbol = self.text[before[who]]
        order = np.argsort(symbol, kind="stable")
        who, symbol = who[order], symbol[order]
        first = np.append(True, symbol[1:] != symbol[:-1])
        starts = np.flatnonzero(first)
        # Least of lcp over (previous of the symbol, this one], from a table of powers of two.
        low = np.where(first, 0, np.append(0, who[:-1] + 1))
        value = _range_min(lcp, low, who)
        kinds = symbol[starts]
        value[starts] = np.where(self.fresh[kinds], -1, np.minimum(value[starts], self.since[kinds]))
        np.minimum(self.since, whole, out=self.since)
        ends = np.append(starts[1:], len(who)) - 1
        tail = who[ends] + 1
        left = np.full(len(kinds), self.cap, np.int32)
        some = tail < len(lcp)
        if some.any():
            left[some] = _range_min(lcp, tail[some], np.full(some.sum(), len(lcp) - 1))
        self.since[kinds] = left
        self.fresh[kinds] = False
        value = np.minimum(value + 1, self.cap)
        places = before[who]
        for s, a, b in zip(kinds.tolist(), starts.tolist(), (ends + 1).tolist()):
            self.queues.put(s, places[a:b], value[a:b])


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], ends included, of each pair."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int32)
    table, k = values.astype(np.int32), 0
    top = int(level.max())
    while True:
        own = level == k
        if own.any():
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
        if k == top:
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def _run(text: np.ndarray, at: int, cap: int) -> int:
    """How often the symbol at a place repeats from there, ``cap`` at most."""
    part = text[at : at + cap]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induced_order(
    text: np.ndarray, cap: int, visit: Callable[[np.ndarray, np.ndarray], None], buffer: int = BUFFER, in_memory: int = IN_MEMORY, depth: int | None = None
) -> None:
    """Calls ``visit(suffixes, common prefixes)`` for all suffixes from the greatest to
    the least, in blocks; a common prefix is with the suffix visited before.

    ``depth``: suffixes alike in so many symbols may stand in any order."""
    n = len(text)
    if not n:
        return
    symbols = int(text.max()) + 1
    up = ascending(text)
    stars = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(stars):
        names, ranks = _names(text, up, stars), None
        if len(np.unique(names)) == len(names):
            order = np.argsort(names)
        elif len(names) <= in_memory:
            order, ranks = _by_doubling(names, depth and -(-depth // 2))  # a name is two symbols at least
        else:
            dense = np.unique(names, return_inverse=True)[1] + 1
            parts: list[np.ndarray] = []
            induced_order(dense, 1, lambda at, lcp: parts.append(at.copy()), buffer, in_memory, depth)
            order = np.concatenate(parts)[::-1]
        common = _common_by_ranks(text, stars, order, ranks, cap) if ranks else common_prefix(text, stars[order[:-1]], stars[order[1:]], cap)
        stars, star_lcp = stars[order], np.append(np.int32(0), common)
        del names, ranks, common
        star_symbol = text[stars].astype(np.int64)
    else:
        star_lcp, star_symbol = np.zeros(0, np.int32), np.zeros(0, np.int64)
    bounds = np.searchsorted(star_symbol, np.arange(symbols + 1))

    # Descending suffixes, from the least: the empty suffix first, then by symbol the
    # descending ones as they arrive and the S* ones.
    queues, kept = Spools(buffer), Spools(buffer)
    down = _Inducer(text, up, False, symbols, cap, queues)
    down.scan(np.array([n]), np.array([0], np.int32))
    for s in range(symbols):
        last = -1
        start = True
        while (part := queues.take(s)) is not None:
            at, lcp = part["at"], part["lcp"].copy()
            if start:
                lcp[0], start = 0, False
            kept.put(s, at, lcp)
            down.scan(at, lcp)
            last = int(at[-1])
        for a in range(int(bounds[s]), int(bounds[s + 1]), BLOCK):
            b = min(a + BLOCK, int(bounds[s + 1]))
            lcp = star_lcp[a:b].copy()
            if a == bounds[s]:
                lcp[0] = 0 if last < 0 else min(_run(text, last, cap), _run(text, int(stars[a]), cap))
            down.scan(stars[a:b], lcp)

    # All suffixes, from the greatest: by symbol the ascending ones as they arrive, then
    # the descending ones backwards.
    queues = Spools(buffer)
    climb = _Inducer(text, up, True, symbols, cap, queues)
    for s in range(symbols - 1, -1, -1):
        last = -1
        start = True
        while (part := queues.take(s)) is not None:
            at, lcp = part["at"], part["lcp"].copy()
            if start:
                lcp[0], start = 0, False
            visit(at, lcp)
            climb.scan(at, lcp)
            last = int(at[-1])
        after = None  # common prefix of the block's greatest with the one before it in this scan
        while (part := kept.take(s, last=True)) is not None:
            at = part["at"][::-1]
            if after is None:
                after = 0 if last < 0 else min(_run(text, last, cap), _run(text, int(at[0]), cap))
            lcp = np.append(np.int32(after), part["lcp"][::-1][:-1])
            after = int(part["lcp"][0])
            visit(at, lcp)
            climb.scan(at, lcp)


def repeated_windows(text: np.ndarray, width: int, buffer: int = BUFFER) -> np.ndarray:
    """Which suffixes share their first ``width`` symbols with another one."""
    out = np.zeros(len(text), bool)
    before = [-1]

    def visit(at: np.ndarray, lcp: np.ndarray) -> None:
        hit = np.flatnonzero(lcp >= width)
        out[at[hit]] = True
        inner = hit[hit > 0]
        out[at[inner - 1]] = True
        if len(hit) and hit[0] == 0:
            out[before[0]] = True
        before[0] = int(at[-1])

    induced_order(text, width, visit, buffer, depth=width)
    return out
