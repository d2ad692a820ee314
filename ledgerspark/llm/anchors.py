"""Anchors: content-defined places that divide all windows of a text among them."""

from __future__ import annotations

import numpy as np

from .shingles import U, mixed

#: Bytes of an anchor's own string.
GRAM = 64
_RANDOM = np.random.Generator(np.random.PCG64(99)).integers(0, np.iinfo(U).max, 256, dtype=U)
_HASH_BITS = 36
#: An odd number and its inverse, for sums of powers over grams.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _INVERSE):
        steps = np.full(n, b, U)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=U))
    return out[0], out[1]


def window_anchors(raw: np.ndarray, offsets: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of every window of ``width`` bytes the anchor: the start of the gram with the least hash in it.

    Equal windows have equal anchors, and windows of one anchor are consecutive.
    Returned per anchor: text, the first and last window it owns (from the
    text's start), where in that stretch the anchor lies, the anchor's hash,
    and a hash of the anchor with the ``side`` bytes before and after it, 0
    where its windows don't reach that far. Every window reaches that far on one
    side at least, so equal windows have one of these hashes in common.
    """
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none, none.view(U), none.view(U), none.view(U)
    n = len(raw)
    if n < width:
        return nothing
    if n >= 1 << (64 - _HASH_BITS):
        raise ValueError("a block of texts is too long for anchors")
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_RANDOM[raw] * up[:n], out=total[1:])
    grams = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    span = width - gram + 1  # grams of a window
    keys = (grams >> U(64 - _HASH_BITS) << U(64 - _HASH_BITS)) | np.arange(len(grams), dtype=U)
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(U).max, U)
    padded[: len(keys)] = keys
    table = padded.reshape(-1, span)
    forth = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    least = (np.minimum(back[:windows], forth[span - 1 : span - 1 + windows]) & U((1 << (64 - _HASH_BITS)) - 1)).astype(np.int64)
    # Windows inside one text, cut where the anchor changes.
    inside = np.zeros(windows + 1, np.int32)
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths >= width)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - width + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return nothing
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    anchor = least[first]
    # Adjoining texts cannot share an anchor, for a window lies inside one text.
    text = np.searchsorted(offsets, first, "right") - 1
    end, side = last + width, (width - gram + 1) // 2
    low, high = np.maximum(anchor - side, 0), np.minimum(anchor + gram + side, n)
    before = mixed((total[anchor + gram] - total[low]) * down[low] + U(1)) | U(1)
    after = mixed((total[high] - total[anchor]) * down[anchor] + U(2)) | U(1)
    before[anchor - side < first] = 0
    after[anchor + gram + side > end] = 0
    return text, first - offsets[text], last - offsets[text], anchor - first, grams[anchor], before, after
