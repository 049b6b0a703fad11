"""Deep-shallow sorting of strings of one width.

Shallow: multikey quicksort on characters of eight bytes, down to a set depth: a group is parted by
one character into what is smaller than, equal to and larger than a pivot, and only the equal part
goes on to the next character. Deep: strings that are still equal there are ordered by a blind trie, which looks at the bytes where strings part and
compares each string whole with one leaf only.
"""

from __future__ import annotations

import numpy as np

#: Bytes sorted by the multikey step.
SHALLOW = 16
#: Groups up to this size aren't parted any further.
SMALL_GROUP = 48


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix of strings of one width."""
    if a == b:
        return len(a)
    lo, hi = 0, len(a)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Inner nodes are [skip, {byte: node}], leaves lists of the numbers of equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, [0]
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s = self.strings[k]
        node = self.root
        while type(node) is tuple:  # blind: only branching bytes are looked at
            nxt = node[1].get(s[node[0]])
            node = next(iter(node[1].values())) if nxt is None else nxt
        leaf = node
        common = _common(s, self.strings[leaf[0]])
        if common == len(s):
            leaf.append(k)
            return
        node, above, key = self.root, None, 0
        while type(node) is tuple and node[0] < common:
            above, key = node, s[node[0]]
            node = node[1][key]
        if type(node) is tuple and node[0] == common:
            node[1][s[common]] = [k]
            return
        other = node
        while type(other) is tuple:
            other = next(iter(other[1].values()))
        split = (common, {self.strings[other[0]][common]: node, s[common]: [k]})
        if above is None:
            self.root = split
        else:
            above[1][key] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of characters (uint64), equal rows next to each other."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)] if words.shape[1] else []
    while stack:
        lo, hi, depth = stack.pop()
        group = order[lo:hi]
        if hi - lo <= SMALL_GROUP:  # few strings are put in order at once, from this character on
            order[lo:hi] = group[np.lexsort(words[group, depth:].T[::-1])]
            continue
        keys = words[group, depth]
        some = np.sort(keys[:: max(1, (hi - lo) // 99)])
        pivot = some[len(some) // 2]
        less, same = keys < pivot, keys == pivot
        a = lo + int(less.sum())
        b = a + int(same.sum())
        order[lo:hi] = np.concatenate([group[less], group[same], group[~less & ~same]])
        if a - lo > 1:
            stack.append((lo, a, depth))
        if hi - b > 1:
            stack.append((b, hi, depth))
        if b - a > 1 and depth + 1 < words.shape[1]:
            stack.append((a, b, depth + 1))
    return order


def sort_strings(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (uint8, one string each), and each row's common prefix with the one before it in that order."""
    n, width = rows.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    depth = min(shallow, width) // 8 * 8
    if depth:
        words = np.ascontiguousarray(rows[:, :depth]).view(">u8").astype(np.uint64)
        order = multikey_quicksort(words)
        tied = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    else:
        order, tied = np.arange(n), np.ones(n - 1, bool)
    edges = np.diff(np.concatenate([[0], tied.view(np.int8), [0]]))
    for lo, hi in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        group = order[lo : hi + 1]
        order[lo : hi + 1] = group[BlindTrie([r.tobytes() for r in rows[group, depth:]]).ordered()]
    lcp = np.zeros(n, np.int64)
    for lo in range(1, n, 50_000):
        a, b = rows[order[lo - 1 : lo + 49_999]], rows[order[lo : lo + 50_000]]
        apart = a[: len(b)] != b
        lcp[lo : lo + len(b)] = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    return order, lcp
