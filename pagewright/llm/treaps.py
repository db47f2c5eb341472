"""Inverted treaps of one block of documents, and the simultaneous traversal of several for the best documents.

A term's treap holds its postings: a search tree by document, a heap by impact (what the term adds to a document's
score). A traversal starts with one interval, all documents of the block, and the treap root of each term of the item.
The impacts of the topmost nodes inside an interval sum up to a bound on any score there; an interval whose bound lies
below the k-th best score is dropped with all its subtrees. Else the node of the largest impact gives a document, whose
score is found on the way down, and which splits the interval and every treap in two. Intervals are handled in numpy,
many at a time, so no step loops over documents in Python; a stack of bounded batches keeps memory bounded.
"""

from __future__ import annotations

import numpy as np

#: Cells (interval, term) that a batch has at most, unless one interval alone has more.
CELLS = 1 << 20


class InvertedTreaps:
    """Treaps over postings sorted by (term, document). left and right are postings, -1 for none."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        self.doc, self.impact = doc, impact
        n = len(term)
        first = np.flatnonzero(np.diff(term, prepend=-1)) if n else np.empty(0, np.int64)
        self.root: dict[int, int] = {}
        left, right = [-1] * (n + 1), [-1] * (n + 1)
        # equal impacts go by a scattered number, so that groups of copies stay shallow
        order = np.empty(n, np.int64)
        scattered = np.random.default_rng(0).permutation(int(doc.max(initial=-1)) + 1)[doc]
        order[np.lexsort((scattered, impact))] = np.arange(n)
        height, ends = order.tolist(), [*first[1:].tolist(), n][: len(first)]
        for t, a, b in zip(term[first].tolist(), first.tolist(), ends, strict=True):
            spine: list[int] = []  # the path from the root to the right
            for i in range(a, b):
                h, under = height[i], -1
                while spine and height[spine[-1]] < h:
                    under = spine.pop()
                left[i] = under
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            self.root[t] = spine[0]
        self.left, self.right = np.array(left[:n], np.int64), np.array(right[:n], np.int64)

    def topmost(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The topmost node with low < document < high in the subtree of each node."""
        out = node.copy()
        at = np.flatnonzero(out >= 0)
        while len(at):
            d = self.doc[out[at]]
            below, above = d <= low[at], d >= high[at]
            out[at[below]] = self.right[out[at[below]]]
            out[at[above]] = self.left[out[at[above]]]
            at = at[below | above]
            at = at[out[at] >= 0]
        return out

    def split(self, node: np.ndarray, low: np.ndarray, doc: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For treaps whose topmost node in (low, high) is `node`: the topmost ones in (low, doc) and (doc, high), and the impact at doc."""
        less, more, hit = np.full(len(node), -1), np.full(len(node), -1), np.zeros(len(node), np.int64)
        at = np.flatnonzero(node >= 0)
        here = node[at]
        while len(at):
            d = self.doc[here]
            met, under, over = d == doc[at], d < doc[at], d > doc[at]
            hit[at[met]] = self.impact[here[met]]
            # a node outside (low, high) is on the way only
            new = under & (less[at] < 0) & (d > low[at])
            less[at[new]] = here[new]
            new = over & (more[at] < 0) & (d < high[at])
            more[at[new]] = here[new]
            k = at[met]
            for side, child, lo, hi in ((less, self.left, low, doc), (more, self.right, doc, high)):
                open_ = side[k] < 0
                side[k[open_]] = self.topmost(child[here[met][open_]], lo[k[open_]], hi[k[open_]])
            here = np.where(under, self.right[here], self.left[here])
            going = ~met & (here >= 0)
            at, here = at[going], here[going]
        return less, more, hit


class Best:
    """The k best (score, doc_id) so far, smaller ids first among equals, unknown ids first of all."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.known = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def floor(self) -> int:
        """A score below this cannot enter."""
        return max(1, int(self.score[-1]) if len(self.score) == self.k else 1)

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        keep = score >= self.floor
        if keep.any():
            s, d, n = (np.append(x, y[keep]) for x, y in ((self.score, score), (self.doc, doc), (self.known, known)))
            order = np.lexsort((d, n, -s))[: self.k]
            self.score, self.doc, self.known = s[order], d[order], n[order]


def traverse(treaps: InvertedTreaps, terms: list[tuple[int, int]], doc_id: np.ndarray, known: np.ndarray, best: Best) -> int:
    """Puts the best documents for terms (term, times) into `best`; doc_id and known by document. Returns how many were scored."""
    roots = [(treaps.root[t], k) for t, k in terms if t in treaps.root]
    if not roots:
        return 0
    times = np.array([k for _, k in roots])
    stack = [(np.array([[r for r, _ in roots]]), np.array([-1]), np.array([len(doc_id)]))]
    scored = 0
    while stack:
        top, low, high = stack.pop()
        value = np.where(top >= 0, treaps.impact[top], 0) * times
        bound = value.sum(1)
        keep = bound >= best.floor
        if not keep.any():
            continue
        top, low, high, value, bound = top[keep], low[keep], high[keep], value[keep], bound[keep]
        most = max(1, CELLS // len(times))
        if len(low) > most:  # the most promising first
            order = np.argsort(-bound, kind="stable")
            for k in reversed(range(0, len(low), most)):
                part = order[k : k + most]
                stack.append((top[part], low[part], high[part]))
            continue
        doc = treaps.doc[top[np.arange(len(top)), value.argmax(1)]]
        wide = lambda x: np.repeat(x, len(times))
        less, more, hit = treaps.split(top.ravel(), wide(low), wide(doc), wide(high))
        best.add((hit.reshape(top.shape) * times).sum(1), doc_id[doc], known[doc])
        scored += len(doc)
        stack.append((np.vstack([less.reshape(top.shape), more.reshape(top.shape)]), np.concatenate([low, doc]), np.concatenate([doc, high])))
    return scored
