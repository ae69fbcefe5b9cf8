"""A whole context tree in memory, which the tests hold the tables of the operator against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tillscope.llm.context_tree import bit_nodes, kt


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream(words: list[bytes]) -> bytes:
    return b"".join((b" ".join(words), b" \n" if words else b"\n"))


@dataclass
class Tree:
    """The frozen mixture in memory, which the tests hold the tables against: per depth, sorted grams with log10 of their byte's probability, and sorted bit nodes
    (context, then the byte's first bits after a leading one) with the probability of a one."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    nodes: list[tuple[np.ndarray, np.ndarray]]

    @property
    def depth(self) -> int:
        return len(self.nodes) - 1

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each key, bit by bit, each by its deepest known context."""
        total, symbol = np.zeros(len(keys)), keys & np.uint64(255)
        for k in range(8):
            prefix = np.uint64(1 << k) | symbol >> np.uint64(8 - k)
            one = np.full(len(keys), 0.5)
            open_ = np.arange(len(keys))
            for d in range(self.depth, -1, -1):
                known, p = self.nodes[d]
                if not len(known) or not len(open_):
                    continue
                context = keys[open_] >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)
                node = context << np.uint64(8) | prefix[open_]
                at = np.minimum(np.searchsorted(known, node), len(known) - 1)
                hit = known[at] == node
                one[open_[hit]] = p[at[hit]]
                open_ = open_[~hit]
            bit = (symbol >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            total += np.log10(np.where(bit, one, 1 - one))
        return total

    def log10(self, keys: np.ndarray) -> np.ndarray:
        known, value = self.grams[self.depth]
        if not len(known):
            return self.bits(keys)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = value[at]
        rare = np.flatnonzero(known[at] != keys)
        if len(rare):
            distinct, back = np.unique(keys[rare], return_inverse=True)
            out[rare] = self.bits(distinct)[back]
        return out


def grow(counts: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The mixture from the counts of grams of 1, 2, ... bytes."""
    nodes = []
    for keys, n in counts:
        node, zeros, ones = bit_nodes(keys, n)
        nodes.append((node, zeros.astype(float), ones.astype(float)))
    depth = len(nodes) - 1
    parents: list[np.ndarray] = [np.empty(0, int)]
    for d in range(1, depth + 1):
        shorter = nodes[d][0] & np.uint64((1 << 8 * d) - 1)
        at = np.minimum(np.searchsorted(nodes[d - 1][0], shorter), max(len(nodes[d - 1][0]) - 1, 0))
        parents.append(np.where(nodes[d - 1][0][at] == shorter, at, -1) if len(nodes[d - 1][0]) else np.full(len(shorter), -1))
    # From the leaves: the weight of a node's own estimate against that of its children.
    own: list[np.ndarray] = [np.empty(0)] * (depth + 1)
    below = None
    for d in range(depth, -1, -1):
        _, a, b = nodes[d]
        estimate = kt(a, b)
        if d == depth:
            own[d], mixed = np.ones(len(a)), estimate
        else:
            fit = parents[d + 1] >= 0
            at = parents[d + 1][fit]
            add = lambda v: np.bincount(at, v[fit], len(a)) if len(a) else np.zeros(0)
            children, left_a, left_b = add(below), a - add(nodes[d + 1][1]), b - add(nodes[d + 1][2])
            inner = np.bincount(at, minlength=len(a)) > 0
            # What dropped children held is coded here.
            split = children + kt(np.maximum(left_a, 0), np.maximum(left_b, 0))
            mixed = np.where(inner, np.logaddexp(estimate, split) - np.log(2), estimate)
            own[d] = np.where(inner, np.exp(estimate - np.log(2) - mixed), 1.0)
        below = mixed
    # From the root: what the shorter contexts put in, and what they leave to the longer ones.
    final, put, left = [], None, None
    for d, (found, a, b) in enumerate(nodes):
        one = (b + 0.5) / (a + b + 1)
        if d == 0:
            before, rest = np.zeros(len(found)), np.ones(len(found))
        else:
            known = parents[d] >= 0
            before, rest = np.where(known, put[parents[d]], 0.0), np.where(known, left[parents[d]], 1.0)
        final.append((found, before + rest * one))
        put, left = before + rest * own[d] * one, rest * (1 - own[d])
    tree = Tree([], final)
    tree.grams = [(counts[d][0], Tree([], final[: d + 1]).bits(counts[d][0])) for d in range(depth + 1)]
    return tree
