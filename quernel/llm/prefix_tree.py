"""A prefix tree over ordered sets, traversed with shared partial overlaps.

The sets' members are renamed in one global order, the most frequent first, so that like sets share
long paths. Chains are one node. A probe goes down level by level with all nodes of a level at once:
the overlap of a node's path is its parent's and its own, computed once for all sets below; a subtree
is pruned when even all that remains, of the probe and of the longest set below, cannot lift the
overlap to what the smallest set below would need.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quernel.llm.components import Forest


@dataclass
class PrefixTree:
    members: list[np.ndarray]  # of each set, renamed, ascending
    size: np.ndarray
    flat: np.ndarray  # the nodes' members one after another
    at: np.ndarray
    length: np.ndarray
    last: np.ndarray  # last member of each node
    below: np.ndarray  # longest rest of a set below the node
    least: np.ndarray  # size of the smallest set at or below the node
    first_child: np.ndarray
    n_children: np.ndarray
    children: np.ndarray
    ends: np.ndarray  # the set that ends at the node, or -1
    vocabulary: int


def build(sets: list[np.ndarray]) -> PrefixTree:
    """The tree of distinct, non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    members = [np.sort(m) for m in np.split(rank[inverse], np.cumsum(sizes)[:-1])]
    order = sorted(range(len(sets)), key=lambda i: members[i].astype(">u4").tobytes())

    segment: list[np.ndarray] = [np.zeros(0, np.int64)]
    parent, depth, ends = [-1], [0], [-1]
    stack, before = [0], np.zeros(0, np.int64)
    for i in order:
        s = members[i]
        n = min(len(s), len(before))
        differ = np.flatnonzero(s[:n] != before[:n])
        shared = int(differ[0]) if len(differ) else n
        popped = -1
        while depth[stack[-1]] > shared:
            popped = stack.pop()
        top = stack[-1]
        if depth[top] < shared:  # the path leaves in the middle of a chain
            split = shared - depth[top]
            segment.append(segment[popped][:split])
            parent.append(top)
            depth.append(shared)
            ends.append(-1)
            segment[popped], parent[popped] = segment[popped][split:], len(parent) - 1
            stack.append(len(parent) - 1)
        segment.append(s[shared:])
        parent.append(stack[-1])
        depth.append(len(s))
        ends.append(i)
        stack.append(len(parent) - 1)
        before = s

    up, deep, end = np.array(parent), np.array(depth), np.array(ends)
    below, least = np.zeros(len(up), np.int64), np.full(len(up), np.iinfo(np.int64).max)
    longest = deep.copy()
    for v in np.argsort(-deep, kind="stable").tolist():  # children are deeper than their parents
        if end[v] >= 0:
            least[v] = min(least[v], deep[v])
        below[v] = longest[v] - deep[v]
        p = up[v]
        if p >= 0:
            longest[p], least[p] = max(longest[p], longest[v]), min(least[p], least[v])
    children = np.argsort(up, kind="stable")[1:]  # the root comes first
    n_children = np.bincount(up[1:], minlength=len(up))
    length = np.array([len(x) for x in segment])
    return PrefixTree(
        members, sizes, np.concatenate(segment), np.cumsum(length) - length, length,
        np.array([x[-1] if len(x) else -1 for x in segment]), below, least,
        np.cumsum(n_children) - n_children, n_children, children, end, len(counts),
    )


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = np.cumsum(length)
    return np.arange(total[-1]) + np.repeat(start - total + length, length)


def similar(tree: PrefixTree, i: int, mark: np.ndarray, percent: int) -> np.ndarray:
    """The sets whose Jaccard similarity to set ``i`` is at least ``percent`` / 100, itself included.

    ``mark`` is a scratch array of ``vocabulary`` zeros; it is left as it was.
    """
    x = tree.members[i]
    n = len(x)
    mark[x] = 1
    found = []
    nodes = tree.children[: tree.n_children[0]]
    overlap = np.zeros(len(nodes), np.int64)
    while len(nodes):
        hit = mark[tree.flat[_ranges(tree.at[nodes], tree.length[nodes])]]
        overlap = overlap + np.add.reduceat(hit, np.cumsum(tree.length[nodes]) - tree.length[nodes], dtype=np.int64)
        # overlap / union >= percent / 100, in integers.
        left = n - np.searchsorted(x, tree.last[nodes], "right")
        reach = overlap + np.minimum(left, tree.below[nodes])
        going = reach * (100 + percent) >= percent * (n + tree.least[nodes])
        nodes, overlap = nodes[going], overlap[going]
        at = tree.ends[nodes]
        here = at >= 0
        ok = overlap[here] * (100 + percent) >= percent * (n + tree.size[at[here]])
        found.append(at[here][ok])
        count = tree.n_children[nodes]
        inner = count > 0
        nodes, overlap, count = nodes[inner], overlap[inner], count[inner]
        if len(nodes):
            overlap = np.repeat(overlap, count)
            nodes = tree.children[_ranges(tree.first_child[nodes], count)]
    mark[x] = 0
    return np.concatenate(found)


def links(sets: list[np.ndarray], percent: int, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what links of similar sets connect: one less than members for each component.

    Sets (those of ``probes``, or all) are probed until all are connected, so a tight group costs a few
    probes, not all pairs.
    """
    tree, forest, out = build(sets), Forest(), []
    mark = np.zeros(tree.vocabulary, np.int8)
    for i in range(len(sets)) if probes is None else probes:
        for j in similar(tree, i, mark, percent).tolist():
            if forest.join(i, j):
                out.append((i, j))
        if len(out) == len(sets) - 1:
            break
    return out
