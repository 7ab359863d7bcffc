"""A small max-flow for labelling a sequence of blocks."""

from __future__ import annotations


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels that minimise the summed cost of the terminals and of separated edges.

    gain[i] > 0 is what it costs to label i False, gain[i] < 0 what it costs to label it True; (i, j, w) costs w where
    i and j differ. Dinic's algorithm; True are the nodes that the source still reaches, so ties give False."""
    n = len(gain)
    if not any(g > 0 for g in gain):
        return [False] * n
    if not any(g < 0 for g in gain):
        return [True] * n
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[int] = []
    for i, j, w in edges:
        if w > 0:
            head[i].append(len(to))
            to.append(j)
            cap.append(w)
            head[j].append(len(to))
            to.append(i)
            cap.append(w)
    left = [max(g, 0) for g in gain]
    room = [max(-g, 0) for g in gain]
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if left[i] > 0]
        for i in queue:
            level[i] = 0
        met = False
        for i in queue:
            if room[i] > 0:
                met = True
            for e in head[i]:
                j = to[e]
                if cap[e] > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not met:
            return [v >= 0 for v in level]
        arc = [0] * n
        for start in [i for i in range(n) if left[i] > 0]:
            path: list[int] = []
            at = start
            while left[start] > 0:
                if room[at] > 0:
                    push = min([left[start], room[at], *(cap[e] for e in path)])
                    left[start] -= push
                    room[at] -= push
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path, at = [], start
                    continue
                while arc[at] < len(head[at]):
                    e = head[at][arc[at]]
                    if cap[e] > 0 and level[to[e]] == level[at] + 1:
                        break
                    arc[at] += 1
                if arc[at] < len(head[at]):
                    path.append(head[at][arc[at]])
                    at = to[path[-1]]
                elif path:
                    e = path.pop()
                    at = to[e ^ 1]
                    arc[at] += 1
                else:
                    break
