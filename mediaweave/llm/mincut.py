"""Minimum cuts of small undirected graphs with terminals (Dinic's blocking flows)."""

from __future__ import annotations


def source_side(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut.

    ``terminals``: capacity from the source if positive, to the sink if negative; a node's two capacities only matter by their
    difference.  ``edges``: (a, b, capacity) in both directions.  Of several minimum cuts, the one with the fewest nodes at
    the source is taken.
    """
    n = len(terminals)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for v, c in enumerate(terminals):
        if c > 0:
            link(source, v, c, 0)
        elif c < 0:
            link(v, sink, -c, 0)
    for a, b, c in edges:
        if c > 0 and a != b:
            link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        reached = [source]
        for v in reached:
            for e in out[v]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    reached.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if not room[e] and not cut:
                        cut = k + 1
                # go on from the first edge that is full now
                v = to[path[cut - 1] ^ 1]
                del path[cut - 1 :]
                continue
            while tried[v] < len(out[v]):
                e = out[v][tried[v]]
                if room[e] > 0 and level[to[e]] == level[v] + 1:
                    break
                tried[v] += 1
            if tried[v] < len(out[v]):
                path.append(out[v][tried[v]])
                v = to[path[-1]]
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                tried[v] += 1
            else:
                break
