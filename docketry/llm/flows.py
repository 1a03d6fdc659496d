"""Largest flows of least cost on the small graphs of quotas and patterns; their rows are sums that Spark made."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence


def cheapest_flow(arcs: Sequence[tuple[object, object, int, int]], source: object, sink: object) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of the largest flow that costs least.

    Path lengths only rise, so for each length that occurs all shortest paths are filled at once, by levels. Costs may be
    negative where no cycle of arcs is.
    """
    number: dict[object, int] = {}
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = []
    for a, b, capacity, price in arcs:
        for x in (a, b):
            if x not in number:
                number[x] = len(out)
                out.append([])
        out[number[a]].append(len(to))
        out[number[b]].append(len(to) + 1)
        to += [number[b], number[a]]
        room += [capacity, 0]
        cost += [price, -price]
    if source not in number or sink not in number:
        return [0] * len(arcs)
    first, last = number[source], number[sink]
    while True:
        far: list[int | None] = [None] * len(out)
        far[first], queue, queued = 0, deque([first]), [False] * len(out)
        while queue:  # costs may be negative on the way back, so nodes are looked at again when they get cheaper
            x = queue.popleft()
            queued[x] = False
            for i in out[x]:
                if room[i]:
                    y, d = to[i], far[x] + cost[i]
                    if far[y] is None or d < far[y]:
                        far[y] = d
                        if not queued[y]:
                            queued[y] = True
                            queue.append(y)
        if far[last] is None:
            return room[1::2]
        while _filled(first, last, out, to, room, cost, far):
            pass


def _filled(first: int, last: int, out: list[list[int]], to: list[int], room: list[int], cost: list[int], far: list[int | None]) -> bool:
    """Fills the paths of fewest arcs among the cheapest; whether there were any."""
    level = [-1] * len(out)
    level[first], queue = 0, deque([first])
    while queue:
        x = queue.popleft()
        for i in out[x]:
            y = to[i]
            if room[i] and level[y] < 0 and far[y] == far[x] + cost[i]:
                level[y] = level[x] + 1
                queue.append(y)
    if level[last] < 0:
        return False
    at, path = [0] * len(out), []
    x = first
    while True:
        if x == last:
            step = min(room[i] for i in path)
            for i in path:
                room[i] -= step
                room[i ^ 1] += step
            path, x = [], first
        while at[x] < len(out[x]):
            i = out[x][at[x]]
            y = to[i]
            if room[i] and level[y] == level[x] + 1 and far[y] == far[x] + cost[i]:
                break
            at[x] += 1
        else:
            if not path:
                return True
            x = to[path.pop() ^ 1]
            at[x] += 1
            continue
        path.append(i)
        x = y
