"""Least-cost transport of whole units between places on a line, where part of the capacity may stay unused."""

from __future__ import annotations

import heapq


def used_capacity(places: list[tuple[int, int, int]]) -> list[int]:
    """How much of each place's capacity the best transport uses: sum of |from - to| over all units, least.

    places: (position, supply, capacity) by rising position, positions whole; the supplies are not more than the capacities.
    Units keep their order, so a map follows from the numbers used.

    The least cost as a function of the units carried past a place is convex and piecewise linear.  Its corners lie in two
    heaps, left and right of the minimum: a supply moves both, a capacity the left one, the way to the next place adds a corner
    at 0.  Then the carried units are read off backwards.  Some (places x log places) steps, all in whole numbers.
    """
    reach = 2 * (abs(places[-1][0] - places[0][0]) + 1) * (len(places) + 1) if places else 0
    left, right = [(0, reach)], [(0, reach)]  # (-corner, slope) and (corner, slope), without the moves
    to_left = to_right = 0
    least = []

    def move(source: list, target: list, slope: int, shift: int) -> None:
        """Take corners of this much slope from the top of source to target; the keys change sign and by shift."""
        while slope:
            key, have = heapq.heappop(source)
            take = min(have, slope)
            heapq.heappush(target, (-key + shift, take))
            if have > take:
                heapq.heappush(source, (key, have - take))
            slope -= take

    for i, (at, supply, capacity) in enumerate(places):
        least.append(-left[0][0] + to_left)  # units carried in, if nothing else mattered
        to_left += supply - capacity
        to_right += supply
        gap = places[i + 1][0] - at if i + 1 < len(places) else 0
        if gap:
            heapq.heappush(left, (to_left, gap))
            move(left, right, gap, to_left - to_right)
            heapq.heappush(right, (-to_right, gap))
            move(right, left, gap, to_left - to_right)
    used, carried = [0] * len(places), 0
    for i in range(len(places) - 1, -1, -1):
        _, supply, capacity = places[i]
        low = carried - supply
        before = min(max(least[i], low), low + capacity)
        used[i], carried = before - low, before
    return used
