"""Shortest edit scripts between the lines of two texts, for Arrow batches of pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence


def near(x: str, y: str, most: int) -> bool:
    """Whether at most ``most`` edits of a character lead from one line to the other; only a band of the table is filled."""
    if x == y:
        return True
    if most == 0 or abs(len(x) - len(y)) > most:
        return False
    far = most + 1
    before = [min(k, far) for k in range(len(y) + 1)]
    for i, c in enumerate(x, 1):
        row = [far] * (len(y) + 1)
        if i <= most:
            row[0] = i
        for k in range(max(1, i - most), min(len(y), i + most) + 1):
            row[k] = min(before[k - 1] + (c != y[k - 1]), before[k] + 1, row[k - 1] + 1, far)
        before = row
    return before[-1] <= most


def script(a: Sequence[str], b: Sequence[str], same: Callable[[str, str], bool]) -> list[str]:
    """``-i`` for each line of ``a`` that goes and ``+j`` for each line of ``b`` that comes, in order, numbers from 1.

    The script is one of the shortest; among those it matches as early as it can and removes before it adds. The distance
    to the end is searched backwards along diagonals: ``reach[d]`` has, for each diagonal, how far to the front ``d``
    edits lead, so time goes with the lines times the edits and memory with the square of the edits.
    """
    n, m = len(a), len(b)

    def slide(x: int, k: int) -> int:
        while x > 0 and x > k and same(a[x - 1], b[x - k - 1]):
            x -= 1
        return x

    reach = [{n - m: slide(n, n - m)}]
    while reach[-1].get(0) != 0:
        last, now = reach[-1], {}
        for k in {d + s for d in last for s in (-1, 1)}:
            ways = []
            if (x := last.get(k + 1)) is not None and x > 0:
                ways.append(x - 1)
            if (x := last.get(k - 1)) is not None and x - k >= 0:
                ways.append(x)
            if ways:
                now[k] = slide(min(ways), k)
        for k, x in last.items():
            now[k] = min(x, now.get(k, x))
        reach.append(now)
    out, i, j, left = [], 0, 0, len(reach) - 1
    while i < n or j < m:
        if i < n and j < m and same(a[i], b[j]):
            i, j = i + 1, j + 1
            continue
        left -= 1
        if i < n and reach[left].get(i + 1 - j, n + 1) <= i + 1:
            i += 1
            out.append(f"-{i}")
        else:
            j += 1
            out.append(f"+{j}")
    return out
