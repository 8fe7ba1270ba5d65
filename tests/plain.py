"""Plain ways of what the library does otherwise."""

import math


def capsule_interval(p, q, a, b, r: float):
    """Part of segment pq (as fractions of it) that is within ``r`` of segment ab; None if nothing is. Distance to a segment is convex, so this is one interval."""
    ux, uy = q[0] - p[0], q[1] - p[1]

    def dist(t):
        x, y = p[0] + t * ux, p[1] + t * uy
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        k = min(1.0, max(0.0, ((x - a[0]) * dx + (y - a[1]) * dy) / n)) if n > 0 else 0.0
        return math.hypot(x - a[0] - k * dx, y - a[1] - k * dy)

    lo, hi = 0.0, 1.0
    for _ in range(80):  # the least distance, by thirds
        m1, m2 = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        if dist(m1) <= dist(m2):
            hi = m2
        else:
            lo = m1
    t = (lo + hi) / 2
    if dist(t) > r:
        return None

    def edge(inside, outside):
        if dist(outside) <= r:
            return outside
        for _ in range(60):
            mid = (inside + outside) / 2
            inside, outside = (mid, outside) if dist(mid) <= r else (inside, mid)
        return inside

    return edge(t, 0.0), edge(t, 1.0)
