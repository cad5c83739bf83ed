import math
import random
from collections import defaultdict

from calathea.operators import mapclusters

SCHEMA = "k long, lat double, lon double"


def model(points, low, high, radius=88, extent=512, least=3):
    """Cells, hubs and clusters of one zoom after another, in plain lists."""
    items = []
    for k, a, b in points:
        if None in (k, a, b):
            continue
        s = math.sin(math.radians(max(-mapclusters.EDGE, min(mapclusters.EDGE, a))))
        items.append((k, b / 360 + 0.5, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi, 1))
    out, parents = {}, {}
    for zoom in range(high, low - 1, -1):
        r = radius / (extent * 2**zoom)
        cells = defaultdict(list)
        for it in items:
            cells[math.floor(it[1] / r), math.floor(it[2] / r)].append(it)
        centre = lambda own: (sum(i[1] * i[3] for i in own) / sum(i[3] for i in own), sum(i[2] * i[3] for i in own) / sum(i[3] for i in own), sum(i[3] for i in own))
        info = {c: (*centre(own), min(i[0] for i in own)) for c, own in cells.items()}
        rank = lambda c: (-info[c][2], info[c][3])
        near = {c: [d for d in info if d != c and (info[c][0] - info[d][0]) ** 2 + (info[c][1] - info[d][1]) ** 2 <= r * r] for c in info}
        hub, open_ = {}, set(info)
        while open_:
            hubs = {c for c in open_ if all(rank(c) < rank(d) for d in near[c] if d in open_)}
            for c in open_:
                mine = [c] if c in hubs else [d for d in near[c] if d in hubs]
                if mine:
                    hub[c] = min(mine, key=rank)
            open_ -= set(hub)
        groups = defaultdict(list)
        for c, own in cells.items():
            groups[hub[c]] += own
        after = []
        for own in groups.values():
            if sum(i[3] for i in own) >= least:
                x, y, n = centre(own)
                k = min(i[0] for i in own)
                after.append((k, x, y, n))
                parents.update({(zoom + 1, i[0]): k for i in own})
            else:
                after += own
                parents.update({(zoom + 1, i[0]): i[0] for i in own})
        items = after
        out.update({(zoom, i[0]): i for i in items})
    return sorted((z, k, i[3], parents.get((z, k)) if z > low else None) for (z, k), i in out.items())


def world(seed, n=250):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice([48.2, 40.4, -33.9]) + rnd.gauss(0, 0.4), rnd.choice([16.4, -3.7, 151.2]) + rnd.gauss(0, 0.4)) for k in range(n)]
    rows += [(1000 + k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(60)] + [(2000 + k, 48.2, 16.37) for k in range(40)]
    return rows + [(None, 1.0, 1.0), (5000, None, 1.0), (5001, 1.0, None), (5002, 90.0, 0.0), (5003, -90.0, 10.0)]


def test_against_plain_lists(spark):
    rows = world(1)
    found = mapclusters.pyramid(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", 2, 6).collect()
    assert sorted((r.zoom, r.id, r.n, r.parent) for r in found) == model(rows, 2, 6)


def test_totals_parents_and_centres(spark):
    rows = world(2, 120)
    found = mapclusters.pyramid(spark.createDataFrame(rows, SCHEMA), "k", 1, 4).collect()
    total = sum(None not in r for r in rows)
    by = defaultdict(dict)
    for r in found:
        by[r.zoom][r.id] = r
    for zoom, items in by.items():
        assert sum(r.n for r in items.values()) == total
        assert all(r.n == 1 or r.n >= 3 for r in items.values())
        if zoom > 1:
            held = defaultdict(int)
            for r in items.values():
                held[r.parent] += r.n
            assert held == {k: r.n for k, r in by[zoom - 1].items()}
    point = next(r for r in by[4].values() if r.n == 1 and abs(r.lat) < 80)
    assert math.isclose(point.lat, next(x[1] for x in rows if x[0] == point.id), abs_tol=1e-9)


def test_nothing(spark):
    assert mapclusters.pyramid(spark.createDataFrame([], SCHEMA), "k", 0, 1).count() == 0
