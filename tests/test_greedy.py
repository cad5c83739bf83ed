import random

import pytest

from calathea.operators import assets, greedy

PAIRS = "g int, a int, b int, cost int, o int"


def model(pairs):
    """One after another."""
    taken, out = set(), []
    for g, o, a in sorted({(g, o, a) for g, a, _, _, o in pairs}):
        free = sorted((c, b) for h, x, b, c, _ in pairs if (h, x) == (g, a) and (g, b) not in taken)
        if free:
            taken.add((g, free[0][1]))
            out.append((a, free[0][1], free[0][0]))
    return sorted(out)


@pytest.mark.parametrize("rounds", [0, 1, 3, 50])
def test_one_to_one_against_one_after_another(spark, rounds):
    rnd = random.Random(1)
    pairs = []
    for g in range(6):
        order = {a: rnd.randrange(20) for a in range(15)}
        pairs += [(g, 100 * g + a, 100 * g + b, rnd.randrange(9), order[a]) for a in range(15) for b in range(12) if rnd.random() < 0.4]
    # a crowd that wants the same
    pairs += [(9, 900 + a, 900 + b, b, a) for a in range(20) for b in range(18)]
    found = greedy.one_to_one(spark.createDataFrame(pairs, PAIRS).repartition(3), "g", "a", "b", "cost", "o", rounds)
    assert sorted(map(tuple, found.collect())) == model(pairs)


def test_one_to_one_of_nothing(spark):
    assert greedy.one_to_one(spark.createDataFrame([], PAIRS), "g", "a", "b", "cost", "o").count() == 0


def test_live_pairs_by_days(spark):
    """Stems that many share, times missing on either side, a single still at any time."""
    day, rnd = 86_400, random.Random(2)
    rows = [(k, None, f"HOT{'_HEVC.MOV' if k % 2 else '.HEIC'}", "MOV" if k % 2 else "HEIC", rnd.choice([None, *range(0, 40 * day, 7_000)]), True) for k in range(80)]
    rows += [(100, None, "ONE.HEIC", "HEIC", 0, True), (101, None, "ONE_HEVC.MOV", "MOV", 30 * day, True), (102, "u", "X.HEIC", "HEIC", 0, True), (103, "u", "Y.MOV", "MOV", 9, True)]
    frame = spark.createDataFrame(rows, "id int, uuid string, name string, kind string, ts long, live boolean")
    found = assets.live_pairs(frame, "id", "uuid", "name", "kind", "ts", "live").collect()
    hot = [r for r in rows if r[2].startswith("HOT")]
    pairs = [(0, m[0], s[0], abs(m[4] - s[4]) if None not in (m[4], s[4]) else 0, m[0]) for m in hot if m[3] == "MOV" for s in hot if s[3] == "HEIC"]
    want = [(b, a) for a, b, _ in model([p for p in pairs if p[3] <= day])] + [(100, 101), (102, 103)]
    assert sorted((r.still, r.mov) for r in found) == sorted(want)


def test_place_clusters_against_one_after_another(spark):
    import math

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    rnd = random.Random(5)
    cells = [(g, 40 + rnd.randrange(60) * 0.005, -3 + rnd.randrange(60) * 0.005, rnd.randrange(1, 9)) for g in range(4) for _ in range(90)] + [(0, None, 1.0, 5), (0, 1.0, 1.0, 0)]
    want = []
    for g in range(4):
        places = []
        for n, a, b in sorted((-n, a, b) for h, a, b, n in cells if h == g and a is not None and n > 0):
            home = next((p for p in places if km(p[1], p[2], a, b) <= 2.0), None)
            if home is None:
                places.append([-n, a, b])
            else:
                home[1:] = [(home[1] * home[0] - a * n) / (home[0] - n), (home[2] * home[0] - b * n) / (home[0] - n)]
                home[0] -= n
        best = [places[i] for i in sorted(range(len(places)), key=lambda i: (-places[i][0], i))][:12]
        want += [(g, k + 1, round(p[1], 9), round(p[2], 9), p[0]) for k, p in enumerate([p for p in best if p[0] >= 3][:6])]
    frame = spark.createDataFrame(cells, "g int, lat double, lon double, n int")
    found = greedy.place_clusters(frame, "g")
    assert sorted((r.g, r.place, round(r.lat, 9), round(r.lon, 9), r.n) for r in found.collect()) == want
