import math

import pytest
from pyspark.sql import functions as F

from terrapulse.functions import geodesy


def inverse(lat1, lon1, lat2, lon2):
    """Vincenty's inverse formula iterated to convergence."""
    f, a = geodesy.WGS84_F, geodesy.WGS84_A
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    length = lam = math.radians(lon2 - lon1)
    for _ in range(100):
        ss = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if ss == 0:
            return 0.0
        cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sig = math.atan2(ss, cs)
        sa = math.cos(u1) * math.cos(u2) * math.sin(lam) / ss
        c2a = 1 - sa**2
        c2m = cs - 2 * math.sin(u1) * math.sin(u2) / c2a if c2a else 0.0
        c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        new = length + (1 - c) * f * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        done, lam = abs(new - lam) < 1e-15, new
        if done:
            break
    uu = c2a * (a * a - b * b) / (b * b)
    aa = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    bb = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    shift = bb * ss * (c2m + bb / 4 * (cs * (2 * c2m**2 - 1) - bb / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    return b * aa * (sig - shift)


PAIRS = [
    (-25.435, -49.275, -25.435 + 5000 / 111320, -49.275),
    (-25.435, -49.275, -25.435, -49.275),
    (-25.4, -49.3, -25.41, -49.32),
    (0.0, 10.0, 0.0, 10.03),
    (60.0, 179.99, 60.0, -179.99),
    (89.0, 0.0, 89.0, 180.0),
    (-25.4, -49.3, 48.8, 2.3),
]


def test_geodesic_distance(spark):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(PAIRS)], "i int, a double, b double, c double, d double")
    got = [r["distancia_m"] for r in geodesy.with_geodesic_distance(df, "a", "b", "c", "d").orderBy("i").collect()]
    assert got[:6] == pytest.approx([inverse(*p) for p in PAIRS[:6]], abs=1e-6)
    assert got[6] == pytest.approx(inverse(*PAIRS[6]), rel=1e-9)
    assert got[0] == pytest.approx(4976, abs=1)  # inside 5 km, unlike the planar distance
    assert set(geodesy.with_geodesic_distance(df, "a", "b", "c", "d").columns) == {"i", "a", "b", "c", "d", "distancia_m"}


def test_known_geodesic(spark):
    """Flinders Peak to Buninyong: the published example, 54,972.271 m (on GRS 80, equal to the millimetre on WGS 84)."""
    df = spark.createDataFrame([(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)], "a double, b double, c double, d double")
    assert geodesy.with_geodesic_distance(df, "a", "b", "c", "d").first()["distancia_m"] == pytest.approx(54972.271, abs=1e-3)


@pytest.mark.parametrize("metres", [50, 150, 500, 1000, 2000])
def test_planar_distance(spark, metres):
    lat = -25.435
    d = spark.range(1).select(
        geodesy.planar_distance(F.lit(lat), F.lit(-49.275), F.lit(lat + metres / 111320), F.lit(-49.275))
    ).first()[0]
    assert d == pytest.approx(metres, abs=1e-6)


@pytest.mark.parametrize("centre", [(-25.43, -49.27), (0.0, 0.0), (70.0, 179.99), (-65.0, -179.995), (89.5, 10.0)])
def test_box_keeps_every_point_in_the_radius(spark, centre):
    lat, lon = centre
    r = 5000.0
    step = 5200 / 111000
    points = [
        (max(-90.0, min(90.0, lat + i * step / 12)), (lon + j * step / 12 / max(math.cos(math.radians(lat)), 0.01) + 540) % 360 - 180)
        for i in range(-12, 13)
        for j in range(-12, 13)
    ]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "lat double, lon double")
    kept = {(x["lat"], x["lon"]) for x in df.filter(geodesy.in_box(F.col("lat"), F.col("lon"), lat, lon, r)).collect()}
    inside = {(a, b) for a, b in points if inverse(lat, lon, a, b) <= r}
    assert inside and inside <= kept


def test_reprojection_of_a_city_point(spark):
    lon, lat = geodesy.to_lon_lat(F.lit(667792.18220869), F.lit(7183619.72139499))
    x, y = spark.range(1).select(lon, lat).first()
    assert -49.5 < x < -49.0 and -25.7 < y < -25.2
    # The central meridian maps to itself, and the equator is at the false northing.
    lon, lat = geodesy.to_lon_lat(F.lit(500000.0), F.lit(10000000.0))
    assert spark.range(1).select(lon, lat).first() == pytest.approx((-51.0, 0.0), abs=1e-12)


def test_reprojection_inverts_the_forward_series(spark):
    """Forward Gauss-Krueger series written out here; both ways meet to a millionth of a second."""
    n = geodesy.GRS80_F / (2 - geodesy.GRS80_F)
    radius = geodesy.GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    for lat, lon in ((-25.43, -49.27), (-30.0, -53.5), (-5.0, -48.1)):
        e = 2 * math.sqrt(n) / (1 + n)
        phi, dl = math.radians(lat), math.radians(lon + 51)
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
        x = 500000 + 0.9996 * radius * (eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)))
        y = 1e7 + 0.9996 * radius * (xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)))
        got = spark.range(1).select(*geodesy.to_lon_lat(F.lit(x), F.lit(y))).first()
        assert tuple(got) == pytest.approx((lon, lat), abs=1e-10)


def square(x, y, size, clockwise=True):
    ring = [[x, y], [x, y + size], [x + size, y + size], [x + size, y], [x, y]]
    return ring if clockwise else ring[::-1]


OUTER = square(670000.0, 7183000.0, 10.0)
HOLE = square(670003.0, 7183003.0, 4.0, False)
FAR = square(670100.0, 7183000.0, 10.0)


@pytest.mark.parametrize(
    ("rings", "shape"),
    [
        ([OUTER, HOLE], [2]),
        ([OUTER, FAR], [1, 1]),
        ([OUTER, HOLE, HOLE, FAR, HOLE], [3, 2]),
        ([HOLE, OUTER], [1, 1]),
        ([OUTER[:3], HOLE, FAR], [1, 1]),
        ([OUTER[:3]], []),
        ([], None),
        (None, None),
    ],
)
def test_rings_to_multipolygon(spark, rings, shape):
    df = spark.createDataFrame([(rings,)], "rings array<array<array<double>>>")
    got = df.select(geodesy.to_multipolygon(F.col("rings")).alias("g")).first()["g"]
    assert (None if got is None else [len(part) for part in got]) == shape
    for part in got or []:
        for ring in part:
            assert all(-49.5 < p[0] < -49.0 and -25.7 < p[1] < -25.2 for p in ring)


def test_ring_orientation(spark):
    rows = [(OUTER,), (HOLE,), ([[0.0, 0.0]],)]
    df = spark.createDataFrame(rows, "r array<array<double>>")
    assert [x[0] for x in df.select(geodesy.is_clockwise(F.col("r"))).collect()] == [True, False, True]
