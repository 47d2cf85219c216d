import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrapulse.operators import indicators, ranking, series

REF = dt.date(2026, 7, 1)


def month(back, ref=REF):
    total = ref.year * 12 + ref.month - 1 - back
    return dt.date(total // 12, total % 12 + 1, 1)


def points(spark, by_back, key="t"):
    rows = [(key, month(b), float(v)) for b, v in by_back.items()]
    return spark.createDataFrame(rows, "territorio_id string, mes date, valor double")


def at(spark, by_back, ref=REF, **options):
    return indicators.indicators_at(points(spark, by_back), ref, **options).first()


@pytest.mark.parametrize(
    ("by_back", "options", "expected"),
    [
        ({**{b: 10 for b in range(1, 25)}, 0: 15}, {}, (15.0, 10.0, 0.5, None)),
        ({**{b: 10 for b in range(1, 25)}, 0: 999}, {}, (999.0, 10.0, 98.9, None)),
        ({**{b: 10 for b in range(1, 25)}, 25: 1000, 0: 10}, {}, (10.0, 10.0, 0.0, None)),
        ({1: 4, 2: 4, 3: 4, 4: 100, 0: 8}, {"window": 3}, (8.0, 4.0, 1.0, None)),
        ({1: 4, 2: 4, 0: 8}, {}, (8.0, None, None, "historico_insuficiente")),
        ({1: 4, 2: 4, 3: 4}, {}, (0.0, 4.0, -1.0, None)),
        ({1: 0, 2: 0, 3: 0, 0: 5}, {}, (5.0, 0.0, None, "baseline_zero")),
        ({2: 4, 20: 4, 24: 1, 0: 3}, {}, (3.0, 3.0, 0.0, None)),
    ],
)
def test_baseline(spark, by_back, options, expected):
    got = at(spark, by_back, **options)
    assert (got["valor_atual"], got["baseline"], got["motivo_baseline"]) == (expected[0], expected[1], expected[3])
    assert got["variacao_pct"] == pytest.approx(expected[2]) if expected[2] is not None else got["variacao_pct"] is None


def windows(now, then):
    return {0: now, 1: now, 2: now, 3: then, 4: then, 5: then}


@pytest.mark.parametrize(
    ("by_back", "options", "label", "pct", "reason"),
    [
        (windows(20, 10), {}, "acelerando", 1.0, None),
        (windows(10, 20), {}, "desacelerando", -0.5, None),
        (windows(10.5, 10), {}, "estavel", 0.05, None),
        (windows(11.5, 10), {}, "acelerando", 0.15, None),
        (windows(11.5, 10), {"threshold": 0.20}, "estavel", 0.15, None),
        (windows(5, 0), {}, "acelerando", None, "baseline_zero"),
        (windows(-5, 0), {}, "acelerando", None, "baseline_zero"),
        (windows(-5, -10), {}, "desacelerando", -0.5, None),
        (windows(0, 0), {}, "estavel", 0.0, None),
        ({0: 5, 3: 5, 4: 5}, {}, None, None, "historico_insuficiente"),
        ({0: 5, 1: 5, 3: 5}, {}, None, None, "historico_insuficiente"),
        ({0: 8, 2: 12, 3: 10, 5: 10}, {}, "estavel", 0.0, None),
    ],
)
def test_trend(spark, by_back, options, label, pct, reason):
    got = at(spark, by_back, **options)
    assert (got["tendencia"], got["motivo_tendencia"]) == (label, reason)
    assert got["tendencia_pct"] == (pytest.approx(pct) if pct is not None else None)


def test_combined_reason_priority(spark):
    assert at(spark, {0: 1, 1: 1})["motivo_indisponivel"] == "historico_insuficiente"
    assert at(spark, {0: 1, 9: 1, 10: 1, 11: 1})["motivo_indisponivel"] == "historico_insuficiente"
    assert at(spark, windows(0, 0))["motivo_indisponivel"] == "baseline_zero"
    assert at(spark, windows(20, 10))["motivo_indisponivel"] is None


def test_reference_inside_a_month_gives_value_zero(spark):
    got = at(spark, windows(20, 10), ref=dt.date(2026, 7, 15))
    assert got["valor_atual"] == 0.0 and got["baseline"] == pytest.approx(70 / 5)


def brute(by_back, filled):
    """Plain-list version of both indicators."""
    series = {b: by_back.get(b, 0.0) for b in range(filled + 1)} if filled is not None else dict(by_back)
    base = [v for b, v in series.items() if 1 <= b <= 24]
    now = [v for b, v in series.items() if 0 <= b <= 2]
    then = [v for b, v in series.items() if 3 <= b <= 5]
    baseline = sum(base) / len(base) if len(base) >= 3 else None
    value = series.get(0, 0.0)
    pct = (value - baseline) / baseline if baseline else None
    if len(now) < 2 or len(then) < 2:
        return value, baseline, pct, None
    n, t = sum(now) / len(now), sum(then) / len(then)
    if t == 0:
        return value, baseline, pct, "estavel" if n == 0 else "acelerando"
    change = (n - t) / t
    return value, baseline, pct, "acelerando" if change > 0.1 else "desacelerando" if change < -0.1 else "estavel"


@pytest.mark.parametrize("filled", [None, 40, 12, 4])
def test_against_plain_lists(spark, filled):
    import random

    random.seed(7)
    by_key = {
        f"k{k}": {b: float(random.randint(-3, 9)) for b in range(45) if random.random() < random.random()}
        for k in range(60)
    }
    rows = [(k, month(b), v) for k, s in by_key.items() for b, v in s.items()]
    df = spark.createDataFrame(rows, "territorio_id string, mes date, valor double")
    wanted = spark.createDataFrame([(k,) for k in by_key], "territorio_id string")
    got = indicators.indicators_at(df, REF, filled=filled, wanted=wanted).collect()
    assert len(got) == 60
    for r in got:
        value, baseline, pct, label = brute(by_key[r["territorio_id"]], filled)
        assert (r["valor_atual"], r["tendencia"]) == (value, label)
        assert r["baseline"] == (pytest.approx(baseline) if baseline is not None else None)
        assert r["variacao_pct"] == (pytest.approx(pct) if pct is not None else None)
    if filled is None:
        every = {(r["territorio_id"], r["mes"]): r for r in indicators.series_indicators(df).collect()}
        for k, s in by_key.items():
            if 0 in s:
                r = every[(k, REF)]
                assert (r["valor_atual"], r["tendencia"]) == (brute(s, None)[0], brute(s, None)[3])
                assert r["baseline"] == (pytest.approx(brute(s, None)[1]) if brute(s, None)[1] is not None else None)


def test_months_from_one_series_equal_plain_lists(spark):
    """Old requested months have a shorter history: the series is filled from the last requested month only."""
    counts = {b: (b * 7) % 5 for b in range(60) if b % 3}
    rows = [("t", None, month(b), v) for b, v in counts.items()]
    table = spark.createDataFrame(rows, "territorio_id string, categoria_id string, mes date, contagem int")
    asked = [0, 1, 5, 17, 30, 38, 40, 44]
    requested = spark.createDataFrame([("t", month(b)) for b in asked], "territorio_id string, mes date")
    got = {r["mes"]: r for r in indicators.indicators_for_months(requested, table, month(1)).collect()}
    assert len(got) == len(asked)
    assert got[month(0)]["motivo_indisponivel"] == "mes_incompleto" and got[month(0)]["valor_atual"] == 0.0
    for b in asked[1:]:
        shifted = {back - b: float(counts.get(back, 0)) for back in range(b, 41)}
        value, baseline, pct, label = brute(shifted, None)
        r = got[month(b)]
        assert (r["valor_atual"], r["tendencia"]) == (value, label)
        assert r["baseline"] == (pytest.approx(baseline) if baseline is not None else None)
        assert r["variacao_pct"] == (pytest.approx(pct) if pct is not None else None)


def test_zero_fill(spark):
    filled = series.zero_fill(points(spark, {0: 2, 5: 3, 50: 9}), REF, 40).orderBy("mes").collect()
    assert len(filled) == 41 and filled[-1]["valor"] == 2.0 and filled[35]["valor"] == 3.0
    assert sum(r["valor"] for r in filled) == 5.0
    inside = series.zero_fill(points(spark, {0: 2}), dt.date(2026, 7, 20), 2).orderBy("mes").collect()
    assert [r["mes"] for r in inside] == [month(2), month(1), month(0)]


ITEM = "territorio_id string, valor_atual double, baseline double, variacao_pct double, tendencia string"


def items(spark, **pct):
    return spark.createDataFrame([(k, 1.0, 1.0, v, None) for k, v in pct.items()], ITEM)


def order(df):
    return [(r["territorio_id"], r["posicao"], r["total"]) for r in df.orderBy("posicao").collect()]


def test_ranking_order_ties_and_nulls(spark):
    df = items(spark, big=0.1, small=2.0, none=None, tie_b=0.5, tie_a=0.5)
    expected = [("small", 1, 4), ("tie_a", 2, 4), ("tie_b", 3, 4), ("big", 4, 4)]
    for limit, kept in ((None, 4), (10, 4), (2, 2), (0, 0), (-1, 3), (-4, 0), (-9, 0), (20_000, 4)):
        assert order(ranking.ranked(df, limit)) == expected[:kept]


def test_position_of_one_territory(spark):
    df = items(spark, big=0.1, small=2.0, none=None, tie_b=0.5, tie_a=0.5)
    assert tuple(ranking.position_of(df, "tie_b").first()) == (3, 4)
    assert tuple(ranking.position_of(df, "none").first()) == (None, 4)
    assert tuple(ranking.position_of(items(spark, none=None), "none").first()) == (None, None)


def test_numbering_over_many_partitions_with_a_hot_tie(spark):
    df = spark.range(30_000).select(
        F.format_string("t%06d", (F.col("id") * 7919) % 30_000).alias("territorio_id"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("variacao_pct"),
    )
    got = ranking.ranked(df.withColumns({c: F.lit(None) for c in ("valor_atual", "baseline", "tendencia")}), None)
    pdf = got.select("territorio_id", "variacao_pct", "posicao").toPandas().sort_values("posicao")
    expected = pdf.sort_values(["variacao_pct", "territorio_id"], ascending=[False, True])
    assert pdf["territorio_id"].tolist() == expected["territorio_id"].tolist()
    assert pdf["posicao"].tolist() == list(range(1, 30_001))


@pytest.mark.parametrize("n", [ranking.SPLITTERS, 64, 1])
def test_equal_changes_are_dealt_over_many_parts(spark, n):
    """99 of 100 changes are equal: the parts stay even and follow the order."""
    df = spark.range(40_000).select(
        F.format_string("t%06d", (F.col("id") * 7919) % 40_000).alias("territorio_id"),
        F.when(F.col("id") % 100 != 0, 0.0).otherwise(F.col("id") - 20_000.0).alias("variacao_pct"),
    )
    pdf = ranking.parted(df, n).toPandas().sort_values(["variacao_pct", "territorio_id"], ascending=[False, True])
    assert pdf["_part"].is_monotonic_increasing
    assert pdf.groupby("_part").size().max() <= max(40_000 * 12 // n, 1)


def test_splitters_are_few_and_repeated_rows_are_numbered(spark):
    df = spark.range(5_000).select(F.lit("one").alias("territorio_id"), F.lit(0.5).alias("variacao_pct"), F.lit(1.0).alias("valor_atual"))
    assert len(ranking.splitters(df).first()[0]) == 1
    assert sorted(r["posicao"] for r in ranking.numbered_by_change(df).collect()) == list(range(1, 5_001))
    odd = spark.createDataFrame([(None, 0.0), ("a", -0.0), ("b", 0.0), ("", 0.0)], "territorio_id string, variacao_pct double")
    got = ranking.ranked(odd).orderBy("posicao").collect()
    assert [r["territorio_id"] for r in got][2:] == ["a", "b"] and {r["total"] for r in got} == {4}
    assert ranking.ranked(odd.limit(0), None).count() == 0
