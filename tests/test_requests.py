"""The seeded scenario with hand-computed answers."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from test_geodesy import inverse

from terrapulse.functions.months import in_last_months
from terrapulse.operators import radius, series
from terrapulse.operators.territories import bounds
from terrapulse.plans import requests
from terrapulse.schemas import ATTRIBUTES, ENTITY, OBSERVATION, TERRITORY
from terrapulse.sinks.exports import feature_lines
from terrapulse.sources.reference import category_seed, code_category_seed

CENTRO, BATEL = "curitiba-bairro-centro", "curitiba-bairro-batel"
JUL, AUG = dt.date(2026, 7, 1), dt.date(2026, 8, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (CENTRO, "bares_restaurantes", JUL, "PRIMEIRA_OBSERVACAO", 5),
        (CENTRO, "bares_restaurantes", JUL, "DESAPARECIMENTO", 2),
        (CENTRO, "bares_restaurantes", AUG, "PRIMEIRA_OBSERVACAO", 3),
        (CENTRO, "bares_restaurantes", AUG, "DESAPARECIMENTO", 4),
        (CENTRO, "saude_clinicas", AUG, "PRIMEIRA_OBSERVACAO", 1),
        (BATEL, "bares_restaurantes", AUG, "PRIMEIRA_OBSERVACAO", 2),
        (BATEL, "bares_restaurantes", AUG, "DESAPARECIMENTO", 1),
        (CENTRO, "bares_restaurantes", AUG, "ABERTURA_CONFIRMADA", 6),
        (BATEL, "bares_restaurantes", AUG, "ABERTURA_CONFIRMADA", 3),
    ]
    return spark.createDataFrame(
        rows, "territorio_id string, categoria_id string, mes date, event_type string, contagem bigint"
    )


@pytest.fixture(scope="module")
def openings(spark):
    months = [dt.date(2024, 8, 1), dt.date(2025, 3, 1), dt.date(2025, 11, 1), JUL]
    rows = [(CENTRO, None, m, 1) for m in months] + [(BATEL, None, JUL, 1)]
    return spark.createDataFrame(rows, "territorio_id string, categoria_id string, mes date, contagem bigint")


POLYGON = [[[[-49.3, -25.4], [-49.3, -25.3], [-49.2, -25.3], [-49.3, -25.4]]]]


@pytest.fixture(scope="module")
def territories(spark):
    rows = [
        (CENTRO, "bairro", "Centro", [], POLYGON, None, "curitiba"),
        (BATEL, "bairro", "Batel", [], None, None, "curitiba"),
        ("curitiba", "cidade", "Curitiba", [], None, None, "curitiba"),
    ]
    return spark.createDataFrame(rows, TERRITORY)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


METRICS = ("territorio_id", "mes", "aberturas", "desaparecimentos", "saldo")


def test_map_mode(events, openings):
    got = requests.commerce_metrics(events, openings)
    assert rows(got, *METRICS) == [(BATEL, None, 5, 1, 4), (CENTRO, None, 15, 6, 9)]
    assert {r["motivo_indisponivel"] for r in got.collect()} == {"nao_aplicavel_sem_territorio_id"}


def test_series_mode(events, openings):
    got = requests.commerce_metrics(events, openings, territory=CENTRO)
    assert rows(got, *METRICS) == [(CENTRO, JUL, 5, 2, 3), (CENTRO, AUG, 10, 4, 6)]
    july, august = got.collect()
    assert (july["baseline"], july["variacao_pct"], july["tendencia"], july["motivo_indisponivel"]) == (
        pytest.approx(0.125), pytest.approx(7.0), "acelerando", None,
    )
    assert (august["baseline"], august["tendencia"], august["motivo_indisponivel"]) == (None, None, "mes_incompleto")


def test_filters(events, openings):
    got = requests.commerce_metrics(events, openings, category="saude_clinicas")
    assert rows(got, "territorio_id", "categoria_id", "aberturas", "desaparecimentos") == [(CENTRO, "saude_clinicas", 1, 0)]
    assert requests.commerce_metrics(events, openings, territory="nowhere").count() == 0
    ranged = requests.commerce_metrics(events, openings, territory=CENTRO, start="2026-08-01", end=dt.date(2026, 8, 1))
    assert rows(ranged, "mes", "aberturas") == [(AUG, 10)]
    assert events.filter(in_last_months(F.col("mes"), "2026-08-20", 1)).count() == 7
    assert events.filter(in_last_months(F.col("mes"), "2026-08-20", 2)).count() == 9


def test_coverage_and_default_period(spark, events):
    assert rows(requests.event_coverage(events), "mes_inicio", "mes_fim") == [(JUL, AUG)]
    assert series.default_period(events).first()[0] == JUL
    nothing = events.filter(F.lit(False))
    assert rows(requests.event_coverage(nothing), "mes_inicio", "mes_fim") == [(None, None)]
    assert series.default_period(nothing, "2026-12-17").first()[0] == dt.date(2026, 12, 1)


@pytest.mark.parametrize("limit", [10, None])
def test_ranking(events, openings, territories, limit):
    got = requests.commerce_ranking(events, openings, territories, limit=limit).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["territorio_id"], r["nome"], r["valor_atual"], r["posicao"], r["total"]) == (CENTRO, "Centro", 1.0, 1, 1)
    assert (r["baseline"], r["variacao_pct"], r["tendencia"]) == (pytest.approx(0.125), pytest.approx(7.0), "acelerando")
    assert len(r["serie"]) == 12 and tuple(r["serie"][-1]) == (JUL, 1.0)
    assert [p["valor"] for p in r["serie"]] == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1]


def test_ranking_limit_zero_and_category(events, openings, territories):
    assert requests.commerce_ranking(events, openings, territories, limit=0).count() == 0
    assert requests.commerce_ranking(events, openings, territories, category="x").count() == 0


def summary(events, openings, territories, territory, **options):
    return requests.territory_summary(events, openings, territories, territory=territory, **options).collect()


def test_summary(events, openings, territories):
    (centro,) = summary(events, openings, territories, CENTRO)
    assert (centro["nome"], centro["periodo"], centro["posicao_ranking"], centro["total_ranking"]) == ("Centro", JUL, 1, 1)
    assert (centro["aberturas_valor_atual"], centro["aberturas_baseline"], centro["aberturas_tendencia"]) == (1.0, pytest.approx(0.125), "acelerando")
    assert centro["aberturas_motivo_indisponivel"] is None
    assert (centro["saldo_valor_atual"], centro["saldo_baseline"], centro["saldo_motivo_indisponivel"]) == (6.0, None, "historico_insuficiente")
    (batel,) = summary(events, openings, territories, BATEL)
    assert (batel["aberturas_baseline"], batel["aberturas_variacao_pct"], batel["aberturas_motivo_indisponivel"]) == (0.0, None, "baseline_zero")
    assert (batel["posicao_ranking"], batel["total_ranking"]) == (None, 1)
    assert summary(events, openings, territories, "nowhere") == []


def test_summary_without_any_row(events, openings, territories):
    (got,) = summary(events, openings, territories, "curitiba")
    assert (got["aberturas_baseline"], got["aberturas_tendencia"], got["aberturas_motivo_indisponivel"]) == (0.0, "estavel", "baseline_zero")
    (got,) = summary(events.filter(F.lit(False)), openings, territories, CENTRO, period=JUL)
    assert (got["saldo_valor_atual"], got["saldo_motivo_indisponivel"]) == (0.0, "historico_insuficiente")
    (got,) = summary(events, openings, territories, CENTRO, period=dt.date(2026, 7, 15))
    assert (got["aberturas_valor_atual"], got["aberturas_baseline"]) == (0.0, pytest.approx(0.125))


def test_breakdown(spark, events, openings):
    categories = category_seed(spark)
    got = requests.territory_breakdown(events, openings, categories, territory=CENTRO)
    assert rows(got, "categoria_id", "nome", "contagem") == [(None, "(sem categoria)", 1)]
    assert requests.territory_breakdown(events, openings, categories, territory=CENTRO, period="2026-07-15").count() == 0


def test_map_dataset(events, territories):
    dataset, domain = requests.map_view(territories, events)
    assert sorted(rows(dataset, "territorio_id", "saldo", "tem_dado")) == [(BATEL, 4, True), (CENTRO, 9, True)]
    assert tuple(domain.first()) == (4, 9, 0, 9)
    dataset, domain = requests.map_view(territories, events, category="saude_clinicas")
    assert sorted(rows(dataset, "territorio_id", "saldo", "aberturas", "tem_dado")) == [(BATEL, 0, None, False), (CENTRO, 1, 1, True)]
    dataset, domain = requests.map_view(territories, events, category="none")
    assert tuple(domain.first()) == (-1, 1, 0, 0)


def test_features(territories):
    features = requests.territory_features(territories)
    assert features.count() == 2 and features.columns == ["type", "geometry", "properties"]
    lines = [json.loads(r[0]) for r in feature_lines(territories).collect()]
    by_id = {x["properties"]["territorio_id"]: x for x in lines}
    assert by_id[BATEL]["geometry"] is None and by_id[BATEL]["properties"]["territorio_pai_id"] is None
    assert by_id[CENTRO]["geometry"] == {"type": "MultiPolygon", "coordinates": POLYGON}
    assert tuple(bounds(territories).first()) == (-49.3, -25.4, -49.2, -25.3)


def test_category_list(spark):
    names = [r["nome"] for r in requests.category_list(category_seed(spark)).collect()]
    assert names == sorted(names) and len(names) == 26


FOOD = "I.56.1.1-2/03-00"
LAT, LON = -25.435, -49.275


@pytest.fixture(scope="module")
def city(spark):
    north = {"1": 50, "2": 300, "3": 100, "4": 5000, "5": 10, "6": 20}
    confidence = {"1": "alta", "2": "media", "3": "baixa", "4": "alta", "5": "alta", "6": "alta"}
    locations = spark.createDataFrame(
        [(e, LAT + m / 111320, LON, confidence[e]) for e, m in north.items()] + [("7", None, None, "baixa")],
        "entidade_id string, lat double, lon double, confianca string",
    )

    def seen(entity, day, **a):
        a = {"endereco": "R. X", "numero": "10", "bairro": "CENTRO", "territorio_id": CENTRO} | a
        return (f"{entity}{day}", entity, day, tuple(a.get(k) for k in ATTRIBUTES), "alvaras_smf", "r", None)

    observations = spark.createDataFrame(
        [
            seen("1", JUL, nome_fantasia="Nome Antigo", cnae_principal=None),
            seen("1", AUG, nome_fantasia="Restaurante Perto", cnae_principal=FOOD),
            seen("2", AUG, nome_empresarial="MEDIA SEM CATEGORIA LTDA"),
            seen("3", AUG, nome_fantasia="Baixa Confianca", cnae_principal=FOOD),
            seen("4", AUG, nome_fantasia="Muito Longe", cnae_principal=FOOD),
            seen("5", AUG, nome_fantasia="No business", cnae_principal=FOOD),
            seen("7", AUG, nome_fantasia="No point", cnae_principal=FOOD),
        ],
        OBSERVATION,
    )
    entities = spark.createDataFrame(
        [(e, "obra" if e == "5" else "comercio", e, None, None) for e in "1234567"], ENTITY
    )
    return locations, observations, entities, code_category_seed(spark)


def search(city, r, category=None):
    hits, totals = requests.radius_search(*city, lat=LAT, lon=LON, radius_m=r, category=category)
    return hits.collect(), tuple(totals.first())


def test_radius_search(city):
    hits, totals = search(city, 500)
    assert [h["entidade_id"] for h in hits] == ["1", "2"] and totals == (2, 1)
    assert hits[0]["nome"] == "Restaurante Perto" and hits[0]["categoria_id"] == "bares_restaurantes"
    assert hits[0]["endereco"] == "R. X, 10 - CENTRO" and hits[0]["territorio_id"] == CENTRO
    assert hits[1]["nome"] == "MEDIA SEM CATEGORIA LTDA" and hits[1]["categoria_id"] is None
    assert hits[0]["distancia_m"] == pytest.approx(49.76, abs=0.05)


def test_radius_search_wide_and_by_category(city):
    hits, totals = search(city, 5000)
    assert [h["entidade_id"] for h in hits] == ["1", "2", "4"] and totals == (3, 1)
    hits, totals = search(city, 500, "bares_restaurantes")
    assert [h["entidade_id"] for h in hits] == ["1"] and totals == (1, 1)
    hits, totals = search(city, 500, "saude_clinicas")
    assert hits == [] and totals == (0, 0)


@pytest.mark.parametrize("r", [0, -1, 5001])
def test_radius_bounds(city, r):
    with pytest.raises(ValueError):
        search(city, r)


def inside(lat1, lon1, lat2, lon2, r):
    return inverse(lat1, lon1, lat2, lon2) <= r


@pytest.mark.parametrize(
    ("centre", "cell_rows"),
    [((-25.4, -49.3), 1000), ((-25.4, -49.3), 10), ((66.0, 179.999), 10), ((-66.0, -179.999), 30), ((0.0, 0.0), 7), ((89.9, 0.0), 10)],
)
def test_radius_join_equals_brute_force(spark, centre, cell_rows):
    random.seed(3)
    lat, lon = centre

    def near(spread):
        a = max(-89.99, min(89.99, lat + random.uniform(-spread, spread)))
        width = spread / max(0.02, abs(math.cos(math.radians(a))))
        return a, (lon + random.uniform(-width, width) + 540) % 360 - 180

    # A third of the locations share one spot.
    places = [(f"e{i}", *((lat, lon) if i % 3 == 0 else near(0.04))) for i in range(240)]
    centres = [(i, *near(0.03)) for i in range(6)]
    locations = spark.createDataFrame([*places, ("null", None, lon)], "entidade_id string, lat double, lon double")
    points = spark.createDataFrame(centres, "ponto_id int, ponto_lat double, ponto_lon double")
    pairs = radius.radius_join(locations, points, 1500, cell_rows=cell_rows).select("ponto_id", "entidade_id").collect()
    expected = sorted((i, e) for i, a, b in centres for e, c, d in places if inside(a, b, c, d, 1500))
    assert sorted(tuple(p) for p in pairs) == expected and expected


def test_radius_join_runs_compiled(spark):
    """The code of a stage stays below the 8000 bytes that the JVM compiles, the formula included, and the locations are dealt over many tasks."""
    locations = spark.createDataFrame([(str(i), -25.4 + i / 1e5, -49.3) for i in range(50)], "entidade_id string, lat double, lon double")
    points = spark.createDataFrame([(1, -25.4, -49.3)], "ponto_id int, ponto_lat double, ponto_lon double")
    pairs = radius.radius_join(locations, points, 500)
    assert pairs.rdd.getNumPartitions() >= 4
    assert len(pairs.collect()) == 50
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(pairs._jdf.queryExecution().executedPlan())
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000
