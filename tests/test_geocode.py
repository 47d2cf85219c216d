import pytest
from pyspark.sql import functions as F

from terrapulse.operators import geocode
from terrapulse.plans import requests

LAT, LON = -25.435, -49.275


def north(metres):
    return LAT + metres / 111320


@pytest.mark.parametrize(
    ("precision", "confidence", "again"),
    [("numero", "alta", False)]
    + [(p, "baixa", True) for p in ("numero_aproximado", "logradouro", "cep", "localidade", "municipio", "other", None)],
)
def test_first_pass_decision(spark, precision, confidence, again):
    p = F.lit(precision).cast("string")
    got = spark.range(1).select(geocode.first_pass_confidence(p), geocode.needs_second_pass(p)).first()
    assert tuple(got) == (confidence, again)


CASES = [
    ("none", None, None, "baixa", None, None),
    ("only second", None, 10.0, "media", 10.0, None),
    ("only first", 10.0, None, "baixa", 10.0, None),
    ("50 m", 0.0, 50.0, "alta", 50.0, 50.0),
    ("150 m", 0.0, 149.999, "alta", 149.999, 150.0),
    ("500 m", 0.0, 500.0, "media", 500.0, 500.0),
    ("1000 m", 0.0, 999.999, "media", 999.999, 1000.0),
    ("2000 m", 0.0, 2000.0, "baixa", 2000.0, 2000.0),
]


def test_reconcile(spark):
    rows = [
        (name, None if a is None else north(a), None if a is None else LON, None if b is None else north(b), None if b is None else LON)
        for name, a, b, *_ in CASES
    ] + [("half a point", None, LON, north(1), None)]
    df = spark.createDataFrame(rows, "name string, a double, b double, c double, d double")
    got = {r["name"]: r for r in geocode.reconcile(df, "a", "b", "c", "d").collect()}
    for name, _, _, confidence, at, apart in CASES:
        assert got[name]["confianca"] == confidence
        assert got[name]["lat"] == (None if at is None else pytest.approx(north(at), abs=1e-12))
        assert got[name]["distancia_desempate_m"] == (None if apart is None else pytest.approx(apart, abs=0.01))
    half = got["half a point"]
    assert (half["confianca"], half["lat"], half["lon"]) == ("baixa", None, None)


CANDIDATE = "array<struct<lat:string, lon:string, importance:double, type:string>>"


def lists(spark, *candidates):
    rows = [(f"e{i}", list(c) if c is not None else None) for i, c in enumerate(candidates)]
    return spark.createDataFrame(rows, f"entidade_id string, candidates {CANDIDATE}")


ONE = ("-25.4799", "-49.2788", 0.5, "house")
CLOSE = ("-25.47995", "-49.27885", 0.4, "house")
FAR = ("-25.5500", "-49.3500", 0.3, None)


def test_candidates(spark):
    df = lists(spark, [], [ONE], [ONE, CLOSE], [ONE, FAR], None, [ONE, CLOSE, FAR], [FAR])
    got = geocode.resolve_candidates(df).orderBy("entidade_id").collect()
    assert [r["status"] for r in got] == ["falha", "sucesso", "sucesso", "ambiguo", "falha", "sucesso", "sucesso"]
    assert got[0]["ponto"] is None and got[3]["ponto"] is None
    assert tuple(got[2]["ponto"]) == (-25.4799, -49.2788)
    assert got[0]["confianca_bruta"] is None
    assert got[1]["confianca_bruta"] == "importance=0.5;type=house;n_candidatos=1"
    assert got[2]["confianca_bruta"] == "importance=0.5;type=house;n_candidatos=2;dist_2o_candidato_m=7.5"
    assert got[3]["confianca_bruta"].startswith("n_candidatos=2;dist_2o_candidato_m=105")
    assert got[5]["confianca_bruta"].startswith("importance=0.5;type=house;n_candidatos=3;")
    assert got[6]["confianca_bruta"] == "importance=0.3;type=None;n_candidatos=1"


def test_search_point(spark):
    assert requests.point_of(lists(spark, [ONE])) == (-25.4799, -49.2788)
    for candidates in ([], [ONE, FAR]):
        with pytest.raises(LookupError):
            requests.point_of(lists(spark, candidates))


def test_search_by_address(spark):
    df = lists(spark, [ONE], [FAR]).withColumn(
        "endereco", F.when(F.col("entidade_id") == "e0", "R. X, Curitiba, PR, Brasil").otherwise("Praça, CURITIBA")
    )
    assert requests.point_of_address(df, "R. X") == (-25.4799, -49.2788)
    assert requests.point_of_address(df, "Praça, CURITIBA") == (-25.55, -49.35)
    with pytest.raises(LookupError):
        requests.point_of_address(df, "R. Y")
    with pytest.raises(ValueError):
        requests.point_of_address(df, "R.")


def test_first_pass(spark):
    pending = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "entidade_id string")
    results = spark.createDataFrame(
        [
            ("a", 1.0, 2.0, "numero", None, 1),
            ("b", 1.0, 2.0, "cep", None, 2),
            ("b", 3.0, 4.0, "numero", None, 3),
            ("c", None, None, "numero", None, 4),
            ("d", 1.0, None, None, None, 5),
            ("x", 1.0, 1.0, "numero", None, 6),
        ],
        "entidade_id string, lat double, lon double, precisao string, tipo_resultado string, position int",
    )
    found = geocode.first_pass(pending, results)
    got = {r["entidade_id"]: (r["lat"], r["lon"], r["confianca"], r["precisao_geocodebr"]) for r in found.collect()}
    assert got == {
        "a": (1.0, 2.0, "alta", "numero"),
        "b": (3.0, 4.0, "alta", "numero"),
        "c": (None, None, "alta", "numero"),
        "d": (None, None, "baixa", None),
        "e": (None, None, "baixa", None),
    }
    assert tuple(geocode.first_pass_totals(found).first()) == (3, 2)


def test_second_pass_by_entity(spark):
    pending = spark.createDataFrame(
        [("e0", None, None, "cep"), ("e1", -25.48, -49.279, "cep"), ("e9", 1.0, 2.0, None)],
        "entidade_id string, lat double, lon double, precisao_geocodebr string",
    )
    got = {r["entidade_id"]: r for r in geocode.second_pass(pending, lists(spark, [ONE], [ONE])).collect()}
    assert (got["e0"]["confianca"], got["e0"]["lat"]) == ("media", -25.4799)
    assert (got["e1"]["confianca"], got["e1"]["lat"], got["e1"]["precisao_geocodebr"]) == ("alta", -25.4799, "cep")
    assert (got["e9"]["confianca"], got["e9"]["lat"]) == ("baixa", 1.0)
    assert {(r["fonte_primaria"], r["fonte_secundaria"]) for r in got.values()} == {("geocodebr", "nominatim")}


def test_disagreements(spark):
    rows = [(f"e{i:02d}", 990.0 + i) for i in range(40)] + [("none", None)]
    df = spark.createDataFrame(rows, "entidade_id string, distancia_desempate_m double")
    assert geocode.severe_disagreements(df).count() == 29
    largest = geocode.largest_disagreements(df).collect()
    assert len(largest) == 20 and largest[0]["entidade_id"] == "e39"
