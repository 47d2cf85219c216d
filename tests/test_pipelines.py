"""Files in, tables out; every step is run twice."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_sources import SQUARE, feature, line, write, write_features

from terrapulse.plans import pipelines, requests
from terrapulse.sinks import tables, upserts
from terrapulse.sources.reference import CATEGORY_CODES

JUL, AUG = "2026-07-01", "2026-08-01"
FOOD, BEAUTY = "I.56.1.1-2/03-00", "S.96.0.2-5/01-00"


def permit(number, start, district="CENTRO", code=FOOD, **more):
    return line(
        NUMERO_DO_ALVARA=number, INICIO_ATIVIDADE=start, BAIRRO=district, CNAE_ATIVIDADE_PRINCIPAL=code,
        NOME_EMPRESARIAL=f"EMPRESA {number}", ENDERECO="R. X", NUMERO="0010", CEP="81010120", **more,
    )


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    made = {n: root / n for n in ("permits", "features", "codes", "results", "candidates", "store", "out")}
    for path in made.values():
        path.mkdir()
    write(made["permits"], f"{JUL}_Alvaras_-_Base_de_Dados.csv", permit("1", "01/01/2010"), permit("2", "05/05/2015", "BATEL"), permit("3", "05/05/2016"))
    write(
        made["permits"], f"{AUG}_Alvaras_-_Base_de_Dados.csv",
        permit("1", "01/01/2010", code=BEAUTY), permit("2", "05/05/2015", "BATEL"), permit("4", "10/07/2026"),
        permit("5", "10/02/2020", "NOWHERE"), permit("4", "11/11/2011", "BATEL"), permit("***", "10/02/2020"),
    )
    write_features(made["features"], [feature(1, "Centro", [SQUARE]), feature(2, "Batel")], [feature(3, None)])
    codes = [
        {"id": c, "descricao": c, "classe": {"id": c[:5], "grupo": {"id": c[:3], "divisao": {"id": c[:2], "secao": {"id": "X"}}}}}
        for group in CATEGORY_CODES.values() for c in group
    ]
    (made["codes"] / "codes.json").write_text(json.dumps(codes))
    return {n: str(p) for n, p in made.items()}


@pytest.fixture(scope="module")
def warehouse(spark, folders):
    return pipelines.Warehouse(spark, folders["store"])


def content(df, *skip):
    return sorted(str(tuple(r)) for r in df.drop("criado_em", "atualizado_em", "data_ingestao", "calculado_em", *skip).collect())


def test_reference_tables(warehouse, folders):
    with pytest.raises(ValueError, match="codes not loaded"):
        pipelines.seed_categories(warehouse)
    for _ in range(2):
        assert vars(pipelines.ingest_activity_codes(warehouse, folders["codes"])) == {"read": 79, "written": 79, "failed": 0}
        assert pipelines.seed_categories(warehouse) == (26, 79)
        assert vars(pipelines.ingest_territories(warehouse, folders["features"])) == {"read": 3, "written": 2, "failed": 1}
    assert warehouse.read("dim_cnae").count() == 79
    assert warehouse.read("dim_territorio").count() == 2


def test_doubled_or_empty_territories_stop_the_load(warehouse, tmp_path):
    before = content(warehouse.read("dim_territorio"))
    for name, features in (("doubled", [feature(1, "São X"), feature(2, "SAO X")]), ("invalid", [feature(1, "Short", [SQUARE[:3]])])):
        (tmp_path / name).mkdir()
        write_features(tmp_path / name, features)
        with pytest.raises(ValueError, match=name):
            pipelines.ingest_territories(warehouse, str(tmp_path / name))
    assert content(warehouse.read("dim_territorio")) == before
    runs = warehouse.read("pipeline_run").filter("conector_id = 'geocuritiba_bairro'").groupBy("status").count()
    assert {tuple(r) for r in runs.collect()} == {("sucesso", 2), ("falha", 2)}


def test_permits(warehouse, folders):
    run, _ = pipelines.ingest_permits(warehouse, folders["permits"], f"{JUL}_Alvaras_-_Base_de_Dados.csv")
    assert vars(run) == {"read": 3, "written": 3, "failed": 0}
    created = {r["identificador_fonte"]: r["criado_em"] for r in warehouse.read("entidade").collect()}
    run, unmatched = pipelines.ingest_permits(warehouse, folders["permits"])
    assert vars(run) == {"read": 5, "written": 4, "failed": 0}
    assert [tuple(r) for r in unmatched.collect()] == [("NOWHERE", 1)]
    first = content(warehouse.read("observacao_entidade"))
    run, _ = pipelines.ingest_permits(warehouse, folders["permits"])
    assert vars(run) == {"read": 5, "written": 0, "failed": 0}
    assert content(warehouse.read("observacao_entidade")) == first and len(first) == 7
    entities = {r["identificador_fonte"]: r for r in warehouse.read("entidade").collect()}
    assert set(entities) == {"1", "2", "3", "4", "5"}
    assert {k: entities[k]["criado_em"] for k in created} == created
    assert entities["1"]["atualizado_em"] > created["1"] and entities["3"]["atualizado_em"] == created["3"]
    four = warehouse.read("observacao_entidade").filter("atributos.numero_do_alvara = '4'").first()
    assert four["atributos"]["inicio_atividade"] == "2026-07-10"  # the first of two lines


def test_events_and_counts(warehouse):
    run, histogram = pipelines.detect_pair(warehouse, JUL, AUG)
    assert vars(run) == {"read": 5, "written": 4, "failed": 0}
    expected = {"ABERTURA_CONFIRMADA": 1, "PRIMEIRA_OBSERVACAO": 1, "MUDANCA_CATEGORIA": 1, "DESAPARECIMENTO": 1}
    assert {r["event_type"]: r["n"] for r in histogram.collect()} == expected
    stored = content(warehouse.read("fato_evento_territorial"))
    run, histogram = pipelines.detect_pair(warehouse, dt.date(2026, 7, 1), dt.date(2026, 8, 1))
    assert vars(run) == {"read": 5, "written": 0, "failed": 0}
    assert content(warehouse.read("fato_evento_territorial")) == stored
    for _ in range(2):
        rows, report = pipelines.rebuild_event_counts(warehouse)
        assert rows == 3 == warehouse.read("contagem_eventos").count()
        found = {(r["event_type"], r["grupo"], r["nome"], r["n"]) for r in report.collect()}
        assert found == {
            (t, g, n, 1)
            for t, names in (("PRIMEIRA_OBSERVACAO", ("(sem bairro)",)), ("DESAPARECIMENTO", ("Centro",)))
            for g, n in (("bairro", names[0]), ("categoria", "Bares, restaurantes e lanchonetes"), ("total", "total"))
        }
        rows, report = pipelines.rebuild_opening_counts(warehouse)
        assert rows == 4 == warehouse.read("contagem_inicio_atividade").count()
    assert warehouse.read("contagem_inicio_atividade").agg(F.sum("contagem")).first()[0] == 4


def test_requests_over_the_tables(warehouse):
    counts, openings = warehouse.read("contagem_eventos"), warehouse.read("contagem_inicio_atividade")
    got = requests.commerce_metrics(counts, openings).collect()
    assert {(r["territorio_id"], r["saldo"]) for r in got} == {("curitiba-bairro-centro", 0), (None, 1)}
    assert requests.commerce_ranking(counts, openings, warehouse.read("dim_territorio")).count() == 0


def test_geocoding(warehouse, folders, spark, tmp_path):
    pipelines.export_first_pass(warehouse, f"{folders['out']}/first")
    rows = spark.read.csv(f"{folders['out']}/first", header=True).collect()
    assert len(rows) == 5 and {(r["municipio"], r["estado"], r["logradouro"]) for r in rows} == {("Curitiba", "PR", "R. X")}
    ids = {r["identificador_fonte"]: r["entidade_id"] for r in warehouse.read("entidade").collect()}
    lines = [f"{ids['1']},-25.4,-49.2,numero,x", f"{ids['2']},-25.4,-49.2,cep,x", f"{ids['3']},,,,"]
    with open(f"{folders['results']}/a.csv", "w") as f:
        f.write("\n".join(["entidade_id,lat,lon,precisao,tipo_resultado", *lines]) + "\n")
    confidences, totals = pipelines.store_first_pass(warehouse, folders["results"], answered_only=True)
    assert {tuple(r) for r in confidences.collect()} == {("alta", 1), ("baixa", 2)}
    assert tuple(totals.first()) == (1, 2)
    confidences, _ = pipelines.store_first_pass(warehouse, folders["results"])
    assert {tuple(r) for r in confidences.collect()} == {("alta", 1), ("baixa", 4)}
    before = {r["entidade_id"]: r for r in warehouse.read("geolocalizacao_entidade").collect()}

    pipelines.export_second_pass(warehouse, f"{folders['out']}/second")
    asked = {r["entidade_id"]: r["endereco"] for r in spark.read.json(f"{folders['out']}/second").collect()}
    assert len(asked) == 4 and asked[ids["2"]] == "R. X, 10, BATEL, 81010-120, Curitiba, PR, Brasil"
    found = {"2": [{"lat": "-25.45", "lon": "-49.2", "importance": 0.1, "type": "t"}], "3": []}
    with open(f"{folders['candidates']}/c.json", "w") as f:
        f.write("\n".join(json.dumps({"entidade_id": ids[k], "candidates": c}) for k, c in found.items()))
    confidences, largest = pipelines.store_second_pass(warehouse, folders["candidates"], answered_only=True)
    assert {tuple(r) for r in confidences.collect()} == {("alta", 1), ("baixa", 4)}
    assert [r["entidade_id"] for r in largest.collect()] == [ids["2"]]
    after = {r["entidade_id"]: r for r in warehouse.read("geolocalizacao_entidade").collect()}
    assert {k: r["geocodificado_em"] for k, r in after.items()} == {k: r["geocodificado_em"] for k, r in before.items()}
    reviewed = {k for k, r in after.items() if r["revisado_em"] is not None}
    assert reviewed == {ids["2"], ids["3"]} and after[ids["2"]]["lat"] == -25.45
    pipelines.store_second_pass(warehouse, folders["candidates"])
    assert warehouse.read("geolocalizacao_entidade").filter("fonte_secundaria IS NULL").count() == 1
    hits, totals = requests.radius_search(
        warehouse.read("geolocalizacao_entidade"), warehouse.read("observacao_entidade"), warehouse.read("entidade"),
        warehouse.read("cnae_categoria_map"), lat=-25.4, lon=-49.2, radius_m=1000,
    )
    assert [h["nome"] for h in hits.collect()] == ["EMPRESA 1"] and tuple(totals.first()) == (1, 0)


def test_every_snapshot_at_once_equals_one_by_one(warehouse, folders, spark, tmp_path):
    whole = pipelines.Warehouse(spark, str(tmp_path))
    pipelines.ingest_activity_codes(whole, folders["codes"])
    pipelines.seed_categories(whole)
    pipelines.ingest_territories(whole, folders["features"])
    run, unmatched = pipelines.ingest_permits(whole, folders["permits"], every_snapshot=True)
    assert vars(run) == {"read": 8, "written": 7, "failed": 0} and unmatched.count() == 1
    run, histogram = pipelines.detect_every_pair(whole)
    assert vars(run) == {"read": 5, "written": 4, "failed": 0} and histogram.count() == 4
    assert vars(pipelines.detect_every_pair(whole)[0]) == {"read": 5, "written": 0, "failed": 0}
    for table in ("observacao_entidade", "fato_evento_territorial", "entidade"):
        assert content(whole.read(table)) == content(warehouse.read(table))


def test_failed_run_is_recorded(warehouse, tmp_path):
    with pytest.raises(FileNotFoundError):
        pipelines.ingest_permits(warehouse, str(tmp_path))
    last = warehouse.read("pipeline_run").orderBy(F.desc("iniciado_em")).first()
    assert (last["conector_id"], last["status"], last["registros_lidos"]) == ("alvaras_smf", "falha", 0)


def test_a_line_with_too_many_fields_stops_the_load(warehouse, tmp_path):
    write(tmp_path, "2026-09-01_Alvaras_-_Base_de_Dados.csv", permit("1", "01/01/2010"), permit("2", "01/01/2010") + ";x")
    with pytest.raises(ValueError, match="1 lines"):
        pipelines.ingest_permits(warehouse, str(tmp_path))
    assert warehouse.read("observacao_entidade").filter("observado_em = '2026-09-01'").count() == 0


def test_versions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "a bigint"
    assert tables.read_current(spark, path, schema).count() == 0
    for n in (5, 3, 4):
        old = tables.read_current(spark, path, schema)
        assert tables.replace(spark.range(n).select(F.col("id").alias("a")), path, sort_by=("a",)) == n
        assert old.count() in (0, 5, 3)
    (tmp_path / "t" / "version-00000009").mkdir()  # left by a failed job
    assert tables.read_current(spark, path, schema).count() == 4
    assert tables.replace(tables.read_current(spark, path, schema).filter("a > 0"), path) == 3
    assert tables.read_current(spark, path, schema).count() == 3
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["version-00000003", "version-00000009", "version-00000010"]


def test_insert_ignore_keeps_both_categories(spark):
    schema = "codigo_cnae string, categoria_id string"
    existing = spark.createDataFrame([("1", "a"), ("2", "b")], schema)
    new = spark.createDataFrame([("1", "a"), ("1", "c"), ("1", "c")], schema)
    got = upserts.added(existing, new, "codigo_cnae", "categoria_id").collect()
    assert sorted(map(tuple, got)) == [("1", "a"), ("1", "c"), ("2", "b")]
