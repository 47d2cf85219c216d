import datetime as dt
import json

import pytest

from terrapulse.operators import normalize
from terrapulse.schemas import ATTRIBUTES, PERMIT_COLUMNS
from terrapulse.sources import geocoders, permits, reference

NAME = "2026-08-01_Alvaras_-_Base_de_Dados.csv"
OLD = "2026-07-01_Alvaras_-_Base_de_Dados.csv"


def line(**values):
    return ";".join(values.get(c, "") for c in PERMIT_COLUMNS)


def write(folder, name, *lines):
    text = "\n".join([";".join(PERMIT_COLUMNS), *lines]) + "\n"
    (folder / name).write_text(text, encoding="latin-1")


@pytest.fixture
def folder(tmp_path):
    write(
        tmp_path,
        NAME,
        line(NOME_EMPRESARIAL="PADARIA ALFA", INICIO_ATIVIDADE="17/11/2009", NUMERO_DO_ALVARA="4004", BAIRRO="MOSSUNGUÊ", CNAE_ATIVIDADE_PRINCIPAL="7-31.40.12", NOME_FANTASIA="***"),
        line(NOME_EMPRESARIAL="OFICINA BETA", INICIO_ATIVIDADE="30/06/1998", NUMERO_DO_ALVARA="5005", BAIRRO="LUGAR NENHUM", CNAE_ATIVIDADE_PRINCIPAL="2-22.33.44"),
        line(NOME_EMPRESARIAL="SEM NUMERO", INICIO_ATIVIDADE="30/06/1998", NUMERO_DO_ALVARA="***", BAIRRO="CENTRO"),
        line(NOME_EMPRESARIAL='"QUOTED; ""INNER"" AND\nTWO LINES"', NUMERO_DO_ALVARA=" 7 ", BAIRRO="SÃO LOURENÇO\xa0"),
        line(NOME_EMPRESARIAL="PADARIA OUTRA VEZ", NUMERO_DO_ALVARA="4004", BAIRRO="MOSSUNGUÊ"),
        line(NOME_EMPRESARIAL="TOO LONG", NUMERO_DO_ALVARA="8") + ";x",
    )
    write(tmp_path, OLD, line(NUMERO_DO_ALVARA="1"))
    write(tmp_path, "2026-09-01_Alvaras_-_Dicionario_de_Dados.csv", line(NUMERO_DO_ALVARA="2"))
    write(tmp_path, "2026-09-15_Alvaras_-_Base_de_Dados.csv", line(NUMERO_DO_ALVARA="3"))
    return str(tmp_path)


@pytest.fixture
def slugs(spark):
    rows = [("curitiba-bairro-mossungue", "Mossunguê"), ("curitiba-bairro-sao-lourenco", "São Lourenço")]
    return normalize.territory_slugs(spark.createDataFrame(rows, "territorio_id string, nome string"))


def test_newest_snapshot_is_found(spark, folder, tmp_path):
    assert permits.latest_snapshot(spark, folder) == NAME
    listed = permits.list_snapshots(spark, folder).orderBy("file_name").collect()
    assert [(r["file_name"], r["observado_em"]) for r in listed] == [(OLD, dt.date(2026, 7, 1)), (NAME, dt.date(2026, 8, 1))]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        permits.latest_snapshot(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        permits.read_permits(spark, folder, "2026-09-01_Alvaras_-_Dicionario_de_Dados.csv")


def test_normalize(spark, folder, slugs):
    lines = permits.read_permits(spark, folder)
    assert lines.count() == 6 and permits.overlong_lines(lines).count() == 1
    assert [r["NOME_EMPRESARIAL"] for r in normalize.without_number(lines).collect()] == ["SEM NUMERO"]
    found = normalize.normalize_permits(lines, slugs)
    rows = found.collect()
    assert len(rows) == 5 and {r["observado_em"] for r in rows} == {dt.date(2026, 8, 1)}
    assert all(r["snapshot_ref"].endswith(NAME) for r in rows)
    by_number = {r["identificador_fonte"]: r for r in normalize.first_lines(found).join(
        normalize.entities_of(found), "entidade_id").collect()}
    assert set(by_number) == {"4004", "5005", "7", "8"}
    bakery = by_number["4004"]["atributos"]
    assert list(bakery.asDict()) == list(ATTRIBUTES)
    assert (bakery["nome_empresarial"], bakery["territorio_id"]) == ("PADARIA ALFA", "curitiba-bairro-mossungue")
    assert (bakery["inicio_atividade"], bakery["nome_fantasia"], bakery["cep"]) == ("2009-11-17", None, None)
    assert by_number["5005"]["atributos"]["territorio_id"] is None
    seven = by_number["7"]["atributos"]
    assert seven["nome_empresarial"] == 'QUOTED; "INNER" AND\nTWO LINES'
    assert (seven["bairro"], seven["territorio_id"]) == ("SÃO LOURENÇO", "curitiba-bairro-sao-lourenco")
    assert [tuple(r) for r in normalize.unmatched_names(found).collect()] == [("LUGAR NENHUM", 1)]
    assert sorted(r[0] for r in normalize.distinct_names(found).collect()) == ["LUGAR NENHUM", "MOSSUNGUÊ", "SÃO LOURENÇO"]


def test_without_territories_none_is_resolved(spark, folder):
    found = normalize.normalize_permits(permits.read_permits(spark, folder)).collect()
    assert {r["atributos"]["territorio_id"] for r in found} == {None}


def test_all_snapshots_in_one_scan(spark, folder):
    found = permits.read_permits(spark, folder, every_snapshot=True)
    assert {(r["observado_em"].month, r["n"]) for r in found.groupBy("observado_em").count().withColumnRenamed("count", "n").collect()} == {(7, 1), (8, 6)}
    single = permits.read_permits(spark, folder, OLD, multi_line=False)
    assert [r["NUMERO_DO_ALVARA"] for r in single.collect()] == ["1"]


def test_columns_are_found_by_name(spark, folder, tmp_path):
    other = "2026-06-01_Alvaras_-_Base_de_Dados.csv"
    (tmp_path / other).write_text("BAIRRO;EXTRA COLUMN;NUMERO_DO_ALVARA\nMOSSUNGUÊ;x;77\nCENTRO;y\n", encoding="latin-1")
    (row,) = normalize.normalize_permits(permits.read_permits(spark, folder, other)).collect()
    assert row["identificador_fonte"] == "77"
    assert (row["atributos"]["bairro"], row["atributos"]["cep"]) == ("MOSSUNGUÊ", None)
    found = permits.read_permits(spark, folder, every_snapshot=True)
    assert {(r["observado_em"].month, r["count"]) for r in found.groupBy("observado_em").count().collect()} == {(6, 2), (7, 1), (8, 6)}
    assert permits.overlong_lines(found).count() == 1


def test_cleaned_table(spark):
    df = spark.createDataFrame([(" a ", "***", 1)], "x string, y string, n int")
    assert tuple(normalize.cleaned(df).first()) == ("a", None, 1)
    assert tuple(normalize.cleaned(df, "x").first()) == ("a", "***", 1)


def test_activity_codes(spark, tmp_path):
    tree = {
        "id": "6209100", "descricao": "SUPORTE TÉCNICO",
        "classe": {"id": "62091", "descricao": "c", "grupo": {"id": "620", "descricao": "g", "divisao": {
            "id": "62", "descricao": "d", "secao": {"id": "J", "descricao": "s"}}}},
        "observacoes": ["ignored"],
    }
    (tmp_path / "codes.json").write_text(json.dumps([tree, {**tree, "id": "6209102"}]), encoding="utf-8")
    rows = reference.read_activity_codes(spark, str(tmp_path)).orderBy("codigo_cnae").collect()
    assert tuple(rows[0]) == ("6209100", "SUPORTE TÉCNICO", "J", "62", "620", "62091", "6209100")
    assert len(rows) == 2


def feature(objectid, nome, rings=None):
    return {"attributes": {"objectid": objectid, "nome": nome}, **({} if rings is None else {"geometry": {"rings": rings}})}


SQUARE = [[670000.0, 7183000.0], [670000.0, 7183010.0], [670010.0, 7183010.0], [670010.0, 7183000.0], [670000.0, 7183000.0]]


def write_features(folder, *pages):
    for i, page in enumerate(pages):
        (folder / f"page{i}.json").write_text(json.dumps({"features": page}, ensure_ascii=False), encoding="utf-8")


def test_territories_from_pages(spark, tmp_path):
    write_features(
        tmp_path,
        [feature(1, "São Lourenço", [SQUARE]), feature(2, " CENTRO ")],
        [feature(3, None), feature(4, "  ")],
        [feature(5, "Short", [SQUARE[:3]])],
    )
    assert reference.read_features(spark, str(tmp_path)).count() == 5
    rows = {r["nome"]: r for r in reference.read_territories(spark, str(tmp_path)).collect()}
    assert set(rows) == {"São Lourenço", "CENTRO", "Short"}
    assert rows["São Lourenço"]["territorio_id"] == "curitiba-bairro-sao-lourenco"
    assert len(rows["São Lourenço"]["geometria"]) == 1 and rows["CENTRO"]["geometria"] is None
    assert rows["Short"]["geometria"] == []
    assert rows["CENTRO"]["nivel"] == "bairro" and rows["CENTRO"]["cidade_id"] == "curitiba"


def test_geocoder_results(spark, tmp_path):
    (tmp_path / "out.csv").write_text(
        '"entidade_id","lat","lon","precisao","tipo_resultado"\n"id1",-25.5011,-49.3022,"numero","dn01"\n"id2",,,,\n"id3","","","",""\n',
        encoding="utf-8",
    )
    got = {r["entidade_id"]: tuple(r)[1:5] for r in geocoders.read_geocoder_results(spark, str(tmp_path)).collect()}
    assert got == {"id1": (-25.5011, -49.3022, "numero", "dn01"), "id2": (None,) * 4, "id3": (None,) * 4}


def test_candidates_file(spark, tmp_path):
    rows = [{"entidade_id": "a", "candidates": [{"lat": "-25.4", "lon": "-49.2", "importance": 1e-05, "type": "house", "more": 1}]}, {"entidade_id": "b", "candidates": []}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    got = {r["entidade_id"]: r["candidates"] for r in geocoders.read_candidates(spark, str(tmp_path)).collect()}
    assert got["b"] == [] and got["a"][0]["lat"] == "-25.4" and got["a"][0]["importance"] == 1e-05
