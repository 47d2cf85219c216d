import pytest

from terrapulse.operators import quality


@pytest.mark.parametrize(
    ("rules", "schema", "rows"),
    [
        (quality.entity_rules, "tipo_entidade string, identificador_fonte string",
         [(("comercio", "1"), []), (("", "1"), ["tipo_entidade"]), (("comercio", None), ["identificador_fonte"])]),
        (quality.observation_rules, "atributos struct<a:string>, fonte_id string, snapshot_ref string",
         [((("x",), "f", "s"), []), ((None, "", None), ["atributos", "fonte_id", "snapshot_ref"])]),
        (quality.event_rules, "entity_type string, event_type string, confianca string, origem_observacoes array<string>",
         [(("c", "FECHAMENTO_CONFIRMADO", "alta", ["o"]), []), (("", "X", "y", []), ["entity_type", "event_type", "confianca", "origem_observacoes"]),
          (("c", None, None, None), ["event_type", "confianca", "origem_observacoes"])]),
        (quality.territory_rules, "territorio_id string, nivel string, nome string, geometria array<array<array<array<double>>>>",
         [(("t", "rua", "n", None), []), (("t", "estado", "", []), ["nivel", "nome", "geometria"]), (("", "cidade", "n", [[[[1.0, 2.0]]]]), ["territorio_id"])]),
        (quality.location_rules, "confianca string, fonte_primaria string", [(("media", "g"), []), (("x", ""), ["confianca", "fonte_primaria"])]),
        (quality.code_rules, "codigo_cnae string, descricao string", [(("1", "d"), []), (("", None), ["codigo_cnae", "descricao"])]),
        (quality.category_rules, "categoria_id string, nome string", [(("1", "d"), []), ((None, ""), ["categoria_id", "nome"])]),
    ],
)
def test_rules(spark, rules, schema, rows):
    df = spark.createDataFrame([row for row, _ in rows], schema).coalesce(1)
    assert [r["motivos"] for r in quality.checked(df, rules()).collect()] == [broken for _, broken in rows]
    good = sum(not broken for _, broken in rows)
    assert quality.valid(df, rules()).count() == good
    assert quality.rejected(df, rules()).count() == len(rows) - good


def test_orphans_and_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("a",)], "id string")
    assert [r["k"] for r in quality.orphans(df, "k", parent, "id").collect()] == ["b"]
    assert [tuple(r) for r in quality.duplicates(df, "k").collect()] == [("a", 2)]
    found = quality.report({"orphans": quality.orphans(df, "k", parent, "id"), "twice": quality.duplicates(df, "k")})
    assert {tuple(r) for r in found.collect()} == {("orphans", 1), ("twice", 1)}
