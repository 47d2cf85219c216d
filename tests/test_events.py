import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrapulse.operators import counts, events, latest
from terrapulse.operators.categories import resolve_category
from terrapulse.schemas import ATTRIBUTES, OBSERVATION
from terrapulse.sources.reference import CATEGORIES, CATEGORY_CODES, category_seed, code_category_seed

D0, D1, D2 = (dt.date(2026, m, 1) for m in (7, 8, 9))
FOOD, BEAUTY, UNKNOWN = "I.56.1.1-2/03-00", "S.96.0.2-5/01-00", "5-70.20.00"


def observation(entity, day, source="alvaras_smf", **attributes):
    return (
        f"{entity}@{day}", entity, day, tuple(attributes.get(a) for a in ATTRIBUTES), source, "ref", None,
    )


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), OBSERVATION)


def detected(spark, *rows, previous=D0, current=D1):
    found = events.detect_events(frame(spark, *rows), code_category_seed(spark), previous, current)
    return {r["entidade_id"]: r for r in found.collect()}


@pytest.mark.parametrize(
    ("start", "current", "kind", "confidence"),
    [
        ("2026-07-15", D1, "ABERTURA_CONFIRMADA", "alta"),
        ("2026-08-01", D1, "PRIMEIRA_OBSERVACAO", "baixa"),
        ("2026-06-30", D1, "PRIMEIRA_OBSERVACAO", "baixa"),
        ("2010-07-15", D1, "PRIMEIRA_OBSERVACAO", "baixa"),
        (None, D1, "PRIMEIRA_OBSERVACAO", "baixa"),
        ("", D1, "PRIMEIRA_OBSERVACAO", "baixa"),
        ("2025-12-31", dt.date(2026, 1, 1), "ABERTURA_CONFIRMADA", "alta"),
    ],
)
def test_first_appearance(spark, start, current, kind, confidence):
    got = detected(spark, observation("e", current, inicio_atividade=start, territorio_id="t"), current=current)["e"]
    assert (got["event_type"], got["confianca"], got["territorio_id"]) == (kind, confidence, "t")
    assert got["origem_observacoes"] == [f"e@{current}"] and got["data_evento"] == current and got["payload"] == {}


def test_pair_rules(spark):
    got = detected(
        spark,
        observation("same", D0, cnae_principal=FOOD), observation("same", D1, cnae_principal=FOOD),
        observation("changed", D0, cnae_principal=FOOD, territorio_id="a"),
        observation("changed", D1, cnae_principal=BEAUTY, territorio_id="b"),
        observation("lost code", D0, cnae_principal=FOOD), observation("lost code", D1),
        observation("empty code", D0, cnae_principal=""), observation("empty code", D1, cnae_principal=FOOD),
        observation("gone", D0, cnae_principal=FOOD, territorio_id="a"),
        observation("other source", D1, source="x"),
        observation("other date", D2),
    )
    assert set(got) == {"changed", "gone"}
    changed, gone = got["changed"], got["gone"]
    assert changed["event_type"] == "MUDANCA_CATEGORIA" and changed["confianca"] == "media"
    assert changed["territorio_id"] == "b"
    assert changed["payload"] == {"cnae_anterior": FOOD, "cnae_atual": BEAUTY, "categoria_id": "beleza_estetica"}
    assert changed["origem_observacoes"] == [f"changed@{D0}", f"changed@{D1}"]
    assert gone["event_type"] == "DESAPARECIMENTO" and gone["confianca"] == "baixa"
    assert gone["territorio_id"] == "a" and gone["data_evento"] == D1
    assert gone["payload"] == {"categoria_id": "bares_restaurantes"}
    assert gone["origem_observacoes"] == [f"gone@{D0}"]


def test_all_pairs_equal_the_single_pairs(spark):
    days = [dt.date(2026, m, 1) for m in range(1, 7)]
    codes = [FOOD, BEAUTY, UNKNOWN]
    rows = [
        observation(f"e{e}", day, cnae_principal=codes[(e + i) % 3], inicio_atividade=f"2026-0{1 + e % 5}-10")
        for e in range(40)
        for i, day in enumerate(days)
        if (e * 7 + i * 5) % 11 not in (0, 3, 4, 8)
    ]
    seen, code_map = frame(spark, *rows), code_category_seed(spark)

    def keys(df):
        columns = ("evento_id", "event_type", "territorio_id", "data_evento", "origem_observacoes", "payload")
        return sorted(str([r[c] for c in columns]) for r in df.collect())

    single = [k for a, b in zip(days, days[1:]) for k in keys(events.detect_events(seen, code_map, a, b))]
    assert keys(events.detect_all_events(seen, code_map)) == sorted(single)


def test_event_ids_repeat(spark):
    rows = [observation("e", D1), observation("f", D1)]
    first, second = detected(spark, *rows), detected(spark, *rows)
    assert {k: r["evento_id"] for k, r in first.items()} == {k: r["evento_id"] for k, r in second.items()}


def test_seeds():
    codes = [c for group in CATEGORY_CODES.values() for c in group]
    assert len(CATEGORIES) == 26 and len(codes) == 79 == len(set(codes))
    assert set(CATEGORY_CODES) == set(CATEGORIES)
    assert all(len(c) == 7 and c.isdigit() for c in codes)


def test_a_code_with_two_categories_does_not_multiply_rows(spark):
    code_map = code_category_seed(spark).union(spark.createDataFrame([("5611203", "alimentacao_varejo")], "a string, b string"))
    df = spark.createDataFrame([(FOOD,), (UNKNOWN,), (None,)], "c string")
    got = {r["c"]: r["categoria_id"] for r in resolve_category(df, code_map, "c").collect()}
    assert got == {FOOD: "bares_restaurantes", UNKNOWN: None, None: None}
    assert category_seed(spark).count() == 26


def test_event_counts_group_nulls_and_skip_other_types(spark):
    rows = [
        ("t", {"categoria_id": "c"}, D1, "PRIMEIRA_OBSERVACAO"),
        ("t", {"categoria_id": "c"}, dt.date(2026, 8, 20), "PRIMEIRA_OBSERVACAO"),
        ("t", {}, D1, "PRIMEIRA_OBSERVACAO"),
        (None, {}, D1, "DESAPARECIMENTO"),
        (None, {"x": "y"}, D1, "DESAPARECIMENTO"),
        ("t", {"categoria_id": "c"}, D1, "ABERTURA_CONFIRMADA"),
        ("t", {"categoria_id": "c"}, D1, "MUDANCA_CATEGORIA"),
    ]
    df = spark.createDataFrame(rows, "territorio_id string, payload map<string,string>, data_evento date, event_type string")
    got = {tuple(r) for r in counts.event_counts(df).collect()}
    assert got == {
        ("t", "c", D1, "PRIMEIRA_OBSERVACAO", 2),
        ("t", None, D1, "PRIMEIRA_OBSERVACAO", 1),
        (None, None, D1, "DESAPARECIMENTO", 2),
        ("t", "c", D1, "ABERTURA_CONFIRMADA", 1),
    }


def test_opening_counts_pick_the_latest_observation_with_a_start_date(spark):
    seen = frame(
        spark,
        observation("a", D0, inicio_atividade="2020-05-03", territorio_id="t", cnae_principal=FOOD),
        observation("a", D1, inicio_atividade="2020-06-03", territorio_id="t", cnae_principal=FOOD),
        observation("a", D2, territorio_id="t", cnae_principal=FOOD),  # no start date: not looked at
        observation("b", D0, inicio_atividade="2020-06-09", territorio_id="t", cnae_principal=FOOD),
        observation("b", D1, inicio_atividade="2020-06-09", cnae_principal=FOOD),  # newest has no territory
        observation("c", D1, inicio_atividade="2020-06-30", territorio_id="t", cnae_principal=UNKNOWN),
        observation("d", D1, "x", inicio_atividade="2020-06-30", territorio_id="t"),
    )
    june = dt.date(2020, 6, 1)
    expected = {("t", "bares_restaurantes", june, 1), ("t", None, june, 1)}
    code_map = code_category_seed(spark)
    assert {tuple(r) for r in counts.opening_counts(seen, code_map).collect()} == expected
    two_steps = counts.by_category(counts.opening_counts_by_code(seen), code_map)
    assert {tuple(r) for r in two_steps.collect()} == expected
    newest = latest.latest_observations(seen, {"inicio": "atributos.inicio_atividade"})
    assert {tuple(r) for r in newest.filter(F.col("entidade_id").isin("a", "b")).collect()} == {("a", None), ("b", "2020-06-09")}
