"""Maintained tables: buckets, the latest observations, counts by what changed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from terrapulse.functions.geodesy import place_order
from terrapulse.operators import counts
from terrapulse.operators.latest import START_FIELDS, latest_observations, state_after, state_of
from terrapulse.plans import pipelines
from terrapulse.schemas import ATTRIBUTES, EVENT, LATEST, OBSERVATION
from terrapulse.sinks import tables
from terrapulse.sinks.buckets import BucketedTable
from terrapulse.sinks.upserts import overwritten


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_merge_touches_its_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "k bigint, x string", ("k",), 8)
    assert table.read().count() == 0 and table.versions() == []
    by_key = lambda old, new: overwritten(old, new, "k")
    frame = lambda pairs: spark.createDataFrame(pairs, "k bigint, x string")
    assert table.merge(frame([(i, "a") for i in range(100)]), by_key) == 8
    before = files(tmp_path)
    assert table.merge(frame([(5, "b"), (500, "c")]), by_key) in (1, 2)
    after = files(tmp_path)
    assert before.items() <= after.items() and len(after) - len(before) in (1, 2)
    want = [(i, "b" if i == 5 else "a") for i in range(100)] + [(500, "c")]
    assert rows(table.read()) == sorted(want, key=str)
    assert rows(table.read(table.versions()[0])) == sorted(((i, "a") for i in range(100)), key=str)
    changed = table.changed(*table.versions())
    assert {r["b"] for r in frame([(5, ""), (500, "")]).select(table.bucket().alias("b")).collect()} == changed
    assert table.merge(frame([]), by_key) == 0 and len(table.versions()) == 2
    # The number of buckets stays that of the first write.
    assert rows(BucketedTable(spark, str(tmp_path), "k bigint, x string", ("k",), 3).read()) == sorted(want, key=str)
    for _ in range(5):
        table.merge(frame([(5, "d")]), by_key)
    assert len(table.versions()) == 4 and table.read().filter("x = 'd'").count() == 1 and table.read().count() == 101


def test_a_failed_merge_leaves_the_table(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "k bigint, x string", ("k",), 4)
    one = spark.createDataFrame([(1, "a")], "k bigint, x string")
    table.merge(one, lambda old, new: new)
    with pytest.raises(Exception, match="broken"):
        table.merge(one, lambda old, new: new.withColumn("x", F.raise_error(F.lit("broken")).cast("string")))
    assert rows(table.read()) == [(1, "a")] and len(table.versions()) == 1
    table.merge(spark.createDataFrame([(1, "b")], "k bigint, x string"), lambda old, new: new)
    assert rows(table.read()) == [(1, "b")]


def observations(spark, seed, days, source="alvaras_smf"):
    rng, out = random.Random(seed), []
    for day in days:
        for e in range(40):
            if rng.random() < 0.7:
                facts = dict.fromkeys(ATTRIBUTES) | {
                    "numero_do_alvara": str(e), "territorio_id": rng.choice(["a", "b", None]), "nome_empresarial": f"N{e} {day}",
                    "inicio_atividade": rng.choice([None, "2020-01-05", "2021-03-01"]), "cnae_principal": rng.choice(["x", "y", None]),
                }
                out.append((f"{e}-{day}", f"e{e}", day, tuple(facts[a] for a in ATTRIBUTES), source, "f", None))
    schema = OBSERVATION.replace("observado_em date", "observado_em string").replace("criado_em timestamp", "criado_em string")
    df = spark.createDataFrame(out, schema)
    return df.withColumn("observado_em", F.to_date("observado_em")).withColumn("criado_em", F.current_timestamp())


DAYS = ["2026-03-01", "2026-01-01", "2026-02-01", "2026-04-01"]


def test_state_equals_the_history(spark):
    """Late, repeated and overlapping loads end in the state of all observations."""
    history = observations(spark, 1, DAYS).cache()
    state = state_of(history.filter("observado_em = '2026-03-01'"))
    for day in ("2026-01-01", "2026-04-01", "2026-01-01", "2026-02-01"):
        state = state_after(state, state_of(history.filter(F.col("observado_em") == day)))
    state = state.cache()
    assert rows(state) == rows(state_of(history))
    for start in (False, True):
        wanted = latest_observations(history, START_FIELDS, source="alvaras_smf", with_start_date=start)
        found = latest_observations(state, START_FIELDS, source="alvaras_smf", with_start_date=start)
        assert rows(found) == rows(wanted) and found.count() > 20
    alone = spark.createDataFrame([], LATEST)
    assert "Aggregate" not in latest_observations(alone, START_FIELDS)._jdf.queryExecution().optimizedPlan().toString()


def test_latest_and_opening_counts_by_what_changed(spark, tmp_path):
    """Equal to a full recount after loads in any order; a load reads its partition and touched buckets only."""
    w = pipelines.Warehouse(spark, str(tmp_path), buckets=4)
    w.replace("cnae_categoria_map", spark.createDataFrame([("x", "c1")], "codigo_cnae string, categoria_id string"))
    history = observations(spark, 2, DAYS).cache()
    for i, day in enumerate(DAYS):
        some = history.filter(F.col("observado_em") == day)
        if i == 3:
            some = some.filter("entidade_id in ('e1', 'e2', 'e3')")
        for _ in range(2):
            tables.append_once(some, w.path("observacao_entidade"), OBSERVATION, pipelines.OBSERVATION_KEY, "observado_em")
        before = files(tmp_path / "ultima_observacao")
        assert pipelines.update_latest(w) == 1 and pipelines.update_latest(w) == 0
        assert before.items() <= files(tmp_path / "ultima_observacao").items()
        for _ in range(2):
            pipelines.rebuild_opening_counts(w)
        want = counts.opening_counts(w.read("observacao_entidade"), w.read("cnae_categoria_map"))
        assert rows(w.read("contagem_inicio_atividade").drop("calculado_em")) == rows(want.select("territorio_id", "categoria_id", "mes", "contagem"))
    assert rows(pipelines.latest(w)) == rows(state_of(w.read("observacao_entidade")))


def test_event_counts_by_new_partitions(spark, tmp_path):
    w = pipelines.Warehouse(spark, str(tmp_path), buckets=4)
    rng = random.Random(3)

    def load(day, start, n):
        found = [
            (f"{day}{i}", "comercio", rng.choice(["ABERTURA_CONFIRMADA", "PRIMEIRA_OBSERVACAO", "DESAPARECIMENTO", "MUDANCA_CATEGORIA"]), f"e{i}", rng.choice(["a", None]), day, None, "alta", [], {"categoria_id": rng.choice(["c", "d"])})
            for i in range(start, start + n)
        ]
        schema = EVENT.replace("data_evento date", "data_evento string").replace("data_ingestao timestamp", "data_ingestao string")
        df = spark.createDataFrame(found, schema).withColumn("data_evento", F.to_date("data_evento")).withColumn("data_ingestao", F.current_timestamp())
        tables.append_once(df, w.path("fato_evento_territorial"), EVENT, pipelines.EVENT_KEY, "data_evento")

    for day, start, n in (("2026-02-01", 0, 30), ("2026-01-01", 0, 20), ("2026-02-01", 30, 5)):
        load(day, start, n)
        before = files(tmp_path / "contagem_eventos_por_dia")
        pipelines.rebuild_event_counts(w)
        after = files(tmp_path / "contagem_eventos_por_dia")
        assert {f for f in before if day not in f} == {f for f in after if day not in f and before.get(f) == after[f]}
        want = counts.event_counts(w.read("fato_evento_territorial"))
        assert rows(w.read("contagem_eventos").drop("calculado_em")) == rows(want)
    before = files(tmp_path / "contagem_eventos_por_dia")
    pipelines.rebuild_event_counts(w)
    assert files(tmp_path / "contagem_eventos_por_dia") == before


def test_place_order(spark):
    """Bits by turns, against plain arithmetic; neighbours of a crowded city share their first bits."""
    places = [(-90.0, -180.0), (90.0, 180.0), (-25.43, -49.27), (-25.44, -49.26), (12.5, 99.9), (None, 1.0)]
    got = [r["z"] for r in spark.createDataFrame(places, "lat double, lon double").select(place_order("lat", "lon").alias("z")).collect()]

    def plain(lat, lon):
        if lat is None:
            return None
        x, y = (min(int(share * 65536), 65535) for share in ((lat + 90) / 180, (lon + 180) / 360))
        return sum((x >> b & 1) << (2 * b + 1) | (y >> b & 1) << (2 * b) for b in range(16))

    assert got == [plain(*p) for p in places]
    assert got[2] >> 12 == got[3] >> 12


def test_append_once_of_known_and_new_partitions(spark, tmp_path):
    """Rows of new dates and missing keys of known ones are appended, shaped; keys with nulls equal none."""
    schema, path = "k string, d date, v string", str(tmp_path / "t")

    def load(*rows):
        new = spark.createDataFrame(rows, "k string, d string, n int").withColumn("d", F.col("d").cast("date"))
        return tables.append_once(new, path, schema, ("k", "d"), "d", shape=lambda df: df.select("k", "d", F.concat(F.lit("v"), "n").alias("v")))

    first = [("a", "2026-01-01", 1), ("b", "2026-01-01", 2), (None, "2026-01-01", 3)]
    assert load(*first) == 3
    assert load(*first[:2]) == 0
    assert load(*first, ("c", "2026-01-01", 4), ("a", "2026-02-01", 5)) == 3
    got = sorted(((r["k"], str(r["d"]), r["v"]) for r in tables.read_appended(spark, path, schema).collect()), key=str)
    want = [("a", "2026-01-01", "v1"), ("a", "2026-02-01", "v5"), ("b", "2026-01-01", "v2"), ("c", "2026-01-01", "v4"), (None, "2026-01-01", "v3"), (None, "2026-01-01", "v3")]
    assert got == sorted(want, key=str)
