"""The readers and pipelines as registered queries.

Each writes the generic tables as raw files or stored tables into a folder of its
own below the shared one, runs the real job over them (twice where that must
change nothing) and returns what is stored. SQL works on the generic tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import queries as b
from bindings import sql as q
from bindings import views as v
from terrapulse.functions.text import display_address, display_name
from terrapulse.operators import categories, geocode
from terrapulse.operators.latest import DISPLAY_FIELDS, latest_observations
from terrapulse.plans import pipelines
from terrapulse.schemas import ATTRIBUTES, PERMIT_COLUMNS
from terrapulse.sinks import tables
from terrapulse.sinks.upserts import entities_after, locations_after
from terrapulse.sources import geocoders
from terrapulse.sources.reference import code_category_seed

_MONTHS = ("2026-07-01", "2026-08-01")


def _warehouse(spark: SparkSession) -> pipelines.Warehouse:
    return pipelines.Warehouse(spark, b._scratch(spark), buckets=16)


def _permit_file(lines: DataFrame, folder: str, month: str) -> None:
    """One permit file with its header, as it is landed: Latin-1, quotes where they are needed."""
    spark = lines.sparkSession
    parts = f"{folder}/parts-{month}"
    rows = lines.orderBy("position.line").select(*PERMIT_COLUMNS).coalesce(1)
    rows.write.options(
        sep=";", header="true", encoding="ISO-8859-1", quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(parts)
    fs, _ = tables._files(spark, parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    (part,) = [n for n in tables._child_names(spark, parts) if n.startswith("part-")]
    fs.rename(path(f"{parts}/{part}"), path(f"{folder}/{month}_Alvaras_-_Base_de_Dados.csv"))


def _latin(lines: DataFrame) -> DataFrame:
    """A line break and a separator inside a quoted name, in every ninth line."""
    name = F.col("NOME_EMPRESARIAL")
    odd = F.col("position.line") % 9 == 4
    return lines.withColumn("NOME_EMPRESARIAL", F.when(odd, F.concat(name, F.lit(';"A"\nB'))).otherwise(name))


_KEPT = [a for a in ATTRIBUTES if a != "nome_empresarial"]


@b.query(
    "ingest_permits",
    f"""WITH {q.PERMITS}, months AS (SELECT unnest(['2026-07-01', '2026-08-01']) AS observado_em)
SELECT observado_em, {', '.join(_KEPT)}, CASE WHEN p_partkey % 9 = 4 THEN nome_empresarial || chr(160) || ';"A"' || chr(10) || 'B' ELSE nome_empresarial END
  AS nome_empresarial, CAST((SELECT count(*) FROM permits) AS BIGINT) AS lidas, CAST((SELECT count(*) FROM permits) AS BIGINT) AS gravadas,
  CAST(4 AS BIGINT) AS execucoes FROM permits, months""",
)
def ingest_permits(spark: SparkSession, sf: str) -> DataFrame:
    """Two monthly files read and loaded, each twice: every line is stored once, and every run leaves its audit row."""
    w = _warehouse(spark)
    territories = v.nation_names(spark, sf).select(
        "territorio_id", F.lit("bairro").alias("nivel"), "nome", F.lit(None).cast("array<string>").alias("nome_alternativo"),
        F.lit(None).cast("array<array<array<array<double>>>>").alias("geometria"),
        F.lit(None).cast("string").alias("territorio_pai_id"), F.lit("curitiba").alias("cidade_id"),
    )
    w.replace("dim_territorio", territories)
    landed = b._scratch(spark)
    for month in _MONTHS:
        _permit_file(_latin(v.raw_permits(spark, sf)), landed, month)
    runs = [pipelines.ingest_permits(w, landed, f"{month}_Alvaras_-_Base_de_Dados.csv")[0] for month in _MONTHS * 2]
    stored = w.read("observacao_entidade")
    return stored.select(
        F.col("observado_em").cast("string").alias("observado_em"),
        *[F.col(f"atributos.{a}").alias(a) for a in ATTRIBUTES],
        F.lit(runs[0].read).cast("bigint").alias("lidas"),
        F.lit(runs[1].written + runs[2].written + runs[3].written).cast("bigint").alias("gravadas"),
        F.lit(w.read("pipeline_run").filter("status = 'sucesso'").count()).cast("bigint").alias("execucoes"),
    )


def _with_events(spark: SparkSession, sf: str) -> pipelines.Warehouse:
    """A warehouse with all observations, and the events of every pair detected twice."""
    w = _warehouse(spark)
    seen = v.observations(spark, sf).withColumn("criado_em", F.current_timestamp())
    tables.append_once(seen, w.path("observacao_entidade"), pipelines.schemas.OBSERVATION, pipelines.OBSERVATION_KEY, "observado_em")
    w.replace("cnae_categoria_map", code_category_seed(spark))
    for _ in range(2):
        pipelines.detect_every_pair(w)
    return w


@b.query("detected_events", b.ORACLES["all_pair_events"])
def detected_events(spark: SparkSession, sf: str) -> DataFrame:
    return b._flat_events(_with_events(spark, sf).read("fato_evento_territorial"))


@b.query("rebuilt_event_counts", b.ORACLES["event_counts"])
def rebuilt_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = _with_events(spark, sf)
    for _ in range(2):
        pipelines.rebuild_event_counts(w)
    return b.shown(w.read("contagem_eventos").drop("calculado_em"))


@b.query("rebuilt_opening_counts", b.ORACLES["opening_counts"])
def rebuilt_opening_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = _warehouse(spark)
    seen = v.observations(spark, sf, start_gaps=True).withColumn("criado_em", F.current_timestamp())
    tables.append_once(seen, w.path("observacao_entidade"), pipelines.schemas.OBSERVATION, pipelines.OBSERVATION_KEY, "observado_em")
    w.replace("cnae_categoria_map", code_category_seed(spark))
    for _ in range(2):
        pipelines.rebuild_opening_counts(w)
    return b.shown(w.read("contagem_inicio_atividade").drop("calculado_em"))


@b.query("landed_candidates", b.ORACLES["candidate_status"])
def landed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate lists written as JSON lines and read by the reader of the second pass."""
    path = b._scratch(spark)
    v.search_lists(spark, sf).write.json(path)
    found = geocode.resolve_candidates(geocoders.read_candidates(spark, path))
    return b.shown(found.select("entidade_id", "status", "ponto.lat", "ponto.lon", "confianca_bruta"))


@b.query(
    "landed_geocoder_results",
    f"""SELECT md5('customer:' || c_custkey) AS entidade_id, round(CASE WHEN c_custkey % 7 <> 6 THEN {q.lat('c_custkey')} + line * 0.001::DOUBLE END, 6) AS lat,
  round(CASE WHEN c_custkey % 7 <> 6 THEN {q.lon('c_custkey')} END, 6) AS lon, 'dn01' AS tipo_resultado
FROM customer, (SELECT unnest([0, 1]) AS line) WHERE c_custkey % 9 <> 8 AND (line = 0 OR c_custkey % 5 = 0)""",
)
def landed_geocoder_results(spark: SparkSession, sf: str) -> DataFrame:
    """First-pass results written as quoted CSV and read by their reader."""
    path = b._scratch(spark)
    v.geocoder_results(spark, sf).drop("position").write.options(header="true", quoteAll="true", nullValue="", emptyValue="").csv(path)
    found = geocoders.read_geocoder_results(spark, path)
    return b.shown(found.select("entidade_id", "lat", "lon", "tipo_resultado"))


def _loaded(spark: SparkSession, sf: str, *, start_gaps: bool = False):
    """A warehouse whose observations come in three loads, the newest first and one of them twice; yields after each."""
    w = pipelines.Warehouse(spark, b._scratch(spark), buckets=16)
    w.replace("cnae_categoria_map", code_category_seed(spark))
    seen = v.observations(spark, sf, start_gaps=start_gaps).withColumn("criado_em", F.current_timestamp())
    # The landed loads, each in a folder of its own.
    landed = b._scratch(spark)
    seen.withColumn("carga", F.year("observado_em") % 3).write.partitionBy("carga").parquet(landed)
    for part in (0, 2, 2, 1):
        some = spark.read.schema(f"{pipelines.schemas.OBSERVATION}, carga int").parquet(landed).filter(F.col("carga") == part).drop("carga")
        tables.append_once(some, w.path("observacao_entidade"), pipelines.schemas.OBSERVATION, pipelines.OBSERVATION_KEY, "observado_em")
        yield w


@b.query("latest_maintained", b.ORACLES["latest_observation"])
def latest_maintained(spark: SparkSession, sf: str) -> DataFrame:
    """The state after late and repeated loads, each merged alone."""
    for w in _loaded(spark, sf):
        pipelines.update_latest(w)
    found = latest_observations(pipelines.latest(w), DISPLAY_FIELDS)
    return found.select(
        "entidade_id",
        display_name("nome_fantasia", "nome_empresarial").alias("nome"),
        display_address("endereco", "numero", "bairro").alias("endereco"),
        "cnae_principal",
        "territorio_id",
    )


@b.query("counts_after_late_loads", b.ORACLES["opening_counts"])
def counts_after_late_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Start-date counts by what each load changed: entities move when a newer start date comes."""
    for w in _loaded(spark, sf, start_gaps=True):
        pipelines.rebuild_opening_counts(w)
    return b.shown(w.read("contagem_inicio_atividade").drop("calculado_em"))


def _part_codes(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("codigo_cnae"), F.col("p_name").alias("descricao"), F.char(65 + F.col("p_size") % 20).alias("secao")
    )


def _landed_codes(spark: SparkSession, codes: DataFrame) -> str:
    """The folder with the codes' hierarchies, one JSON array in each of 64 files."""
    code = F.col("codigo_cnae")

    def level(name: str, key, below=None):
        parts = [key.alias("id"), F.lit(name).alias("descricao")]
        return F.struct(*parts, *([] if below is None else [below]))

    division = level("divisao", F.substring(code, 1, 2), level("secao", F.col("secao")).alias("secao"))
    group = level("grupo", F.substring(code, 1, 3), division.alias("divisao"))
    node = F.struct(code.alias("id"), "descricao", level("classe", F.substring(code, 1, 5), group.alias("grupo")).alias("classe"))
    files = codes.groupBy(F.pmod(F.xxhash64(code), F.lit(64)).alias("file")).agg(F.collect_list(node).alias("codes"))
    path = b._scratch(spark)
    files.select("file", F.to_json("codes").alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


@b.query(
    "loaded_activity_codes",
    """SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS codigo_cnae, p_name AS descricao, chr(CAST(65 + p_size % 20 AS INTEGER)) AS secao,
  lpad(CAST(p_partkey AS VARCHAR), 7, '0')[1:2] AS divisao, lpad(CAST(p_partkey AS VARCHAR), 7, '0')[1:3] AS grupo,
  lpad(CAST(p_partkey AS VARCHAR), 7, '0')[1:5] AS classe, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS subclasse FROM part""",
)
def loaded_activity_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Code hierarchies landed as JSON arrays in many files, loaded twice."""
    w = _warehouse(spark)
    path = _landed_codes(spark, _part_codes(spark, sf))
    for _ in range(2):
        pipelines.ingest_activity_codes(w, path)
    return w.read("dim_cnae")


@b.query("seeded_categories", b.ORACLES["code_category"])
def seeded_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Observations by the stored categories: the parts' codes and those of the seeds are loaded, then the seeds, twice."""
    seeds = code_category_seed(spark).select("codigo_cnae", F.lit("semente").alias("descricao"), F.lit("S").alias("secao"))
    parts = _part_codes(spark, sf)
    both = parts.join(seeds, "codigo_cnae", "left_anti").unionByName(seeds)
    w = _warehouse(spark)
    pipelines.ingest_activity_codes(w, _landed_codes(spark, both))
    for _ in range(2):
        pipelines.seed_categories(w)
    found = categories.resolve_category(v.observations(spark, sf), w.read("cnae_categoria_map"), F.col("atributos.cnae_principal"))
    named = w.read("dim_categoria").select("categoria_id", F.lit(True).alias("conhecida"))
    return found.join(named, "categoria_id", "left").select("observacao_id", F.when(F.col("conhecida"), F.col("categoria_id")).alias("categoria_id"))


@b.query(
    "loaded_territories",
    """SELECT 'curitiba-bairro-' || lower(replace(replace(n_name, ' ', '-'), '_', '-')) AS territorio_id, n_name AS nome, 'bairro' AS nivel,
  n_nationkey % 5 <> 4 AS com_geometria FROM nation WHERE n_nationkey % 7 <> 6""",
)
def loaded_territories(spark: SparkSession, sf: str) -> DataFrame:
    """Features landed as one page for each region, some without a name or an outline, loaded twice."""
    x = F.col("n_nationkey").cast("double")
    corner = lambda a, b: F.array(x + a, F.lit(float(b)))
    ring = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))
    name = F.when(F.col("n_nationkey") % 7 != 6, F.concat(F.lit(" "), F.col("n_name")))
    geometry = F.when(F.col("n_nationkey") % 5 != 4, F.struct(F.array(ring).alias("rings")))
    feature = F.struct(F.struct(F.col("n_nationkey").alias("objectid"), name.alias("nome")).alias("attributes"), geometry.alias("geometry"))
    pages = v.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(feature).alias("features"))
    path = b._scratch(spark)
    pages.repartition("n_regionkey").write.partitionBy("n_regionkey").json(path)
    w = _warehouse(spark)
    for _ in range(2):
        pipelines.ingest_territories(w, path)
    return w.read("dim_territorio").select("territorio_id", "nome", "nivel", (F.size(F.coalesce("geometria", F.array())) > 0).alias("com_geometria"))


@b.query("stored_first_pass", b.ORACLES["geocode_pass1"])
def stored_first_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Results of the first geocoder landed and stored in two runs: the answered ones, then all that is still pending."""
    *_, w = _loaded(spark, sf)
    w.bucketed("entidade").merge(v.entities(spark, sf), entities_after)
    path = b._scratch(spark)
    v.geocoder_results(spark, sf).orderBy("position").drop("position").write.options(header="true", nullValue="", emptyValue="").csv(path)
    for answered in (True, False, False):
        pipelines.store_first_pass(w, path, answered_only=answered)
    stored = w.read("geolocalizacao_entidade").drop("geocodificado_em", "revisado_em")
    return b.shown(stored)


@b.query(
    "stored_second_pass",
    f"""WITH {q.SECOND_PASS}, kept AS (SELECT * FROM locations WHERE entidade_id NOT IN (SELECT entidade_id FROM second))
SELECT entidade_id, round(lat, 6) AS lat, round(lon, 6) AS lon, confianca, fonte_secundaria, precisao_geocodebr,
  round(distancia_desempate_m, 3) AS distancia_desempate_m, true AS revisado FROM second
UNION ALL SELECT entidade_id, round(lat, 6), round(lon, 6), confianca, NULL, precisao_geocodebr, NULL, false FROM kept""",
)
def stored_second_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate lists landed as JSON lines and stored in three runs over first-pass rows: the listed ones, all that still wait, nothing more."""
    *_, w = _loaded(spark, sf)
    w.bucketed("geolocalizacao_entidade").merge(v.first_locations(spark, sf), locations_after)
    path = b._scratch(spark)
    v.search_lists(spark, sf).write.json(path)
    for answered in (True, False, False):
        pipelines.store_second_pass(w, path, answered_only=answered)
    stored = w.read("geolocalizacao_entidade").withColumn("distancia_desempate_m", F.round("distancia_desempate_m", 3))
    return b.shown(
        stored.select("entidade_id", "lat", "lon", "confianca", "fonte_secundaria", "precisao_geocodebr", "distancia_desempate_m", F.col("revisado_em").isNotNull().alias("revisado"))
    )
