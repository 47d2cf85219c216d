"""Batch pipelines over the stored tables. Each can be run again without doubling rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse import schemas
from terrapulse.constants import (
    BUSINESS,
    CODE_SOURCE,
    EVENT_DETECTION_JOB,
    NEIGHBOURHOOD,
    PERMIT_SOURCE,
    TERRITORY_SOURCE,
)
from terrapulse.functions.geodesy import place_order
from terrapulse.operators import quality
from terrapulse.operators.counts import by_category, event_counts, opening_counts_by_code, top_report
from terrapulse.operators.events import (
    all_snapshot_pairs,
    event_type_histogram,
    snapshot_pairs,
    to_events,
)
from terrapulse.operators.geocode import (
    confidence_histogram,
    first_pass,
    first_pass_totals,
    largest_disagreements,
    pending_first_pass,
    pending_second_pass,
    second_pass,
    with_query_address,
)
from terrapulse.operators.latest import state_after, state_of
from terrapulse.operators.normalize import (
    entities_of,
    first_lines,
    normalize_permits,
    territory_slugs,
    unmatched_names,
    with_number,
)
from terrapulse.session import staged
from terrapulse.sinks import ledger, tables
from terrapulse.sinks.buckets import BucketedTable
from terrapulse.sinks.exports import export_geocoder_input
from terrapulse.sinks.runs import Run, audited
from terrapulse.sinks.upserts import added, entities_after, locations_after, overwritten
from terrapulse.sources.geocoders import read_candidates, read_geocoder_results
from terrapulse.sources.permits import (
    latest_snapshot,
    list_snapshots,
    overlong_lines,
    read_permits,
)
from terrapulse.sources.reference import (
    category_seed,
    code_category_seed,
    read_activity_codes,
    read_features,
    to_territories,
)
from terrapulse.sources.tables import of_level, of_snapshots

OBSERVATION_KEY = ("entidade_id", "fonte_id", "observado_em")
EVENT_KEY = ("entidade_id", "event_type", "data_evento")
_APPENDED = {
    "observacao_entidade": schemas.OBSERVATION,
    "fato_evento_territorial": schemas.EVENT,
    "pipeline_run": schemas.RUN,
}
_REPLACED = {
    "dim_territorio": schemas.TERRITORY,
    "dim_cnae": schemas.CODE,
    "dim_categoria": schemas.CATEGORY,
    "cnae_categoria_map": schemas.CODE_CATEGORY,
    "contagem_eventos": schemas.EVENT_COUNT,
    "contagem_inicio_atividade": schemas.OPENING_COUNT,
    "contagem_inicio_por_codigo": schemas.OPENING_COUNT_BY_CODE,
}
# Tables with one row for each key, merged bucket by bucket.
_BUCKETED = {
    "entidade": (schemas.ENTITY, ("tipo_entidade", "identificador_fonte")),
    "geolocalizacao_entidade": (schemas.GEOLOCATION, ("entidade_id",)),
    "ultima_observacao": (schemas.LATEST, ("entidade_id",)),
}


@dataclass(frozen=True)
class Warehouse:
    """The stored tables under one folder."""

    spark: SparkSession
    root: str
    #: Buckets of the keyed tables when they are made.
    buckets: int = 1024

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def bucketed(self, table: str) -> BucketedTable:
        schema, keys = _BUCKETED[table]
        return BucketedTable(self.spark, self.path(table), schema, keys, self.buckets)

    @property
    def ledger(self) -> ledger.Ledger:
        return ledger.Ledger(self.spark, self.path("particao_consumida"))

    def read(self, table: str) -> DataFrame:
        if table in _BUCKETED:
            return self.bucketed(table).read()
        if table in _APPENDED:
            return tables.read_appended(self.spark, self.path(table), _APPENDED[table])
        return tables.read_current(self.spark, self.path(table), _REPLACED[table])

    def replace(self, table: str, df: DataFrame, sort_by: tuple[str, ...] = ()) -> int:
        columns = self.read(table).columns
        return tables.replace(df.select(*columns), self.path(table), sort_by)

    def audited(self, job: str):
        return audited(self.spark, self.path("pipeline_run"), job)


def _stop_if_any(found: DataFrame, key: str, what: str) -> None:
    """An error with a few examples when a check found rows."""
    examples = [r[key] for r in found.select(key).take(5)]
    if examples:
        raise ValueError(f"{what}: {examples}")


def ingest_permits(
    warehouse: Warehouse,
    directory: str,
    file_name: str | None = None,
    *,
    every_snapshot: bool = False,
    multi_line: bool = True,
) -> tuple[Run, DataFrame]:
    """Loads one snapshot file, the newest by default, or every file of the folder in one job.

    Also returns the unmatched district names. A file is parsed once, into a
    staged table that every later step reads; a line with too many fields stops
    the load before anything is stored. Entities are taken from the observations
    just stored, so a run that broke in between is completed by running it again.
    """
    spark = warehouse.spark
    with warehouse.audited(PERMIT_SOURCE) as run:
        if every_snapshot:
            # One row per file of the folder.
            days = [str(r["observado_em"]) for r in list_snapshots(spark, directory).collect()]
        else:
            file_name = file_name or latest_snapshot(spark, directory)
            days = [file_name[:10]]
        slugs = territory_slugs(of_level(warehouse.read("dim_territorio"), NEIGHBOURHOOD))
        lines = staged(
            read_permits(
                spark, directory, file_name, every_snapshot=every_snapshot, multi_line=multi_line
            )
        )
        overlong = overlong_lines(lines).count()
        if overlong:
            raise ValueError(f"{overlong} lines have more fields than the header")
        run.read = with_number(lines).count()
        fresh = (
            first_lines(normalize_permits(lines, slugs))
            .withColumn("criado_em", F.current_timestamp())
            .drop("tipo_entidade", "identificador_fonte")
        )
        run.written = tables.append_once(
            fresh,
            warehouse.path("observacao_entidade"),
            schemas.OBSERVATION,
            OBSERVATION_KEY,
            "observado_em",
            only=days,
        )
        stored = of_snapshots(warehouse.read("observacao_entidade"), *days)
        loaded = stored.select(
            "entidade_id",
            F.lit(BUSINESS).alias("tipo_entidade"),
            F.col("atributos.numero_do_alvara").alias("identificador_fonte"),
        )
        warehouse.bucketed("entidade").merge(staged(entities_of(loaded)), entities_after)
        update_latest(warehouse, days)
    return run, unmatched_names(stored)


def update_latest(warehouse: Warehouse, days: list[str] | None = None) -> int:
    """Merges the observation partitions that are new since the last time into the state; returns how many.

    Only those partitions and the buckets of their entities are read. A load that
    comes again changes nothing, a late one only what it knows more of.
    """
    path, job = warehouse.path("observacao_entidade"), "ultima_observacao"
    found = ledger.partitions(warehouse.spark, path, "observado_em")
    pending = warehouse.ledger.pending(job, {d: f for d, f in found.items() if days is None or d in days})
    if pending:
        wanted = [F.lit(day).cast("date") for day in pending]
        new = warehouse.read("observacao_entidade").filter(F.col("observado_em").isin(wanted))
        warehouse.bucketed(job).merge(staged(state_of(new)), state_after)
        warehouse.ledger.record(job, pending)
    return len(pending)


def latest(warehouse: Warehouse) -> DataFrame:
    """The newest observation of each entity; requests take it in place of all observations."""
    update_latest(warehouse)
    return warehouse.read("ultima_observacao")


def ingest_activity_codes(warehouse: Warehouse, path: str) -> Run:
    with warehouse.audited(CODE_SOURCE) as run:
        codes = read_activity_codes(warehouse.spark, path)
        _stop_if_any(quality.rejected(codes, quality.code_rules()), "codigo_cnae", "invalid codes")
        _stop_if_any(quality.duplicates(codes, "codigo_cnae"), "codigo_cnae", "doubled codes")
        warehouse.replace("dim_cnae", overwritten(warehouse.read("dim_cnae"), codes, "codigo_cnae"))
        run.read = run.written = codes.count()
    return run


def ingest_territories(warehouse: Warehouse, path: str) -> Run:
    """Loads the neighbourhood features; stops on invalid polygons and on two features of one id."""
    with warehouse.audited(TERRITORY_SOURCE) as run:
        features = read_features(warehouse.spark, path)
        territories = to_territories(features)
        run.read = features.count()
        _stop_if_any(
            quality.rejected(territories, quality.territory_rules()), "territorio_id", "invalid territories"
        )
        _stop_if_any(
            quality.duplicates(territories, "territorio_id"), "territorio_id", "doubled territory ids"
        )
        stored = overwritten(warehouse.read("dim_territorio"), territories, "territorio_id")
        warehouse.replace("dim_territorio", stored)
        run.written = territories.count()
        run.failed = run.read - run.written
    return run


def seed_categories(warehouse: Warehouse) -> tuple[int, int]:
    """Stores the categories and their codes; the codes have to be in the code table already."""
    spark = warehouse.spark
    pairs = code_category_seed(spark)
    unknown = quality.orphans(pairs, "codigo_cnae", warehouse.read("dim_cnae"))
    _stop_if_any(unknown, "codigo_cnae", "activity codes not loaded yet")
    categories = overwritten(warehouse.read("dim_categoria"), category_seed(spark), "categoria_id")
    mapping = added(warehouse.read("cnae_categoria_map"), pairs, "codigo_cnae", "categoria_id")
    return (
        warehouse.replace("dim_categoria", categories),
        warehouse.replace("cnae_categoria_map", mapping),
    )


def _store_events(
    warehouse: Warehouse, pairs: DataFrame, days: list[dt.date | str] | None, run: Run
) -> None:
    pairs = staged(pairs)
    run.read = pairs.count()
    code_map = warehouse.read("cnae_categoria_map")
    run.written = tables.append_once(
        pairs,
        warehouse.path("fato_evento_territorial"),
        schemas.EVENT,
        EVENT_KEY,
        "data_evento",
        only=days,
        shape=lambda some: to_events(some, code_map).withColumn("data_ingestao", F.current_timestamp()),
    )


def detect_pair(
    warehouse: Warehouse, previous: dt.date | str, current: dt.date | str
) -> tuple[Run, DataFrame]:
    """Detects and stores the events between two loaded snapshots; also returns their histogram."""
    with warehouse.audited(EVENT_DETECTION_JOB) as run:
        observations = warehouse.read("observacao_entidade")
        _store_events(warehouse, snapshot_pairs(observations, previous, current), [current], run)
    stored = warehouse.read("fato_evento_territorial")
    of_pair = stored.filter(F.col("data_evento") == F.lit(str(current)).cast("date"))
    return run, event_type_histogram(of_pair)


def detect_every_pair(warehouse: Warehouse) -> tuple[Run, DataFrame]:
    """Detects and stores the events of all consecutive snapshots in one job; also returns the histogram."""
    with warehouse.audited(EVENT_DETECTION_JOB) as run:
        pairs = all_snapshot_pairs(warehouse.read("observacao_entidade"))
        _store_events(warehouse, pairs, None, run)
    return run, event_type_histogram(warehouse.read("fato_evento_territorial"))


def rebuild_event_counts(warehouse: Warehouse) -> tuple[int, DataFrame]:
    """Brings the event counts up to date; also returns the report of the largest groups.

    Each date's counts are kept apart. Only dates with new files are counted again,
    in place of what they had, so the order of loads and repeated runs don't matter.
    """
    spark, job = warehouse.spark, "contagem_eventos_por_dia"
    found = ledger.partitions(spark, warehouse.path("fato_evento_territorial"), "data_evento")
    pending = warehouse.ledger.pending(job, found)
    if pending:
        wanted = [F.lit(day).cast("date") for day in pending]
        events = warehouse.read("fato_evento_territorial").filter(F.col("data_evento").isin(wanted))
        daily = event_counts(events, "data_evento").hint("rebalance", "data_evento")
        daily.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("data_evento").parquet(warehouse.path(job))
        warehouse.ledger.record(job, pending)
    daily = tables.read_appended(spark, warehouse.path(job), f"{schemas.EVENT_COUNT}, data_evento date")
    counts = daily.groupBy("territorio_id", "categoria_id", "mes", "event_type").agg(F.sum("contagem").alias("contagem"))
    rows = warehouse.replace(
        "contagem_eventos",
        counts.withColumn("calculado_em", F.current_timestamp()),
        sort_by=("territorio_id", "mes"),
    )
    return rows, top_report(
        warehouse.read("contagem_eventos"),
        warehouse.read("dim_territorio"),
        warehouse.read("dim_categoria"),
    )


def _opening_counts_by_code(warehouse: Warehouse) -> DataFrame:
    """Start dates by territory, month and code at the newest version of the state.

    The stored counts name the version that they are of. What changed since is the
    difference of the buckets that changed: an entity whose newest start moved is
    taken out where it was and put in where it is.
    """
    state, table = warehouse.bucketed("ultima_observacao"), "contagem_inicio_por_codigo"
    keys = ["territorio_id", "mes", "cnae_principal"]
    stored = warehouse.read(table)
    versions = state.versions()
    if not versions:
        return stored.filter("false")
    at = stored.agg(F.max("versao")).first()[0]
    if at == versions[-1]:
        return stored
    if at in versions:
        changed = state.changed(at, versions[-1])
        after = opening_counts_by_code(state.read(only=changed))
        before = opening_counts_by_code(state.read(at, changed)).withColumn("contagem", -F.col("contagem"))
        parts = stored.select(*keys, "contagem").unionByName(after).unionByName(before)
        counts = parts.groupBy(*keys).agg(F.sum("contagem").alias("contagem")).filter("contagem <> 0")
    else:
        counts = opening_counts_by_code(state.read())
    warehouse.replace(table, counts.withColumn("versao", F.lit(versions[-1])))
    return warehouse.read(table)


def rebuild_opening_counts(warehouse: Warehouse) -> tuple[int, DataFrame]:
    """Brings the start-date counts up to date; also returns the report of the largest groups."""
    update_latest(warehouse)
    counts = by_category(_opening_counts_by_code(warehouse), warehouse.read("cnae_categoria_map"))
    rows = warehouse.replace(
        "contagem_inicio_atividade",
        counts.withColumn("calculado_em", F.current_timestamp()),
        sort_by=("territorio_id", "mes"),
    )
    return rows, top_report(
        warehouse.read("contagem_inicio_atividade"),
        warehouse.read("dim_territorio"),
        warehouse.read("dim_categoria"),
        by_type=False,
    )


def export_first_pass(warehouse: Warehouse, path: str, limit: int | None = None) -> None:
    """Writes the addresses the first geocoder has still to look up."""
    pending = pending_first_pass(
        latest(warehouse),
        warehouse.read("entidade"),
        warehouse.read("geolocalizacao_entidade"),
        limit=limit,
    )
    export_geocoder_input(pending, path)


def _store_locations(warehouse: Warehouse, new: DataFrame) -> int:
    # Neighbours lie together within a bucket, so a search box skips most of its row groups.
    return warehouse.bucketed("geolocalizacao_entidade").merge(staged(new), locations_after, sort_by=(place_order("lat", "lon"), "entidade_id"))


def store_first_pass(
    warehouse: Warehouse, results_path: str, *, answered_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Stores landed results of the first geocoder; returns confidences and outcome totals.

    Every pending entity gets a row, unresolved when it has no result.
    `answered_only` stores part of the results now and leaves the rest pending.
    """
    results = read_geocoder_results(warehouse.spark, results_path)
    pending = pending_first_pass(
        latest(warehouse),
        warehouse.read("entidade"),
        warehouse.read("geolocalizacao_entidade"),
    )
    if answered_only:
        pending = pending.join(results.select("entidade_id"), "entidade_id", "left_semi")
    _store_locations(warehouse, first_pass(pending, results))
    stored = warehouse.read("geolocalizacao_entidade")
    waiting_or_final = stored.filter(F.col("fonte_secundaria").isNull())
    return confidence_histogram(stored), first_pass_totals(waiting_or_final)


def export_second_pass(warehouse: Warehouse, path: str, limit: int | None = None) -> None:
    """Writes the address texts the second geocoder has still to look up."""
    pending = pending_second_pass(
        latest(warehouse),
        warehouse.read("geolocalizacao_entidade"),
        limit=limit,
    )
    with_query_address(pending).select("entidade_id", "endereco").write.mode("errorifexists").json(path)


def store_second_pass(
    warehouse: Warehouse, candidates_path: str, *, answered_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Stores landed candidate lists; returns confidences and the largest disagreements.

    Every waiting entity is settled, without a list as not found. `answered_only`
    settles the listed ones and leaves the rest waiting.
    """
    candidates = read_candidates(warehouse.spark, candidates_path)
    pending = pending_second_pass(
        latest(warehouse), warehouse.read("geolocalizacao_entidade")
    )
    if answered_only:
        pending = pending.join(candidates.select("entidade_id"), "entidade_id", "left_semi")
    _store_locations(warehouse, second_pass(pending, candidates))
    stored = warehouse.read("geolocalizacao_entidade")
    return confidence_histogram(stored), largest_disagreements(stored)
