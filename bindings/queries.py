"""Registered queries over the generic tables, each with its SQL counterpart.

Dates are shown as ISO text and doubles rounded, on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import sql as q
from bindings import views as v
from terrapulse.constants import NEIGHBOURHOOD, PERMIT_SOURCE
from terrapulse.functions import geodesy, text
from terrapulse.functions.months import in_last_months, month_start, shift_month
from terrapulse.functions.text import activity_code, complete_search_text, display_address, display_name
from terrapulse.operators import (
    categories,
    counts,
    events,
    geocode,
    indicators,
    latest,
    normalize,
    quality,
    radius,
    ranking,
    series,
    territories,
)
from terrapulse.plans import requests
from terrapulse.schemas import OBSERVATION
from terrapulse.session import shared_folder, staged
from terrapulse.sinks import exports, tables, upserts
from terrapulse.sources.reference import code_category_seed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

INDICATORS = ("valor_atual", "baseline", "variacao_pct", "tendencia", "motivo_indisponivel")


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, doubles rounded."""
    forms = {"date": lambda c: F.col(c).cast("string"), "double": lambda c: F.round(c, digits)}
    return df.select(*[forms[t](c).alias(c) if t in forms else F.col(c) for c, t in df.dtypes])


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def _indicator_sql(prefix: str = "") -> str:
    return (
        f"round({prefix}valor_atual, 6) AS valor_atual, round({prefix}baseline, 6) AS baseline, "
        f"round({prefix}variacao_pct, 6) AS variacao_pct, {prefix}tendencia AS tendencia"
    )


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return events.detect_all_events(v.observations(spark, sf), code_category_seed(spark))


def _event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.event_counts(_events(spark, sf))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/terrapulse-{uuid.uuid4()}"


def _flat_events(found: DataFrame) -> DataFrame:
    return shown(
        found.select(
            "evento_id", "entity_type", "event_type", "entidade_id", "territorio_id", "data_evento",
            "confianca",
            F.concat_ws(",", "origem_observacoes").alias("origem"),
            F.col("payload")["cnae_anterior"].alias("cnae_anterior"),
            F.col("payload")["cnae_atual"].alias("cnae_atual"),
            F.col("payload")["categoria_id"].alias("categoria_id"),
        )
    )


_EVENT_SQL = """SELECT evento_id, entity_type, event_type, entidade_id, territorio_id,
  CAST(data_evento AS VARCHAR) AS data_evento, confianca, origem, cnae_anterior, cnae_atual, categoria_id FROM ev"""

# ---- indicators over the monthly openings ------------------------------------------------

_RANKING_SQL = f"""SELECT territorio_id, {_indicator_sql()}, posicao, total FROM ranking"""


@query("growth_ranking", f"WITH {q.RANKING} {_RANKING_SQL} WHERE posicao <= 10")
def growth_ranking(spark: SparkSession, sf: str) -> DataFrame:
    openings = v.openings(spark, sf)
    return shown(ranking.growth_ranking(openings, v.last_full_month(openings)))


@query("full_ranking", f"WITH {q.RANKING} {_RANKING_SQL}")
def full_ranking(spark: SparkSession, sf: str) -> DataFrame:
    openings = v.openings(spark, sf)
    return shown(ranking.growth_ranking(openings, v.last_full_month(openings), limit=None))


@query("ranking_without_tail", f"WITH {q.RANKING} {_RANKING_SQL} WHERE posicao <= total - 5")
def ranking_without_tail(spark: SparkSession, sf: str) -> DataFrame:
    openings = v.openings(spark, sf)
    return shown(ranking.growth_ranking(openings, v.last_full_month(openings), limit=-5))


@query(
    "tied_ranking",
    """SELECT territorio_id, variacao_pct, CAST(row_number() OVER (ORDER BY variacao_pct DESC, territorio_id) AS BIGINT) AS posicao,
  CAST(count(*) OVER () AS BIGINT) AS total
FROM (SELECT 'order-' || o_orderkey AS territorio_id,
        CASE WHEN o_orderkey % 100 = 0 THEN CAST(o_custkey AS DOUBLE) - 50 ELSE 0.25::DOUBLE END AS variacao_pct FROM orders)""",
)
def tied_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking of every order, nearly all with one change: positions go by the territory."""
    rows = v.table(spark, sf, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("territorio_id"),
        F.when(F.col("o_orderkey") % 100 == 0, F.col("o_custkey").cast("double") - 50).otherwise(F.lit(0.25)).alias("variacao_pct"),
    )
    return ranking.ranked(rows, None)


@query(
    "category_ranking",
    f"""WITH {q.OPENINGS}, chosen AS (SELECT * FROM openings WHERE categoria_id = 'BUILDING'),
{q.filled_indicators('chosen', 'SELECT ref FROM ref')},
ranking AS (SELECT *, CAST(row_number() OVER (ORDER BY variacao_pct DESC, territorio_id) AS BIGINT) AS posicao,
  CAST(count(*) OVER () AS BIGINT) AS total FROM indicators WHERE variacao_pct IS NOT NULL)
{_RANKING_SQL} WHERE posicao <= 10""",
)
def category_ranking(spark: SparkSession, sf: str) -> DataFrame:
    openings = v.openings(spark, sf)
    return shown(
        ranking.growth_ranking(openings, v.last_full_month(openings), category="BUILDING")
    )


@query(
    "commerce_ranking",
    f"""WITH {q.EVENT_COUNTS}, {q.OPENINGS.split('ref AS')[0].rstrip().rstrip(',')}, {q.TERRITORIES},
ref AS (SELECT CAST(max(mes) - INTERVAL 1 MONTH AS DATE) AS ref FROM event_counts),
{q.filled_indicators('openings', 'SELECT ref FROM ref')},
ranking AS (SELECT *, CAST(row_number() OVER (ORDER BY variacao_pct DESC, territorio_id) AS BIGINT) AS posicao,
  CAST(count(*) OVER () AS BIGINT) AS total FROM indicators WHERE variacao_pct IS NOT NULL)
SELECT r.territorio_id, coalesce(nome, r.territorio_id) AS nome, {_indicator_sql('r.')}, posicao, total,
  CAST(f.mes AS VARCHAR) AS mes, round(f.valor, 6) AS valor
FROM ranking r LEFT JOIN territories t ON t.territorio_id = r.territorio_id
JOIN filled f ON f.territorio_id = r.territorio_id
WHERE posicao <= 10 AND f.mes BETWEEN (SELECT ref - INTERVAL 11 MONTH FROM ref) AND (SELECT ref FROM ref)""",
)
def commerce_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ranking request: default period, names, sparkline (one row per point)."""
    ranked = requests.commerce_ranking(
        staged(_event_counts(spark, sf)), v.openings(spark, sf), v.territories(spark, sf)
    )
    points = ranked.select(*[c for c in ranked.columns if c != "serie"], F.inline("serie"))
    return shown(points)


@query(
    "monthly_indicators",
    f"""WITH {q.MONTH_INDICATORS}
SELECT territorio_id, CAST(mes AS VARCHAR) AS mes, {_indicator_sql()}, motivo_indisponivel FROM month_indicators""",
)
def monthly_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators for every territory and month that has events."""
    event_counts = staged(_event_counts(spark, sf))
    requested = event_counts.select("territorio_id", "mes").filter("territorio_id IS NOT NULL").distinct()
    found = indicators.indicators_for_months(
        requested, v.openings(spark, sf), series.default_period(event_counts).scalar()
    )
    return shown(found.select("territorio_id", "mes", *INDICATORS))


@query(
    "zero_fill",
    f"""WITH {q.OPENINGS}, {q.filled_indicators('openings', 'SELECT ref FROM ref')}
SELECT territorio_id, CAST(mes AS VARCHAR) AS mes, round(valor, 6) AS valor FROM filled""",
)
def zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    openings = v.openings(spark, sf)
    return shown(series.zero_fill(series.opening_series(openings), v.last_full_month(openings)))


@query(
    "sparkline",
    f"""WITH {q.OPENINGS}, {q.filled_indicators('openings', 'SELECT ref FROM ref')}
SELECT territorio_id, CAST(mes AS VARCHAR) AS mes, round(valor, 6) AS valor FROM filled
WHERE mes >= (SELECT ref - INTERVAL 11 MONTH FROM ref)""",
)
def sparkline(spark: SparkSession, sf: str) -> DataFrame:
    openings = v.openings(spark, sf)
    return shown(series.sparkline(openings, v.last_full_month(openings)))


@query(
    "series_indicators",
    f"""WITH {q.EVENT_COUNTS},
by_month AS (SELECT territorio_id, mes, {q.METRICS} FROM event_counts WHERE territorio_id IS NOT NULL GROUP BY 1, 2),
points AS (SELECT territorio_id, mes, CAST(aberturas - desaparecimentos AS DOUBLE) AS valor FROM by_month),
windows AS (SELECT territorio_id, mes, valor,
    sum(valor) OVER b AS base, count(*) OVER b AS base_n, sum(valor) OVER n AS now_sum, count(*) OVER n AS now_n,
    sum(valor) OVER t AS then_sum, count(*) OVER t AS then_n
  FROM points
  WINDOW b AS (PARTITION BY territorio_id ORDER BY mes RANGE BETWEEN INTERVAL 24 MONTH PRECEDING AND INTERVAL 1 MONTH PRECEDING),
         n AS (PARTITION BY territorio_id ORDER BY mes RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW),
         t AS (PARTITION BY territorio_id ORDER BY mes RANGE BETWEEN INTERVAL 5 MONTH PRECEDING AND INTERVAL 3 MONTH PRECEDING)),
found AS (SELECT territorio_id, mes, {q.indicator_columns('valor', 'base', 'base_n', 'now_sum', 'now_n', 'then_sum', 'then_n')} FROM windows)
SELECT territorio_id, CAST(mes AS VARCHAR) AS mes, {_indicator_sql()}, motivo_indisponivel FROM found""",
)
def series_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline and trend at every month of the balance series, gaps counting as missing."""
    points = counts.metrics_by_month(_event_counts(spark, sf)).filter("territorio_id IS NOT NULL")
    found = indicators.series_indicators(
        points.select("territorio_id", "mes", F.col("saldo").cast("double").alias("valor"))
    )
    return shown(found.select("territorio_id", "mes", *INDICATORS))


@query(
    "opening_indicators",
    f"""WITH {q.OPENINGS}, {q.filled_indicators('openings', 'SELECT ref FROM ref')}
SELECT territorio_id, {_indicator_sql()}, motivo_indisponivel FROM indicators""",
)
def opening_indicators(spark: SparkSession, sf: str) -> DataFrame:
    openings = v.openings(spark, sf)
    found = indicators.opening_indicators(openings, v.last_full_month(openings))
    return shown(found.select("territorio_id", *INDICATORS))


@query(
    "balance_indicator",
    f"WITH {q.BALANCE} SELECT territorio_id, {_indicator_sql()}, motivo_indisponivel FROM balance",
)
def balance_indicator(spark: SparkSession, sf: str) -> DataFrame:
    found = indicators.balance_indicators(staged(_event_counts(spark, sf)))
    return shown(found.select("territorio_id", *INDICATORS))


@query(
    "default_period",
    f"""WITH {q.EVENT_COUNTS}
SELECT CAST(CAST(max(mes) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS periodo FROM event_counts""",
)
def default_period(spark: SparkSession, sf: str) -> DataFrame:
    return shown(series.default_period(_event_counts(spark, sf)))


@query(
    "coverage",
    f"""WITH {q.EVENT_COUNTS}
SELECT CAST(min(mes) AS VARCHAR) AS mes_inicio, CAST(max(mes) AS VARCHAR) AS mes_fim FROM event_counts""",
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return shown(requests.event_coverage(_event_counts(spark, sf)))


_SUMMARY = "nation-3"


@query(
    "territory_summary",
    f"""WITH {q.BALANCE}, {q.OPENINGS.split('ref AS')[0].rstrip().rstrip(',')}, {q.TERRITORIES},
ref AS (SELECT CAST(max(mes) - INTERVAL 1 MONTH AS DATE) AS ref FROM event_counts),
{q.filled_indicators('openings', 'SELECT ref FROM ref').replace('windows AS', 'windows_o AS').replace('FROM windows WHERE', 'FROM windows_o WHERE')},
ranking AS (SELECT territorio_id, CAST(row_number() OVER (ORDER BY variacao_pct DESC, territorio_id) AS BIGINT) AS posicao,
  CAST(count(*) OVER () AS BIGINT) AS total FROM indicators WHERE variacao_pct IS NOT NULL)
SELECT t.territorio_id, nome, CAST((SELECT ref FROM ref) AS VARCHAR) AS periodo,
  round(i.valor_atual, 6) AS aberturas_valor_atual, round(i.baseline, 6) AS aberturas_baseline,
  round(i.variacao_pct, 6) AS aberturas_variacao_pct, i.tendencia AS aberturas_tendencia,
  i.motivo_indisponivel AS aberturas_motivo_indisponivel,
  round(b.valor_atual, 6) AS saldo_valor_atual, round(b.baseline, 6) AS saldo_baseline,
  round(b.variacao_pct, 6) AS saldo_variacao_pct, b.tendencia AS saldo_tendencia,
  b.motivo_indisponivel AS saldo_motivo_indisponivel,
  posicao AS posicao_ranking, (SELECT max(total) FROM ranking) AS total_ranking
FROM territories t JOIN indicators i USING (territorio_id) JOIN balance b USING (territorio_id)
LEFT JOIN ranking r USING (territorio_id) WHERE t.territorio_id = '{_SUMMARY}'""",
)
def territory_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shown(
        requests.territory_summary(
            staged(_event_counts(spark, sf)),
            v.openings(spark, sf),
            v.territories(spark, sf),
            territory=_SUMMARY,
        )
    )


@query(
    "territory_profile",
    f"""SELECT s.*, n.categorias, m.mes, m.aberturas, m.desaparecimentos, m.saldo, m.baseline, m.variacao_pct, m.tendencia,
  m.motivo_indisponivel
FROM ({ORACLES['territory_summary']}) s
LEFT JOIN (SELECT '{_SUMMARY}' AS territorio_id, string_agg(nome || '=' || contagem, ',' ORDER BY contagem DESC, categoria_id) AS categorias
  FROM (WITH {q.OPENINGS}, {q.SEGMENTS}, {q.EVENT_COUNTS},
    period AS (SELECT CAST(max(mes) - INTERVAL 1 MONTH AS DATE) AS p FROM event_counts)
    SELECT categoria_id, nome, CAST(sum(contagem) AS BIGINT) AS contagem FROM openings JOIN segments USING (categoria_id), period
    WHERE territorio_id = '{_SUMMARY}' AND mes = p GROUP BY ALL ORDER BY contagem DESC, categoria_id LIMIT 5)) n USING (territorio_id)
LEFT JOIN (SELECT * FROM (WITH {q.MONTH_INDICATORS}
SELECT territorio_id, CAST(mes AS VARCHAR) AS mes, aberturas, desaparecimentos,
  aberturas - desaparecimentos AS saldo, round(baseline, 6) AS baseline, round(variacao_pct, 6) AS variacao_pct,
  tendencia, motivo_indisponivel
FROM by_month JOIN month_indicators USING (territorio_id, mes) WHERE territorio_id = '{_SUMMARY}')
  WHERE mes >= '1996-03-01') m USING (territorio_id)""",
)
def territory_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The whole profile request, one row for each month of its series."""
    row = requests.territory_profile(
        staged(_event_counts(spark, sf)), v.openings(spark, sf), v.territories(spark, sf), v.segments(spark, sf),
        territory=_SUMMARY, start="1996-03-01",
    )
    short = F.array_join(F.transform("categorias", lambda c: F.concat_ws("=", c["nome"], c["contagem"].cast("string"))), ",")
    single = row.withColumn("categorias", short)
    months = single.select(*[c for c in single.columns if c != "serie"], F.inline_outer("serie"))
    return shown(months.drop("categoria_id"))


# ---- events -----------------------------------------------------------------------------


@query(
    "snapshot_events",
    f"""WITH {q.EVENTS} {_EVENT_SQL}
WHERE data_evento = (SELECT max(observado_em) - INTERVAL 1 MONTH FROM obs)""",
)
def snapshot_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the last full pair of snapshots."""
    seen = v.observations(spark, sf)
    last = seen.select(F.max("observado_em").alias("d"))
    previous = last.select(shift_month("d", -2)).scalar()
    current = last.select(shift_month("d", -1)).scalar()
    return _flat_events(events.detect_events(seen, code_category_seed(spark), previous, current))


@query("all_pair_events", f"WITH {q.EVENTS} {_EVENT_SQL}")
def all_pair_events(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_events(_events(spark, sf))


@query(
    "event_type_histogram",
    f"WITH {q.EVENTS} SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY 1",
)
def event_type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_type_histogram(_events(spark, sf))


@query(
    "code_normalize",
    f"""WITH {q.obs()} SELECT cnae_principal, {q.norm_code('cnae_principal')} AS codigo_cnae,
  CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY ALL""",
)
def code_normalize(spark: SparkSession, sf: str) -> DataFrame:
    seen = v.observations(spark, sf).select(F.col("atributos.cnae_principal").alias("cnae_principal"))
    return (
        seen.withColumn("codigo_cnae", activity_code("cnae_principal"))
        .groupBy("cnae_principal", "codigo_cnae")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "code_category",
    f"""WITH {q.CODE_MAP}, {q.obs()} SELECT observacao_id, categoria_id
FROM obs LEFT JOIN code_map ON codigo_cnae = {q.norm_code('cnae_principal')}""",
)
def code_category(spark: SparkSession, sf: str) -> DataFrame:
    seen = v.observations(spark, sf)
    found = categories.resolve_category(seen, code_category_seed(spark), F.col("atributos.cnae_principal"))
    return found.select("observacao_id", "categoria_id")


@query(
    "latest_observation",
    f"""WITH {q.obs()}, newest AS (SELECT *, row_number() OVER (PARTITION BY entidade_id ORDER BY observado_em DESC) AS n FROM obs)
SELECT entidade_id, coalesce(nome_fantasia, nome_empresarial) AS nome,
  concat_ws(' - ', concat_ws(', ', endereco, numero), bairro) AS endereco, cnae_principal, territorio_id
FROM newest WHERE n = 1""",
)
def latest_observation(spark: SparkSession, sf: str) -> DataFrame:
    found = latest.latest_observations(v.observations(spark, sf), latest.DISPLAY_FIELDS)
    return found.select(
        "entidade_id",
        display_name("nome_fantasia", "nome_empresarial").alias("nome"),
        display_address("endereco", "numero", "bairro").alias("endereco"),
        "cnae_principal",
        "territorio_id",
    )


_STARTED = f"""{q.CODE_MAP}, {q.obs(start_gaps=True)},
newest AS (SELECT *, row_number() OVER (PARTITION BY entidade_id ORDER BY observado_em DESC) AS n
  FROM obs WHERE inicio_atividade IS NOT NULL),
started AS (SELECT *, CAST(date_trunc('month', CAST(inicio_atividade AS DATE)) AS DATE) AS mes
  FROM newest LEFT JOIN code_map ON codigo_cnae = {q.norm_code('cnae_principal')} WHERE n = 1)"""


@query(
    "latest_with_start_date",
    f"WITH {_STARTED} SELECT entidade_id, territorio_id, inicio_atividade, cnae_principal FROM started",
)
def latest_with_start_date(spark: SparkSession, sf: str) -> DataFrame:
    seen = v.observations(spark, sf, start_gaps=True)
    return latest.latest_observations(seen, latest.START_FIELDS, with_start_date=True)


# ---- counts and metrics -----------------------------------------------------------------

_COUNT_SQL = "territorio_id, categoria_id, CAST(mes AS VARCHAR) AS mes"


@query("event_counts", f"WITH {q.EVENT_COUNTS} SELECT {_COUNT_SQL}, event_type, contagem FROM event_counts")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_event_counts(spark, sf))


@query(
    "opening_counts",
    f"""WITH {_STARTED} SELECT {_COUNT_SQL}, CAST(count(*) AS BIGINT) AS contagem
FROM started WHERE territorio_id IS NOT NULL GROUP BY ALL""",
)
def opening_counts(spark: SparkSession, sf: str) -> DataFrame:
    seen = v.observations(spark, sf, start_gaps=True)
    return shown(counts.opening_counts(seen, code_category_seed(spark)))


@query(
    "opening_counts_by_code",
    f"""WITH {_STARTED} SELECT territorio_id, CAST(mes AS VARCHAR) AS mes, cnae_principal,
  CAST(count(*) AS BIGINT) AS contagem FROM started WHERE territorio_id IS NOT NULL GROUP BY ALL""",
)
def opening_counts_by_code(spark: SparkSession, sf: str) -> DataFrame:
    return shown(counts.opening_counts_by_code(v.observations(spark, sf, start_gaps=True)))


@query(
    "counts_regrouped_by_category",
    f"""WITH {_STARTED} SELECT {_COUNT_SQL}, CAST(count(*) AS BIGINT) AS contagem
FROM started WHERE territorio_id IS NOT NULL GROUP BY ALL""",
)
def counts_regrouped_by_category(spark: SparkSession, sf: str) -> DataFrame:
    raw = counts.opening_counts_by_code(v.observations(spark, sf, start_gaps=True))
    return shown(counts.by_category(raw, code_category_seed(spark)))


@query(
    "metrics_map",
    f"""WITH {q.EVENT_COUNTS} SELECT territorio_id, {q.METRICS}, aberturas - desaparecimentos AS saldo
FROM event_counts GROUP BY territorio_id""",
)
def metrics_map(spark: SparkSession, sf: str) -> DataFrame:
    return counts.metrics_map(_event_counts(spark, sf))


@query(
    "metrics_filtered",
    f"""WITH {q.EVENT_COUNTS} SELECT territorio_id, CAST(mes AS VARCHAR) AS mes, {q.METRICS},
  aberturas - desaparecimentos AS saldo FROM event_counts
WHERE categoria_id = 'bares_restaurantes' AND mes BETWEEN DATE '1996-02-01' AND DATE '1998-09-01'
GROUP BY territorio_id, event_counts.mes""",
)
def metrics_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly metrics of one category in an inclusive month range."""
    return shown(
        counts.metrics_by_month(
            _event_counts(spark, sf), category="bares_restaurantes", start="1996-02-01", end="1998-09-01"
        )
    )


@query(
    "metrics_last_months",
    f"""WITH {q.EVENT_COUNTS}, last AS (SELECT max(mes) AS m FROM event_counts)
SELECT territorio_id, {q.METRICS}, aberturas - desaparecimentos AS saldo FROM event_counts, last
WHERE mes >= m - INTERVAL 11 MONTH GROUP BY territorio_id""",
)
def metrics_last_months(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the preset period of twelve months."""
    found = staged(_event_counts(spark, sf))
    last = found.agg(F.max("mes")).scalar()
    return counts.metrics_map(found.filter(in_last_months(F.col("mes"), last, 12)))


@query(
    "metrics_series",
    f"""WITH {q.MONTH_INDICATORS}
SELECT territorio_id, CAST(NULL AS VARCHAR) AS categoria_id, CAST(mes AS VARCHAR) AS mes, aberturas, desaparecimentos,
  aberturas - desaparecimentos AS saldo, round(baseline, 6) AS baseline, round(variacao_pct, 6) AS variacao_pct,
  tendencia, motivo_indisponivel
FROM by_month JOIN month_indicators USING (territorio_id, mes) WHERE territorio_id = '{_SUMMARY}'""",
)
def metrics_series(spark: SparkSession, sf: str) -> DataFrame:
    return shown(
        requests.commerce_metrics(
            staged(_event_counts(spark, sf)), v.openings(spark, sf), territory=_SUMMARY
        )
    )


@query(
    "metrics_all_series",
    f"""WITH {q.MONTH_INDICATORS}
SELECT territorio_id, CAST(mes AS VARCHAR) AS mes, aberturas, desaparecimentos,
  aberturas - desaparecimentos AS saldo, round(baseline, 6) AS baseline, round(variacao_pct, 6) AS variacao_pct,
  tendencia, motivo_indisponivel
FROM by_month LEFT JOIN month_indicators USING (territorio_id, mes)""",
)
def metrics_all_series(spark: SparkSession, sf: str) -> DataFrame:
    """The monthly series of every territory in one job."""
    found = staged(_event_counts(spark, sf))
    joined = requests.with_month_indicators(
        counts.metrics_by_month(found), found, v.openings(spark, sf)
    )
    return shown(
        joined.select(
            "territorio_id", "mes", "aberturas", "desaparecimentos", "saldo", "baseline",
            "variacao_pct", "tendencia", "motivo_indisponivel",
        )
    )


@query(
    "commerce_metrics_map",
    f"""WITH {q.EVENT_COUNTS} SELECT territorio_id, CAST(NULL AS VARCHAR) AS categoria_id, CAST(NULL AS VARCHAR) AS mes,
  {q.METRICS}, aberturas - desaparecimentos AS saldo, CAST(NULL AS DOUBLE) AS baseline,
  CAST(NULL AS DOUBLE) AS variacao_pct, CAST(NULL AS VARCHAR) AS tendencia,
  'nao_aplicavel_sem_territorio_id' AS motivo_indisponivel FROM event_counts GROUP BY territorio_id""",
)
def commerce_metrics_map(spark: SparkSession, sf: str) -> DataFrame:
    return shown(requests.commerce_metrics(_event_counts(spark, sf), v.openings(spark, sf)))


_MAP_SQL = f"""{q.EVENT_COUNTS}, {q.ALL_TERRITORIES},
late AS (SELECT territorio_id, {q.METRICS} FROM event_counts WHERE mes >= DATE '2001-06-01' GROUP BY 1),
dataset AS (SELECT t.territorio_id, nome, coalesce(aberturas - desaparecimentos, 0) AS saldo, aberturas,
  desaparecimentos, l.territorio_id IS NOT NULL AS tem_dado FROM territories t LEFT JOIN late l USING (territorio_id))"""


@query("map_dataset", f"WITH {_MAP_SQL} SELECT * FROM dataset")
def map_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return requests.map_view(v.all_territories(spark, sf), _event_counts(spark, sf), start="2001-06-01")[0]


@query(
    "balance_domain",
    f"""WITH {_MAP_SQL} SELECT coalesce(min(saldo), -1) AS minimo, coalesce(max(saldo), 1) AS maximo,
  least(0, min(saldo)) AS legenda_minimo, greatest(0, max(saldo)) AS legenda_maximo FROM dataset WHERE tem_dado""",
)
def balance_domain(spark: SparkSession, sf: str) -> DataFrame:
    return requests.map_view(v.all_territories(spark, sf), _event_counts(spark, sf), start="2001-06-01")[1]


_BREAKDOWN_SQL = f"""WITH fine AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN c_mktsegment || '/' || o_orderpriority END AS categoria_id,
  date_trunc('month', o_orderdate) AS mes FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE 'nation-' || c_nationkey = '{_SUMMARY}')
SELECT categoria_id, CASE WHEN categoria_id IS NULL OR categoria_id LIKE '%/1-URGENT' THEN '(sem categoria)'
  ELSE lower(categoria_id) END AS nome, CAST(count(*) AS BIGINT) AS contagem FROM fine
WHERE mes = (SELECT max(mes) FROM fine) GROUP BY ALL ORDER BY contagem DESC, categoria_id LIMIT 5"""


@query("category_breakdown", _BREAKDOWN_SQL)
def category_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Largest categories of the last month in which the territory has openings."""
    found = v.fine_openings(spark, sf)
    month = found.filter(F.col("territorio_id") == _SUMMARY).agg(F.max("mes")).scalar()
    return requests.territory_breakdown(
        _event_counts(spark, sf), found, v.fine_categories(spark, sf), territory=_SUMMARY, period=month
    )


def _report_sql(source: str) -> str:
    return f"""named AS (SELECT event_type, coalesce(t.nome, '(sem bairro)') AS bairro,
  coalesce(c.nome, '(sem categoria)') AS categoria, contagem FROM {source} e
  LEFT JOIN territories t ON t.territorio_id = e.territorio_id LEFT JOIN cats c ON c.categoria_id = e.categoria_id),
sums AS (
  SELECT event_type, 'bairro' AS grupo, bairro AS nome, CAST(sum(contagem) AS BIGINT) AS n FROM named GROUP BY 1, 2, 3
  UNION ALL SELECT event_type, 'categoria', categoria, CAST(sum(contagem) AS BIGINT) FROM named GROUP BY 1, 2, 3
  UNION ALL SELECT event_type, 'total', 'total', CAST(sum(contagem) AS BIGINT) FROM named GROUP BY 1, 2, 3),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type, grupo ORDER BY n DESC, nome) AS BIGINT) AS posicao FROM sums)
SELECT event_type, grupo, posicao, nome, n FROM placed WHERE posicao <= 10"""


_CODE_CATS = "cats AS (SELECT DISTINCT categoria_id, replace(categoria_id, '_', ' ') AS nome FROM code_map WHERE categoria_id <> 'beleza_estetica')"


@query(
    "top_report",
    f"""WITH {q.EVENT_COUNTS}, {q.TERRITORIES}, {_CODE_CATS},
reported AS (SELECT * FROM event_counts WHERE event_type IN ('PRIMEIRA_OBSERVACAO', 'DESAPARECIMENTO')), {_report_sql('reported')}""",
)
def top_report(spark: SparkSession, sf: str) -> DataFrame:
    """Largest territories and categories per event type; one category has no name."""
    names = (
        code_category_seed(spark)
        .select("categoria_id", F.replace("categoria_id", F.lit("_"), F.lit(" ")).alias("nome"))
        .filter("categoria_id <> 'beleza_estetica'")
        .distinct()
    )
    return counts.top_report(_event_counts(spark, sf), v.territories(spark, sf), names)


@query(
    "opening_report",
    f"""WITH {q.OPENINGS}, {q.TERRITORIES}, {q.SEGMENTS}, cats AS (SELECT * FROM segments),
reported AS (SELECT 'INICIO_ATIVIDADE' AS event_type, * FROM openings), {_report_sql('reported')}""",
)
def opening_report(spark: SparkSession, sf: str) -> DataFrame:
    return counts.top_report(
        v.openings(spark, sf), v.territories(spark, sf), v.segments(spark, sf), by_type=False
    )


@query("category_list", f"WITH {q.SEGMENTS} SELECT * FROM segments")
def category_list(spark: SparkSession, sf: str) -> DataFrame:
    return requests.category_list(v.segments(spark, sf))


@query(
    "territory_labels",
    f"""WITH {q.OPENINGS}, {q.TERRITORIES}
SELECT o.territorio_id, coalesce(nome, o.territorio_id) AS nome, CAST(sum(contagem) AS BIGINT) AS contagem
FROM openings o LEFT JOIN territories t USING (territorio_id) GROUP BY ALL""",
)
def territory_labels(spark: SparkSession, sf: str) -> DataFrame:
    summed = v.openings(spark, sf).groupBy("territorio_id").agg(F.sum("contagem").alias("contagem"))
    named = categories.with_territory_name(summed, v.territories(spark, sf), F.col("territorio_id"))
    return named.select("territorio_id", "nome", "contagem")


# ---- geocoding ----------------------------------------------------------------------------


def _done(spark: SparkSession, sf: str) -> DataFrame:
    """Locations that exist already: those with an exact house number."""
    return v.first_locations(spark, sf).filter("confianca = 'alta'")


_PENDING_SQL = f"""{q.obs()}, {q.ENTITIES}, {q.FIRST_LOCATIONS},
newest AS (SELECT *, row_number() OVER (PARTITION BY entidade_id ORDER BY observado_em DESC) AS n FROM obs),
pending AS (SELECT entidade_id, coalesce(endereco, '') AS logradouro, coalesce(numero, '') AS numero, cep,
  coalesce(bairro, '') AS bairro FROM newest JOIN entities USING (entidade_id)
  WHERE n = 1 AND tipo_entidade = 'comercio'
    AND entidade_id NOT IN (SELECT entidade_id FROM locations WHERE confianca = 'alta'))"""


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.pending_first_pass(v.observations(spark, sf), v.entities(spark, sf), _done(spark, sf))


@query(
    "geocode_pending",
    f"""WITH {_PENDING_SQL} SELECT entidade_id, logradouro, numero, cep, bairro AS localidade,
  'Curitiba' AS municipio, 'PR' AS estado FROM pending""",
)
def geocode_pending(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.geocoder_input(_pending(spark, sf))


@query(
    "geocode_pending_first",
    f"WITH {_PENDING_SQL} SELECT * FROM pending ORDER BY entidade_id LIMIT 50",
)
def geocode_pending_first(spark: SparkSession, sf: str) -> DataFrame:
    """The limit operators of the pending lists."""
    return geocode.pending_first_pass(
        v.observations(spark, sf), v.entities(spark, sf), _done(spark, sf), limit=50
    )


_PASS1_SQL = f"""{_PENDING_SQL},
results AS (SELECT md5('customer:' || c_custkey) AS entidade_id, line,
    CASE WHEN c_custkey % 7 <> 6 THEN {q.lat('c_custkey')} + line * 0.001::DOUBLE END AS rlat,
    CASE WHEN c_custkey % 7 <> 6 THEN {q.lon('c_custkey')} END AS rlon, {q._PRECISION} AS precisao
  FROM customer, (VALUES (0), (1)) lines(line)
  WHERE c_custkey % 9 <> 8 AND (line = 0 OR c_custkey % 5 = 0)),
last_results AS (SELECT *, row_number() OVER (PARTITION BY entidade_id ORDER BY line DESC) AS n FROM results),
pass1 AS (SELECT p.entidade_id, rlat AS lat, rlon AS lon,
  CASE WHEN precisao = 'numero' THEN 'alta' ELSE 'baixa' END AS confianca, 'geocodebr' AS fonte_primaria,
  CAST(NULL AS VARCHAR) AS fonte_secundaria, precisao AS precisao_geocodebr, CAST(NULL AS DOUBLE) AS distancia_desempate_m
  FROM pending p LEFT JOIN last_results r ON r.entidade_id = p.entidade_id AND r.n = 1)"""

# The pass over entities without any location yet, so that exact results occur too.
_PASS1_SQL = _PASS1_SQL.replace("locations WHERE confianca = 'alta'", "locations WHERE false")


def _pass1(spark: SparkSession, sf: str) -> DataFrame:
    nothing_yet = v.first_locations(spark, sf).filter(F.lit(False))
    pending = geocode.pending_first_pass(v.observations(spark, sf), v.entities(spark, sf), nothing_yet)
    return geocode.first_pass(pending, v.geocoder_results(spark, sf))


@query(
    "geocode_pass1",
    f"""WITH {_PASS1_SQL} SELECT entidade_id, round(lat, 6) AS lat, round(lon, 6) AS lon, confianca, fonte_primaria,
  fonte_secundaria, precisao_geocodebr, distancia_desempate_m FROM pass1""",
)
def geocode_pass1(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_pass1(spark, sf))


@query(
    "geocode_pass1_totals",
    f"""WITH {_PASS1_SQL} SELECT CAST(count(*) FILTER (WHERE confianca = 'alta') AS BIGINT) AS alta,
  CAST(count(*) FILTER (WHERE confianca <> 'alta') AS BIGINT) AS enfileirado FROM pass1""",
)
def geocode_pass1_totals(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.first_pass_totals(_pass1(spark, sf))


def _second_pending(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.pending_second_pass(v.observations(spark, sf), v.first_locations(spark, sf))


@query(
    "geocode_addresses",
    f"""WITH {q.obs()}, {q.FIRST_LOCATIONS},
newest AS (SELECT *, row_number() OVER (PARTITION BY entidade_id ORDER BY observado_em DESC) AS n FROM obs)
SELECT entidade_id, endereco || ', ' || CASE WHEN numero IS NULL THEN '' ELSE CAST(CAST(numero AS INTEGER) AS VARCHAR) || ', ' END
  || coalesce(bairro || ', ', '') || cep[1:5] || '-' || cep[6:8] || ', Curitiba, PR, Brasil' AS endereco
FROM newest JOIN locations USING (entidade_id) WHERE n = 1 AND confianca = 'baixa'""",
)
def geocode_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.with_query_address(_second_pending(spark, sf)).select("entidade_id", "endereco")


@query(
    "candidate_status",
    f"""WITH {q.CANDIDATES} SELECT entidade_id, status, CASE WHEN status = 'sucesso' THEN round(lat1, 6) END AS lat,
  CASE WHEN status = 'sucesso' THEN round(lon1, 6) END AS lon,
  CASE WHEN n = 1 THEN 'importance=0.5;type=house;n_candidatos=1'
       WHEN n = 2 AND status = 'sucesso' THEN 'importance=0.5;type=house;n_candidatos=2;dist_2o_candidato_m=' || printf('%.1f', apart)
       WHEN n = 2 THEN 'n_candidatos=2;dist_2o_candidato_m=' || printf('%.1f', apart) END AS confianca_bruta
FROM resolved""",
)
def candidate_status(spark: SparkSession, sf: str) -> DataFrame:
    found = requests.search_points(v.candidate_lists(spark, sf))
    return shown(found.select("entidade_id", "status", "ponto.lat", "ponto.lon", "confianca_bruta"))


def _second(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.second_pass(_second_pending(spark, sf), v.candidate_lists(spark, sf))


@query(
    "geocode_reconcile",
    f"""WITH {q.SECOND_PASS} SELECT entidade_id, round(lat, 6) AS lat, round(lon, 6) AS lon, confianca, fonte_primaria,
  fonte_secundaria, precisao_geocodebr, round(distancia_desempate_m, 3) AS distancia_desempate_m FROM second""",
)
def geocode_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    found = _second(spark, sf)
    return shown(found.withColumn("distancia_desempate_m", F.round("distancia_desempate_m", 3)))


@query(
    "confidence_histogram",
    f"WITH {q.SECOND_PASS} SELECT confianca, CAST(count(*) AS BIGINT) AS n FROM second GROUP BY 1",
)
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.confidence_histogram(_second(spark, sf))


@query(
    "severe_disagreement",
    f"""WITH {q.SECOND_PASS} SELECT entidade_id, round(distancia_desempate_m, 3) AS distancia_desempate_m FROM second
WHERE distancia_desempate_m > 1000""",
)
def severe_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return shown(geocode.severe_disagreements(_second(spark, sf)), 3)


@query(
    "largest_disagreements",
    f"""WITH {q.SECOND_PASS} SELECT round(distancia_desempate_m, 3) AS distancia_desempate_m FROM second
WHERE distancia_desempate_m > 1000 ORDER BY distancia_desempate_m DESC LIMIT 20""",
)
def largest_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return shown(geocode.largest_disagreements(_second(spark, sf)).select("distancia_desempate_m"), 3)


# ---- radius searches ----------------------------------------------------------------------

_CENTRE = (-25.50, -49.30)
_RADIUS = 5000

_HITS_SQL = f"""{q.CODE_MAP}, {q.obs()}, {q.ENTITIES}, {q.FIRST_LOCATIONS},
newest AS (SELECT *, row_number() OVER (PARTITION BY entidade_id ORDER BY observado_em DESC) AS n FROM obs),
pairs AS (SELECT entidade_id, confianca, lat AS lat_b, lon AS lon_b, {_CENTRE[0]}::DOUBLE AS lat_a, {_CENTRE[1]}::DOUBLE AS lon_a
  FROM locations WHERE lat IS NOT NULL),
{q.geodesic('pairs', 'measured')},
hits AS (SELECT m.entidade_id, coalesce(nome_fantasia, nome_empresarial) AS nome,
  concat_ws(' - ', concat_ws(', ', endereco, numero), bairro) AS endereco, categoria_id, territorio_id,
  distancia_m, confianca, lat_b AS lat, lon_b AS lon
  FROM measured m JOIN newest USING (entidade_id) JOIN entities e USING (entidade_id)
  LEFT JOIN code_map ON codigo_cnae = {q.norm_code('cnae_principal')}
  WHERE n = 1 AND tipo_entidade = 'comercio' AND distancia_m <= {_RADIUS})"""


def _search(spark: SparkSession, sf: str, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    return requests.radius_search(
        v.first_locations(spark, sf),
        v.observations(spark, sf),
        v.entities(spark, sf),
        code_category_seed(spark),
        lat=_CENTRE[0],
        lon=_CENTRE[1],
        radius_m=_RADIUS,
        category=category,
    )


@query(
    "radius_search",
    f"""WITH {_HITS_SQL} SELECT entidade_id, nome, endereco, categoria_id, territorio_id,
  round(distancia_m, 3) AS distancia_m, confianca, round(lat, 6) AS lat, round(lon, 6) AS lon
FROM hits WHERE confianca IN ('alta', 'media')""",
)
def radius_search(spark: SparkSession, sf: str) -> DataFrame:
    found = _search(spark, sf)[0]
    return shown(found.withColumn("distancia_m", F.round("distancia_m", 3)))


@query(
    "radius_totals",
    f"""WITH {_HITS_SQL} SELECT CAST(count(*) FILTER (WHERE confianca IN ('alta', 'media')) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE confianca = 'baixa') AS BIGINT) AS excluidos_baixa_confianca
FROM hits WHERE categoria_id = 'bares_restaurantes'""",
)
def radius_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "bares_restaurantes")[1]


_ADDRESS = "Customer#000000001"
_ADDRESS_SQL = _HITS_SQL.replace(f"{_CENTRE[0]}::DOUBLE AS lat_a", "(SELECT lat1 FROM point) AS lat_a").replace(
    f"{_CENTRE[1]}::DOUBLE AS lon_a", "(SELECT lon1 FROM point) AS lon_a"
)


@query(
    "address_search",
    f"""WITH {q.CANDIDATES}, point AS (SELECT lat1, lon1 FROM resolved JOIN customer USING (c_custkey)
  WHERE c_name = '{_ADDRESS}' AND status = 'sucesso'), {_ADDRESS_SQL}
SELECT entidade_id, nome, endereco, categoria_id, territorio_id, round(distancia_m, 3) AS distancia_m, confianca,
  round(lat, 6) AS lat, round(lon, 6) AS lon, round((SELECT lat1 FROM point), 6) AS ponto_lat,
  round((SELECT lon1 FROM point), 6) AS ponto_lon FROM hits WHERE confianca IN ('alta', 'media')""",
)
def address_search(spark: SparkSession, sf: str) -> DataFrame:
    """Businesses around a searched address, with the point that was found for it."""
    found, _ = requests.address_search(
        v.search_lists(spark, sf), v.first_locations(spark, sf), v.observations(spark, sf), v.entities(spark, sf),
        code_category_seed(spark), address=_ADDRESS, radius_m=_RADIUS,
    )
    return shown(found.withColumn("distancia_m", F.round("distancia_m", 3)))


@query(
    "radius_join",
    f"""WITH {q.FIRST_LOCATIONS},
points AS (SELECT s_suppkey AS ponto_id, {q.lat('(s_suppkey * 31)')} AS lat_a, {q.lon('(s_suppkey * 17)')} AS lon_a FROM supplier),
pairs AS (SELECT ponto_id, lat_a, lon_a, confianca, lat AS lat_b, lon AS lon_b FROM points, locations WHERE lat IS NOT NULL),
{q.geodesic('pairs', 'measured')}
SELECT ponto_id, CAST(count(*) FILTER (WHERE confianca IN ('alta', 'media')) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE confianca = 'baixa') AS BIGINT) AS excluidos_baixa_confianca,
  round(min(distancia_m), 3) AS menor_distancia_m, round(max(distancia_m), 3) AS maior_distancia_m
FROM measured WHERE distancia_m <= 500 GROUP BY 1""",
)
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    """Totals around every supplier at once."""
    pairs = radius.radius_join(v.first_locations(spark, sf), v.search_points(spark, sf), 500)
    return pairs.groupBy("ponto_id").agg(
        *radius.total_columns(),
        F.round(F.min("distancia_m"), 3).alias("menor_distancia_m"),
        F.round(F.max("distancia_m"), 3).alias("maior_distancia_m"),
    )


# ---- permit lines -------------------------------------------------------------------------


def _permits(spark: SparkSession, sf: str) -> DataFrame:
    slugs = normalize.territory_slugs(v.nation_names(spark, sf))
    return normalize.normalize_permits(v.raw_permits(spark, sf), slugs)


@query(
    "permit_normalize",
    f"""WITH {q.PERMITS} SELECT md5('comercio:' || numero_do_alvara) AS entidade_id,
  md5(md5('comercio:' || numero_do_alvara) || ':alvaras_smf:2026-08-01') AS observacao_id, * EXCLUDE (p_partkey) FROM permits""",
)
def permit_normalize(spark: SparkSession, sf: str) -> DataFrame:
    kept = (
        "numero_do_alvara", "nome_empresarial", "nome_fantasia", "inicio_atividade", "data_emissao",
        "data_expiracao", "endereco", "numero", "unidade", "andar", "complemento", "bairro", "territorio_id", "cep",
        "cnae_principal", "atividade_principal",
    )
    return _permits(spark, sf).select("entidade_id", "observacao_id", *[f"atributos.{a}" for a in kept])


_DECOMPOSED = ", ".join(f"'{c}': '{a.replace(chr(39), chr(39) * 2)}'" for c, a in q.decomposed().items())


@query(
    "slug_names",
    f"""WITH table_of AS (SELECT MAP {{{_DECOMPOSED}}} AS m)
SELECT doc_id, trim(regexp_replace(lower(list_aggregate(list_transform(string_split(text, ''),
  lambda c: CASE WHEN ord(c) < 128 THEN c ELSE coalesce(m[c], '') END), 'string_agg', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM documents, table_of""",
)
def slug_names(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs of whole texts; SQL looks each character up in a table made by Python's Unicode data."""
    return v.table(spark, sf, "documents").select("doc_id", text.slug("text").alias("slug"))


@query(
    "unmatched_names",
    f"""WITH {q.PERMITS} SELECT bairro, CAST(count(*) AS BIGINT) AS linhas FROM permits
WHERE territorio_id IS NULL AND bairro IS NOT NULL GROUP BY 1""",
)
def unmatched_names(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.unmatched_names(_permits(spark, sf))


@query(
    "distinct_names",
    f"WITH {q.PERMITS} SELECT DISTINCT bairro FROM permits WHERE bairro IS NOT NULL",
)
def distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.distinct_names(_permits(spark, sf))


@query(
    "first_line_wins",
    """WITH placed AS (SELECT o_custkey, o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT md5('customer:' || o_custkey) AS entidade_id, o_orderkey AS linha, o_orderpriority AS valor FROM placed WHERE n = 1""",
)
def first_line_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of one key, here the orders of a customer: the first line is kept."""
    lines = v.table(spark, sf, "orders").select(
        v.entity_id("o_custkey").alias("entidade_id"),
        F.col("o_orderkey").alias("linha"),
        F.col("o_orderpriority").alias("valor"),
        F.col("o_orderkey").alias("position"),
    )
    return normalize.first_lines(lines, ("entidade_id",))


@query(
    "stored_entity_ids",
    f"""WITH {q.PERMITS} SELECT CASE WHEN c_custkey IS NOT NULL THEN 'old-' || c_custkey END AS stored_id, numero_do_alvara
FROM permits LEFT JOIN customer ON numero_do_alvara = CAST(c_custkey AS VARCHAR)""",
)
def stored_entity_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of a load replaced by the stored ids of the same business keys."""
    stored = v.table(spark, sf, "customer").select(
        F.concat(F.lit("old-"), "c_custkey").alias("entidade_id"),
        F.lit("comercio").alias("tipo_entidade"),
        F.col("c_custkey").cast("string").alias("identificador_fonte"),
    )
    found = normalize.with_stored_ids(_permits(spark, sf), stored)
    # Lines without a stored entity keep the computed id, which is no number in SQL.
    own = F.when(F.col("entidade_id").startswith("old-"), F.col("entidade_id"))
    return found.select(own.alias("stored_id"), "atributos.numero_do_alvara")


@query(
    "json_attributes",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events",
)
def json_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "search_text",
    """SELECT c_custkey, CASE WHEN contains(lower(t), 'curitiba') THEN t ELSE t || ', Curitiba, PR, Brasil' END AS busca
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ', CURITIBA' ELSE c_name END AS t FROM customer)""",
)
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(", CURITIBA"))).otherwise(
        F.col("c_name")
    )
    return v.table(spark, sf, "customer").select("c_custkey", complete_search_text(name).alias("busca"))


@query(
    "quality_report",
    f"""WITH {q.obs()}, {q.ENTITIES}, {q.TERRITORIES},
faulty AS (SELECT *, CASE WHEN numero_do_alvara::BIGINT % 29 = 0 THEN '' ELSE 'alvaras_smf' END AS fonte,
  CASE WHEN numero_do_alvara::BIGINT % 31 = 0 THEN NULL ELSE 'x' END AS ref FROM obs)
SELECT 'observation_rejected' AS regra, CAST(count(*) AS BIGINT) AS linhas FROM faulty WHERE fonte = '' OR ref IS NULL
UNION ALL SELECT 'observation_without_business', CAST(count(*) AS BIGINT) FROM obs
  WHERE entidade_id NOT IN (SELECT entidade_id FROM entities WHERE tipo_entidade = 'comercio')
UNION ALL SELECT 'customer_without_territory', CAST(count(*) AS BIGINT) FROM customer
  WHERE 'nation-' || c_nationkey NOT IN (SELECT territorio_id FROM territories)
UNION ALL SELECT 'doubled_supplier_nation', CAST(count(*) AS BIGINT) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)""",
)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Validity, orphan and duplicate checks over planted faults."""
    seen = v.observations(spark, sf)
    number = F.col("atributos.numero_do_alvara").cast("bigint")
    faulty = seen.withColumns(
        {
            "fonte_id": F.when(number % 29 == 0, "").otherwise(F.col("fonte_id")),
            "snapshot_ref": F.when(number % 31 != 0, F.col("snapshot_ref")),
        }
    )
    businesses = v.entities(spark, sf).filter("tipo_entidade = 'comercio'")
    customers = v.table(spark, sf, "customer").select(v.territory_id("c_nationkey").alias("territorio_id"))
    return quality.report(
        {
            "observation_rejected": quality.rejected(faulty, quality.observation_rules()),
            "observation_without_business": quality.orphans(seen, "entidade_id", businesses),
            "customer_without_territory": quality.orphans(
                customers, "territorio_id", v.territories(spark, sf)
            ),
            "doubled_supplier_nation": quality.duplicates(v.table(spark, sf, "supplier"), "s_nationkey"),
        }
    )


@query(
    "event_validity",
    """SELECT event_id, concat_ws(',', CASE WHEN event_type NOT IN ('PRIMEIRA_OBSERVACAO', 'ABERTURA_CONFIRMADA',
  'DESAPARECIMENTO', 'FECHAMENTO_CONFIRMADO', 'MUDANCA_CATEGORIA') THEN 'event_type' END,
  CASE WHEN user_id % 4 = 3 THEN 'confianca' END, CASE WHEN user_id % 5 = 0 THEN 'origem_observacoes' END) AS motivos
FROM events""",
)
def event_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Broken rules of each row of the event stream."""
    user = F.col("user_id")
    labels = F.array(*map(F.lit, ("alta", "media", "baixa", "incerta")))
    rows = v.table(spark, sf, "events").select(
        "event_id",
        F.lit("comercio").alias("entity_type"),
        "event_type",
        F.get(labels, (user % 4).cast("int")).alias("confianca"),
        F.when(user % 5 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(user.cast("string")))
        .alias("origem_observacoes"),
    )
    return quality.checked(rows, quality.event_rules()).select(
        "event_id", F.concat_ws(",", "motivos").alias("motivos")
    )


# ---- geometry -----------------------------------------------------------------------------


def _square(x: str, y: str, size: int) -> list[tuple[str, str]]:
    return [(f"{x} + {a}", f"{y} + {b}") for a, b in ((0, 0), (0, size), (size, size), (size, 0), (0, 0))]


@query(
    "ring_orientation",
    """WITH kinds(kind, clockwise, points, divisor) AS (VALUES (0, true, 5, 1), (1, false, 5, 3), (2, true, 3, 5), (3, true, 5, 4))
SELECT 'nation-' || n_nationkey AS territorio_id,
  CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY kind) - 1 AS BIGINT) AS anel,
  CASE WHEN kind = 2 THEN 3 ELSE 5 END AS pontos, clockwise AS horario
FROM nation, kinds WHERE n_nationkey % divisor = 0""",
)
def ring_orientation(spark: SparkSession, sf: str) -> DataFrame:
    each = v.rings(spark, sf).select("territorio_id", F.posexplode("rings").alias("anel", "ring"))
    return each.select(
        "territorio_id",
        F.col("anel").cast("bigint").alias("anel"),
        F.size("ring").alias("pontos"),
        geodesy.is_clockwise(F.col("ring")).alias("horario"),
    )


@query(
    "polygon_assembly",
    """SELECT 'nation-' || n_nationkey AS territorio_id, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END AS partes,
  CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS aneis_da_primeira FROM nation""",
)
def polygon_assembly(spark: SparkSession, sf: str) -> DataFrame:
    parts = geodesy.group_rings(F.col("rings"))
    return v.rings(spark, sf).select(
        "territorio_id", F.size(parts).alias("partes"), F.size(parts[0]).alias("aneis_da_primeira")
    )


def _inverse_sql(x: str, y: str) -> tuple[str, str]:
    """Degrees from metres in SQL, by the same published series in other words."""
    r, beta, delta = geodesy._krueger()
    xi, eta = f"(({y} - 10000000.0::DOUBLE) / {0.9996 * r!r}::DOUBLE)", f"(({x} - 500000.0::DOUBLE) / {0.9996 * r!r}::DOUBLE)"
    terms = [(b, 2 * j) for j, b in enumerate(beta, start=1)]
    cosh, sinh = "((exp({0}) + exp(-({0}))) / 2)", "((exp({0}) - exp(-({0}))) / 2)"
    xi1 = f"({xi} - " + " - ".join(f"{b!r}::DOUBLE * sin({k} * {xi}) * {cosh.format(f'{k} * {eta}')}" for b, k in terms) + ")"
    eta1 = f"({eta} - " + " - ".join(f"{b!r}::DOUBLE * cos({k} * {xi}) * {sinh.format(f'{k} * {eta}')}" for b, k in terms) + ")"
    chi = f"asin(sin({xi1}) / {cosh.format(eta1)})"
    phi = f"{chi} + " + " + ".join(f"{d!r}::DOUBLE * sin({k} * {chi})" for d, k in [(d, 2 * j) for j, d in enumerate(delta, start=1)])
    return f"-51.0 + degrees(atan({sinh.format(eta1)} / cos({xi1})))", f"degrees({phi})"


_LON, _LAT = _inverse_sql("x", "y")


@query(
    "reproject",
    f"""WITH squares AS (SELECT n_nationkey AS n, 670000.0::DOUBLE + n_nationkey * 1000 + dx AS x, 7183000.0::DOUBLE + dy AS y, k
  FROM nation, (VALUES (0, 0, 0), (1, 0, 500), (2, 500, 500), (3, 500, 0), (4, 0, 0)) corners(k, dx, dy))
SELECT 'nation-' || n AS territorio_id, CAST(k AS BIGINT) AS ponto, round({_LON}, 7) AS lon, round({_LAT}, 7) AS lat FROM squares""",
)
def reproject(spark: SparkSession, sf: str) -> DataFrame:
    """Corners of each nation's square in degrees."""
    ring = geodesy.reproject_ring(F.col("rings")[0])
    corners = v.rings(spark, sf).select("territorio_id", F.posexplode(ring).alias("ponto", "p"))
    return corners.select(
        "territorio_id",
        F.col("ponto").cast("bigint").alias("ponto"),
        F.round(F.col("p")[0], 7).alias("lon"),
        F.round(F.col("p")[1], 7).alias("lat"),
    )


def _territory_polygons(spark: SparkSession, sf: str) -> DataFrame:
    polygons = v.rings(spark, sf).select(
        "territorio_id", geodesy.to_multipolygon(F.col("rings")).alias("geometria")
    )
    return v.all_territories(spark, sf).join(polygons, "territorio_id", "left")


@query(
    "bounds",
    f"""WITH squares AS (SELECT 670000.0::DOUBLE + n_nationkey * 1000 + dx AS x, 7183000.0::DOUBLE + dy AS y
  FROM nation, (VALUES (0, 0, 1), (0, 500, 1), (500, 500, 1), (500, 0, 1),
    (600, 0, 4), (600, 200, 4), (800, 200, 4), (800, 0, 4)) corners(dx, dy, divisor)
  WHERE n_nationkey % divisor = 0),
degrees AS (SELECT {_LON} AS lon, {_LAT} AS lat FROM squares)
SELECT round(min(lon), 7) AS lon_min, round(min(lat), 7) AS lat_min, round(max(lon), 7) AS lon_max, round(max(lat), 7) AS lat_max FROM degrees""",
)
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return shown(territories.bounds(_territory_polygons(spark, sf)), 7)


@query(
    "territory_features",
    f"""WITH {q.ALL_TERRITORIES} SELECT territorio_id, 'Feature' AS tipo, 'MultiPolygon' AS geometria, nome, nivel,
  territorio_pai_id, cidade_id FROM territories""",
)
def territory_features(spark: SparkSession, sf: str) -> DataFrame:
    """GeoJSON lines, read back field by field."""
    lines = exports.feature_lines(_territory_polygons(spark, sf))
    fields = ("territorio_id", "nome", "nivel", "territorio_pai_id", "cidade_id")
    return lines.select(
        F.get_json_object("value", "$.type").alias("tipo"),
        F.get_json_object("value", "$.geometry.type").alias("geometria"),
        *[F.get_json_object("value", f"$.properties.{f}").alias(f) for f in fields],
    )


# ---- sinks: written twice, read back ----------------------------------------------------------


@query(
    "append_once",
    f"""WITH {q.obs()} SELECT entidade_id, CAST(observado_em AS VARCHAR) AS observado_em, territorio_id, cnae_principal,
  CAST((SELECT count(*) FROM obs) AS BIGINT) AS escritas FROM obs""",
)
def append_once(spark: SparkSession, sf: str) -> DataFrame:
    """Observations appended in two overlapping loads; each is stored once, and the loads report what they wrote."""
    path = _scratch(spark)
    seen = v.observations(spark, sf).withColumn("criado_em", F.current_timestamp())
    keys = ("entidade_id", "fonte_id", "observado_em")
    first = tables.append_once(seen.filter("observado_em < '1999-01-01'"), path, OBSERVATION, keys, "observado_em")
    second = tables.append_once(seen, path, OBSERVATION, keys, "observado_em")
    stored = tables.read_appended(spark, path, OBSERVATION)
    return shown(
        stored.select(
            "entidade_id", "observado_em", "atributos.territorio_id", "atributos.cnae_principal",
            F.lit(first + second).cast("bigint").alias("escritas"),
        )
    )


@query(
    "upsert_entities",
    """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'old-' || c_custkey ELSE md5('customer:' || c_custkey) END AS entidade_id,
  CAST(c_custkey AS VARCHAR) AS identificador_fonte, c_custkey % 2 = 0 AS criado_antes,
  NOT (c_custkey % 2 = 0 AND c_custkey % 3 = 0) AS atualizado
FROM customer""",
)
def upsert_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Stored ids win, every entity of the load is marked."""
    key = F.col("c_custkey")
    base = v.table(spark, sf, "customer").select(
        "c_custkey",
        F.lit("comercio").alias("tipo_entidade"),
        key.cast("string").alias("identificador_fonte"),
    )
    before, now = F.lit("2020-01-01").cast("timestamp"), F.lit("2026-08-01").cast("timestamp")
    existing = base.filter(key % 2 == 0).select(
        F.concat(F.lit("old-"), key).alias("entidade_id"),
        "tipo_entidade",
        "identificador_fonte",
        before.alias("criado_em"),
        before.alias("atualizado_em"),
    )
    new = base.filter((key % 3 != 0) | (key % 2 != 0)).withColumn("entidade_id", v.entity_id("c_custkey"))
    after = upserts.entities_after(existing, new, now)
    return after.select(
        "entidade_id",
        "identificador_fonte",
        (F.col("criado_em") == before).alias("criado_antes"),
        (F.col("atualizado_em") == now).alias("atualizado"),
    )


@query(
    "upsert_locations",
    f"""WITH {q.SECOND_PASS}
SELECT l.entidade_id, round(CASE WHEN s.entidade_id IS NULL THEN l.lat ELSE s.lat END, 7) AS lat,
  round(CASE WHEN s.entidade_id IS NULL THEN l.lon ELSE s.lon END, 7) AS lon, l.precisao_geocodebr AS precisao_geocodebr,
  round(s.distancia_desempate_m, 4) AS distancia_desempate_m, 'geocodebr' AS fonte_primaria,
  coalesce(s.confianca, l.confianca) AS confianca, s.fonte_secundaria AS fonte_secundaria,
  true AS geocodificado_antes, s.entidade_id IS NOT NULL AS revisado
FROM locations l LEFT JOIN second s ON s.entidade_id = l.entidade_id""",
)
def upsert_locations(spark: SparkSession, sf: str) -> DataFrame:
    """The second pass over stored first-pass locations keeps the first geocoding time."""
    path = _scratch(spark)
    schema = (
        "entidade_id string, lat double, lon double, confianca string, fonte_primaria string, "
        "fonte_secundaria string, precisao_geocodebr string, distancia_desempate_m double, "
        "geocodificado_em timestamp, revisado_em timestamp"
    )
    first, second = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-02-01").cast("timestamp")
    nothing = tables.read_current(spark, path, schema)
    tables.replace(upserts.locations_after(nothing, v.first_locations(spark, sf), first), path)
    stored = tables.read_current(spark, path, schema)
    tables.replace(upserts.locations_after(stored, _second(spark, sf), second), path)
    after = tables.read_current(spark, path, schema)
    return after.select(
        "entidade_id",
        F.round("lat", 7).alias("lat"),
        F.round("lon", 7).alias("lon"),
        "precisao_geocodebr",
        F.round("distancia_desempate_m", 4).alias("distancia_desempate_m"),
        "fonte_primaria",
        "confianca",
        "fonte_secundaria",
        (F.col("geocodificado_em") == first).alias("geocodificado_antes"),
        F.coalesce(F.col("revisado_em") == second, F.lit(False)).alias("revisado"),
    )


@query(
    "upsert_dimension",
    """SELECT CAST(c_custkey AS VARCHAR) AS categoria_id,
  CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 1 THEN upper(c_name) ELSE c_name END AS nome FROM customer""",
)
def upsert_dimension(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = v.table(spark, sf, "customer")
    existing = rows.filter(key % 2 == 0).select(key.cast("string").alias("categoria_id"), F.col("c_name").alias("nome"))
    new = rows.filter((key % 3 == 0) | (key % 2 != 0)).select(
        key.cast("string").alias("categoria_id"), F.upper("c_name").alias("nome")
    )
    return upserts.overwritten(existing, new, "categoria_id")


@query(
    "insert_ignore",
    """SELECT DISTINCT CAST(p_size AS VARCHAR) AS codigo_cnae, p_brand AS categoria_id FROM part""",
)
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs already there are ignored; a code mapped anew keeps both pairs."""
    pairs = v.table(spark, sf, "part").select(
        F.col("p_size").cast("string").alias("codigo_cnae"), F.col("p_brand").alias("categoria_id")
    )
    existing = pairs.filter(F.col("codigo_cnae") < "3").distinct()
    return upserts.added(existing, pairs, "codigo_cnae", "categoria_id")


@query(
    "replace_table",
    f"WITH {q.OPENINGS} SELECT territorio_id, categoria_id, CAST(mes AS VARCHAR) AS mes, contagem FROM openings",
)
def replace_table(spark: SparkSession, sf: str) -> DataFrame:
    """A derived table written twice holds the second content only."""
    path = _scratch(spark)
    schema = "territorio_id string, categoria_id string, mes date, contagem bigint"
    openings = v.openings(spark, sf)
    tables.replace(openings.filter("contagem > 1"), path, sort_by=("territorio_id", "mes"))
    tables.replace(openings, path, sort_by=("territorio_id", "mes"))
    return shown(tables.read_current(spark, path, schema))
