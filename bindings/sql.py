"""The same views and queries as plain SQL, for the side-by-side check.

Written independently of the Spark side: full outer joins instead of grouped
maxima, row numbers instead of `max_by`, generated months instead of
conditional sums.
"""

from __future__ import annotations

import sys
import unicodedata

from terrapulse.constants import HISTORY_MONTHS
from terrapulse.sources.reference import CATEGORY_CODES

from bindings.views import ACCENTS, PRECISIONS, PRIORITY_CODES

_PAIRS = ", ".join(f"('{c}', '{cat}')" for cat, codes in CATEGORY_CODES.items() for c in codes)

_PRIORITY = " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in PRIORITY_CODES.items())


def norm_code(raw: str) -> str:
    pattern = r"^[A-U]\.(\d{2})\.(\d)\.(\d)-(\d)/(\d{2})-\d{2}$"
    return (
        f"CASE WHEN regexp_matches(trim({raw}), '{pattern}') "
        rf"THEN regexp_replace(trim({raw}), '{pattern}', '\1\2\3\4\5') END"
    )


def start_matches(inicio: str, observado: str) -> str:
    return (
        f"date_trunc('month', CAST({inicio} AS DATE)) = "
        f"date_trunc('month', {observado}) - INTERVAL 1 MONTH"
    )


CODE_MAP = f"code_map(codigo_cnae, categoria_id) AS (VALUES {_PAIRS})"

ALL_TERRITORIES = """territories AS (
  SELECT 'nation-' || n_nationkey AS territorio_id, 'bairro' AS nivel, n_name AS nome,
         'region-' || n_regionkey AS territorio_pai_id, 'curitiba' AS cidade_id
  FROM nation)"""

TERRITORIES = """territories AS (
  SELECT CASE WHEN n_nationkey % 6 = 5 THEN 'former-' ELSE '' END || 'nation-' || n_nationkey AS territorio_id,
         'bairro' AS nivel, n_name AS nome, 'region-' || n_regionkey AS territorio_pai_id, 'curitiba' AS cidade_id
  FROM nation)"""

SEGMENTS = """segments AS (
  SELECT DISTINCT c_mktsegment AS categoria_id,
         upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS nome FROM customer)"""

OPENINGS = """openings AS (
  SELECT 'nation-' || c_nationkey AS territorio_id, c_mktsegment AS categoria_id,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, CAST(count(*) AS BIGINT) AS contagem
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
ref AS (SELECT CAST(max(mes) - INTERVAL 1 MONTH AS DATE) AS ref FROM openings)"""


def obs(start_gaps: bool = False) -> str:
    inicio = "CAST(CAST(start_day AS DATE) AS VARCHAR)"
    if start_gaps:
        inicio = f"CASE WHEN o_orderkey % 19 <> 0 THEN {inicio} END"
    return f"""ranked_orders AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)
                               ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
         min(o_orderdate) OVER (PARTITION BY o_custkey) AS start_day
  FROM orders),
obs AS (
  SELECT md5('customer:' || c_custkey) AS entidade_id,
         CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS observado_em,
         md5(md5('customer:' || c_custkey) || ':alvaras_smf:' ||
             CAST(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS VARCHAR)) AS observacao_id,
         c_name AS nome_empresarial,
         CASE WHEN c_custkey % 3 <> 0 THEN 'Loja ' || c_custkey END AS nome_fantasia,
         CAST(c_custkey AS VARCHAR) AS numero_do_alvara,
         {inicio} AS inicio_atividade,
         'R. ' || c_mktsegment AS endereco,
         CASE WHEN c_custkey % 7 <> 0 THEN lpad(CAST(c_custkey % 1000 AS VARCHAR), 5, '0') END AS numero,
         CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS bairro,
         CASE WHEN c_custkey % 13 <> 0 THEN 'nation-' || c_nationkey END AS territorio_id,
         lpad(CAST(c_custkey * 37 % 100000000 AS VARCHAR), 8, '0') AS cep,
         CASE o_orderpriority {_PRIORITY} END AS cnae_principal
  FROM ranked_orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey WHERE rn = 1)"""


EVENTS = f"""{CODE_MAP},
{obs()},
days AS (SELECT DISTINCT observado_em AS d FROM obs),
spans AS (SELECT d AS d0, lead(d) OVER (ORDER BY d) AS d1 FROM days),
before AS (SELECT spans.d0, spans.d1, obs.* FROM spans JOIN obs ON observado_em = d0 WHERE d1 IS NOT NULL),
after AS (SELECT spans.d0, spans.d1, obs.* FROM spans JOIN obs ON observado_em = d1),
pairs AS (
  SELECT coalesce(b.entidade_id, a.entidade_id) AS entidade_id, coalesce(b.d1, a.d1) AS data_evento,
         b.observacao_id AS old_id, a.observacao_id AS new_id,
         b.cnae_principal AS old_code, a.cnae_principal AS new_code,
         b.territorio_id AS old_territory, a.territorio_id AS new_territory,
         a.inicio_atividade AS start_text
  FROM before b FULL OUTER JOIN after a ON a.d1 = b.d1 AND a.entidade_id = b.entidade_id),
typed AS (
  SELECT *, CASE WHEN new_id IS NULL THEN 'DESAPARECIMENTO'
                 WHEN old_id IS NULL AND {start_matches('start_text', 'data_evento')} THEN 'ABERTURA_CONFIRMADA'
                 WHEN old_id IS NULL THEN 'PRIMEIRA_OBSERVACAO'
                 WHEN old_code <> new_code THEN 'MUDANCA_CATEGORIA' END AS event_type
  FROM pairs),
ev AS (
  SELECT md5(entidade_id || ':' || event_type || ':' || CAST(data_evento AS VARCHAR)) AS evento_id,
         'comercio' AS entity_type, event_type, entidade_id,
         CASE WHEN new_id IS NULL THEN old_territory ELSE new_territory END AS territorio_id,
         data_evento,
         CASE event_type WHEN 'ABERTURA_CONFIRMADA' THEN 'alta' WHEN 'MUDANCA_CATEGORIA' THEN 'media'
              ELSE 'baixa' END AS confianca,
         CASE WHEN event_type = 'MUDANCA_CATEGORIA' THEN old_id || ',' || new_id
              ELSE coalesce(new_id, old_id) END AS origem,
         CASE WHEN event_type = 'MUDANCA_CATEGORIA' THEN old_code END AS cnae_anterior,
         CASE WHEN event_type = 'MUDANCA_CATEGORIA' THEN new_code END AS cnae_atual,
         categoria_id
  FROM typed LEFT JOIN code_map
    ON codigo_cnae = {norm_code("CASE WHEN new_id IS NULL THEN old_code ELSE new_code END")}
  WHERE event_type IS NOT NULL)"""

EVENT_COUNTS = f"""{EVENTS},
event_counts AS (
  SELECT territorio_id, categoria_id, CAST(date_trunc('month', data_evento) AS DATE) AS mes, event_type,
         CAST(count(*) AS BIGINT) AS contagem
  FROM ev WHERE event_type IN ('PRIMEIRA_OBSERVACAO', 'ABERTURA_CONFIRMADA', 'DESAPARECIMENTO')
  GROUP BY ALL)"""

METRICS = """CAST(coalesce(sum(contagem) FILTER (WHERE event_type IN ('PRIMEIRA_OBSERVACAO', 'ABERTURA_CONFIRMADA')), 0) AS BIGINT) AS aberturas,
         CAST(coalesce(sum(contagem) FILTER (WHERE event_type = 'DESAPARECIMENTO'), 0) AS BIGINT) AS desaparecimentos"""


def indicator_columns(value: str, base: str, base_n: str, now: str, now_n: str, then: str, then_n: str) -> str:
    """SQL columns of both indicators from sums and numbers of points."""
    b = f"(CASE WHEN {base_n} >= 3 THEN {base} / {base_n} END)"
    enough = f"({now_n} >= 2 AND {then_n} >= 2)"
    n = f"(CASE WHEN {enough} THEN {now} / {now_n} END)"
    t = f"(CASE WHEN {enough} THEN {then} / {then_n} END)"
    pct = f"(CASE WHEN {t} <> 0 THEN ({n} - {t}) / {t} END)"
    trend = (
        f"(CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 0 AND {n} = 0 THEN 'estavel' "
        f"WHEN {t} = 0 OR {pct} > 0.10 THEN 'acelerando' WHEN {pct} < -0.10 THEN 'desacelerando' "
        "ELSE 'estavel' END)"
    )
    base_reason = f"CASE WHEN {b} IS NULL THEN 'historico_insuficiente' WHEN {b} = 0 THEN 'baseline_zero' END"
    return f"""{value} AS valor_atual, {b} AS baseline,
      CASE WHEN {b} <> 0 THEN ({value} - {b}) / {b} END AS variacao_pct,
      {trend} AS tendencia,
      CASE WHEN {b} IS NULL THEN 'historico_insuficiente' WHEN {trend} IS NULL THEN 'historico_insuficiente'
           WHEN {b} = 0 THEN {base_reason} END AS motivo_indisponivel"""


def filled_indicators(source: str, ref: str) -> str:
    """Indicators at a month over a generated zero-filled series (`territorio_id`, `mes`, `contagem`)."""
    return f"""filled AS (
  SELECT k.territorio_id, m.mes, CAST(coalesce(sum(s.contagem), 0) AS DOUBLE) AS valor
  FROM (SELECT DISTINCT territorio_id FROM {source}) k
  CROSS JOIN (SELECT CAST(unnest(generate_series(({ref}) - INTERVAL {HISTORY_MONTHS} MONTH, CAST(({ref}) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS mes) m
  LEFT JOIN {source} s ON s.territorio_id = k.territorio_id AND s.mes = m.mes
  GROUP BY 1, 2),
windows AS (
  SELECT territorio_id, mes, valor,
    sum(valor) OVER b AS base, count(*) OVER b AS base_n,
    sum(valor) OVER n AS now_sum, count(*) OVER n AS now_n,
    sum(valor) OVER t AS then_sum, count(*) OVER t AS then_n
  FROM filled
  WINDOW b AS (PARTITION BY territorio_id ORDER BY mes RANGE BETWEEN INTERVAL 24 MONTH PRECEDING AND INTERVAL 1 MONTH PRECEDING),
         n AS (PARTITION BY territorio_id ORDER BY mes RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW),
         t AS (PARTITION BY territorio_id ORDER BY mes RANGE BETWEEN INTERVAL 5 MONTH PRECEDING AND INTERVAL 3 MONTH PRECEDING)),
indicators AS (
  SELECT territorio_id, {indicator_columns('valor', 'base', 'base_n', 'now_sum', 'now_n', 'then_sum', 'then_n')}
  FROM windows WHERE mes = ({ref}))"""


RANKING = f"""{OPENINGS},
{filled_indicators('openings', 'SELECT ref FROM ref')},
ranking AS (
  SELECT *, CAST(row_number() OVER (ORDER BY variacao_pct DESC, territorio_id) AS BIGINT) AS posicao,
         CAST(count(*) OVER () AS BIGINT) AS total
  FROM indicators WHERE variacao_pct IS NOT NULL)"""

BALANCE = f"""{EVENT_COUNTS},
last AS (SELECT max(mes) AS ref FROM event_counts),
by_month AS (SELECT territorio_id, mes, {METRICS} FROM event_counts GROUP BY 1, 2),
points AS (SELECT territorio_id, mes, CAST(aberturas - desaparecimentos AS DOUBLE) AS valor,
           date_diff('month', mes, (SELECT ref FROM last)) AS back FROM by_month),
sums AS (
  SELECT territorio_id, coalesce(sum(valor) FILTER (WHERE back = 0), 0) AS valor,
    sum(valor) FILTER (WHERE back BETWEEN 1 AND 24) AS base, count(*) FILTER (WHERE back BETWEEN 1 AND 24) AS base_n,
    sum(valor) FILTER (WHERE back BETWEEN 0 AND 2) AS now_sum, count(*) FILTER (WHERE back BETWEEN 0 AND 2) AS now_n,
    sum(valor) FILTER (WHERE back BETWEEN 3 AND 5) AS then_sum, count(*) FILTER (WHERE back BETWEEN 3 AND 5) AS then_n
  FROM points GROUP BY 1),
balance AS (
  SELECT territorio_id, {indicator_columns('valor', 'base', 'base_n', 'now_sum', 'now_n', 'then_sum', 'then_n')}
  FROM sums)"""

MONTH_INDICATORS = f"""{EVENT_COUNTS}, {OPENINGS},
by_month AS (SELECT territorio_id, mes, {METRICS} FROM event_counts GROUP BY 1, 2),
complete AS (SELECT CAST(max(mes) - INTERVAL 1 MONTH AS DATE) AS until FROM event_counts),
last AS (SELECT territorio_id, max(mes) AS last_mes FROM by_month WHERE territorio_id IS NOT NULL GROUP BY 1),
filled AS (
  SELECT l.territorio_id, CAST(m.mes AS DATE) AS mes, CAST(coalesce(sum(o.contagem), 0) AS DOUBLE) AS valor
  FROM (SELECT territorio_id, unnest(generate_series(last_mes - INTERVAL {HISTORY_MONTHS} MONTH, CAST(last_mes AS TIMESTAMP), INTERVAL 1 MONTH)) AS mes FROM last) m
  JOIN last l USING (territorio_id)
  LEFT JOIN openings o ON o.territorio_id = m.territorio_id AND o.mes = CAST(m.mes AS DATE)
  GROUP BY 1, 2),
sums AS (
  SELECT b.territorio_id, b.mes,
    coalesce(sum(f.valor) FILTER (WHERE f.mes = b.mes), 0) AS valor,
    sum(f.valor) FILTER (WHERE date_diff('month', f.mes, b.mes) BETWEEN 1 AND 24) AS base,
    count(f.mes) FILTER (WHERE date_diff('month', f.mes, b.mes) BETWEEN 1 AND 24) AS base_n,
    sum(f.valor) FILTER (WHERE date_diff('month', f.mes, b.mes) BETWEEN 0 AND 2) AS now_sum,
    count(f.mes) FILTER (WHERE date_diff('month', f.mes, b.mes) BETWEEN 0 AND 2) AS now_n,
    sum(f.valor) FILTER (WHERE date_diff('month', f.mes, b.mes) BETWEEN 3 AND 5) AS then_sum,
    count(f.mes) FILTER (WHERE date_diff('month', f.mes, b.mes) BETWEEN 3 AND 5) AS then_n
  FROM by_month b LEFT JOIN filled f ON f.territorio_id = b.territorio_id
  WHERE b.territorio_id IS NOT NULL GROUP BY 1, 2),
raw_indicators AS (
  SELECT territorio_id, mes, {indicator_columns('valor', 'base', 'base_n', 'now_sum', 'now_n', 'then_sum', 'then_n')}
  FROM sums),
month_indicators AS (
  SELECT territorio_id, mes,
    CASE WHEN mes > until THEN 0.0 ELSE valor_atual END AS valor_atual,
    CASE WHEN mes <= until THEN baseline END AS baseline,
    CASE WHEN mes <= until THEN variacao_pct END AS variacao_pct,
    CASE WHEN mes <= until THEN tendencia END AS tendencia,
    CASE WHEN mes > until THEN 'mes_incompleto' ELSE motivo_indisponivel END AS motivo_indisponivel
  FROM raw_indicators, complete)"""

ENTITIES = """entities AS (
  SELECT md5('customer:' || c_custkey) AS entidade_id,
         CASE WHEN c_custkey % 23 = 0 THEN 'obra' ELSE 'comercio' END AS tipo_entidade,
         CAST(c_custkey AS VARCHAR) AS identificador_fonte FROM customer)"""


def lat(key: str) -> str:
    return f"(-25.60::DOUBLE + ({key} * 7919 % 20000)::DOUBLE / 100000)"


def lon(key: str) -> str:
    return f"(-49.40::DOUBLE + ({key} * 104729 % 20000)::DOUBLE / 100000)"


_PRECISION = "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PRECISIONS)) + " END"

FIRST_LOCATIONS = f"""locations AS (
  SELECT c_custkey, md5('customer:' || c_custkey) AS entidade_id,
         CASE WHEN c_custkey % 7 <> 6 THEN {lat('c_custkey')} END AS lat,
         CASE WHEN c_custkey % 7 <> 6 THEN {lon('c_custkey')} END AS lon,
         CASE WHEN c_custkey % 7 = 0 THEN 'alta' ELSE 'baixa' END AS confianca,
         {_PRECISION} AS precisao_geocodebr
  FROM customer)"""


def planar(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"sqrt(pow(({lat2} - {lat1}) * 111320, 2) + "
        f"pow(({lon2} - {lon1}) * 111320 * cos(radians(({lat1} + {lat2}) / 2)), 2))"
    )


CANDIDATES = f"""candidates AS (
  SELECT c_custkey, md5('customer:' || c_custkey) AS entidade_id, c_custkey % 3 AS n,
         {lat('c_custkey')} + (c_custkey % 31) * 0.0005::DOUBLE AS lat1, {lon('c_custkey')} AS lon1,
         {lat('c_custkey')} + (c_custkey % 31) * 0.0005::DOUBLE + (c_custkey % 20) * 0.0001::DOUBLE AS lat2
  FROM customer),
placed AS (SELECT *, CASE WHEN n = 2 THEN {planar('lat1', 'lon1', 'lat2', 'lon1')} END AS apart FROM candidates),
resolved AS (
  SELECT *, CASE WHEN n = 0 THEN 'falha' WHEN n = 1 OR apart <= 50 THEN 'sucesso' ELSE 'ambiguo' END AS status
  FROM placed)"""

SECOND_PASS = f"""{FIRST_LOCATIONS}, {CANDIDATES}, {obs()},
waiting AS (
  SELECT l.entidade_id, l.lat, l.lon, precisao_geocodebr FROM locations l
  WHERE confianca = 'baixa' AND l.entidade_id IN (SELECT entidade_id FROM obs)),
both_points AS (
  SELECT w.entidade_id, w.precisao_geocodebr, w.lat AS lat_a, w.lon AS lon_a,
         CASE WHEN status = 'sucesso' THEN lat1 END AS lat_b, CASE WHEN status = 'sucesso' THEN lon1 END AS lon_b
  FROM waiting w LEFT JOIN resolved r ON r.entidade_id = w.entidade_id),
measured AS (SELECT *, {planar('lat_a', 'lon_a', 'lat_b', 'lon_b')} AS apart FROM both_points),
second AS (
  SELECT entidade_id, coalesce(lat_b, lat_a) AS lat, coalesce(lon_b, lon_a) AS lon,
    CASE WHEN lat_b IS NULL THEN 'baixa' WHEN lat_a IS NULL THEN 'media' WHEN apart <= 150 THEN 'alta'
         WHEN apart <= 1000 THEN 'media' ELSE 'baixa' END AS confianca,
    'geocodebr' AS fonte_primaria, 'nominatim' AS fonte_secundaria, precisao_geocodebr,
    apart AS distancia_desempate_m
  FROM measured)"""


def geodesic(source: str, out: str, iterations: int = 5) -> str:
    """CTEs that add `distancia_m` between (lat_a, lon_a) and (lat_b, lon_b): Vincenty's inverse formula."""
    f, a = "(1/298.257223563::DOUBLE)", "6378137.0::DOUBLE"
    b = f"({a} * (1 - {f}))"
    steps = [
        f"""g0 AS (SELECT *, radians(lon_b - lon_a) AS l, radians(lon_b - lon_a) AS lam,
  sin(atan((1 - {f}) * tan(radians(lat_a)))) AS su1, cos(atan((1 - {f}) * tan(radians(lat_a)))) AS cu1,
  sin(atan((1 - {f}) * tan(radians(lat_b)))) AS su2, cos(atan((1 - {f}) * tan(radians(lat_b)))) AS cu2
  FROM {source})"""
    ]
    keep = "* EXCLUDE (lam)"
    for i in range(iterations):
        drop = "" if i == 0 else " EXCLUDE (ss, cs, sa, c2a, c2m, sig, cc)"
        steps.append(
            f"""a{i} AS (SELECT *{drop},
  sqrt(pow(cu2 * sin(lam), 2) + pow(cu1 * su2 - su1 * cu2 * cos(lam), 2)) AS ss,
  su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM g{i}),
b{i} AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cu1 * cu2 * sin(lam) / ss END AS sa, atan2(ss, cs) AS sig FROM a{i}),
c{i} AS (SELECT *, 1 - sa * sa AS c2a FROM b{i}),
d{i} AS (SELECT *, CASE WHEN c2a = 0 THEN 0 ELSE cs - 2 * su1 * su2 / c2a END AS c2m,
  {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS cc FROM c{i}),
g{i + 1} AS (SELECT {keep}, l + (1 - cc) * {f} * sa * (sig + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))) AS lam FROM d{i})"""
        )
    last = f"g{iterations}"
    steps.append(
        f"""u AS (SELECT *, c2a * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS uu FROM {last}),
v AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768)) AS aa,
  uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128)) AS bb FROM u),
{out} AS (SELECT *, {b} * aa * (sig - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1)
  - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) AS distancia_m FROM v)"""
    )
    return ",\n".join(steps)


def clean(text: str) -> str:
    return f"CASE WHEN trim({text}) NOT IN ('', '***') THEN trim({text}) END"


def decomposed() -> dict[str, str]:
    """Every character beyond ASCII that decomposes to some ASCII, with that."""
    chars = (chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF)
    plain = ((c, unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode("ascii")) for c in chars)
    return {c: a for c, a in plain if a}


def slug(text: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({text})), '[^a-z0-9]+', '-', 'g'), '-')"


def iso(text: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({text}, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') "
        f"THEN CAST(try_cast(try_strptime({text}, '%d/%m/%Y') AS DATE) AS VARCHAR) END"
    )


_CODES = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN '{c} '" for i, c in enumerate(PRIORITY_CODES.values())) + " END"

PERMITS = f"""permit_lines AS (
  SELECT p_partkey,
    '  ' || p_name || ' ' AS nome_empresarial,
    CASE WHEN p_partkey % 8 = 0 THEN '***' ELSE (p_partkey % 33) || '/' || (p_partkey % 14) || '/' || (2000 + p_partkey % 25) END AS inicio,
    CASE WHEN p_partkey % 10 = 0 THEN ' *** ' ELSE CAST(p_partkey AS VARCHAR) END AS numero_do_alvara,
    CASE WHEN p_partkey % 4 = 0 THEN '   ' ELSE p_brand END AS nome_fantasia,
    (2000 + p_partkey % 25) || '-' || (p_partkey % 14) || '-' || (p_partkey % 33) AS emissao,
    lpad(CAST(p_partkey % 33 AS VARCHAR), 2, '0') || '/' || lpad(CAST(p_partkey % 14 AS VARCHAR), 2, '0') || '/2030' AS expiracao,
    'R. ' || p_type AS endereco, lpad(CAST(p_size AS VARCHAR), 5, '0') AS numero,
    CASE WHEN p_partkey % 12 = 0 THEN '***' ELSE ' ' || coalesce(CASE WHEN p_partkey % 2 = 0 THEN n_name
      ELSE translate(n_name, '{"".join(ACCENTS)}', '{"".join(ACCENTS.values())}') END, 'BAIRRO ' || (p_partkey % 30)) END AS bairro,
    lpad(CAST(p_partkey * 91 % 100000000 AS VARCHAR), 8, '0') AS cep, {_CODES} AS cnae, p_type,
    CASE WHEN p_partkey % 7 = 0 THEN ' AP ' || (p_partkey % 40) || ' ' ELSE '***' END AS unidade,
    CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 21 AS VARCHAR) ELSE ' ' END AS andar,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS complemento
  FROM part LEFT JOIN nation ON p_partkey % 30 = n_nationkey),
slugs AS (SELECT {slug('n_name')} AS slug, max('nation-' || n_nationkey) AS territorio_id FROM nation GROUP BY 1),
cleaned AS (SELECT *, {clean('bairro')} AS bairro_limpo FROM permit_lines WHERE {clean('numero_do_alvara')} IS NOT NULL),
permits AS (
  SELECT p_partkey, {clean('numero_do_alvara')} AS numero_do_alvara, {clean('nome_empresarial')} AS nome_empresarial,
    {clean('nome_fantasia')} AS nome_fantasia, {iso('inicio')} AS inicio_atividade, {iso('emissao')} AS data_emissao,
    {iso('expiracao')} AS data_expiracao, endereco, numero, {clean('unidade')} AS unidade, {clean('andar')} AS andar,
    {clean('complemento')} AS complemento, bairro_limpo AS bairro, territorio_id, cep, {clean('cnae')} AS cnae_principal,
    {clean('p_type')} AS atividade_principal
  FROM cleaned LEFT JOIN slugs ON {slug('bairro_limpo')} = slug)"""
