"""Territorial views over the generic tables.

Territory = nation, category = market segment or activity code by order
priority, entity = customer, start of activity = first order, one observation
per customer and month with orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.constants import BUSINESS, CITY_ID, NEIGHBOURHOOD, PERMIT_SOURCE
from terrapulse.functions.months import month_start, shift_month
from terrapulse.functions.text import complete_search_text
from terrapulse.schemas import ATTRIBUTES

# Raw activity code of each order priority; the last two are notations without a known code.
PRIORITY_CODES = {
    "1-URGENT": "I.56.1.1-2/03-00",
    "2-HIGH": "S.96.0.2-5/01-00",
    "3-MEDIUM": "G.47.8.1-4/00-00",
    "4-NOT SPECIFIED": "7-31.40.12",
    "5-LOW": "W.12.3.4-5/67-89",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def territory_id(key: str) -> Column:
    return F.concat(F.lit("nation-"), F.col(key))


def entity_id(key: str) -> Column:
    return F.md5(F.concat(F.lit("customer:"), F.col(key)))


def all_territories(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation."""
    return table(spark, sf, "nation").select(
        territory_id("n_nationkey").alias("territorio_id"),
        F.lit(NEIGHBOURHOOD).alias("nivel"),
        F.col("n_name").alias("nome"),
        F.concat(F.lit("region-"), F.col("n_regionkey")).alias("territorio_pai_id"),
        F.lit(CITY_ID).alias("cidade_id"),
    )


def territories(spark: SparkSession, sf: str) -> DataFrame:
    """Nations, for queries about label fallbacks: every sixth one is registered under another id, so its label isn't found."""
    lost = F.pmod(F.substring("territorio_id", 8, 9).cast("int"), F.lit(6)) == 5
    named = F.when(lost, F.concat(F.lit("former-"), "territorio_id")).otherwise(F.col("territorio_id"))
    return all_territories(spark, sf).withColumn("territorio_id", named)


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Market segments as categories."""
    name = F.col("c_mktsegment")
    return (
        table(spark, sf, "customer")
        .select(name.alias("categoria_id"), F.initcap(name).alias("nome"))
        .distinct()
    )


def openings(spark: SparkSession, sf: str) -> DataFrame:
    """Start-date counts: one opening per order."""
    orders = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            territory_id("c_nationkey").alias("territorio_id"),
            F.col("c_mktsegment").alias("categoria_id"),
            month_start("day").alias("mes"),
        )
        .agg(F.count(F.lit(1)).alias("contagem"))
    )


def fine_openings(spark: SparkSession, sf: str) -> DataFrame:
    """Start-date counts by segment and order priority: 25 categories."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    category = F.when(F.col("o_orderpriority") != "5-LOW", F.concat_ws("/", "c_mktsegment", "o_orderpriority"))
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(territory_id("c_nationkey").alias("territorio_id"), category.alias("categoria_id"), month_start("day").alias("mes"))
        .agg(F.count(F.lit(1)).alias("contagem"))
    )


def fine_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the categories of `fine_openings`, but for one priority, so that a label is missing."""
    rows = fine_openings(spark, sf).select("categoria_id").distinct().filter("categoria_id NOT LIKE '%/1-URGENT'")
    return rows.withColumn("nome", F.lower("categoria_id"))


def search_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate lists of search texts: the customers' names, completed by the city."""
    names = table(spark, sf, "customer").select(entity_id("c_custkey").alias("entidade_id"), complete_search_text("c_name").alias("endereco"))
    return candidate_lists(spark, sf).join(names, "entidade_id")


def last_full_month(counts: DataFrame) -> Column:
    """Month before the last one with counts, as a scalar."""
    return counts.agg(shift_month(F.max("mes"), -1).alias("m")).scalar()


def observations(spark: SparkSession, sf: str, *, start_gaps: bool = False) -> DataFrame:
    """Snapshots: the latest order of a customer's month, seen on the first day of the next month.

    `start_gaps` leaves out the start date where the order key is a multiple of 19.
    """
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day")
    )
    monthly = (
        orders.groupBy("o_custkey", month_start("day").alias("mes"))
        .agg(
            F.max_by(F.struct("o_orderpriority", "o_orderkey"), F.struct("day", "o_orderkey")).alias("last"),
            F.min("day").alias("first"),
        )
        .withColumn("start", F.min("first").over(Window.partitionBy("o_custkey")))
    )
    rows = monthly.join(
        table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    ).join(
        table(spark, sf, "nation").select("n_nationkey", "n_name"),
        F.col("c_nationkey") == F.col("n_nationkey"),
    )
    key = F.col("c_custkey")
    code = F.create_map(*[F.lit(x) for pair in PRIORITY_CODES.items() for x in pair])
    start = F.date_format("start", "yyyy-MM-dd")
    values = {
        "nome_empresarial": F.col("c_name"),
        "nome_fantasia": F.when(key % 3 != 0, F.concat(F.lit("Loja "), key)),
        "numero_do_alvara": key.cast("string"),
        "inicio_atividade": F.when(F.col("last.o_orderkey") % 19 != 0, start) if start_gaps else start,
        "endereco": F.concat(F.lit("R. "), F.col("c_mktsegment")),
        "numero": F.when(key % 7 != 0, F.lpad((key % 1000).cast("string"), 5, "0")),
        "bairro": F.when(key % 11 != 0, F.col("n_name")),
        "territorio_id": F.when(key % 13 != 0, territory_id("c_nationkey")),
        "cep": F.lpad((key * 37 % 100000000).cast("string"), 8, "0"),
        "cnae_principal": code[F.col("last.o_orderpriority")],
        "atividade_principal": F.col("c_mktsegment"),
    }
    nothing = F.lit(None).cast("string")
    at = shift_month("mes", 1)
    return rows.select(
        F.md5(F.concat_ws(":", entity_id("c_custkey"), F.lit(PERMIT_SOURCE), at)).alias("observacao_id"),
        entity_id("c_custkey").alias("entidade_id"),
        at.alias("observado_em"),
        F.struct(*[values.get(a, nothing).alias(a) for a in ATTRIBUTES]).alias("atributos"),
        F.lit(PERMIT_SOURCE).alias("fonte_id"),
        F.concat(F.lit("snapshot-"), at).alias("snapshot_ref"),
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers; every 23rd one is no business."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        entity_id("c_custkey").alias("entidade_id"),
        F.when(key % 23 == 0, "obra").otherwise(BUSINESS).alias("tipo_entidade"),
        key.cast("string").alias("identificador_fonte"),
    )


def _lat(key: Column) -> Column:
    return F.lit(-25.60) + (key * 7919 % 20000) / 100000


def _lon(key: Column) -> Column:
    return F.lit(-49.40) + (key * 104729 % 20000) / 100000


PRECISIONS = ("numero", "numero_aproximado", "logradouro", "cep", "localidade", "municipio")


def geocoder_results(spark: SparkSession, sf: str) -> DataFrame:
    """First-pass results: two lines for every fifth customer, none for every ninth."""
    key = F.col("c_custkey")
    kind = key % 7
    precision = F.get(F.array(*map(F.lit, PRECISIONS)), kind.cast("int"))
    copies = F.explode(F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (
        table(spark, sf, "customer")
        .filter(key % 9 != 8)
        .select("c_custkey", copies.alias("line"))
        .select(
            entity_id("c_custkey").alias("entidade_id"),
            F.when(kind != 6, _lat(key) + F.col("line") * 0.001).alias("lat"),
            F.when(kind != 6, _lon(key)).alias("lon"),
            precision.alias("precisao"),
            F.lit("dn01").alias("tipo_resultado"),
            F.struct(F.lit("").alias("path"), F.lit(0).alias("block"), F.col("line")).alias("position"),
        )
    )


def first_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Locations after the first pass, of every customer."""
    key = F.col("c_custkey")
    precision = F.get(F.array(*map(F.lit, PRECISIONS)), (key % 7).cast("int"))
    placed = precision.isNotNull()
    return table(spark, sf, "customer").select(
        entity_id("c_custkey").alias("entidade_id"),
        F.when(placed, _lat(key)).alias("lat"),
        F.when(placed, _lon(key)).alias("lon"),
        F.when(precision == "numero", "alta").otherwise("baixa").alias("confianca"),
        F.lit("geocodebr").alias("fonte_primaria"),
        F.lit(None).cast("string").alias("fonte_secundaria"),
        precision.alias("precisao_geocodebr"),
        F.lit(None).cast("double").alias("distancia_desempate_m"),
    )


def candidate_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Second-pass candidates: none, one or two; the first up to 1.7 km off, the second up to 0.2 km from it."""
    key = F.col("c_custkey")
    lat = _lat(key) + (key % 31) * 0.0005

    def candidate(lat: Column, importance: Column) -> Column:
        return F.struct(
            lat.cast("string").alias("lat"),
            _lon(key).cast("string").alias("lon"),
            importance.alias("importance"),
            F.lit("house").alias("type"),
        )

    both = F.array(candidate(lat, F.lit(0.5)), candidate(lat + (key % 20) * 0.0001, F.lit(0.25)))
    return table(spark, sf, "customer").select(
        entity_id("c_custkey").alias("entidade_id"),
        F.slice(both, 1, (key % 3).cast("int")).alias("candidates"),
    )


def search_points(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as search points."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("ponto_id"), _lat(key * 31).alias("ponto_lat"), _lon(key * 17).alias("ponto_lon")
    )


# Accents put into the names; the plain letters come back in the slug.
ACCENTS = {"A": "Á", "E": "ê", "I": "Í", "O": "õ", "C": "Ç"}


def raw_permits(spark: SparkSession, sf: str) -> DataFrame:
    """Raw permit lines, one per part, with every fault the cleaning knows."""
    key = F.col("p_partkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    name = F.translate(F.col("n_name"), "".join(ACCENTS), "".join(ACCENTS.values()))
    unknown = F.concat(F.lit("BAIRRO "), key % 30)
    district = F.coalesce(F.when(key % 2 == 0, F.col("n_name")).otherwise(name), unknown)
    day, month = key % 33, key % 14
    date = F.concat_ws("/", day, month, F.lit(2000) + key % 25)
    code = F.get(F.array(*map(F.lit, PRIORITY_CODES.values())), (key % 5).cast("int"))
    lines = table(spark, sf, "part").join(nation, key % 30 == F.col("n_nationkey"), "left")
    columns = {
        "NOME_EMPRESARIAL": F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")),
        "INICIO_ATIVIDADE": F.when(key % 8 == 0, "***").otherwise(date),
        "NUMERO_DO_ALVARA": F.when(key % 10 == 0, " *** ").otherwise(key.cast("string")),
        "NOME_FANTASIA": F.when(key % 4 == 0, "   ").otherwise(F.col("p_brand")),
        "DATA_EMISSAO": F.concat_ws("-", F.lit(2000) + key % 25, month, day),
        "DATA_EXPIRACAO": F.concat_ws("/", F.lpad(day.cast("string"), 2, "0"), F.lpad(month.cast("string"), 2, "0"), F.lit("2030")),
        "ENDERECO": F.concat(F.lit("R. "), F.col("p_type")),
        "NUMERO": F.lpad(F.col("p_size").cast("string"), 5, "0"),
        "BAIRRO": F.when(key % 12 == 0, "***").otherwise(F.concat(F.lit(" "), district)),
        "CEP": F.lpad((key * 91 % 100000000).cast("string"), 8, "0"),
        "CNAE_ATIVIDADE_PRINCIPAL": F.concat(code, F.lit(" ")),
        "ATIVIDADE_PRINCIPAL": F.col("p_type"),
    }
    columns["UNIDADE"] = F.when(key % 7 == 0, F.concat(F.lit(" AP "), key % 40, F.lit(" "))).otherwise("***")
    columns["ANDAR"] = F.when(key % 9 != 0, (key % 21).cast("string")).otherwise(" ")
    columns["COMPLEMENTO"] = F.when(key % 3 == 0, F.col("p_brand")).otherwise("")
    return lines.select(
        *[c.alias(n) for n, c in columns.items()],
        F.lit("file").alias("snapshot_ref"),
        F.lit("2026-08-01").cast("date").alias("observado_em"),
        F.struct(F.lit("file").alias("path"), F.lit(0).alias("block"), key.alias("line")).alias("position"),
    )


def nation_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        territory_id("n_nationkey").alias("territorio_id"), F.col("n_name").alias("nome")
    )


def rings(spark: SparkSession, sf: str) -> DataFrame:
    """Projected rings per nation: a square, and for some a hole, a second part, a ring that is too short."""
    n = F.col("n_nationkey")

    def ring(x: Column, y: Column, size: float, clockwise: bool) -> Column:
        steps = ((0, 0), (0, size), (size, size), (size, 0), (0, 0))
        if not clockwise:
            steps = steps[::-1]
        return F.array(*[F.array(x + F.lit(float(a)), y + F.lit(float(b))) for a, b in steps])

    x, y = F.lit(670000.0) + n * 1000, F.lit(7183000.0)
    nothing = F.lit(None)
    parts = F.array(
        ring(x, y, 500, True),
        F.when(n % 3 == 0, ring(x + 100, y + 100, 100, False)).otherwise(nothing),
        F.when(n % 5 == 0, F.slice(ring(x + 5, y + 5, 5, True), 1, 3)).otherwise(nothing),
        F.when(n % 4 == 0, ring(x + 600, y, 200, True)).otherwise(nothing),
    )
    return table(spark, sf, "nation").select(
        territory_id("n_nationkey").alias("territorio_id"), F.array_compact(parts).alias("rings")
    )
