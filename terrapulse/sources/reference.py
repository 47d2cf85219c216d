"""Activity codes, territories and the seeded categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.constants import CITY_ID, NEIGHBOURHOOD
from terrapulse.functions.geodesy import to_multipolygon
from terrapulse.functions.text import slug, strip

CODE_JSON = (
    "id string, descricao string, classe struct<id:string, descricao:string, "
    "grupo:struct<id:string, descricao:string, divisao:struct<id:string, descricao:string, "
    "secao:struct<id:string, descricao:string>>>>"
)
FEATURE_JSON = (
    "features array<struct<attributes:struct<objectid:bigint, nome:string>, "
    "geometry:struct<rings:array<array<array<double>>>>>>"
)

# Categories and their display names.
CATEGORIES = {
    "alimentacao_varejo": "Comércio varejista de alimentos e bebidas",
    "bares_restaurantes": "Bares, restaurantes e lanchonetes",
    "vestuario_calcados": "Vestuário, calçados e confecção",
    "beleza_estetica": "Beleza e estética",
    "saude_clinicas": "Saúde e clínicas",
    "veterinaria_pet": "Veterinária e pet shop",
    "construcao_civil": "Construção civil e reformas",
    "veiculos_autopecas": "Comércio e manutenção de veículos",
    "transporte_logistica": "Transporte e logística",
    "imobiliario": "Imobiliário",
    "tecnologia_ti": "Tecnologia da informação",
    "juridico_contabil": "Serviços jurídicos e contábeis",
    "consultoria_empresarial": "Consultoria e serviços empresariais",
    "apoio_administrativo": "Apoio administrativo e escritório",
    "engenharia_arquitetura": "Engenharia e arquitetura",
    "publicidade_marketing": "Publicidade e marketing",
    "educacao_treinamento": "Educação e treinamento",
    "eventos_lazer_esporte": "Eventos, lazer e esporte",
    "seguros_financeiro": "Seguros e serviços financeiros",
    "comercio_eletronicos": "Comércio de eletrônicos e informática",
    "comercio_casa_decoracao": "Comércio de casa, móveis e decoração",
    "farmacia_cosmeticos": "Farmácia e cosméticos",
    "comercio_diversos": "Comércio varejista diversos",
    "associacoes_religiao": "Associações e organizações religiosas",
    "turismo": "Turismo e viagens",
    "servicos_gerais": "Outros serviços prestados a empresas",
}

# Activity codes of each category.
CATEGORY_CODES = {
    "apoio_administrativo": ["8211300", "8219999", "8291100"],
    "vestuario_calcados": ["4781400", "1412601"],
    "juridico_contabil": ["6911701", "6920601"],
    "saude_clinicas": ["8630503", "8650003", "8630504", "8650004"],
    "consultoria_empresarial": ["7020400", "7490104"],
    "bares_restaurantes": ["5611201", "5611203", "5611204", "5620104"],
    "seguros_financeiro": ["6462000", "6622300", "6463800", "6619399"],
    "educacao_treinamento": ["8599604", "8599699"],
    "publicidade_marketing": ["7319002", "7319003", "7311400"],
    "construcao_civil": ["4120400", "4399103", "4321500", "4330404", "4330499", "4744099"],
    "beleza_estetica": ["9602501", "9602502"],
    "transporte_logistica": ["4930202", "4930201", "5320202", "5223100"],
    "imobiliario": ["4110700", "6821801", "6810202", "6810201", "6822600"],
    "engenharia_arquitetura": ["7112000", "7111100"],
    "tecnologia_ti": ["6209100", "6204000", "6201501", "6202300", "6319400"],
    "comercio_diversos": ["4619200", "4789099", "4761003", "4789001"],
    "alimentacao_varejo": ["4712100", "4729699", "4723700"],
    "eventos_lazer_esporte": ["8230001", "9313100"],
    "veiculos_autopecas": ["4530703", "4520001", "4511102"],
    "comercio_eletronicos": ["4751201", "4752100", "4753900", "4757100"],
    "associacoes_religiao": ["9430800", "9499500", "9491000"],
    "turismo": ["7911200"],
    "comercio_casa_decoracao": ["4754701", "4744001", "4759899"],
    "farmacia_cosmeticos": ["4772500", "4771701"],
    "veterinaria_pet": ["4789004", "7500100"],
    "servicos_gerais": ["9511800", "8299799"],
}


def _literal_table(spark: SparkSession, rows: list[tuple[str, str]], *names: str) -> DataFrame:
    """A table of literals. Catalyst knows its size, so joins broadcast it without a hint."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def category_seed(spark: SparkSession) -> DataFrame:
    return _literal_table(spark, list(CATEGORIES.items()), "categoria_id", "nome")


def code_category_seed(spark: SparkSession) -> DataFrame:
    pairs = [(code, category) for category, codes in CATEGORY_CODES.items() for code in codes]
    return _literal_table(spark, pairs, "codigo_cnae", "categoria_id")


def read_activity_codes(spark: SparkSession, path: str) -> DataFrame:
    """Nested code hierarchy (one JSON array per file) flattened to seven columns."""
    tree = spark.read.schema(CODE_JSON).option("multiLine", "true").json(path)
    return tree.select(
        F.col("id").alias("codigo_cnae"),
        "descricao",
        F.col("classe.grupo.divisao.secao.id").alias("secao"),
        F.col("classe.grupo.divisao.id").alias("divisao"),
        F.col("classe.grupo.id").alias("grupo"),
        F.col("classe.id").alias("classe"),
        F.col("id").alias("subclasse"),
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature; a directory of result pages is one scan."""
    pages = spark.read.schema(FEATURE_JSON).option("multiLine", "true").json(path)
    return pages.select(F.explode("features").alias("f")).select(
        F.col("f.attributes.objectid").alias("objectid"),
        F.col("f.attributes.nome").alias("nome"),
        F.col("f.geometry.rings").alias("rings"),
    )


def to_territories(features: DataFrame) -> DataFrame:
    """Neighbourhoods with an id from the slug of the name; nameless features are dropped."""
    named = features.withColumn("nome", strip("nome")).filter(F.col("nome") != "")
    return named.select(
        F.concat(F.lit(f"{CITY_ID}-{NEIGHBOURHOOD}-"), slug("nome")).alias("territorio_id"),
        F.lit(NEIGHBOURHOOD).alias("nivel"),
        "nome",
        F.array().cast("array<string>").alias("nome_alternativo"),
        to_multipolygon(F.col("rings")).alias("geometria"),
        F.lit(None).cast("string").alias("territorio_pai_id"),
        F.lit(CITY_ID).alias("cidade_id"),
    )


def read_territories(spark: SparkSession, path: str) -> DataFrame:
    return to_territories(read_features(spark, path))
