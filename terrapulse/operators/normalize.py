"""Raw permit lines to entities and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import BUSINESS, PERMIT_SOURCE
from terrapulse.functions.ids import key_id
from terrapulse.functions.text import clean, iso_date, slug

# Attribute -> raw column, for the texts that are only cleaned.
_TEXTS = {
    "nome_empresarial": "NOME_EMPRESARIAL",
    "nome_fantasia": "NOME_FANTASIA",
    "endereco": "ENDERECO",
    "numero": "NUMERO",
    "unidade": "UNIDADE",
    "andar": "ANDAR",
    "complemento": "COMPLEMENTO",
    "cep": "CEP",
    "cnae_principal": "CNAE_ATIVIDADE_PRINCIPAL",
    "atividade_principal": "ATIVIDADE_PRINCIPAL",
}
_DATES = {
    "inicio_atividade": "INICIO_ATIVIDADE",
    "data_emissao": "DATA_EMISSAO",
    "data_expiracao": "DATA_EXPIRACAO",
}


def cleaned(df: DataFrame, *columns: str) -> DataFrame:
    """Missing-marker cleaning of the given text columns (all of them by default)."""
    chosen = columns or tuple(n for n, t in df.dtypes if t == "string")
    return df.withColumns({c: clean(c) for c in chosen})


def territory_slugs(territories: DataFrame) -> DataFrame:
    """Slug of the name -> territory id, one row per slug."""
    return territories.groupBy(slug("nome").alias("slug")).agg(
        F.max("territorio_id").alias("territorio_id")
    )


def resolve_territory(lines: DataFrame, slugs: DataFrame, name: str = "bairro") -> DataFrame:
    """Adds `territorio_id` by the slug of a name; lines without a match keep a null."""
    looked_up = slugs.select(F.col("slug").alias("_slug"), "territorio_id")
    return lines.withColumn("_slug", slug(name)).join(looked_up, "_slug", "left").drop("_slug")


def attributes(territory: Column) -> Column:
    """The 16-attribute record of a permit line whose number and district are already cleaned."""
    values = {a: clean(c) for a, c in _TEXTS.items()}
    values |= {a: iso_date(c) for a, c in _DATES.items()}
    values |= {
        "numero_do_alvara": F.col("numero_do_alvara"),
        "bairro": F.col("bairro"),
        "territorio_id": territory,
    }
    order = (
        "nome_empresarial", "nome_fantasia", "numero_do_alvara", "inicio_atividade",
        "data_emissao", "data_expiracao", "endereco", "numero", "unidade", "andar",
        "complemento", "bairro", "territorio_id", "cep", "cnae_principal", "atividade_principal",
    )
    return F.struct(*[values[a].alias(a) for a in order])


def with_number(lines: DataFrame) -> DataFrame:
    """The raw lines that have a permit number."""
    return lines.filter(clean("NUMERO_DO_ALVARA").isNotNull())


def without_number(lines: DataFrame) -> DataFrame:
    """The raw lines that `normalize_permits` drops."""
    return lines.filter(clean("NUMERO_DO_ALVARA").isNull())


def normalize_permits(
    lines: DataFrame, slugs: DataFrame | None = None, source: str = PERMIT_SOURCE
) -> DataFrame:
    """Observations with their business key; lines without a permit number are dropped.

    `lines` are raw lines with `snapshot_ref`, `observado_em` and `position`.
    Without `slugs` no territory is resolved.
    """
    kept = with_number(lines).withColumns(
        {"numero_do_alvara": clean("NUMERO_DO_ALVARA"), "bairro": clean("BAIRRO")}
    )
    if slugs is None:
        kept = kept.withColumn("territorio_id", F.lit(None).cast("string"))
    else:
        kept = resolve_territory(kept, slugs)
    entity = key_id(F.lit(BUSINESS), "numero_do_alvara")
    return kept.select(
        key_id(entity, F.lit(source), "observado_em").alias("observacao_id"),
        entity.alias("entidade_id"),
        F.lit(BUSINESS).alias("tipo_entidade"),
        F.col("numero_do_alvara").alias("identificador_fonte"),
        "observado_em",
        attributes(F.col("territorio_id")).alias("atributos"),
        F.lit(source).alias("fonte_id"),
        "snapshot_ref",
        "position",
    )


def unmatched_names(observations: DataFrame) -> DataFrame:
    """District names without a territory, with their number of lines, in name order."""
    return (
        observations.filter(
            F.col("atributos.territorio_id").isNull() & F.col("atributos.bairro").isNotNull()
        )
        .groupBy(F.col("atributos.bairro").alias("bairro"))
        .agg(F.count(F.lit(1)).alias("linhas"))
        .orderBy("bairro")
    )


def distinct_names(observations: DataFrame) -> DataFrame:
    """Distinct district names of a load."""
    return (
        observations.select(F.col("atributos.bairro").alias("bairro"))
        .filter(F.col("bairro").isNotNull())
        .distinct()
    )


def entities_of(observations: DataFrame) -> DataFrame:
    """One entity per business key of a load."""
    return observations.select("entidade_id", "tipo_entidade", "identificador_fonte").dropDuplicates(
        ["tipo_entidade", "identificador_fonte"]
    )


def with_stored_ids(observations: DataFrame, entities: DataFrame) -> DataFrame:
    """Replaces the entity ids of a load by the stored ids of the same business keys; unknown keys keep theirs.

    Only needed for stores that hold ids from elsewhere; ours follow from the key.
    """
    keys = ["tipo_entidade", "identificador_fonte"]
    stored = entities.select(*keys, F.col("entidade_id").alias("_stored"))
    return observations.join(stored, keys, "left").withColumn("entidade_id", F.coalesce("_stored", "entidade_id")).drop("_stored")


def first_lines(
    observations: DataFrame, keys: tuple[str, ...] = ("entidade_id", "fonte_id", "observado_em")
) -> DataFrame:
    """One observation per key: the first line in file order wins.

    A grouped minimum combines on the map side, so many copies of one key stay cheap.
    """
    rest = [c for c in observations.columns if c not in keys and c != "position"]
    first = F.min_by(F.struct(*rest), F.col("position")).alias("_first")
    return observations.groupBy(*keys).agg(first).select(*keys, "_first.*").select(
        *[c for c in observations.columns if c != "position"]
    )
