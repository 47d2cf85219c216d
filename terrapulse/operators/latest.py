"""Latest observation per entity, from the whole history or from its maintained state.

The state has one row for each source and entity: its newest observation, and the
start fields of the newest one that has a start date. Merging keeps the greater of
stored and new, so loads may come late, twice or in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import PERMIT_SOURCE


def latest_observations(
    observations: DataFrame,
    fields: dict[str, str],
    *,
    source: str = PERMIT_SOURCE,
    with_start_date: bool = False,
) -> DataFrame:
    """The chosen fields (name -> path) of each entity's newest observation.

    `with_start_date` looks only at observations that have a start date, before
    picking the newest. A grouped maximum: only the chosen fields are shuffled,
    after a map-side combine. Given the state, it reads a row for each entity and
    groups nothing.
    """
    if "inicio" in observations.columns:
        return _from_state(observations, fields, source, with_start_date)
    rows = observations.filter(F.col("fonte_id") == source)
    if with_start_date:
        rows = rows.filter(F.col("atributos.inicio_atividade").isNotNull())
    value = F.struct(*[F.col(path).alias(name) for name, path in fields.items()])
    newest = F.max_by(value, F.struct("observado_em", "observacao_id")).alias("_newest")
    return rows.groupBy("entidade_id").agg(newest).select("entidade_id", "_newest.*")


def _from_state(state: DataFrame, fields: dict[str, str], source: str, with_start_date: bool) -> DataFrame:
    rows = state.filter(F.col("fonte_id") == source)
    if with_start_date:
        rows = rows.filter(F.col("inicio").isNotNull())
        fields = {name: path.replace("atributos.", "inicio.") for name, path in fields.items()}
    return rows.select("entidade_id", *[F.col(path).alias(name) for name, path in fields.items()])


def state_of(observations: DataFrame) -> DataFrame:
    """The state after the given observations alone."""
    started = F.col("atributos.inicio_atividade").isNotNull()
    order = F.struct("observado_em", "observacao_id")
    start = F.struct("observado_em", "observacao_id", *[F.col(path).alias(name) for name, path in START_FIELDS.items()])
    newest = F.max_by(F.struct("observado_em", "observacao_id", "atributos"), order)
    return (
        observations.groupBy("fonte_id", "entidade_id")
        .agg(newest.alias("_n"), F.max_by(F.when(started, start), F.when(started, order)).alias("inicio"))
        .select("entidade_id", "fonte_id", "_n.observado_em", "_n.observacao_id", "_n.atributos", "inicio")
    )


def state_after(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The state after a load: of the stored and the new row of an entity the newer one, field by field."""
    keys = ["entidade_id", "fonte_id"]

    def newest(name: str) -> Column:
        at = F.struct(f"{name}.observado_em", f"{name}.observacao_id")
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), at))

    rows = [df.select(*keys, F.struct("observado_em", "observacao_id", "atributos").alias("_n"), "inicio") for df in (stored, new)]
    merged = rows[0].unionByName(rows[1]).groupBy(*keys).agg(newest("_n").alias("_n"), newest("inicio").alias("inicio"))
    return merged.select(*keys, "_n.observado_em", "_n.observacao_id", "_n.atributos", "inicio")


ADDRESS_FIELDS = {
    "logradouro": "atributos.endereco",
    "numero": "atributos.numero",
    "cep": "atributos.cep",
    "bairro": "atributos.bairro",
}
DISPLAY_FIELDS = {
    "nome_fantasia": "atributos.nome_fantasia",
    "nome_empresarial": "atributos.nome_empresarial",
    "endereco": "atributos.endereco",
    "numero": "atributos.numero",
    "bairro": "atributos.bairro",
    "cnae_principal": "atributos.cnae_principal",
    "territorio_id": "atributos.territorio_id",
}
START_FIELDS = {
    "territorio_id": "atributos.territorio_id",
    "inicio_atividade": "atributos.inicio_atividade",
    "cnae_principal": "atributos.cnae_principal",
}
