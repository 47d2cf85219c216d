"""Validity rules per table, orphans and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import CONFIDENCES, EVENT_TYPES, TERRITORY_LEVELS

Rules = dict[str, Column]


def _missing(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def _outside(name: str, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(~F.col(name).isin(*allowed), F.lit(True))


def entity_rules() -> Rules:
    return {
        "tipo_entidade": _missing("tipo_entidade"),
        "identificador_fonte": _missing("identificador_fonte"),
    }


def observation_rules() -> Rules:
    return {
        "atributos": F.col("atributos").isNull(),
        "fonte_id": _missing("fonte_id"),
        "snapshot_ref": _missing("snapshot_ref"),
    }


def event_rules() -> Rules:
    return {
        "entity_type": _missing("entity_type"),
        "event_type": _outside("event_type", EVENT_TYPES),
        "confianca": _outside("confianca", CONFIDENCES),
        "origem_observacoes": F.coalesce(F.array_size("origem_observacoes") == 0, F.lit(True)),
    }


def territory_rules() -> Rules:
    return {
        "territorio_id": _missing("territorio_id"),
        "nivel": _outside("nivel", TERRITORY_LEVELS),
        "nome": _missing("nome"),
        "geometria": F.coalesce(F.array_size("geometria") == 0, F.lit(False)),
    }


def location_rules() -> Rules:
    return {
        "confianca": _outside("confianca", CONFIDENCES),
        "fonte_primaria": _missing("fonte_primaria"),
    }


def code_rules() -> Rules:
    return {"codigo_cnae": _missing("codigo_cnae"), "descricao": _missing("descricao")}


def category_rules() -> Rules:
    return {"categoria_id": _missing("categoria_id"), "nome": _missing("nome")}


def checked(df: DataFrame, rules: Rules, out: str = "motivos") -> DataFrame:
    """Adds the names of the broken rules; an empty array marks a valid row."""
    broken = [F.when(condition, F.lit(name)) for name, condition in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*broken)))


def valid(df: DataFrame, rules: Rules) -> DataFrame:
    return checked(df, rules, "_broken").filter(F.array_size("_broken") == 0).drop("_broken")


def rejected(df: DataFrame, rules: Rules) -> DataFrame:
    return checked(df, rules).filter(F.array_size("motivos") > 0)


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Rows whose non-null reference has no parent row."""
    known = parent.select(F.col(parent_key or key).alias(key))
    return df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("linhas")).filter(F.col("linhas") > 1)


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """Number of rows found by each named check."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("linhas")).select(F.lit(name).alias("regra"), "linhas")
        for name, df in checks.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
