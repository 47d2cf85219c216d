"""Schemas of the stored tables and of the raw permit file, as DDL."""

from __future__ import annotations

# Header of the permit file, in file order.
PERMIT_COLUMNS = (
    "NOME_EMPRESARIAL",
    "INICIO_ATIVIDADE",
    "NUMERO_DO_ALVARA",
    "NOME_FANTASIA",
    "DATA_EMISSAO",
    "DATA_EXPIRACAO",
    "ENDERECO",
    "NUMERO",
    "UNIDADE",
    "ANDAR",
    "COMPLEMENTO",
    "BAIRRO",
    "CEP",
    "CNAE_ATIVIDADE_PRINCIPAL",
    "ATIVIDADE_PRINCIPAL",
)

# The 16 attributes kept with an observation.
ATTRIBUTES = (
    "nome_empresarial",
    "nome_fantasia",
    "numero_do_alvara",
    "inicio_atividade",
    "data_emissao",
    "data_expiracao",
    "endereco",
    "numero",
    "unidade",
    "andar",
    "complemento",
    "bairro",
    "territorio_id",
    "cep",
    "cnae_principal",
    "atividade_principal",
)


def strings(*names: str) -> str:
    return ", ".join(f"{n} string" for n in names)


POLYGONS = "array<array<array<array<double>>>>"
ATTRIBUTES_TYPE = "struct<" + ", ".join(f"{a}: string" for a in ATTRIBUTES) + ">"

ENTITY = (
    "entidade_id string, tipo_entidade string, identificador_fonte string, "
    "criado_em timestamp, atualizado_em timestamp"
)
OBSERVATION = (
    f"observacao_id string, entidade_id string, observado_em date, atributos {ATTRIBUTES_TYPE}, "
    "fonte_id string, snapshot_ref string, criado_em timestamp"
)
LATEST = (
    f"entidade_id string, fonte_id string, observado_em date, observacao_id string, atributos {ATTRIBUTES_TYPE}, "
    "inicio struct<observado_em: date, observacao_id: string, territorio_id: string, inicio_atividade: string, cnae_principal: string>"
)
EVENT = (
    "evento_id string, entity_type string, event_type string, entidade_id string, "
    "territorio_id string, data_evento date, data_ingestao timestamp, confianca string, "
    "origem_observacoes array<string>, payload map<string,string>"
)
TERRITORY = (
    "territorio_id string, nivel string, nome string, nome_alternativo array<string>, "
    f"geometria {POLYGONS}, territorio_pai_id string, cidade_id string"
)
CODE = strings("codigo_cnae", "descricao", "secao", "divisao", "grupo", "classe", "subclasse")
CATEGORY = strings("categoria_id", "nome")
CODE_CATEGORY = strings("codigo_cnae", "categoria_id")
GEOLOCATION = (
    "entidade_id string, lat double, lon double, confianca string, fonte_primaria string, "
    "fonte_secundaria string, precisao_geocodebr string, distancia_desempate_m double, "
    "geocodificado_em timestamp, revisado_em timestamp"
)
EVENT_COUNT = (
    "territorio_id string, categoria_id string, mes date, event_type string, contagem bigint, "
    "calculado_em timestamp"
)
OPENING_COUNT = (
    "territorio_id string, categoria_id string, mes date, contagem bigint, calculado_em timestamp"
)
OPENING_COUNT_BY_CODE = "territorio_id string, mes date, cnae_principal string, contagem bigint, versao int"
RUN = (
    "run_id string, conector_id string, iniciado_em timestamp, finalizado_em timestamp, "
    "status string, registros_lidos bigint, registros_gravados bigint, registros_com_falha bigint"
)
