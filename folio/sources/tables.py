"""Reading pages and dimensions; the in-code dimensions with their priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import BLANKS
from folio.sources import schemas


def pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.PAGES) -> DataFrame:
    """Pages with trimmed text, the usable flag and their provenance. The schema is given, so nothing is inferred."""
    from folio.operators.classify import usable

    rows = spark.read.schema(schema).format(fmt).load(path)
    text = F.trim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    return rows.select("proc_id", "page_no", text.alias("text"), F.coalesce("source", F.lit("text")).alias("source"), usable(text).alias("usable"))


def last_wins(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """A dimension: null keys become 0, empty values go, the last row of each key stays."""
    known = rows.withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in keys}).filter(F.trim(F.coalesce(value, F.lit(""))) != "")
    return known.groupBy(*keys).agg(F.max_by(F.trim(F.col(value)), order).alias(value))


def expense_codes(spark: SparkSession, path: str, modality: int = 90) -> DataFrame:
    """(element, sub, name) of one modality from CSV."""
    rows = spark.read.schema(schemas.EXPENSE_CODES).option("header", True).csv(path)
    return last_wins(rows.filter(F.col("modality") == modality), ["element", "sub"], "name", "row_no")


def elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ELEMENTS).option("header", True).csv(path).filter(F.trim("name") != "")


def aliases(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(priority, alias, acronym): the order of the pairs is their priority."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "priority int, alias string, acronym string")


#: Units and their acronyms, in order of priority (fixed values).
UNIT_ALIASES = (
    ("9º GPT LOG", "9º GPT LOG"), ("9 GPT LOG", "9º GPT LOG"), ("CMDO 9º GPT LOG", "9º GPT LOG"), ("CMDO 9 GPT LOG", "9º GPT LOG"), ("COMANDO DO 9º GPT LOG", "9º GPT LOG"), ("9º GRUPO DE LOGÍSTICA", "9º GPT LOG"),
    ("9º B SUP", "9º B SUP"), ("9 B SUP", "9º B SUP"), ("9º BATALHÃO DE SUPRIMENTO", "9º B SUP"), ("H MIL A CG", "H MIL A CG"), ("HOSPITAL MILITAR", "H MIL A CG"), ("CRO/9", "CRO/9"), ("CRO 9", "CRO/9"),
    ("18º B TRNP", "18º B TRNP"), ("18 B TRNP", "18º B TRNP"), ("CIA CMDO", "CIA CMDO"), ("CIA CMDO/9º GPT LOG", "CIA CMDO/9º GPT LOG"), ("9º B MNT", "9º B MNT"), ("9 B MNT", "9º B MNT"), ("CMCG", "CMCG"),
)
#: Issuing bodies and their acronyms, in order of priority (fixed values).
ISSUER_ALIASES = (
    ("COMANDO DE OPERAÇÕES TERRESTRES", "COTER"), ("COTER", "COTER"), ("DIRETORIA DE GESTÃO DE PESSOAL", "DGP"), ("DIRETORIA DE GESTAO DE PESSOAL", "DGP"), ("DGP", "DGP"), ("COMANDO DE ENGENHARIA E CONSTRUÇÕES", "COE"), ("COE", "COE"),
    ("DIRETORIA DE GESTÃO ORÇAMENTÁRIA", "DGO"), ("DIRETORIA DE GESTAO ORCAMENTARIA", "DGO"), ("DGO", "DGO"), ("DEPARTAMENTO DE ENGENHARIA E CONSTRUÇÃO", "DEC"), ("DEPARTAMENTO DE ENGENHARIA E CONSTRUCAO", "DEC"),
    ("DEPARTAMENTO DE ENGENHARIA E CONSTRUÇÃO-G", "DEC"), ("DEPARTAMENTO DE ENGENHARIA E CONSTRUCAO-G", "DEC"), ("DEC", "DEC"), ("CENTRO DE OBTENÇÕES DO EXÉRCITO", "CObtEx"), ("CENTRO DE OBTENCOES DO EXERCITO", "CObtEx"), ("COBTEX", "CObtEx"),
    ("COMANDO MILITAR DO OESTE", "CMO"), ("CMO", "CMO"), ("9º GRUPAMENTO LOGÍSTICO", "9º GPT LOG"), ("9 GRUPAMENTO LOGISTICO", "9º GPT LOG"), ("9º GPT LOG", "9º GPT LOG"), ("DIRETORIA DE SAÚDE", "D SAÚ"), ("D SAÚ", "D SAÚ"),
    ("DIRETORIA DE FORMAÇÃO E APERFEIÇOAMENTO", "DFA"), ("DFA", "DFA"), ("ESTADO-MAIOR DO EXÉRCITO", "EME"), ("EME", "EME"), ("DEPARTAMENTO-GERAL DO PESSOAL", "DGP"),
)
#: Unit names and their purchasing codes, in order of priority (fixed values).
UNIT_NAME_CODES = (("9º GPT LOG", "160136"), ("9 GPT LOG", "160136"), ("CRO/9", "160141"), ("CRO 9", "160141"), ("9º B SUP", "160142"), ("9 B SUP", "160142"), ("H MIL A CG", "160143"), ("CMCG", "160078"), ("18º B TRNP", "160512"), ("18 B TRNP", "160512"), ("9º B MNT", "160142"))
#: Favoured units that are purchasing units themselves (fixed values).
UNIT_CODES = ("160136", "160141", "160142", "160143", "160078", "160512", "160502", "160504")
#: Official names of the purchasing units (fixed values).
KNOWN_UNITS = {"160136": "9º Grupamento Logístico", "160141": "CRO/9", "160142": "9º Batalhão de Suprimento", "160143": "Hospital Militar de Área de Campo Grande", "160078": "Colégio Militar de Campo Grande", "160255": "1º Batalhão de Polícia do Exército", "160512": "20º Regimento de Cavalaria Blindado", "160502": "Departamento de Engenharia e Construção", "160504": "Comando Militar do Oeste"}
#: Written forms of the units and their official names (fixed values).
OFFICIAL_UNITS = (
    ("9 GRUPAMENTO LOGISTICO", "9º Grupamento Logístico"),
    ("9º GRUPAMENTO LOGISTICO", "9º Grupamento Logístico"),
    ("9 GRUPAMENTO LOGÍSTICO", "9º Grupamento Logístico"),
    ("9º GRUPAMENTO LOGÍSTICO", "9º Grupamento Logístico"),
    ("9 GPT LOG", "9º Grupamento Logístico"),
    ("9º GPT LOG", "9º Grupamento Logístico"),
    ("9 GPT LOGISTICO", "9º Grupamento Logístico"),
    ("9º GPT LOGISTICO", "9º Grupamento Logístico"),
    ("9 GPT LOGÍSTICO", "9º Grupamento Logístico"),
    ("9º GPT LOGÍSTICO", "9º Grupamento Logístico"),
    ("9 GRUP LOG", "9º Grupamento Logístico"),
    ("9º GRUP LOG", "9º Grupamento Logístico"),
    ("CMDO 9 GPT LOG", "9º Grupamento Logístico"),
    ("CMDO 9º GPT LOG", "9º Grupamento Logístico"),
    ("9 BATALHAO DE MANUTENCAO", "9º Batalhão de Manutenção"),
    ("9º BATALHAO DE MANUTENCAO", "9º Batalhão de Manutenção"),
    ("9 BATALHÃO DE MANUTENÇÃO", "9º Batalhão de Manutenção"),
    ("9º BATALHÃO DE MANUTENÇÃO", "9º Batalhão de Manutenção"),
    ("9 B MNT", "9º Batalhão de Manutenção"),
    ("9º B MNT", "9º Batalhão de Manutenção"),
    ("9 BATALHAO MANUTENCAO", "9º Batalhão de Manutenção"),
    ("9º BATALHAO MANUTENCAO", "9º Batalhão de Manutenção"),
    ("9 BATALHAO DE SAUDE", "9º Batalhão de Saúde"),
    ("9º BATALHAO DE SAUDE", "9º Batalhão de Saúde"),
    ("9 BATALHÃO DE SAÚDE", "9º Batalhão de Saúde"),
    ("9º BATALHÃO DE SAÚDE", "9º Batalhão de Saúde"),
    ("9 B SAU", "9º Batalhão de Saúde"),
    ("9º B SAU", "9º Batalhão de Saúde"),
    ("9 B SAUDE", "9º Batalhão de Saúde"),
    ("9º B SAUDE", "9º Batalhão de Saúde"),
    ("9 BATALHAO SAUDE", "9º Batalhão de Saúde"),
    ("9º BATALHAO SAUDE", "9º Batalhão de Saúde"),
    ("9 BATALHAO DE SUPRIMENTO", "9º Batalhão de Suprimento"),
    ("9º BATALHAO DE SUPRIMENTO", "9º Batalhão de Suprimento"),
    ("9 BATALHÃO DE SUPRIMENTO", "9º Batalhão de Suprimento"),
    ("9º BATALHÃO DE SUPRIMENTO", "9º Batalhão de Suprimento"),
    ("9 B SUP", "9º Batalhão de Suprimento"),
    ("9º B SUP", "9º Batalhão de Suprimento"),
    ("9 B SUPRIMENTO", "9º Batalhão de Suprimento"),
    ("9º B SUPRIMENTO", "9º Batalhão de Suprimento"),
    ("9 BATALHAO SUPRIMENTO", "9º Batalhão de Suprimento"),
    ("9º BATALHAO SUPRIMENTO", "9º Batalhão de Suprimento"),
    ("18 BATALHAO DE TRANSPORTE", "18º Batalhão de Transporte"),
    ("18º BATALHAO DE TRANSPORTE", "18º Batalhão de Transporte"),
    ("18 BATALHÃO DE TRANSPORTE", "18º Batalhão de Transporte"),
    ("18º BATALHÃO DE TRANSPORTE", "18º Batalhão de Transporte"),
    ("18 B TRNP", "18º Batalhão de Transporte"),
    ("18º B TRNP", "18º Batalhão de Transporte"),
    ("18 B TRANSPORTE", "18º Batalhão de Transporte"),
    ("18º B TRANSPORTE", "18º Batalhão de Transporte"),
    ("18 BATALHAO TRANSPORTE", "18º Batalhão de Transporte"),
    ("18º BATALHAO TRANSPORTE", "18º Batalhão de Transporte"),
)


def official_units(spark: SparkSession) -> DataFrame:
    """(alias, official)."""
    return spark.createDataFrame(list(OFFICIAL_UNITS), "alias string, official string")


def safe_array(text: Column, kind: str = "array<string>") -> Column:
    """A JSON array; bad or empty text is an empty array."""
    return F.coalesce(F.from_json(text, kind, {"mode": "PERMISSIVE"}), F.array().cast(kind))
