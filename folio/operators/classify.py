"""Page labelling: usable text, indicator counts, exclusive and multiple labels, running gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import BLANKS, any_of, hits, matches

USABLE_CHARS, SCANNED_CHARS = 30, 50
#: The footer that digital dossiers print on every page (fixed value).
FOOTER = r"(?is)\A\s*Este documento é peça do processo\s+[0-9][0-9./-]*\s*Pág\s+[0-9]+\s+de\s+[0-9]+\s*\z"

#: Indicators of the page kinds, matched on the text in capitals (fixed values).
COVER = ("PROCESSO NUP", "PROTOCOLO GERAL", "PEÇAS PROCESSUAIS")
OPENING = ("TERMO DE ABERTURA", "AUTUO O PRESENTE PROCESSO")
BID_NOTICE = ("EDITAL", "TERMO DE REFER[ÊE]NCIA", "PREG[ÃA]O ELETR[ÔO]NICO N[ºO°]", "ESTUDO TÉCNICO PRELIMINAR", "ATA DE REGISTRO DE PREÇOS", "PREGOEIRO", "EQUIPE DE APOIO", "HABILITAÇÃO", "IMPUGNAÇÃO")
REQUISITION = (r"REQ\s*(?:N[ºO°]\s*)?\d", "ORDENADOR DE DESPESAS", "TIPO DE EMPENHO", r"(?s)\A(?=.*AO SR)(?=.*ORDENADOR)", r"(?s)\A(?=.*MATERIAL)(?=.*ADQUIRIDO)", r"(?s)\A(?=.*P\.\s?UNT)(?=.*TOTAL)", r"(?s)\A(?=.*FISC ADM)(?=.*REQUISI)")
CONTINUATION = (r"\b[134]\d{4,5}\b", r"\b\d{2}\.\d{2}\.\d{2}\.\d{2}\b", "TOTAL")
CREDIT_NOTE = ("NOTA DE CR[ÉE]DITO", "UG EMITENTE", "SISTEMA ORIGEM SIAFI", "DEMONSTRA-DIARIO", "DEMONSTRA-CONRAZAO", r"20\d{2}NC\d{6}")
CONTRACT_CLAUSES = ("CLÁUSULA PRIMEIRA", "CLÁUSULA SEGUNDA", "VIGÊNCIA", "OBJETO", "CONTRATANTE", "CONTRATADA")
ANTI_ANCHORS = ("EDITAL", r"TERMO\s+DE\s+REFER[ÊE]NCIA", r"ATA\s+DE\s+REGISTRO\s+DE\s+PRE[ÇC]OS", r"PREG[ÃA]O\s+ELETR[ÔO]NICO\s+N[°º]", "PREGOEIRO", r"EQUIPE\s+DE\s+APOIO")


def usable(text: Column, least: int = USABLE_CHARS, footer: str = FOOTER) -> Column:
    """Enough text, and not the footer alone."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return (F.length(t) > least) & ~F.regexp_like(t, F.lit(footer))


def scanned(text: Column, most: int = SCANNED_CHARS) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))) < most


def at_least(text: Column, patterns: Sequence[str], k: int, flags: str = "(?dU)") -> Column:
    """At least ``k`` of the patterns match."""
    return hits(text, patterns, flags) >= k


def exclusive_label(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that holds gives the label; null if none does."""
    out = F.when(rules[0][1], rules[0][0])
    for name, condition in rules[1:]:
        out = out.when(condition, name)
    return out


def multi_label(rules: Sequence[tuple[str, Column]]) -> Column:
    """All rules that hold, in order, as an array."""
    return F.array_compact(F.array(*(F.when(condition, name) for name, condition in rules)))


def label_rules(up: Column) -> dict[str, Column]:
    """Conditions of the page kinds on the text in capitals."""
    has = lambda p: matches(up, p, "(?dU)")
    continuation = ~has("EDITAL|TERMO DE REFER[ÊE]NCIA") & has(r"R\$") & any_of(up, CONTINUATION, "(?dU)")
    return {
        "cover": any_of(up, COVER, "(?dU)") | (has("CHECK LIST") & has("PEÇAS")),
        "opening": any_of(up, OPENING, "(?dU)"),
        "dispatch": has(r"DESPACHO\s*N[ºO°]"),
        "approves": has("APROVO"),
        "forwards": has("ENCAMINHO"),
        "checklist": has("CHECK LIST") & has("CONTRATO"),
        "bid_notice": at_least(up, BID_NOTICE, 2),
        "requisition": at_least(up, REQUISITION, 2) | continuation,
        "continuation": continuation,
        "credit_note": any_of(up, CREDIT_NOTE, "(?dU)"),
        "sicaf": has("DADOS DO FORNECEDOR") & has("SITUAÇÃO DO FORNECEDOR|CADASTRAMENTO UNIFICADO DE FORNECEDORES"),
        "cadin": has("CADIN") & has("CRÉDITOS NÃO QUITADOS|CREDITOS NAO QUITADOS|CONSULTA CONTRATANTE"),
        "consolidated": has("CONSULTA CONSOLIDADA DE PESSOA") & has("RESULTADO"),
        "contract": has("TERMO DE CONTRATO") | (has("CONTRATANTE") & has("CONTRATADA")) | at_least(up, CONTRACT_CLAUSES, 2),
    }


def page_labels(up: Column) -> Column:
    """All labels of a page, from its text in capitals.

    Cover, opening, deciding dispatch and bid notice are exclusive, in this order; a checklist is not, but keeps its page
    from being a bid notice or requisition. The other kinds may meet on one page; a dispatch without decision and
    ``unclassified`` are what is left."""
    r = label_rules(up)
    exclusive = exclusive_label([("cover", r["cover"]), ("opening", r["opening"]), ("dispatch_approval", r["dispatch"] & r["approves"]), ("dispatch_forwarding", r["dispatch"] & r["forwards"]), ("bid_notice", r["bid_notice"] & ~r["checklist"])])
    requisition = r["requisition"] & ~r["checklist"]
    several = multi_label([("checklist", r["checklist"]), ("requisition", requisition), ("credit_note", r["credit_note"] & ~r["requisition"]), ("sicaf", r["sicaf"]), ("cadin", r["cadin"]), ("consolidated", r["consolidated"]), ("contract", r["contract"])])
    rest = F.when(r["dispatch"], "dispatch").otherwise("unclassified")
    return F.when(exclusive.isNotNull(), F.array(F.when(exclusive.startswith("dispatch"), F.lit("dispatch")).otherwise(exclusive))).when(F.size(several) > 0, several).otherwise(F.array(rest))


def classify_pages(pages: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(proc_id, page_no, label) and the columns to carry, a row for each label of a page; no shuffle."""
    up = F.upper(F.coalesce("text", F.lit("")))
    return pages.withColumn("_up", up).select("proc_id", "page_no", *carry, F.explode(page_labels(F.col("_up"))).alias("label"))


def label_counts(labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pages per label, a column each."""
    return labels.groupBy("proc_id").agg(*(F.count_if(F.col("label") == n).alias(n) for n in names))


def running_gate(rows: DataFrame, key: str, order: Sequence[str], text: str, patterns: Sequence[str], limit: int = 2, flags: str = "(?dUi)") -> DataFrame:
    """``open`` stays true until ``limit`` of the patterns have been seen in the texts up to and including a row."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.max(matches(F.col(text), p, flags).cast("int")).over(so_far) for p in patterns]
    total = seen[0]
    for s in seen[1:]:
        total = total + s
    return rows.withColumn("anti", total).withColumn("open", F.col("anti") < limit)


def filled(columns: Sequence[Column]) -> Column:
    """How many of the columns hold a value."""
    out = F.lit(0)
    for c in columns:
        out = out + c.isNotNull().cast("int")
    return out


def real_item(description: Column, total: Column, code: Column, least: int = 5) -> Column:
    """False for a phantom row: short description, no total, no code."""
    phantom = (F.length(F.trim(F.coalesce(description, F.lit("")))) < least) & (F.coalesce(total, F.lit(0)) == 0) & (F.trim(F.coalesce(code, F.lit(""))) == "")
    return ~phantom
