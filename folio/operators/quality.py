"""Expected against actual values, required pieces, specification checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions.text import contains_count
from folio.operators.reconcile import dimension


def failures(expected: DataFrame, actual: DataFrame, key: str, checks: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """(key, check, severity, note) for every check that fails: (name, severity, condition of failure, note)."""
    rows = expected.join(actual, key, "left")
    made = [F.when(bad, F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), note.alias("note"))) for n, s, bad, note in checks]
    return rows.select(key, F.explode(F.array_compact(F.array(*made))).alias("f")).select(key, "f.*")


def report(failed: DataFrame) -> DataFrame:
    return failed.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))


def missing_labels(dossiers: DataFrame, labels: DataFrame, required: DataFrame, key: str = "proc_id", kind: str = "type") -> DataFrame:
    """Required labels (per dossier type) that a dossier has no page of. ``required(type, label)`` is a dimension."""
    wanted = dossiers.select(key, kind).join(dimension(required), kind).select(key, "label")
    return wanted.join(labels.select(key, "label").distinct().hint("shuffle_merge"), [key, "label"], "left_anti")


def fewer_than(rows: DataFrame, key: str, least: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least)


def rejected_then_corrected(rows: DataFrame, key: str, order: str, rejects: Column, corrects: Column) -> DataFrame:
    """Per key whether a rejection occurs, and whether a correction follows the first one."""
    r = rows.groupBy(key).agg(F.min(F.when(rejects, F.col(order))).alias("rejected_at"), F.max(F.when(corrects, F.col(order))).alias("corrected_at"))
    return r.select(key, F.col("rejected_at").isNotNull().alias("rejected"), F.coalesce(F.col("corrected_at") > F.col("rejected_at"), F.lit(False)).alias("corrected"))


def number_findings(dispatches: DataFrame, dossiers: DataFrame, key: str = "proc_id", number: str = "nup") -> DataFrame:
    """A caveat for each dispatch that names another dossier's number; dispatches that name none are passed over."""
    side = dossiers.select(key, F.col(number).alias("_own")).hint("shuffle_merge")
    rows = dispatches.join(side, key).filter(F.col(number) != F.col("_own"))
    text = F.concat(F.lit("NUP do despacho "), number, F.lit(" difere do processo "), "_own")
    return rows.select(key, F.lit("dispatch").alias("family"), F.lit("NUP do despacho").alias("check"), text.alias("description"), F.lit("ressalva").alias("severity"))


def declared_status(total: Column, declared: Column, tolerance: float = 0.02) -> Column:
    """Whether items add up to the declared total; null where either is unknown."""
    return F.when(F.abs(total - declared) > F.lit(tolerance).cast("decimal(4,2)"), "ressalva").when((total - declared).isNotNull(), "conforme")


def registered_items(items: DataFrame, registered: DataFrame, keys: Sequence[str], price: str = "unit_price", qty: str = "qty", tolerance: float = 0.02) -> DataFrame:
    """Items against those registered for their bid: ``status`` is absent, price, quantity or ok, in this order; the registered price and
    quantity are ``registered_price`` and ``registered_qty``."""
    side = registered.select(*keys, F.col(price).alias("registered_price"), F.col(qty).alias("registered_qty"), F.lit(True).alias("_there")).hint("shuffle_merge")
    rows = items.join(side, list(keys), "left")
    apart = F.abs(F.col(price) - F.col("registered_price")) > F.lit(tolerance).cast("decimal(4,2)")
    status = F.when(F.col("_there").isNull(), "absent").when(apart, "price").when(F.col(qty) > F.col("registered_qty"), "quantity").otherwise("ok")
    return rows.withColumn("status", status).drop("_there")


#: Documents that every dossier needs, and those that its type adds: (type, label, shown) (fixed values).
REQUIRED = (
    *((kind, label, shown) for kind in ("Licitação", "Contrato", "") for label, shown in (("cover", "Capa"), ("opening", "Termo de Abertura"), ("requisition", "Requisição"), ("sicaf", "SICAF"), ("cadin", "CADIN"), ("consolidated", "Consulta Consolidada"))),
    ("Licitação", "bid_notice", "Edital/página do pregão"), ("Contrato", "contract", "Contrato"),
)
#: Words of a rejection and of a correction in dispatches (fixed values).
REJECTS = ("reprovo", "reprovação", "reprovada", "divergência", "impedimento", "vencida", "incorreta", "restituir")
CORRECTS = ("aprovo", "aprovação", "corrigida", "sanada", "retificada", "deve avançar")
DISPATCHES = 3


def specification_findings(dossiers: DataFrame, labels: DataFrame, dispatches: DataFrame, sums: DataFrame, spark: SparkSession, registered: DataFrame | None = None, items: DataFrame | None = None, key: str = "proc_id") -> DataFrame:
    """What the specification asks of a dossier beyond its documents' contents: required documents, three dispatches, a rejection that was
    corrected, the declared sum and, with ``registered(bid, code, unit_price, qty)``, prices and quantities of the bid.

    ``dossiers(key, type, bid)``, ``dispatches(key, page_no, text)``, ``sums(key, total, declared)``; each finding is a caveat, and so none
    where all is well."""
    made = lambda rows, seq, check, text: rows.select(key, F.lit("specification").alias("family"), F.lit(seq).alias("seq"), F.lit(check).alias("check"), text.alias("description"), F.lit("ressalva").alias("severity"))
    required = spark.createDataFrame(REQUIRED, "type string, label string, shown string")
    typed = dossiers.select(key, F.when(F.col("type").isin("Licitação", "Contrato"), F.col("type")).otherwise("").alias("type"))
    missing = missing_labels(typed, labels, required).join(F.broadcast(required.select("label", "shown").distinct()), "label")  # a fixed list
    low = F.lower("text")
    says = lambda words: contains_count(low, words) > 0
    turned = rejected_then_corrected(dispatches, key, "page_no", says(REJECTS), says(CORRECTS)).filter("rejected")
    said = F.when(F.col("corrected"), "Despacho de reprovação com correção posterior — verificar").otherwise("Despacho de reprovação sem correção posterior")
    few = dossiers.select(key).join(dispatches.groupBy(key).agg(F.count(F.lit(1)).alias("n")).hint("shuffle_merge"), key, "left").filter(F.coalesce("n", F.lit(0)) < DISPATCHES)
    apart = sums.filter(declared_status(F.col("total"), F.col("declared")) == "ressalva")
    found = [
        made(missing, 0, "Peças obrigatórias", F.concat(F.lit("Peça obrigatória ausente: "), "shown")),
        made(few, 1, "Despachos obrigatórios", F.concat(F.lit("Despachos encontrados: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(f" de {DISPATCHES}"))),
        made(turned, 2, "Reprovação anterior", said),
        made(apart, 3, "Soma dos itens", F.concat(F.lit("Soma dos itens "), S.format_brl(F.col("total")), F.lit(" ≠ total declarado "), S.format_brl(F.col("declared")))),
    ]
    if registered is not None and items is not None:
        sold = items.join(dossiers.select(key, "bid").hint("shuffle_merge"), key).filter(F.col("bid").isNotNull() & F.col("code").isNotNull())
        bad = registered_items(sold, registered, ["bid", "code"]).filter(F.col("status") != "ok")
        why = F.element_at(F.create_map(*map(F.lit, ("absent", "não consta do pregão", "price", "preço difere do registrado", "quantity", "quantidade acima da registrada"))), F.col("status"))
        found.append(made(bad, 4, "Itens do pregão", F.concat(F.lit("Item "), F.coalesce(F.col("item_no").cast("string"), F.lit("?")), F.lit(": "), why)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
