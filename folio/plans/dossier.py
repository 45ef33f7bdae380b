"""From page texts to decisions and texts, for many dossiers at once.

Pages are labelled where they are read, without a shuffle, and written with their labels; their texts are shuffled once, when
the pages of one label are joined, and these joined texts are written, too. What follows reads these two tables and joins
tables of one row per dossier (or item, note, finding) on ``proc_id``. Those that several later ones read are written as well:
their patterns run once, the plans of what follows start from them, and a lost executor costs nothing. ``release``
deletes the folder.
"""

from __future__ import annotations

import datetime
import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions.text import find
from folio.operators import classify, fields, history, items, quality, reconcile, registry, render, rules, texts
from folio.sources import analyses, keyed, store, tables
from folio.streaming import incremental

KEY = "proc_id"


@dataclass
class Dossiers:
    """Every table of a run, below ``folder``; only ``dispatches``, ``pieces`` and ``rendered`` are worked out when they are read."""

    labels: DataFrame
    texts: DataFrame
    identification: DataFrame
    items: DataFrame
    notes: DataFrame
    sicaf: DataFrame
    cadin: DataFrame
    consolidated: DataFrame
    contracts: DataFrame
    dispatches: DataFrame
    pieces: DataFrame
    note_lines: DataFrame
    certificates: DataFrame
    findings: DataFrame
    decisions: DataFrame
    rendered: DataFrame
    folder: str

    def release(self) -> None:
        store.remove(self.labels.sparkSession, self.folder)


def _of(label_texts: DataFrame, label: str, columns) -> DataFrame:
    rows = label_texts.filter(F.col("label") == label)
    return rows.select(KEY, *(c.alias(n) for n, c in columns(F.col("text")).items()))


def _requisitions(label_texts: DataFrame) -> DataFrame:
    """The fields of a requisition; supplier and tax id also from the text around the first tax id, the instrument also by its context."""
    also = {"observation": fields.observation(F.col("text")), "_beside": fields.supplier_near_tax_id(F.col("text")), "named_instrument": fields.instrument(F.col("text"))["shown"]}
    out = fields.requisitions(label_texts.filter(F.col("label") == "requisition"), KEY, also=also)
    return out.withColumns({n: F.coalesce(n, F.col("_beside")[n]) for n in ("supplier", "tax_id")}).drop("_beside")


def run(spark: SparkSession, pages: DataFrame, page_rows: DataFrame, as_of: Column, ocr_texts: DataFrame | None = None, names: DataFrame | None = None, elements: DataFrame | None = None, with_contract: bool = False, with_notes: bool = True, with_specification: bool = False, registered: DataFrame | None = None, gated: bool = False) -> Dossiers:
    """The whole run. ``with_contract`` lets contract checks into the decision, ``with_specification`` those that the specification asks for
    beside (with ``registered`` also against the items of the bid); ``with_notes`` false leaves out the credit notes. ``gated`` passes over
    item tables behind pages of other kinds of text."""
    folder = store.scratch(spark)
    count = itertools.count()

    def _kept(df: DataFrame) -> DataFrame:
        return store.written(df, f"{folder}/{next(count)}")

    labelled = store.written(texts.with_grid_text(classify.classify_pages(pages, ("text", "source")), page_rows), f"{folder}/labelled")
    labels = labelled.select(KEY, "page_no", "label")
    label_texts = store.written(texts.joined_text(labelled, [KEY, "label"], "page_no"), f"{folder}/texts")
    everyone = _kept(labels.select(KEY).distinct())

    cover = _of(label_texts, "cover", fields.cover)
    pieces = fields.pieces(label_texts.filter(F.col("label") == "cover"), KEY, active=True)
    requisition = _kept(_requisitions(label_texts).drop("more_nc"))
    sicaf, cadin = _kept(_of(label_texts, "sicaf", fields.sicaf)), _kept(_of(label_texts, "cadin", fields.cadin))
    consolidated = _kept(_of(label_texts, "consolidated", fields.consolidated))
    contract_texts = label_texts.filter(F.col("label") == "contract")
    contract_columns = fields.contract_document(F.col("text"))
    contracts = _kept(contract_texts.filter(fields.real_contract(contract_columns)).select(KEY, *(c.alias(n) for n, c in contract_columns.items())))
    dispatches = labelled.filter(F.col("label") == "dispatch").select(KEY, "page_no", *(c.alias(n) for n, c in fields.dispatch(F.col("text")).items()))

    ident = reconcile.merge_identification(everyone.join(cover, KEY, "left"), requisition)
    named = requisition.select(KEY, "named_instrument")
    ident = ident.join(named, KEY, "left").withColumn("instrument", F.coalesce("instrument", "named_instrument")).drop("named_instrument")
    ident = ident.withColumn("number", F.coalesce("number", fields.requisition_number(F.col("subject"))["raw"]))
    ident = reconcile.complete_supplier(ident, sicaf)
    read = fields.supplier_by_page(labelled.filter((F.col("source") == "ocr") & (F.col("label") == "requisition")))
    ident = reconcile.complete_supplier(ident, read.withColumnRenamed("supplier", "name"))
    ident = _kept(ident.withColumn("unit_name", F.coalesce("unit_name", reconcile.unit_from_cover(F.col("origin"), F.col("interested")))))

    table_pages = labels.filter(F.col("label") == "requisition").select(KEY, "page_no")
    if gated:
        gate = classify.running_gate(pages.select(KEY, "page_no", "text"), KEY, ["page_no"], "text", classify.ANTI_ANCHORS)
        table_pages = table_pages.join(gate.filter("open").select(KEY, "page_no"), [KEY, "page_no"], "left_semi")
    found = items.rows_to_items(page_rows.join(table_pages, [KEY, "page_no"], "left_semi"))
    if ocr_texts is not None:
        read = items.texts_to_items(ocr_texts.join(table_pages, [KEY, "page_no"], "left_semi")).join(found.select(KEY).distinct(), KEY, "left_anti")
        found = found.unionByName(read, allowMissingColumns=True)
    found = found.filter(classify.real_item(F.col("description"), F.col("total"), F.col("code")))
    found = _kept(reconcile.fill_item_codes(found, ident))

    notes, note_lines = fields.credit_notes_and_lines(label_texts.filter(F.col("label") == "credit_note"))
    note_lines = _kept(note_lines)
    mirrors = labelled.filter(F.col("label").isin("unclassified", "credit_note"))
    notes = reconcile.complete_notes_from_mirror(notes, mirrors)
    notes = reconcile.complete_notes(notes, ident, as_of)
    terminal = F.col("format") == "terminal"
    lines = note_lines.drop("number").withColumnRenamed("value", "balance")
    fitted = reconcile.matching_line(notes.filter(terminal), lines, ident, [KEY], "nd", "line_no", ["nd", "esf", "ptres", "fonte", "ugr", "pi", "balance"])
    notes = _kept(fitted.unionByName(notes.filter(~terminal), allowMissingColumns=True))

    first_note = notes.groupBy(KEY).agg(F.min_by("favoured_code", "number").alias("_favoured"))
    unit_names = tables.aliases(spark, tables.UNIT_NAME_CODES)
    cover_text = label_texts.filter(F.col("label") == "cover").select(KEY, find(F.col("text"), r"(?:UASG|gerenciad[ao]\s+pel[ao]\s+UASG)\s*:?\s*(\d{6})").alias("_cover_code"))
    side = ident.join(contracts.select(KEY, F.col("unit_code").alias("_contract_code")), KEY, "left").join(first_note, KEY, "left").join(cover_text, KEY, "left")
    side = reconcile.alias_lookup(side, "unit_name", unit_names, F.lit(None).cast("string"), "_named_code")
    resolved = reconcile.resolve([("requisicao", F.col("unit_code")), ("pregao_detalhes", F.col("bid_details.unit_code")), ("contrato", F.col("_contract_code")), ("nc", F.when(F.col("_favoured").isin(*tables.UNIT_CODES), F.col("_favoured"))), ("capa", F.col("_cover_code")), ("mapa_om", F.col("_named_code"))])
    ident = side.withColumn("_unit", resolved).withColumns({"unit_code": F.col("_unit.value"), "unit_source": F.col("_unit.source")}).drop("_unit", "_contract_code", "_favoured", "_cover_code", "_named_code")

    has = labels.groupBy(KEY).agg(F.bool_or(F.col("label") == "checklist").alias("_checklist"), F.bool_or(F.col("label") == "contract").alias("_contract"))
    ident = ident.join(has, KEY, "left")
    ident = ident.withColumn("type", F.coalesce("type", fields.dossier_type(F.col("contract"), F.col("_checklist"), F.col("_contract"), F.col("bid"), F.col("commitment_type")))).drop("_checklist", "_contract")
    known = F.create_map(*(F.lit(x) for kv in tables.KNOWN_UNITS.items() for x in kv))
    ident = reconcile.official_name(ident, "unit_name", tables.official_units(spark), "unit_official", title=True)
    ident = _kept(ident.withColumn("unit_official", F.coalesce(F.try_element_at(known, F.col("unit_code")), "unit_official")))
    # a dossier without a credit note document shows the requisition's own note
    lone = ident.join(notes.select(KEY).distinct().hint("shuffle_merge"), KEY, "left_anti").filter(F.col("nc").isNotNull())
    lone = lone.select(KEY, F.col("nc").alias("number"), F.col("nc_date").alias("issue_date"), F.col("nc_issuer").alias("issuer_name"), "nd", "pi", "ptres", "ugr", "fonte", F.lit(True).alias("from_requisition"))
    shown = notes.withColumn("from_requisition", F.lit(False)).unionByName(lone, allowMissingColumns=True)

    certificates = _kept(rules.certificate_rows(everyone, sicaf, cadin, consolidated, as_of))
    ids = ident.select(KEY, "tax_id", "supplier").join(sicaf.select(KEY, F.col("tax_id").alias("sicaf_id"), F.col("name").alias("sicaf_name")), KEY, "left")
    ids = ids.join(cadin.select(KEY, F.col("tax_id").alias("cadin_id")), KEY, "left").join(consolidated.select(KEY, F.col("tax_id").alias("consolidated_id")), KEY, "left")
    found_all = [
        rules.identity_findings(ids, KEY, "tax_id", {"SICAF": "sicaf_id", "CADIN": "cadin_id", "Consulta Consolidada": "consolidated_id"}, "supplier", "sicaf_name", "sicaf_id"),
        rules.item_findings(found, everyone),
        rules.certificate_findings(certificates),
        quality.number_findings(dispatches.select(KEY, "nup"), ident),
    ]
    if names is not None and elements is not None:
        found_all.append(rules.code_findings(found, ident, names, elements))
    if with_notes:
        found_all.append(rules.note_findings(rules.note_totals(notes, ident, found)))
    if with_contract:
        joined = contracts.join(ids.select(KEY, "tax_id", F.col("sicaf_id").alias("sicaf_tax_id")), KEY).join(ident.select(KEY, "contract"), KEY)
        found_all.append(rules.contract_findings(joined, KEY, as_of))
    if with_specification:
        sums = found.groupBy(KEY).agg(F.sum("total").alias("total")).join(items.declared_totals(page_rows).hint("shuffle_merge"), KEY)
        sent = labelled.filter(F.col("label") == "dispatch").select(KEY, "page_no", "text")
        found_all.append(quality.specification_findings(ident, labels, sent, sums, spark, registered, found))
    findings = found_all[0]
    for f in found_all[1:]:
        findings = findings.unionByName(f, allowMissingColumns=True)
    findings = _kept(findings)
    decisions = _kept(rules.decide(findings, KEY, partial=not with_notes))
    return Dossiers(labels, label_texts, ident, found, shown, sicaf, cadin, consolidated, contracts, history.dispatch_order(dispatches), pieces, note_lines, certificates, findings, decisions, rendered(spark, ident, shown, decisions), folder)


def rendered(spark: SparkSession, ident: DataFrame, notes: DataFrame, decisions: DataFrame, for_rejections: bool = False) -> DataFrame:
    """(proc_id, template, dispatch): the template text, one part per credit note, and the dispatch text.

    Rejected dossiers get no template unless ``for_rejections``."""
    number = F.coalesce("number", find(F.col("subject"), r"Req\s*n[°º]?\s*([\w/]+)\s*[-–]"))
    who = ident.select(KEY, F.coalesce("unit_name", "origin").alias("_unit_name"), number.alias("req"), "sector", S.short_object(F.coalesce("object", "subject")).alias("object"), "bid", "contract", "unit_code", "participation", "type", F.col("nc_issuer").alias("_issuer"), F.col("nd").alias("_nd"), F.col("pi").alias("_pi"))
    who = reconcile.alias_lookup(who, "_unit_name", tables.aliases(spark, tables.UNIT_ALIASES), F.substring(F.upper("_unit_name"), 1, 20), "unit")
    rows = notes.select(KEY, F.col("number").alias("nc"), F.col("issue_date").alias("nc_date"), "issuer_name", "nd", "pi", "ptres", "ugr", "fonte").join(who, KEY)
    rows = rows.withColumn("_issuing", F.coalesce("issuer_name", "_issuer"))
    rows = reconcile.issuer_acronym(rows, "_issuing", tables.aliases(spark, tables.ISSUER_ALIASES), "issuer")
    values = {n: F.col(n) for n in ("unit", "sector", "object", "nc", "nc_date", "issuer", "fonte", "ptres", "ugr", "bid", "contract", "unit_code", "participation", "type")}
    values |= {"number": F.col("req"), "nd": F.coalesce("nd", "_nd"), "pi": F.coalesce("pi", "_pi")}
    one = rows.select(KEY, "nc", render.template_text(values).alias("text"))
    all_parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nc", "text"))), lambda t: t["text"]), "\n\n")
    templates = one.groupBy(KEY).agg(all_parts.alias("template"))
    out = decisions.join(templates, KEY, "left")
    template = F.col("template") if for_rejections else F.when(F.col("type") != "rejection", F.col("template"))
    return out.select(KEY, template.alias("template"), render.dispatch_text(F.col("type"), F.col("caveats")).alias("dispatch"))


def arriving(path: str, page_rows: DataFrame, as_of: Column, limit: datetime.timedelta = datetime.timedelta(days=7), **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: pages go through the whole plan, and its results into the history and the registries of bids,
    contracts and units below ``path``. A batch that is delivered again changes nothing.

    Pages that carry ``n_pages`` (how many pages their dossier has) and ``arrived`` may come in any pieces: they wait until their
    dossier is whole, or until ``limit`` has passed. Without these columns a batch holds whole dossiers."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = page_rows.join(batch.select(KEY).distinct().hint("shuffle_merge"), KEY, "left_semi")
        out = run(spark, batch, rows, as_of, **options)
        facts = out.identification.select(KEY, "nup", F.col("supplier"), "tax_id", "unit_code", "unit_name", "instrument", "bid", "bid_details", F.to_timestamp(as_of).alias("created"))
        totals = out.items.groupBy(KEY).agg(F.sum("total").alias("total"))
        decided = out.decisions.join(facts, KEY).join(totals, KEY, "left").withColumn("result", F.col("type"))
        made = store.analysis_rows(decided, KEY, "created", ["nup", "result", "title", "supplier", "tax_id", "unit_code", "unit_name", "instrument", "total"])
        analyses.Analyses(spark, f"{path}/analyses").append(made, batch_id)
        bids = facts.join(out.items.select(KEY, F.col("description").alias("item")), KEY, "left").select("bid", "unit_code", F.col("bid_details.unit_name").alias("unit_name"), F.col("bid_details.object").alias("object"), "supplier", "tax_id", "item", KEY, F.col("created").alias("used"))
        keyed.merge_into(f"{path}/bids", registry.bid_facts)(bids, batch_id)
        signed = out.contracts.select(KEY, F.col("contract_no").alias("contract"), "contracted", F.col("contracted_tax_id").alias("tax_id"), "object", "total", "valid_from", "valid_to", "signed").withColumn("used", F.to_timestamp(as_of))
        keyed.merge_into(f"{path}/contracts", registry.contract_facts)(signed, batch_id)
        keyed.merge_into(f"{path}/units", registry.unit_facts)(facts.select("unit_code", "unit_name", F.col("created").alias("used")), batch_id)
        out.release()

    hold = incremental.whole(f"{path}/waiting", work, KEY, limit=limit)
    return lambda batch, batch_id: hold(batch, batch_id) if {"n_pages", "arrived"} <= set(batch.columns) else work(batch, batch_id)
