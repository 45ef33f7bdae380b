"""The whole way from pages to decisions, and its parts, on the synthetic corpus."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folio.functions.text import lines_around
from folio.operators import classify, fields, items, texts
from folio.plans import dossier
from folio.sources import analyses, keyed, schemas
from tests import corpus

AS_OF = "2026-02-10"


SMALL = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}


@pytest.fixture(scope="module", autouse=True)
def small(spark):
    """A dozen pages go through plans of hundreds of expressions: compiling these would take longest by far."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def run(spark):
    pages = spark.createDataFrame(corpus.PAGES, schemas.PAGES)
    rows = spark.createDataFrame(corpus.ROWS, schemas.PAGE_ROWS)
    names = spark.createDataFrame([(30, 24, "MATERIAL P/ MANUTENÇÃO")], "element int, sub int, name string")
    elements = spark.createDataFrame([(30, "MATERIAL DE CONSUMO")], "element int, name string")
    return dossier.run(spark, pages, rows, F.lit(AS_OF).cast("date"), names=names, elements=elements)


def one(df, proc="A"):
    return df.filter(F.col("proc_id") == proc).first()


def test_labels(run):
    got = {}
    for r in run.labels.collect():
        got.setdefault((r.proc_id, r.page_no), set()).add(r.label)
    assert [got["A", i] for i in range(1, 10)] == [{"cover"}, {"requisition"}, {"credit_note"}, {"sicaf"}, {"cadin"}, {"consolidated"}, {"dispatch"}, {"bid_notice"}, {"unclassified"}]
    assert got["B", 5] == {"requisition", "contract"}  # an amount and a total make it look like an item table, too


def test_every_page_has_a_label(run):
    assert run.labels.select("proc_id", "page_no").distinct().count() == len(corpus.PAGES)


def test_usable(spark):
    df = spark.createDataFrame([(corpus.FOOTER,), ("x" * 31,), ("x" * 30,), (None,)], "t string")
    assert [r.u for r in df.select(classify.usable(F.col("t")).alias("u")).collect()] == [False, True, False, False]


def test_units_have_official_names(run):
    assert one(run.identification).unit_official == "9º Batalhão de Suprimento"


def test_identification(run):
    a = one(run.identification)
    assert (a.nup, a.number, a.sector, a.supplier, a.tax_id) == ("64136.000123/2026-11", "21", "Almox", "ACME LTDA", "12.345.678/0001-90")
    assert (a.nc, a.nc_date, a.nc_issuer, a.nd, a.pi, a.bid) == ("2026NC000343", "05/02/2026", "DGO", "339030", "E6SUPLJA3RR", "90004/2025")
    assert (a.unit_code, a.unit_source, a.instrument, a.type, a.commitment_type) == ("160142", "requisicao", "PE 90004/2025 (GER)", "Licitação", "Global")
    assert a.unit_name == "9º B Mnt" and a.origin == "9º Gpt Log" and a.participation == "GER"


def test_pieces(spark):
    df = spark.createDataFrame([("A", corpus.COVER)], "proc_id string, text string")
    got = [(r.piece_no, r.name, r.mark, r.status) for r in fields.pieces(df, "proc_id").orderBy("piece_no").collect()]
    assert got == [(1, "Capa", "a", "documento_origem"), (2, "Requisição", None, "ativo"), (3, "Nota antiga", "c", "desentranhado")]


def test_terminal_note(run):
    a = one(run.notes)
    assert (a.number, a.format, a.issuer_code, a.favoured_code, a.nd, a.ptres) == ("2026NC000343", "terminal", "160502", "160136", "339030", "232180")
    assert (a.balance, a.total) == (Decimal("2000.00"), Decimal("2500.00"))
    assert a.due == datetime.date(2026, 6, 30) and a.days_left == 140


def test_standard_note(run):
    b = one(run.notes, "B")
    assert (b.number, b.issuer_code, b.favoured_code, b.nd, b.balance, b.pi) == ("2026NC000276", "160073", "160136", "339000", Decimal("9000.00"), "I3DAFUNADOM")
    assert b.due == datetime.date(2026, 2, 27)


def test_items(run):
    got = {(r.proc_id, r.item_no): r for r in run.items.collect()}
    a1, a2 = got["A", 1], got["A", 2]
    assert (a1.code, a1.description, a1.qty, a1.unit_price, a1.total, a1.nd_si) == ("123456", "CHAPA DE AÇO GALVANIZADO", Decimal("6666"), Decimal("0.30"), Decimal("1999.80"), "30.24")
    assert (a2.code, a2.qty, a2.nd_si) == ("301234", Decimal("5"), "30")
    assert (got["B", 12].description, got["B", 12].total) == ("DESCRIÇÃO LONGA DO MATERIAL", Decimal("7.00"))
    assert len(got) == 4


def test_map_goes_on_in_the_next_table(spark):
    """A table without header whose first row fits goes on under the header of an earlier page; other tables, and other dossiers, do not."""
    head, first = corpus.ROWS[0][4], corpus.ROWS[1][4]
    more = ["2", "301999", "PREGO", "KG", "4", "30.24", "R$ 1,00", "R$ 4,00"]
    rows = [("A", 2, 1, 0, head), ("A", 2, 1, 1, first), ("A", 3, 1, 0, more), ("A", 3, 1, 1, [None, None, "FINO", *[None] * 5]), ("A", 4, 1, 0, ["nota", "texto"]), ("B", 1, 1, 0, more)]
    got = [(r.proc_id, r.page_no, r.item_no, r.code, r.description, r.qty, r.total) for r in items.rows_to_items(spark.createDataFrame(rows, schemas.PAGE_ROWS)).orderBy("proc_id", "page_no").collect()]
    assert got == [("A", 2, 1, "123456", "CHAPA DE AÇO", Decimal("6666"), Decimal("1999.80")), ("A", 3, 2, "301999", "PREGO FINO", Decimal("4"), Decimal("4.00"))]


def test_certificates(run):
    s = one(run.sicaf)
    assert (s.status, s.size, s.trade_name) == ("Credenciado", "ME", "ACME") and s.validities == {"receita_federal": datetime.date(2026, 7, 20), "fgts": datetime.date(2026, 2, 19)}
    assert one(run.cadin).status == "REGULAR"
    assert [(r.agency, r.short_name, r.result) for r in one(run.consolidated).registers] == [("TCU", "TCU — Licitantes Inidôneos", "Nada Consta"), ("CNJ", "CNJ — Improbidade", "Nada Consta")]
    got = {r.certificate: r.status for r in run.certificates.filter(F.col("proc_id") == "A").collect()}
    assert got["FGTS"] == "ressalva" and got["Credenciamento"] == "conforme" and got["CADIN"] == "conforme" and len(got) == 13


def test_contract(run):
    b = one(run.contracts, "B")
    assert (b.contract_no, b.contracted_tax_id, b.contracting_tax_id, b.valid_from, b.valid_to, b.total) == ("059/2024", "98.765.432/0001-10", "00.394.452/0001-03", "01/01/2025", "31/12/2026", "12.000,00")
    assert b.contracted == "LIMPA TUDO LTDA" and b.signed and b.signers == ["FULANO DE TAL", "BELTRANA SILVA"]


def test_dispatch(run):
    d = one(run.dispatches)
    assert (d.number, d.sector, d.unit_name, d.date, d.kind, d.role, d.signed) == (324, "Fisc Adm/CAF", "Cmdo 9º Gpt Log", "9 de fevereiro de 2026", "aprovacao_encaminhamento", "Ordenador de Despesas", True)
    assert d.signer == "FULANO DE TAL - TC" and d.subject == "aprovação da requisição"


def test_decisions(run):
    a, b = one(run.decisions), one(run.decisions, "B")
    assert a.type == "caveat" and [c for c in a.caveats if "FGTS" in c] == ["FGTS: 19/02/2026 (9 dias)"]
    assert b.type == "rejection" and any("CNPJ divergente — SICAF" in c for c in b.caveats)
    assert "CNPJ consistente em todas as peças (SICAF, CADIN, Consulta Consolidada)" in a.ok
    assert any(c.startswith("Saldo R$ 2.000,00 < R$ 2.009,80") for c in a.caveats)


def test_texts(run):
    a, b = one(run.rendered), one(run.rendered, "B")
    assert a.template == "9º B MNT, REQ 21-ALMOX, AQS DE MAT ESPORTIVO, 2026NC000343, de 05FEV26, do DEC, ND 339030, FONTE 1021000000, PTRES 232180, UGR 167504 PI E3PCFSCDEGE, PE 90004/2025, UASG 160142 (GER)."
    assert "a certidão de FGTS no SICAF possui validade próxima (19/02/2026, 9 dias restantes)." in a.dispatch and a.dispatch.startswith("Informo que ")
    assert b.template is None and "o CNPJ constante no SICAF (12.345.678/0001-90) não corresponde ao CNPJ do fornecedor requisitado (11.111.111/0001-11)." in b.dispatch


def test_requisition_numbers(spark):
    cases = {"ASSUNTO: Requisição 21/2026- Almox Cmdo": ("21/2026", "Requisição Nº 21/2026"), "ASSUNTO: Requisição N°10/2026 - Almox": ("10/2026", "Requisição Nº 10/2026"), "ASSUNTO: Req n° S002/2026 – Pel Sup": ("S002/2026", "Req Nº S002/2026"), "ASSUNTO: Req 03": ("03", "Requisição Nº 03"), "nada": (None, None)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [(r.n.raw, r.n.shown) for r in df.select("i", fields.requisition_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_instrument(spark):
    cases = {"por meio do Contrato 59/2024 e PE 90004/2025": "Contrato 59/2024", "Contrato 59/2024 e PE 90004 / 2025": "PE 90004/2025", "Dispensa de Licitação nº 12/2025": "Dispensa 12/2025", "nada": None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.s for r in df.select("i", fields.instrument(F.col("t")).shown.alias("s")).orderBy("i").collect()] == list(cases.values())


def test_supplier_near_tax_id(spark):
    cases = {"Nome da Empresa: ACME LTDA CNPJ: 12.345.678/0001-90": "ACME LTDA", "12.345.678/0001-90 - BETA SA\n": "BETA SA", "GAMA ME - CNPJ: 12.345.678/0001-90": "GAMA ME", "x": None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.s for r in df.select("i", fields.supplier_near_tax_id(F.col("t")).supplier.alias("s")).orderBy("i").collect()] == list(cases.values())


def test_ocr_items(spark):
    text = "101 - CHAPA 301234 CHAPA DE ACO 10 KG 30/24 R$ 2,00 R$ 20,00\n102 - TINTA 401234 TINTA BRANCA 5 L R$ 3,00 R$ 15,00"
    df = spark.createDataFrame([("A", 1, 1, text), ("B", 1, 1, "")], "proc_id string, page_no int, image_no int, text string")
    got = [(r.item_no, r.code, r.qty, r.unit_price, r.total, r.nd_si, r.strategy) for r in items.texts_to_items(df).orderBy("item_no").collect()]
    assert got == [(101, "301234", Decimal("10"), Decimal("2.00"), Decimal("20.00"), "30.24", "numbers"), (102, "401234", Decimal("5"), Decimal("3.00"), Decimal("15.00"), None, "numbers")]


def test_machine_read_texts_are_searched_once(spark):
    """How a text is cut is told once for each text, not for each of its segments, and a segment's amounts are not read again for each column."""
    rows = spark.range(1).select(F.col("id").alias("i"), F.col("id").cast("string").alias("text"))
    segments, texts = items.texts_to_items(rows, ("i",))._jdf.queryExecution().optimizedPlan().toString().split("Generate ", 1)
    assert segments.count("[-–]") == 0 and texts.count("[-–]") == 3
    assert max(segments.count(p) for p in (r"R\$\s*([\d.]+", r"TOTAL.*", r"\d{2}[/.]\d{2}", r"(\d{2}/\d{2})")) <= 2  # where it is read, and in the filter that Spark moves ahead


def test_machine_read_items_in_odd_forms(spark):
    texts = {
        "x \n100 -  A 301234 |  PANO [x] 50% 1kg 3010\t2 mês 33.90.30/07\n101–\nB 12 UND R$1,00 R$ 3,00 R$ 2,00 TOTAL FORNECEDOR R$ 1,234,50 FIM": [
            (100, "301234", "PANO x 1kg 2 mês", "MÊS", None, "30.07", None, None), (101, None, "– B 12 UND", "UND", "12.0000", None, "1.00", "1234.50")],
        "301234 A 1 L 400000 AÇO 20 M2 30/00": [(1, "301234", "A 1 L", "L", "1.0000", None, None, None), (2, "400000", "AÇO 20 M", "M2", "20.0000", None, None, None)],
        "CAT 301234 12 KG ABC 34 CX DEF": [(1, "301234", "12 KG ABC", "KG", "12.0000", None, None, None), (2, "301234", "34 CX DEF", "CX", "34.0000", None, None, None)],
        "PANO 1234567 KG  12,50": [(1, None, "PANO KG", "KG", None, None, None, None)],
        " \n": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = items.texts_to_items(df, ("i",)).selectExpr("i", "item_no", "code", "description", "unit", "string(qty) AS qty", "nd_si", "string(unit_price) AS unit_price", "string(total) AS total").orderBy("i", "item_no").collect()
    assert [tuple(r) for r in got] == [(i, *row) for i, rows in enumerate(texts.values()) for row in rows]


def test_a_catalogue_code_is_no_budget_code(spark):
    texts = {
        "X 339030 TINTA 2 KG 30/07 R$ 2,00 R$ 4,00": ("339030", "30.07"), "X 339030 TINTA 2 KG R$ 2,00 R$ 4,00": ("339030", None), "X 301234 TINTA 2 KG 339039 R$ 2,00": ("301234", "39"),
        "ND 339030 CATMAT 301234 TINTA": ("339030", "30"), "X 339012 TINTA 339039": ("339012", "39"), "X 301234 339030/24": ("301234", "30.24"), "X 339030 TINTA 33.90.30.24": ("339030", "30.24"),
    }
    df = spark.createDataFrame([(i, f"105 - {t}\n106 - Y 301111 PAPEL") for i, t in enumerate(texts)], "i int, text string")
    assert [(r.code, r.nd_si) for r in items.texts_to_items(df, ("i",)).filter("item_no = 105").orderBy("i").collect()] == list(texts.values())


def test_mirror_fills_gaps(spark):
    from folio.operators import reconcile

    notes = spark.createDataFrame([("A", "1", None, "339039")], "proc_id string, number string, ugr string, nd string")
    pages = spark.createDataFrame([("A", 3, "FONTE DE RECURSO\n1000000000\nNATUREZA DA DESPESA 339000\nUGR 160073\nPLANO INTERNO I3DAFUNADOM", "ocr")], schemas.PAGES)
    r = reconcile.complete_notes_from_mirror(notes, pages).first()
    assert (r.fonte, r.ugr, r.nd, r.pi) == ("1000000000", "160073", "339039", "INTERNO") or (r.fonte, r.ugr, r.nd, r.pi) == ("1000000000", "160073", "339039", "I3DAFUNADOM")


def test_running_gate(spark):
    df = spark.createDataFrame([("A", 1, "texto"), ("A", 2, "EDITAL"), ("A", 3, "pregoeiro"), ("A", 4, "fim"), ("B", 1, "fim")], "p string, n int, t string")
    got = [(r.p, r.n, r.open) for r in classify.running_gate(df, "p", ["n"], "t", classify.ANTI_ANCHORS).orderBy("p", "n").collect()]
    assert got == [("A", 1, True), ("A", 2, True), ("A", 3, False), ("A", 4, False), ("B", 1, True)]


def test_pairing_stops_at_the_next_opening(spark):
    df = spark.createDataFrame([("A", i, k, f"v{i}") for i, k in enumerate("oxodxxxd")], "p string, n int, k string, v string")
    got = [(r.n, r.paired) for r in texts.pair_following(df, "p", "n", F.col("k") == "o", F.col("k") == "d", F.col("v"), 3).orderBy("n").collect()]
    assert got == [(0, None), (2, "v3")]


def test_long_text_does_not_overflow(spark):
    long = "Órgão Gestor: X\nCadastro: Y\n" + "linha\n" * 50_000 + "Resultado da consulta: Z\n"
    df = spark.createDataFrame([(long,)], "t string").select(*(c.alias(n) for n, c in fields.consolidated(F.col("t")).items()))
    assert [(r.agency, r.register, r.result) for r in df.first().registers] == [("X", "Y", "Z")]


MEGABYTE = "palavra comum do processo\n" * 40_000


def test_no_field_is_cut_short_in_a_long_text(spark):
    """A megabyte between the anchors of each field."""
    line = MEGABYTE.replace("\n", " ").strip()
    cases = {
        "pieces": ("PEÇAS PROCESSUAIS\n" + "7- Nota de empenho\n" * 20_000 + "8- Última peça (b)\nLegenda", lambda t: None, None),
        "validity": ("CLÁUSULA PRIMEIRA OBJETO 1.1. Limpeza, " + line + ", fim 1.2. x\nprazo de vigência " + MEGABYTE + " 01/02/2025 " + MEGABYTE + " 31/01/2026", lambda t: fields.contract_document(t)["valid_to"], "31/01/2026"),
        "note": ("DOCUMENTO WEB : 2026NC000343\nOBSERVACAO\n" + MEGABYTE + "LANCADO POR X", lambda t: F.length(fields.terminal_note(t)["note"]).cast("string"), str(len(line))),
        "subject": ("Assunto: " + MEGABYTE.lower() + "\n\n1. x", lambda t: F.length(fields.dispatch(t)["subject"]).cast("string"), str(len(line))),
        "observation": ('Obs: "' + MEGABYTE + '"', lambda t: F.length(fields.observation(t)).cast("string"), str(len(MEGABYTE))),
    }
    df = spark.createDataFrame([(k, t) for k, (t, *_) in cases.items()], "proc_id string, text string")
    got = fields.pieces(df.filter("proc_id = 'pieces'"), "proc_id")
    assert got.count() == 20_001 and got.filter("piece_no = 8").first().status == "nao_imprimivel"
    for k, (_, f, want) in cases.items():
        if want:
            assert df.filter(F.col("proc_id") == k).select(f(F.col("text")).alias("v")).first().v == want, k
    r = df.filter("proc_id = 'validity'").select(fields.contract_document(F.col("text"))["object"].alias("o")).first().o
    assert r == "Limpeza"


def test_names_of_any_length(spark):
    """A company of 300 characters found by its suffix, signers of 150 characters in both forms, blanks of any kind."""
    company, person = "GRÃO DE OURO " * 22 + "COMÉRCIO LTDA", ("ÂNGELA  DA\tSILVA " * 9).strip()
    cases = [(f"entre a UNIÃO e {company}, doravante", f"x\n{person} - 2º Ten Int\nChefe da Seção\n"), ("e ME", f"x\n{person}\nChefe de Tudo\n"), ("e " + "A" * 200_000, "\n" + "A " * 200_000)]
    rows = [(i, c, s) for i, (c, s) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, c string, s string").select("i", fields.contract_document(F.col("c"))["contracted"].alias("c"), *(fields.dispatch(F.col("s"))[n].alias(n) for n in ("signer", "role")))
    got = [tuple(r)[1:] for r in df.orderBy("i").collect()]
    assert len(company) >= 299 and len(person) >= 150
    assert got == [(company, f"{person} - 2º Ten Int", "Chefe da Seção"), (None, person, "Chefe de Tudo"), (None, None, None)]


def test_requisition_fields_in_a_long_text(spark):
    """A megabyte ahead of, between and behind the anchors; the number of the credit note in the first, or only in the last line."""
    import time

    line = MEGABYTE.replace("\n", " ").strip()
    cases = {
        "purchase": ("despesas com a aquisição de " + line + " por meio do PE", lambda r: len(r.bid_details["object"]), len("aquisição de " + line)),
        "template": ("2026NC000343\n6. Material:\n2026NC000343 ND 339030 PI X " + MEGABYTE + "\n8. Outro", lambda r: len(r.own_template), len("2026NC000343 ND 339030 PI X " + line)),
        "last": (MEGABYTE + "9º B Mnt, NC 2026NC000343, de 05FEV26, ND 339030\nPE 90004/2025\n\nfim", lambda r: (r.own_template, r.nc_date), ("9º B Mnt, NC 2026NC000343, de 05FEV26, ND 339030 PE 90004/2025", "05FEV26")),
        "many": ("2026NC000343\n" * 80_000 + "2026NC000343 de 5/02/26\nEmpresa: " + line, lambda r: (r.nc_date, len(r.supplier)), ("5/02/26", len(line))),
    }
    for name, (text, read, want) in cases.items():
        df = fields.requisitions(spark.createDataFrame([("A", text)], "proc_id string, text string"))
        start = time.time()
        assert read(df.first()) == want, name
        assert time.time() - start < 20, name
    near = spark.createDataFrame([(cases["last"][0],)], "text string").select(lines_around(F.col("text"), F.lit("2026NC000343"), 6).alias("n"))
    near.first()
    start = time.time()
    assert near.first().n.startswith("9º B Mnt") and time.time() - start < 1


def test_lines_around_a_key(spark):
    cases = {"a\nb K\nc\nd": ("K", "b K\nc"), "K": ("K", "K"), "x K\n\ny": ("K", "x K"), "\nK\ny": ("K", "K\ny"), "none": ("K", None)}
    df = spark.createDataFrame([(i, t, k) for i, (t, (k, _)) in enumerate(cases.items())], "i int, t string, k string")
    assert [r.n for r in df.select("i", lines_around(F.col("t"), F.col("k"), 1).alias("n")).orderBy("i").collect()] == [w for _, w in cases.values()]


REQUISITIONS = [
    # each written form of a sender, and what is unit and sector then
    ("Do: Chefe da Seção de Compras do 9º B Mnt, em exercício\n", {"unit_name": "9º B Mnt", "sector": "Seção de Compras"}),
    ("Do: FISC ADM/Cmdo 9º Gpt Log Ao: Sr X\n", {"unit_name": "9º Gpt Log", "sector": "FISC ADM"}),
    ("Do: 18º B Trnp\n", {"unit_name": "18º B Trnp", "sector": None}),
    ("Do: Fulano\nAo: Sr OD do Cmdo 9º Gpt Log\n", {"unit_name": "9º Gpt Log"}),
    ("Do Sr Cmt do 18 B Trnp\n", {"unit_name": "18 B Trnp"}),
    ("Do Enc Set Mat/Cmdo 9º Gpt Log\n", {"unit_name": "9º Gpt Log", "sector": "Set Mat"}),
    ("Do Enc Almoxarifado\n", {"unit_name": "Almoxarifado", "sector": None}),
    ("Req. nº 9 – Aprv/CCAp\n", {"number": "9", "sector": "Aprv"}),
    ("REQ 12-9º Gpt Log\n", {"number": "12", "sector": None}),
    ("Referência: Lei 14.133\n", {"law": "Lei 14.133"}), ("Lei Federal Nr 14.133, de 2021\n", {"law": "14.133, de 2021"}),
    ("TIPO DE EMPENHO ordinario\n", {"commitment_type": "Ordinario"}), ("( x ) Ordinário ( ) Global\n", {"commitment_type": "Ordinário"}), ("(X)Estimativo", {"commitment_type": "Estimativo"}),
    ("Nome da empresa: ÁGUIA S.A. - CNPJ: 12.345.678/0001-90", {"supplier": "ÁGUIA S.A.", "tax_id": "12.345.678/0001-90"}), ("EMPRESA:\n BETA – CNPJ: x\n", {"supplier": "BETA", "tax_id": None}),
    ("2026NC000001 x 2026NC000002 e 2026NC000001, DE 27 JAN 26 da Diretoria de Gestão Orçamentária", {"nc": "2026NC000001", "more_nc": ["2026NC000002"], "nc_date": "27 JAN 26", "nc_issuer": "DGO"}),
    ("2026NC000001 11/jan/2026 dela COTER", {"nc_date": "11/jan/2026", "nc_issuer": "COTER", "more_nc": []}), ("2026NC000001", {"nc_date": None}),
    ("Pregão Eletrônico nº 9004/2025 gerenciado pela UASG 160142 – 9º B Sup, o qual", {"bid": "90004/2025", "unit_code": "160142", "bid_details": ("160142", "9º B Sup", None)}),
    ("Pregão nº 90006/2024, da UASG 160141, CRO/9 da qual", {"bid": "90006/2024", "bid_details": ("160141", "CRO/9", None)}),
    ("PE 4/2025 PE 90004/2025, UASG 160142 (CAR)", {"bid": "90004/2025", "participation": "CAR", "bid_details": ("160142", None, None)}), ("órgão participante", {"participation": "PART"}),
    ("contrato nº 59/2024 gerenciado pela UG 160136\nGestão e Fiscalização de Contrato: Fulano", {"contract": "59/2024", "managing_unit": "160136", "inspector": "Fulano"}),
    ("aprovar as despesas com a\ncontratação, constante", {"bid_details": (None, None, "a contratação")}), ("despesas com Aquisição de água para atender", {"bid_details": (None, None, "Aquisição de água")}),
    ("Campo Grande, MS, 3 de março de 2026.\nAo Sr. Ordenador\nASSUNTO:  compra ", {"date": "3 de março de 2026", "addressee": "Ordenador", "subject": "compra"}),
    ("ND 33.90.30 PI ABCDEFGH1 PTRES 1714 UGR 160504 FONTE 1000000000 NUP: 64136.000123/2026-11", {"nd": "33.90.30", "pi": "ABCDEFGH1", "ptres": "1714", "ugr": "160504", "fonte": "1000000000", "nup": "64136.000123/2026-11"}),
    ("7. Descrição\n2026NC000001 ND 339030\nCONTRATO 59/2024\n\n8. x", {"own_template": "2026NC000001 ND 339030 CONTRATO 59/2024"}), ("7. Descrição\n2026NC000001 sem código\n8. x", {"own_template": None}),
    ("", {"number": None, "nc": None, "own_template": None}), (None, {"number": None, "nc": None, "own_template": None}),
]


def test_written_forms_of_a_requisition(spark):
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(REQUISITIONS)], "proc_id string, text string")
    got = {r.proc_id: r.asDict() for r in fields.requisitions(df).collect()}
    for i, (text, want) in enumerate(REQUISITIONS):
        own = {k: (tuple(got[str(i)][k]) if k == "bid_details" else got[str(i)][k]) for k in want}
        assert own == want, text


def filled(spark, path):
    """The history and the registries below a path."""
    history = {r.proc_id: (r.result, r.total) for r in analyses.Analyses(spark, f"{path}/analyses").read().collect()}
    bid = keyed.Keyed(spark, f"{path}/bids")
    shown = {r.bid: (r.n_items, r.n_dossiers) for r in bid.entries("bid", sets=["items", "dossiers"]).collect()}
    dossiers = {r.bid: sorted(r.dossiers) for r in bid.members("bid", "dossiers", 10).collect()}
    contracts = [r.contract for r in keyed.Keyed(spark, f"{path}/contracts").entries("contract").collect()]
    units = sorted((r.unit_code, r.unit_name) for r in keyed.Keyed(spark, f"{path}/units").entries("unit_code", ["unit_name"]).collect())
    return history, shown, dossiers, contracts, units


FILLED = ({"A": ("caveat", Decimal("2009.80")), "B": ("rejection", Decimal("12.00"))}, {"90004/2025": (4, 2)}, {"90004/2025": ["A", "B"]}, ["059/2024"], [("160142", "9º B Mnt")])


def test_arriving_dossiers_fill_history_and_registries(spark, tmp_path):
    rows = spark.createDataFrame(corpus.ROWS, schemas.PAGE_ROWS)
    work = dossier.arriving(f"{tmp_path}/out", rows, F.lit(AS_OF).cast("date"))
    for n, proc in ((0, "A"), (1, "B"), (1, "B")):  # the second is delivered again
        work(spark.createDataFrame([p for p in corpus.PAGES if p[0] == proc], schemas.PAGES), n)
    assert filled(spark, f"{tmp_path}/out") == FILLED


def test_dossiers_that_arrive_in_pieces(spark, tmp_path):
    """Pages of both dossiers in turn, one batch twice; a dossier is worked off when its last page is there."""
    rows = spark.createDataFrame(corpus.ROWS, schemas.PAGE_ROWS)
    size = {p: sum(x[0] == p for x in corpus.PAGES) for p in "AB"}
    pages = [(*p, size[p[0]] if i % 4 == 0 or p[1] == size[p[0]] else None, datetime.datetime(2026, 2, 1)) for i, p in enumerate(corpus.PAGES)]
    work = dossier.arriving(f"{tmp_path}/out", rows, F.lit(AS_OF).cast("date"))
    schema = "proc_id string, page_no int, text string, source string, n_pages int, arrived timestamp"
    for n, part in ((0, pages[::2]), (0, pages[::2]), (1, pages[1::2])):
        work(spark.createDataFrame(part, schema), n)
    assert filled(spark, f"{tmp_path}/out") == FILLED


def test_destination_rows(spark):
    barred = "DESTINO | 1 | 160136 | 1 | 171460 | 1000000000 | 339000 | 160073 | I3DAFUNADOM | R$ 9.000,00"
    plain = "DESTINO x\nDESTINO 1 1 160136 1 171397 1000000000 33.90.30 160504 E6SUPLJA3RR R$\n4.000,00 fim"
    df = spark.createDataFrame([(0, barred), (1, plain), (2, "DESTINO 1 2")], "i int, t string").select("i", fields.destination(F.col("t")).alias("d")).orderBy("i").collect()
    assert tuple(df[0].d) == ("160136", "1", "171460", "1000000000", "339000", "160073", "I3DAFUNADOM", "9.000,00")
    assert tuple(df[1].d) == ("160136", "1", "171397", "1000000000", "33.90.30", "160504", "E6SUPLJA3RR", "4.000,00") and df[2].d is None


def test_active_pieces(spark):
    df = spark.createDataFrame([("A", corpus.COVER)], "proc_id string, text string")
    assert [r.piece_no for r in fields.pieces(df, "proc_id", active=True).orderBy("piece_no").collect()] == [1, 2]


def test_notes_without_a_number_stay(spark):
    df = spark.createDataFrame([("A", corpus.TERMINAL.replace("DOCUMENTO WEB : 2026NC000343\n", ""))], "proc_id string, text string")
    r = fields.credit_notes(df).first()
    assert r.number is None and r.siafi_no == "2026RO000273" and r.nd == "339030"


def test_note_lines_bear_their_number(run):
    got = [(r.number, r.line_no, r.nd, r.value) for r in run.note_lines.filter("proc_id = 'A'").orderBy("line_no").collect()]
    assert [(n, nd, v) for n, _, nd, v in got] == [("2026NC000343", "339030", Decimal("2000.00")), ("2026NC000343", "339000", Decimal("500.00"))]


def test_pieces_and_dispatches_of_a_run(run):
    assert [(r.piece_no, r.name) for r in run.pieces.filter("proc_id = 'A'").orderBy("piece_no").collect()] == [(1, "Capa"), (2, "Requisição")]
    assert [r.seq for r in run.dispatches.filter("proc_id = 'A'").collect()] == [1]


def test_a_note_in_a_grid_is_read(spark):
    """A page that has next to no text of its own, but a grid of characters."""
    pages = spark.createDataFrame([("A", 1, "credit_note", "DEMONSTRA-DIARIO", "text"), ("A", 2, "credit_note", "x" * 101, "text"), ("A", 1, "sicaf", "DEMONSTRA-DIARIO", "text")], "proc_id string, page_no int, label string, text string, source string")
    rows = spark.createDataFrame([("A", 1, 1, i, list(line)) for i, line in enumerate(corpus.TERMINAL.split("\n"))] + [("A", 2, 1, 0, ["y"] * 200)], schemas.PAGE_ROWS)
    got = {(r.page_no, r.label): r.text for r in texts.with_grid_text(pages, rows).collect()}
    assert got == {(1, "credit_note"): corpus.TERMINAL, (2, "credit_note"): "x" * 101, (1, "sicaf"): "DEMONSTRA-DIARIO"}


def test_tables_of_two_columns_are_not_told_by_shape(spark):
    rows = [("A", 1, 1, 0, ["1", "R$ 2,00 por unidade de material de limpeza"]), ("B", 1, 1, 0, ["1", "MATERIAL DE LIMPEZA PESADA", "R$ 2,00", "R$ 4,00"]), ("B", 1, 1, 1, ["TOTAL", None, None, "R$ 4,00"])]
    df = spark.createDataFrame(rows, schemas.PAGE_ROWS)
    assert [(r.proc_id, r.item_no, r.total) for r in items.rows_to_items(df).collect()] == [("B", 1, Decimal("4.00"))]
    assert [(r.proc_id, r.declared) for r in items.declared_totals(df).collect()] == [("B", Decimal("4.00"))]


def test_specification_and_gate_in_the_run(spark):
    pages, rows = spark.createDataFrame(corpus.PAGES, schemas.PAGES), spark.createDataFrame(corpus.ROWS, schemas.PAGE_ROWS)
    out = dossier.run(spark, pages, rows, F.lit(AS_OF).cast("date"), with_specification=True, gated=True)
    said = {r.description for r in out.findings.filter("family = 'specification' and proc_id = 'A'").collect()}
    assert "Peça obrigatória ausente: Termo de Abertura" in said and "Despachos encontrados: 1 de 3" in said and not any("CADIN" in x for x in said)
    assert out.items.count() == 4  # no text before the tables closes the gate
    out.release()


def test_lines_of_a_note_are_paired_inside_its_row(spark):
    """No line of a note is shuffled; the first data line within three, not past an event line; an amount that is no number gives no line."""
    event, data = "00{} 301203       {}", "     1  232180 1021000000 {} 167504 E3PCFSCDEGE"
    text = "\n".join(["DOCUMENTO WEB : 2026NC000001", "9 UASG", event.format(1, "1.000,00"), data.format("339000"), event.format(2, "7,00"), event.format(3, "2,50"), "x", "", data.format("339030"), event.format(4, "9,00"), "x", "1 y", "", data.format("339039"),
                      event.format(5, "4,00"), data.format("339000"), event.format(6, "1,234,567.89"), data.format("339030"), event.format(7, "3,00"), "\t" + data.format("339039").strip() + " \r"])
    notes = spark.createDataFrame([("A", text), ("B", "DOCUMENTO WEB : 2026NC000002")], "proc_id string, text string")
    assert [(r.line_no, r.nd, r.value) for r in fields.event_lines(notes).orderBy("line_no").collect()] == [(2, "339000", Decimal("1000.00")), (5, "339030", Decimal("2.50")), (14, "339000", Decimal("4.00")), (18, "339039", Decimal("3.00"))]
    out = fields.credit_notes(notes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    got = {r.proc_id: (r.nd, r.pi, r.balance, r.total) for r in out.collect()}
    assert got == {"A": ("339030", "E3PCFSCDEGE", Decimal("2.50"), Decimal("1005.50")), "B": (None, None, None, None)}
