"""Bindings of the extraction operators: page texts and table rows are rendered from the star schema and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.operators import classify, fields, items, reconcile, rules
from folio.plans.bindings import AS_OF, Registry, as_of, decimal, spread, table

R = Registry()
KEY = "o_orderkey"


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _pad(c, width: int):
    return F.lpad(_s(c), width, "0")


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _orders(spark, d):
    """Orders with their customer and the codes that the pages name; the narrow rows are spread behind the join, as rendering and reading
    their texts is the work: a join by shuffle leaves few partitions of them."""
    k, c = F.col(KEY), F.col("o_custkey")
    rows = spread(table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")), KEY)
    tax = _pad(c % 100_000_000, 8)
    return rows.withColumns({
        "k": k, "day": F.to_date("o_orderdate"), "nup": _cat("64136.", _pad(k % 1_000_000, 6), "/2026-", _pad(k % 97, 2)), "nc": _cat("2026NC", _pad(k % 1_000_000, 6)),
        "tax": _cat(F.substring(tax, 1, 2), ".", F.substring(tax, 3, 3), ".", F.substring(tax, 6, 3), "/0001-", _pad(c % 97, 2)),
    })


_ORDERS = """o AS (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, '64136.' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '/2026-' || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') AS nup,
  '2026NC' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS nc, substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 1, 2) || '.' || substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 3, 3) || '.' || substr(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 6, 3) || '/0001-' || lpad(CAST(o_custkey % 97 AS VARCHAR), 2, '0') AS tax
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _read(rows, columns, *more):
    return rows.select(KEY, *more, *(c.alias(n) for n, c in columns.items()))


@R.add("cover_fields", f"""WITH {_ORDERS} SELECT o_orderkey, 'cover' AS labels, nup, 'Requisição ' || k || '/2026 (' || c_mktsegment || ')' AS subject, CASE WHEN k % 3 > 0 THEN c_name END AS interested, '9º B ' || c_nationkey AS origin,
  '052.' || lpad(CAST(k % 90 AS VARCHAR), 2, '0') AS "class", 'S' || k % 7 AS section FROM o""")
def cover_fields(spark, d):
    k = F.col("k")
    text = _cat("PROCESSO NUP ", F.col("nup"), "\nASSUNTO: Requisição ", _s(k), "/2026 (", F.col("c_mktsegment"), ")\n", F.when(k % 3 > 0, _cat("INTERESSADO: ", F.col("c_name"), "\n")).otherwise(""), "Órgão de Origem: 9º B ", _s("c_nationkey"), F.when(k % 2 == 0, " Data da Criação: 01/02/2026").otherwise(""),
                "\nClassificação: 052.", _pad(k % 90, 2), "\nSEÇÃO: S", _s(k % 7), "\n")
    rows = _orders(spark, d).withColumn("text", text).withColumn("labels", F.array_join(classify.page_labels(F.upper("text")), ","))
    return _read(rows, fields.cover(F.col("text")), "labels")


@R.add("piece_rows", f"""WITH {_ORDERS}, p AS (SELECT k AS o_orderkey, unnest([{{'n': 1, 'name': 'Capa', 'status': 'documento_origem'}}, {{'n': 2, 'name': 'Requisição', 'status': 'ativo'}}, CASE WHEN k % 5 = 0 THEN {{'n': 3, 'name': 'Nota ' || k, 'status': 'desentranhado'}} END, {{'n': 5, 'name': c_mktsegment, 'status': 'nao_imprimivel'}}]) AS p FROM o)
SELECT o_orderkey, p.n AS piece_no, p.name AS name, p.status AS status FROM p WHERE p IS NOT NULL""")
def piece_rows(spark, d):
    k = F.col("k")
    text = _cat("x\nPEÇAS PROCESSUAIS\n1- Capa (a)\n2 – Requisição\n", F.when(k % 5 == 0, _cat("3- Nota ", _s(k), " (c)\n")).otherwise(""), "4- 12.3\n5- ", F.col("c_mktsegment"), " (b)\nLegenda: x\n9- Fora")
    return fields.pieces(_orders(spark, d).select(KEY, text.alias("text")), KEY).select(KEY, "piece_no", "name", "status")


_REQUISITION = f"""WITH {_ORDERS}, r AS (SELECT *, k % 2 = 0 AS one, '3390' || 30 + k % 10 AS nd, 'E6SUP' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS pi, '17' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS ptres, '160' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') AS ugr,
  '1' || lpad(CAST(k % 1000000000 AS VARCHAR), 9, '0') AS fonte, lpad(CAST(k % 1000 AS VARCHAR), 3, '0') AS pe, '16' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS unit FROM o)
SELECT o_orderkey, CAST(k % 1000 AS VARCHAR) AS number, 'Almox' AS sector, '9º B ' || c_nationkey || ' Sup' AS unit_name, nup, k % 28 + 1 || ' de março de 2026' AS "date", 'Ordenador ' || c_nationkey AS addressee, c_mktsegment || ' e outros' AS subject, CASE WHEN one THEN 'Lei ' || k ELSE k || ', de 2021' END AS law,
  ['Ordinário', 'Global', 'Estimativo'][k % 3 + 1] AS commitment_type, c_name AS supplier, tax AS tax_id, nc, CASE WHEN k % 4 = 0 THEN '2025NC000001' ELSE '' END AS more_nc, strftime(day, '%d/%m/%Y') AS nc_date, 'DGO' AS nc_issuer, nd, pi, ptres, ugr, fonte, '90' || pe || '/2025' AS bid, unit AS unit_code,
  CASE WHEN one THEN 'GER' ELSE 'PART' END AS participation, CASE WHEN NOT one THEN '59/2024' END AS contract, CASE WHEN NOT one THEN '160136' END AS managing_unit, CASE WHEN NOT one THEN 'Fulano ' || c_nationkey END AS inspector, unit AS bid_unit_code, CASE WHEN NOT one THEN '9º B Sup' END AS bid_unit_name,
  CASE WHEN one THEN 'aquisição de ' ELSE 'serviço de ' END || c_mktsegment AS bid_object,
  CASE WHEN one THEN 'NC ' || nc || ', de ' || strftime(day, '%d/%m/%Y') || ', do DGO, ND ' || nd || ', PI ' || pi || ', PTRES ' || ptres || ', UGR ' || ugr || ', FONTE ' || fonte || ' PE ' || pe || '/2025, UASG ' || unit || ' (GER)' ELSE nc || ', ND ' || nd || ' PE ' || pe END AS own_template FROM r"""


@R.add("requisition_fields", _REQUISITION)
def requisition_fields(spark, d):
    """Every field, in two written forms each; the second names the bid, a contract and a numbered template field."""
    k, kind = F.col("k"), F.element_at(F.array(*map(F.lit, ("Ordinário", "GLOBAL", "estimativo"))), (F.col("k") % 3 + 1).cast("int"))
    n, pe, unit, nation = _s(k % 1000), _pad(k % 1000, 3), _cat("16", _pad(k % 10_000, 4)), _s("c_nationkey")
    nd, day = _cat("ND 3390", _s(30 + k % 10)), F.date_format("day", "dd/MM/yyyy")
    codes = _cat(nd, ", PI E6SUP", _pad(k % 10_000, 4), ", PTRES 17", _pad(k % 10_000, 4), ", UGR 160", _pad(k % 1000, 3), ", FONTE 1", _pad(k % 1_000_000_000, 9))
    more = F.when(k % 4 == 0, "e NC 2025NC000001\n").otherwise("")
    first = _cat("Req nº ", n, "-Almox\nDo: Chefe da Sec ", _s(k % 7), " do 9º B ", nation, " Sup\nCampo Grande, MS, ", _s(k % 28 + 1), " de março de 2026.\nAo Sr Ordenador ", nation, "\nNUP: ", F.col("nup"), "\nAssunto: ", F.col("c_mktsegment"), " e outros\nReferência: Lei ", _s(k), "\nTipo de Empenho: ", kind,
                 "\nEmpresa: ", F.col("c_name"), " – CNPJ: ", F.col("tax"), "\nNC ", F.col("nc"), ", de ", day, ", do DGO, ", codes, "\nPE ", pe, "/2025, UASG ", unit, " (GER)\n\n", more, "aprovar despesas com a aquisição de ", F.col("c_mktsegment"), "\npor meio do PE")
    second = _cat("REQ. ", n, " – Almox/Cia Cmdo\nDo: Sec ", _s(k % 7), "/Cmdo 9º B ", nation, " Sup Ao: Sr OD\nCAMPO GRANDE – ", _s(k % 28 + 1), " de março de 2026\nAo  Sr. Ordenador ", nation, "\nNUP: ", F.col("nup"), "\nASSUNTO:\n", F.col("c_mktsegment"), " e outros\nLei Federal Nr ", _s(k), ", de 2021\n( x ) ", kind,
                  "\nNome da empresa: ", F.col("c_name"), "\nCNPJ: ", F.col("tax"), "\nNC ", F.col("nc"), " ", day, " da Diretoria de Gestão Orçamentária, ", codes, "\nPregão Eletrônico nº ", pe, "/2025 gerenciado pela UASG ", unit, " – 9º B Sup, órgão participante\n", more,
                  "CONTRATO Nº 59/2024, gerenciado pela UG 160136\nGestão e Fiscalização de Contrato: Fulano ", nation, "\naprovar as despesas com serviço de ", F.col("c_mktsegment"), " constante do termo\n7. Descrição do material\n", F.col("nc"), ", ", nd, "\n PE ", pe, "\n8. Fim")
    out = fields.requisitions(_orders(spark, d).withColumn("text", F.when(k % 2 == 0, first).otherwise(second)), KEY)
    return out.withColumns({"more_nc": F.array_join("more_nc", ","), **{f"bid_{n}": F.col("bid_details")[n] for n in ("unit_code", "unit_name", "object")}}).drop("bid_details")


@R.add("certificate_fields", f"""WITH {_ORDERS} SELECT o_orderkey, tax AS tax_id, c_name AS name, CASE WHEN k % 3 = 0 THEN 'Suspenso' ELSE 'Credenciado' END AS status, CAST(day AS VARCHAR) AS valid_to, CASE WHEN k % 2 = 0 THEN 'Consta' ELSE 'Nada Consta' END AS impediment, CAST(day + CAST(k % 50 AS INTEGER) AS VARCHAR) AS fgts,
  CASE WHEN k % 4 > 0 THEN CAST(day + 1 AS VARCHAR) END AS economic, CASE WHEN k % 5 = 0 THEN 'IRREGULAR' ELSE 'REGULAR' END AS debtor, 'TCU — Licitantes Inidôneos=Nada Consta; CNJ — Improbidade=' || CASE WHEN k % 7 = 0 THEN 'Consta' ELSE 'Nada Consta' END AS registers FROM o""")
def certificate_fields(spark, d):
    k, t = F.col("k"), F.col("text")
    date = lambda c: F.date_format(c, "dd/MM/yyyy")
    text = _cat("DADOS DO FORNECEDOR\nCNPJ: ", F.col("tax"), "\nRazão Social: ", F.col("c_name"), "\nSituação do Fornecedor: ", F.when(k % 3 == 0, "Suspenso").otherwise("Credenciado"), "\nVencimento do Cadastro: ", date("day"), "\nImpedimento de Licitar: ", F.when(k % 2 == 0, "Consta").otherwise("Nada Consta"),
                "\nFGTS Validade: ", date(F.date_add("day", (k % 50).cast("int"))), " Automática\n", F.when(k % 4 > 0, _cat("Qualificação Econômico-Financeira\nlinha\nValidade: ", date(F.date_add("day", 1)), "\n")).otherwise(""))
    debtor = _cat("CNPJ: ", F.col("tax"), "\nSituação para a Esfera Federal: ", F.when(k % 5 == 0, "Irregular").otherwise("Regular"), "\n")
    listed = _cat("Órgão Gestor: TCU\nCadastro: Licitantes Inidôneos\nResultado da consulta: Nada Consta\nÓrgão Gestor: CNJ\nCadastro: CNIA - Cadastro\npor Improbidade\noutra linha\nResultado da consulta: ", F.when(k % 7 == 0, "Consta").otherwise("Nada Consta"), "\n")
    rows = _orders(spark, d).withColumn("text", text)
    out = _read(rows, fields.sicaf(t), fields.cadin(debtor)["status"].alias("debtor"), fields.consolidated(listed)["registers"].alias("registers"))
    shown = F.array_join(F.transform("registers", lambda r: F.concat(r["short_name"], F.lit("="), r["result"])), "; ")
    return out.select(KEY, "tax_id", "name", "status", _s("valid_to").alias("valid_to"), "impediment", _s(F.try_element_at("validities", F.lit("fgts"))).alias("fgts"), _s(F.try_element_at("validities", F.lit("qualif_economica"))).alias("economic"), "debtor", shown.alias("registers"))


@R.add("contract_fields", f"""WITH {_ORDERS} SELECT o_orderkey, lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '/2024' AS contract_no, '160136' AS unit_code, 'COMANDO ' || c_nationkey AS contracting_name, '00.394.452/0001-03' AS contracting_tax_id, upper(c_mktsegment) || ' LTDA' AS contracted, tax AS contracted_tax_id,
  'Serviço de ' || lower(c_mktsegment) || ' e limpeza' AS object, translate(format('{{:,.2f}}', CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))), ',.', '.,') AS total, strftime(day, '%d/%m/%Y') AS valid_from, strftime(day + 365, '%d/%m/%Y') AS valid_to, k % 2 = 0 AS signed, CASE WHEN k % 2 = 0 THEN 'FULANO ' || c_nationkey || '; BELTRANA' ELSE 'FULANO ' || c_nationkey END AS signers, true AS real FROM o""")
def contract_fields(spark, d):
    k = F.col("k")
    text = _cat("TERMO DE CONTRATO\nCONTRATO DE PRESTAÇÃO DE SERVIÇOS Nº ", _pad(k % 1000, 3), "/2024, QUE FAZEM ENTRE SI\nCONTRATANTE: UNIÃO, POR INTERMÉDIO DO COMANDO ", _s("c_nationkey"), ", inscrita no CNPJ 00.394.452/0001-03\nCONTRATADA: ", F.upper("c_mktsegment"), " LTDA, inscrita no CNPJ ", F.col("tax"),
                "\nUASG 160136\nCLÁUSULA PRIMEIRA - OBJETO\n1.1. Serviço de ", F.lower("c_mktsegment"), "\ne limpeza\n1.2. x\nCLÁUSULA SEGUNDA\no prazo de vigência vai de ", F.date_format("day", "dd/MM/yyyy"), "\naté ", F.date_format(F.date_add("day", 365), "dd/MM/yyyy"), "\nvalor total de R$ ", S.format_amount(decimal("o_totalprice")),
                "\nassinado digitalmente\nFULANO ", _s("c_nationkey"), "\n", F.when(k % 2 == 0, "Documento assinado digitalmente\nw BELTRANA\n").otherwise(""))
    read = _read(_orders(spark, d).withColumn("text", text), fields.contract_document(F.col("text")))
    out = read.withColumn("real", fields.real_contract({n: F.col(n) for n in read.columns if n != KEY}))  # over the fields as they are read
    return out.select(KEY, "contract_no", "unit_code", "contracting_name", "contracting_tax_id", "contracted", "contracted_tax_id", "object", "total", "valid_from", "valid_to", "signed", F.array_join("signers", "; ").alias("signers"), "real")


@R.add("dispatch_fields", f"""WITH {_ORDERS} SELECT o_orderkey, CAST(k % 1000 AS INTEGER) AS number, 'Fisc Adm/CAF' AS sector, 'Cmdo ' || c_nationkey AS unit_name, (k % 28 + 1) || ' de fevereiro de 2026' AS date, 'aprovação da requisição ' || k AS subject, CASE k % 4 WHEN 0 THEN 'aprovacao_encaminhamento' WHEN 1 THEN 'aprovacao' WHEN 2 THEN 'restituicao' ELSE 'outro' END AS kind,
  'FULANO DE TAL - TC' AS signer, 'Ordenador de Despesas' AS role, k % 2 = 0 AS signed FROM o""")
def dispatch_fields(spark, d):
    k = F.col("k")
    verb = F.element_at(F.array(*map(F.lit, ("APROVO e ENCAMINHO", "Aprovo", "Restituo", "Ciente"))), (k % 4 + 1).cast("int"))
    text = _cat("Despacho Nº ", _s(k % 1000), "-Fisc Adm/CAF/Cmdo ", _s("c_nationkey"), "\nCampo Grande, MS, ", _s(k % 28 + 1), " de fevereiro de 2026\nAssunto: aprovação da\nrequisição ", _s(k), "\n\n1. ", verb, ".\n\nFULANO DE TAL - TC\nOrdenador de Despesas\n", F.when(k % 2 == 0, "assinado digitalmente").otherwise(""))
    out = _read(_orders(spark, d).withColumn("text", text), fields.dispatch(F.col("text")))
    return out.select(KEY, "number", "sector", "unit_name", "date", "subject", "kind", "signer", "role", "signed")


@R.add("standard_note_fields", f"""WITH {_ORDERS} SELECT o_orderkey, nc AS number, 'standard' AS format, '160073' AS issuer_code, strftime(day, '%d/%m/%Y') AS issue_date, '160136' AS favoured_code, CASE WHEN k % 3 < 2 THEN '1' END AS esf, '17' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS ptres, '1000000000' AS fonte, CASE WHEN k % 3 = 1 THEN '339030' ELSE '339000' END AS nd, '160073' AS ugr, 'I3DAFUNADOM' AS pi,
  CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS DOUBLE) AS balance, '27 FEV 26' AS deadline, 'Atender ' || k || '. Prazo de empenho 27 FEV 26.' AS note FROM o""")
def standard_note_fields(spark, d):
    k = F.col("k")
    amount, ptres = S.format_amount(decimal("o_totalprice")), _cat("17", _pad(k % 10_000, 4))
    barred = _cat("DESTINO | 1 | 160136 | 1 | ", ptres, " | 1000000000 | 339000 | 160073 | I3DAFUNADOM | R$ ", amount)
    plain = _cat("DESTINO 1 1 160136 1 ", ptres, " 1000000000 33.90.30 160073 I3DAFUNADOM R$\n", amount)
    loose = _cat("UG Favorecida: 160136 PTRES ", ptres, " FONTE 1000000000 ND 339000 UGR 160073 PI I3DAFUNADOM")
    text = _cat("Nota de Crédito Nº ", F.col("nc"), " da UG 160073\nUG EMITENTE     160073\nDATA EMISSÃO    ", F.date_format("day", "dd/MM/yyyy"), "\nVALOR TOTAL     ", amount, "\nDESCRIÇÃO       Atender\n", _s(k), ".\n Prazo de empenho 27 FEV 26.\n", F.when(k % 3 == 0, barred).when(k % 3 == 1, plain).otherwise(_cat("OBS ", loose)))
    out = fields.credit_notes(_orders(spark, d).select(F.col(KEY).alias("proc_id"), text.alias("text")))
    return out.select(F.col("proc_id").alias(KEY), "number", "format", "issuer_code", "issue_date", "favoured_code", "esf", "ptres", "fonte", "nd", "ugr", "pi", F.col("balance").cast("double").alias("balance"), "deadline", "note")


@R.add("terminal_note_fields", f"""WITH {_ORDERS},
l AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN '339030' WHEN 'A' THEN '339039' ELSE '339000' END AS nd, CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2)) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem),
f AS (SELECT l_orderkey, nd, arg_min(v, pos) AS balance, min(CASE WHEN nd = '339000' THEN 1000 ELSE 0 END + pos) AS pos FROM l GROUP BY l_orderkey, nd),
b AS (SELECT l_orderkey, arg_min(nd, pos) AS nd, CAST(arg_min(balance, pos) AS DOUBLE) AS balance, CAST(sum(balance) AS DOUBLE) AS total FROM f GROUP BY 1)
SELECT o_orderkey, CASE WHEN k % 6 > 0 THEN nc END AS number, 'terminal' AS format, '2026RO' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') AS siafi_no, '05FEV26' AS issue_date, '160502' AS issuer_code, 'DEPARTAMENTO ' || c_nationkey AS issuer_name, '160136' AS favoured_code, '30JUN26' AS deadline, nd, balance, total FROM o JOIN b ON l_orderkey = o_orderkey""")
def terminal_note_fields(spark, d):
    k = F.col("k")
    nd = F.when(F.col("l_returnflag") == "R", "339030").when(F.col("l_returnflag") == "A", "339039").otherwise("339000")
    line = lambda x, i: _cat(_pad((i + 1) % 1000, 3), " 301203       ", x["amount"], "\n     1  232180 1021000000 ", x["nd"], " 167504 E3PCFSCDEGE")
    row = F.struct("l_linenumber", "l_partkey", "l_extendedprice", nd.alias("nd"), S.format_amount(decimal("l_extendedprice")).alias("amount"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias(KEY)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), line), "\n").alias("lines"))  # the lines of an order
    head = _cat("DEMONSTRA-DIARIO\n", F.when(k % 6 > 0, _cat("DOCUMENTO WEB : ", F.col("nc"), "\n")).otherwise(""), "NUMERO : 2026RO", _pad(k % 1_000_000, 6), "\nDATA EMISSAO : 05FEV26\nUG/GESTAO EMITENTE : 160502 / 00001 - DEPARTAMENTO ", _s("c_nationkey"), " - GESTOR\nUG/GESTAO FAVORECIDA : 160136 / 00001 - 9 GRUPAMENTO\nOBSERVACAO\nEMPENHO ATE 30JUN26\nLANCADO POR X\n")
    rows = _orders(spark, d).join(lines.hint("shuffle_merge"), KEY).select(F.col(KEY).alias("proc_id"), _cat(head, F.col("lines")).alias("text"))
    out = fields.credit_notes(rows)
    return out.select(F.col("proc_id").alias(KEY), "number", "format", "siafi_no", "issue_date", "issuer_code", "issuer_name", "favoured_code", "deadline", "nd", F.col("balance").cast("double").alias("balance"), F.col("total").cast("double").alias("total"))


@R.add("item_rows", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, CAST(pos AS INTEGER) AS item_no, CASE WHEN pos % 3 < 2 THEN CAST(300000 + l_partkey % 90000 AS VARCHAR) END AS code, upper(p_name) || CASE WHEN pos % 2 = 0 THEN ' ' || p_brand ELSE '' END AS description, 'UND' AS unit, l_quantity AS qty, '30.' || lpad(CAST(l_partkey % 9 + 1 AS VARCHAR), 2, '0') AS nd_si,
  CAST(CAST(round(p_retailprice, 2) AS DECIMAL(18, 2)) AS DOUBLE) AS unit_price, CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2)) AS DOUBLE) AS total FROM l""")
def item_rows(spark, d):
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    l = l.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").withColumn("pos", pos)  # a given number is not joined to fewer: rows grow tenfold behind it
    none = F.lit(None).cast("string")
    code = _s(300_000 + F.col("l_partkey") % 90_000)
    here = F.when(F.col("pos") % 3 == 0, code)  # else it stands on the next row, if there is one before the next item
    main = F.array(_s("pos"), here, F.upper("p_name"), F.lit("UND"), _s(F.col("l_quantity").cast("int")), _cat("30.", _pad(F.col("l_partkey") % 9 + 1, 2)), S.format_brl(decimal("p_retailprice")), S.format_brl(decimal("l_extendedprice")))
    below = F.array(none, F.when(F.col("pos") % 3 == 1, code), F.when(F.col("pos") % 2 == 0, F.col("p_brand")), none, none, none, none, none)
    head = F.array(*map(F.lit, ("ITEM", "CATMAT", "DESCRIÇÃO", "UND", "QTD", "ND/S.I.", "P. UNT", "P TOTAL")))
    foot = F.array(F.lit("TOTAL"), *[none] * 6, F.lit("R$ 1,00"))
    row = lambda no, cells: F.struct(no.alias("row_no"), cells.alias("cells"))
    own = F.array(row(F.col("pos") * 2, main), row(F.col("pos") * 2 + 1, below))
    ends = F.when(F.col("pos") == 1, F.array(row(F.lit(0), head), row(F.lit(1_000_000), foot))).otherwise(F.array())  # the first line brings both ends of its table
    rows = l.select("l_orderkey", F.explode(F.concat(own, ends)).alias("r")).select("l_orderkey", "r.*")
    out = items.rows_to_items(rows, ("l_orderkey",))
    return out.select("l_orderkey", "item_no", "code", "description", "unit", *(F.col(c).cast("double").alias(c) for c in ("qty", "unit_price", "total")), "nd_si")


@R.add("cert_table", f"""
WITH s AS (SELECT s_suppkey AS k, s_nationkey, CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_acctbal > 0 THEN 1 ELSE 2 END AS reg FROM supplier),
c AS (SELECT k, unnest(CASE WHEN k % 7 = 0 THEN [{{'n': 'SICAF', 'r': 1}}] ELSE [
  {{'n': 'Credenciamento', 'r': CASE WHEN k % 5 = 0 OR k % 60 < 5 THEN 2 WHEN k % 60 - 5 <= 15 THEN 1 ELSE 0 END}}, {{'n': 'FGTS', 'r': CASE WHEN k % 40 < 10 THEN 2 WHEN k % 40 <= 25 THEN 1 ELSE 0 END}}, {{'n': 'Receita Federal', 'r': CASE WHEN k % 3 = 0 THEN 0 WHEN s_nationkey <= 15 THEN 1 ELSE 0 END}},
  {{'n': 'Impedimento de Licitar', 'r': reg}}, {{'n': 'Ocorr. Imped. Indiretas', 'r': k % 2}}, {{'n': 'Vínculo Serv. Público', 'r': CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END}}] END) AS c FROM s
  UNION ALL SELECT k, {{'n': 'CADIN', 'r': CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END}} FROM s UNION ALL SELECT k, CASE WHEN k % 11 = 0 THEN {{'n': 'Consulta Consolidada', 'r': 1}} ELSE {{'n': 'TCU', 'r': reg}} END FROM s)
SELECT k AS s_suppkey, string_agg(c.n, ', ' ORDER BY c.n) FILTER (c.r > 0) AS bad, CASE max(c.r) WHEN 2 THEN 'bloqueio' WHEN 1 THEN 'ressalva' ELSE 'conforme' END AS status FROM c GROUP BY 1""")
def cert_table(spark, d):
    k = F.col("s_suppkey")
    day = lambda n: F.date_add(as_of(), n.cast("int"))
    s = table(spark, d, "supplier")
    result = F.when(F.col("s_acctbal") > 5000, "Nada Consta").when(F.col("s_acctbal") > 0, "Sistema indisponível").otherwise("Consta")
    dates = F.create_map(F.lit("fgts"), day(k % 40 - 10), F.lit("receita_federal"), F.when(k % 3 > 0, day(F.col("s_nationkey"))))
    sicaf = s.filter(k % 7 > 0).select("s_suppkey", F.col("s_name").alias("tax_id"), F.when(k % 5 > 0, "Credenciado").otherwise("Suspenso").alias("status"), day(k % 60 - 5).alias("valid_to"), F.map_filter(dates, lambda n, v: v.isNotNull()).alias("validities"), result.alias("impediment"), F.when(k % 2 == 0, "Nada Consta").otherwise("Consta").alias("indirect"), F.when(k % 4 > 0, "Nada Consta").alias("public_link"))
    cadin = s.select("s_suppkey", F.col("s_name").alias("tax_id"), F.when(k % 3 > 0, "REGULAR").otherwise("IRREGULAR").alias("status"))
    listed = s.filter(k % 11 > 0).select("s_suppkey", F.array(F.struct(F.lit("TCU").alias("short_name"), result.alias("result"))).alias("registers"))
    rows = rules.certificate_rows(s.select("s_suppkey"), sicaf, cadin, listed, as_of(), "s_suppkey")
    bad = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != rules.OK, F.col("certificate")))), ", ")
    worst = rules.certificate_findings(rows, "s_suppkey").groupBy("s_suppkey").agg(rules.named(F.max(rules.rank(F.col("severity")))).alias("status"))
    return rows.groupBy("s_suppkey").agg(F.nullif(bad, F.lit("")).alias("bad")).join(worst.hint("shuffle_merge"), "s_suppkey")


@R.add("note_checks", f"""
WITH n AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderkey % 3 = o_custkey % 2) AS equal, bool_or(o_orderkey % 3 = 2) AS generic, sum(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))) AS balance, min(date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE))) AS days FROM orders GROUP BY 1),
i AS (SELECT o_custkey, sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2))) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_custkey, CASE WHEN equal THEN 'conforme' ELSE 'ressalva' END AS code, CASE WHEN balance > 0 AND total > 0 AND balance < total THEN 'ressalva' ELSE 'conforme' END AS balance, CASE WHEN days <= 15 THEN 'ressalva' ELSE 'conforme' END AS deadline, generic AND NOT equal AS generic FROM n LEFT JOIN i USING (o_custkey)""")
def note_checks(spark, d):
    orders = table(spark, d, "orders")
    nd = lambda c: F.element_at(F.array(*map(F.lit, ("339030", "339039", "339000"))), (c + 1).cast("int"))
    notes = orders.select("o_custkey", _s(KEY).alias("number"), nd(F.col(KEY) % 3).alias("nd"), decimal("o_totalprice").alias("balance"), S.days_left(F.to_date("o_orderdate"), as_of()).alias("days_left"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("deadline"))
    ident = orders.select("o_custkey").distinct().select("o_custkey", nd(F.col("o_custkey") % 2).alias("nd"))
    lines = table(spark, d, "lineitem").join(orders.select(KEY, "o_custkey"), F.col("l_orderkey") == F.col(KEY)).select("o_custkey", decimal("l_extendedprice").alias("total"))
    found = rules.note_findings(rules.note_totals(notes, ident, lines, "o_custkey"), "o_custkey")
    of = lambda seq: F.max(F.when(F.col("seq") == seq, F.col("severity")))
    return found.groupBy("o_custkey").agg(of(0).alias("code"), of(1).alias("balance"), of(2).alias("deadline"), F.bool_or((F.col("seq") == 0) & F.col("description").startswith("NC com ND genérica")).alias("generic"))


@R.add("code_checks", """
WITH i AS (SELECT l_orderkey, l_partkey % 3 AS e, l_partkey % 4 AS t FROM lineitem),
b AS (SELECT l_orderkey, (e = 0 AND t IN (1, 2)) OR (e = 1 AND t = 0) OR (e = 2 AND t = 1) AS bad FROM i)
SELECT l_orderkey, count(*) FILTER (bad) AS n_bad, NOT bool_or(bad) AS fine FROM b GROUP BY 1""")
def code_checks(spark, d):
    p = F.col("l_partkey")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (p % n + 1).cast("int"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("item_no"), at(("30.24", "39.05", "52.12"), 3).alias("nd_si"), at(("tinta", "vigilância", "veículo", "xyz"), 4).alias("description"))
    ident = table(spark, d, "orders").select(F.col(KEY).alias("l_orderkey"), F.lit("339030").alias("nd"))
    names = spark.createDataFrame([(30, 24, "x")], "element int, sub int, name string")
    elements = spark.createDataFrame([(30, "CONSUMO"), (39, "PJ"), (52, "PERMANENTE")], "element int, name string")
    found = rules.code_findings(lines, ident, names, elements, "l_orderkey")
    return found.groupBy("l_orderkey").agg(F.count_if(F.col("severity") != rules.OK).alias("n_bad"), F.bool_and(F.col("severity") == rules.OK).alias("fine"))


@R.add("identification_merge", f"""WITH {_ORDERS}, r AS (SELECT *, k % 3 > 0 AS has FROM o)
SELECT o_orderkey, coalesce(CASE WHEN k % 2 = 0 THEN nup END, CASE WHEN has THEN 'req' END) AS nup, CASE WHEN has THEN nc END AS nc, CASE WHEN has AND k % 4 = 1 THEN '059/2024' END AS contract, CASE WHEN has THEN '90004/2025' END AS bid, CASE WHEN has THEN c_mktsegment END AS object,
  CASE WHEN has AND k % 4 = 1 THEN 'Contrato 059/2024' WHEN has THEN 'PE 90004/2025 (GER)' END AS instrument, CASE WHEN has AND k % 4 = 1 THEN 'Contrato' WHEN has THEN 'Licitação' END AS type, coalesce(CASE WHEN has AND k % 5 > 0 THEN c_name END, 'SICAF ' || o_custkey) AS supplier FROM r""")
def identification_merge(spark, d):
    k, o = F.col("k"), _orders(spark, d)
    cover = o.select(F.col(KEY).alias("proc_id"), F.when(k % 2 == 0, F.col("nup")).alias("nup"))
    has = o.filter(k % 3 > 0)
    requisition = has.select(F.col(KEY).alias("proc_id"), F.lit("req").alias("nup"), "nc", F.when(k % 4 == 1, "059/2024").alias("contract"), F.lit("90004/2025").alias("bid"), F.lit("GER").alias("participation"), F.col("c_mktsegment").alias("subject"), F.when(k % 5 > 0, F.col("c_name")).alias("supplier"), F.col("tax").alias("tax_id"))
    sicaf = o.select(F.col(KEY).alias("proc_id"), F.col("tax").alias("tax_id"), _cat("SICAF ", _s("o_custkey")).alias("name"))
    out = reconcile.complete_supplier(reconcile.merge_identification(cover, requisition), sicaf)
    return out.select(F.col("proc_id").alias(KEY), "nup", "nc", "contract", "bid", "object", "instrument", "type", "supplier")


@R.add("note_gaps", f"""WITH {_ORDERS} SELECT o_orderkey, CASE WHEN k % 2 = 0 THEN '339039' ELSE '339030' END AS nd, CASE WHEN k % 4 > 0 THEN '160073' ELSE '160504' END AS ugr, CASE WHEN k % 5 = 0 THEN '1000000000' END AS fonte, CAST(CASE WHEN k % 3 = 0 THEN day + 30 ELSE day END AS VARCHAR) AS due,
  CAST(date_diff('day', DATE '{AS_OF}', CASE WHEN k % 3 = 0 THEN day + 30 ELSE day END) AS INTEGER) AS days_left, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS DOUBLE) AS balance FROM o""")
def note_gaps(spark, d):
    k, o = F.col("k"), _orders(spark, d)
    none = F.lit(None).cast("string")
    notes = o.select(F.col(KEY).alias("proc_id"), F.col("nc").alias("number"), F.when(k % 2 == 0, "339039").alias("nd"), F.when(k % 4 == 0, "160504").otherwise("").alias("ugr"), none.alias("ptres"), none.alias("fonte"), none.alias("pi"), F.when(k % 3 == 0, "30 DIAS após").otherwise(F.date_format("day", "dd/MM/yyyy")).alias("deadline"), F.date_format("day", "dd/MM/yyyy").alias("issue_date"), F.lit(None).cast("decimal(18,2)").alias("balance"), decimal("o_totalprice").alias("total"))
    copies = o.filter(k % 5 == 0).select(F.col(KEY).alias("proc_id"), F.lit(1).alias("page_no"), F.lit("FONTE DE RECURSO\n1000000000\nNATUREZA DA DESPESA 339030\nPLANO INTERNO I3DAFUNADOM").alias("text"), F.lit("ocr").alias("source"))
    ident = o.select(F.col(KEY).alias("proc_id"), F.lit("339030").alias("nd"), none.alias("ptres"), none.alias("fonte"), F.lit("160073").alias("ugr"), none.alias("pi"))
    out = reconcile.complete_notes(reconcile.complete_notes_from_mirror(notes, copies), ident, as_of())
    return out.select(F.col("proc_id").alias(KEY), "nd", "ugr", "fonte", _s("due").alias("due"), "days_left", F.col("balance").cast("double").alias("balance"))


#: Pages of every kind, as they are written, and the label that each gets.
PAGE_FORMS = (
    ("TERMO DE ABERTURA\nAutuo o presente processo", "opening"), ("EDITAL do certame, pregoeiro e equipe de apoio", "bid_notice"), ("continuação R$ 10,00 301234 TOTAL", "requisition"), ("Req nº {k}-Almox\nTipo de Empenho: Global", "requisition"),
    ("NOTA DE CRÉDITO {nc}", "credit_note"), ("2026NC000001 UG EMITENTE 160073", "credit_note"), ("TERMO DE CONTRATO {k}", "contract"), ("CLÁUSULA PRIMEIRA\nVIGÊNCIA de 12 meses", "contract"), ("DADOS DO FORNECEDOR\nSituação do Fornecedor: ok", "sicaf"),
    ("CADIN\nCréditos não quitados", "cadin"), ("Consulta Consolidada de Pessoa Jurídica\nResultado", "consolidated"), ("Check List do contrato", "checklist"), ("DESPACHO Nº {k}\nAPROVO", "dispatch"), ("Despacho nº {k}\nciente", "dispatch"), ("CHECK LIST das peças", "cover"), ("página {k} sem mais", "unclassified"),
    ("DADOS DO FORNECEDOR\nCADASTRAMENTO UNIFICADO DE FORNECEDORES\nNota de Crédito", "credit_note,sicaf"),
)


def _formed_pages(spark, d, proc):
    """A page for each order, in one of the forms."""
    texts = F.array(*(F.lit(t) for t, _ in PAGE_FORMS))
    text = F.replace(F.replace(F.element_at(texts, (F.col("k") % len(PAGE_FORMS) + 1).cast("int")), F.lit("{k}"), _s("k")), F.lit("{nc}"), F.col("nc"))
    return _orders(spark, d).select(F.col(proc).alias("proc_id"), F.col("k").alias("page_no"), text.alias("text"))


_COUNTED = ("opening", "dispatch", "credit_note", "requisition")


@R.add("label_totals", f"""WITH {_ORDERS}, f AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{label}')" for i, (_, labels) in enumerate(PAGE_FORMS) for label in labels.split(",")) + f""") t(form, label))
SELECT o_custkey, {", ".join(f"count(*) FILTER (label = '{n}') AS {n}" for n in _COUNTED)} FROM o JOIN f ON form = k % {len(PAGE_FORMS)} GROUP BY 1""")
def label_totals(spark, d):
    return classify.label_counts(classify.classify_pages(_formed_pages(spark, d, "o_custkey")), _COUNTED).withColumnRenamed("proc_id", "o_custkey")


@R.add("page_kinds", f"""WITH {_ORDERS}, f AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{label}')" for i, (_, label) in enumerate(PAGE_FORMS)) + f""") t(form, labels)) SELECT o_orderkey, labels FROM o JOIN f ON form = k % {len(PAGE_FORMS)}""")
def page_kinds(spark, d):
    labels = classify.classify_pages(_formed_pages(spark, d, KEY)).groupBy("proc_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return labels.withColumnRenamed("proc_id", KEY)


@R.add("machine_items", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, CASE WHEN n > 1 THEN 'numbers' ELSE 'single' END AS strategy, CAST(CASE WHEN n > 1 THEN 100 + pos ELSE 1 END AS INTEGER) AS item_no, CAST(300000 + l_partkey % 90000 AS VARCHAR) AS code, upper(p_name) || ' ' || CAST(l_quantity AS INTEGER) || ' KG' AS description, 'KG' AS unit, l_quantity AS qty,
  '30.' || lpad(CAST(l_partkey % 9 + 1 AS VARCHAR), 2, '0') AS nd_si, CAST(least(CAST(round(p_retailprice, 2) AS DECIMAL(18, 2)), CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS unit_price, CAST(greatest(CAST(round(p_retailprice, 2) AS DECIMAL(18, 2)), CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM l""")
def machine_items(spark, d):
    """Machine-read item texts, a text for each order: item number, code, description, quantity, budget code, two amounts."""
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    part = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("name"), S.format_brl(decimal("p_retailprice")).alias("listed"))  # written once for each part
    l = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("pos", pos)
    line = _cat(_s(F.col("pos") + 100), " - X ", _s(300_000 + F.col("l_partkey") % 90_000), " ", F.col("name"), " ", _s(F.col("l_quantity").cast("int")), " KG 30/", _pad(F.col("l_partkey") % 9 + 1, 2), " ", F.col("listed"), " ", S.format_brl(decimal("l_extendedprice")))
    texts = l.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", line.alias("t"))))["t"], "\n").alias("text"))  # the lines of an order
    out = items.texts_to_items(texts, ("l_orderkey",))
    return out.select("l_orderkey", "strategy", "item_no", "code", "description", "unit", *(F.col(c).cast("double").alias(c) for c in ("qty", "unit_price", "total")), "nd_si")


_BRIEF = ("Nome da Empresa: {n} CNPJ: {t}", "{t} - {n}\n", "{n} - CNPJ: {t}", "contratar da empresa {n}, CNPJ\n{t}", "Empresa : {n}\nfim {t}", "{n} {t}")


@R.add("brief_look_ups", f"""WITH {_ORDERS} SELECT o_orderkey, tax AS tax_id, c_name AS supplier, CASE k % 4 WHEN 0 THEN 'PE ' || (1000 + k % 9000) || '/2025' WHEN 1 THEN 'Contrato ' || (k % 900 + 1) || '/2024' WHEN 2 THEN 'Dispensa ' || (k % 900 + 1) || '/2024' END AS instrument,
  CASE WHEN k % 3 = 0 THEN 'S' || lpad(CAST(k % 900 AS VARCHAR), 3, '0') || '/2026' ELSE lpad(CAST(k % 900 AS VARCHAR), 2, '0') END AS requisition, CASE WHEN k % 3 = 0 THEN '2026' END AS year, ['Global', 'Ordinário', 'Estimativo'][k % 3 + 1] AS commitment, 'obs ' || k AS observation,
  CASE WHEN k % 4 = 1 THEN 'Contrato' WHEN k % 4 = 0 THEN 'Licitação' WHEN k % 3 = 1 THEN 'Licitação' ELSE 'Contrato' END AS type, CASE WHEN k % 2 = 0 THEN '9º B Sup' WHEN k % 5 > 0 THEN '18º B Trnp' END AS unit, '30.' || lpad(CAST(k % 9 + 1 AS VARCHAR), 2, '0') AS cell, 'LÂMPADA ' || c_mktsegment AS clean, CASE WHEN k % 2 = 0 THEN 'FGTS' ELSE 'Receita Federal' END AS certificate, k || ' 0 1' AS repaired FROM o""")
def brief_look_ups(spark, d):
    """Look-ups in short texts: supplier in six forms, instrument, requisition number, commitment, observation, dossier type, unit of a cover."""
    k = F.col("k")
    rows = _orders(spark, d).withColumn("near", F.replace(F.replace(F.element_at(F.array(*map(F.lit, _BRIEF)), (k % 6 + 1).cast("int")), F.lit("{n}"), F.col("c_name")), F.lit("{t}"), F.col("tax")))
    instrument = F.when(k % 4 == 0, _cat("por meio do PE ", _s(1000 + k % 9000), "/2025 e Contrato 9/2020")).when(k % 4 == 1, _cat("por meio do Contrato ", _s(k % 900 + 1), "/2024, PE 90004/2025")).when(k % 4 == 2, _cat("Dispensa de Licitação nº ", _s(k % 900 + 1), "/2024")).otherwise("nada")
    number = F.when(k % 3 == 0, _cat("ASSUNTO: Req n° S", _pad(k % 900, 3), "/2026 – Pel")).otherwise(_cat("Requisição ", _pad(k % 900, 2), "-Almox"))
    kind = F.element_at(F.array(*map(F.lit, ("Tipo de Empenho: GLOBAL", "( x ) Ordinário", "( X ) estimativo"))), (k % 3 + 1).cast("int"))
    rows = rows.select(KEY, "k", "c_mktsegment", fields.supplier_near_tax_id(F.col("near")).alias("s"), fields.instrument(instrument).alias("i"), fields.requisition_number(number).alias("r"), fields.commitment_type(kind).alias("commitment"), fields.observation(_cat('Obs: "obs ', _s(k), '"')).alias("observation"))
    none = F.lit(None).cast("string")
    kind = fields.dossier_type(F.when(k % 4 == 1, "1/2024"), F.lit(False), F.lit(False), F.when(k % 4 == 0, "1/2025").otherwise(none), F.col("commitment"))
    unit = reconcile.unit_from_cover(F.when(k % 2 == 0, "9º B Sup").otherwise(""), F.when(k % 5 > 0, "18º B Trnp").otherwise("Fulano"))
    coded = reconcile.fill_item_codes(rows.select(F.col(KEY).alias("proc_id"), none.alias("nd_si")), rows.select(F.col(KEY).alias("proc_id"), _cat("33.90.30.", _pad(k % 9 + 1, 2)).alias("nd"))).select(F.col("proc_id").alias(KEY), F.col("nd_si").alias("cell"))
    out = rows.select(KEY, "s.tax_id", "s.supplier", F.col("i.shown").alias("instrument"), F.col("r.raw").alias("requisition"), "r.year", "commitment", "observation", kind.alias("type"), unit.alias("unit"), S.clean_description(_cat("| LÂMPADA ", F.col("c_mktsegment"), " <R$ 1,00")).alias("clean"), S.certificate_name(F.when(k % 2 == 0, " fgts").otherwise("receita_federal")).alias("certificate"), S.repair_ocr(_cat(_s(k), " O l"), "number").alias("repaired"))
    return out.join(coded.hint("shuffle_merge"), KEY)
