"""Checks: each gives findings (check, description, severity) with severities conforme, ressalva, bloqueio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions.text import contains_count, once, present
from folio.operators.reconcile import dimension

OK, CAVEAT, BLOCK = "conforme", "ressalva", "bloqueio"
SEVERITY = {OK: 0, CAVEAT: 1, BLOCK: 2}


def rank(severity: Column) -> Column:
    return F.when(severity == BLOCK, 2).when(severity == CAVEAT, 1).otherwise(0)


def named(rank_: Column) -> Column:
    return F.when(rank_ == 2, BLOCK).when(rank_ == 1, CAVEAT).otherwise(OK)


def worst(*severities: Column) -> Column:
    return named(F.greatest(*map(rank, severities)))


def finding(check, description, severity) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(as_column(check).alias("check"), as_column(description).alias("description"), as_column(severity).alias("severity"))


def stacked(rows: DataFrame, keys: Sequence[str], findings: Sequence[Column], family: str | None = None) -> DataFrame:
    """One row per finding that is not null, numbered within its dossier and family."""
    out = rows.select(*keys, F.posexplode(F.array_compact(F.array(*findings))).alias("seq", "f")).select(*keys, "seq", "f.*")
    return out if family is None else out.withColumn("family", F.lit(family))


def stacked_families(rows: DataFrame, keys: Sequence[str], families: dict[str, Sequence[Column]]) -> DataFrame:
    """As ``stacked`` for several families at once: each numbers its own findings; the rows are read once."""

    def numbered(family: str, found: Sequence[Column]) -> Column:
        return F.transform(F.array_compact(F.array(*found)), lambda f, i: F.struct(F.lit(family).alias("family"), i.alias("seq"), f["check"].alias("check"), f["description"].alias("description"), f["severity"].alias("severity")))

    made = [numbered(family, found) for family, found in families.items()]
    return rows.select(*keys, F.explode(F.flatten(F.array(*made))).alias("f")).select(*keys, "f.seq", "f.check", "f.description", "f.severity", "f.family")


def tax_id_checks(base: str, others: dict[str, str]) -> list[Column]:
    """The requisition's tax id against those of the other documents (label -> column); documents without one are ignored."""
    name = "CNPJ cruzado entre peças"
    own = present(F.col(base))
    have = {label: present(F.col(c)) for label, c in others.items()}
    differ = {label: S.tax_id(c) != S.tax_id(own) for label, c in have.items()}
    blocks = [F.when(own.isNotNull() & d, finding(name, F.concat(F.lit(f"CNPJ divergente — {label}: "), have[label], F.lit(" ≠ Req: "), own), BLOCK)) for label, d in differ.items()]
    any_differs = F.exists(F.array(*(F.coalesce(d, F.lit(False)) for d in differ.values())), lambda x: x)
    listed = F.array_join(F.array_compact(F.array(*(F.when(c.isNotNull(), F.lit(label)) for label, c in have.items()))), ", ")
    nothing = F.coalesce(*have.values()).isNull()
    return [
        F.when(own.isNull(), finding(name, "CNPJ não extraído da requisição — verificar manualmente", CAVEAT)),
        F.when(own.isNotNull() & nothing, finding(name, "Nenhuma certidão com CNPJ para comparar", OK)),
        *blocks,
        F.when(own.isNotNull() & ~nothing & ~any_differs, finding(name, F.concat(F.lit("CNPJ consistente em todas as peças ("), listed, F.lit(")")), OK)),
    ]


def name_checks(name: str, other_name: str, tax_id: str, other_tax_id: str) -> list[Column]:
    """Equal names are fine; different ones with equal tax ids a caveat, else a block; a missing name gives no row."""
    check = "Razão Social (Req vs SICAF)"
    a, b = present(F.col(name)), present(F.col(other_name))
    same, same_id = F.upper(a) == F.upper(b), F.coalesce(S.tax_id(F.col(tax_id)) == S.tax_id(F.col(other_tax_id)), F.lit(False))
    both = F.concat(F.lit('Razão Social divergente: Requisição diz "'), a, F.lit('", SICAF diz "'), b, F.lit('" (CNPJ confere: '), F.col(other_tax_id), F.lit(")"))
    neither = F.concat(F.lit('Razão Social divergente e CNPJ não confere: Req: "'), a, F.lit('" / SICAF: "'), b, F.lit('"'))
    return [F.when(same, finding(check, F.concat(F.lit("Razão Social consistente: "), b), OK)).when(~same & same_id, finding(check, both, CAVEAT)).when(~same, finding(check, neither, BLOCK))]


def tax_id_findings(rows: DataFrame, key: str, base: str, others: dict[str, str]) -> DataFrame:
    return stacked(rows, [key], tax_id_checks(base, others), "tax_id")


def name_findings(rows: DataFrame, key: str, name: str, other_name: str, tax_id: str, other_tax_id: str) -> DataFrame:
    return stacked(rows, [key], name_checks(name, other_name, tax_id, other_tax_id), "name")


def identity_findings(rows: DataFrame, key: str, base: str, others: dict[str, str], name: str, other_name: str, other_tax_id: str) -> DataFrame:
    """Tax ids and company names, from one reading of the rows."""
    return stacked_families(rows, [key], {"tax_id": tax_id_checks(base, others), "name": name_checks(name, other_name, base, other_tax_id)})


def arithmetic_status(qty: Column, price: Column, total: Column, tolerance: float = 0.02) -> Column:
    """Quantity times price against the total; incomplete numbers are a caveat, none at all gives null."""
    some = F.coalesce(qty, price, total).isNotNull()
    full = qty.isNotNull() & price.isNotNull() & total.isNotNull()
    return F.when(full, F.when(F.abs(F.round(qty * price, 2) - total) > F.lit(tolerance).cast("decimal(4,2)"), CAVEAT).otherwise(OK)).when(some, CAVEAT)


def item_findings(items: DataFrame, dossiers: DataFrame, key: str = "proc_id") -> DataFrame:
    """Rows for items whose arithmetic differs; else one row that all is well, or that there are no items."""
    q, p, t = F.col("qty"), F.col("unit_price"), F.col("total")
    status = arithmetic_status(q, p, t)
    number = F.coalesce(F.col("item_no").cast("string"), F.lit("?"))
    wrong = F.concat(F.lit("Item "), number, F.lit(": "), S.format_amount(q, 3), F.lit(" × "), S.format_brl(p), F.lit(" = "), S.format_brl(F.round(q * p, 2)), F.lit(" ≠ "), S.format_brl(t), F.lit(" declarado"))
    said = F.coalesce(wrong, F.concat(F.lit("Item "), number, F.lit(": dados incompletos — verificar manualmente")))
    checked = items.withColumn("_status", status)
    bad = checked.filter(F.col("_status") == CAVEAT).select(key, F.concat(F.lit("Verificação de cálculo (Item "), number, F.lit(")")).alias("check"), said.alias("description"), F.lit(CAVEAT).alias("severity"))
    counts = dossiers.select(key).join(checked.groupBy(key).agg(F.count("_status").alias("n"), F.count_if(F.col("_status") == CAVEAT).alias("bad")), key, "left")
    rest = counts.filter(F.coalesce("bad", F.lit(0)) == 0).select(key, F.when(F.coalesce("n", F.lit(0)) > 0, finding("Cálculos da requisição", "Cálculos da requisição corretos", OK)).otherwise(finding("Itens da requisição", "Itens não extraídos automaticamente — verificar PDF", CAVEAT)).alias("f")).select(key, "f.*")
    return bad.unionByName(rest).withColumn("family", F.lit("items"))


#: Words that tell a description's kind (fixed values).
KEYWORDS = {
    "material": [
        "aquisição", "aquisicao", "aqs", "material", "produto", "fornecimento", "calha", "chapa", "parafuso", "prego", "tinta", "papel", "caneta",
        "vidro", "cimento", "areia", "madeira", "tubo", "fio", "cabo", "peça", "peca", "componente", "lâmpada", "lampada", "bateria", "medicamento",
        "alimento", "gênero", "genero", "uniforme", "tecido", "combustível", "combustivel", "lubrificante", "solvente", "filtro", "válvula",
        "valvula", "rolamento", "anel", "junta", "mangueira", "borracha", "plástico", "plastico", "aço", "aco", "ferro", "alumínio", "aluminio",
        "cobre", "inox", "impressora", "toner", "cartucho", "pilha", "esportivo", "copa", "cozinha", "limpeza", "higiene", "galvanizado",
        "chapa de aço", "calha",
    ],
    "servico": [
        "serviço", "servico", "manutenção", "manutencao", "mnt", "instalação", "instalacao", "remanejamento", "conserto", "reparo", "reparação",
        "reparacao", "limpeza e conservação", "vigilância", "vigilancia", "monitoramento", "contrato", "contratação", "contratacao", "prestação",
        "prestacao", "locação", "locacao", "aluguel", "assinatura", "consultoria", "assessoria", "treinamento", "capacitação", "hospedagem",
        "transporte", "frete", "energia elétrica", "água e esgoto", "telefone", "telecomunicação", "software", "licença", "licenca", "gráfico",
        "grafico", "impressão", "impressao", "preventiva", "corretiva",
    ],
    "permanente": [
        "equipamento", "mobiliário", "mobiliario", "veículo", "veiculo", "máquina", "maquina", "aparelho", "instrumento", "aeronave", "embarcação",
        "embarcacao", "armamento", "armamento",
    ],
}


def keyword_scores(text: Column, keywords: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """How many words of each list occur in the text."""
    low = F.lower(text)
    return {k: contains_count(low, ws) for k, ws in (keywords or KEYWORDS).items()}


def keyword_kind(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The list with strictly the most hits; null on a tie or without hits."""
    scores = keyword_scores(text, keywords)

    def highest(s: Column) -> Column:
        out = None
        for k in scores:
            above = F.lit(True)
            for other in scores:
                if other != k:
                    above = above & (s[k] > s[other])
            out = F.when(above, k) if out is None else out.when(above, k)
        return out

    return once(F.struct(*(s.alias(k) for k, s in scores.items())), highest)


def compatible(code_kind: Column, text_kind: Column) -> Column:
    """False where the code's kind contradicts the description's; unknown kinds never do."""
    service = code_kind.isin("servico", "servico_pj", "servico_pf")
    bad = ((code_kind == "material") & text_kind.isin("servico", "permanente")) | (service & (text_kind == "material")) | ((code_kind == "permanente") & (text_kind == "servico"))
    return ~F.coalesce(bad, F.lit(False))


def code_findings(items: DataFrame, ident: DataFrame, names: DataFrame, elements: DataFrame, key: str = "proc_id") -> DataFrame:
    """Items whose expenditure code does not fit their description; else one row that all fit. ``names(element, sub, name)`` and ``elements(element, name)`` are dimensions,
    ``ident`` has a row for each dossier.

    Only items without a code of their own meet the dossier's; the others are judged where they are read, and no description is shuffled for them."""
    own = items.withColumn("element", S.element_sub(F.col("nd_si"))["element"])
    rest = own.filter(F.col("element").isNull()).join(ident.select(key, F.col("nd").alias("_nd")), key, "left").withColumn("element", S.element_of(F.col("_nd"))).drop("_nd")
    rows = own.unionByName(rest).filter(F.col("element").isNotNull())
    kind, said = S.element_kind(F.col("element")), keyword_kind(F.col("description"))
    rows = rows.withColumn("_ok", once(F.struct(kind.alias("code"), said.alias("text")), lambda k: compatible(k["code"], k["text"])))
    shown = {"material": "MATERIAL", "servico": "SERVIÇO", "permanente": "EQUIPAMENTO PERMANENTE"}
    word = lambda c: F.when(c == "material", shown["material"]).when(c.startswith("servico"), shown["servico"]).otherwise(shown["permanente"])
    code_word = F.when((kind == "material") & (said == "permanente"), "MATERIAL DE CONSUMO").otherwise(word(kind))
    unfit = rows.filter(~F.col("_ok")).join(dimension(elements.select("element", F.col("name").alias("_element_name"))), "element", "left")
    name = F.coalesce("_element_name", F.concat(F.lit("Elemento "), F.col("element").cast("string")))
    unfit = unfit.withColumn("_text", F.concat(F.lit("ND indica "), code_word, F.lit(" ("), name, F.lit("), mas descrição sugere "), word(said)))
    number = F.coalesce(F.col("item_no").cast("string"), F.lit("?"))
    bad = unfit.select(key, F.concat(F.lit("ND/SI × Descrição (Item "), number, F.lit(")")).alias("check"), F.concat(F.lit("Item "), number, F.lit(": "), F.col("_text"), F.lit(" — verificar ND/SI")).alias("description"), F.lit(CAVEAT).alias("severity"))
    good = rows.groupBy(key).agg(F.bool_and("_ok").alias("_ok")).filter("_ok").select(key, F.lit("ND/SI × Descrição dos itens").alias("check"), F.lit("ND/SI compatível com a descrição dos itens").alias("description"), F.lit(OK).alias("severity"))
    return bad.unionByName(good).withColumn("family", F.lit("codes"))


def note_totals(notes: DataFrame, ident: DataFrame, items: DataFrame, key: str = "proc_id", generic: str = "339000") -> DataFrame:
    """Per dossier: whether any note's code equals the requisition's or is generic, the balances' and items' sums, the most urgent deadline."""
    plain = lambda c: F.replace(c, F.lit("."), F.lit(""))
    rows = notes.join(ident.select(key, F.col("nd").alias("nd_req")), key, "left")
    agg = rows.groupBy(key).agg(
        F.count("nd").alias("n_codes"), F.min("nd").alias("nd"), F.bool_or(plain(F.col("nd")) == plain(F.col("nd_req"))).alias("equal"), F.bool_or(plain(F.col("nd")) == generic).alias("generic"),
        F.first("nd_req", ignorenulls=True).alias("nd_req"), F.sum("balance").alias("balance"), F.min("days_left").alias("days_left"), F.min_by("deadline", F.struct("days_left", "number")).alias("deadline"), F.count("days_left").alias("n_deadlines"),
        F.min_by("number", F.struct("days_left", "number")).alias("urgent"),
    )
    totals = items.groupBy(key).agg(F.sum(F.coalesce("total", F.lit(0))).alias("items_total"))
    return agg.join(totals, key, "left")


def code_status(equal: Column, generic: Column) -> Column:
    return F.when(equal, OK).when(generic, CAVEAT).when(equal.isNotNull(), CAVEAT).otherwise(OK)


def balance_status(balance: Column, total: Column) -> Column:
    """Unknown or zero sums are not judged."""
    known = (balance > 0) & (total > 0)
    return F.when(known & (balance < total), CAVEAT).otherwise(OK)


def deadline_status(days: Column) -> Column:
    return F.when(days <= 15, CAVEAT).otherwise(OK)


def deadline_text(days: Column, shown: Column) -> Column:
    return (
        F.when(days.isNull(), "— (prazo não extraído)").when(days < 0, F.concat(F.lit("VENCIDO há "), F.abs(days).cast("string"), F.lit(" dias ("), shown, F.lit(")")))
        .when(days <= 7, F.concat(shown, F.lit(" — URGENTE: "), days.cast("string"), F.lit(" dias restantes"))).when(days <= 15, F.concat(shown, F.lit(" — "), days.cast("string"), F.lit(" dias (atenção: pode vencer antes do empenho)")))
        .otherwise(F.concat(shown, F.lit(" — "), days.cast("string"), F.lit(" dias restantes")))
    )


def note_findings(totals: DataFrame, key: str = "proc_id") -> DataFrame:
    c = F.col
    code = F.when(c("n_codes").isNull() | (c("n_codes") == 0) | c("nd_req").isNull(), F.concat(F.lit("— ("), F.coalesce("nd", "nd_req", F.lit("não extraído")), F.lit(")"))).when(c("equal"), F.concat(c("nd"), F.lit(" = "), c("nd_req"))).when(
        c("generic"), F.concat(F.lit("NC com ND genérica ("), c("nd"), F.lit(") — Req usa "), c("nd_req"), F.lit(" — verificar DETAORC"))).otherwise(F.concat(F.lit("NC: "), c("nd"), F.lit(" ≠ Req: "), c("nd_req"), F.lit(" — verificar com analista")))
    code_sev = F.when(c("nd_req").isNull() | (c("n_codes") == 0), OK).otherwise(code_status(c("equal"), c("generic")))
    known = (c("balance") > 0) & (c("items_total") > 0)
    money = F.when(~F.coalesce(known, F.lit(False)), "— (saldo não extraído)").when(c("balance") >= c("items_total"), F.concat(S.format_brl(c("balance")), F.lit(" ≥ "), S.format_brl(c("items_total")))).otherwise(F.concat(F.lit("Saldo "), S.format_brl(c("balance")), F.lit(" < "), S.format_brl(c("items_total")), F.lit(" — pode haver saldo complementar de outras datas")))
    urgent = F.when(c("n_deadlines") > 1, F.concat(F.lit(" — NC mais urgente: "), c("urgent"))).otherwise("")
    return stacked(totals, [key], [
        finding("ND da NC vs ND da Requisição", code, code_sev),
        finding("Saldo vs Valor Requisição", money, balance_status(c("balance"), c("items_total"))),
        finding("Prazo de empenho", F.concat(deadline_text(c("days_left"), F.coalesce("deadline", F.lit("—"))), urgent), F.when(c("days_left").isNull(), OK).otherwise(deadline_status(c("days_left")))),
    ], "notes")


def register_status(result: Column, fine: Sequence[str] = ("NADA CONSTA",), otherwise: str = BLOCK) -> Column:
    """Unavailable is a caveat, one of the fine words is fine, anything else as given; a missing result is a caveat."""
    up = F.upper(result)
    good = F.lit(False)
    for w in fine:
        good = good | F.contains(up, F.lit(w))
    return F.when(result.isNull(), CAVEAT).when(F.contains(up, F.lit("INDISPONÍVEL")) | F.contains(up, F.lit("INDISPONIVEL")), CAVEAT).when(good, OK).otherwise(otherwise)


#: Shown names of the certificates (fixed values).
CERTIFICATES = {"receita_federal": "Receita Federal", "fgts": "FGTS", "trabalhista": "Trabalhista (CNDT)", "receita_estadual": "Receita Estadual", "receita_municipal": "Receita Municipal", "qualif_economica": "Qualif. Econômico-Financeira"}


def certificate_rows(dossiers: DataFrame, sicaf: DataFrame, cadin: DataFrame, consolidated: DataFrame, as_of: Column, key: str = "proc_id") -> DataFrame:
    """(key, certificate, result, validity, status): the supplier register's rows, the debtor register's, and one per barred-company register; a missing document is a caveat."""
    row = lambda name, result, validity, status: F.struct(F.lit(name).alias("certificate") if isinstance(name, str) else name.alias("certificate"), result.alias("result"), validity.alias("validity"), status.alias("status"))
    none = F.lit("—")
    left = lambda d: S.days_left(d, as_of)
    shown = lambda d: F.when(d.isNotNull(), F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" ("), S.expiry_label(left(d)), F.lit(")"))).otherwise("—")
    s = dossiers.select(key).join(sicaf, key, "left")
    v = lambda k: F.try_element_at(F.col("validities"), F.lit(k))
    cred = worst(F.when(F.col("status") == "Credenciado", OK).otherwise(BLOCK), F.coalesce(S.expiry_status(left(F.col("valid_to"))), F.lit(OK)))
    rows = F.array(
        row("Credenciamento", F.concat_ws(" — ", "tax_id", F.coalesce("status", none)), F.when(F.col("valid_to").isNotNull(), F.concat(F.lit("Cadastro: "), shown(F.col("valid_to")))).otherwise("—"), cred),
        *(row(n, none, shown(v(k)), S.expiry_status(left(v(k)))) for k, n in CERTIFICATES.items()),
        row("Impedimento de Licitar", F.coalesce("impediment", F.lit("não extraído")), none, register_status(F.col("impediment"))),
        row("Ocorr. Imped. Indiretas", F.coalesce(F.substring_index("indirect", ".", 1), F.lit("não extraído")), none, F.when(F.contains(F.upper("indirect"), F.lit("NADA CONSTA")), OK).otherwise(CAVEAT)),
        row("Vínculo Serv. Público", F.coalesce("public_link", F.lit("não extraído")), none, register_status(F.col("public_link"))),
    )
    missing = lambda n: F.array(row(n, F.lit("Não encontrado no PDF"), none, F.lit(CAVEAT)))
    first = s.select(key, F.explode(F.when(F.col("tax_id").isNotNull(), rows).otherwise(missing("SICAF"))).alias("r"))
    c = dossiers.select(key).join(cadin, key, "left")
    second = c.select(key, F.explode(F.when(F.col("tax_id").isNotNull(), F.array(row("CADIN", F.concat_ws(" — ", "tax_id", F.coalesce("status", none)), none, F.when(F.col("status").isin("REGULAR", "NADA CONSTA"), OK).otherwise(register_status(F.col("status"), ()))))).otherwise(missing("CADIN"))).alias("r"))
    k = dossiers.select(key).join(consolidated, key, "left")
    listed = F.transform("registers", lambda r: row(r["short_name"], F.coalesce(r["result"], none), none, register_status(r["result"])))
    third = k.select(key, F.explode(F.when(F.size(F.coalesce("registers", F.array())) > 0, listed).otherwise(missing("Consulta Consolidada"))).alias("r"))
    return first.unionByName(second).unionByName(third).select(key, "r.*")


def certificate_findings(certificates: DataFrame, key: str = "proc_id") -> DataFrame:
    """A row for each certificate that is not fine; one row if all are."""
    text = F.concat(F.col("certificate"), F.lit(": "), F.when(F.col("validity") != "—", F.col("validity")).otherwise(F.col("result")))
    bad = certificates.filter(F.col("status") != OK).select(key, F.lit("Certidões").alias("check"), text.alias("description"), F.col("status").alias("severity"))
    good = certificates.groupBy(key).agg(F.count_if(F.col("status") != OK).alias("n")).filter("n = 0").select(key, F.lit("Certidões").alias("check"), F.lit("Todas as certidões regulares e vigentes").alias("description"), F.lit(OK).alias("severity"))
    return bad.unionByName(good).withColumn("family", F.lit("certificates"))


def contract_findings(rows: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Checks of a contract document joined with its requisition (contract, tax_id) and register (sicaf_tax_id): number, ids, signatures, validity."""
    c = F.col
    plain = lambda n: F.regexp_replace(n, r"\A0+", "")
    number = F.when(c("contract").isNotNull() & c("contract_no").isNotNull(), F.when(plain(c("contract")) == plain(c("contract_no")), finding("Nº Contrato", F.concat(F.lit("Número confere: "), c("contract_no")), OK)).otherwise(finding("Nº Contrato", F.concat(F.lit("Divergência: requisição="), c("contract"), F.lit(", documento="), c("contract_no")), BLOCK))).when(
        c("contract").isNotNull(), finding("Nº Contrato", F.concat(F.lit("Número "), c("contract"), F.lit(" na requisição, mas não encontrado no documento")), CAVEAT))
    own = F.when(c("contracted_tax_id").isNotNull() & c("tax_id").isNotNull(), F.when(c("contracted_tax_id") == c("tax_id"), finding("CNPJ Contratada", F.concat(F.lit("CNPJ confere: "), c("contracted_tax_id")), OK)).otherwise(finding("CNPJ Contratada", F.concat(F.lit("Divergência: contrato="), c("contracted_tax_id"), F.lit(", requisição="), c("tax_id")), BLOCK)))
    other = F.when(c("contracted_tax_id") != c("sicaf_tax_id"), finding("CNPJ (Contrato vs SICAF)", F.concat(F.lit("Contrato="), c("contracted_tax_id"), F.lit(", SICAF="), c("sicaf_tax_id")), BLOCK))
    signed = F.when(c("signed"), finding("Assinaturas", F.concat(F.lit("Contrato assinado digitalmente ("), F.size("signers").cast("string"), F.lit(" assinantes)")), OK)).otherwise(finding("Assinaturas", "Assinaturas digitais não detectadas no documento", CAVEAT))
    until = F.try_to_date(c("valid_to"), "d/M/yyyy")
    days = S.days_left(until, as_of)
    valid = F.when(c("valid_to").isNull(), F.lit(None)).when(days.isNull(), finding("Vigência", F.concat(F.lit("Data de vigência não pôde ser interpretada: "), c("valid_to")), CAVEAT)).when(days <= 0, finding("Vigência", F.concat(F.lit("Contrato vencido desde "), c("valid_to"), F.lit(" ("), (-days).cast("string"), F.lit(" dias)")), BLOCK)).otherwise(
        finding("Vigência", F.concat(F.lit("Vigente até "), c("valid_to"), F.lit(" ("), days.cast("string"), F.lit(" dias restantes)")), F.when(days > 30, OK).otherwise(CAVEAT)))
    return stacked(rows, [key], [number, own, other, signed, valid], "contract")


def _kind(worst: Column) -> Column:
    return F.when(worst == 2, "rejection").when(worst == 1, "caveat").otherwise("approval")


def counted(findings: DataFrame, key: str = "proc_id") -> DataFrame:
    """The type of ``decide`` and how many findings stand on each of its two sides; their texts are neither made nor shuffled for it."""
    sev = rank(F.col("severity"))
    return findings.groupBy(key).agg(_kind(F.max(sev)).alias("type"), F.count_if(sev > 0).alias("n_caveats"), F.count_if(sev == 0).alias("n_ok"))


def decide(findings: DataFrame, key: str = "proc_id", partial: bool = False) -> DataFrame:
    """One decision per dossier: any block rejects, any caveat approves with caveats; the texts of both sides in order of family and number."""
    f = findings if "seq" in findings.columns else findings.withColumn("seq", F.lit(0))
    sev = rank(F.col("severity"))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("family").alias("a"), F.coalesce("seq", F.lit(0)).alias("b"), S.without_marks(F.col("description")).alias("t"))))), lambda x: x["t"])
    rows = f.groupBy(key).agg(F.max(sev).alias("worst"), listed(sev > 0).alias("caveats"), listed(sev == 0).alias("ok"))
    title = F.when(F.col("worst") == 2, "REPROVAÇÃO").when(F.col("worst") == 1, "APROVAÇÃO COM RESSALVA").otherwise("APROVAÇÃO (PARCIAL — AGUARDANDO NC)" if partial else "APROVAÇÃO")
    return rows.select(key, _kind(F.col("worst")).alias("type"), title.alias("title"), "caveats", "ok")


def stage_status(findings: DataFrame, key: str, family: str = "family") -> DataFrame:
    """The worst severity of each set of checks."""
    return findings.groupBy(key, family).agg(named(F.max(rank(F.col("severity")))).alias("status"))
