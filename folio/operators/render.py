"""Rendering: template texts, their comparison, sentences and dispatch texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions.text import find, find_all, first_rule, matches, once, present


def joined_parts(*parts: Column) -> Column:
    """Present parts joined by one blank."""
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def _if(value: Column, text: Column) -> Column:
    return F.when(present(value).isNotNull(), text)


def template_text(r: dict[str, Column]) -> Column:
    """The template text of one credit note, by dossier type. ``r`` maps unit, number, sector, object, nc, nc_date, issuer, nd, fonte,
    ptres, ugr, pi, bid, contract, unit_code, participation, type to columns; absent values are null or empty.

    A comma follows a budget field only if a later one exists; without a unit code the last comma becomes a period."""
    v = lambda n: present(r.get(n, F.lit(None).cast("string")))
    comma = lambda *later: F.when(F.coalesce(*map(v, later)).isNotNull(), ",").otherwise("")
    unit = F.concat(F.coalesce(v("unit"), F.lit("—")), F.lit(","))
    req = F.when(v("number").isNotNull(), F.concat(F.lit("REQ "), v("number"), F.coalesce(F.concat(F.lit("-"), F.upper(v("sector"))), F.lit("")), F.lit(",")))
    obj = _if(v("object"), F.concat(v("object"), F.lit(",")))
    nc = F.when(v("nc").isNotNull(), F.concat(v("nc"), F.coalesce(F.concat(F.lit(", de "), v("nc_date")), F.lit("")), F.lit(",")))
    issuer = _if(v("issuer"), F.concat(S.with_preposition(v("issuer")), F.lit(",")))
    nd = lambda *later: F.concat(F.lit("ND "), v("nd"), comma(*later) if later else F.lit(","))
    ptres, ugr = F.concat(F.lit("PTRES "), v("ptres"), comma("ugr")), F.concat(F.lit("UGR "), v("ugr"))
    fonte, pi = F.concat(F.lit("FONTE "), v("fonte"), comma("ptres", "ugr")), F.concat(F.lit("PI "), v("pi"), F.lit(","))
    bid, disp, cont = (F.concat(F.lit(f"{w} "), v(n), F.lit(",")) for w, n in (("PE", "bid"), ("DISP", "bid"), ("CONT", "contract")))
    code = lambda part: F.concat(F.lit("UASG "), v("unit_code"), F.lit(" ("), part, F.lit(")."))
    part = F.coalesce(v("participation"), F.lit("GER"))
    kind = F.upper(F.coalesce(v("type"), F.lit("")))
    text = (
        F.when(F.contains(kind, F.lit("CONTRATO")), joined_parts(unit, req, obj, nc, issuer, nd("ptres", "ugr"), ptres, ugr, pi, cont, code(F.lit("GER"))))
        .when(F.contains(kind, F.lit("DISPENSA")), joined_parts(unit, disp, obj, nc, nd(), pi, disp, code(part)))
        .otherwise(joined_parts(unit, req, obj, nc, issuer, nd("fonte", "ptres", "ugr"), fonte, ptres, ugr, pi, bid, code(part)))
    )
    return F.regexp_replace(text, r",\z", ".")


#: Compared fields with their shown names, in order (fixed values).
COMPARED = {"nc": "NC", "nd": "ND", "pi": "PI", "pe": "PE (Pregão)", "cont": "Contrato", "uasg": "UASG", "fonte": "FONTE", "ptres": "PTRES", "ugr": "UGR"}


def compare_templates(rows: DataFrame, key: str, ours: str, theirs: str, compared: dict[str, str] | None = None, fields=None, numbers: str = r"(20\d{2}NC\d{6})", generic: str = "339000") -> DataFrame:
    """(key, field, ours, theirs) where both texts name a field differently; a generic code on their side is expected;
    numbers that only their text lists come last, sorted."""
    compared = compared or COMPARED

    def differs(t: dict[str, Column]) -> Column:
        out = []
        for k, name in compared.items():
            x, y = t["a"][k], t["b"][k]
            apart = S.comparable(x) != S.comparable(y)
            if k == "nd":
                apart = apart & (S.comparable(y) != generic)
            out.append(F.when(apart, F.struct(F.lit(name).alias("field"), x.alias("ours"), y.alias("theirs"))))
        out.append(F.when(F.size(t["extra"]) > 0, F.struct(F.lit("NCs adicionais").alias("field"), F.lit("—").alias("ours"), F.array_join(t["extra"], ", ").alias("theirs"))))
        return F.array_compact(F.array(*out))

    extra = F.array_sort(F.array_except(find_all(F.col(theirs), numbers, flags="(?d)"), find_all(F.col(ours), numbers, flags="(?d)")))
    both = present(F.col(ours)).isNotNull() & present(F.col(theirs)).isNotNull()
    # the tokens of both texts are columns of a step of their own, read once however often they are compared and shown
    step = rows.select(key, both.alias("_both"), S.template_tokens(F.col(ours), fields).alias("a"), S.template_tokens(F.col(theirs), fields).alias("b"), extra.alias("extra"))
    return step.select(key, F.explode(F.when(F.col("_both"), differs({n: F.col(n) for n in ("a", "b", "extra")}))).alias("d")).select(key, "d.*")


def sentence(text: Column) -> Column:
    """The sentence for a caveat; the rules are tried in order, a text that none fits is used as it stands, in lower case.

    Each rule looks for its words first, so that its pattern runs only on texts that can fit."""
    return once(F.struct(text.alias("text"), F.upper(text).alias("up")), lambda t: _sentence(t["text"], t["up"]))


def _sentence(text: Column, up: Column) -> Column:
    has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(up, F.lit(w)) for w in ws])
    g = lambda p, k=1: find(text, p, k)
    cat = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    expired, near, dated = r"([^\n]+?):\s*(\d{2}/\d{2}/\d{4})\s*\((\d+)\s*dias?\s*vencida?\)", r"([^\n]+?):\s*(\d{2}/\d{2}/\d{4})\s*\((\d+)\s*dias?\)", r"([^\n]+?):\s*(\d{2}/\d{2}/\d{4})"
    ids = r"(\w+):\s*([\d./-]+)\s*≠\s*Req:\s*([\d./-]+)"
    names = r'Requisição diz "(.+?)".*SICAF diz "(.+?)"'
    generic, codes = r"NC com ND genérica \((\S+)\).*Req usa (\S+)", r"NC:\s*(\S+)\s*≠\s*Req:\s*(\S+)"
    money = r"Saldo\s+(R\$\s*[\d.,]+)\s*<\s*(R\$\s*[\d.,]+)"
    differs = F.contains(text, F.lit("≠"))
    confirms = F.coalesce(cat(" (CNPJ ", g(r"CNPJ confere:\s*([\d./-]+)"), " confere)"), F.lit(""))
    rules = [
        (has("VENCID") & matches(text, expired), cat("a certidão de ", S.certificate_name(g(expired)), " no SICAF encontra-se VENCIDA desde ", g(expired, 2), " (", g(expired, 3), " dias).")),
        (has("DIA") & matches(text, near), cat("a certidão de ", S.certificate_name(g(near)), " no SICAF possui validade próxima (", g(near, 2), ", ", g(near, 3), " dias restantes).")),
        (has("FGTS", "RECEITA", "TRABALHISTA", "QUALIF", "MUNICIPAL", "ESTADUAL", "FEDERAL") & matches(text, dated), cat("a certidão de ", S.certificate_name(g(dated)), " no SICAF requer verificação (validade: ", g(dated, 2), ").")),
        (has("CNPJ DIVERGENTE") | (has("CNPJ") & differs), F.when(matches(text, ids), cat("o CNPJ constante no ", g(ids), " (", g(ids, 2), ") não corresponde ao CNPJ do fornecedor requisitado (", g(ids, 3), ").")).otherwise("o CNPJ do fornecedor diverge entre as peças do processo.")),
        (has("CNPJ NÃO EXTRAÍDO"), F.lit("não foi possível extrair o CNPJ da requisição para validação cruzada — verificar manualmente.")),
        (has("RAZÃO SOCIAL"), F.when(matches(text, names), cat('a razão social na requisição ("', g(names), '") diverge da razão social no SICAF ("', g(names, 2), '")', confirms, ".")).otherwise("a razão social diverge entre a requisição e o SICAF.")),
        (has("ND") & (differs | has("GENÉRICA", "GENERICA")), F.when(has("GENÉRICA", "GENERICA") & matches(text, generic), cat("a NC possui ND genérica (", g(generic), "), enquanto a requisição utiliza ND ", g(generic, 2), " — verificar necessidade de DETAORC.")).when(matches(text, codes), cat("a ND da NC (", g(codes), ") diverge da ND da requisição (", g(codes, 2), ").")).otherwise("a Natureza de Despesa (ND) diverge entre a NC e a requisição.")),
        (has("SALDO") & F.contains(text, F.lit("<")), F.when(matches(text, money), cat("o saldo disponível para empenho é de ", g(money), ", inferior ao valor da requisição (", g(money, 2), ").")).otherwise("o saldo da NC é inferior ao valor da requisição.")),
        (has("VENCIDO") & has("PRAZO"), F.coalesce(cat("o prazo de empenho da NC está vencido há ", g(r"VENCIDO há (\d+) dias"), " dias."), F.lit("o prazo de empenho da NC está vencido."))),
        ((has("URGENTE") | (has("PRAZO") & has("DIAS"))) & matches(text, r"(\d+)\s*dias\s*restantes"), cat("o prazo de empenho da NC possui apenas ", g(r"(\d+)\s*dias\s*restantes"), " dias restantes — urgente.")),
        (has("IMPEDIMENTO") & has("LICITAR"), F.lit("consta impedimento de licitar no SICAF.")),
        (has("CADIN") & has("IRREGULAR", "BLOQUEIO"), F.lit("a situação no CADIN encontra-se irregular.")),
        (has("TCU", "CNJ", "CEIS", "CNEP") & has("CONSTA"), cat("consta registro no ", first_rule([(has(w), F.lit(w)) for w in ("TCU", "CNJ", "CEIS", "CNEP")]), ", o que impede o andamento do processo.")),
        (has("SITUAÇÃO DO FORNECEDOR", "CREDENCIADO"), F.lit("a situação do fornecedor no SICAF não está como 'Credenciado'.")),
        (has("VÍNCULO") & has("SERVIÇO PÚBLICO"), F.lit("consta vínculo com Serviço Público no SICAF.")),
        (has("ITEM") & (has("CÁLCULO") | differs) & matches(text, r"Item\s+(\d+)", "(?d)"), cat("na tabela de requisição, o cálculo do item ", find(text, r"Item\s+(\d+)", flags="(?d)"), " apresenta divergência.")),
        (has("ITENS NÃO EXTRAÍDOS", "NENHUM ITEM"), F.lit("não foi possível extrair automaticamente os itens da tabela de requisição — verificar o layout da tabela no PDF.")),
        (has("OCORR") & has("IMPED"), F.lit("constam Ocorrências Impeditivas Indiretas no SICAF — verificar no Relatório de Ocorrências.")),
    ]
    return first_rule(rules, F.concat(F.rtrim(F.lower(text), F.lit(".")), F.lit(".")))


def dispatch_text(kind: Column, caveats: Column) -> Column:
    """Empty for an approval; else "Informo que" the first sentence, and "Adicionalmente," each further one."""
    said = F.transform(caveats, sentence)
    return F.when((kind == "approval") | (F.size(caveats) == 0), "").otherwise(F.concat(F.lit("Informo que "), F.array_join(said, " Adicionalmente, ")))


def dash(*columns: Column) -> Column:
    """The first present value, else a dash; for display only."""
    return F.coalesce(*(present(c) for c in columns), F.lit("—"))


def code_and_name(code: Column, name: Column) -> Column:
    return F.when(present(code).isNotNull() & present(name).isNotNull(), F.concat(code, F.lit(" — "), name)).otherwise(dash(code))
