"""Domain scalars: Brazilian amounts and dates, expenditure codes, numbers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import find, once, present, replace_all, squeeze

#: Month names (fixed values).
MONTHS = {"JAN": 1, "FEV": 2, "MAR": 3, "ABR": 4, "MAI": 5, "JUN": 6, "JUL": 7, "AGO": 8, "SET": 9, "OUT": 10, "NOV": 11, "DEZ": 12}
LONG_MONTHS = {"JANEIRO": 1, "FEVEREIRO": 2, "MARÇO": 3, "ABRIL": 4, "MAIO": 5, "JUNHO": 6, "JULHO": 7, "AGOSTO": 8, "SETEMBRO": 9, "OUTUBRO": 10, "NOVEMBRO": 11, "DEZEMBRO": 12}
#: Expenditure element to kind (fixed values).
ELEMENT_KINDS = {30: "material", 32: "material", 33: "passagem", 35: "servico", 36: "servico_pf", 37: "servico", 39: "servico_pj", 40: "servico", 47: "tributo", 51: "permanente", 52: "permanente"}


def money_strict(text: Column) -> Column:
    """``1.234,56`` to a decimal: dots go, the comma is the decimal mark; null if it is no number."""
    return F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def _tolerant(text: Column) -> Column:
    return once(F.regexp_replace(text, r"\s+", ""), _unpointed)


def _unpointed(plain: Column) -> Column:
    thousands = F.regexp_like(plain, F.lit(r"\A[^.]*\.[0-9]{3}\z"))
    return F.when(F.contains(plain, F.lit(",")), F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(thousands, F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain)


def money(text: Column) -> Column:
    """Like ``money_strict``, but the sign ``R$`` goes, and without a comma a lone dot is the decimal mark unless three digits follow."""
    common = F.regexp_like(text, F.lit(r"\A(?:R\$ ?)?[0-9.]+,[0-9]+\z"))  # as most are written: one search, no lambda
    return F.when(common, F.translate(text, ",R$. ", ".")).otherwise(_tolerant(F.regexp_replace(text, r"(?i)R\$", ""))).try_cast("decimal(18,2)")


def quantity(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"\A[0-9]+\z")), text).otherwise(_tolerant(text)).try_cast("decimal(18,4)")


def format_amount(amount: Column, digits: int = 2) -> Column:
    """``1.234,56``."""
    return F.translate(F.format_number(amount, digits), ",.", ".,")


def format_brl(amount: Column) -> Column:
    return F.concat(F.lit("R$ "), format_amount(amount))


def _month(name: Column, months: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in months.items() for x in kv)), F.upper(name))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def flexible_date(text: Column) -> Column:
    """A date in one of eight written forms, read from the start of the text: dd/mm/yyyy, dd/MMM/yyyy, d de mês de yyyy,
    d MMM yyyy, ddMMMyyyy, d MMM yy, ddMMMyy, dd/mm/yy. Four-digit years are tried before two-digit ones."""
    return F.element_at(F.transform(F.array(F.trim(text)), _flexible), 1)  # bound once, as every branch reads it


def _flexible(t: Column) -> Column:
    part = lambda p, k: F.nullif(F.regexp_extract(t, rf"(?U)\A{p}", k), F.lit(""))
    full = lambda p: (part(p, 3).cast("int"), part(p, 2), part(p, 1))
    short = lambda p: (F.lit(2000) + part(p, 3).cast("int"), part(p, 2), part(p, 1))
    numeric = r"([0-9]{2})/([0-9]{2})/([0-9]{4})(?![0-9])"
    named = r"([0-9]{2})/([A-Za-z]{3})/([0-9]{4})(?![0-9])"
    spelt = r"(?i:([0-9]{1,2})\s+de\s+(\w+)\s+de\s+([0-9]{4}))(?![0-9])"
    spaced = r"([0-9]{1,2})\s+([A-Za-z]{3})\s+([0-9]{4})(?![0-9])"
    joined = r"([0-9]{2})([A-Za-z]{3})([0-9]{4})(?![0-9])"
    spaced2 = r"([0-9]{1,2})\s+([A-Za-z]{3})\s+([0-9]{2})(?![0-9])"
    joined2 = r"([0-9]{2})([A-Za-z]{3})([0-9]{2})(?![0-9])"
    numeric2 = r"([0-9]{2})/([0-9]{2})/([0-9]{2})(?![0-9])"

    def by(parts, months=None):
        year, month, day = parts
        return _date(year, month if months is None else _month(month, months), day)

    return F.coalesce(by(full(numeric)), by(full(named), MONTHS), by(full(spelt), LONG_MONTHS), by(full(spaced), MONTHS), by(full(joined), MONTHS), by(short(spaced2), MONTHS), by(short(joined2), MONTHS), by(short(numeric2)))


def days_left(date: Column, as_of: Column) -> Column:
    return F.date_diff(date, as_of)


def expiry_status(days: Column, warn: int = 15) -> Column:
    """Expired blocks, up to ``warn`` days left is a caveat; unknown is fine."""
    return F.when(days < 0, "bloqueio").when(days <= warn, "ressalva").otherwise("conforme")


def expiry_label(days: Column) -> Column:
    return F.when(days < 0, F.concat(F.abs(days).cast("string"), F.lit(" dias vencida"))).when(days == 0, "vence hoje").otherwise(F.concat(days.cast("string"), F.lit(" dias")))


def element_item(code: Column) -> Column:
    """``EE.SS`` or ``EE`` from an expenditure code in any of its written forms; null if there is no element, or sub-element 00."""
    any_form = once(F.regexp_replace(F.regexp_replace(code, r"\s+", ""), r"[^0-9./]", ""), lambda s: once(_element_forms(F.when(F.length(s) <= 15, s)), _element_of_forms))
    # as most are written: one search, no lambda
    return F.when(F.regexp_like(code, F.lit(r"\A[0-9]{2}[./][0-9]{2}\z")), F.when(~code.endswith("00"), F.replace(code, F.lit("/"), F.lit(".")))).otherwise(any_form)


def _element_forms(s: Column) -> Column:
    """struct(pair, long, single): what each kind of written form gives."""
    pair = F.coalesce(*(F.nullif(F.regexp_replace(F.regexp_extract(s, p, 0), p, "$1.$2"), F.lit("")) for p in (r"\A33\.90\.([0-9]{2})[./]([0-9]{2})\z", r"\A3390([0-9]{2})/([0-9]{2})\z", r"\A([0-9]{2})[./]([0-9]{2})\z")))
    long = F.nullif(F.regexp_replace(F.regexp_extract(s, r"\A3390([0-9]{2})([0-9]{2})\z", 0), r"\A3390([0-9]{2})([0-9]{2})\z", "$1.$2"), F.lit(""))
    single = F.coalesce(*(F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (r"\A3390([0-9]{2})\z", r"\A33\.90\.([0-9]{2})\z", r"\A([0-9]{2})\z")))
    return F.struct(pair.alias("pair"), long.alias("long"), single.alias("single"))


def _element_of_forms(forms: Column) -> Column:
    pair, long, single = forms["pair"], forms["long"], forms["single"]
    return F.when(pair.isNotNull(), F.when(~pair.endswith(".00"), pair)).when(long.isNotNull(), F.when(long.endswith(".00"), F.substring(long, 1, 2)).otherwise(long)).when(single != "00", single)


def element_item_loose(code: Column) -> Column:
    """The side form: any prefix counts, an unknown form is returned as it stands."""
    s = F.nullif(F.regexp_replace(code, r"\s+", ""), F.lit(""))
    forms = (r"\A[0-9]{2}\.[0-9]{2}\.([0-9]{2})[./]([0-9]{2})\z", r"\A[0-9]{4}\.([0-9]{2})\.([0-9]{2})\z", r"\A([0-9]{2})[./]([0-9]{2})\z")
    return F.coalesce(*(F.nullif(F.regexp_replace(F.regexp_extract(s, p, 0), p, "$1.$2"), F.lit("")) for p in forms), s)


def element_sub(code: Column) -> Column:
    """struct(element, sub) from ``39.17``, ``33.90.39/24``, ``33.90.30``, ``339030`` or ``30/17``; nulls if none fits."""
    t = F.trim(code)
    head = F.substring_index(t, "/", 1)
    last = F.element_at(F.regexp_extract_all(head, F.lit(r"([0-9]+)"), F.lit(1)), -1).try_cast("int")
    slash = F.contains(t, F.lit("/"))
    element = F.when(slash, F.when(last > 99, last % 100).otherwise(last)).otherwise(F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("int") for p in (r"\A([0-9]{1,2})\.[0-9]{1,2}\z", r"\A(?:[^.]*\.){2,6}([0-9]+)\z", r"\A[0-9]{4}([0-9]{2})\z"))))
    sub = F.when(slash, F.nullif(F.regexp_extract(t, r"/\s*([0-9]+)\s*\z", 1), F.lit("")).try_cast("int")).otherwise(F.nullif(F.regexp_extract(t, r"\A[0-9]{1,2}\.([0-9]{1,2})\z", 1), F.lit("")).try_cast("int"))
    return F.struct(element.alias("element"), F.when(element.isNotNull(), sub).alias("sub"))


def element_of(code: Column) -> Column:
    """The element of a full six-digit code, dotted or not."""
    return F.nullif(F.regexp_extract(F.replace(F.trim(code), F.lit("."), F.lit("")), r"\A[0-9]{4}([0-9]{2})\z", 1), F.lit("")).try_cast("int")


def element_kind(element: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ELEMENT_KINDS.items() for x in kv)), element), F.lit("outro"))


def tax_id(text: Column) -> Column:
    """A tax id without its marks, for comparison."""
    return F.nullif(F.trim(F.regexp_replace(text, r"[./-]", "")), F.lit(""))


def contract_number(text: Column) -> Column:
    """The number before the slash padded to three digits; longer numbers stay."""
    t = F.trim(text)
    number, year = F.regexp_extract(t, r"\A([0-9]+)/", 1), F.regexp_extract(t, r"/(.*)\z", 1)
    return F.when((number != "") & (F.length(number) < 3), F.concat(F.lpad(number, 3, "0"), F.lit("/"), year)).otherwise(t)


def bid_number(text: Column) -> Column:
    """Five digits before the year: ``9014`` lacks a 0 after the 9, up to three digits lack the 90."""
    n, year = F.regexp_extract(text, r"\A\s*([^/]*?)\s*/([^/]*)\z", 1), F.trim(F.regexp_extract(text, r"\A([^/]*)/([^/]*)\z", 2))
    fixed = F.when(F.length(n) == 5, n).when((F.length(n) == 4) & n.startswith("9"), F.concat(F.lit("90"), F.substring(n, 2, 3))).when(F.length(n) <= 3, F.concat(F.lit("90"), F.lpad(n, 3, "0")))
    return F.when((n != "") & fixed.isNotNull(), F.concat(fixed, F.lit("/"), year)).otherwise(text)


def register_name(register: Column, agency: Column) -> Column:
    """The short name of a register of barred companies."""
    up, by = F.upper(register), F.upper(agency)
    has = lambda w: F.contains(up, F.lit(w))
    return (
        F.when(has("INID") & F.contains(by, F.lit("TCU")), "TCU — Licitantes Inidôneos")
        .when(has("CNIA") | has("IMPROBIDADE"), "CNJ — Improbidade")
        .when(has("INID") & has("SUSPENS"), "CEIS — Inidôneas/Suspensas")
        .when(has("CNEP") | has("PUNIDAS"), "CNEP — Empresas Punidas")
        .when(has("CEPIM"), "CEPIM — Impedidas")
        .when(has("CADICON") | has("ETCE"), "CADICON / eTCE")
        .otherwise(register)
    )


#: Certificate names that stay in capitals (fixed values).
CERTIFICATE_ACRONYMS = ("fgts", "cndt", "tcu", "cnj", "ceis", "cnep", "cadin", "sicaf")


def certificate_name(name: Column) -> Column:
    plain = F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit(" "))
    return F.when(plain.isin(*CERTIFICATE_ACRONYMS), F.upper(plain)).otherwise(F.initcap(plain))


#: Abbreviations of an object's words, in order (fixed values).
OBJECT_WORDS = (
    (r"\bAQUISI[ÇC][ÃA]O\b", "AQS"), (r"\bSERVI[ÇC]O[S]?\b", "SV"), (r"\bMANUTEN[ÇC][ÃA]O\b", "MNT"), (r"\bMATERIAL\b", "MAT"), (r"\bCONTRATO\b", "CONT"),
    (r"\bGÊNEROS?\b", "GEN"), (r"\bALIMENT[ÍI]CIOS?\b", "ALIMENTICIOS"), (r"\bSA[ÚU]DE\b", "SAÚ"), (r"\bLIMPEZA\b", "LIMP"), (r"\bELETR[ÔO]NIC[OA]?\b", "ELET"),
    (r"\bEXPEDIENTE\b", "EXPED"), (r"\bGR[ÁA]FICOS?\b", "GRAFICOS"), (r"\bESPORTIVO[S]?\b", "ESPORTIVO"), (r"\bPRESTAÇÃO\b", "PREST"),
)


def short_object(text: Column, words=OBJECT_WORDS, most: int = 6) -> Column:
    """Capitals, parentheses dropped, words abbreviated, at most ``most`` words."""
    t = replace_all(F.upper(F.trim(F.regexp_replace(text, r"\([^)\n]*\)", ""))), words)
    parts = F.split(squeeze(t), " ")
    return F.when(F.size(parts) > most, F.array_join(F.slice(parts, 1, most), " ")).otherwise(t)


#: Keyed fields of a template text (fixed values).
TEMPLATE_FIELDS = {
    "nc": (r"(20\d{2}NC\d{6})", ""), "nd": (r"\bND\s+(3[34]\d{4}|33\.90\.\d{2})", ""), "pi": (r"\bPI\s+([A-Z0-9]{6,15})", "i"), "pe": (r"\bPE\s+(\d{3,5}/\d{4})", ""), "cont": (r"\bCONT(?:RATO)?\s+(\d{1,3}/\d{4})", "i"),
    "uasg": (r"\bUASG\s+(\d{6})", ""), "fonte": (r"\bFONTE\s+(\d{10})", ""), "ptres": (r"\bPTRES\s+(\d{4,6})", ""), "ugr": (r"\bUGR\s+(\d{6})", ""),
}


def template_tokens(text: Column, fields=None) -> Column:
    """The keyed fields of a template text as a struct."""
    fields = fields or TEMPLATE_FIELDS
    value = {k: find(text, p, flags=f"(?d{f})") for k, (p, f) in fields.items()}
    if "nd" in value:
        value["nd"] = F.replace(value["nd"], F.lit("."), F.lit(""))
    return F.struct(*(v.alias(k) for k, v in value.items()))


def comparable(text: Column) -> Column:
    """Without blanks, dots and hyphens, in capitals."""
    return F.upper(F.regexp_replace(F.trim(text), r"[ .-]", ""))


def repair_ocr(text: Column, context: str = "text") -> Column:
    """Misread characters: lone l, O, S in a number; the currency sign in an amount."""
    t = F.replace(text, F.lit("ÍTEM"), F.lit("ITEM"))
    if context == "number":
        return replace_all(t, ((r"\bl\b", "1"), (r"\bO\b", "0"), (r"\bS\b", "5")), "(?U)")
    if context == "amount":
        for wrong in ("R5", "RS"):
            t = F.replace(t, F.lit(wrong), F.lit("R$"))
        return F.replace(t, F.lit("R "), F.lit("R$ "))
    return t


def clean_description(text: Column, least: int = 3) -> Column:
    """Stray marks, amounts and long numbers go; null if fewer than ``least`` characters are left."""
    marks = ((r"[|]", " "), (r"[\"'\[\]<>]", " "), (r"\S*[ªº;%!@#&=]+\S*", " "))
    unmarked = once(text, lambda t: F.when(F.regexp_like(t, F.lit(r"[|\"'\[\]<>=&#@!%;ºª]")), replace_all(t, marks, "(?U)")).otherwise(t))  # most hold none
    t = replace_all(unmarked, ((r"R\$\s*[0-9.,]+", " "), (r",[0-9]{2}\b", " "), (r"\b[0-9]{3,}\b", " ")), "(?U)")
    return once(F.rtrim(squeeze(t), F.lit("0123456789., ")), lambda d: F.when(F.length(d) >= least, d))


def with_preposition(acronym: Column) -> Column:
    return F.when(present(acronym).isNotNull(), F.concat(F.lit("do "), acronym)).otherwise("")


def without_marks(text: Column) -> Column:
    """Finding texts without their status signs."""
    return F.trim(F.regexp_replace(text, "(⚠️ |✅ |🟢 |🔴 |❌ )", ""))


def bid_display(number: Column) -> Column:
    """Where a bid comes from: five digits are a regular number."""
    return F.when(F.length(F.substring_index(number, "/", 1)) == 5, "regular").otherwise("outro")


def rebuilt_text(text: Column, rows: Column, enough: int = 100) -> Column:
    """The page's own text if long enough, else its grid's rows (arrays of cells) put together, whichever is longer."""
    own = F.coalesce(F.trim(text), F.lit(""))
    lines = F.transform(rows, lambda r: F.rtrim(F.array_join(F.transform(r, lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(" "))), "")))
    grid = F.array_join(F.filter(lines, lambda s: s != ""), "\n")
    return F.when(F.length(own) > enough, own).when(F.length(F.coalesce(grid, F.lit(""))) > F.length(own), grid).otherwise(own)
