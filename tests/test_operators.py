"""Merges, registries, streaming, entry points."""

from pyspark.sql import functions as F

from folio.operators import history, items, quality, reconcile, registry, render, rules
from folio.sources import keyed, tables
from folio.streaming import incremental


def bids(store):
    """Entries with their members, one row a bid."""
    out = store.entries("bid", ["unit_code", "unit_name", "object"], sets=["suppliers", "items", "dossiers"])
    for name in ("suppliers", "items", "dossiers"):
        out = out.join(store.members("bid", name, 10), "bid", "left")
    return out.collect()


def test_merge_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("9014/2024", "1", None, "obj", "ACME", "11.111.111/0001-11", "Tinta ", "P1", 1), ("90014/2024", "1", "U", "other", "ACME SA", "11111111000111", "tinta", "P2", 2), ("90014/2024", None, "V", None, "BETA", "22.222.222/0001-22", "Papel", "P1", 3)], "bid string, unit_code string, unit_name string, object string, supplier string, tax_id string, item string, proc_id string, used int")
    store_ = keyed.Keyed(spark, f"{tmp_path}/bids", buckets=4, spread=2)
    for batch in range(2):  # the same rows as another batch change nothing
        store_.merge(registry.bid_facts(rows), batch)
        (r,) = bids(store_)
        assert (r.bid, r.unit_code, r.unit_name, r.object, r.first_use, r.last_use) == ("90014/2024", "1", "U", "obj", 1, 3)
        assert r.dossiers == ["P1", "P2"] and len(r.suppliers) == 2 and r["items"] == ["Tinta ", "Papel"] and (r.n_suppliers, r.n_items, r.n_dossiers) == (2, 2, 2)


def test_contracts_and_units(spark, tmp_path):
    rows = spark.createDataFrame([("59/2024", "A", False, "P1", 1), ("059/2024", "B", True, "P2", 2), (None, "C", True, "P3", 3)], "contract string, contracted string, signed boolean, proc_id string, used int")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("tax_id", "object", "total", "valid_from", "valid_to")})
    store_ = keyed.Keyed(spark, f"{tmp_path}/contracts")
    store_.merge(registry.contract_facts(rows), 0)
    (x,) = store_.entries("contract", ["contracted", "object"], ["signed"], ["dossiers"]).collect()
    assert (x.contract, x.contracted, x.object, x.signed, x.n_dossiers) == ("059/2024", "A", None, True, 2) and store_.members("contract", "dossiers", 1).first().dossiers == ["P1"]
    units = spark.createDataFrame([("1", None, 1), ("1", "U", 2), (None, "V", 3)], "unit_code string, unit_name string, used int")
    assert [tuple(x) for x in registry.merge_units(units).select("unit_code", "unit_name", "first_use", "last_use").collect()] == [("1", "U", 1, 2)]


def test_decision_is_monotone_in_severity(spark):
    order = {"approval": 0, "caveat": 1, "rejection": 2}
    rows = [(f"{a}{b}{c}", s, i) for a in range(3) for b in range(3) for c in range(3) for i, s in enumerate((a, b, c))]
    f = spark.createDataFrame(rows, "proc_id string, r int, seq int").select("proc_id", F.lit("x").alias("family"), "seq", F.lit("c").alias("check"), F.lit("d").alias("description"), rules.named(F.col("r")).alias("severity"))
    for d in rules.decide(f).collect():
        assert order[d.type] == max(map(int, d.proc_id)) and len(d.caveats) + len(d.ok) == 3


def test_empty_tables(spark):
    f = spark.createDataFrame([], "proc_id string, family string, seq int, check string, description string, severity string")
    assert rules.decide(f).count() == 0
    rows = spark.createDataFrame([], "k string, o int, v string")
    assert reconcile.merge_records(rows, ["k"], "o", ["v"]).count() == 0


def test_null_keys_stay_apart(spark):
    rows = spark.createDataFrame([("a", "1", 1, ""), ("a", "1", 2, "x"), ("a", None, 1, "y"), ("a", None, 2, "z")], "p string, n string, o int, v string")
    got = sorted((r.n or "", r.v) for r in reconcile.merge_records(rows, ["p", "n"], "o", ["v"]).collect())
    assert got == [("", "y"), ("", "z"), ("1", "x")]


def test_sentences(spark):
    cases = {
        "fgts: 15/02/2026 (4 dias vencida)": "a certidão de FGTS no SICAF encontra-se VENCIDA desde 15/02/2026 (4 dias).",
        "receita_estadual: 15/02/2026 (4 dias)": "a certidão de Receita Estadual no SICAF possui validade próxima (15/02/2026, 4 dias restantes).",
        "CNPJ não extraído da requisição — verificar manualmente": "não foi possível extrair o CNPJ da requisição para validação cruzada — verificar manualmente.",
        "NC com ND genérica (339000) — Req usa 339030 — verificar DETAORC": "a NC possui ND genérica (339000), enquanto a requisição utiliza ND 339030 — verificar necessidade de DETAORC.",
        "ND — NC: 339030 ≠ Req: 339039 — verificar com analista": "a ND da NC (339030) diverge da ND da requisição (339039).",
        "Saldo R$ 1,00 < R$ 2,00 — pode haver": "o saldo disponível para empenho é de R$ 1,00, inferior ao valor da requisição (R$ 2,00).",
        "x — URGENTE: 3 dias restantes": "o prazo de empenho da NC possui apenas 3 dias restantes — urgente.",
        "Impedimento de Licitar: Consta": "consta impedimento de licitar no SICAF.",
        "CEIS — Inidôneas/Suspensas: Consta": "consta registro no CEIS, o que impede o andamento do processo.",
        "Item 3: 1,000 × R$ 2,00 = R$ 2,00 ≠ R$ 3,00 declarado": "na tabela de requisição, o cálculo do item 3 apresenta divergência.",
        "Outra Coisa.": "outra coisa.",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.s for r in df.select("i", render.sentence(F.col("t")).alias("s")).orderBy("i").collect()] == list(cases.values())


def test_search_and_latest(spark):
    rows = spark.createDataFrame([(1, "N1", "Ácme", "u", "PE", "ok", "2026-01-01"), (2, "N2", "Beta", "u", "acme x", "no", "2026-02-01"), (3, None, None, None, None, "ok", "2026-02-01")], "id int, nup string, supplier string, unit_name string, instrument string, result string, created string")
    assert [r.id for r in history.search(rows, "acme").collect()] == [2]
    assert [r.id for r in history.search(rows, None, result="ok", start="2026-01-01", end="2026-01-31").collect()] == [1]
    assert [r.id for r in history.latest(rows, 2, "created", "id").collect()] == [3, 2]


def test_safe_array(spark):
    assert [len(r.a) for r in spark.createDataFrame([('["x"]',), ("bad",), (None,)], "t string").select(tables.safe_array(F.col("t")).alias("a")).collect()] == [1, 0, 0]


def test_incremental_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 3), f"n{i}" if i > 2 else None, i) for i in range(12)], "unit_code string, unit_name string, used int")
    work = keyed.merge_into(f"{tmp_path}/out", registry.unit_facts)
    for k in (2, 0, 1):
        rows.filter(F.col("used") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.run_available(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", work)
    units = lambda: [tuple(r) for r in keyed.Keyed(spark, f"{tmp_path}/out").entries("unit_code", ["unit_name"]).orderBy("unit_code").collect()]
    want = [("0", "n3", 0, 9), ("1", "n4", 1, 10), ("2", "n5", 2, 11)]
    assert units() == want
    work(rows.filter("used % 3 = 1"), 2)  # delivered again
    assert units() == want


def test_missing_and_failures(spark):
    d = spark.createDataFrame([("A", "x"), ("B", "y")], "proc_id string, type string")
    l = spark.createDataFrame([("A", "cover")], "proc_id string, label string")
    r = spark.createDataFrame([("x", "cover"), ("x", "sicaf"), ("y", "cover")], "type string, label string")
    assert sorted(map(tuple, quality.missing_labels(d, l, r).collect())) == [("A", "sicaf"), ("B", "cover")]
    e = spark.createDataFrame([("A", 2), ("B", 1)], "proc_id string, want int")
    a = spark.createDataFrame([("A", 1)], "proc_id string, got int")
    out = quality.failures(e, a, "proc_id", [("few", "critical", F.col("got") < F.col("want"), F.lit("n")), ("none", "warning", F.col("got").isNull(), F.lit("m"))])
    assert sorted((r.proc_id, r.check) for r in out.collect()) == [("A", "few"), ("B", "none")]


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "decision" in e.queries()


def brute(names, aliases, exact_first=False):
    out = {}
    for n in names:
        up = (n or "").strip().upper()
        fits = [((0 if up == a.upper() else 1) if exact_first else 0, p, c) for p, a, c in aliases if a and up and (a.upper() in up or up in a.upper())]
        out[n] = min(fits)[2] if fits else None
    return out


def test_many_aliases_are_found_by_their_grams(spark, monkeypatch):
    """Short and long names, names in aliases and aliases in names, special characters, ties by priority, an exact match first."""
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdeé .*") for _ in range(n))
    aliases = [(i, word(rng.randint(1, 9)), f"c{i}") for i in range(700)] + [(900, "", "none"), (901, "zz", "two"), (902, "ZZ", "three"), (903, "quartel general do exército", "qge")]
    names = sorted({word(rng.randint(1, 14)) for _ in range(400)} | {"zz", "QUARTEL GENERAL", "", " ", "x" * 50})
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    dim = spark.createDataFrame(aliases, "priority int, alias string, acronym string")
    for few in (256, 10_000):
        monkeypatch.setattr(reconcile, "FEW_ALIASES", few)
        for exact in (False, True):
            got = {r.n: r.acronym for r in reconcile.alias_lookup(df, "n", dim, F.lit(None).cast("string"), exact_first=exact).collect()}
            assert got == brute([*names, None], aliases, exact)


def test_a_hundred_thousand_aliases(spark):
    dim = spark.range(100_000).select(F.col("id").cast("int").alias("priority"), F.concat(F.lit("batalhão "), F.md5(F.col("id").cast("string"))).alias("alias"), F.col("id").cast("string").alias("acronym"))
    names = spark.range(200).select(F.concat(F.lit("do Batalhão "), F.md5((F.col("id") * 500).cast("string")), F.lit(" / MS")).alias("n"), F.col("id"))
    out = reconcile.alias_lookup(names, "n", dim, F.lit(None).cast("string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.id: r.acronym for r in out.select("id", "acronym").collect()} == {i: str(i * 500) for i in range(200)}


def test_specification(spark):
    dossiers = spark.createDataFrame([("A", "Licitação", "90001/2025"), ("B", None, None)], "proc_id string, type string, bid string")
    labels = spark.createDataFrame([("A", x) for x in ("cover", "opening", "requisition", "sicaf", "cadin", "consolidated")] + [("B", "cover")], "proc_id string, label string")
    sent = spark.createDataFrame([("A", 1, "REPROVO"), ("A", 2, "sanada a falha"), ("A", 3, "ciente"), ("B", 1, "a restituir")], "proc_id string, page_no int, text string")
    sums = spark.createDataFrame([("A", 10.0, 10.0), ("B", 10.0, 12.0)], "proc_id string, total double, declared double").withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("total", "declared")})
    registered = spark.createDataFrame([("90001/2025", "1", 5.0, 10.0), ("90001/2025", "2", 5.0, 10.0)], "bid string, code string, unit_price double, qty double")
    sold = spark.createDataFrame([("A", 1, "1", 5.0, 9.0), ("A", 2, "2", 6.0, 9.0), ("A", 3, "3", 5.0, 9.0)], "proc_id string, item_no int, code string, unit_price double, qty double")
    got = sorted((r.proc_id, r.seq, r.description) for r in quality.specification_findings(dossiers, labels, sent, sums, spark, registered, sold).collect())
    assert got == [
        ("A", 0, "Peça obrigatória ausente: Edital/página do pregão"), ("A", 2, "Despacho de reprovação com correção posterior — verificar"), ("A", 4, "Item 2: preço difere do registrado"), ("A", 4, "Item 3: não consta do pregão"),
        *(("B", 0, f"Peça obrigatória ausente: {x}") for x in ("CADIN", "Consulta Consolidada", "Requisição", "SICAF", "Termo de Abertura")), ("B", 1, "Despachos encontrados: 1 de 3"), ("B", 2, "Despacho de reprovação sem correção posterior"), ("B", 3, "Soma dos itens R$ 10,00 ≠ total declarado R$ 12,00"),
    ]


def test_searches_are_written_down_once(spark):
    """A pattern in a branch or a lambda is not repeated for its null test, at any depth."""
    from folio.functions import scalars as S
    from folio.functions import text as T
    from folio.operators import fields

    rows = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = lambda c: rows.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    t = F.col("t")
    assert plan(fields.supplier_near_tax_id(t)).count("destinada") == 1 and plan(fields.instrument(t)["shown"]).count("Contrato)") == 1
    assert plan(fields.requisition_number(t)).count("Req\\s+") == 1 and plan(S.clean_description(t)).count("@#&=") == 1
    assert plan(F.coalesce(F.col("t"), T.find(t, "a(b)c"))).count("a(b)c") <= 1 and plan(T.Anchored(t, t).behind("k:")).count("k:") == 1


def test_filled_is_null_for_empty_texts_only(spark):
    from folio.functions.text import filled

    rows = spark.createDataFrame([(0, None), (1, ""), (2, " "), (3, "x")], "i int, t string")
    assert [r.f for r in rows.select("i", filled(F.col("t")).alias("f")).orderBy("i").collect()] == [None, None, " ", "x"]


def test_page_rows_are_spread_behind_the_join(spark):
    from folio.plans import page_queries

    plan = page_queries._orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("RepartitionByExpression") < plan.index("Join Inner")


def test_sizes_of_a_registry_hold_no_members(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None), (None, 1, "z")], "k string, o int, v string")
    out = registry.merge_registry(rows, "k", "o", "o", sizes={"vs": "v"})
    assert {r.k: r.n_vs for r in out.collect() if r.k} == {"a": 2, "b": 0} and "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def shuffled(df):
    """(names of its columns, its part of the plan) of each exchange, before adaptive execution changes the plan."""
    def below(node):
        found = [({node.output().apply(i).name() for i in range(node.output().size())}, node.toString())] if node.nodeName() == "Exchange" else []
        return found + [x for i in range(node.children().size()) for x in below(node.children().apply(i))]

    plan = df._jdf.queryExecution().executedPlan()
    return below(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)


def test_coded_items_are_judged_where_they_are_read(spark):
    """Items with a code of their own meet no other table; those without take the dossier's."""
    items = spark.createDataFrame([("A", 1, "30.24", "veículo"), ("A", 2, "30.24", "tinta"), ("B", 1, None, "vigilância"), ("C", 1, None, "tinta"), ("D", 1, "52.12", None), ("E", 1, None, "tinta")], "proc_id string, item_no int, nd_si string, description string")
    ident = spark.createDataFrame([("A", "339039"), ("B", "339030"), ("C", "33.90.30"), ("E", None)], "proc_id string, nd string")
    names, elements = spark.createDataFrame([(30, 24, "x")], "element int, sub int, name string"), spark.createDataFrame([(30, "CONSUMO")], "element int, name string")
    found = rules.code_findings(items, ident, names, elements)
    got = sorted((r.proc_id, r.check, r.description, r.severity) for r in found.collect())
    fits = ("ND/SI × Descrição dos itens", "ND/SI compatível com a descrição dos itens", "conforme")
    assert got == [
        ("A", "ND/SI × Descrição (Item 1)", "Item 1: ND indica MATERIAL DE CONSUMO (CONSUMO), mas descrição sugere EQUIPAMENTO PERMANENTE — verificar ND/SI", "ressalva"),
        ("B", "ND/SI × Descrição (Item 1)", "Item 1: ND indica MATERIAL (CONSUMO), mas descrição sugere SERVIÇO — verificar ND/SI", "ressalva"), ("C", *fits), ("D", *fits),
    ]
    counted = found.groupBy("proc_id").agg(F.count_if(F.col("severity") != rules.OK))
    with_texts = [plan for columns, plan in shuffled(counted) if columns & {"nd_si", "description"}]
    assert len(with_texts) == 2 and all("isnull(" in plan for plan in with_texts)  # only items without a code are shuffled with their texts


def test_shapes_are_told_only_in_tables_without_header(spark):
    """Whether a table has a header is known before a cell is held against the shapes."""
    rows = spark.createDataFrame([("A", 0, ["ITEM", "DESCRIÇÃO", "QTD"]), ("A", 1, ["1", "Tinta", "2"]), ("B", 0, ["7", "Uma descrição bem longa", "R$ 2,00", "R$ 4,00"]), ("B", 1, ["8", "Outra descrição bem longa", "R$ 3,00", "R$ 3,00"])], "t string, row_no int, cells array<string>")
    out = items.rows_to_items(rows, ("t",))
    got = sorted((r.t, r.item_no, r.description, r.qty and float(r.qty), r.total and float(r.total)) for r in out.collect())
    assert got == [("A", 1, "Tinta", 2.0, None), ("B", 7, "Uma descrição bem longa", None, 4.0), ("B", 8, "Outra descrição bem longa", None, 3.0)]
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    lowest = max(i for i, line in enumerate(lines) if line.lstrip("+-: ").startswith("Window "))
    shape = r"\A\d{1,5}\z"
    assert any(shape in line for line in lines[:lowest]) and not any(shape in line for line in lines[lowest:])


def test_findings_are_counted_without_their_texts(spark):
    """Both sides of a decision have as many findings as ``decide`` lists, with or without texts; the query makes no text of an item for that."""
    import __spark_entry__ as e

    rows = [("a", "x", "1", "ressalva"), ("a", "x", "1", "ressalva"), ("a", "y", None, "conforme"), ("b", "x", "1", "conforme"), ("c", "x", None, "bloqueio"), ("c", "y", "2", None)]
    found = spark.createDataFrame(rows, "k string, family string, description string, severity string")
    listed = {r.k: (r.type, len(r.caveats), len(r.ok)) for r in rules.decide(found, "k").collect()}
    assert {r.k: (r.type, r.n_caveats, r.n_ok) for r in rules.counted(found, "k").collect()} == listed == {"a": ("caveat", 2, 1), "b": ("approval", 0, 1), "c": ("rejection", 1, 1)}
    plan = e.queries()["decision"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "format_number" not in plan


def test_differing_names_are_quoted(spark):
    rows = spark.createDataFrame([(1, "N.1", "N.1", "A", "B %s"), (2, "N.1", "N.2", "A", "B"), (3, "N.1", None, "A", "B"), (4, "N.1", "N.1", "A", None)], "k int, own string, lo string, name string, other string")
    got = {r.k: (r.severity, r.description) for r in rules.name_findings(rows, "k", "name", "other", "own", "lo").collect()}
    assert got == {1: ("ressalva", 'Razão Social divergente: Requisição diz "A", SICAF diz "B %s" (CNPJ confere: N.1)'), 2: ("bloqueio", 'Razão Social divergente e CNPJ não confere: Req: "A" / SICAF: "B"'), 3: ("bloqueio", 'Razão Social divergente e CNPJ não confere: Req: "A" / SICAF: "B"')}
