"""Bindings over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions.text import around, cascade, find, find_all, find_by, find_distinct, first_rule, hits, matches, segments, which
from folio.operators import classify, fields, items, quality, texts
from folio.operators.history import completeness, summary
from folio.plans.bindings import Registry, table

R = Registry()
EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+)"
PHONE = r"(\+[0-9][0-9 ().-]+[0-9])"
ADDRESS = r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"
WORDS = ("the ", "que ", "und ", "licen", "@", "[0-9]{3}", "[#*%&]")


@R.add("page_usable", f"""
SELECT source, count(*) AS n, count(*) FILTER (length(trim(text)) > 600 AND NOT regexp_matches(text, '{classify.FOOTER.replace("'", "''")}')) AS n_usable,
  count(*) FILTER (length(trim(text)) < 400) AS n_short FROM documents GROUP BY source""")
def page_usable(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(classify.usable(text, 600)).alias("n_usable"), F.count_if(classify.scanned(text, 400)).alias("n_short"))


@R.add("k_of_n_labels", "SELECT doc_id, n_hits, n_hits >= 3 AS labelled FROM (SELECT doc_id, " + " + ".join(f"CAST(regexp_matches(text, '{w}') AS INTEGER)" for w in WORDS) + " AS n_hits FROM documents)")
def k_of_n_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", hits(F.col("text"), WORDS, "(?d)").alias("n_hits")).select("doc_id", "n_hits", (F.col("n_hits") >= 3).alias("labelled"))


@R.add("page_classify", f"""
WITH p AS (SELECT doc_id, lang, CASE WHEN regexp_matches(text, '{EMAIL}') THEN ['mail'] WHEN regexp_matches(text, 'Licen[sc]e|LICEN[SC]E') THEN ['licence'] WHEN length(text) < 300 THEN ['short'] END AS one,
  list_filter([CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END, CASE WHEN regexp_matches(text, '[#*%&]') THEN 'symbols' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END], lambda x: x IS NOT NULL) AS many FROM documents),
l AS (SELECT lang, unnest(CASE WHEN one IS NOT NULL THEN one WHEN len(many) > 0 THEN many ELSE ['unclassified'] END) AS label FROM p)
SELECT lang, label, count(*) AS n FROM l GROUP BY lang, label""")
def page_classify(spark, d):
    t = F.col("text")
    one = classify.exclusive_label([("mail", matches(t, EMAIL, "(?d)")), ("licence", matches(t, "Licen[sc]e|LICEN[SC]E", "(?d)")), ("short", F.length(t) < 300)])
    many = classify.multi_label([("digits", matches(t, "[0-9]", "(?d)")), ("symbols", matches(t, "[#*%&]", "(?d)")), ("lines", F.contains(t, F.lit("\n")))])
    labels = F.when(one.isNotNull(), F.array(one)).when(F.size(many) > 0, many).otherwise(F.array(F.lit("unclassified")))
    return table(spark, d, "documents").select("lang", F.explode(labels).alias("label")).groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


GATE = ("ing", "que", "tion", "ent")


@R.add("running_gate", f"""
WITH g AS (SELECT conv_id, turn, {", ".join(f"max(CAST(regexp_matches(text, '{p}') AS INTEGER)) OVER w AS g{i}" for i, p in enumerate(GATE))} FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, CAST(g0 + g1 + g2 + g3 AS INTEGER) AS anti, g0 + g1 + g2 + g3 < 2 AS open FROM g""")
def running_gate(spark, d):
    rows = classify.running_gate(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], "text", GATE, 2, "(?d)")
    return rows.select("conv_id", "turn", "anti", "open")


CASCADE = {"mail": EMAIL, "phone": PHONE, "address": ADDRESS}


@R.add("field_cascade", f"""
SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '{EMAIL}', 1)), ''), nullif(trim(regexp_extract(text, '{PHONE}', 1)), ''), nullif(trim(regexp_extract(text, '{ADDRESS}', 1)), '')) AS contact,
  CASE WHEN regexp_matches(text, '{EMAIL}') THEN 'mail' WHEN regexp_matches(text, '{PHONE}') THEN 'phone' WHEN regexp_matches(text, '{ADDRESS}') THEN 'address' END AS kind FROM documents""")
def field_cascade(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", cascade(t, EMAIL, PHONE, ADDRESS, flags="(?d)").alias("contact"), which(t, CASCADE, "(?d)").alias("kind"))


@R.add("repeat_extract", """
WITH f AS (SELECT doc_id, regexp_extract_all(text, '([0-9]{2,6})', 1) AS a FROM documents)
SELECT doc_id, a[1] AS main, len(list_distinct(a)) - CASE WHEN len(a) > 0 THEN 1 ELSE 0 END AS n_more, len(a) AS n_all FROM f""")
def repeat_extract(spark, d):
    rows = table(spark, d, "documents").select("doc_id", find_all(F.col("text"), "([0-9]{2,6})", flags="(?d)").alias("a"), find_distinct(F.col("text"), "([0-9]{2,6})", flags="(?d)").alias("u"))
    more = F.size(F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(0))))
    return rows.select("doc_id", F.try_element_at("u", F.lit(1)).alias("main"), more.cast("long").alias("n_more"), F.size("a").cast("long").alias("n_all"))


@R.add("text_by_group", """
SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (text <> '' AND turn < 2)) AS first_md5, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (text <> '')) AS all_md5
FROM conversations GROUP BY conv_id""")
def text_by_group(spark, d):
    rows = texts.first_then_all(table(spark, d, "conversations"), "conv_id", "turn", "text", 2)
    return rows.select("conv_id", F.md5(F.nullif("first_text", F.lit(""))).alias("first_md5"), F.md5(F.nullif("all_text", F.lit(""))).alias("all_md5"))


@R.add("line_pairing", """
WITH l AS (SELECT *, lead(role, 1) OVER w AS r1, lead(role, 2) OVER w AS r2, lead(role, 3) OVER w AS r3, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(text, 3) OVER w AS t3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(CASE WHEN r1 = 'assistant' THEN t1 WHEN r1 = 'user' THEN NULL WHEN r2 = 'assistant' THEN t2 WHEN r2 = 'user' THEN NULL WHEN r3 = 'assistant' THEN t3 END) AS answer_md5 FROM l WHERE role = 'user'""")
def line_pairing(spark, d):
    rows = texts.pair_following(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant", F.col("text"), 3)
    return rows.select("conv_id", "turn", F.md5("paired").alias("answer_md5"))


@R.add("continuation_merge", """
SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS group_no, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS asked
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def continuation_merge(spark, d):
    rows = texts.continuation_groups(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user")
    rows = texts.carried(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.length("text")), "asked")
    return rows.select("conv_id", "turn", "group_no", F.col("asked").cast("long").alias("asked"))


@R.add("lookahead_fill", """
WITH e AS (SELECT *, CASE WHEN value >= 20 THEN value END AS v, event_type = 'signup' AS stop FROM events),
l AS (SELECT *, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2, coalesce(lead(stop, 1) OVER w, false) AS s1, coalesce(lead(stop, 2) OVER w, false) AS s2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(v, CASE WHEN NOT s1 THEN v1 END, CASE WHEN NOT s1 AND NOT s2 THEN v2 END) AS filled FROM l""")
def lookahead_fill(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("value") >= 20, F.col("value")))
    return texts.filled_ahead(rows, "user_id", ["ts", "event_id"], "v", 2, F.col("event_type") == "signup", "filled").select("event_id", "filled")


@R.add("segment_text", """
WITH s AS (SELECT doc_id, text, list_filter(string_split(replace(text, 'The ', chr(1) || 'The '), chr(1)), lambda x: starts_with(x, 'The ')) AS p, strpos(text, ', ') AS pos FROM documents)
SELECT doc_id, len(p) AS n_segments, md5(p[1]) AS first_md5, CASE WHEN pos > 0 THEN substr(text, greatest(pos - 10, 1), pos - greatest(pos - 10, 1) + 20) END AS near FROM s""")
def segment_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", segments(F.col("text"), "The ").alias("p"), around(F.col("text"), F.lit(", "), 10, 20).alias("near"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_segments"), F.md5(F.try_element_at("p", F.lit(1))).alias("first_md5"), "near")


@R.add("expected_vs_actual", """
WITH e AS (SELECT doc_id, n_chars AS expected, length(text) AS actual, regexp_matches(text, '[#*%&]') AS odd FROM documents),
f AS (SELECT 'length' AS "check", 'critical' AS severity FROM e WHERE expected <> actual UNION ALL SELECT 'long', 'warning' FROM e WHERE actual > 5000 UNION ALL SELECT 'symbols', 'warning' FROM e WHERE odd)
SELECT "check", severity, count(*) AS n FROM f GROUP BY ALL""")
def expected_vs_actual(spark, d):
    docs = table(spark, d, "documents")
    expected = docs.select("doc_id", F.col("n_chars").alias("expected"))
    actual = docs.select("doc_id", F.length("text").alias("actual"), matches(F.col("text"), "[#*%&]", "(?d)").alias("odd"))
    checks = [("length", "critical", F.col("expected") != F.col("actual"), F.lit("")), ("long", "warning", F.col("actual") > 5000, F.lit("")), ("symbols", "warning", F.col("odd"), F.lit(""))]
    return quality.report(quality.failures(expected, actual, "doc_id", checks))


@R.add("summary", f"""
WITH f AS (SELECT d.doc_id, nullif(regexp_extract(text, '{EMAIL}', 1), '') AS mail, nullif(regexp_extract(text, '{PHONE}', 1), '') AS phone, l.quality FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))
SELECT 'mail' AS field, count(mail) AS found, count(*) AS n_rows, count(*) FILTER (mail IS NULL AND phone IS NULL AND quality IS NULL) AS n_empty FROM f
UNION ALL SELECT 'phone', count(phone), count(*), count(*) FILTER (mail IS NULL AND phone IS NULL AND quality IS NULL) FROM f
UNION ALL SELECT 'quality', count(quality), count(*), count(*) FILTER (mail IS NULL AND phone IS NULL AND quality IS NULL) FROM f""")
def summary_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id", find(F.col("text"), EMAIL, flags="(?d)").alias("mail"), find(F.col("text"), PHONE, flags="(?d)").alias("phone"))
    rows = docs.join(table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left")
    found, _ = summary({c: F.col(c) for c in ("mail", "phone", "quality")})
    return completeness(rows, ["mail", "phone", "quality"], n_empty=F.count_if(F.size(found) == 0))


@R.add("cell_map", """
WITH c AS (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS cells FROM pages),
m AS (SELECT page_id, cells, list_transform(cells, lambda x: CASE WHEN regexp_matches(x, 'example') THEN 'host' WHEN regexp_matches(x, '^[a-z][a-z]$') THEN 'lang' WHEN regexp_matches(x, '^[0-9]') THEN 'number' END) AS k FROM c)
SELECT page_id, cells[list_position(k, 'host')] AS host, cells[list_position(k, 'lang')] AS lang, nullif(cells[list_position(k, 'number')], '') AS number FROM m""")
def cell_map(spark, d):
    cells = F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/")
    rows = table(spark, d, "pages").select("page_id", cells.alias("cells"))
    kinds = {"host": "example", "lang": r"\A[a-z][a-z]\z", "number": r"\A[0-9]"}
    named = F.transform("cells", lambda c: items.kind_of(c, kinds))
    names = F.array_distinct(F.array_compact(named))
    rows = rows.withColumn("m", F.map_from_arrays(names, F.transform(names, lambda n: F.array_position(named, n).cast("int"))))
    return rows.select("page_id", *(items.cell(F.col("cells"), F.col("m"), n).alias(n) for n in kinds))


@R.add("missing_pieces", """
WITH q AS (SELECT d.doc_id, d.lang FROM documents d),
r AS (SELECT * FROM (VALUES ('en', 'digits'), ('en', 'lines'), ('fr', 'lines'), ('de', 'digits'), ('es', 'lines')) t(lang, label)),
h AS (SELECT doc_id, 'digits' AS label FROM documents WHERE regexp_matches(text, '[0-9]') UNION SELECT doc_id, 'lines' FROM documents WHERE contains(text, chr(10)))
SELECT q.doc_id, r.label FROM q JOIN r USING (lang) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = q.doc_id AND h.label = r.label)""")
def missing_pieces(spark, d):
    docs = table(spark, d, "documents")
    labels = docs.select("doc_id", F.explode(classify.multi_label([("digits", matches(F.col("text"), "[0-9]", "(?d)")), ("lines", F.contains("text", F.lit("\n")))])).alias("label"))
    required = spark.createDataFrame([("en", "digits"), ("en", "lines"), ("fr", "lines"), ("de", "digits"), ("es", "lines")], "lang string, label string")
    return quality.missing_labels(docs, labels, required, "doc_id", "lang")


@R.add("piece_list", r"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_pieces, count(*) FILTER (regexp_matches(line, ',$')) AS n_marked, min(length(regexp_extract(line, '^([A-Z][a-z]+) ', 1))) AS shortest
FROM s WHERE regexp_matches(line, '^[A-Z][a-z]+ .*$') GROUP BY doc_id""")
def piece_list(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(matches(F.col("line"), r"^[A-Z][a-z]+ .*$", "(?d)"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.count_if(matches(F.col("line"), ",$", "(?d)")).alias("n_marked"), F.min(F.length(F.regexp_extract("line", "(?d)^([A-Z][a-z]+) ", 1))).cast("long").alias("shortest"))


@R.add("document_extract", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[#*%&]{3}') THEN 'marked' WHEN contains(text, '@') THEN 'mail' ELSE 'plain' END AS format,
  nullif(regexp_extract(text, '(' || source || '[^ ]*)', 1), '') AS own_source, nullif(regexp_extract(text, substr(text, 1, 2) || '([a-z]+)', 1), '') AS keyed FROM documents WHERE regexp_matches(substr(text, 1, 2), '^[A-Z][a-z]$')""")
def document_extract(spark, d):
    t = F.col("text")
    kind = first_rule([(matches(t, "[#*%&]{3}", "(?d)"), F.lit("marked")), (F.contains(t, F.lit("@")), F.lit("mail"))], F.lit("plain"))
    key = F.substring(t, 1, 2)
    rows = table(spark, d, "documents").filter(matches(key, "^[A-Z][a-z]$", "(?d)"))
    own = find_by(t, F.concat(F.lit("("), F.col("source"), F.lit("[^ ]*)")))
    keyed = find_by(t, F.concat(key, F.lit("([a-z]+)")))
    return rows.select("doc_id", kind.alias("format"), own.alias("own_source"), keyed.alias("keyed"))


@R.add("ocr_items", r"""
WITH s AS (SELECT doc_id, text, len(regexp_extract_all(text, '\b[0-9]{3,}\b')) AS n_num, len(regexp_extract_all(text, '\. [A-Z]')) AS n_sent FROM documents),
p AS (SELECT doc_id, CASE WHEN n_num >= 2 THEN 'numbers' WHEN n_sent >= 2 THEN 'sentences' ELSE 'single' END AS strategy,
  CASE WHEN n_num >= 2 THEN len(regexp_extract_all(text, '\b[0-9]{3,}\b')) WHEN n_sent >= 2 THEN n_sent ELSE 1 END AS n_segments FROM s)
SELECT doc_id, strategy, n_segments FROM p""")
def ocr_items(spark, d):
    t = F.col("text")
    n_num, n_sent = F.size(find_all(t, r"(\b[0-9]{3,}\b)", flags="(?d)")), F.size(find_all(t, r"(\. [A-Z])", flags="(?d)"))
    kind = first_rule([(n_num >= 2, F.lit("numbers")), (n_sent >= 2, F.lit("sentences"))], F.lit("single"))
    found = F.when(kind == "numbers", F.size(segments(t, r"\b[0-9]{3,}\b"))).when(kind == "sentences", F.size(segments(t, r"\. [A-Z]"))).otherwise(1)
    return table(spark, d, "documents").select("doc_id", kind.alias("strategy"), found.cast("long").alias("n_segments"))


@R.add("grid_text", """
WITH g AS (SELECT conv_id, string_agg(rtrim(role || ' ' || text), chr(10) ORDER BY turn, text) AS grid, min(CASE WHEN turn = 0 THEN trim(text) END) AS own FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(CASE WHEN length(coalesce(own, '')) > 100 THEN own WHEN length(grid) > length(coalesce(own, '')) THEN grid ELSE coalesce(own, '') END) AS text_md5 FROM g""")
def grid_text(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.trim("text"))).alias("own"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda r: F.array(r["role"], F.lit(None).cast("string"), r["text"])).alias("cells"))
    return rows.select("conv_id", F.md5(S.rebuilt_text(F.col("own"), F.col("cells"))).alias("text_md5"))
