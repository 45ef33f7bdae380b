"""URL filter: host rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, are counted from the
URLs that the rules decide, but for a quarter held out by a hash of the URL. A character's probability backs off from two characters of context to one, to
none, to uniform, each order weighted by how often and how variously its context was seen. A URL's score is
the mean log ratio per character, in units of 1e-4; the threshold is the score that separates the held-out
URLs best (highest sum of both hit rates, the lowest such score on ties). Where these, or the others, lack a label, all labelled
URLs serve in their stead. All of it is DataFrame work: the
counts are a grouped count over at most ``2 * V**3`` keys, the model has ``V**3`` integers whatever the
input, and scoring is a column expression without join or shuffle.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no rule and is scored as the
empty string. Repeated rows are judged each; they also count each in the models. Without labelled URLs of
both kinds the method allows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import materialize, scratch_dir, table

#: Rules of the contract: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the models: start and end mark, letters, any digit (0), punctuation, anything else (~).
ALPHABET = "^" + LOWER + "0./_?=&#%-~"
V = len(ALPHABET)
#: First digits of the hash of held-out URLs.
HELD_OUT = ("0", "1", "2", "3")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    rest = F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F.when if rule is None else rule.when)(fits, h + p)
        verdict = (F.when if verdict is None else verdict.when)(fits, kind)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The URL in the models' alphabet, between two start marks and an end mark."""
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "0" * 9)
    return F.concat(F.lit("^^"), F.regexp_replace(plain, r"[^a-z0./_?=&#%-]", "~"), F.lit("^"))


def codes(symbols: str) -> str:
    """SQL for the numbers of all windows of three symbols of the column ``symbols``; linear in its length."""
    chars = f"transform(split({symbols}, ''), x -> instr('{ALPHABET}', x) - 1)"
    return f"element_at(transform(array({chars}), c -> transform(slice(c, 1, size(c) - 2), (x, i) -> (x * {V} + c[i + 1]) * {V} + c[i + 2])), 1)"


def train(labelled: DataFrame) -> list[int]:
    """The log ratio of every window in units of 1e-4, from rows (label 1 accepted or 0 rejected, symbols).

    The collected list has ``V**3`` integers."""
    spark = labelled.sparkSession
    counts = labelled.select("label", F.explode(F.expr(codes("symbols"))).alias("code")).groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(2 * V**3).select((F.col("id") / V**3).cast("int").alias("label"), (F.col("id") % V**3).cast("int").alias("code"))
    over = lambda *by: Window.partitionBy("label", *by)
    a, b = F.col("a"), F.col("b")
    rows = (
        grid.join(counts.hint("shuffle_hash"), ["label", "code"], "left")
        .select("label", "code", (F.col("code") / V**2).cast("int").alias("a"), ((F.col("code") / V).cast("int") % V).alias("b"), (F.col("code") % V).alias("c"), F.coalesce("n", F.lit(0)).alias("n"))
        .withColumns({"n_ab": F.sum("n").over(over("a", "b")), "t_ab": F.count_if(F.col("n") > 0).over(over("a", "b")), "n_bc": F.sum("n").over(over("b", "c")), "n_b": F.sum("n").over(over("b")), "n_c": F.sum("n").over(over("c")), "n_all": F.sum("n").over(over())})
        .withColumns({"t_b": F.count_if((F.col("n_bc") > 0) & (a == 0)).over(over("b")), "t_all": F.count_if((F.col("n_c") > 0) & (a == 0) & (b == 0)).over(over())})
    )
    back_off = lambda n, lower, seen, kinds: F.when(F.col(seen) > 0, (F.col(n) + F.col(kinds) * lower) / (F.col(seen) + F.col(kinds))).otherwise(lower)
    rows = rows.withColumn("p1", back_off("n_c", F.lit(1.0 / V), "n_all", "t_all"))
    rows = rows.withColumn("p2", back_off("n_bc", F.col("p1"), "n_b", "t_b"))
    rows = rows.withColumn("p3", back_off("n", F.col("p2"), "n_ab", "t_ab"))
    accepted, rejected = (F.sum(F.when(F.col("label") == x, F.log("p3"))) for x in (1, 0))
    ratio = rows.groupBy("code").agg(F.round((accepted - rejected) * 10000).cast("int").alias("w"))
    out = [0] * V**3
    for r in ratio.collect():
        out[r.code] = r.w
    return out


def held_out(symbols: Column) -> Column:
    """Whether a URL is kept from training; equal URLs go together."""
    return F.substring(F.md5(symbols), 1, 1).isin(*HELD_OUT)


def score(model: list[int], symbols: str) -> Column:
    """Mean log ratio per character, rounded down."""
    weights = "cast(split('" + ",".join(map(str, model)) + "', ',') as array<int>)"
    return F.expr(f"cast(floor(aggregate({codes(symbols)}, 0L, (t, x) -> t + element_at({weights}, x + 1)) / (length({symbols}) - 2)) as long)")


def threshold(scored: DataFrame, step: int = 100) -> int | None:
    """The multiple of ``step`` that separates rows (label, score) best; None without both labels."""
    bins = scored.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"))
    everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # scores, hence bins, are bounded
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rate = 1 - F.coalesce(F.sum("yes").over(before), F.lit(0)) / F.sum("yes").over(everything) + F.coalesce(F.sum("no").over(before), F.lit(0)) / F.sum("no").over(everything)
    totals = scored.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not (totals[0] and totals[1]):
        return None
    return int(bins.select("bin", rate.alias("rate")).orderBy(F.desc("rate"), "bin").first().bin) * step


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row."""
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    rows = pages.select(id_col, url_col, host.alias("host"), path.alias("path"), symbols(F.col(url_col)).alias("symbols"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("ruled"), "symbols")
    rows = materialize(rows, f"{scratch_dir(spark)}/urls")
    labelled = rows.filter(F.col("ruled").isNotNull()).select(F.when(F.col("ruled") == "allow", 1).otherwise(0).alias("label"), "symbols", held_out(F.col("symbols")).alias("held"))
    both = {r.held for r in labelled.groupBy("held").agg(F.count_distinct("label").alias("n")).filter("n = 2").collect()}
    model = train(labelled.filter(~F.col("held")) if False in both else labelled)
    judged = labelled.filter("held") if True in both else labelled
    least = threshold(judged.select("label", score(model, "symbols").alias("score")))
    value = score(model, "symbols")
    own = F.lit("allow") if least is None else F.when(value >= least, "allow").otherwise("block")
    return rows.select(id_col, "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), value.alias("score"))


def op9_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(what) -> str:
    cases = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{what(k, h, p)}'" for k, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    return "CASE " + " ".join(cases) + " END"


_SQL = f"""
WITH cut AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  '^^' || regexp_replace(translate(url, '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0./_?=&#%-]', '~', 'g') || '^' AS s FROM cut),
ruled AS (SELECT *, row_number() OVER () AS row_no, md5(s)[1:1] IN ('0', '1', '2', '3') AS held, {_rule_sql(lambda k, h, p: h + p)} AS rule, {_rule_sql(lambda k, h, p: k)} AS ruled FROM named),
parts AS (SELECT held, count(DISTINCT ruled) = 2 AS able FROM ruled WHERE ruled IS NOT NULL GROUP BY 1),
taught AS (SELECT row_no, ruled FROM ruled WHERE ruled IS NOT NULL AND NOT (held AND coalesce((SELECT able FROM parts WHERE NOT held), false))),
judged AS (SELECT row_no, ruled FROM ruled WHERE ruled IS NOT NULL AND (held OR NOT coalesce((SELECT able FROM parts WHERE held), false))),
windows AS (SELECT row_no, unnest(list_transform(range(1, length(s) - 1), lambda i: ((strpos('{ALPHABET}', s[i:i]) - 1) * {V} + strpos('{ALPHABET}', s[i + 1:i + 1]) - 1) * {V} + strpos('{ALPHABET}', s[i + 2:i + 2]) - 1)) AS code FROM ruled),
counts AS (SELECT CASE ruled WHEN 'allow' THEN 1 ELSE 0 END AS label, code, count(*) AS k FROM windows JOIN taught USING (row_no) GROUP BY ALL),
grid AS (SELECT label, code, code // {V * V} AS a, code // {V} % {V} AS b, code % {V} AS c, coalesce(k, 0) AS n FROM (SELECT unnest([0, 1]) AS label) CROSS JOIN (SELECT unnest(range({V**3})) AS code) LEFT JOIN counts USING (label, code)),
sums AS (SELECT *, sum(n) OVER (PARTITION BY label, a, b) AS n_ab, count(*) FILTER (n > 0) OVER (PARTITION BY label, a, b) AS t_ab, sum(n) OVER (PARTITION BY label, b, c) AS n_bc,
  sum(n) OVER (PARTITION BY label, b) AS n_b, sum(n) OVER (PARTITION BY label, c) AS n_c, sum(n) OVER (PARTITION BY label) AS n_all FROM grid),
kinds AS (SELECT *, count(*) FILTER (n_bc > 0 AND a = 0) OVER (PARTITION BY label, b) AS t_b, count(*) FILTER (n_c > 0 AND a = 0 AND b = 0) OVER (PARTITION BY label) AS t_all FROM sums),
one AS (SELECT *, CASE WHEN n_all > 0 THEN (n_c + t_all * CAST({1.0 / V!r} AS DOUBLE)) / (n_all + t_all) ELSE {1.0 / V!r} END AS p1 FROM kinds),
two AS (SELECT *, CASE WHEN n_b > 0 THEN (n_bc + t_b * p1) / (n_b + t_b) ELSE p1 END AS p2 FROM one),
three AS (SELECT *, CASE WHEN n_ab > 0 THEN (n + t_ab * p2) / (n_ab + t_ab) ELSE p2 END AS p3 FROM two),
model AS (SELECT code, CAST(round((sum(ln(p3)) FILTER (label = 1) - sum(ln(p3)) FILTER (label = 0)) * 10000) AS BIGINT) AS w FROM three GROUP BY code),
scored AS (SELECT row_no, floor(sum(w) / count(*)) AS score FROM windows JOIN model USING (code) GROUP BY row_no),
bins AS (SELECT floor(score / 100) AS bin, count(*) FILTER (ruled = 'allow') AS yes, count(*) FILTER (ruled = 'block') AS no FROM scored JOIN judged USING (row_no) GROUP BY 1),
rates AS (SELECT bin, 1 - coalesce(sum(yes) OVER before, 0) / sum(yes) OVER () + coalesce(sum(no) OVER before, 0) / sum(no) OVER () AS rate FROM bins WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT bin * 100 AS least FROM rates ORDER BY rate DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= coalesce((SELECT least FROM best), -1e9) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scored USING (row_no)
"""

QUERIES = {"op9_url_language_ratio": op9_url_language_ratio}
ORACLE_SQL = {"op9_url_language_ratio": _SQL}
