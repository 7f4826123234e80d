"""URL filter: host and path rules, and a character language-model ratio for what no rule fits.

Two smoothed variable-order Markov models are counted over host and path of the URLs that rules accept and reject.
Each order is interpolated with the next shorter one by the number of different characters that
follow its context (Witten-Bell), down to an even share; a context that was never met leaves the shorter one as it is,
so each position uses the longest context known. The score is the difference of the log-likelihoods
per character. Its threshold is calibrated on judged URLs that the models did not see.

All of it is joins and aggregates of DataFrames. Probabilities are worked out once per distinct window of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, UPPER
from tidewatch.sources.staging import stage

ORDER = 4  # characters of context
CALIBRATION = ("0", "1", "2")  # judged URLs whose MD5 begins so calibrate
SALTS = 8  # a window that all URLs share is dealt to so many tasks
BINS, LIMIT = 1000, 20.0  # thresholds in thousandths of a nat per character, within the limit
BEGIN, END = "\u0002", "\u0003"

Rule = tuple[str, str]  # verdict, host and path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = F.concat(F.lit("."), host).endswith("." + name) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _windows(texts: DataFrame, *keep: str) -> DataFrame:
    """Every character of ``s`` and its end, each with the ORDER characters before it."""
    padded = F.concat(F.lit(BEGIN * ORDER), F.col("s"), F.lit(END))
    rows = texts.select(*keep, padded.alias("padded"), F.explode(F.sequence(F.lit(1), F.length("s") + 1)).alias("i"))
    return rows.select(*keep, F.substring("padded", F.col("i"), F.lit(ORDER + 1)).alias("w"))


def _order(windows: DataFrame, shorter: DataFrame | None, k: int) -> DataFrame:
    """Probabilities of all grams of k + 1 characters under both models (pa, pr), from those of k characters."""
    gram = F.substring("w", ORDER + 1 - k, k + 1)
    grams = windows.groupBy(gram.alias("g")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    context = F.substring("g", 1, k) if k else F.lit("")
    grams = grams.withColumn("c", context)
    totals = grams.groupBy("c").agg(
        F.sum("acc").alias("na"), F.count_if(F.col("acc") > 0).alias("ta"),
        F.sum("rej").alias("nr"), F.count_if(F.col("rej") > 0).alias("tr"), F.count("*").alias("signs"),
    )
    rows = grams.join(totals, "c")
    if shorter is None:
        base = 1.0 / F.col("signs")  # the even share over all characters of the table
        rows = rows.withColumns({"qa": base, "qr": base})
    else:
        below = shorter.select(F.col("g").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        rows = rows.join(below, F.substring("g", 2, k) == F.col("tail"))
    mix = lambda n, total, kinds, q: F.when(
        F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(q)) / (F.col(total) + F.col(kinds))
    ).otherwise(F.col(q))
    return rows.select("g", mix("acc", "na", "ta", "qa").alias("pa"), mix("rej", "nr", "tr", "qr").alias("pr"))


def filter_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where a rule decides).

    ``rules`` are (allow or block, host with path); no two are equal. Repeated urls count as often as they occur and
    all get one verdict. Empty hosts and paths are judged like others, by the end sign alone. If rules accept or reject
    nothing, that model is the even share; without calibration urls of both kinds the threshold is 0. An empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "s", F.concat("host", "path")
    )
    ruling = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)]) if rules else None
    decided = F.element_at(ruling, F.col("rule")) if rules else F.lit(None).cast("string")
    texts = stage(
        rows.groupBy("s").agg(F.count("*").alias("n"), F.first("rule").alias("rule")).select(
            "s", "n", decided.alias("kind"), F.substring(F.md5("s"), 1, 1).isin(*CALIBRATION).alias("apart")
        ),
        "url-texts",
    )
    taught = lambda kind: F.sum(
        F.when((F.col("kind") == kind) & ~F.col("apart"), F.col("n")).otherwise(0)
    )
    windows = stage(
        _windows(texts, "n", "kind", "apart").groupBy("w").agg(taught("allow").alias("acc"), taught("block").alias("rej")),
        "url-windows",
    )
    known = None
    for k in range(ORDER + 1):
        known = _order(windows, known, k)
    micro = F.round((F.log("pa") - F.log("pr")) * 1e6).cast("long")  # whole numbers: sums do not depend on order
    known = known.select(F.col("g").alias("w"), micro.alias("micro"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    open_texts = texts.where(F.col("kind").isNull() | F.col("apart"))
    salt = F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int")
    scored = stage(
        _windows(open_texts, "s", "n", "kind").withColumn("salt", salt).join(known, ["w", "salt"])
        .groupBy("s").agg(F.sum("micro").alias("micro"), F.first("n").alias("n"), F.first("kind").alias("kind"))
        .withColumn("score", F.col("micro") / (F.length("s") + 1) / 1e6),
        "url-scores",
    )
    limit = _threshold(scored.where("kind is not null"))
    by_text = scored.where("kind is null").select("s", "score")
    judged = rows.join(by_text, "s", "left")
    by_score = F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce(decided, by_score).alias("verdict"),
        (F.round("score", 4) + 0.0).alias("score"),  # no minus zero
    )


def _threshold(judged: DataFrame) -> float:
    """The threshold that tells most accepted and rejected urls apart, both kinds weighing the same: the lowest such
    one, in the middle between the nearest scores."""
    bins = judged.select(
        F.floor(F.greatest(F.least("score", F.lit(LIMIT)), F.lit(-LIMIT)) * BINS).alias("bin"), "kind", "n"
    ).groupBy("bin").agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("n")).otherwise(0)).alias("acc"),
        F.sum(F.when(F.col("kind") == "block", F.col("n")).otherwise(0)).alias("rej"),
    )
    below, everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    best = bins.select(  # at most 2 BINS LIMIT + 1 rows
        "bin", F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin")).alias("above"), F.coalesce(F.sum("rej").over(below), F.lit(0)).alias("low"), F.sum("rej").over(everything).alias("rejected"),
        (F.sum("acc").over(everything) - F.coalesce(F.sum("acc").over(below), F.lit(0))).alias("high"),
        F.sum("acc").over(everything).alias("accepted"),
    ).where("accepted > 0 and rejected > 0").withColumn(
        "right", F.col("low") * F.col("accepted") + F.col("high") * F.col("rejected")
    ).orderBy(F.desc("right"), "bin").first()
    return (best["bin"] + best["above"]) / 2 / BINS if best else 0.0


def oracle(rules: list[Rule]) -> str:
    """The same in DuckDB SQL."""
    fits = "CAST(NULL AS VARCHAR)"
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = f"CASE WHEN ends_with('.' || host, '.{name}') AND starts_with(path, '{slash}{start}') THEN '{rule}' ELSE {fits} END"
    kind = "CASE " + " ".join(f"WHEN rule = '{rule}' THEN '{verdict}'" for verdict, rule in rules) + " END"
    begin = " || ".join(["chr(2)"] * ORDER)
    orders = []
    for k in range(ORDER + 1):
        base = f"JOIN p{k - 1} ON substr(t.g, 2, {k}) = p{k - 1}.g" if k else ""
        qa, qr = (f"p{k - 1}.pa", f"p{k - 1}.pr") if k else ("1.0 / signs", "1.0 / signs")
        orders.append(f"""
g{k} AS (SELECT substr(w, {ORDER + 1 - k}, {k + 1}) g, sum(acc)::BIGINT acc, sum(rej)::BIGINT rej FROM windows GROUP BY 1),
t{k} AS (SELECT g, acc, rej, sum(acc) OVER c na, count(*) FILTER (acc > 0) OVER c ta, sum(rej) OVER c nr,
  count(*) FILTER (rej > 0) OVER c tr, count(*) OVER c signs FROM g{k} WINDOW c AS (PARTITION BY substr(g, 1, {k}))),
p{k} AS (SELECT t.g, CASE WHEN na > 0 THEN (acc + ta * ({qa})::DOUBLE) / (na + ta)::DOUBLE ELSE ({qa})::DOUBLE END pa,
  CASE WHEN nr > 0 THEN (rej + tr * ({qr})::DOUBLE) / (nr + tr)::DOUBLE ELSE ({qr})::DOUBLE END pr FROM t{k} t {base})""")
    return f"""
WITH cut AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM cut),
ruled AS (SELECT *, {fits} AS rule, host || path s FROM parts),
rowsk AS (SELECT *, {kind} AS kind FROM ruled),
texts AS (SELECT s, count(*) n, min(kind) kind FROM rowsk GROUP BY s),
marked AS (SELECT *, substr(md5(s), 1, 1) IN {CALIBRATION} apart FROM texts),
spread AS (SELECT s, n, kind, apart, unnest(range(1, length(s) + 2)) i FROM marked),
wins AS (SELECT *, substr({begin} || s || chr(3), i, {ORDER + 1}) w FROM spread),
windows AS (SELECT w, sum(CASE WHEN kind = 'allow' AND NOT apart THEN n ELSE 0 END) acc,
  sum(CASE WHEN kind = 'block' AND NOT apart THEN n ELSE 0 END) rej FROM wins GROUP BY w),{",".join(orders)},
scored AS (SELECT s, any_value(n) n, any_value(kind) kind,
  sum(CAST(round((ln(pa) - ln(pr)) * 1e6) AS BIGINT))::DOUBLE / (length(s) + 1) / 1e6 score
  FROM wins JOIN p{ORDER} ON w = g WHERE kind IS NULL OR apart GROUP BY s),
bins AS (SELECT floor(greatest(least(score, {LIMIT}), -{LIMIT}) * {BINS}) bin,
  sum(CASE WHEN kind = 'allow' THEN n ELSE 0 END) acc, sum(CASE WHEN kind = 'block' THEN n ELSE 0 END) rej
  FROM scored WHERE kind IS NOT NULL GROUP BY 1),
sums AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) above, coalesce(sum(rej) OVER b, 0) low, sum(rej) OVER () rejected,
  sum(acc) OVER () - coalesce(sum(acc) OVER b, 0) high, sum(acc) OVER () accepted FROM bins
  WINDOW b AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT (bin + above)::BIGINT::DOUBLE / 2 / {BINS} t FROM sums WHERE accepted > 0 AND rejected > 0
  ORDER BY low * accepted + high * rejected DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(r.kind, CASE WHEN score >= coalesce((SELECT t FROM best), 0) THEN 'allow' ELSE 'block' END) verdict,
  round(score, 4) + 0.0 score
FROM rowsk r LEFT JOIN (SELECT s, score FROM scored WHERE kind IS NULL) USING (s)"""

