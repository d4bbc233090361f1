"""URL filter: rules first, then a ratio of character language models. Built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.session import materialize

#: Longest n-gram. With 42 symbols a model has at most 42 + 42^2 + 42^3 entries.
ORDER = 3
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?"
_BASE = len(SYMBOLS) + 2  # and one for any other character, one for a URL's ends
#: Weight of the longer context's estimate is n / (n + PRIOR), n its count.
PRIOR = 5.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Null or no ``://``: both empty."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, the first by name on a tie; nulls if none fits. rules: (rule, verdict)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        on, _, rest = rule.partition("/")
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _symbols(url: Column) -> Column:
    """The URL without its scheme, lower-case, as symbol numbers between two end marks."""
    text = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    place = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    end = F.array(F.lit(_BASE - 1))
    return F.concat(end, F.transform(place, lambda i: F.when(i > 0, i - 1).otherwise(_BASE - 2)), end)


def _grams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per symbol but the first: codes of its 1- to ORDER-grams (null before the start)."""
    at = F.posexplode(F.slice(F.col("symbols"), F.lit(2), F.size("symbols") - 1)).alias("pos", "c1")
    one = rows.select(*keep, "symbols", at)
    two = F.try_element_at("symbols", F.col("pos") + 1)
    three = F.when(F.col("pos") > 0, F.try_element_at("symbols", F.greatest(F.col("pos"), F.lit(1))))
    code1 = F.col("c1")
    code2 = two * _BASE + F.col("c1")
    code3 = (three * _BASE + two) * _BASE + F.col("c1")
    return one.select(*keep, code1.cast("int").alias("g1"), code2.cast("int").alias("g2"), code3.cast("int").alias("g3"))


def train_ratio(labelled: DataFrame) -> DataFrame:
    """Model (order, gram, ratio): log-probability of the gram's last symbol among accepted URLs minus among rejected ones.

    labelled: (url, accepted), distinct. Each class's estimate of order k mixes
    its own counts with order k - 1 by the context's count (variable order).
    The result has at most _BASE + _BASE^2 + ... rows, whatever the input.
    """
    counts = _grams(labelled.select("accepted", _symbols(F.col("url")).alias("symbols")), ["accepted"])
    both = F.array(*[F.struct(F.lit(k).alias("order"), F.col(f"g{k}").alias("gram")) for k in range(1, ORDER + 1)])
    counts = counts.select("accepted", F.explode(both).alias("g")).where("g.gram is not null").groupBy("g.order", "g.gram")
    counts = counts.agg(F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no"))
    counts = materialize(counts, "url-counts")
    lower = None
    for k in range(1, ORDER + 1):
        own = counts.where(F.col("order") == k)
        context = F.floor(F.col("gram") / _BASE).cast("int")
        sums = own.groupBy(context.alias("context")).agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
        own = own.withColumn("context", context).join(sums, "context")
        if lower is None:
            own = own.withColumns({"low_yes": F.lit(1.0 / _BASE), "low_no": F.lit(1.0 / _BASE)})
        else:
            down = lower.select(F.col("gram").alias("low"), F.col("p_yes").alias("low_yes"), F.col("p_no").alias("low_no"))
            own = own.withColumn("low", F.col("gram") % (_BASE ** (k - 1))).join(down, "low")
        p = {f"p_{c}": (F.col(c) + PRIOR * F.col(f"low_{c}")) / (F.col(f"all_{c}") + PRIOR) for c in ("yes", "no")}
        lower = materialize(own.withColumns(p).select("order", "gram", "p_yes", "p_no"), "url-model")
        done = lower if k == 1 else done.unionAll(lower)
    return done.select("order", "gram", F.log(F.col("p_yes") / F.col("p_no")).alias("ratio"))


def score_urls(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(url, score): mean log-ratio of a distinct URL's symbols, each by the longest gram that the model knows, rounded to 9 places."""
    tables = []
    for k in range(ORDER, 0, -1):
        part = model.where(F.col("order") == k).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        tables.append((f"g{k}", F.broadcast(part)))
    rows = _grams(urls.select("url", _symbols(F.col("url")).alias("symbols")), ["url"])
    for name, part in tables:
        rows = rows.join(part, name, "left")
    ratio = F.coalesce(*[F.col(f"r{k}") for k in range(ORDER, 0, -1)], F.lit(0.0))
    return rows.groupBy("url").agg(F.round(F.avg(ratio), 9).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """Threshold with the least sum of the two error rates on (accepted, score), the lowest such score; 0 without both classes.

    Scores are counted in a grid of 4096 steps, so one small aggregate decides.
    """
    low, high, yes, no = scored.agg(F.min("score"), F.max("score"), F.sum(F.col("accepted").cast("long")), F.sum((~F.col("accepted")).cast("long"))).first()
    if not yes or not no:
        return 0.0
    step = max((high - low) / 4096, 1e-9)
    bins = scored.groupBy(F.floor((F.col("score") - low) / step).alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no"))
    below_yes = below_no = 0
    best, where = 1.0, low
    for r in sorted(bins.collect(), key=lambda r: r["bin"]):  # 4097 rows at most
        error = below_yes / yes + 1 - below_no / no
        if error < best - 1e-12:
            best, where = error, low + r["bin"] * step
        below_yes, below_no = below_yes + r["yes"], below_no + r["no"]
    return float(where)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score.

    URLs that rules accept and reject train two smoothed variable-order Markov
    models over characters. Where no rule fits, the verdict is ``allow`` if the
    mean log-likelihood difference per character reaches the threshold that
    parts the ruled URLs best. Null URLs read as empty. Every distinct URL is
    scored once, so repeated pages cost one join row each.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = materialize(rows.select("url", "host", "path").distinct().select("url", says.alias("says")), "urls")
    ruled = urls.where("says is not null").select("url", (F.col("says") == "allow").alias("accepted"))
    scores = materialize(score_urls(urls.select("url"), train_ratio(ruled)), "url-scores")
    limit = calibrate(scores.join(ruled, "url").select("accepted", "score"))
    judged = rows.join(scores, "url").withColumns({"rule": name, "says": says})
    verdict = F.coalesce("says", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
