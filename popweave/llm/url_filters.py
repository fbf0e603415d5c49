"""URL verdicts: a list of host and path rules, and association rules for the URLs that the list says nothing about.

Spark's FP-growth mines token combinations of labelled URLs that go with a verdict. Rules below a support or a confidence are
pruned, and so are rules that a shorter one makes redundant. Tokens that the labelled URLs only hold together are mined as one, and
any of them stands for it, since the rules with either are the same but for the name. The rest form an inverted index on the rarest token of each:
a URL meets a rule only through that token, and the rule's other tokens are checked there.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from popweave.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "verdict:"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" for NULL or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; "" for NULL or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule, such as ``net/es/``, whose host is the URL's or a parent of it and whose path the URL's begins with."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, rule).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, top level, host labels, path parts (digits as #), query names and whether there is a fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("(?:^|&)([^=&]+)"), F.lit(1))
    named = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))
    top = F.transform(F.slice(F.reverse(labels), 1, 1), lambda x: F.concat(F.lit("top:"), x))
    fragment = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(scheme, top, named("label:", labels), named("part:", parts), named("query:", query), fragment)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def together(token_sets: DataFrame) -> DataFrame:
    """``token`` and ``group``, the least of the tokens that are in exactly the same rows; tokens alone in theirs stand for themselves.

    Rows are compared by their number and two sums over hashes of distinct row numbers.
    """
    rows = cut_lineage(token_sets.select(F.monotonically_increasing_id().alias("row"), "tokens"))
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)"))
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), hashed(1).alias("h1"), hashed(2).alias("h2")
    )
    least = seen.groupBy("n", "h1", "h2").agg(F.min("token").alias("group"))
    return cut_lineage(seen.join(least, ["n", "h1", "h2"]).select("token", "group"))


def grouped(token_sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct ``tokens`` with ``groups``, the sorted groups of their tokens; tokens without a group are left out."""
    pairs = token_sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(groups, "token")
    return pairs.groupBy("tokens").agg(F.array_sort(F.collect_set("group")).alias("groups"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """``tokens``, ``verdict``, ``confidence`` and ``support`` of the rules that hold among ``tokens``, ``verdict`` rows.

    A rule goes if another one for the same verdict with some of its tokens is at least as confident.
    """
    empty = labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    rows = labelled.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    if rows.isEmpty():
        return empty
    items = rows.select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.select(
        F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("then"), "confidence", "support"
    )
    rules = rules.where(F.startswith("then", F.lit(VERDICT)) & ~F.exists("tokens", lambda t: F.startswith(t, F.lit(VERDICT))))
    rules = cut_lineage(rules.withColumn("then", F.expr(f"substr(then, {len(VERDICT) + 1})")).withColumnRenamed("then", "verdict"))
    shorter = rules.select(F.explode("tokens").alias("token"), "verdict", F.col("tokens").alias("fewer"), F.col("confidence").alias("c"))
    shorter = shorter.where(F.col("token") == F.col("fewer")[0])
    met = rules.withColumn("token", F.explode("tokens")).join(shorter, ["token", "verdict"])
    met = met.where(
        (F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))
    )
    return cut_lineage(rules.join(met.select("tokens", "verdict"), ["tokens", "verdict"], "left_anti").select(*empty.columns))


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens`` and ``verdict`` of the distinct ``token_sets`` that hold all tokens of a rule.

    Of several rules the most confident decides, then the best supported, then the longest, then the last by tokens.
    """
    frequency = token_sets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    ranked = rules.withColumn("token", F.explode("tokens")).join(frequency, "token", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r")
    index = ranked.groupBy("tokens", "verdict", "confidence", "support").agg(rarest)
    index = index.select(F.col("r.token").alias("token"), F.col("tokens").alias("all"), "verdict", "confidence", "support")
    met = token_sets.withColumn("token", F.explode("tokens")).join(index, "token").where(F.size(F.array_except("all", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("all").alias("n"), "all", "verdict")).alias("best")
    return met.groupBy("tokens").agg(best).select("tokens", F.col("best.verdict").alias("verdict"))


def judge(
    pages: DataFrame,
    rules: dict[str, str],
    id_col: str = "page_id",
    url_col: str = "url",
    labels: Column | None = None,
    default: str = "allow",
    min_support: float = 0.002,
    min_confidence: float = 0.9,
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (NULL where none fits) and ``verdict`` of every row.

    The list decides where a rule fits. Elsewhere association rules do, mined from the rows that ``labels``, an expression,
    gives a verdict; by default the list's own verdicts are the labels. Where no rule holds, also for NULL URLs and those
    without ``://``, the verdict is ``default``. Rows with the same tokens are matched once. Repeated rows and NULL ids stay
    as they are; other columns are read only by ``labels``; an empty table gives no rows.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule = list_rule(host, path, rules)
    listed = F.lit(None).cast("string")
    for name, verdict in rules.items():
        listed = F.when(F.col("rule") == name, verdict).otherwise(listed)
    known = F.lit(None).cast("string") if labels is None else labels
    rows = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), rule.alias("rule"), tokens_of(url).alias("tokens"), known.alias("label")
    )
    rows = rows.withColumn("listed", listed)
    taught = rows.select("tokens", (F.col("listed") if labels is None else F.col("label")).alias("verdict"))
    known = taught.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    groups = together(known)
    short = known.join(grouped(known, groups), "tokens").select(F.col("groups").alias("tokens"), "verdict")
    mined = mine(short, min_support, min_confidence)
    sets = grouped(rows.where("listed IS NULL"), groups)
    by_groups = match(sets.select(F.col("groups").alias("tokens")).distinct(), mined).withColumnsRenamed({"tokens": "groups", "verdict": "mined"})
    judged = rows.join(sets.join(by_groups, "groups").select("tokens", "mined"), "tokens", "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"))
