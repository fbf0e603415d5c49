"""Secret scan: candidates by pattern, false ones removed by a random forest. DataFrame functions only.

A candidate is a run of token characters, with the word and the separator before it and the word after it: one of 12 or more with
a digit, one of 24 or more without, one of any length from 4 that is assigned to a credential's name, or the password of a URL.
Features tell its length, how its characters change, how much of its letters dictionary words cover, whether it looks like part of a
path, and what its neighbours are like. The dictionary is a fixed list and the words that most documents of the corpus share. What
the labelling rules ask about a finding's neighbours is no feature, so the forest judges the findings they leave open by themselves.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from popweave.session import cut_lineage

TOKEN = "A-Za-z0-9_+/-"
CREDENTIAL_WORDS = "pass|passwd|password|pwd|secret|token|key|apikey|auth|cred|credential|bearer|private|signature"
# a look at the nearest characters first, as most runs follow a plain space
_ASSIGNED = rf"(?<=[=:][ ]?[\"'`]?)(?<=(?i:{CREDENTIAL_WORDS})s?[\"'`]?[ ]?[=:][ ]?[\"'`]?)"
_IN_URL = r"(?<=:)(?<=://[^\s/:@]{1,64}:)"
# no run is scanned twice: a candidate starts where a run starts, and its parts give nothing back
CANDIDATE = (
    rf"(?<![{TOKEN}])(?:(?=[A-Za-z_+/-]*+[0-9])[{TOKEN}]{{12,}}+|[{TOKEN}]{{24,}}+|{_ASSIGNED}[{TOKEN}]{{4,}}+|{_IN_URL}[{TOKEN}]{{4,}}+(?=@))"
    "={0,2}+"
)
IN_CONTEXT = rf"(?:([A-Za-z][A-Za-z_.]{{0,39}}+)([^{TOKEN}]{{1,6}}))?({CANDIDATE})(?=[^A-Za-z0-9]{{0,4}}([A-Za-z]{{0,20}}))"

SAMPLE_FINDINGS = 20_000  # labelled findings that the forest is fitted on, at most
TREES, DEPTH = 30, 8
LEARNT, SHARED = 500, 3  # words of the corpus that join the dictionary, at most; documents that must hold each

# Words whose presence speaks for a name rather than a random value.
DICTIONARY = (
    "access account address admin alpha application archive article asset background base beta block blog build button"
    " bundle cache category channel chapter client cloud code color commit common component config connect container content"
    " control copy core count country create current custom customer data date default delta demo description design detail"
    " device digest document download draft edit element email engine error event example export feature field figure file"
    " filter final first font form forum frame front function general global graph group guide handler header height help home"
    " image import index info input install item job json key label language last layout left library license line link list"
    " local login main manager master media member menu message meta method mobile mode model module name network news node"
    " note number object option order output page panel parent part path payment photo placeholder player plugin policy post"
    " preview price process product profile project public query random record release remote report request result review"
    " right role root sample schema script search section server service session setting shop simple site size source start"
    " state static status step store style summary support system table target task template test text theme thread time title"
    " tool topic total track type update upload user value version video view web width window word world"
).split()


def corpus_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The words of 4 or more letters that most documents hold, LEARNT at most; parts of longer tokens are no words."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(f"(?<![{TOKEN}])[a-z]{{4,}}+(?![{TOKEN}])"), F.lit(0))
    counts = docs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").count()
    return [r.word for r in counts.where(F.col("count") >= SHARED).orderBy(F.desc("count"), "word").limit(LEARNT).collect()]


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: ``id``, ``place`` (0, 1, ... in its text), ``before``, ``gap``, ``value`` and ``after``."""
    text = F.col(text_col)
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.regexp_like("text", F.lit(CANDIDATE)))
    names = ("before", "gap", "value", "after")
    groups = [F.regexp_extract_all("text", F.lit(IN_CONTEXT), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    rows = found.select("id", F.posexplode(F.arrays_zip(*groups)).alias("place", "x"))
    return rows.select("id", "place", F.lower("x.before").alias("before"), "x.gap", "x.value", F.lower("x.after").alias("after"))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def dictionary_share(words: list[str]) -> Column:
    """Share of a value's letters that words of the dictionary cover; 0 without letters."""
    known = sorted({*DICTIONARY, *words}, key=lambda w: (-len(w), w))
    letters = F.regexp_replace(F.lower("value"), "[^a-z]+", " ")
    left = F.regexp_replace(letters, "(?:" + "|".join(known) + ")", "")
    count = lambda text: F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(count(letters) > 0, 1 - count(left) / count(letters)).otherwise(0.0)


def features(words: list[str] = []) -> dict[str, Column]:
    value = F.col("value")
    n = F.length("value")
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return {
        "length": n.cast("double"),
        "entropy": F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "digits": _share("[0-9]"),
        "capitals": _share("[A-Z]"),
        "hex": _share("[0-9a-f]"),
        "letter_digit": _share("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
        "case_change": _share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "repeats": _share(r"(.)(?=\1)"),
        "vowel_pairs": _share("(?<=[b-df-hj-np-tv-xz])[aeiou]|(?<=[aeiou])[b-df-hj-np-tv-xz]"),
        "dictionary": dictionary_share(words),
        "slashes": _share("/"),
        "joiners": _share("[_-]"),
        "padding": value.endswith("=").cast("double"),
        "quoted": F.regexp_like("gap", F.lit("[\"'`]")).cast("double"),
        "in_path": F.regexp_like("gap", F.lit(r"[/\\?&#]")).cast("double"),
        "word_before": F.length("before").cast("double"),
        "word_after": F.length("after").cast("double"),
    }


def by_rule(words: list[str] = []) -> Column:
    """Label of a finding that a rule settles, else NULL.

    1: a published key format, or an assignment to a credential's name. 0: digits alone, or letters that dictionary words make up for
    the most part.
    """
    provider = F.regexp_like("value", F.lit("^(?:AKIA|ASIA)[0-9A-Z]{16}$|^(?:ghp|gho|ghs)_[A-Za-z0-9]{36}$|^sk_live_[A-Za-z0-9]{16,}$"))
    named = F.regexp_like("before", F.lit(f"(?:^|[_.])(?:{CREDENTIAL_WORDS})s?$")) & F.regexp_like("gap", F.lit("[=:]"))
    plain = F.regexp_like("value", F.lit("^[0-9]+$")) | (dictionary_share(words) >= 0.7)
    return F.when(provider | F.coalesce(named, F.lit(False)), 1).when(plain, 0)


def _with_features(findings: DataFrame, words: list[str] = []) -> DataFrame:
    made = findings.select("*", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(f"f_{n}") for n, c in features(words).items()])
    return VectorAssembler(inputCols=[f"f_{n}" for n in features()], outputCol="f_all").transform(made)


def fit(findings: DataFrame, label: Column, words: list[str] = []) -> RandomForestClassificationModel | None:
    """Forest over labelled findings (SAMPLE_FINDINGS at most, by a hash); None unless both labels, 0 and 1, occur."""
    known = findings.withColumn("y", label.cast("double")).where(F.col("y").isin(0.0, 1.0))
    known = known.orderBy(F.xxhash64("value", "before", "id", "place"), "value", "id", "place").limit(SAMPLE_FINDINGS)
    known = cut_lineage(known)
    if known.select("y").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="f_all", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=17)
    return forest.fit(_with_features(known, words))


def scan(
    docs: DataFrame, label: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """One row per candidate of every whole text: ``id_col``, ``place``, ``value``, ``probability`` and ``secret``.

    ``label`` (1 or 0, NULL for unlabelled findings) marks what the forest learns from; ``by_rule`` by default. With labels of
    one kind only there is nothing to learn, and the label (0 if NULL) is the probability. NULL and empty texts have no
    candidates. Repeated rows and NULL ids are scanned each for itself; a value that occurs twice in a text is two
    candidates. Other columns are not read. Tables without candidates, or empty ones, give no rows.
    """
    words = corpus_words(docs, text_col)
    label = by_rule(words) if label is None else label
    findings = cut_lineage(find_candidates(docs, id_col, text_col))
    model = fit(findings, label, words)
    if model is None:
        scored = findings.withColumn("probability", F.coalesce(label.cast("double"), F.lit(0.0)))
    else:
        scored = model.transform(_with_features(findings, words)).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "place", "value", "probability", (F.col("probability") >= threshold).alias("secret"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret value of ``found`` in a row's text replaced; rows without one, and all other columns, stay.

    Values are replaced longest first. Rows under a NULL id have no findings to go by and stay as they are.
    """
    secrets = found.where("secret").groupBy(F.col(id_col).alias("of"))
    secrets = secrets.agg(F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), "value"))).alias("values"))
    rows = docs.select(F.struct("*").alias("row"))  # so that no column of theirs can be taken for one of the findings
    joined = rows.join(secrets, F.col(f"row.{id_col}") == F.col("of"), "left")
    text = F.aggregate(
        F.coalesce("values", F.array()), F.col(f"row.{text_col}"), lambda t, s: F.replace(t, s.getField("value"), F.lit(mark))
    )
    text = F.when(F.col("values").isNull(), F.col(f"row.{text_col}")).otherwise(text)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
