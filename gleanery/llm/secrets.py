"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and Spark ML only.

A candidate is a run of at least 16 key-like characters with a digit, whatever is assigned to a secret's name (a
quoted value, or all up to white space, of any length), or the password in ``scheme://user:password@host``.  The forest sees its length, the transitions
between its kinds of characters, how much of it common words cover, the path around it and its neighbouring words, and is
trained on labelled findings.  Where no labels are given, findings that formats and assignments settle beyond doubt
label themselves (a key format or an assignment to a secret's name; a plain number, address, path or placeholder); the
forest decides on all.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.registry import query, table
from gleanery.llm.text import SPACE, stored
from gleanery.operators.joins import broadcast_if_small

NAMES = r"(?i)(pass(word|wd|phrase)?|secret|token|credential|auth|bearer|api[_-]?key|access[_-]?key|private[_-]?key)"
RUN = r"(?<![A-Za-z0-9+/_.@-])(?=AKIA|[A-Za-z+/_.@-]*[0-9])[A-Za-z0-9+/_.@-]{16,}={0,2}"
# The first two conditions are cheap and leave few places for the third.
AFTER_NAME = (r"(?<=[:=\s\"'])(?<=[:=][\s\"']{0,33})(?<=(?i:" + NAMES.removeprefix("(?i)")
              + r")[\"']?\s{0,32}[:=]{1,4}\s{0,32}[\"']?)")
VALUE = r"(?:(?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|[^\s\"']\S*?(?=[,;\"']*(?:\s|\z)))"
# The password of an address with user and host; the colon is looked for first.
CREDENTIAL = r"(?<=:)(?<=://[^\s/:@\"']{0,64}:)[^\s/@\"']+(?=@[A-Za-z0-9\[])"
CANDIDATE = f"{AFTER_NAME}{VALUE}|{CREDENTIAL}|{RUN}"
PLACEHOLDERS = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|1234567890)"
ASSIGNED = NAMES + r"[\"']?\s*[:=]+\s*[\"']?\z"
IN_ADDRESS = r"://[^\s/:@\"']*:\z"
KEY_FORMAT = r"^(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
NOT_SECRET = r"^[0-9.+_-]+$|@|/.*/|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
# After an assignment slashes and at signs prove nothing, but for a path from its root and an address.
NOT_ASSIGNED = r"^[0-9.+_-]+$|^[.~]{0,2}/|^[^@]+@[^@]+\.[A-Za-z]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
# A short word after white space may be prose: no label, or 0 if it is made of dictionary words.
PLAIN_WORD = r"^[A-Za-z]?[a-z]{0,10}[.!?]?$"
BEFORE_CHARS, AFTER_CHARS = 48, 24
# The dictionary: the most frequent words of the corpus with so many letters.
DICTIONARY_WORDS = 400
DICTIONARY_LETTERS = (3, 12)
# Labelled findings of each class the forest is trained on, chosen by hash.
SAMPLE = 2000
TREES, DEPTH = 24, 6
THRESHOLD = 0.5
FEATURES = (
    "length", "digits", "capitals", "hexadecimal", "signs", "transitions", "variety", "covered", "path", "address",
    "named_before", "named_near", "assigned", "quoted", "placeholder", "source_path")
REDACTED = "[SECRET]"


def dictionary(documents: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent plain words of all texts, at most ``size``."""
    fewest, most = DICTIONARY_LETTERS
    words = documents.select(F.explode(F.split(F.lower("text"), rf"{SPACE}+")).alias("word"))
    words = words.where(F.length("word").between(fewest, most)).groupBy("word").count()
    words = words.where(F.col("word").rlike("^[a-z]+$"))
    return [row[0] for row in words.orderBy(F.desc("count"), "word").limit(size).collect()]


def candidates(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per candidate: the columns ``keep``, ``row``, ``n``, ``start``, ``value``, ``before``, ``after``."""
    rows = documents.select(*keep, F.col("text").alias("__text"), F.col("source").cast("string").alias("__source"))
    rows = rows.where(F.col("__text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({
        "values": F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)), "between": F.split("__text", CANDIDATE)})
    found = rows.select(*keep, "row", "__source", "between", "values", F.posexplode("values").alias("n", "value"))
    piece = F.get("between", F.col("n"))
    found = found.select(
        *keep, "row", "n", "value", F.length(piece).cast("long").alias("gap"), F.expr(f"right(concat(coalesce(get(values, n - 1), ''), get(between, n)), {BEFORE_CHARS})").alias("before"),
        F.expr(f"left(get(between, n + 1), {AFTER_CHARS})").alias("after"), F.coalesce("__source", F.lit("")).alias("source_name"))
    found = stored(found, "secret-candidates")  # rows keep their numbers
    so_far = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one text's candidates
    start = F.sum(F.col("gap") + F.length("value")).over(so_far) - F.length("value")
    return found.withColumn("start", start).drop("gap")


def features(found: DataFrame, common: list[str]) -> DataFrame:
    """``found`` with the columns FEATURES, all doubles."""
    value, size = F.col("value"), F.length("value").cast("double")
    left = lambda pattern: F.length(F.regexp_replace("value", pattern, ""))
    share = lambda pattern: (size - left(pattern)) / size
    kinds = value
    for pattern, mark in (("[0-9]", "0"), ("[a-z]", "a"), ("[A-Z]", "A"), ("[^0aA]", "-")):
        kinds = F.regexp_replace(kinds, pattern, mark)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    covered = share(f"(?i)({'|'.join(sorted(common, key=lambda w: (-len(w), w)))})") if common else F.lit(0.0)
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    return found.withColumns({
        "length": size, "digits": share("[0-9]"), "capitals": share("[A-Z]"), "hexadecimal": share("[0-9a-f]"),
        "signs": share("[^A-Za-z0-9]"), "transitions": (runs - 1) / size,
        "variety": F.size(F.array_distinct(F.split("value", ""))) / size, "covered": covered,
        "path": share("[^/]"), "address": flag(value.rlike(r"@|^[0-9]+(\.[0-9]+){3}")),
        "named_before": flag(F.col("before").rlike(NAMES + r"\W*\z") | _in_address(value, F.col("before"))),
        "named_near": flag(F.col("before").rlike(NAMES) | F.col("after").rlike(NAMES)),
        "assigned": flag(F.col("before").rlike(r"[:=]\s*[\"']?\z")), "quoted": flag(F.col("after").rlike("^[\"']")),
        "placeholder": flag(F.concat("before", value, "after").rlike(PLACEHOLDERS)),
        "source_path": flag(F.col("source_name").rlike("(?i)(test|example|fixture|/doc|sample)")),
    }).fillna(0.0, list(FEATURES))


def evident_label(value: Column, before: Column) -> Column:
    """1 or 0 where format and assignment leave no doubt, else null."""
    fake, assigned = value.rlike(PLACEHOLDERS), before.rlike(ASSIGNED) | _in_address(value, before)
    known = assigned & ~value.rlike(NOT_ASSIGNED) & ~_may_be_prose(value, before)
    negative = F.when(assigned, value.rlike(r"^[0-9.+_-]+$")).otherwise(value.rlike(NOT_SECRET))
    return F.when((value.rlike(KEY_FORMAT) | known) & ~fake, 1.0).when(negative | fake, 0.0)


def _in_address(value: Column, before: Column) -> Column:
    """Is it a password before a host, not a port or a path?"""
    return before.rlike(IN_ADDRESS) & ~value.rlike("[@/]")


def _may_be_prose(value: Column, before: Column) -> Column:
    return value.rlike(PLAIN_WORD) & before.rlike(r"\s\z")


def train_forest(labelled: DataFrame, seed: int = 7):
    """A forest over FEATURES from rows with ``label``; a bounded sample of both classes.  None if a class is missing."""
    parts = [labelled.where(F.col("label") == c).orderBy(F.xxhash64("value", "before"), "value", "before").limit(SAMPLE)
             for c in (0.0, 1.0)]
    sample = stored(parts[0].unionByName(parts[1]).select("label", *FEATURES), "secret-labels")
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.coalesce(1))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, labelCol="label", maxBins=64)
    return forest.fit(vectors)


def scan_secrets(
    documents: DataFrame, labelled: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per candidate: ``keep``, ``start``, ``value``, ``score``, ``is_secret`` and the features.

    ``start`` counts code points.  ``labelled`` has ``value, before, after, source_name, label``; without it, evident
    findings are the labels.  Null and empty texts have no candidates; equal candidates in equal places get equal
    scores; repeated rows are scanned one by one; other columns are ignored; with findings of one class only, the
    evident label is the score; an empty table gives no rows.
    """
    common = dictionary(documents)
    found = stored(features(candidates(documents, keep), common), "secret-findings")
    if labelled is None:
        value, before = F.col("value"), F.col("before")
        word = F.when(_may_be_prose(value, before) & (F.col("covered") >= 1), 0.0)
        known = found.withColumn("label", F.coalesce(evident_label(value, before), word)).where("label IS NOT NULL")
    else:
        known = features(labelled, common)
    forest = train_forest(known)
    if forest is None:
        score = F.coalesce(evident_label(F.col("value"), F.col("before")), F.lit(0.0))
        return found.withColumn("score", score).withColumn("is_secret", F.col("score") >= THRESHOLD)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    scored = forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD).drop("features", "rawPrediction", "probability", "prediction")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every secret replaced by REDACTED, ``n_chars`` counted anew where it exists."""
    marked = documents.withColumn("__key", F.xxhash64("text"))
    found = scan_secrets(marked, keep=("doc_id", "__key")).where("is_secret")
    # Every secret goes at its place, from the last to the first; runs go wherever else the text has them too, longer
    # ones first: one may be part of another.
    run = F.when(F.col("value").rlike(f"^(?:{RUN})$"), F.struct(F.length("value").alias("n"), F.col("value").alias("v")))
    secrets = found.groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__found")).agg(
        F.reverse(F.array_sort(F.collect_set(F.struct("start", F.length("value").alias("n"))))).alias("__places"),
        F.reverse(F.array_sort(F.collect_set(run))).alias("__secrets"))
    secrets = broadcast_if_small(stored(secrets, "secrets"))
    both = marked.join(secrets, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__found")), "left")
    text = F.aggregate("__places", F.col("text"), lambda t, p: F.concat(
        F.substr(t, F.lit(1), p["start"].cast("int")), F.lit(REDACTED),
        F.substr(t, (p["start"] + p["n"] + 1).cast("int"), F.length(t))))
    text = F.aggregate("__secrets", text, lambda t, s: F.replace(t, s["v"], F.lit(REDACTED)))
    both = both.withColumn("text", F.when(F.col("__secrets").isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.when(F.col("__secrets").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return both.select(*documents.columns)


@query("op4_secret_forest")
def secret_forest(spark, folder):
    found = scan_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "start", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
