"""Secret scan with a random forest against false positives (operator 5).

A pattern finds candidates in whole texts: runs of at least MIN_LENGTH characters of the
base-64, hexadecimal and token alphabets that hold a digit and a letter, with the words
around them. A random forest, trained from labelled findings, tells secrets from false
positives by length, character transitions, dictionary coverage, path and neighbouring
words. Features are SQL expressions, the forest is Spark's own; no Python runs on rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintloom.llm.common import let

MIN_LENGTH = 16
#: Labelled findings that train() uses at most, taken by the order of a hash.
MAX_FINDINGS = 20_000
TREES, DEPTH, SEED = 30, 6, 7
THRESHOLD = 0.5

#: Words of identifiers and prose that speak against a random string.
DICTIONARY = (
    "access account admin alpha and api app application archive article base beta build cache class client code commit config content data database default "
    "demo document download edit error event example false file for form function handler header http https id image index info input item key language "
    "lib link list local login main manager message method model module name new node note null object option order output page panel param part password "
    "path place please plugin post private process product project public query release report request response result row sample script search secret "
    "section server service session set setting site source start state static status step string style system table tag task template test text the "
    "theme this time title token tool type update upload user value version view web width window with www xml your"
).split()
#: Words before a candidate that speak for and against a secret, and parts of paths that speak against.
FOR_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "auth", "bearer", "credential", "private_key", "access_key")
AGAINST_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "revision", "uuid", "etag", "fingerprint", "integrity", "version", "build")
AGAINST_PATHS = ("test", "example", "sample", "demo", "doc", "mock", "fixture")
#: '=' may stand before a candidate; behind it, it is padding only if no value follows, bare or quoted, so that a long name leaves it to its value.
_CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+(?:={{1,2}}(?![\"']?[A-Za-z0-9+/_=-]))?"
FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "class_changes", "vowel_changes", "distinct", "repeats", "hex_only", "dictionary", "longest_word",
    "path_against", "before_for", "before_against", "assigned", "quoted",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def candidates(docs: DataFrame, path: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, number, path, before, value): the candidates of each text in order, numbered from 0, with up to 48 characters before them."""
    column = F.col(text)

    def placed(values: Column) -> Column:
        # a long name is a match of its own: without it, its value would stand behind nothing
        last = lambda i: F.coalesce(F.get(values, i - 1), F.lit(""))
        between = let(F.split(column, _CANDIDATE, -1), lambda parts: F.transform(values, lambda v, i: F.struct(F.right(F.concat(last(i), F.get(parts, i)), F.lit(48)).alias("before"), v.alias("value"))))
        return F.when(F.size(values) > 0, between).otherwise(F.array().cast("array<struct<before:string,value:string>>"))

    found = let(F.regexp_extract_all(column, F.lit(_CANDIDATE), F.lit(0)), placed)
    mixed = F.filter(found, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    rows = docs.select("doc_id", F.col(path).cast("string").alias("path"), F.posexplode(mixed).alias("number", "m"))
    return rows.select("doc_id", "number", "path", "m.before", "m.value")


def with_features(findings: DataFrame) -> DataFrame:
    """findings (path, before, value) with the numeric columns FEATURES."""
    value, before, n = F.col("value"), F.lower(F.col("before")), F.length("value").cast("double")
    share = lambda pattern: _count(value, pattern) / n
    words = "(?i)" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    letters = F.greatest(_count(value, "[A-Za-z]"), F.lit(1.0))
    tail = F.regexp_extract(before, r"([a-z0-9_\-]*)[^a-z0-9]*$", 1)
    last_words = F.split(F.regexp_replace(before, r"[^a-z0-9_]+", " "), " ")
    columns = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "signs": share("[+/_=-]"),
        "class_changes": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"),
        "vowel_changes": share("(?i)(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "repeats": share(r"(.)(?=\1)"),
        "hex_only": value.rlike("^[0-9a-fA-F-]+$").cast("double"),
        "dictionary": F.length(F.array_join(F.regexp_extract_all(value, F.lit(words), F.lit(0)), "")) / letters,
        "longest_word": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w))), F.lit(0)).cast("double") / n,
        "path_against": F.coalesce(F.lower("path").rlike("|".join(AGAINST_PATHS)), F.lit(False)).cast("double"),
        "before_for": tail.rlike("|".join(FOR_WORDS)).cast("double"),
        "before_against": F.arrays_overlap(last_words, F.array(*map(F.lit, AGAINST_WORDS))).cast("double"),
        "assigned": before.rlike(r"[a-z0-9_\]]\s*(=|:|=>)\s*[\"']?$").cast("double"),
        "quoted": before.rlike("[\"']$").cast("double"),
    }
    return findings.withColumns({k: F.coalesce(columns[k], F.lit(0.0)) for k in FEATURES})


def train(findings: DataFrame) -> PipelineModel:
    """A forest from labelled findings (path, before, value, label 0 or 1); at most MAX_FINDINGS of them, chosen by hash."""
    bounded = findings.where("label IS NOT NULL AND value IS NOT NULL").orderBy(F.xxhash64("value", "before", "path", "label"), "value", "before", "label").limit(MAX_FINDINGS)
    data = with_features(bounded.withColumn("before", F.coalesce("before", F.lit("")))).select(*FEATURES, F.col("label").cast("double").alias("label")).coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", probabilityCol="probability")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(data)


def scan(docs: DataFrame, model: PipelineModel, path: str = "source") -> DataFrame:
    """One row for each candidate: doc_id, number, value, probability and is_secret.

    Null and empty texts have no candidates. Long texts are scanned whole; repeated
    rows give repeated findings. A null path speaks neither way. Other columns of docs
    are not looked at. An empty table gives an empty result.
    """
    scored = model.transform(with_features(candidates(docs, path)))
    probability = F.round(vector_to_array("probability")[1], 9)
    return scored.select("doc_id", "number", "value", probability.alias("probability"), (probability >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, model: PipelineModel, mask: str = "<SECRET>") -> DataFrame:
    """docs with every value found to be a secret replaced by mask, wherever it stands in the text of that doc_id.

    Null and empty texts, and those without secrets, stay as they are; long texts are
    masked whole. Rows that share a doc_id, the null one included, share their secrets,
    so repeated rows are masked alike. All columns stay, whatever their names; an empty
    table stays empty.
    """
    secrets = scan(docs, model).where("is_secret").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("value").alias("__values"))
    joined = docs.join(secrets, docs["doc_id"].eqNullSafe(F.col("__id")), "left")
    longest_first = F.reverse(F.array_sort(F.transform("__values", lambda v: F.struct(F.length(v), v.alias("v")))))
    text = F.when(F.col("__values").isNull(), docs["text"]).otherwise(F.aggregate(longest_first, docs["text"], lambda t, v: F.replace(t, v["v"], F.lit(mask))))
    return joined.select(*[(text.alias("text") if c == "text" else docs[c]) for c in docs.columns])


def made_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """n labelled findings made by rule, half of them secrets, for use where no reviewed findings are at hand.

    Secrets are random strings behind an assignment. False positives are checksums and
    identifiers named as such, random strings in paths of tests and examples, and names
    put together from dictionary words and numbers. Row k depends on k alone.
    """
    k = F.col("id")
    digest = lambda salt, bits=256: F.sha2(F.concat(F.lit(f"{salt}:"), k.cast("string")), bits)
    pick = lambda salt, values: F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(F.lit(salt), k), F.lit(len(values))).cast("int"))
    sized = lambda text, salt, sizes: F.substring(text, F.lit(1), pick(salt, sizes))
    base64 = F.regexp_replace(F.base64(F.unhex(digest("b64", 512))), "[=\n\r]", "")
    upper = F.upper(F.translate(base64, "+/", "XZ"))
    random = F.when(k % 3 == 0, sized(digest("hex"), "hl", [32, 40, 64])).when(k % 3 == 1, sized(base64, "bl", [20, 32, 40, 64])).otherwise(sized(upper, "ul", [16, 20, 24]))
    words = F.concat_ws("_", pick("w1", DICTIONARY), pick("w2", DICTIONARY), pick("w3", DICTIONARY), F.pmod(F.xxhash64(k), F.lit(1000)).cast("string"))
    dash = lambda t: F.concat_ws("-", *[F.substring(t, F.lit(a), F.lit(b)) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    case = F.pmod(F.xxhash64(F.lit("case"), k), F.lit(4))
    lead = pick("lead", ["", "the ", "set the ", "with ", "of ", "x. "])
    named = F.concat(lead, pick("for", FOR_WORDS), pick("op", [" = \"", "=", ": ", " = '", "\": \"", " = "]))
    checksum = F.concat(lead, pick("ag", AGAINST_WORDS), pick("op2", [" ", ": ", "=", " \""]))
    secret = F.struct(pick("p", ["src", "config", "web", "notes", "src7"]).alias("path"), named.alias("before"), random.alias("value"), F.lit(1).alias("label"))
    false = F.when(case == 0, F.struct(pick("p", ["src", "web", "src7", "log"]).alias("path"), checksum.alias("before"), sized(digest("f"), "fl", [32, 40, 64]).alias("value"), F.lit(0).alias("label")))
    false = false.when(case == 1, F.struct(pick("p", ["src", "web"]).alias("path"), F.concat(lead, pick("op3", ["id ", "uuid=", "uuid: ", "request "])).alias("before"), dash(digest("u")).alias("value"), F.lit(0).alias("label")))
    false = false.when(case == 2, F.struct(pick("pt", ["tests/unit", "docs/example", "demo/app", "sample"]).alias("path"), named.alias("before"), random.alias("value"), F.lit(0).alias("label")))
    false = false.otherwise(F.struct(pick("p", ["src", "web", "config"]).alias("path"), F.when(k % 2 == 0, named).otherwise(lead).alias("before"), words.alias("value"), F.lit(0).alias("label")))
    return spark.range(n).select(F.when(k % 2 == 0, secret).otherwise(false).alias("f")).select("f.*").where(F.length("value") >= MIN_LENGTH)
