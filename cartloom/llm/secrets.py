"""Secrets in documents, false findings removed by a random forest.

A candidate is a run of key characters in a word, long enough and with a digit,
a key of a known form, or whatever is assigned to a name of secrets, however
short or plain. Each gets features of its own characters (length, kinds, transitions between
kinds, share that dictionary words cover), of its neighbouring words and of its
path, and a forest learned from labelled findings tells how likely it is a
secret. All of it is columns, SQL functions and Spark's own forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.registry import llm_query, read, written

RUN = r"[A-Za-z0-9+/_\-]{12,}={0,2}"
"""What a candidate without a name is made of; one digit at least is asked for besides."""
DICTIONARY = 20_000
"""Most frequent words of the corpus that count as dictionary; the bound of what is broadcast."""
SAMPLE = 20_000
"""Labelled findings that the forest learns from at most."""
TREES, DEPTH, SEED = 40, 8, 20240607
LIMIT = 0.5

# What tells findings by their form, and words that point to secrets, places of tests, and calls for them.
KEY_FORMS = r"^(AKIA|ASIA)[0-9A-Z]{16}$"
ASSIGNED = r"(?i)(token|secret|passw(or)?d|pwd|api_?key|credential)\s*[=:]\s*[\"']?$"
FORMS = r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|eyJ[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]*+)"
NAMED = r"(?i)(?:token|secret|pass|pwd|key|auth|credential|login)[a-z0-9_.\-]{0,40}+[\"'`\]]{0,3}+\s*[=:]{1,3}+>?\s*(?:(?:bearer|basic)\s+)?"
NUMBER = r"^[0-9]+$"
KEY_WORDS = r"(?i)(token|secret|passw|pwd|key|auth|credential|login)"
TEST_PATHS = r"(?i)(test|example|sample|spec|doc|fixture|mock)"

TRANSITIONS = {
    "letter_digit": r"(?<=[A-Za-z])(?=[0-9])", "digit_letter": r"(?<=[0-9])(?=[A-Za-z])",
    "lower_upper": r"(?<=[a-z])(?=[A-Z])", "upper_lower": r"(?<=[A-Z])(?=[a-z])", "to_mark": r"(?<=[A-Za-z0-9])(?=[+/_\-])",
    "vowel_consonant": r"(?<=[aeiouAEIOU])(?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])", "same": r"(.)(?=\1)",
}
FEATURES = ["length", "digits", "uppers", "lowers", "marks", "distinct_chars", "hex_only", *TRANSITIONS, "coverage",
            "before_key", "before_assign", "inside_assign", "quoted", "after_letters", "before_letters", "path_test", "path_depth"]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, position, path, value, lead, tail, before, after), one row per candidate of whole texts.

    What stands after a name of secrets and = or : is a candidate up to the
    word's end, without quotes around it; of a quoted value of several words the
    first. Cloud keys and web tokens are candidates anywhere.
    ``position`` is the word's number; lead and tail are the rest of its word
    around the value, before and after its two neighbours on each side. A word with several
    runs gives several rows. Null and empty texts have none.
    """
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    # The three words before a word may hold the name that it is assigned to. They are zipped to it rather than looked
    # up, since the optimizer may copy the split into whatever a lambda refers to; nothing stands for a missing word.
    own = F.col("_words")
    nothing = F.array_repeat(F.lit(None).cast("string"), 3)
    earlier = lambda k: F.slice(F.concat(F.slice(nothing, 1, k), own), F.lit(1), F.size(own)).alias(f"b{k}")
    later = lambda k: F.slice(F.concat(own, nothing), F.lit(k + 1), F.size(own)).alias(f"a{k}")
    tail = NAMED + r"(\S+)$"
    sides = ["b2", "b1", "a1", "a2"]
    spot = lambda z, i, assigned: F.struct(z["w"].alias("word"), *(z[c].alias(c) for c in sides), i.alias("position"), assigned.alias("assigned"))
    signed = lambda *parts: F.coalesce(F.greatest(*(F.instr(x, "=") + F.instr(x, ":") for x in parts)), F.lit(0)) > 0
    zipped = F.arrays_zip(own.alias("w"), earlier(1), earlier(2), earlier(3), later(1), later(2))
    near = F.transform(zipped, lambda z, i: spot(
        z, i, F.when(signed(z["b2"], z["b1"], z["w"]), F.regexp_extract(F.concat_ws(" ", z["b3"], z["b2"], z["b1"], z["w"]), tail, 1)).otherwise("")))
    plain = F.transform(zipped, lambda z, i: spot(z, i, F.lit("")))
    run = lambda s: (F.length(s["word"]) >= 12) & s["word"].rlike(r"[0-9]")
    wanted = lambda s: run(s) | (s["assigned"] != "") | (F.length(s["word"]) >= 8) & s["word"].rlike(FORMS)
    # Each spot carries its neighbours, never the text, so that a text of many candidates stays of its own size.
    small = lambda s: F.struct(s["word"].alias("word"), s["position"].alias("position"), s["assigned"].alias("assigned"),
                               F.concat_ws(" ", s["b2"], s["b1"]).alias("before"), F.concat_ws(" ", s["a1"], s["a2"]).alias("after"))
    # Neighbours are zipped only where a word can be a candidate at all.
    any_word = F.exists(own, lambda w: (F.length(w) >= 12) & w.rlike(r"[0-9]") | (F.length(w) >= 8) & w.rlike(FORMS))
    spots = (F.when(F.col("_named"), F.transform(F.filter(near, wanted), small))
             .when(any_word, F.transform(F.filter(plain, wanted), small)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).cast("string").alias("path"), words.alias("_words"),
                       F.coalesce(F.col(text).rlike(NAMED), F.lit(False)).alias("_named")).select("doc_id", "path", spots.alias("_spots"))
    spotted = rows.filter(F.size("_spots") > 0).select("doc_id", "path", F.explode("_spots").alias("s"))
    runs = F.filter(F.regexp_extract_all(F.col("s.word"), F.lit(RUN), F.lit(0)), lambda v: v.rlike(r"[0-9]"))
    raw = F.col("s.assigned")
    quoted = F.regexp_extract(raw, r"^([\"'`])(.+?)\1", 2)
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[\"'`]+", ""), r"[\"'`,;]+$", "")
    named = F.filter(F.array(F.when(quoted != "", quoted).otherwise(bare)), lambda v: v != "")
    values = F.concat(runs, F.array_except(F.concat(F.regexp_extract_all(F.col("s.word"), F.lit(FORMS), F.lit(0)), named), runs))
    around = spotted.select(
        "doc_id", F.col("s.position").cast("long").alias("position"), F.coalesce("path", F.lit("")).alias("path"), F.col("s.word").alias("word"),
        F.explode(values).alias("value"), F.col("s.before").alias("before"), F.col("s.after").alias("after"))
    begin = F.instr("word", F.col("value"))
    return around.select("doc_id", "position", "path", "value", F.expr("substring(word, 1, instr(word, value) - 1)").alias("lead"),
                         F.substring("word", begin + F.length("value"), F.length("word")).alias("tail"), "before", "after")


def dictionary(docs: DataFrame, size: int = DICTIONARY, text: str = "text") -> DataFrame:
    """The corpus's most frequent words of 3 letters and more; ties by the word."""
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"))
    counts = written(docs.select(word.alias("word")).filter("length(word) >= 3").groupBy("word").agg(F.count("*").alias("n")))
    # How many words are at least as frequent as each power of 2^(1/8): only those from the last step needed are sorted.
    step = F.floor(F.log2("n") * 8).alias("step")
    steps = sorted(((r.step, r["count"]) for r in counts.groupBy(step).count().collect()), reverse=True)
    least, held = 0, 0
    for least, n in steps:
        held += n
        if held >= size:
            break
    return written(counts.filter(F.floor(F.log2("n") * 8) >= least).orderBy(F.desc("n"), "word").limit(size).select("word"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns FEATURES."""
    value, length = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / length
    near = F.concat_ws("", F.col("before"), F.lit(" "), F.col("lead"))
    columns = {
        "length": length, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "marks": share("[^0-9A-Za-z]"),
        "distinct_chars": F.size(F.array_distinct(F.split(value, ""))) / length,
        "hex_only": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "before_key": near.rlike(KEY_WORDS).cast("double"), "before_assign": F.col("before").rlike(r"[=:]$").cast("double"),
        "inside_assign": F.col("lead").rlike(r"[=:][\"']?$").cast("double"),
        "quoted": (F.col("lead").rlike("[\"']$") & F.col("tail").rlike("^[\"']")).cast("double"),
        "before_letters": F.regexp_count("before", F.lit(r"\p{L}")).cast("double"), "after_letters": F.regexp_count("after", F.lit(r"\p{L}")).cast("double"),
        "path_test": F.col("path").rlike(TEST_PATHS).cast("double"), "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
    } | {name: share(pattern) for name, pattern in TRANSITIONS.items()}
    # Letters of the value's alphabetic parts that are dictionary words.
    distinct = found.select("value").distinct()
    parts = distinct.select("value", F.explode(F.split(F.lower("value"), r"[^a-z]+")).alias("word")).filter("length(word) >= 3")
    covered = parts.join(F.broadcast(words), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    joined = found.join(covered, "value", "left").withColumn("coverage", F.coalesce("covered", F.lit(0)) / length).drop("covered")
    return joined.withColumns(columns)


def labelled_by_form(found: DataFrame) -> DataFrame:
    """Findings with a label where their form decides: 1 for a cloud key or an assignment to a
    name of secrets, 0 for bare numbers; the others are left out."""
    named = F.concat_ws(" ", F.col("before"), F.col("lead")).rlike(ASSIGNED)
    label = F.when(F.col("value").rlike(KEY_FORMS) | named, 1.0).when(F.col("value").rlike(NUMBER), 0.0)
    plain = F.when(F.col("coverage") >= 0.5, 0.0)
    return found.withColumn("label", F.coalesce(label, plain)).filter("label IS NOT NULL")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest from at most ``sample`` labelled findings, those of the smallest hashes; None unless both labels occur."""
    drawn = labelled.orderBy(F.xxhash64(F.lit(SEED), "value", "before"), "value", "before", "position").limit(sample)
    rows = written(drawn.select("label", *(F.col(c).cast("double").alias(c) for c in FEATURES)))
    if rows.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(assembled.select("label", "features"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """One row per candidate: doc_id, position, value_sha256, length, probability, secret.

    ``labelled`` has candidates with FEATURES and a label; without it findings
    whose form decides are the labels. Where labels do not show both kinds
    nothing can be learned: the probability is null and every candidate counts
    as a secret. Repeated rows are scanned each for itself; an empty table gives
    no rows.
    """
    found = written(candidates(docs))
    featured = written(with_features(found, dictionary(docs)))
    model = fit(labelled if labelled is not None else labelled_by_form(featured))
    if model is None:
        scored = featured.withColumn("probability", F.lit(None).cast("double"))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured)
        scored = model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("doc_id", "position", F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("int").alias("length"),
                         "probability", F.coalesce(F.col("probability") >= limit, F.lit(True)).alias("secret"))


@llm_query("op7_secret_scan")
def op7_secret_scan(spark, folder):
    """All candidates of all documents."""
    return scan(read(spark, folder, "documents"))
