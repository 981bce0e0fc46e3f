"""Secret scan: candidate strings by form, false positives removed by a random forest.

``findings`` names every word that has the form of a secret: long strings that mix digits with letters, known key prefixes, and values
assigned to a name such as password or token. The forest (trained by ``fit`` from labelled findings) judges each by its length, its
character transitions (changes of kind, and letter pairs usual in words), how much of it a list of ordinary words covers, the shape of
paths in it and in the record's own path, and its neighbouring words. ``masked`` puts a mark in place of each secret.

Null and empty texts have no findings. A record's text is scanned whole; repeated rows give their findings each. Null path: empty. An empty table gives no
findings. Only the named columns are read; ``masked`` passes other columns through, whatever their names. Only DataFrame functions and
the JVM's forest are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "[SECRET]"
#: Names that secrets are assigned to, words near strings that only look like secrets, key prefixes of providers.
NAMES = r"passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key"
HARMLESS = r"commit|revision|sha1?|sha256|md5|hash|checksum|digest|uuid|guid|version|build|order|invoice|isbn|card|phone|tel|example|sample|dummy|test|placeholder|doi"
PREFIXES = r"AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ|npm_"
#: Ordinary words and letter pairs.
WORDS = r"password|passwd|secret|token|change|example|sample|dummy|test|your|here|key|user|admin|default|none|null|true|false|value|string|number|name|this|that|with|from|have|will|into|over|under|about|http|https|www|com|org|net|html|index|page|file|path|home|lib|usr|bin|etc|var|local|share|python|java|node|module|package|version|release|build|image|data|table|error|warning|info|debug|main|master|branch|commit"
PAIRS = r"th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|el|la|ta|ci|do|ie|ge|ei|un|qu|ue|au|ai|ment"
LONG = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}"
#: Never narrower than what ``findings`` takes: the value may stand on a later line.
ASSIGNED = rf"(?i)(?:{NAMES})[\"']?[\x20\x09-\x0D]*[=:][\x20\x09-\x0D]*[^\x20\x09-\x0D]{{6,}}"
CANDIDATE = rf"{LONG}|(?i:(?:{NAMES})[\"']?[=:][\"']?[^\s\"']{{6,}})|(?:{PREFIXES})[A-Za-z0-9_-]{{12,}}"
FEATURES = ["size", "kinds", "pairs", "digits", "upper", "distinct", "covered", "repeats", "pathlike", "test_path", "named", "harmless", "prefix", "assigned"]
#: Labelled findings that the forest is trained on at most, and its shape.
TRAINING_ROWS, TREES, DEPTH, SEED = 6_000, 40, 8, 3


def _bare(word: Column) -> Column:
    """A word without the name it is assigned to and without quotes and punctuation around it."""
    value = F.regexp_replace(word, r"^[\"'({\[]*[A-Za-z_][\w.-]*[\"']?[=:][\"']?(?=[^=\s])", "")
    return F.regexp_replace(value, r"^[^A-Za-z0-9+/_-]+|[^A-Za-z0-9+/_=-]+$", "")


def _form(text: Column) -> Column:
    """Whether a text can hold a finding."""
    return text.rlike(f"{LONG}|(?:{PREFIXES})[A-Za-z0-9_-]{{12,}}") | text.rlike(ASSIGNED)


def findings(docs: DataFrame, keys: list[str], text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: keys, position (of the word in the text), word, value, near (four neighbours), path."""
    some = docs.filter(_form(F.col(text)))
    words = some.select(*keys, F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.split(text, r"[\x20\x09-\x0D]+").alias("_words"))

    def at(w: Column, i: Column) -> Column:
        near = [F.when(i + d >= 0, F.get("_words", i + d)) for d in (-3, -2, -1, 1, 2)]
        return F.struct(i.cast("long").alias("position"), w.alias("word"), F.concat_ws(" ", *near[:3]).alias("before"), F.concat_ws(" ", *near[3:]).alias("after"))

    def wanted(c: Column) -> Column:
        return c["word"].rlike(CANDIDATE) | (c["before"].rlike(rf"(?i)(?:{NAMES})[\"']?[ ]*[=:]$") & c["word"].rlike(r"[^\s\"']{6,}"))

    found = words.select(*keys, "path", F.explode(F.filter(F.transform("_words", at), wanted)).alias("_c"))
    value = _bare(F.col("_c.word"))
    return found.select(*keys, F.col("_c.position").alias("position"), F.col("_c.word").alias("word"), value.alias("value"), F.col("_c.before").alias("before"), F.col("_c.after").alias("after"), "path").filter(F.length("value") >= 6)


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` (word, value, before, after, path) with FEATURES."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    small = F.lower(v)
    flag = lambda c: c.cast("double")
    around = F.concat_ws(" ", "before", F.regexp_extract("word", r"^[\"'({\[]*([A-Za-z_][\w.-]*)[\"']?[=:]", 1), "after")
    f = {
        "size": n,
        "kinds": count(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Za-z0-9](?=[^A-Za-z0-9])") / n,
        "pairs": F.regexp_count(small, F.lit(f"(?={PAIRS})")).cast("double") / n,
        "digits": count("[0-9]") / n,
        "upper": count("[A-Z]") / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        "covered": 1 - F.length(F.regexp_replace(small, WORDS, "")) / n,
        "repeats": flag(v.rlike(r"(.)\1{3,}|(?:012345|123456|abcdef)")),
        "pathlike": count("[/.:]") / n,
        "test_path": flag(F.col("path").rlike(r"(?i)\b(?:test|tests|example|examples|sample|docs?|fixture)")),
        "named": flag(around.rlike(f"(?i)(?:{NAMES})")),
        "harmless": flag(around.rlike(rf"(?i)\b(?:{HARMLESS})\b")),
        "prefix": flag(v.rlike(f"^(?:{PREFIXES})")),
        "assigned": flag(F.col("word").rlike(r"^[\"'({\[]*[A-Za-z_][\w.-]*[\"']?[=:]") | F.col("before").rlike(r"[=:]$")),
    }
    return rows.withColumns(f)


def practice(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings in the forms that scanners meet, half of them false: word, value, before, after, path, label."""
    r = spark.range(rows, numPartitions=1)
    digest = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256)
    again = F.sha2(digest, 256)
    hexes = lambda a, n: F.substring(digest, a, n)
    big = F.translate(F.concat(digest, again), "0123456789abcdef", "QZ7XK2MJ4WPB6RTV")
    mixed = F.concat(*[F.translate(F.substring(again if k % 2 else digest, 4 * k + 1, 4), "0123456789abcdef", alphabet) for k, alphabet in enumerate(["aQ7zK2mJ4wPb6RtV", "xH1sD9fGq3LkE8yN", "Uo5cYi0vTeAjS2hB", "pW6gXn4MrZ1dFuC9", "Kq8aLw3sJe7rHt5y", "bN2mVc6xQz9pOl1k", "Rf4tGy7hUj0iKo3P", "eD5wSq8aZx1cVb6n", "Mj9nBh2gVf5dCs7x", "Tz3yXu6wVi1rUo8q"])])
    turn = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.conv(hexes(1, 4), 16, 10).cast("int") % len(xs) + 1))
    other = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.conv(hexes(9, 4), 16, 10).cast("int") % len(xs) + 1))
    word = turn("the", "thorn", "ander", "with", "reti", "und", "que", "ción", "heit", "erly", "of", "into")
    name = other("password", "passwd", "secret", "api_key", "token", "db_password", "auth_token", "client_secret")
    uuid = F.concat_ws("-", hexes(1, 8), hexes(9, 4), hexes(13, 4), hexes(17, 4), hexes(21, 12))
    digits = F.substring(F.regexp_replace(F.concat(digest, again), "[a-f]", ""), 1, 16)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kinds: list[tuple[int, Column, Column, Column]] = [
        # label, word, words before, words after
        (1, F.concat(F.lit("AKIA"), F.substring(big, 1, 16)), F.concat_ws(" ", word, word, word), word),
        (1, F.concat(name, F.lit("="), hexes(3, 18)), F.concat_ws(" ", word, word, word), word),
        (1, quoted(hexes(1, 40)), F.concat_ws(" ", word, name, F.lit("=")), word),
        (1, F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.concat_ws(" ", word, word, other("use", "with", "token")), word),
        (1, F.concat(name, F.lit(":"), F.substring(mixed, 3, 24)), F.concat_ws(" ", word, word, word), word),
        (1, F.substring(mixed, 1, 32), F.concat_ws(" ", word, name, F.lit(":")), word),
        (1, F.concat(name, F.lit("="), F.substring(mixed, 2, 12)), F.concat_ws(" ", word, word, word), word),
        (0, hexes(1, 40), F.concat_ws(" ", word, word, other("commit", "sha1", "revision", "hash")), word),
        (0, uuid, F.concat_ws(" ", word, word, other("uuid", "guid", "id", "record")), word),
        (0, hexes(1, 32), F.concat_ws(" ", word, other("md5", "checksum", "digest", "hash"), other("of", ":", "=")), word),
        (0, F.concat(name, F.lit("="), other("changeme", "your_password_here", "xxxxxxxxxxxx", "example12345", "password123", "secret_key_here", "test1234567", "none_default", "placeholder1")), F.concat_ws(" ", word, word, word), word),
        (0, digits, F.concat_ws(" ", word, word, other("card", "order", "phone", "number", "the", "with")), word),
        (0, F.concat(F.lit("/usr/lib/python3/"), word, F.lit("/"), name, hexes(1, 2)), F.concat_ws(" ", word, word, other("in", "file", "see")), word),
        (0, F.concat(word, F.lit("thonterheand"), word, F.substring(digits, 1, 2)), F.concat_ws(" ", word, word, word), word),
        (0, F.concat(F.lit("2024-0"), F.substring(digits, 1, 1), F.lit("-1"), F.substring(digits, 2, 1), F.lit("T10:11:1"), F.substring(digits, 3, 1)), F.concat_ws(" ", word, word, word), word),
        (0, F.concat(F.lit("build-"), F.substring(digits, 1, 6), F.lit("-"), hexes(1, 7)), F.concat_ws(" ", word, word, other("version", "release", "build")), word),
    ]
    kind = F.col("id") % len(kinds)
    pick = lambda column: F.element_at(F.array(*[k[column] for k in kinds]), (kind + 1).cast("int"))
    path = F.when(kind >= 7, other("src1", "src2", "tests/unit", "examples", "docs", "main")).otherwise(other("src1", "src2", "src3", "main", "config", "deploy"))
    out = r.select(pick(1).alias("word"), pick(2).alias("before"), pick(3).alias("after"), path.alias("path"), F.element_at(F.array(*[F.lit(k[0]) for k in kinds]), (kind + 1).cast("int")).cast("double").alias("label"))
    return out.withColumn("value", _bare(F.col("word")))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, most: int = TRAINING_ROWS) -> RandomForestClassificationModel:
    """A forest from labelled findings (word, value, before, after, path, label); at most ``most`` of them, those of the smallest hash."""
    sample = labelled.orderBy(F.xxhash64("word", "before", "after", "path"), "word", "before").limit(most)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(measured(sample)).select("features", "label").coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)


def judged(found: DataFrame, model: RandomForestClassificationModel, least: float = 0.5) -> DataFrame:
    """``found`` with ``probability`` and ``is_secret``."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(measured(found))
    out = model.transform(rows).withColumn("_p", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "prediction", "probability", *FEATURES).withColumnRenamed("_p", "probability").withColumn("is_secret", F.col("probability") >= least)


def masked(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", path: str = "source") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by MARK; records without candidates are not shuffled."""
    form = F.coalesce(_form(F.col(text)), F.lit(False))
    plain, some = docs.filter(~form), docs.filter(form)
    # equal texts with equal paths have equal findings, so their fingerprint is key enough
    mark = F.sha2(F.concat_ws("\u0001", F.coalesce(F.col(path).cast("string"), F.lit("")), text), 256)
    told = judged(findings(some.select(F.col(text), F.col(path), mark.alias("__secret_mark")).dropDuplicates(["__secret_mark"]), ["__secret_mark"], text, path), model).filter("is_secret")
    values = told.groupBy("__secret_mark").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct((-F.length("value")).alias("n"), F.col("value").alias("v"))))).alias("__secret_values"))
    joined = some.withColumn("__secret_mark", mark).join(values, "__secret_mark", "left")
    clean = F.aggregate(F.coalesce("__secret_values", F.array().cast("array<struct<n:int,v:string>>")), F.col(text), lambda t, s: F.replace(t, s["v"], F.lit(MARK)))
    return plain.unionByName(joined.withColumn(text, clean).select(*[f"`{c}`" for c in docs.columns]))
