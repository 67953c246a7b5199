"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least LEAST characters of a key alphabet, with a digit, in a white-space
token; each run of a token is one, told apart by ``run``. Its features are length, character transitions, dictionary coverage (share of its
letters in runs that are frequent words of the corpus), path shape, and the two words before it and
the one after. A random forest trained on labelled findings scores each candidate. Everything is
DataFrame functions and Spark's own forest.

At most ``sample`` labelled findings are fitted (a documented bound). Null and empty texts hold no
candidate; without findings of both labels each candidate gets the score of the only label, or 0, if
findings are given;
repeated rows are each reported. Without findings at all, built-in rules label the candidates, and stand
in for the forest if they give one label only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import keyed, pinned

LEAST = 16
SAMPLE = 20_000
DICTIONARY = 10_000
_RUN = r"[A-Za-z0-9+/_=\-]{16,}"
#: Words that stand before a credential.
KEY_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|auth|bearer|credential|private|key)"

_LOGIN = rf"(?i)://[^/@]*:[^/@]+@|://.*[?&;#][^=&]*{KEY_WORDS[4:]}[^=&]*="
_MAIL = r"^[^A-Za-z0-9]*[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+[^A-Za-z0-9]*$"

FEATURES = [
    "length", "digits", "upper", "lower", "signs", "hex", "transitions", "distinct", "slashes", "dots", "at", "scheme",
    "quoted", "coverage", "key_word", "assigned", "before_length", "after_length",
]


def _word(tokens: Column, at: Column) -> Column:
    return F.coalesce(F.get(tokens, at), F.lit(""))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, run, token, value, lead, before, earlier, after): one row per candidate of each row.

    ``lead`` is what stands in the token between the run and the start of the run before it.
    """
    own = keyed(docs, key, text).withColumn("tokens", F.split(F.trim("text"), r"[ \t\n\r\x0b\f]+"))
    each = own.select("id", "tokens", F.posexplode("tokens").alias("pos", "token"))
    shaped = each.where((F.length("token") >= LEAST) & F.col("token").rlike(_RUN)).withColumns(
        {"runs": F.regexp_extract_all("token", F.lit(f"({_RUN})"), 1), "between": F.split("token", _RUN)}
    )
    split = shaped.select("*", F.posexplode("runs").alias("run", "value"))
    return split.where(F.col("value").rlike("[0-9]")).select(
        "id", "pos", "run", "token", "value",
        F.concat(F.when(F.col("run") > 0, F.get("runs", F.col("run") - 1)).otherwise(""), F.get("between", F.col("run"))).alias("lead"),
        _word(F.col("tokens"), F.col("pos") - 1).alias("before"),
        _word(F.col("tokens"), F.col("pos") - 2).alias("earlier"),
        _word(F.col("tokens"), F.col("pos") + 1).alias("after"),
    )


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word): the DICTIONARY most frequent runs of three letters or more, over all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z]+")).alias("word"))
    counted = words.where(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(DICTIONARY).select("word")


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with a double column for each of FEATURES."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.split(F.lower("value"), r"[^a-z]+")).alias("word"))
    # The dictionary has at most DICTIONARY rows.
    covered = runs.join(F.broadcast(words), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    joined = found.join(covered, "value", "left")
    first = F.col("run") == 0
    made = {
        "length": F.length("value"),
        "digits": _share("[^0-9]"),
        "upper": _share("[^A-Z]"),
        "lower": _share("[^a-z]"),
        "signs": _share("[A-Za-z0-9]"),
        "hex": _share("[^0-9a-fA-F]"),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) - 1) / F.length("value"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "slashes": F.length("token") - F.length(F.translate("token", "/", "")),
        "dots": F.length("token") - F.length(F.translate("token", ".", "")),
        "at": F.col("token").contains("@"),
        "scheme": F.col("token").contains("://"),
        "quoted": (first & F.col("token").rlike("^[\"'`]")) | F.col("lead").rlike("[\"'`]$"),
        "coverage": F.coalesce("covered", F.lit(0)) / F.length("value"),
        "key_word": (first & F.concat_ws(" ", "earlier", "before").rlike(KEY_WORDS)) | F.concat("lead", "value").rlike(KEY_WORDS + "[\"']?[=:]"),
        "assigned": (first & F.col("before").rlike("[=:]$")) | F.col("lead").rlike("[=:][\"'`]?$") | F.col("value").rlike("^[A-Za-z_]+="),
        "before_length": F.length("before"),
        "after_length": F.length("after"),
    }
    return joined.withColumns({name: column.cast("double") for name, column in made.items()}).drop("covered")


def scored(found: DataFrame, findings: DataFrame, sample: int = SAMPLE, trees: int = 20, rule: Column | None = None) -> DataFrame:
    """Add ``score`` to candidates with features; ``findings`` are such rows with ``secret`` (boolean).

    With one label only, ``rule`` (boolean) decides each candidate, or else the label.
    """
    labelled = findings.where(F.col("secret").isNotNull()).orderBy(F.xxhash64("value", "id", "pos", "run"), "value", "id", "pos", "run").limit(sample)
    fitted = pinned(labelled.select(*FEATURES, F.col("secret").cast("double").alias("label")))
    kinds = [row[0] for row in fitted.select("label").distinct().collect()]
    if len(kinds) < 2:
        return found.withColumn("score", F.lit(float(kinds[0]) if kinds else 0.0) if rule is None else rule.cast("double"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=8, seed=11)
    model = forest.fit(assembler.transform(fitted))
    judged = model.transform(assembler.transform(found))
    return judged.withColumn("score", vector_to_array("probability")[1]).select(*found.columns, "score")


def scan(docs: DataFrame, findings: DataFrame | None = None, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, pos, run, value_sha256, score, secret) of every candidate of every row.

    ``findings``: (id, pos, secret) of labelled candidates, and run where a token has several; without
    them, candidates assigned after a key word, quoted or not, count as secrets, and those of digits
    alone, of mail addresses and of URLs as false positives, and only those two kinds are trained on.
    URLs with a password or a key parameter get no label.
    """
    made = pinned(with_features(candidates(docs, key, text), dictionary(docs, text)))
    if findings is None:
        login = F.col("token").rlike(_LOGIN)
        sure = (F.col("key_word") == 1) & (F.col("assigned") == 1)
        other = (F.col("digits") == 1) | F.col("token").rlike(_MAIL) | (F.col("scheme") == 1)
        labelled = made.withColumn("secret", F.when(login, None).when(sure, True).when(other, False))
        judged = scored(made, labelled, rule=sure | login)
    else:
        on = [c for c in ("id", "pos", "run") if c in findings.columns]
        labelled = made.join(findings.select(*on, "secret"), on)
        judged = scored(made, labelled)
    return judged.select(
        F.col("id").alias(key), "pos", "run", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= least).alias("secret")
    )
