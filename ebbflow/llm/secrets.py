"""Secret scan: wide candidates, a random forest takes out false positives.

Candidates are long runs of key characters, and values of any characters that
are assigned to a credential's name.  The forest sees their length,
character classes and changes between them, how much of them dictionary words
cover, whether they are part of a path or address, and the words beside them.
It is trained from labelled findings (those of ``findings.py`` unless others are given).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled
from .findings import WORDS, findings as shipped

#: Words before a credential (fixed values).
CUES = "api|auth|bearer|credential|key|passwd|password|pwd|secret|token"
#: Shortest candidate, shortest value of a credential's name, and how much text on either side is looked at.
LEAST, LEAST_VALUE, BEFORE, AFTER = 16, 8, 40, 16
#: A value after a cue and = or :; the shorter look-behinds are there to be cheap.
VALUE = (rf"(?<=[=:\s\"'])(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{CUES})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)"
         rf"[^\s\"']{{{LEAST_VALUE - 1},}}[^\s\"',;.)]")
CANDIDATE = rf"{VALUE}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}"
#: Words of at least this share of the corpus' words are its vocabulary (so 1 / SHARE at most).
SHARE = 1e-5
#: Letters of a word in a candidate: shorter ones turn up in any random run.
WORD = (4, 12)
FEATURES = ("length", "digits", "uppers", "signs", "variety", "changes", "digit_letter", "letter_digit", "case_changes",
            "hexadecimal", "coverage", "in_path", "in_address", "cue", "assigned", "quoted", "word_before")
#: Known forms of credentials, (before, candidate) patterns (fixed values); they count where findings hold one label only.
FORMS = ((r"", r"AKIA[0-9A-Z]{16}"), (r"", r"gh[pousr]_[A-Za-z0-9]{36}"), (r"", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
         (r"(?i)(?:token|secret|api_?key)\s*[=:]\s*[\"']$", r"[0-9a-f]{32,64}"),
         (r"(?i)(?:password|passwd|pwd)\s*[=:]\s*[\"']?$", r"(?=.*[0-9])[A-Za-z0-9+/_-]{16,}"))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``begin``, ``end``, ``candidate``, ``before``, ``after`` for
    every run of key characters in the whole text; offsets in code points.
    Rows that repeat id and text are reported once."""
    text = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where(F.col("text").rlike(CANDIDATE))
    parts = text.select("doc_id", "mark", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
                        F.transform(F.split("text", CANDIDATE, -1), lambda g: F.struct(
                            F.length(g).alias("n"), F.right(g, F.lit(BEFORE)).alias("tail"), F.left(g, F.lit(AFTER)).alias("head"))).alias("gaps"))
    rows = parts.select("doc_id", "mark", F.posexplode(F.transform("found", lambda c, i: F.struct(
        c.alias("candidate"), F.get("gaps", i).alias("gap"), F.get("gaps", i + 1)["head"].alias("after")))).alias("pos", "x")).select(
        "doc_id", "mark", "pos", "x.candidate", F.col("x.gap.n").alias("gap"), F.col("x.gap.tail").alias("before"), "x.after")
    one = W.partitionBy("doc_id", "mark", "pos").orderBy("pos")
    rows = rows.withColumn("nth", F.row_number().over(one)).where("nth = 1")
    so_far = W.partitionBy("doc_id", "mark").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.length("candidate")).over(so_far)
    return rows.withColumn("end", end).select("doc_id", (F.col("end") - F.length("candidate")).alias("begin"), "end", "candidate", "before", "after")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word``: the words with a share of SHARE or more of all rows' words,
    and those that the shipped findings are made of."""
    lo, hi = WORD
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![a-z0-9])[a-z]+(?![a-z0-9])"), F.lit(0)))
    counts = settled(docs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") >= max(2, SHARE * total)).where(F.length("word").between(lo, hi)).select("word")
    return settled(often.unionAll(docs.sparkSession.createDataFrame([(w,) for w in WORDS], "word string")).distinct())


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """``candidate``, ``coverage``: the share of each distinct candidate's
    characters that lie in one of ``words``, wherever in it they begin."""
    lo, hi = WORD
    one = found.select("candidate").distinct()
    low = F.lower("candidate")
    places = one.select("candidate", low.alias("low"), F.explode(F.sequence(F.lit(1), F.length("candidate"))).alias("at")).where(
        F.substr("low", F.col("at"), F.lit(lo)).rlike(f"^[a-z]{{{lo}}}$"))
    parts = places.select("candidate", "at", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("n"), "low").where(
        F.col("at") + F.col("n") - 1 <= F.length("candidate")).select("candidate", "at", "n", F.substr("low", F.col("at"), F.col("n")).alias("word"))
    reach = parts.join(F.broadcast(words), "word").groupBy("candidate", "at").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    before = F.coalesce(F.max("end").over(W.partitionBy("candidate").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(1))
    new = F.greatest(F.col("end") - F.greatest("at", before), F.lit(0))
    return (reach.select("candidate", new.alias("new")).groupBy("candidate")
            .agg((F.sum("new") / F.length("candidate")).alias("coverage")))


def _share(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns of FEATURES."""
    c, before, after = F.col("candidate"), F.col("before"), F.coalesce("after", F.lit(""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[+/_=-]", "_"), "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    n = F.length(c) - 1
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1
    pairs = lambda p: F.regexp_count(kinds, F.lit(p)) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.join(covered(found, words), "candidate", "left").withColumns({
        "length": F.length(c).cast("double"), "digits": _share(c, "[^0-9]"), "uppers": _share(c, "[^A-Z]"), "signs": _share(c, "[A-Za-z0-9]"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.length(c), "changes": runs / n,
        "digit_letter": pairs("9(?=[aA])"), "letter_digit": pairs("[aA](?=9)"), "case_changes": pairs("a(?=A)|A(?=a)"),
        "hexadecimal": _share(c, "[^0-9a-fA-F]"), "coverage": F.coalesce("coverage", F.lit(0.0)), "in_path": flag(c.contains("/") | before.rlike("[/\\\\]$") | after.startswith("/")),
        "in_address": flag(before.rlike("[@.]$") | after.rlike("^[@.][A-Za-z0-9]")), "cue": flag(before.rlike(rf"(?i)(?:{CUES})[\"']?\s*[=:]?\s*[\"']?$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")), "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "word_before": flag(before.rlike(r"[A-Za-z]{2,}[,.]?\s$"))})


def known_form(candidate: Column, before: Column) -> Column:
    """Whether a finding has one of the known forms of credentials."""
    out = F.lit(False)
    for b, c in FORMS:
        fits = candidate.rlike(f"^(?:{c})$")
        out = out | (fits & before.rlike(b) if b else fits)
    return out


def labelled(spark: SparkSession) -> DataFrame:
    """The shipped findings: candidate, before, after, label."""
    return spark.createDataFrame(shipped(), "candidate string, before string, after string, label double")


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> PipelineModel | None:
    """Forest from findings with the columns of FEATURES and ``label``; None if
    only one label occurs."""
    if findings.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector", labelCol="label",
                                    rawPredictionCol="raw", probabilityCol="odds", predictionCol="guess")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    model: RandomForestClassificationModel = forest.fit(assembler.transform(findings))
    return PipelineModel([assembler, model])


def scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``doc_id``, ``begin``, ``end``, ``length``, ``score`` of the candidates
    that the forest scores ``least`` or more.

    ``findings`` are labelled ones (candidate, before, after, label); without
    them the shipped ones.  If they hold one label only, all candidates of a known form stay with score 1.
    Null and empty texts have no candidates; only doc_id and text are read."""
    words = vocabulary(docs)
    found = settled(features(settled(candidates(docs)), words))
    known = settled(features(labelled(docs.sparkSession) if findings is None else findings, words))
    model = train(known)
    if model is None:
        kept = found.where(known_form(F.col("candidate"), F.col("before"))).withColumn("score", F.lit(1.0))
    else:
        kept = model.transform(found).withColumn("score", F.get(vector_to_array("odds"), F.lit(1))).where(F.col("score") >= least)
    return kept.select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"),
                       F.col("length").cast("long").alias("length"), "score")
