r"""Quality rules with distribution divergence (op2, built of DataFrame functions only).

Base counts of each text come first. Then a document's histograms, of character classes and of common words, are compared
with references of the languages by Jensen-Shannon distance (base 2, so 0 to 1). References are learned from all
documents with a language: median shares of the classes, and the most common words with their counts from a
frequent-items sketch over every word (its error is below ``3.5 / SKETCH`` of all words). The
document's own language counts, or, where that is too far or unknown, as language labels may be wrong, the least distance
over it and the ``LANGUAGES`` languages with most words. References of these are part of the plan; those of all other
languages are a table that documents are joined with by language, so every language has its own. Guards: texts of
fewer than ``MIN_WORDS`` words are not compared, and the limits widen with the inverse root of the length, as sampling
alone moves short histograms away.

Words are `[^\x20\x09-\x0D]+`; sizes are code points.

Cases: null and empty texts have no words and fail the base rule; without any language (empty table, all null) there is
no reference and the base rule alone decides; repeated rows are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, stored

#: a document far from its own language is compared with so many others, the ones with most words
LANGUAGES = 32
#: words of a reference
COMMON = 48
#: entries of the frequent-items sketch
SKETCH = 32768
MIN_WORDS = 30
MAX_CLASS_DISTANCE = 0.15
MAX_WORD_DISTANCE = 0.5
#: added to a limit: so much divided by the root of the number of words
SLACK = 1.0

CLASSES = ("lower", "space", "upper", "digit", "stop", "other")
_ROW = "doc_id"


def _words(body: Column) -> Column:
    return F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")


def _class_counts(df: DataFrame) -> DataFrame:
    """Adds ``_n_<class>``: each step strips one class, so that the next one has less to read."""
    left = "_body"
    for name, chars in (("lower", r"\p{Ll}+"), ("space", r"[\x20\x09-\x0D]+"), ("upper", r"\p{Lu}+"), ("digit", r"[0-9]+"), ("stop", r"[.,;:?'\"()-]+")):
        df = df.withColumn(f"_r_{name}", F.regexp_replace(left, chars, ""))
        df = df.withColumn(f"_n_{name}", F.length(left) - F.length(f"_r_{name}"))
        left = f"_r_{name}"
    return df.withColumn("_n_other", F.length(left)).drop(*[f"_r_{c}" for c in CLASSES])


def _read(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.coalesce("text", F.lit("")).alias("_body")).withColumn("_words", _words(F.col("_body")))


def fit(docs: DataFrame) -> tuple[list[str], list[dict], DataFrame | None]:
    """The references: per language the shares of classes (medians over its documents, which a minority of odd documents
    does not move) and of common words. Returns the common words of the ``LANGUAGES`` largest languages together, their
    references, and a table of all other languages' (lang, _o_classes, _o_words, _o_shares)."""
    texts = docs.where("lang IS NOT NULL")
    top = (texts.select("lang", F.explode(_words(F.col("text"))).alias("w")).groupBy("lang")
           .agg(F.count("*").alias("n"), F.expr(f"approx_top_k(w, {COMMON}, {SKETCH})").alias("top")))
    shares = (_class_counts(_read(texts, "lang").drop("_words")).where("length(_body) > 0")
              .groupBy("lang").agg(*[F.percentile_approx(F.col(f"_n_{c}") / F.length("_body"), 0.5, 1000).alias(c) for c in CLASSES]))
    whole = F.greatest(sum((F.col(c) for c in CLASSES), F.lit(0.0)), F.lit(1e-9))
    learned = stored(top.join(shares, "lang").select(
        "lang", "n", F.array(*[F.col(c) / whole for c in CLASSES]).alias("classes"),
        F.sort_array(F.transform("top", lambda x: F.struct(x["item"].alias("w"), (x["count"] / F.col("n")).alias("share")))).alias("words")), "references")
    largest = learned.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not largest:
        return [], [], None
    references = [{"lang": r["lang"], "classes": r["classes"], "words": {x["w"]: x["share"] for x in r["words"]}} for r in sorted(largest, key=lambda r: r["lang"])]
    others = learned.where(~F.col("lang").isin([r["lang"] for r in largest])).select(
        "lang", F.col("classes").alias("_o_classes"), F.col("words.w").alias("_o_words"), F.col("words.share").alias("_o_shares"))
    return sorted({w for x in references for w in x["words"]}), references, others


def _f(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _term(p: Column, q: Column | float) -> Column:
    """A cell's part of twice the divergence: p log2(2p / (p + q)) + q log2(2q / (p + q))."""
    q = q if isinstance(q, Column) else F.lit(float(q))
    return _f(p) + _f(q) - _f(p + q) + p + q


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice, F.lit(0.0)) / 2)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of five words that the text holds more than once. Windows are
    compared by 64-bit hash; only texts that have equal ones sort them."""
    size = 5
    ahead = lambda h, k: F.slice(h, k + 1, F.size(h))
    pair = lambda x, y: F.xxhash64(x, y)
    df = df.withColumn("_h", F.when(F.size("_words") > size, F.transform("_words", lambda w: F.xxhash64(w))))
    df = df.withColumn("_g2", F.zip_with("_h", ahead("_h", 1), pair)).withColumn("_g4", F.zip_with("_g2", ahead("_g2", 2), pair))
    df = df.withColumn("_g", F.slice(F.zip_with("_g4", ahead("_h", 4), pair), 1, F.size("_h") - 4)).drop("_g2", "_g4")
    twice = F.col("_g").isNotNull() & (F.size(F.array_distinct("_g")) < F.size("_g"))
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_sh", F.transform("_s", lambda x: x["h"]))
    same = lambda x, j: F.get("_sh", j).eqNullSafe(x["h"])
    at = F.sort_array(F.transform(F.filter("_s", lambda x, j: same(x, j + 1) | same(x, j - 1)), lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", computed(F.coalesce(F.when(F.col("_s").isNotNull(), covered), F.lit(0)).cast("long"))).drop("_h", "_g", "_s", "_sh")


def _word_runs(df: DataFrame, vocabulary: list[str] | str) -> DataFrame:
    """Adds ``_runs``: place in the vocabulary (a list, or the name of a column that holds each row's) and share of each
    common word of the text."""
    places = F.col(vocabulary) if isinstance(vocabulary, str) else F.array(*[F.lit(w) for w in vocabulary])
    common = (lambda w: F.array_contains(places, w)) if isinstance(vocabulary, str) else (lambda w: w.isin(vocabulary))
    df = df.withColumn("_hits", F.sort_array(F.filter("_words", common)))
    df = df.withColumn("_ends", F.filter(F.transform("_hits", lambda w, i: F.when(F.coalesce(F.get("_hits", i + 1) == w, F.lit(False)), -1).otherwise(i)), lambda i: i >= 0))
    df = df.withColumn("_runs", F.transform("_ends", lambda e, j: F.struct(
        (F.array_position(places, F.get("_hits", e)) - 1).cast("int").alias("w"), ((e - F.coalesce(F.get("_ends", j - 1), F.lit(-1))) / F.size("_words")).alias("p"))))
    return df.withColumn("_runs", F.transform("_runs", lambda x: F.struct(x["w"].alias("w"), x["p"].alias("p"), _f(x["p"]).alias("f"))))


def _word_divergence(shares: Column, total: Column) -> Column:
    """Distance of the text's common words from the shares of the vocabulary's words in a language."""
    def add(a, x):
        q = F.get(shares, x["w"])
        both = x["p"] + q
        return F.when(q > 0, F.struct((a["d"] + x["f"] + _f(q) - both * F.log2(both) + both).alias("d"), (a["p"] + x["p"]).alias("p"), (a["q"] + q).alias("q"))).otherwise(a)

    def close(a):
        # absent words hold their own share of distance; the rest of either side is one cell
        return _distance(a["d"] + (total - a["q"]) + _term(F.greatest(1 - a["p"], F.lit(0.0)), F.greatest(1 - total, F.lit(0.0))))

    return F.aggregate("_runs", F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")), add, close)


def _distances(df: DataFrame, vocabulary: list[str], references: list[dict], others: DataFrame | None) -> DataFrame:
    """Adds ``class_distance`` and ``word_distance`` (null without any reference): to the document's own language, or
    the least over that and the largest languages where that one is too far or there is none."""
    if not references:
        return df.withColumn("class_distance", F.lit(None).cast("double")).withColumn("word_distance", F.lit(None).cast("double"))
    df = _class_counts(df)
    chars = F.greatest(F.length("_body"), F.lit(1))
    shares = [F.array(*[F.lit(float(r["words"].get(w, 0.0))) for w in vocabulary]) for r in references]
    totals = [F.lit(float(sum(r["words"].values()))) for r in references]
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]  # noqa: E731  (nulls do not count)
    class_distance = lambda qs: _distance(sum((_term(F.col(f"_n_{c}") / chars, q) for c, q in zip(CLASSES, qs)), F.lit(0.0)))

    # the own language, where it is none of the largest: from the joined reference
    df = df.join(others, "lang", "left")
    total = F.aggregate("_o_shares", F.lit(0.0), lambda a, x: a + x)
    given = F.col("_o_words").isNotNull()
    df = _word_runs(df, "_o_words")
    df = df.withColumn("_o_word", F.when(given, _word_divergence(F.col("_o_shares"), total))).withColumn(
        "_o_class", F.when(given, class_distance([F.get("_o_classes", i) for i in range(len(CLASSES))]))).drop("_hits", "_ends", "_runs")

    df = _word_runs(df, vocabulary)
    classes = least([class_distance(r["classes"]) for r in references])
    own = F.array_position(F.array(*[F.lit(r["lang"]) for r in references]), F.col("lang")).cast("int") - 1
    df = df.withColumn("_at", own).withColumn("_shares", F.get(F.array(*shares), F.col("_at"))).withColumn("_total", F.get(F.array(*totals), F.col("_at")))
    df = df.withColumn("class_distance", F.least(classes, F.col("_o_class")))
    df = df.withColumn("_own", F.coalesce("_o_word", F.when(F.col("_at") >= 0, _word_divergence(F.col("_shares"), F.col("_total")))))
    return df.withColumn("word_distance", F.when(F.col("_own") <= MAX_WORD_DISTANCE, F.col("_own")).otherwise(
        least([*[_word_divergence(x, t) for x, t in zip(shares, totals)], F.col("_o_word")])))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and rules, both distances and the verdict of every row."""
    vocabulary, references, others = fit(docs)
    df = _repeat_words(_read(docs, _ROW, "lang"))
    df = _distances(df, vocabulary, references, others)
    lines = F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines).select(
        _ROW, F.size("_words").cast("long").alias("n_words"), F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        (F.length("_body") - F.length(F.regexp_replace("_body", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", "class_distance", "word_distance")
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    slack = SLACK / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = (F.col("class_distance") > MAX_CLASS_DISTANCE + slack / 2) | (F.col("word_distance") > MAX_WORD_DISTANCE + slack)
    diverges = (F.col("n_words") >= MIN_WORDS) & F.coalesce(far, F.lit(False))
    return df.select(*df.columns, (~F.col("base_failed") & ~diverges).alias("kept"))
