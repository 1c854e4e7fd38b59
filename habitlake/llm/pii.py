r"""Personal data by boosted candidates (op1, built of DataFrame functions only).

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers. Wider generators of each kind propose
further spans: obfuscated addresses, numbers that a base rule ran together or cut, phones without a plus. Boosted trees
score a span by its format (digits, groups, separators, checksum) and context (neighbouring characters, cue words in
front). They learn from the whole corpus: positives are the base spans and what they look like rewritten into the other
forms (``FORMS``; a card or phone rewritten so needs a cue word in front), negatives the generated spans that are
implausible or, of cards and phones, have no cue; other generated spans stay unlabelled. Both are counted in one
grouping by feature vector, whose number is bounded by the feature ranges. Each kind's threshold is the lowest score at
which ``PRECISION`` of the held-back spans are positives, and even odds at least. Plausible candidates from it on, off
all base spans, are added. Texts are scanned once: the spans are stored, for the fit and for the result.

Positions are code points, ends exclusive. Texts are scanned whole, each pattern in one linear scan.

Cases: null and empty texts have no spans; repeated rows are scanned each by itself; an empty corpus, or one without
base spans of a kind (also among the held-back), adds nothing of that kind; other columns are ignored (``find_pii``) or kept (``redacted``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost, calibrated_threshold
from .common import computed, stored

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
#: one document in so many (by hash) is held back to calibrate the thresholds
HELD_BACK = 5

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Possessive repeats and the look-behinds keep scans linear; they leave the matches of the plain patterns as they are:
# a run of its class can only match from its first character on.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{2,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?: ?(?:\.|[(\[](?:\.|dot)[)\]]) ?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ ._/-][0-9]{4}){3}|[0-9]{4}[ ._/-][0-9]{6}[ ._/-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?(?:[0-9]{1,3}[ ./-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-]?[0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
# cheap tests that every match of a kind's patterns passes
GATE = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9] ?[.(\[]", "card": r"[0-9](?:[ ._/-]?[0-9]){12}", "phone": r"[0-9)][ ().0-9/-]{3,}[0-9]"}
CUES = {"email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|server|address", "card": r"(?i)card|visa|master|amex|account", "phone": r"(?i)phone|\btel|call|mobile|fax"}

_SPAN = "array<struct<kind:string,start:int,end:int,hit:string,before:string,after:string>>"
FEATURES = ("digits", "groups", "lead", "separator", "valid", "left", "right", "cue")


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: each piece runs from the last match's end through the next."""
    whole = F.lit(r"\G([\s\S]*?)(" + pattern + r")(?=([\s\S]?))")
    pieces = F.arrays_zip(*[F.regexp_extract_all(text, whole, F.lit(i)).alias(n) for i, n in ((0, "piece"), (2, "hit"), (3, "after"))])
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc, x):
        end = acc["at"] + F.length(x["piece"])
        size = F.length(x["hit"])
        gap = F.length(x["piece"]) - size
        near = F.least(gap, F.lit(24))
        span = F.struct(F.lit(kind).alias("kind"), (end - size).alias("start"), end.alias("end"), x["hit"].alias("hit"),
                        F.substring(x["piece"], gap - near + 1, near).alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(pieces, empty, add)["out"]
    return F.when(text.rlike(GATE[kind]), found).otherwise(F.array().cast(_SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, with its own digits added up."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(each, lambda c, i: F.when(c == "", 0).otherwise(
        F.when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c >= "5", 9).otherwise(0))))
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        return F.regexp_replace(hit, r"[^0-9.]|(?<=\()dot(?=\))", "").rlike(rf"^{_OCTET}(?:\.+{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & _luhn(F.when(n <= 19, _digits(hit)).otherwise("1"))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _plausible(kind: str, hit: Column) -> Column:
    """What the checksum, the octets, the number of digits or the last label say, whatever stands between the parts."""
    if kind == "ip":
        return F.regexp_replace(hit, "[^0-9]+", ".").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    return hit.rlike("[A-Za-z]{2,}$") if kind == "email" else _valid(kind, hit)


def _forms(kind: str, x: Column) -> Column:
    """The span and its rewritten forms, as spans in its context."""
    digits, bare = _digits(x["hit"]), F.regexp_replace(x["hit"], r"^\+", "")
    swap = lambda *to: [F.regexp_replace(x["hit"], r"\.", t) for t in to]
    if kind == "email":
        other = [F.regexp_replace(h, "@", at) for h, at in zip(swap(" (dot) ", "[dot]", "."), (" (at) ", "[at]", " @ "))]
    elif kind == "ip":
        other = swap(" . ", "[.]", " (dot) ")
    elif kind == "card":
        fours = r"^([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{4})$"
        other = [F.when(F.length(digits) == 16, F.regexp_replace(digits, fours, f"$1{c}$2{c}$3{c}$4")).otherwise(
            F.regexp_replace(digits, r"^([0-9]{4})([0-9]{6})([0-9]{5})$", f"$1{c}$2{c}$3")) for c in "./_"]
    else:
        other = [F.regexp_replace(F.trim(bare), "[ ().-]+", c) for c in (" ", "-", ".", "/")] + [F.concat(F.lit("00"), bare)]
    spans = [F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), h.alias("hit"), x["before"].alias("before"), x["after"].alias("after")) for h in (x["hit"], *other)]
    every, itself = F.array(*spans).cast(_SPAN), F.array(spans[0]).cast(_SPAN)
    return every if kind in ("email", "ip") else F.when(x["before"].rlike(CUES[kind]), every).otherwise(itself)


def _negative(x: Column) -> Column:
    """A generated span that is surely none: implausible, or, of the kinds that are mere digits, without a cue."""
    out = F.lit(False)
    for k in KINDS:
        none = ~_plausible(k, x["hit"])
        out = out | ((x["kind"] == k) & (none if k in ("email", "ip") else none | ~x["before"].rlike(CUES[k])))
    return out


def _side(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4))


def _features(kind: str, x: Column) -> list[Column]:
    hit = x["hit"]
    n = F.length(_digits(hit))
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    marks = F.regexp_replace(hit, r"[0-9A-Za-z+@]", "")
    separator = (F.when(marks == "", 0).when(marks.rlike(r"[()\[\]]"), 4).when(marks.rlike("^ +$"), 1)
                 .when(marks.rlike(r"^\.+$"), 2).when(marks.rlike("^-+$"), 3).otherwise(5))
    size = (F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n < 12, 3).when(n < 13, 4).when(n < 16, 5).when(n == 16, 6)
            .when(n <= 19, 7).otherwise(8))
    return [size, F.least(F.size(groups), F.lit(6)), F.least(F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))), F.lit(5)), separator,
            _plausible(kind, hit).cast("int"), _side(F.substring(x["before"], -1, 1)), _side(x["after"]), x["before"].rlike(CUES[kind]).cast("int")]


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_more``: base spans, and generated spans off all base spans, by kind and start."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs
    for k in KINDS:
        out = out.withColumn(f"_b_{k}", _matches(body, k, BASE[k])).withColumn(f"_w_{k}", _matches(body, k, WIDE[k]))
    passing = lambda k: F.filter(f"_b_{k}", lambda x: _valid(k, x["hit"]))
    out = out.withColumn("_base", computed(F.concat(*[passing(k) for k in KINDS])))
    off = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    out = out.withColumn("_more", computed(F.filter(F.concat(*[F.col(f"_w_{k}") for k in KINDS]), off)))
    return out.drop(*[f"_{a}_{k}" for k in KINDS for a in "bw"])


def _vector(x: Column) -> Column:
    """The feature struct of a span of any kind."""
    each = {k: _features(k, x) for k in KINDS}
    pick = lambda i: F.when(x["kind"] == KINDS[0], each[KINDS[0]][i]).when(x["kind"] == KINDS[1], each[KINDS[1]][i]).when(x["kind"] == KINDS[2], each[KINDS[2]][i]).otherwise(each[KINDS[3]][i])
    return F.struct(*[pick(i).alias(f) for i, f in enumerate(FEATURES)])


def fit(found: DataFrame) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold of each kind, from the spans of all documents (``candidates``, and ``_seed``, a hash of the
    text)."""
    spans = found.select("_seed", "_base", "_more").where("size(_base) + size(_more) > 0")
    held = (F.pmod("_seed", F.lit(HELD_BACK)) == 0).alias("held")
    labelled = lambda spans, y: F.transform(spans, lambda x: F.struct(x.alias("x"), F.lit(y).alias("y")))
    forms = lambda k: F.flatten(F.transform(F.filter("_base", lambda x: x["kind"] == k), lambda x: _forms(k, x)))
    positive = F.concat(*[forms(k) for k in KINDS])
    rows = spans.select(held, F.explode(F.concat(labelled(positive, 1), labelled(F.filter("_more", _negative), 0))).alias("s"))
    cells = (rows.select("held", F.col("s.x.kind").alias("kind"), "s.y", _vector(F.col("s.x")).alias("v"))
             .groupBy("held", "kind", "v").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect())  # distinct vectors only
    model = {}
    for k in KINDS:
        part = {h: [(tuple(c["v"]), float(c["pos"]), float(c["n"] - c["pos"])) for c in cells if c["kind"] == k and c["held"] == h] for h in (False, True)}
        trees = boost(part[False])
        model[k] = (trees, max(0.5, calibrated_threshold(trees, part[True], PRECISION)))
    return model


def _selected(model) -> Column:
    """All spans: the base, and the candidates whose score reaches their kind's threshold; by kind, then start."""
    def chosen(k):
        trees, threshold = model[k]
        scored = F.transform(F.filter("_more", lambda x: x["kind"] == k), lambda x: F.struct(x.alias("x"), F.struct(*[f.alias(n) for n, f in zip(FEATURES, _features(k, x))]).alias("v")))
        good = F.filter(scored, lambda c: (c["v"]["valid"] == 1) & (trees.expression([c["v"][n] for n in FEATURES]) >= threshold))
        both = F.concat(F.filter("_base", lambda x: x["kind"] == k), F.transform(good, lambda c: c["x"]))
        return F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.concat(*[chosen(k) for k in KINDS])


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans as text and as structs."""
    seen = docs.select("doc_id", "text", F.xxhash64("text").alias("_seed"))
    found = stored(candidates(seen).drop("text"), "spans")
    found = found.withColumn("_all", computed(_selected(fit(found))))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
                        _listed(F.col("_all")).alias("spans"), F.col("_all").alias("all_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span in ``text`` replaced by its kind in brackets (overlapping spans by the first
    one's), and ``n_chars``, where there is such a column, set to the new length."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"), F.xxhash64("text").alias("_seed"))
    found = stored(candidates(packed, "_text").drop("_text"), "spans")
    found = found.withColumn("_text", F.col("_row.text")).withColumn("_all", computed(F.array_sort(_selected(fit(found)))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc, x):
        keep = F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), keep.alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("_all", start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    text = F.when(F.size("_all") > 0, done).otherwise(F.col("_text"))
    out = found.withColumn("_new", text)
    columns = [F.col("_new").alias(c) if c == "text" else F.when(F.size("_all") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(F.col(f"_row.`{c}`")).alias(c)
               if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)
