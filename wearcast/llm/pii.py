"""Personal data by candidate spans and gradient boosting, in DataFrame expressions throughout.

1. Base: one strict pattern a kind (email, ip, card, phone), leftmost and
   non-overlapping, with its check (parts of an address at most 255, 14 to 19
   digits with a Luhn sum, 10 to 15 digits); failing matches are dropped. Base
   spans are always reported.
2. Generators with high recall propose more spans, which may overlap: anything
   around an "@", "[at]" or "(at)", numbers joined by dots, "[.]" or "(dot)", any
   longer run of digits and separators, and each unbroken run of digits in it.
3. Boosted trees (Spark ML) judge each candidate by its format and context; only
   those that pass the check of their kind, once normalised, are reported. No
   table labels personal data, so the trees learn from all candidates of the
   table, counted by equal features (Spark groups them; a kind weighs as much as
   any other), labelled by ``verdict``: the check of the kind on
   the normalised span ("[at]", "(dot)" and the like undone, separators of any
   sort left out). Phone numbers also need evidence, a "+" or a word such as "tel"
   before them; without it a number of the right form is neither right nor wrong
   and left out. The trees never see that evidence, and numbers that are right
   count once more as people also write them (``rewritten``), so the
   trees judge by digits, groups and separators and find numbers without it.
4. Thresholds are calibrated by kind on the quarter of the candidates that the trees
   have not seen: half the way from the lowest score that keeps a precision of
   ``PRECISION`` to the next one seen, 0.5 at least unless that score is lower; a
   kind for which none does adds nothing.

The fitted trees are turned into one SQL expression, so that scoring is a
projection over the scan: no shuffle, no Python on the executors, no row ever
leaves its place. The patterns are written to run in linear time on any text
(possessive runs that start where the last match or another kind of character
ends), which finds the same matches as the plain patterns.

Defined cases: null text is the empty text, without spans; offsets count code
points, ends are exclusive; repeated rows and null ids are answered row by row;
empty tables give empty results; if all candidates are of one class, the base
spans are the result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearcast.session import pin

#: Kinds in their order of report.
KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns, as contracted; "(?<![x])|\G" and "++" only keep them linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": [r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\[dot\]|\(dot\)) ?)[A-Za-z0-9-]++)*+"],
    "ip": [r"(?:(?<![0-9])|\G)[0-9]++(?:(?:[.:]|\[\.\]|[\[(]dot[\])])[0-9]++){2,}+"],
    "card": [r"[0-9]++(?:[ ./-]{1,2}+[0-9]++)*+", r"[0-9]{14,}+"],
    "phone": [r"(?<![0-9A-Za-z])(?![0-9]{4}[-/.][0-9]{1,2}[-/.][0-9])(?![0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![0-9]))[+(]?[0-9][ ().0-9/-]{5,}[0-9]"],
}
#: What a text must hold for a kind to be searched at all.
HINT = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
WORDS_BEFORE = r"(?i)\b(e-?mail|contact|address|host|server|ip|card|visa|account)\W{0,3}$"
PHONE_BEFORE = r"(?i)\b(phone|telephone|tel|call|fax|mobile|cell|whatsapp)\W{0,3}$"  # evidence for labels, hidden from the trees

FIT_PARTS = 16
CONTEXT = 24
TREES, DEPTH = 12, 4
PRECISION = 0.95
FEATURES = ("kind", "size", "digits", "letters", "marks", "dots", "gaps", "luhn", "small_parts", "groups",
            "longest_group", "tail", "glued_before", "glued_after", "word_before")
_CHUNK = 512


# ---------------------------------------------------------------- expressions
def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """Sums of all elements before each, in chunks, so that a long array does not cost its square."""
    none = F.array(F.lit(0).cast("long"))

    def sums(a):
        return F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def join(parts):
        ends = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), ends.alias("start")), lambda z: F.when(
            z["part"].isNotNull(), F.transform(F.slice(z["part"], 1, F.size(z["part"]) - 1), lambda v: v + z["start"])).otherwise(F.array().cast("array<bigint>"))))

    def cut(a):
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _CHUNK).cast("int"))
        return let(F.transform(starts, lambda c: sums(F.slice(a, c * _CHUNK + 1, F.lit(_CHUNK)))), join)

    return let(sizes, lambda a: F.when(F.size(a) > 0, cut(a)).otherwise(F.array().cast("array<bigint>")))


SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def matches(text: Column, pattern: str, hint: str) -> Column:
    """All matches of the pattern with code-point offsets and what stands around them (up to the neighbouring matches)."""

    def place(z):
        at = running(F.transform(z, lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))).cast("long")))
        both = F.filter(F.arrays_zip(z.alias("m"), at.alias("at")), lambda x: x["m"]["value"].isNotNull())
        return F.transform(both, lambda x: F.struct(
            (x["at"] + F.length(x["m"]["gap"])).alias("start"), (x["at"] + F.length(x["m"]["gap"]) + F.length(x["m"]["value"])).alias("end"),
            x["m"]["value"].alias("value"), F.right(x["m"]["gap"], F.lit(CONTEXT)).alias("before"), F.left(F.coalesce(x["m"]["next"], F.lit("")), F.lit(CONTEXT)).alias("after")))

    def pair(gaps):
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(F.arrays_zip(values.alias("value"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next")), place)

    return F.when(text.rlike(hint), let(F.split(text, pattern, -1), pair).cast(SPAN)).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits (at most 19 are looked at) has a Luhn sum that ten divides."""
    def total(d):
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(d), F.lit(19)), F.lit(1))), lambda i: F.struct(F.substring(d, -i, F.lit(1)).cast("int").alias("n"), i.alias("i")))
        return F.aggregate(own, F.lit(0), lambda acc, x: acc + F.when(x["i"] % 2 == 1, x["n"]).when(x["n"] >= 5, 2 * x["n"] - 9).otherwise(2 * x["n"])) % 10 == 0
    return F.when(F.length(number).between(1, 19), let(number, total)).otherwise(F.lit(False))


SMALL_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

CHECK: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(SMALL_PARTS),
    "card": lambda v: let(digits(v), lambda d: F.length(d).between(14, 19) & luhn(d)),
    "phone": lambda v: F.length(digits(v)).between(10, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], HINT[kind]), lambda x: CHECK[kind](x["value"]))


def normal(kind: str, value: Column) -> Column:
    """The span with its disguises undone: "[at]", "(dot)", "[.]" and spaces beside them."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(value, r" ?(?:@|\[at\]|\(at\)) ?", "@"), r" ?(?:\[dot\]|\(dot\)) ?", ".")
    return F.regexp_replace(value, r"\[\.\]|[\[(]dot[\])]", ".") if kind == "ip" else value


def sound(kind: str, value: Column) -> Column:
    """Whether a candidate passes the check of its kind in its normalised form."""
    v = normal(kind, value)
    return v.rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$") if kind == "email" else CHECK[kind](v)


def sound_ones(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: sound(kind, x["value"]))


def verdict(kind: str, x: Column) -> Column:
    """1 if a candidate is right, 0 if wrong, null if nothing tells (a number that may be a phone's, without evidence)."""
    v, good = x["value"], sound(kind, x["value"])
    if kind == "phone":
        told = v.startswith("+") | x["before"].rlike(PHONE_BEFORE)
        other = v.rlike(SMALL_PARTS) | v.rlike("^[0-9]+$") | luhn(digits(v))  # an address, a plain number, perhaps a card
        return F.when(good & told & ~v.rlike(SMALL_PARTS), 1.0).when(good & ~other, F.lit(None)).otherwise(0.0)
    return F.when(good, 1.0).otherwise(0.0)


def rewritten(kind: str, x: Column, turn: Column) -> Column:
    """A right number as it is also written, by the turn (0 to 3): a phone number without "+", brackets or country, with
    one sort of separator; a card in fours. Other kinds stay as they are (their disguises are undone before they are seen)."""
    v = x["value"]
    if kind == "phone":
        bare = F.regexp_replace(v, "[+()]", "")
        home = F.regexp_replace(v, r"^\+[0-9]{1,3}[ .-]+", "")
        new = F.when(turn == 0, bare).when((turn == 1) & CHECK["phone"](home), home) \
            .otherwise(F.regexp_replace(bare, "[ .-]+", F.when(turn == 2, " ").otherwise("-")))
        # most countries begin a number at home with 0
        new = F.when(turn == 2, F.concat(F.lit("0"), F.substring(new, 2, 64))).otherwise(new)
    elif kind == "card":
        new = F.regexp_replace(digits(v), "([0-9]{4})(?=[0-9])", F.when(turn == 0, "$1.").when(turn == 1, "$1  ").when(turn == 2, "$1-").otherwise("$1/"))
    else:
        new = v
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), new.alias("value"), x["before"].alias("before"), x["after"].alias("after"))


def features(kind: int, x: Column) -> list[Column]:
    """The numbers that the trees see of one span, in the order of FEATURES; none of them is a base pattern or the evidence of ``verdict``."""
    v = normal(KINDS[kind], x["value"])

    def count(pattern):
        return F.length(F.regexp_replace(v, pattern, "")).cast("double")

    def flag(c):
        return F.when(c, 1.0).otherwise(0.0)

    longest = F.array_max(F.transform(F.split(v, "[^0-9]+", -1), lambda s: F.length(s)))
    return [F.lit(float(kind)), F.length(digits(v) if KINDS[kind] == "phone" else v).cast("double"), count("[^0-9]"), count("[^A-Za-z]"),
            F.lit(0.0) if KINDS[kind] == "phone" else count("[0-9A-Za-z]"), count(r"[^.]"), flag(v.rlike("[0-9][^0-9]+[0-9]")), flag(luhn(digits(v))) if KINDS[kind] == "card" else F.lit(0.0), flag(v.rlike(SMALL_PARTS)),
            F.size(F.split(F.regexp_replace(v, "^[^0-9A-Za-z]+", ""), "[^0-9A-Za-z]+", -1)).cast("double"), longest.cast("double"), F.length(F.regexp_extract(v, r"(?<=\.)[A-Za-z]+$", 0)).cast("double"),
            flag(x["before"].rlike("[0-9A-Za-z@_.]$")), flag(x["after"].rlike("^[0-9A-Za-z@_]")), flag(x["before"].rlike(WORDS_BEFORE))]


def tree_sum(model: GBTClassificationModel, value: list[Column]) -> Column:
    """The boosted margin as an expression over the features."""
    def node(n):
        if n.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(n.prediction()))
        return F.when(value[n.split().featureIndex()] <= F.lit(float(n.split().threshold())), node(n.leftChild())).otherwise(node(n.rightChild()))

    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        total = total + node(tree._java_obj.rootNode()) * F.lit(float(weight))
    return total


def probability(model: GBTClassificationModel, kind: int, x: Column) -> Column:
    """Probability of one span; the features are worked out once."""
    margin = let(F.array(*features(kind, x)), lambda f: tree_sum(model, [f[i] for i in range(len(FEATURES))]))
    return F.lit(1.0) / (1 + F.exp(-2 * margin))


# ---------------------------------------------------------------- fitting
class Judge:
    """Fitted trees and thresholds by kind; without trees only base spans count."""

    def __init__(self, model: GBTClassificationModel | None, threshold: dict[str, float]):
        self.model, self.threshold = model, threshold


def _candidates(docs: DataFrame, text: Column, k: int) -> DataFrame:
    """The candidates of a kind that have a verdict: x (span), spot (their hash) and right."""
    every = F.concat(*[matches(F.col("t"), pattern, HINT[KINDS[k]]) for pattern in CANDIDATES[KINDS[k]]])
    return docs.select(text.alias("t")).filter(F.col("t").rlike(HINT[KINDS[k]])).select(F.xxhash64("t").alias("h"), F.explode(every).alias("x")) \
        .select("x", F.xxhash64("h", "x.start", "x.end", F.lit(k)).alias("spot"), verdict(KINDS[k], F.col("x")).alias("right")).filter("right is not null")


def _numbers(one: DataFrame, k: int) -> DataFrame:
    """spot, right, held_out and the features of candidates, and of the right ones as rewritten (a candidate and its other
    form are held out together)."""
    twin = rewritten(KINDS[k], F.col("x"), F.pmod(F.shiftright("spot", 8), F.lit(4)))
    both = F.when(F.col("right") == 1, F.array("x", twin)).otherwise(F.array("x"))
    numbers = [c.alias(n) for n, c in zip(FEATURES, features(k, F.col("x")))]
    return one.select("spot", "right", F.explode(both).alias("x")).select("spot", "right", (F.pmod("spot", F.lit(4)) == 0).alias("held_out"), *numbers)


def _sample(docs: DataFrame, text: Column, rows: int) -> DataFrame:
    """At most ``rows`` candidates, those with the smallest hashes, to look at; ``fit`` takes them all."""
    return reduce(DataFrame.union, [_numbers(_candidates(docs, text, k).orderBy("spot", "x").limit(rows // len(KINDS)), k) for k in range(len(KINDS))])


def _labelled(docs: DataFrame, text: Column) -> DataFrame:
    """All candidates by equal features: kind and the other features, right, held_out and how many look so."""
    every = reduce(DataFrame.union, [_numbers(_candidates(docs, text, k), k) for k in range(len(KINDS))])
    return every.groupBy(*FEATURES, "right", "held_out").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> Judge:
    """Trees from all candidates, each kind with the same weight, and thresholds from the quarter held out."""
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = pin(_labelled(own, F.col("text")))
    learnt = rows.filter("not held_out")
    size = learnt.groupBy("kind").agg(F.sum("n").alias("of_kind"), F.min("right").alias("least"), F.max("right").alias("most"))
    sizes = size.collect()  # a row a kind
    if not sizes or min(r["least"] for r in sizes) == max(r["most"] for r in sizes):
        return Judge(None, {})
    mean = sum(r["of_kind"] for r in sizes) / len(sizes)
    share = F.coalesce(*[F.when(F.col("kind") == r["kind"], F.col("n") * F.lit(mean / r["of_kind"])) for r in sizes])
    # dealt by their features and sorted, so that equal tables give equal trees
    dealt = learnt.withColumn("weight", share).repartition(FIT_PARTS, *FEATURES).sortWithinPartitions(*FEATURES, "right")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(dealt)
    model = GBTClassifier(labelCol="right", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(ready)
    margin = let(F.array(*FEATURES), lambda f: tree_sum(model, [f[i] for i in range(len(FEATURES))]))
    bins = rows.filter("held_out").select("kind", "right", "n", F.floor(100 / (1 + F.exp(-2 * margin))).alias("bin")) \
        .groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("right")).alias("hits")).collect()  # at most 4 x 101 rows
    threshold = {}
    for k, kind in enumerate(KINDS):
        own = sorted((r for r in bins if r["kind"] == k), key=lambda r: -r["bin"])
        n = hits = 0
        for i, r in enumerate(own):
            n, hits = n + r["n"], hits + r["hits"]
            if hits / n >= precision:  # anything down to the next lower bin keeps it: half of that way, but not below even odds
                least, below = r["bin"] / 100, (own[i + 1]["bin"] + 1) / 100 if i + 1 < len(own) else 0.0
                threshold[kind] = min(least, max(0.5, (least + below) / 2))
    return Judge(model, threshold)


def find(docs: DataFrame, judge: Judge, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, value, base, score) by start, then kind; base spans have score 1."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    shape = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,base:boolean,score:double>>"

    def report(spans, k, base, score):
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), x["end"].alias("end"), F.lit(KINDS[k]).alias("kind"),
                                                     x["value"].alias("value"), F.lit(base).alias("base"), score(x).alias("score"))).cast(shape)

    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(report(base_spans(F.col("t"), kind), k, True, lambda x: F.lit(1.0)))
        if judge.model is not None and kind in judge.threshold:
            least = F.lit(judge.threshold[kind])
            for pattern in CANDIDATES[kind]:
                well = sound_ones(kind, matches(F.col("t"), pattern, HINT[kind]))
                scored = report(well, k, False, lambda x, k=k: probability(judge.model, k, x))
                parts.append(F.filter(scored, lambda x: x["score"] >= least))
    # an equal span of the rules comes first and stays
    every = F.array_sort(F.concat(*parts), lambda a, b: _order(a, b))

    def once(acc, x):
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["start"] == x["start"]) & (F.try_element_at(acc, F.lit(-1))["rank"] == x["rank"]) \
            & (F.try_element_at(acc, F.lit(-1))["end"] == x["end"])
        return F.when(same, acc).otherwise(F.concat(acc, F.array(x)))

    return own.select("doc_id", F.aggregate(every, F.array().cast(shape), once).alias("spans"))


def _order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for less in reversed([(a["start"], b["start"]), (a["rank"], b["rank"]), (a["end"], b["end"]), (b["base"].cast("int"), a["base"].cast("int"))]):
        out = F.when(less[0] < less[1], -1).when(less[0] > less[1], 1).otherwise(out)
    return out


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base, counts = F.filter("spans", lambda x: x["base"]), [of(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, judge: Judge, mask: str = "[{}]") -> DataFrame:
    """doc_id and the text with each span replaced by its kind; overlapping spans go as one, under the first one's kind."""
    row = F.struct("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = find(docs.select(row.alias("row"), "text"), judge, "row").withColumnRenamed("doc_id", "row")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x, text):
        new = x["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.when(new, F.concat(acc["out"], gap, F.format_string(mask.replace("{}", "%s"), x["kind"]))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], x["end"]).alias("at"))

    text = F.col("row.text")
    done = F.aggregate("spans", start, lambda acc, x: step(acc, x, text))
    return found.select(F.col("row.doc_id").alias("doc_id"), let(done, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text)))).alias("text"))
