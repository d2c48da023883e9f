"""Personal data by candidate spans and boosted trees.

Generators with high recall propose spans in each whole text: the four formats that are always redacted, and looser
ones (numbers that fail their check digit, national phone numbers, secrets, account numbers, spelled-out addresses).
Each looser span gets features of its own format and of the text around it; boosted trees score them, and a threshold
for each kind, calibrated on examples kept aside, selects what is redacted as well. All of it is column expressions;
the trees are trained on seeded examples and then written out as one expression.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.shared import Carried

#: The formats that are always redacted, in the order of their kinds (fixed values). A run that a match could begin in
#: is only tried at its start or where the last match ended, and is never given back: the matches are the same as of
#: the plain patterns, in time that grows with the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser formats. Each needs one of the given marks in the text before its pattern is tried.
LOOSE = {
    "secret": (r"""(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)["']?\x20?[:=]\x20?["']?[A-Za-z0-9+/_.=-]{8,}+""", ["=", ":"]),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", []),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ["-"]),
    "national_phone": (r"(?<![0-9+.(-])\(?[0-9]{3,5}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9.-])", []),
    "spelled_email": (r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[a-z0-9-]++\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[a-z]{2,12}(?![a-z0-9])", ["at]", "at)", " at "]),
    "ipv6": (r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){3,7}(?::?[0-9a-f]{1,4}){1,4}(?![0-9a-f:])", [":"]),
}
KINDS = [*BASE, *LOOSE]
SPAN = "struct<start:bigint,kind:int,end:bigint>"
CANDIDATE = "struct<start:bigint,kind:int,end:bigint,value:string,before:string,after:string>"
CONTEXT = 32


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int") * (1 + i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(short) <= 3) & (short.try_cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


def _passes(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": _octets(value),
        "card": count.between(12, 19) & luhn(_digits(value)),
        "phone": count.between(9, 15),
    }[kind]


def _with_found(df: DataFrame, text: Column, kind: str, pattern: str, mark: Column) -> DataFrame:
    """`df` with _<kind>: array<CANDIDATE> of a pattern's matches; what stands between matches gives their places. Matches
    and gaps are columns of their own, so that no element computes them again."""
    number, values, gaps = KINDS.index(kind), F.col("_values"), F.col("_gaps")
    df = df.withColumn("_values", F.when(mark, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(_array("string")))
    df = df.withColumn("_gaps", F.when(F.size("_values") > 0, F.split(text, pattern, -1)).otherwise(_array("string")))
    sizes = F.zip_with(gaps, values, lambda g, v: F.struct(F.char_length(g).alias("gap"), F.char_length(v).alias("value")))

    def step(state: Column, size: Column) -> Column:
        start = state["at"] + size["gap"]
        return F.struct((start + size["value"]).alias("at"), F.concat(state["starts"], F.array(start)).alias("starts")).cast("struct<at:bigint,starts:array<bigint>>")

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), _array("bigint").alias("starts"))
    df = df.withColumn("_starts", F.aggregate(F.slice(sizes, F.lit(1), F.size("_values")), empty, step, lambda s: s["starts"]))

    def candidate(start: Column, i: Column) -> Column:
        value = F.get(values, i)
        return F.struct(
            start.alias("start"), F.lit(number).alias("kind"), (start + F.char_length(value)).cast("bigint").alias("end"), value.alias("value"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("after"),
        ).cast(CANDIDATE)

    return df.withColumn(f"_{kind}", F.transform("_starts", candidate)).drop("_values", "_gaps", "_starts")


def _array(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with _base (spans that are always redacted) and _loose (candidates of the other generators)."""
    body, out = F.coalesce(F.col(text).cast("string"), F.lit("")), docs
    marks = {"email": body.contains("@"), "ip": body.rlike(r"[0-9]\.[0-9]"), "card": body.rlike("[0-9][\x20-]?[0-9]"), "phone": body.contains("+")}
    for kind, pattern in BASE.items():
        out = _with_found(out, body, kind, pattern, marks[kind])
    for kind, (pattern, needs) in LOOSE.items():
        mark = reduce(lambda a, b: a | b, [body.contains(n) for n in needs]) if needs else body.rlike("[0-9]{2}")
        out = _with_found(out, body, kind, pattern, mark)

    def held(kind: str, passes: bool) -> Column:
        return F.filter(f"_{kind}", lambda c: _passes(kind, c["value"]) if passes else ~_passes(kind, c["value"]))

    passed, failed = [held(k, True) for k in BASE], [held(k, False) for k in ("ip", "card", "phone")]
    out = out.withColumn("_base", F.array_sort(F.transform(F.concat(*passed), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))
    loose = F.concat(*[F.col(f"_{k}") for k in LOOSE], *failed)
    apart = F.filter(loose, lambda c: ~F.exists(F.col("_base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return out.withColumn("_loose", apart).drop(*[f"_{k}" for k in KINDS])


#: Words before a span that speak for personal data, or against it (features, not rules).
FOR = r"(?i)(?:phone|tel|call|mobile|fax|contact|mail|reach|card|visa|credit|debit|pay|account|iban|bank|ssn|social|security|host|address|addr|login|user|patient|passport)"
AGAINST = r"(?i)(?:version|order|invoice|isbn|ref|part|model|serial|commit|section|figure|page|sku|build|chapter|score|total|year|range|ratio)"


def features(c: Column) -> list[Column]:
    """Numbers that describe a candidate's format and its surroundings."""
    value, before, after = c["value"], c["before"], c["after"]
    count = F.length(_digits(value))
    return [x.cast("double") for x in (
        *[(c["kind"] == i).cast("int") for i in range(len(KINDS))],
        F.char_length(value),
        count,
        F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(value, r"[^\x20().-]", "")),
        F.size(F.array_distinct(F.split(value, ""))),
        (count.between(12, 19) & luhn(_digits(value))).cast("int"),
        before.rlike(FOR).cast("int"),
        before.rlike(AGAINST).cast("int"),
        before.rlike(r"[\p{L}\p{N}]$").cast("int"),
        after.rlike(r"^[\p{L}\p{N}]").cast("int"),
        before.rlike(r"[:=#]\x20?$").cast("int"),
        (before.rlike(r"[0-9][^\p{L}]{0,3}$") | after.rlike(r"^[^\p{L}]{0,3}[0-9]")).cast("int"),
    )]


def examples(n: int, seed: int) -> list[tuple[int, str, int]]:
    """Seeded texts around one made-up value each, and whether that value is personal data."""
    draw = random.Random(seed)

    def digits(k: int) -> str:
        return "".join(draw.choice("0123456789") for _ in range(k))

    def some(k: int, of: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> str:
        return "".join(draw.choice(of) for _ in range(k))

    good = [
        (lambda: f'{draw.choice(["token", "secret", "password", "api_key"])} = "{some(draw.randint(16, 40))}"', ["", "login", "set"]),
        (lambda: f"{draw.choice(['token', 'password'])}: {some(12)}", ["user", "the"]),
        (lambda: draw.choice(["DE", "FR", "ES", "GB"]) + digits(2) + " " + " ".join(digits(4) for _ in range(4)) + " " + digits(2), ["account", "IBAN", "bank", "pay to"]),
        (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["SSN", "social security number", "her ssn is"]),
        (lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", ["call", "phone:", "tel", "reach me at"]),
        (lambda: f"{digits(4)} {digits(3)} {digits(4)}", ["phone", "mobile:", "fax"]),
        (lambda: f"{some(6)} at {some(7)} dot com", ["mail", "contact me:", "reach"]),
        (lambda: f"{some(5)} [at] {some(6)} [dot] org", ["mail", "", "address"]),
        (lambda: ":".join(some(4, "0123456789abcdef") for _ in range(8)), ["host", "address", "login from"]),
        (lambda: " ".join(digits(4) for _ in range(4)), ["credit card", "visa", "card number:"]),
    ]
    bad = [
        (lambda: f"token: {draw.choice(['necessary', 'something', 'afterwards', 'parenthesis'])}", ["the", "a", "lexical"]),
        (lambda: draw.choice(["AB", "XK", "QR"]) + digits(2) + " " + some(4, "ABCDEFGH") + " " + some(4, "ABCDEFGH"), ["model", "part", "serial"]),
        (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["part", "order", "ref", "sku"]),
        (lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", ["version", "section", "total"]),
        (lambda: f"{digits(4)}/{digits(4)}", ["ratio", "page", "range"]),
        (lambda: f"{digits(4)} {digits(3)} {digits(4)}", ["invoice", "order", "isbn", "figure"]),
        (lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", ["serial", "build", "total", "the"]),
        (lambda: digits(draw.randint(12, 30)), ["the", "order", "", "commit", "and"]),
        (lambda: f"{digits(3)}.{digits(3)}.{draw.randint(300, 999)}.{digits(3)}", ["version", "section", "build"]),
        (lambda: f"look at {some(5, 'abcdefgh')} dot {some(4, 'abcdefgh')}", ["", "and"]),
        (lambda: ":".join(digits(2) for _ in range(6)), ["chapter", "score", "at time"]),
        (lambda: "+" + " ".join(digits(1) for _ in range(4)), ["score", "total", "sum"]),
    ]
    rows = []
    for i in range(n):
        label = i % 2
        value, words = draw.choice(good if label else bad)
        lead = " ".join(some(draw.randint(2, 9), "abcdefghilmnoprstu") for _ in range(draw.randint(0, 6)))
        tail = draw.choice([".", " ", ", ", "\n"]) + " ".join(some(draw.randint(2, 9), "abcdefghilmnoprstu") for _ in range(draw.randint(0, 6)))
        rows.append((i, f"{lead} {draw.choice(words)} {value()}{tail}", label))
    return rows


_FITTED: dict[str, tuple[list, list[float]]] = {}


def fit(spark: SparkSession, n: int = 3000, seed: int = 11, trees: int = 12, depth: int = 3, precision: float = 0.98) -> tuple[list, list[float]]:
    """Trees as (weight, nested tuples) and a threshold for each kind, from `n` seeded examples: two thirds to fit, one
    third to calibrate. A kind that never reaches `precision` there gets a threshold no score reaches. Kept for the
    application, as the examples are always the same."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    known = _FITTED.get(spark.sparkContext.applicationId)
    if known:
        return known
    rows = with_candidates(spark.createDataFrame(examples(n, seed), "id int, text string, label int"))
    each = rows.select("id", "label", F.explode("_loose").alias("c"))
    named = each.select("id", F.col("label").cast("double").alias("label"), F.col("c.kind").alias("kind"), *[x.alias(f"f{i}") for i, x in enumerate(features(F.col("c")))])
    names = [c for c in named.columns if c.startswith("f")]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(named).repartition(2, "id").sortWithinPartitions("id", "kind").cache()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(data.where("id % 3 > 0"))

    def unfold(node):
        if not node.numDescendants():
            return float(node.prediction())
        split = node.split()
        return int(split.featureIndex()), float(split.threshold()), unfold(node.leftChild()), unfold(node.rightChild())

    fitted = [(float(w), unfold(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]
    scored = data.where("id % 3 = 0").select("kind", "label", score(fitted, [F.col(c) for c in names]).alias("score")).collect()
    data.unpersist()
    thresholds = []
    for kind in range(len(KINDS)):
        own = sorted(((r["score"], r["label"]) for r in scored if r["kind"] == kind), reverse=True)
        good, limit = 0.0, 2.0
        for i, (value, label) in enumerate(own):
            good += label
            last = i + 1 == len(own) or own[i + 1][0] < value
            if last and good / (i + 1) >= precision and value > 0.5:
                limit = value
        thresholds.append(limit)
    _FITTED[spark.sparkContext.applicationId] = fitted, thresholds
    return fitted, thresholds


def score(fitted: list, values: list[Column]) -> Column:
    """Probability of personal data as one expression over a candidate's features."""

    def tree(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        i, threshold, low, high = node
        return F.when(values[i] <= threshold, tree(low)).otherwise(tree(high))

    total = reduce(lambda a, b: a + b, [F.lit(w) * tree(t) for w, t in fitted])
    return 1 / (1 + F.exp(-2 * total))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with _base and _spans: arrays of (start, kind, end) in code points, by start and then by the order of KINDS.
    _spans has all base spans and the selected looser ones, which never touch a base span."""
    fitted, thresholds = fit(docs.sparkSession)
    limits = F.array(*[F.lit(t) for t in thresholds])
    scored = F.transform(F.col("_loose"), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), score(fitted, features(c)).alias("score")))
    chosen = F.filter(F.col("_scored"), lambda c: c["score"] >= F.get(limits, c["kind"]))
    out = with_candidates(docs, text).withColumn("_scored", F.when(F.size("_loose") > 0, scored).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double>>")))
    plain = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return out.withColumn("_spans", F.array_sort(F.concat(F.col("_base"), plain))).drop("_loose", "_scored")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans as text), spans (likewise), for each row.

    A null or empty text has no spans; null doc_ids and repeated rows stay; an empty table stays empty; texts are read
    whole; further columns are ignored. Spans of different kinds may overlap, and all of them are listed.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = with_spans(own)

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return spans.select("doc_id", *counts, listed(F.col("_base")).alias("base"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span in `text` replaced by its kind in brackets; overlapping spans become one, named after the
    first. Texts without spans, null ones included, stay as they are, and so do all other columns."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col("text")

    def step(state: Column, s: Column) -> Column:
        begins = s["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(body, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.get(names, s["kind"]))
        return F.struct(F.when(begins, piece).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    rest = lambda s: F.concat(s["out"], F.substring(body, (s["at"] + 1).cast("int"), F.char_length(body)))
    own = Carried(docs, "text")
    changed = F.when(F.size("_spans") > 0, F.aggregate("_spans", empty, step, rest)).otherwise(body)
    return with_spans(own.df).select(*own.restored(text=changed))
