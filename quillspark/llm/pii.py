"""Personal data by generators, gradient-boosted trees and calibrated thresholds.

Generators with high recall propose spans of four kinds. The base generators' spans that pass their own test (octets,
Luhn, digit counts) are always personal data. Further generators, of spelt-out addresses, numbers without a plus, cards
with other separators and addresses of version 6, propose spans that may overlap; they have no limits of length. Boosted
trees score these by format and context features, and a span is redacted if its score reaches its kind's threshold and
it overlaps no base span and no span with a higher score.

The trees are trained here by Spark ML's JVM code on SAMPLE cases: values from templates, good and bad ones, put between
pieces of CONTEXTS documents, which are alike for both. Half of the cases are held out to calibrate each kind's threshold
to PRECISION; `quality` measures precision and recall on them. The trees become CASE expressions, so that scoring is one
projection. All rows are handled one by one without a shuffle. Secrets (keys and tokens by their names or forms) are
counted beside the four kinds.

Defined results: null counts as empty, without spans; repeated rows and ids give repeated results; other columns don't
matter; texts of any length are read whole; of candidates with equal scores the first stays; an empty table gives an
empty result, and contexts are then empty. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table
from quillspark.llm.spans import apart_from, best_first, placed

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
# Kind, expression, gate. Possessive loops and the look-behinds only keep the same matches from being searched twice.
BASE = [
    ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
]
AT = r"[(\[{<] ?(?:at|@) ?[)\]}>]"
DOT = r"[(\[{<] ?(?:dot|\.) ?[)\]}>]"
MORE = [
    ("email", rf"(?i)(?<!{LOCAL}){LOCAL}++ ?(?:{AT}| at ) ?[A-Za-z0-9-]++(?: ?(?:{DOT}| dot |\.) ?[A-Za-z0-9-]++)++", r"[(\[{<] ?(?:[aA][tT]|@) ?[)\]}>]| [aA][tT] [A-Za-z0-9-]++ ?(?:[(\[{<]| [dD][oO][tT] |\.)"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{0,4}:"),
    ("card", r"(?<![0-9])[0-9]++(?:[./_\u2013\u00A0][0-9]++)++(?![0-9])", r"[0-9][./_\u2013\u00A0][0-9]"),
    ("phone", r"(?<![0-9A-Za-z+./-])\(?[0-9]++\)?(?:[ ./-] ?\(?[0-9]++\)?)++(?![0-9A-Za-z])", r"[0-9]\)?[ ./-] ?\(?[0-9]"),
]
SECRET = (
    r"(?i)(?:token|secret|passw(?:or)?d|(?:api|access|private|auth)[_ -]?key)[\x22\x27]? ?[=:] ?[\x22\x27]?[^\s\x22\x27]{8,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9_-]{20,}"
)
SECRET_GATE = (r"[=:] ?[\x22\x27]?[^\s\x22\x27]{8}", r"(?i)token|secret|passw|key")  # a named secret has both
CONTEXT = {"email": "mail|contact|write|reach", "ip": "ip|host|server|address|client", "card": "card|visa|master|credit|pay", "phone": "phone|tel|call|mobile|fax|reach"}
FEATURES = ["kind", "digits", "length", "separators", "letters", "luhn", "context", "ends_free", "starts_free", "distinct", "groups", "longest", "shortest", "brackets", "spelt", "double", "year"]
SAMPLE, SEED = 8000, 11  # training cases
CONTEXTS = 2000  # documents that lend their words to the cases, at most
PRECISION = 0.97  # that thresholds are calibrated to
SPAN = "array<struct<kind:string,start:int,end:int,text:string,left:string,right:string>>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(d)
    value = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)),
    )
    return (n > 0) & (total % 10 == 0)


def passes(kind: str, s: Column) -> Column:
    d = F.length(digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(s, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.when(d.between(13, 19), luhn(digits(s))).otherwise(False)
    if kind == "phone":
        return d.between(9, 15)
    return F.lit(True)


def matches(text: Column, kind: str, rx: str, gate: str) -> Column:
    """All leftmost matches with their places and up to 16 characters before and 1 after, within the gap to the next match."""
    def span(start: Column, end: Column, m: Column, gap: Column, behind: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), m.alias("text"), F.right(gap, F.lit(16)).alias("left"), F.substring(behind, 1, 1).alias("right"),
        )

    found = placed(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx), F.length, span, SPAN[6:-1])
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(SPAN))


def features(c: Column) -> dict[str, Column]:
    """Format and context features of a candidate, as doubles."""
    s, kind = c["text"], c["kind"]
    number = {k: float(i) for i, k in enumerate(KINDS)}
    code = F.lit(0.0)
    near = F.lit(0.0)
    for k in KINDS:
        code = F.when(kind == k, number[k]).otherwise(code)
        near = F.when((kind == k) & F.lower(c["left"]).rlike(CONTEXT[k]), 1.0).otherwise(near)
    d = digits(s)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    runs = F.transform(F.filter(F.split(s, "[^0-9A-Fa-f]+"), lambda x: x != ""), lambda x: F.length(x))
    return {
        "kind": code, "digits": F.length(d).cast("double"), "length": F.length(s).cast("double"),
        "separators": F.length(F.regexp_replace(s, r"[^ .()/:\[\]_-]", "")).cast("double"), "letters": F.length(F.regexp_replace(s, "[^A-Za-z]", "")).cast("double"),
        "luhn": flag(luhn(d)), "context": near, "ends_free": flag(~c["right"].rlike(r"[\w/]")), "starts_free": flag(~c["left"].rlike(r"[\w/.#-]$")),
        "distinct": F.size(F.array_distinct(F.split(d, ""))).cast("double"), "groups": F.size(runs).cast("double"),
        "longest": F.coalesce(F.array_max(runs), F.lit(0)).cast("double"), "shortest": F.coalesce(F.array_min(runs), F.lit(0)).cast("double"),
        "brackets": flag(s.rlike(r"[(\[{<]")), "spelt": flag(F.lower(s).rlike(r"\bdot\b")), "double": flag(F.contains(s, F.lit("::"))),
        "year": flag(s.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")),
    }


def contexts(docs: DataFrame | None, most: int = CONTEXTS) -> DataFrame | None:
    """(k, before, behind): pieces of up to 16 and 8 characters from documents without digits there, of at most `most` documents."""
    if docs is None:
        return None
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct().withColumnRenamed("doc_id", "id")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\s.,]+", " ")
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("plain") - 24, F.lit(1))).cast("int")
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", plain.alias("plain"))  # `most` ids
    pieces = rows.select("doc_id", F.substring("plain", at + 1, F.lit(15)).alias("before"), F.substring("plain", at + 16, F.lit(8)).alias("behind"))
    pieces = pieces.orderBy("doc_id", "before").limit(most).coalesce(1)  # `most` rows
    return pieces.select((F.monotonically_increasing_id()).alias("k"), "before", "behind")


def generated_cases(spark: SparkSession, n: int = SAMPLE, seed: int = SEED, docs: DataFrame | None = None) -> DataFrame:
    """Labelled candidates: (kind, text, left, right, label, part). Values come from templates; what stands around them comes
    from documents and is drawn alike for good and bad ones, but for words that name a kind, which are rarer at bad ones."""
    def draw(j: int, k: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed + j)), F.lit(k))

    def pick(j: int, xs: list) -> Column:
        return F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (draw(j, len(xs)) + 1).cast("int"))

    def number(j: int, k: int) -> Column:
        return F.lpad(draw(100 + j, 10**k).cast("string"), k, "0")

    hexed = lambda j: F.lower(F.hex(draw(200 + j, 65536)))
    small = lambda j: F.lower(F.hex(draw(200 + j, 256)))
    good, kind = draw(0, 2) == 0, pick(1, list(KINDS))
    size = pick(30, [13, 15, 16, 16, 16, 19])
    body = F.substring(F.concat(F.lit("4"), *[number(10 + i, 6) for i in range(4)]), F.lit(1), size - 1)
    check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: luhn(F.concat(body, x))), 1)
    wrong = F.pmod(check.cast("int") + 1 + draw(31, 9), F.lit(10)).cast("string")
    card = F.concat(body, F.when(good, check).otherwise(wrong))
    card = F.array_join(F.array(*[F.substring(card, 1 + 4 * i, 4) for i in range(3)], F.substring(card, 13, 10)), "#")
    card = F.replace(card, F.lit("#"), pick(2, [".", "/", "_", "\u2013"]))
    sep = pick(4, [" ", "-", ".", "/"])
    joined = lambda s, *xs: F.concat_ws("", *[F.concat(s, x) if k else x for k, x in enumerate(xs)])
    a3, b3, c4 = number(1, 3), number(2, 3), number(3, 4)
    phone = pick(3, [
        joined(sep, a3, b3, c4), F.concat(F.lit("("), a3, F.lit(") "), b3, pick(5, ["-", " ", "."]), c4), joined(sep, F.concat(F.lit("0"), number(4, 2)), c4, number(5, 4)),
        joined(sep, F.concat(F.lit("0"), number(4, 3)), number(5, 3), number(6, 4)), joined(pick(5, [" ", "-"]), F.concat(F.lit("00"), number(7, 2)), number(4, 3), b3, c4), joined(sep, F.lit("1"), a3, b3, c4),
    ])
    day, month = F.lpad((draw(32, 28) + 1).cast("string"), 2, "0"), F.lpad((draw(33, 12) + 1).cast("string"), 2, "0")
    year = (draw(34, 90) + 1940).cast("string")
    not_phone = pick(35, [
        joined(sep, year, month, day), joined(sep, day, month, year), joined(F.lit("."), number(1, 1), number(2, 1), number(3, 1), number(4, 2)), joined(F.lit("-"), F.lit("978"), number(1, 1), number(2, 2), number(3, 6), number(4, 1)),
        joined(F.lit(" "), number(1, 1), number(2, 2), number(3, 1)), joined(F.lit("/"), number(1, 2), number(2, 2)), joined(F.lit("."), number(1, 3), number(2, 3), number(3, 3), number(4, 3), number(5, 3)), joined(F.lit("-"), number(1, 6), number(2, 8), number(3, 6)),
    ])
    word = lambda j: pick(j, ["ana", "j.doe", "info", "kim7", "sales", "max-m", "look", "noon", "home", "page"])
    host, top = pick(8, ["mail", "corp", "uni", "web-4", "office"]), pick(10, ["com", "org", "net", "de", "fr"])
    mail = F.concat(word(6), pick(7, [" (at) ", "[at]", "(at)", "{at}", " at ", "<at>", "[@]"]), host, pick(9, [" (dot) ", " dot ", "[dot]", "(.)", "."]), top)
    mail = F.when(F.contains(mail, F.lit(" at ")) & ~F.lower(mail).rlike("dot"), F.replace(mail, F.lit(" at "), F.lit("(at)"))).otherwise(mail)
    not_mail = pick(36, [F.concat(pick(6, ["f", "x"]), F.lit("(at)"), number(4, 1), F.lit("."), number(5, 2)), F.concat(word(37), F.lit(" at "), word(38), F.lit("."), word(39)), F.concat(word(37), F.lit(" at "), word(38), F.lit(". "), word(39)), F.concat(word(37), F.lit(" at "), number(4, 1), F.lit("."), number(5, 2))])
    v6 = pick(40, [F.concat_ws(":", *[hexed(i) for i in range(8)]), F.concat(F.lit("2001:db8:"), hexed(1), F.lit("::"), hexed(2)), F.concat(F.lit("fe80::"), hexed(1), F.lit(":"), hexed(2)), F.concat(hexed(1), F.lit(":"), hexed(2), F.lit("::"), hexed(3), F.lit(":"), hexed(4)), F.concat(F.lit("2001:db8::"), small(5)), F.concat(hexed(1), F.lit("::"), small(6))])
    not_v6 = pick(41, [F.concat_ws(":", *[number(20 + i, 2) for i in range(3)]), F.concat_ws(":", *[number(20 + i, 2) for i in range(4)]), F.concat_ws(":", *[F.substring(F.lpad(hexed(i), 4, "0"), 1, 2) for i in range(6)]), F.concat_ws(":", *[number(20 + i, 1) for i in range(3)]), F.concat(number(1, 1), F.lit("::"), number(2, 1)), F.lit("::"), F.concat(F.lit(":"), number(1, 2), F.lit(":"))])
    near = {"email": ["mail: ", "contact ", "write to "], "ip": ["ip ", "server ", "host "], "card": ["card ", "visa ", "credit "], "phone": ["call ", "tel: ", "phone "]}
    text, named = F.lit(""), F.lit("")
    for k, yes, no in (("email", mail, not_mail), ("ip", v6, not_v6), ("card", card, card), ("phone", phone, not_phone)):
        text = F.when(kind == k, F.when(good, yes).otherwise(no)).otherwise(text)
        named = F.when(kind == k, pick(11, near[k])).otherwise(named)
    named = F.when(draw(42, 10) < F.when(good, 4).otherwise(1), named).otherwise(pick(12, ["", "", "", "part ", "no ", "on "]))
    rows = spark.range(n).coalesce(1).select("id", kind.alias("kind"), text.alias("text"), named.alias("named"), pick(43, [" ", " ", ".", ",", ""]).alias("mark"), good.cast("double").alias("label"), (F.col("id") % 2).alias("part"))
    pool = contexts(docs)
    if pool is None:
        rows = rows.withColumns({"before": F.lit(" "), "behind": F.lit("")})
    else:
        rows = rows.withColumn("k0", F.col("id") % CONTEXTS).join(F.broadcast(pool), F.col("k0") == F.col("k"), "left")  # CONTEXTS rows
    left = F.right(F.concat(F.coalesce("before", F.lit("")), F.lit(" "), "named"), F.lit(16))
    right = F.substring(F.concat("mark", F.when(F.col("mark") == "", "").otherwise(F.coalesce("behind", F.lit("")))), 1, 1)
    return rows.select("id", "kind", "text", left.alias("left"), right.alias("right"), "label", "part")


Model = tuple[list[tuple[float, str]], dict[str, float]]


def trained(spark: SparkSession, n: int = SAMPLE, docs: DataFrame | None = None) -> Model:
    """(weight, debug text of each tree), and the threshold of each kind."""
    return fitted(spark, n, docs)[0]


def quality(spark: SparkSession, n: int = SAMPLE, docs: DataFrame | None = None) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each kind on the held-out cases, at its threshold."""
    return fitted(spark, n, docs)[1]


def fitted(spark: SparkSession, n: int, docs: DataFrame | None) -> tuple[Model, dict[str, tuple[float, float]]]:
    f = features(F.struct(*[F.col(x) for x in ("kind", "text", "left", "right")]))
    rows = generated_cases(spark, n, docs=docs).select("id", F.col("kind").alias("of_kind"), "label", "part", *[f[x].alias(x) for x in FEATURES])
    rows = rows.repartition(1).sortWithinPartitions("id").cache()  # `n` rows, in one order
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(labelCol="label", maxIter=12, maxDepth=4, stepSize=0.4, seed=SEED).fit(vectors.transform(rows.where("part = 0")))
    trees = list(zip(model.treeWeights, [t.toDebugString for t in model.trees]))
    scored = rows.where("part = 1").select("of_kind", "label", probability(trees, {x: F.col(x) for x in FEATURES}).alias("p"))
    least, found = {}, {}
    held = scored.groupBy("of_kind", F.round("p", 6).alias("p")).agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()  # from `n` rows at most
    for kind in KINDS:
        of_kind = sorted((r for r in held if r["of_kind"] == kind), key=lambda r: -r["p"])
        yes = all_ = 0.0
        whole = max(1.0, sum(r["yes"] for r in of_kind))
        least[kind], found[kind] = 2.0, (1.0, 0.0)  # none
        for r in of_kind:
            yes, all_ = yes + r["yes"], all_ + r["n"]
            if yes >= PRECISION * all_ and r["p"] >= 0.5:
                least[kind], found[kind] = r["p"] - 1e-6, (yes / all_, yes / whole)
    rows.unpersist()
    return (trees, least), found


def tree_case(debug: str, f: dict[str, Column]) -> Column:
    """A tree's debug text as a CASE expression over its features."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in debug.splitlines()[1:] if x.strip()]

    def node(i: int) -> tuple[Column, int]:
        depth, line = lines[i]
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1])), i + 1
        number, bound = re.search(r"feature (\d+) <= (\S+?)\)", line).groups()
        yes, i = node(i + 1)
        no, i = node(i + 1)  # past the Else line
        return F.when(f[FEATURES[int(number)]] <= float(bound), yes).otherwise(no), i

    return node(0)[0]


def tree_sql(debug: str, f: str) -> str:
    """A tree's debug text as an SQL expression over the fields of `f`."""
    lines = [x.strip() for x in debug.splitlines()[1:] if x.strip()]

    def node(i: int) -> tuple[str, int]:
        if lines[i].startswith("Predict"):
            return f"{float(lines[i].split(':')[1])!r}D", i + 1
        number, bound = re.search(r"feature (\d+) <= (\S+?)\)", lines[i]).groups()
        yes, i = node(i + 1)
        no, i = node(i + 1)  # past the Else line
        return f"CASE WHEN {f}.{FEATURES[int(number)]} <= {float(bound)!r}D THEN {yes} ELSE {no} END", i

    return node(0)[0]


def probability_sql(trees: list[tuple[float, str]], f: str) -> str:
    """As `probability`, from text, which the engine reads at once."""
    margin = " + ".join(["0.0D", *[f"{float(w)!r}D * ({tree_sql(d, f)})" for w, d in trees]])
    return f"1 / (1 + exp(-2 * ({margin})))"


def probability(trees: list[tuple[float, str]], f: dict[str, Column]) -> Column:
    margin = sum((F.lit(w) * tree_case(d, f) for w, d in trees), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, text, base and spans: arrays of (kind, start, end, ...) by kind and start; secrets:
    their count."""
    trees, least = model
    text = F.coalesce(F.col("text"), F.lit(""))

    def passing(kind: str, rx: str, gate: str) -> Column:
        return F.filter(matches(F.col("text"), kind, rx, gate), lambda s: passes(kind, s["text"]))

    base = F.concat(*[passing(*g) for g in BASE])
    more = F.concat(*[matches(F.col("text"), *g) for g in MORE])
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", base).withColumn("more", more)

    def threshold(kind: Column) -> Column:
        t = F.lit(2.0)
        for k, v in least.items():
            t = F.when(kind == k, v).otherwise(t)
        return t

    by_start = lambda x: F.array_sort(F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("c"))))
    # features once a candidate, below the trees that read them
    seen = F.transform(apart_from(by_start(F.col("more")), by_start(F.col("base"))), lambda x: x["c"])
    seen = F.transform(seen, lambda c: F.struct(c.alias("c"), F.struct(*[v.alias(k) for k, v in features(c).items()]).alias("f")))
    rows = rows.withColumn("seen", F.when(F.size("more") > 0, seen)).withColumn("scored", F.expr(f"transform(seen, x -> struct(x.c AS c, {probability_sql(trees, 'x.f')} AS p))"))
    likely = F.transform(F.filter("scored", lambda x: x["p"] >= threshold(x["c"]["kind"])), lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["end"].alias("end"), x["p"].alias("p"), x["c"].alias("c")))
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.transform(best_first(F.array_sort(likely), lambda x: F.struct((-x["p"]).alias("p"), x["start"].alias("s"), x["c"].alias("c")), overlap), lambda x: x["c"])
    rows = rows.withColumn("added", F.coalesce(F.when(F.size("scored") > 0, free), F.array().cast(SPAN)))

    def of_kind(x: Column, kind: str) -> Column:
        return F.array_sort(F.transform(F.filter(x, lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    secret = (F.col("text").rlike(SECRET_GATE[0]) & F.col("text").rlike(SECRET_GATE[1])) | F.contains("text", F.lit("-----BEGIN ")) | F.col("text").rlike(r"\b(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_|sk-)")
    order = lambda x: F.concat(*[of_kind(x, k) for k in KINDS])
    return rows.select("doc_id", "text", order(F.col("base")).alias("base"), order(F.concat("base", "added")).alias("spans"), F.when(secret, F.regexp_count("text", F.lit(SECRET))).otherwise(0).cast("long").alias("secrets"))


def redact(docs: DataFrame, model) -> DataFrame:
    """(doc_id, text): each span replaced by its kind in brackets, from left to right."""
    found = find(docs, model)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    done = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return found.select("doc_id", done.alias("text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, trained(spark, docs=docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.col("secrets").alias("n_secrets"), ((F.size("spans") > 0) | (F.col("secrets") > 0)).alias("private"))
