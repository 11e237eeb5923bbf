"""PII spans by boosted trees over candidates, with DataFrame functions and Spark ML only.

1. *Base spans* of four kinds come from fixed patterns and validators, leftmost and non-overlapping within a kind; they stay.
2. *Generators* of high recall propose overlapping candidates: addresses with any kind of at and dot, runs like numbers, tokens like
   keys (12 or more characters with a digit), and whatever follows a cue word and ``=`` or ``:``. Each has format features (length,
   shares and kinds of characters, groups; an address is first written with @ and dots) and context features (signs around it, and
   how often the word before it stands before labelled candidates).
3. Weak labels: a candidate that overlaps a base span, or a key of a known format, is personal; all others count as not. No
   feature holds what the validators ask (the plus, the @, check sums, a key's prefix), so trees learn what else personal data have in
   common, and give the same to what the validators miss. A quarter of the candidates (by hash) gives the words' shares, two quarters
   fit gradient-boosted trees, on at most MAX_FITTED candidates (smallest hashes), turned into one SQL expression.
4. *Calibrated thresholds*: for each generator and kind the lowest score (0.5 at least) from which on the last quarter's candidates
   reach PRECISION; where these are too few to tell, FEW at least. Candidates from there on that overlap no base span are added.

Positions are code points, ends exclusive. Patterns are possessive with a look-behind for what precedes, which finds the same
matches as the plain ones and stays linear on long runs. Positions and overlaps of a text's matches are running sums and maxima in
pieces of about the square root of their number, so a text with many matches costs little more than as many texts. All is done within
rows: no join, no shuffle of texts. A null text is an empty one and has no span. Repeated rows get equal results; extra columns are
ignored; an empty table gives an empty one. With too little to fit (fewer than MIN_FITTED candidates or one class only) nothing is added.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, materialize, table, text_or_empty

MAX_FITTED, MIN_FITTED, PRECISION, FEW, CUES = 20_000, 40, 0.95, 0.9, 100
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "secret"]
AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20?@\x20?)"
DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
GENERATORS = {
    "address": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:{AT}|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]++\x20(?:dot|DOT)\x20))[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+",
    "number": r"(?:\G|(?<![0-9.A-Za-z]))[(]?[0-9](?:[\x20().·/_-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
    "key": r"(?:\G|(?<![A-Za-z0-9+/_-]))(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+",
    "value": r"(?<![^\"' =:])(?<=(?:assword|asswd|pwd|oken|ecret|ey|ASSWORD|OKEN|ECRET|KEY)[\"' ]{0,2}[=:][\"' ]{0,2})[^\s\"',;=:]++",
}
GATES = {"address": "@|at[\\])}>]|AT[\\])}>]| (?:dot|DOT) ", "number": "[0-9]", "key": "[0-9]", "value": "[=:]"}
#: Formats of well-known keys.
KNOWN_KEY = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{20,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
FEATURES = 13  # the last one is the share of the word before


def along(array: Column, start: Column, of) -> Column:
    """of(start, x0), of(of(start, x0), x1) and so on."""
    first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return let(of(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

    return F.aggregate(array, first, step, lambda acc: acc["out"])


def running(values: Column, merge, zero: Column) -> Column:
    """merge(merge(zero, v0), v1) and so on for each place of an array: by pieces of about the square root of its size."""
    def cut(v: Column, wide: Column) -> Column:
        none = F.array().cast("array<array<int>>")
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / wide).cast("int")), lambda k: F.slice(v, k * wide + 1, wide))).otherwise(none)

    def whole(pieces: Column) -> Column:
        starts = F.concat(F.array(zero), along(pieces, zero, lambda at, piece: F.aggregate(piece, at, merge)))
        return let(starts, lambda st: F.flatten(F.transform(pieces, lambda piece, k: along(piece, F.get(st, k), merge))))

    return let(values, lambda v: let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda wide: let(cut(v, wide), whole)))


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<s, e, m, before, after>> of each match: positions are running sums of the lengths of matches and of what is between."""
    def of(hits: Column, parts: Column) -> Column:
        lengths = F.flatten(F.zip_with(parts, hits, lambda part, hit: F.array(F.length(part), F.coalesce(F.length(hit), F.lit(0)))))

        def rows(ends: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                before = F.right(F.concat(F.coalesce(F.get(hits, i - 1), F.lit("")), F.get(parts, i)), F.lit(24))
                after = F.left(F.concat(F.get(parts, i + 1), F.coalesce(F.get(hits, i + 1), F.lit(""))), F.lit(1))
                return F.struct(F.get(ends, 2 * i).alias("s"), F.get(ends, 2 * i + 1).alias("e"), hit.alias("m"), before.alias("before"), after.alias("after"))

            return F.transform(hits, one)

        return let(running(lengths, lambda a, b: a + b, F.lit(0)), rows)

    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(F.split(text, pattern, -1), lambda parts: of(hits, parts)))
    return F.when(gate & text.rlike(pattern), found).otherwise(none)


def spans(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<s, e, m>>: start, end and string of each match."""
    return F.transform(matches(text, pattern, gate), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The validated spans of each kind."""
    has_digit = text.rlike("[0-9]")
    part_ok = lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")) <= 255, F.lit(False))
    size = lambda x: F.length(digits(x["m"]))
    return {
        "email": spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP, has_digit), lambda x: F.forall(F.split(x["m"], r"\."), part_ok)),
        "card": F.filter(spans(text, CARD, has_digit), lambda x: F.when(size(x).between(16, 19), luhn(digits(x["m"]))).otherwise(False)),
        "phone": F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: size(x).between(8, 15)),
    }


def features(x: dict[str, Column], m: Column) -> list[Column]:
    """All but the last of the FEATURES numbers of a candidate, of its format and of its context; m: written with @ and dots."""
    n = F.length(m)
    share = lambda p: F.length(F.regexp_replace(m, f"[^{p}]", "")) / n
    groups = F.split(m, "[^0-9A-Za-z]+")
    is_ = lambda c: c.cast("int")
    distinct = F.size(F.array_distinct(F.split(F.left(m, F.lit(256)), "")))
    out = [x["g"], F.log2(n.cast("double")), F.length(digits(m)), share("0-9"), share("A-Z"), share("a-z"), distinct / F.least(n, F.lit(256)), F.size(groups),
           F.array_max(F.transform(groups, F.length)), is_(x["before"].rlike(r"[=:][\"' ]*$")), is_(x["before"].rlike(r"[\"'<]$")), is_(x["after"].rlike("[A-Za-z0-9]"))]
    return [c.cast("double") for c in out]


def clear_of(found: Column, known: Column) -> Column:
    """Whether each of found (ascending, without overlaps) overlaps none of known: a known span that begins before its end ends before it."""
    ends = F.transform(found, lambda c: F.struct(c["e"].alias("at"), F.lit(0).alias("t"), c["s"].alias("v")))
    begins = F.transform(known, lambda k: F.struct(k["s"].alias("at"), F.lit(1).alias("t"), k["e"].alias("v")))

    def told(events: Column) -> Column:
        furthest = running(F.transform(events, lambda x: F.when(x["t"] == 1, x["v"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b), F.lit(0))
        return F.filter(F.zip_with(events, furthest, lambda x, far: F.when(x["t"] == 0, far <= x["v"])), lambda clear: clear.isNotNull())

    return F.when((F.size(known) > 0) & (F.size(found) > 0), let(F.array_sort(F.concat(ends, begins)), told)).otherwise(F.transform(found, lambda c: F.lit(True)))


def candidates(text: Column, known: Column) -> Column:
    """array<struct<g, s, e, kind, weak, clear, word, f>>: g is the generator's number, weak the label, clear says that no base span overlaps."""
    out = []
    for g, (name, pattern) in enumerate(GENERATORS.items()):
        def build(x: Column, clear: Column, g=g, name=name) -> Column:
            x = {k: x[k] for k in ("s", "e", "m", "before", "after")} | {"g": F.lit(g)}
            weak = ~clear if name in ("address", "number") else x["m"].rlike(KNOWN_KEY)
            number = F.when(x["m"].rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip").when(F.length(digits(x["m"])) >= 13, "card").otherwise("phone")
            kind = F.lit("email") if name == "address" else number if name == "number" else F.lit("secret")
            word = F.lower(F.regexp_extract(x["before"], "([A-Za-z_]+)[^A-Za-z_]*$", 1))
            plain = F.regexp_replace(F.regexp_replace(x["m"], AT + r"|\x20(?:at|AT)\x20", "@"), DOT, ".") if name == "address" else x["m"]
            f = let(plain, lambda m: F.array(*features(x, m)))
            return F.struct(x["g"].alias("g"), x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"), weak.cast("double").alias("weak"), clear.alias("clear"), word.alias("word"), f.alias("f"))

        out.append(let(matches(text, pattern, text.rlike(GATES[name])), lambda found: F.zip_with(found, clear_of(found, known), lambda x, clear: build(x, clear))))
    return F.concat(*out)


def tree_expression(lines: list[str], f) -> Column:
    """A tree's printed form (``If (feature 3 <= 0.5)``, ``Else``, ``Predict: x``) as nested conditions; f gives the column of a feature."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    feature, value = re.match(r"If \(feature (\d+) <= ([-+.\dEe]+)\)", line).groups()
    low = tree_expression(lines, f)
    lines.pop(0)  # Else
    return F.when(f(int(feature)) <= float(value), low).otherwise(tree_expression(lines, f))


def lowest_thresholds(rows: list[tuple], precision: float = PRECISION) -> dict:
    """group -> the score from which on candidates reach the precision. rows: group, hundredths, personal, all.

    It is half way between the lowest hundredth that does and the next one that has candidates, 0.5 at least; and FEW at least where one
    right and one wrong candidate more would miss the precision.
    """
    out: dict = {}
    for group in {r[0] for r in rows}:
        yes = n = 0
        ordered = sorted((r[1:] for r in rows if r[0] == group), reverse=True)
        for (cent, personal, every), (below, *_) in zip(ordered, [*ordered[1:], (0,)]):
            yes, n = yes + personal, n + every
            if yes >= precision * n:
                out[group] = max((cent + below) / 200, 0.5 if yes + 1 >= precision * (n + 2) else FEW)
    return out


def fit(found: DataFrame, scratch: Scratch, trees: int = 10, depth: int = 3):
    """candidate -> probability as a column builder, and the threshold of each generator; None if there's too little to fit."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    every = found.select("doc_id", F.explode("found").alias("c")).select("c.g", "c.kind", "c.weak", "c.f", "c.word", F.xxhash64("c.f", "c.g", "c.s", "doc_id").alias("h"))
    of_word = every.where("pmod(h, 4) = 1").groupBy("word").agg(F.sum("weak").alias("yes"), F.count("*").alias("n"))
    cues = {r["word"]: (r["yes"] + 0.5) / (r["n"] + 2.0) for r in of_word.orderBy(F.desc("yes"), F.desc("n"), "word").limit(CUES).collect()}
    cue_map = F.create_map(*(F.lit(x) for kv in cues.items() for x in kv)) if cues else None
    cue = lambda word: F.coalesce(F.element_at(cue_map, word), F.lit(0.25)) if cues else F.lit(0.25)
    sample = every.where("pmod(h, 4) > 1").orderBy("h").limit(MAX_FITTED).select("weak", array_to_vector(F.concat("f", F.array(cue(F.col("word"))))).alias("features"))
    sample = scratch(sample, "fitted")
    classes = {r["weak"]: r["count"] for r in sample.groupBy("weak").count().collect()}
    if len(classes) < 2 or sum(classes.values()) < MIN_FITTED:
        return None
    model = GBTClassifier(labelCol="weak", maxIter=trees, maxDepth=depth, seed=7, maxMemoryInMB=64).fit(sample.coalesce(4))
    printed = [t.toDebugString.split("\n")[1:] for t in model.trees]
    weights = model.treeWeights

    def score(f: Column, word: Column) -> Column:
        total = F.lit(0.0)
        for lines, w in zip(printed, weights):
            total = total + tree_expression([x for x in lines if x.strip()], lambda k: f[k] if k < FEATURES - 1 else cue(word)) * float(w)
        return 1 / (1 + F.exp(-2 * total))

    held = every.where("pmod(h, 4) = 0").groupBy("g", "kind", F.floor(score(F.col("f"), F.col("word")) * 100).cast("int").alias("cent")).agg(F.sum("weak").alias("yes"), F.count("*").alias("n"))
    return score, lowest_thresholds([((r["g"], r["kind"]), r["cent"], r["yes"], r["n"]) for r in held.collect()])  # at most 101 rows a group


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of kind, s, e), added (likewise) of every row."""
    scratch = Scratch()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base_spans(F.col("text"))
    rows = rows.select("doc_id", "text", *(c.alias(f"mq_{k}") for k, c in base.items()))
    whole = F.concat(*(_kinded(F.col(f"mq_{k}"), k) for k in base))
    rows = rows.select("doc_id", "text", whole.alias("base"))
    found = materialize(rows.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("found")), "found")
    fitted = fit(found, scratch)
    scratch.release()
    added = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    if fitted:
        score, thresholds = fitted
        kept = F.filter("found", lambda c: c["clear"] & (score(c["f"], c["word"]) >= _threshold(c["g"], c["kind"], thresholds)))
        added = F.array_distinct(F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))))
    return found.select("doc_id", "base", added.alias("added"))


def _kinded(array: Column, kind: str) -> Column:
    return F.transform(array, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _threshold(generator: Column, kind: Column, thresholds: dict[tuple[int, str], float]) -> Column:
    out = F.lit(2.0)  # no threshold: nothing reaches it
    for (g, k), t in thresholds.items():
        out = F.when((generator == g) & (kind == k), F.lit(t)).otherwise(out)
    return out


def joined(array: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    ordered = F.concat(*(_of_kind(array, kind) for kind in KINDS))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _of_kind(array: Column, kind: str) -> Column:
    chosen = F.filter(array, lambda x: x["kind"] == kind)
    return F.array_sort(F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans to redact, unfolded: kind, s, e."""
    found = pii(docs, id_col, text_col)
    return found.select("doc_id", F.explode(F.concat("base", "added")).alias("x")).select("doc_id", "x.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = pii(table(spark, sf_dir, "documents"))
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
