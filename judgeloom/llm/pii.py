"""Personal data in texts, by DataFrame functions alone.

Base spans follow four fixed patterns with their checks and always stay. Wider candidates (spelled-out
e-mail addresses, numbers without a country code, identity numbers, names after a title) are settled by weak supervision:
labelers - patterns and checksums, gazetteers, words before the span, characters around it - vote for,
against or not at all on every candidate, base ones included. Spark counts the patterns of votes
and features over all documents; expectation-maximisation over these counts estimates how reliable each
labeler is for either class; the posteriors train a logistic span classifier on the features, and a
candidate is added if the classifier says so and no base span overlaps it.

Everything on the rows is a column expression: no Python worker runs. The driver sees counts of vote
patterns only, of which there are at most as many as combinations of the labelers' and features' values.

Positions are code points, ends exclusive. Arrays of spans are worked in groups of GROUP, so that a text with very many spans takes time
in proportion to them. Cases: a null text is empty; texts are read whole, and patterns are
possessive so that long runs take linear time; equal spans of two kinds both count; repeated rows are judged
each and vote each; an empty table trains nothing and adds nothing; other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that no start or length is tried twice; they find what the plain forms find.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match the base pattern.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
#: Wider candidates: origin, kind, pattern, what a text needs to match.
WIDER = (
    ("spelled", "email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{{2,24}}+){{1,4}}+", r"(?:\[dot\]|\(dot\)| dot )"),
    ("local", "phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("social", "id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("iban", "id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    ("titled", "name", rf"(?<![\p{{L}}])(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}{{1,30}}+(?: \p{{Lu}}\p{{Ll}}{{1,30}}+){{0,2}}+", rf"(?:{TITLES})\.? \p{{Lu}}"),
    ("access", "secret", r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])", r"A[KS]IA[A-Z0-9]{16}"),
    ("assigned", "secret", r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?[^\s=:]{6,200}+", r"(?i)(?:password|passwd|pwd|secret|token|key)\x20?[=:]"),
)
KINDS = ("email", "ip", "card", "phone", "id", "name", "secret")
#: Gazetteers, as one pattern a kind over the span's text.
GAZETTEER = {
    "email": r"(?i)(?:\.| dot |\[dot\]|\(dot\)) ?(?:com|org|net|edu|gov|io|info|biz|co|uk|de|fr|es|it|eu|us)$",
    "ip": r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{14})|\(?[2-9][0-9]{2}\)?)",
    "id": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)[0-9]{2}|^(?!000|666|9)[0-9]{3}-(?!00)",
    "name": r"(?:\s|^)(?:James|John|Robert|Michael|William|David|Mary|Anna|Anne|Maria|Elizabeth|Linda|Susan|Sarah|Thomas|Charles|Peter|Paul|Hans|Klaus|Jean|Pierre|Marie|Juan|Carlos|Carmen|Jose|Luis|Smith|Jones|Brown|Miller|Schmidt|Dubois|Garcia)(?:\s|$)",
    "secret": r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]",
}
#: Words before a span that speak for and against it.
FOR = r"(?i)(?:contact|call|tel|phone|mobile|cell|fax|e-?mail|mail|write|reach|server|host|address|ip|card|visa|payment|account|iban|ssn|security|passport|name|signed|dear|kontakt|telefon|téléphone|teléfono|correo|courriel)\W{0,3}(?:\w{1,6}\W{1,2})?$"
AGAINST = r"(?i)(?:version|ver|v|isbn|order|invoice|ref|page|chapter|section|figure|fig|build|release|no|nr|table|§)\W{0,3}$"
REACH = 24
ROUNDS, STEPS, RATE = 25, 300, 0.5
ADD_AT = 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits of a short text pass the Luhn check."""
    back = F.reverse(_digits(text))

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _passes(kind: str, text: Column) -> Column:
    """The check of a base pattern's match."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.substring(F.concat(F.lit("00"), p), -3, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(text)).between(13, 19), _luhn(text)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<kind:string,origin:string,start:int,end:int,said:string,before:string,after:string,checked:boolean>>"


#: Elements of an array that are worked in one go.
GROUP = 256


def _grouped(values: Column, size: int = GROUP) -> Column:
    """values in arrays of size."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, size))


def _before(values: Column, join: Callable[[Column, Column], Column], first: int) -> Column:
    """For each number of an array, those before it joined (a sum, a maximum): within groups, after the groups before."""

    def scan(numbers: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(numbers, empty, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def over(groups: Column) -> Column:
        whole = F.transform(groups, lambda g: F.aggregate(g, F.lit(first), join))
        return F.flatten(F.transform(F.arrays_zip(groups.alias("g"), scan(whole, F.lit(first)).alias("start")), lambda z: scan(z["g"], z["start"])))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(_grouped(values), over))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _matches(text: Column, pattern: str, needs: str, kind: str, origin: str, check: Column | None) -> Column:
    """All matches of a pattern with their places: the pieces between them and they themselves give the positions."""
    pieces = F.split(text, pattern)
    parts = let(pieces, lambda p: F.arrays_zip(p.alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"), F.slice(p, 2, F.size(p)).alias("next")))

    def span(x: Column) -> Column:
        start = x["at"] + F.length(x["part"]["piece"])
        said = x["part"]["said"]
        checked = _passes(kind, said) if check is None else check
        after = F.substring(F.coalesce(x["part"]["next"], F.lit("")), 1, 1)
        return F.struct(F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), start.alias("start"), (start + F.length(said)).alias("end"), said.alias("said"), F.right(x["part"]["piece"], F.lit(REACH)).alias("before"), after.alias("after"), checked.alias("checked"))

    def placed(p: Column) -> Column:
        sizes = F.transform(p, lambda x: F.length(x["piece"]) + F.length(F.coalesce(x["said"], F.lit(""))))
        at = let(sizes, lambda n: _before(n, _add, 0))
        return F.transform(F.filter(F.arrays_zip(p.alias("part"), at.alias("at")), lambda x: x["part"]["said"].isNotNull()), span)

    return F.when(text.rlike(needs), let(parts, placed)).otherwise(F.array()).cast(SPAN)


def found(docs: DataFrame, text: Column) -> DataFrame:
    """docs with __text, an array column of matches per base kind (__email, ...) and __wider."""
    held = docs.withColumn("__text", F.coalesce(text.cast("string"), F.lit("")))
    t = F.col("__text")
    wider = F.concat(*(_matches(t, p, needs, kind, origin, F.lit(True)) for origin, kind, p, needs in WIDER))
    return held.select("*", *(_matches(t, p, NEEDS[k], k, "base", None).alias(f"__{k}") for k, p in BASE.items()), wider.alias("__wider"))


def _votes(c: Column) -> list[Column]:
    """One vote in -1, 0, 1 of each labeler."""
    by_kind = lambda pairs, other: reduce(lambda acc, kv: F.when(c["kind"] == kv[0], kv[1]).otherwise(acc), pairs, F.lit(other))
    pattern = F.when(~c["checked"], -1).when(c["origin"].isin("base", "social", "iban", "access", "assigned"), 1).otherwise(0)
    listed = by_kind([(k, F.when(c["said"].rlike(g), 1).otherwise(-1 if k in ("card", "ip", "email") else 0)) for k, g in GAZETTEER.items()], 0)
    context = F.when(c["before"].rlike(FOR), 1).when(c["before"].rlike(AGAINST), -1).otherwise(0)
    around = F.when(c["before"].rlike(r"[\p{L}\p{N}_./-]$") | c["after"].rlike(r"^[\p{L}\p{N}_/]"), -1).otherwise(1)
    return [pattern, listed, context, around]


def _features(c: Column) -> list[Column]:
    """Binary features of a span."""
    origins = [w[0] for w in WIDER]
    n = F.length(c["said"])
    return [
        *((c["kind"] == k) for k in KINDS),
        *((c["origin"] == o) for o in origins),
        c["checked"],
        n > 12,
        n > 24,
        c["before"].rlike(r"(?:^|\s)$"),
        c["before"].rlike(FOR),
        c["before"].rlike(AGAINST),
        c["after"].rlike(r"^[\s,.;!?)]") | (c["after"] == ""),
    ]


def _estimate(patterns: list[tuple[tuple[int, ...], float]]) -> list[float]:
    """Posterior of each vote pattern, by EM over two classes with a table of vote chances a labeler and class."""
    labelers = len(patterns[0][0])
    post = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in patterns]
    for _ in range(ROUNDS):
        total = sum(n for _, n in patterns)
        prior = (1 + sum(p * n for p, (_, n) in zip(post, patterns))) / (2 + total)
        chance = [[{v: (1 + (v == (1 if y else -1))) for v in (-1, 0, 1)} for y in (0, 1)] for _ in range(labelers)]
        for p, (votes, n) in zip(post, patterns):
            for j, v in enumerate(votes):
                chance[j][1][v] += p * n
                chance[j][0][v] += (1 - p) * n
        for j in range(labelers):
            for y in (0, 1):
                whole = sum(chance[j][y].values())
                chance[j][y] = {v: x / whole for v, x in chance[j][y].items()}
        post = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j][1][v] / chance[j][0][v]) for j, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return post


def train(docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """Weights of the span classifier (the last is the intercept), or None if there is nothing to learn from."""
    spans = found(docs.select(F.col(f"`{text_col}`")), F.col(f"`{text_col}`"))
    each = spans.select(F.explode(F.concat(*(F.col(f"__{k}") for k in BASE), F.col("__wider"))).alias("c"))
    c = F.col("c")
    seen = each.select(F.array(*(v.cast("int") for v in _votes(c))).alias("votes"), F.array(*(F.coalesce(f, F.lit(False)) for f in _features(c))).alias("features")).groupBy("votes", "features").agg(F.count("*").alias("n")).collect()
    if not seen:
        return None
    by_votes: dict[tuple, float] = {}
    for r in seen:
        by_votes[tuple(r["votes"])] = by_votes.get(tuple(r["votes"]), 0) + r["n"]
    patterns = sorted(by_votes.items())
    post = dict(zip((v for v, _ in patterns), _estimate(patterns), strict=True))
    # a pattern of features counts by the logarithm of its spans, so that common spans don't drown rare ones
    rows = sorted(([float(f) for f in r["features"]] + [1.0], post[tuple(r["votes"])], math.log1p(r["n"])) for r in seen)
    w, whole = [0.0] * len(rows[0][0]), sum(n for *_, n in rows)
    for _ in range(STEPS):
        g = [0.001 * x for x in w]
        for x, y, n in rows:
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - y) * n / whole
            for k, v in enumerate(x):
                if v:
                    g[k] += e * v
        w = [a - 4 * RATE * b for a, b in zip(w, g)]
    return w


def _score(c: Column, weights: list[float]) -> Column:
    total = F.lit(float(weights[-1]))
    for f, w in zip(_features(c), weights, strict=False):
        total = total + F.when(f, float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def detect(docs: DataFrame, weights: list[float] | None, text_col: str = "text") -> DataFrame:
    """docs with __text and, per base kind, its spans (__email, __ip, __card, __phone), and __added."""
    spans = found(docs, F.col(f"`{text_col}`"))
    keep = {k: F.filter(F.col(f"__{k}"), lambda c: c["checked"]) for k in BASE}
    base = spans.select(*docs.columns, "__text", *(v.alias(f"__{k}") for k, v in keep.items()), "__wider")
    if weights is None:
        return base.withColumn("__added", F.filter("__wider", lambda c: F.lit(False))).drop("__wider")
    free = let(F.array_sort(F.concat(*(_tagged(F.col(f"__{k}"), False) for k in BASE), _tagged(F.col("__wider"), True))), _free)
    none = F.size("__wider") == 0
    return base.withColumn("__added", F.when(none, F.col("__wider")).otherwise(F.filter(free, lambda c: _score(c, weights) >= ADD_AT))).drop("__wider")


def _tagged(spans: Column, wider: bool) -> Column:
    return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(wider).alias("wider"), c.alias("span")))


def _free(spans: Column) -> Column:
    """The wider ones of ordered spans that overlap no base one: those before end in time, those after begin late enough."""
    far = 2**31 - 1
    reach = let(F.transform(spans, lambda x: F.when(x["wider"], 0).otherwise(x["end"])), lambda n: _before(n, _most, 0))
    ahead = F.reverse(let(F.reverse(F.transform(spans, lambda x: F.when(x["wider"], far).otherwise(x["start"]))), lambda n: _before(n, _least, far)))
    kept = F.filter(F.arrays_zip(spans.alias("x"), reach.alias("reach"), ahead.alias("ahead")), lambda z: z["x"]["wider"] & (z["reach"] <= z["x"]["start"]) & (z["ahead"] >= z["x"]["end"]))
    return F.transform(kept, lambda z: z["x"]["span"])


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _listed(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(_rank(s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(detected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.concat(*(F.col(f"__{k}") for k in BASE))
    return detected.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.concat(base, "__added")).alias("spans"),
    )


#: Code points of a part of a text that is cut at many places.
PART = 1024


def _between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in parts of PART."""
    first = F.floor(start / PART).cast("int")
    held = F.array_join(F.slice(parts, first + 1, F.floor(end / PART).cast("int") - first + 1), "")
    return F.substring(held, start - first * PART + 1, end - start)


def redacted(docs: DataFrame, weights: list[float] | None, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; texts without a span stay as they are."""
    spans = detect(docs, weights, text_col)
    all_ = F.array_sort(F.transform(F.concat(*(F.col(f"__{k}") for k in BASE), F.col("__added")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    held = spans.select(*docs.columns, "__text", all_.alias("__spans"))
    text = F.col("__text")

    def replaced(x: Column) -> Column:
        # a span that begins before an earlier one ends goes with that one
        reach = let(F.transform(x["spans"], lambda s: s["end"]), lambda n: _before(n, _most, 0))
        kept = F.filter(F.arrays_zip(x["spans"].alias("s"), reach.alias("at")), lambda z: z["s"]["start"] >= z["at"])
        said = F.transform(kept, lambda z: F.concat(_between(x["parts"], z["at"], z["s"]["start"]), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]")))
        return F.concat(F.array_join(said, ""), _between(x["parts"], F.array_max(F.transform(x["spans"], lambda s: s["end"])), F.length(text)))

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PART).cast("int")), lambda k: F.substring(text, k * PART + 1, F.lit(PART)))
    new = let(F.struct(F.col("__spans").alias("spans"), parts.alias("parts")), replaced)
    own = F.col(f"`{text_col}`")
    return held.withColumn(text_col, F.when(F.size("__spans") > 0, new).otherwise(own)).select(*docs.columns)
