"""Cleaning of case texts: labels from conclusions, truncation before the outcome, repair, HTML to text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Where an assessment begins (at the start of a line or anywhere).
MARKERS = (
    r"^[IVX]+\.\s*THE COURT['’]?S ASSESSMENT",
    r"^[IVX]+\.\s*MERITS",
    r"^[IVX]+\.\s*THE MERITS",
    r"^THE COURT['’]?S ASSESSMENT",
    r"^MERITS$",
    r"^FOR THESE REASONS",
    r"^OPERATIVE PROVISIONS",
    r"^[IVX]+\.\s*APPLICATION OF ARTICLE 41",
    r"^APPLICATION OF ARTICLE 41",
    r"^ARTICLE 41",
    r"The Court will now assess",
    r"The Court will first examine",
    r"The Court must therefore determine",
    r"The Court will examine the merits",
    r"The Court notes at the outset that",
    r"The Court observes that the parties",
    r"Turning to the merits",
    r"As to the merits",
)
# What gives the outcome away, tried in this order.
CONCLUSORY = (
    r"(?:finds|concludes|holds)\s+that\s+there\s+has\s+(?:been|not been)\s+(?:a\s+)?violation",
    r"(?:finds|concludes|holds)\s+that\s+there\s+has\s+(?:been|not been)\s+(?:a\s+)?breach",
    r"there\s+has\s+(?:been|not been)\s+(?:a\s+)?violation\s+of\s+Article",
    r"there\s+has\s+(?:been|not been)\s+(?:a\s+)?breach\s+of\s+Article",
    r"no\s+violation\s+of\s+Article",
    r"violated?\s+Article",
    r"Accordingly,?\s+the\s+Court\s+(?:finds|concludes|holds)",
    r"It\s+follows\s+that\s+there\s+has\s+(?:been|not been)",
    r"In\s+the\s+light\s+of\s+the\s+above.*(?:finds|concludes)",
    r"The\s+Court\s+therefore\s+concludes",
    r"dismisses?\s+the\s+(?:application|complaint)",
    r"Holds\s+that",
    r"Decides\s+that",
)
MIN_LENGTH = 500
NO_TRUNCATION, MARKED, CONCLUDED = "no_truncation", "court_assessment_start", "aggressive_fix: conclusory_pattern"
REMOVED, CUT, CLEANED = "; surgical_fix: removed leaking sentence", "; surgical_fix: truncated before leaking sentence", "; conclusory_pattern_cleanup"

_FLAGS = "(?diuU)"


#: What (?U)\s matches.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACE))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def before_sentence(text: Column, pattern: str) -> Column:
    """The text up to the last full stop before a pattern's first match; null without a match or such a stop past the first character."""
    return let(F.split(text, _FLAGS + pattern, 2), lambda parts: F.when(F.size(parts) > 1, F.nullif(F.regexp_extract(parts[0], r"(?s)^(.+\.)", 1), F.lit(""))))


#: How conclusory patterns, and markers that stand anywhere, begin (with all letters that match i or s in any case): most places of a text are passed over at these two letters.
_I = "[iI\u0130\u0131]"
_CONCLUSION_BEGINS = f"(?=(?-iuU:[fF]{_I}|[cC][oO]|[hH][oO]|[tT][hH]|[nN][oO]|[vV]{_I}|[aA][cC]|{_I}[tTnN]|[dD][iI\u0130\u0131eE]))"
_MARKER_BEGINS = "(?=(?-iuU:[tT][hHuU]|[aA][sS\u017f]))"
#: Any conclusory pattern: one search tells whether they need to be tried in turn.
_ANY_CONCLUSION = _FLAGS + _CONCLUSION_BEGINS + "(?:" + "|".join(CONCLUSORY) + ")"
#: Any marker: only where the first one begins counts, so their order doesn't.
_ANY_MARKER = "(?dimuU)(?:^(?:" + "|".join(m[1:] for m in MARKERS if m[0] == "^") + ")|" + _MARKER_BEGINS + "(?:" + "|".join(m for m in MARKERS if m[0] != "^") + "))"


#: A word that every text has which the pattern matches, in the patterns' order: where it is missing, the search is left out.
_CONCLUSION_HAS = ("violation", "breach", "violation", "breach", "violation", "violate", "accordingly", "follows", "light", "therefore", "dismiss", "holds", "decides")
#: One of these is in every text that a marker matches.
_MARKER_HAS = (
    "s assessment", "merits", "for these reasons", "operative provisions", "article 41", "the court will now assess", "the court will first examine", "the court must therefore determine",
    "the court notes at the outset that", "the court observes that the parties",
)
#: Letters outside ASCII that a pattern's i, s or k matches, too.
_ODD = ("\u0130", "\u0131", "\u017f", "\u212a")


def _seen(text: Column) -> Column:
    """struct<lower, odd>: what _has looks at."""
    odd = F.contains(text, F.lit(_ODD[0]))
    for letter in _ODD[1:]:
        odd = odd | F.contains(text, F.lit(letter))
    return F.struct(F.lower(text).alias("lower"), odd.alias("odd"))


def _has(seen: Column, *words: str) -> Column:
    """Whether a text may hold one of words in any case, as patterns see it: false only where none is there."""
    out = seen["odd"]
    for w in words:
        out = out | F.contains(seen["lower"], F.lit(w))
    return out


def without_conclusions(text: Column, method: Column) -> Column:
    """struct<text, method>: every conclusory pattern in turn cuts what the ones before have left."""

    def cut_at(pattern):
        return lambda s: let(before_sentence(s["text"], pattern), lambda cut: F.struct(F.coalesce(rstrip(cut), s["text"]).alias("text"), F.concat(s["method"], F.when(cut.isNotNull(), CLEANED).otherwise("")).alias("method")))

    first = F.struct(text.alias("text"), method.alias("method"))
    state = first
    for pattern in CONCLUSORY:
        state = let(state, cut_at(pattern))
    return F.when(text.rlike(_ANY_CONCLUSION), state).otherwise(first)


def truncate(text: Column) -> Column:
    """struct<text, method>: the text before its assessment, and how that was found. A pattern is tried only where its words are."""

    def found(kept: Column, method: str) -> Column:
        return F.struct(kept.alias("text"), F.lit(method).alias("method"))

    plain = found(text, NO_TRUNCATION)

    def searched(seen: Column) -> Column:
        cuts = (F.when(_has(seen, word), before_sentence(text, p)) for p, word in zip(CONCLUSORY, _CONCLUSION_HAS, strict=True))
        fallback = let(F.coalesce(*cuts), lambda cut: F.when(cut.isNotNull(), found(rstrip(cut), CONCLUDED)).otherwise(plain))
        markers = F.when(_has(seen, *_MARKER_HAS), F.split(text, _ANY_MARKER, 2))
        return let(markers, lambda parts: F.when(F.size(parts) > 1, found(rstrip(parts[0]), MARKED)).otherwise(fallback))

    return let(_seen(text), searched)


def without_sentences(text: Column, method: Column, sentences: Column) -> Column:
    """struct<text, method>: each leaking sentence removed once, or the text cut before where it begins."""

    def step(state, sentence):
        plain = strip(sentence)
        at = F.position(plain, state["text"])
        removed = F.concat(F.substring(state["text"], F.lit(1), at - 1), F.substring(state["text"], at + F.length(plain), F.length(state["text"])))
        fuzzy = F.position(F.substring(F.lower(sentence), 1, 50), F.lower(state["text"]))
        kept = F.nullif(F.regexp_extract(F.substring(state["text"], F.lit(1), fuzzy - 1), r"(?s)^(.+\.)", 1), F.lit(""))
        exact = (at > 0) & (F.length(plain) > 0)
        cut = ~exact & (fuzzy > 1) & kept.isNotNull()
        return F.when(F.coalesce(F.length(sentence), F.lit(0)) == 0, state).otherwise(
            F.struct(
                F.when(exact, removed).when(cut, rstrip(kept)).otherwise(state["text"]).alias("text"),
                F.when(exact, F.concat(state["method"], F.lit(REMOVED))).when(cut, F.concat(state["method"], F.lit(CUT))).otherwise(state["method"]).alias("method"),
            )
        )

    return F.aggregate(F.coalesce(sentences, F.array().cast("array<string>")), F.struct(text.alias("text"), method.alias("method")), step)


def retention(length: Column, original: Column) -> Column:
    return F.when(original > 0, 100.0 * length / original).otherwise(0.0)


def conclusion_pairs(conclusion: Column) -> Column:
    """array<struct<article, label>> of a conclusion; parts without an article or outcome are dropped."""
    parts = F.transform(F.split(F.coalesce(conclusion, F.lit("")), ";"), strip)
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"(?iU)Article\s+([\dP][\d-]*)", 1).alias("article"),
            F.when(p.rlike(r"(?iU)no\s+violation"), "no_violation").when(p.rlike("(?i)violation"), "violation").alias("label"),
        ),
    )
    return F.filter(pairs, lambda x: (x["article"] != "") & x["label"].isNotNull())


def unfenced(text: Column) -> Column:
    """JSON without the code fence around it."""
    body = F.regexp_replace(strip(text), r"(?s)^```(?:json)?(.*?)(?:```.*)?$", "$1")
    return strip(body)


class _Lines(HTMLParser):
    OPENING = frozenset("p div br h1 h2 h3 h4 h5 h6 li tr".split())
    CLOSING = frozenset("p div h1 h2 h3 h4 h5 h6 li tr table".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.quiet = [], False

    def handle_starttag(self, tag, attrs):
        self.quiet = self.quiet or tag in ("script", "style")
        if tag in self.OPENING:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.quiet = self.quiet and tag not in ("script", "style")
        if tag in self.CLOSING or tag == "td":
            self.out.append("  " if tag == "td" else "\n")

    def handle_data(self, data):
        if not self.quiet:
            self.out.append(data)


def plain_text(page: str | None) -> str | None:
    if page is None:
        return None
    reader = _Lines()
    reader.feed(page)
    few = re.sub(r"\n{3,}", "\n\n", "".join(reader.out))
    return "\n".join(re.sub(r"[ \t]+", " ", line.strip()) for line in few.split("\n")).strip()


def html_text(page: Column) -> Column:
    """HTML as text with its paragraphs; Arrow batches, for no built-in function parses HTML."""

    @F.arrow_udf("string")
    def read(pages):
        import pyarrow as pa

        return pa.array([plain_text(p) for p in pages.to_pylist()], pa.string())

    return read(page)
