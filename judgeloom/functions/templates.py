"""Prompts, messages and request parameters; placeholder replacement."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Article titles, one table for all stages.
ARTICLE_TITLES = {
    "1": "Protection of property", "2": "Right to life", "3": "Prohibition of torture", "5": "Right to liberty and security", "6": "Right to a fair trial",
    "7": "No punishment without law", "8": "Right to respect for private and family life", "9": "Freedom of thought, conscience and religion", "10": "Freedom of expression",
    "11": "Freedom of assembly and association", "13": "Right to an effective remedy", "14": "Prohibition of discrimination", "34": "Individual applications",
    "41": "Just satisfaction", "P1-1": "Protection of property",
}
FRAMINGS = ("predictive", "normative", "factual")
_ASK = {"predictive": "will the court find", "normative": "should the court find", "factual": "was there"}
SYSTEM = "You advise on human-rights cases."
#: One template a framing, with the slots {case_text}, {article} and {article_title}; replace them with your own.
TEMPLATES = {f: "Facts:\n\n{case_text}\n\nOn a scale from 1 (certainly) to 5 (certainly not): " + ask + " a violation of Article {article} - {article_title}? Answer with the number alone." for f, ask in _ASK.items()}


def title(article: Column, default: str = "Article ") -> Column:
    known = F.create_map(*(F.lit(x) for kv in ARTICLE_TITLES.items() for x in kv))
    return F.coalesce(known[article], F.concat(F.lit(default), article))


def rendered(template: str, **slots: Column) -> Column:
    """A template with its slots filled; text is never read as a format."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(slots[p], F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def by_framing(framing: Column, text: Column, article: Column) -> Column:
    out = F.lit(None).cast("string")
    for f, t in TEMPLATES.items():
        out = F.when(framing == f, rendered(t, case_text=text, article=article, article_title=title(article))).otherwise(out)
    return out


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: Column, user: Column, model: Column) -> Column:
    """System and user turns; models without a system turn get both in one."""
    joined = F.array(_message("user", F.concat_ws("\n\n", system, user)))
    return F.when(F.lower(model).contains("gemini"), joined).otherwise(F.array(_message("system", system), _message("user", user)))


def conversation(system: Column, turns: Column, model: Column) -> Column:
    """Turns (array of role and content) with the system text: in front, or inside the first user turn."""
    roles = F.transform(turns, lambda t: t["role"])
    first = F.array_position(roles, F.lit("user"))
    merged = F.transform(turns, lambda t, i: F.when(i + 1 == first, _message("user", F.concat_ws("\n\n", system, t["content"]))).otherwise(F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    return F.when(F.lower(model).contains("gemini"), merged).otherwise(F.concat(F.array(_message("system", system)), F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))))


def parameters(model: Column, temperature: float = 1.0, max_tokens: int = 100) -> Column:
    """Request parameters by model family; null where a family takes none."""
    low = F.lower(model)
    five, gemini = low.contains("gpt-5"), low.contains("gemini")
    return F.struct(
        F.when(~five, F.lit(float(temperature))).alias("temperature"),
        F.when(gemini, 4096).when(~five, max_tokens).alias("max_tokens"),
        F.when(five, 2048).alias("max_completion_tokens"),
        F.when(five, "low").alias("reasoning_effort"),
    )


def custom_id(*parts: Column | str) -> Column:
    return F.concat_ws("_", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def file_key(stem: Column, prefix: str = "") -> Column:
    """A file's stem as a key."""
    return F.translate(F.regexp_replace(stem, "^" + re.escape(prefix), ""), ".-/", "___")


def bare_model(model: Column) -> Column:
    return F.element_at(F.split(model, "/"), -1)


def is_error(response: Column) -> Column:
    return F.coalesce(response.startswith("ERROR:") | (response == ""), F.lit(True))


def check_conflicts(keys: list[str], strategies: dict) -> None:
    """Raise if two of the named strategies define one placeholder."""
    owner: dict[str, str] = {}
    for key in keys:
        for placeholder in [*strategies[key].get("replacements", {}), *strategies[key].get("complex_replacements", {})]:
            if placeholder in owner:
                raise ValueError(f"placeholder {placeholder!r} belongs to both {owner[placeholder]!r} and {key!r}")
            owner[placeholder] = key


def replaced(text: Column, keys: list[str], strategies: dict) -> Column:
    """Placeholders by the named strategies: plain ones longest first, then pronouns by context."""
    plain: dict[str, str] = {}
    contextual: dict[str, dict] = {}
    for key in keys:
        plain |= strategies[key].get("replacements", {})
        contextual |= strategies[key].get("complex_replacements", {})
    for placeholder in sorted(plain, key=len, reverse=True):
        text = F.replace(text, F.lit(placeholder), F.lit(plain[placeholder]))
    for placeholder, rule in contextual.items():
        if rule["type"] == "contextual_pronoun":
            verbs = "|".join(rule["object_verbs"])
            text = F.regexp_replace(text, rf"(?iu)({verbs})(?U:\s+)\Q{placeholder}\E", "$1 " + re.sub(r"([\\$])", r"\\\1", rule["object"]))
            subject = rule["subject"].capitalize() if placeholder[:1].isupper() else rule["subject"]
            text = F.replace(text, F.lit(placeholder), F.lit(subject))
    return text


def percent_text(value: Column, signed: bool = False) -> Column:
    """A share as percent with one place, rounded as its exact binary value says (ties to even); dashes for null and NaN.

    Ten times a double is eight and two times it; what their sum loses is known exactly and settles a tie."""
    x = F.abs(value.cast("double") * 100)
    s = x * 8 + x * 2
    lost = x * 2 - (s - x * 8)
    whole = F.floor(s)
    part = s - whole
    up = (part > 0.5) | ((part == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    tenths = whole + up.cast("long")
    minus = F.when(value < 0, "-").otherwise("+" if signed else "")
    text = F.concat(minus, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(value.isNull() | F.isnan(value.cast("double")), "--").otherwise(text)
