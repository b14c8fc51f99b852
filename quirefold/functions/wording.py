"""Column functions that turn sizes, messages and stages into words or classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.scalars import format_size

# What an error's text says about its kind, the first that matches; and the kinds there are.
ERROR_PATTERNS = [
    ("not-pdf", r"does not look like a pdf|not a pdf|choose a pdf"),
    ("password", r"password"),
    ("restricted", r"restrict|permission"),
    ("protected", r"protected|flatten"),
    ("page-too-large", r"page \d+ is too large"),
    ("timeout", r"too long|timed out|timeout"),
    ("too-big", r"memory budget|too large for"),
    ("read", r"could not be read|couldn.t read"),
    ("engine", r"engine|worker"),
]
ERROR_KINDS = [*(kind for kind, _ in ERROR_PATTERNS), "unknown"]
# From how many milliseconds on a longer wait has words of its own.
WAITS_MS = [0, 25_000, 75_000, 150_000, 300_000, 600_000]
# Numbers that are written out.
NUMBER_WORDS = ["none", "one", "two", "three", "four", "five", "six"]
COMMENTED_STAGES = ["read", "tidy", "photos", "verify", "split", "flatten"]


def error_kind(message: Column, code: Column) -> Column:
    """The code where it is a known kind, else what the message says."""
    text, out = F.lower(message), F.when(code.isin(ERROR_KINDS), code)
    for kind, pattern in ERROR_PATTERNS:
        out = out.when(text.rlike(pattern), kind)
    return out.otherwise("unknown")


def commentary_key(stage: Column) -> Column:
    return F.when(stage.isin(COMMENTED_STAGES), stage).when(stage.isin("resize", "sharpen"), "photos").otherwise("any")


def wait_step(elapsed_ms: Column) -> Column:
    """Which of the waits has begun last, from 0; the first before any."""
    return F.greatest(F.lit(0), F.size(F.filter(F.array(*map(F.lit, WAITS_MS)), lambda x: elapsed_ms >= x)) - 1)


def mailbox_name(profile: Column, limit: Column) -> Column:
    """A mailbox with its article: numbers that are said with a vowel first take *an*."""
    size = format_size(limit)
    article = F.when(size.rlike(r"^(8|1[18](?!\d))"), "an").otherwise("a")
    named = F.concat_ws(" ", article, size, F.when(profile == "custom", "limit").otherwise("mailbox"))
    return F.when(profile == "gmail-advanced", "Gmail to Gmail").otherwise(named)


def weigh_in(deck: Column, limit: Column, budget: Column, conditional: Column) -> Column:
    return F.when(deck <= budget, "fits").when(~conditional & (deck < limit), "looks-like-it-fits").otherwise("over")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def number_word(n: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, NUMBER_WORDS)), n.cast("int")), n.cast("string"))


def listed(items: Column) -> Column:
    """Items joined by commas, the last by *and*."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.lit(1), F.size(items) - 1)), ", ")
    return F.when(F.size(items) < 3, F.array_join(items, " and ")).otherwise(F.concat_ws(" and ", head, F.element_at(items, -1)))


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def inline(text: Column) -> Column:
    """The same with ``**words**`` made strong."""
    return F.regexp_replace(escaped(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
