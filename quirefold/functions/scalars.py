"""Column functions: sizes, names, numbers, mailbox budgets, matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mailbox profiles (id, message limit, budget of the raw file), decimal megabytes and binary mebibytes.
MB, MIB = 1_000_000, 1_048_576
MIME_OVERHEAD, BODY_RESERVE = 1.3684, 512 * 1024
PROFILES = [("common-25", 25 * MB, 17 * MIB), ("strict-20", 20 * MB, int(13.5 * MIB)), ("gmail-advanced", 25 * MB, 23 * MIB)]
CUSTOM_MIN_MB, CUSTOM_MAX_MB, CUSTOM_DEFAULT_MB = 5, 70, 25
# Canvas quality, target score, first-guess distance.
LOOKS = [(0.66, 63.9, 3.0), (0.72, 68.6, 2.45), (0.76, 72.7, 1.9), (0.8, 75.9, 1.62), (0.82, 78.6, 1.4), (0.85, 85.0, 1.1)]


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def fixed(x: Column, places: int) -> Column:
    """Decimal text of a number of 0 or more with so many places: the nearest by its exact binary value, the larger of two as near.

    Twice the scaled number is taken as a product and what the product lost, so 1.005, which is stored as slightly less, becomes 1.00.
    """
    scale, x = 10**places, x.cast("double")
    low = F.floor(x * float(scale)).cast("long")
    wide = x * 134217729.0  # 2**27 + 1 parts the digits of x in two halves
    head = wide - (wide - x)
    product, middle = x * float(2 * scale), (low * 2 + 1).cast("double")
    lost = (head * float(2 * scale) - product) + (x - head) * float(2 * scale)
    n = low + F.when((product > middle) | ((product == middle) & (lost >= 0)), 1).otherwise(0)
    whole = F.floor(n / scale).cast("long").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((n % scale).cast("string"), places, "0")) if places else n.cast("string")


def format_bytes(n: Column) -> Column:
    """Bytes in decimal units to three digits; the unit is chosen before rounding."""
    k = n / 1000.0
    value = F.when(k < 1000, k).when(k < 1e6, k / 1000.0).otherwise(k / 1000.0 / 1000.0)
    unit = F.when(k < 1000, "KB").when(k < 1e6, "MB").otherwise("GB")
    text = F.when(value >= 100, fixed(value, 0)).when(value >= 10, fixed(value, 1)).otherwise(fixed(value, 2))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(text, F.lit(" "), unit))


def format_duration(ms: Column) -> Column:
    short = F.concat(F.greatest(F.lit(1), js_round(ms)).cast("long").cast("string"), F.lit(" ms"))
    return F.when(ms < 1000, short).otherwise(F.concat(fixed(ms / 1000.0, 1), F.lit(" s")))


def format_size(n: Column) -> Column:
    """As ``format_bytes`` for people: whole KB, MB to one place without a trailing zero, joined by a no-break space."""
    mb = n / 1e6
    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1_000_000, F.concat(F.greatest(F.lit(1), js_round(n / 1000.0)).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.when(mb >= 100, js_round(mb).cast("long").cast("string")).otherwise(F.regexp_replace(fixed(mb, 1), r"\.0$", "")), F.lit(" MB")))
    )


def format_elapsed(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000.0)).cast("long")
    return F.concat(F.floor(s / 60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def percent_lighter(before: Column, after: Column) -> Column:
    return F.when((before <= 0) | (after >= before), 0).otherwise(js_round((1 - after / before) * 100)).cast("int")


def deck_name(file_name: Column) -> Column:
    name = F.trim(F.regexp_replace(file_name, r"(?i)\.pdf$", ""))
    return F.when(name == "", "my deck").otherwise(name)


def email_version_name(file_name: Column, part: Column | None = None, parts: Column | None = None) -> Column:
    """A safe file name for the lighter copy, numbered if it is one of several."""
    stem = F.regexp_replace(file_name, r"(?i)\.pdf$", "")
    stem = F.trim(F.regexp_replace(F.regexp_replace(stem, r'[\\/:*?"<>|]+', "-"), r"\s+", " "))
    stem = F.when(stem == "", "deck").otherwise(stem)
    if part is None:
        return F.concat(stem, F.lit("-email.pdf"))
    padded = lambda x: F.when(F.length(x.cast("string")) < 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat(stem, F.lit("-part-"), padded(part), F.lit("-of-"), padded(parts), F.lit(".pdf"))


def message_bytes(raw: Column) -> Column:
    """A message's size with the raw file attached."""
    return F.ceil(raw * MIME_OVERHEAD + float(BODY_RESERVE)).cast("long")


def custom_limit(mb: Column) -> Column:
    """Message limit in bytes of a mailbox of so many megabytes, held within what makes sense."""
    x = F.when(mb.isNull() | F.isnan(mb.cast("double")) | (F.abs(mb.cast("double")) == float("inf")), float(CUSTOM_DEFAULT_MB)).otherwise(mb.cast("double"))
    return js_round(F.least(F.lit(float(CUSTOM_MAX_MB)), F.greatest(F.lit(float(CUSTOM_MIN_MB)), x)) * MB).cast("long")


def custom_budget(mb: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((custom_limit(mb) - BODY_RESERVE) / MIME_OVERHEAD)).cast("long")


def ref_number(ref: Column) -> Column:
    """Object number of a reference such as ``12 0 R``; null for anything else."""
    return F.when(ref.rlike(r"^\d+ \d+ R$"), F.regexp_extract(ref, r"^(\d+)", 1).cast("long"))


def decode_pdf_string(s: Column) -> Column:
    """``u:`` text as it stands, ``b:`` hexadecimal as Latin-1; null for anything else."""
    hexed = F.substring(s, 3, 1 << 30)
    even = F.substring(hexed, F.lit(1), F.length(hexed) - F.length(hexed) % 2)
    return F.when(s.startswith("u:"), hexed).when(s.startswith("b:"), F.decode(F.unhex(even), "ISO-8859-1"))


def multiply(m: Column, n: Column) -> Column:
    """Product of two affine matrices, structs of a to f."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"),
        (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"),
        (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"),
        (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def matrix_scale(m: Column) -> Column:
    """Largest singular value."""
    s = m["a"] * m["a"] + m["b"] * m["b"] + m["c"] * m["c"] + m["d"] * m["d"]
    det = m["a"] * m["d"] - m["b"] * m["c"]
    return F.sqrt((s + F.sqrt(F.greatest(F.lit(0.0), s * s - 4 * det * det))) / 2)


def path_decimals(pixels: Column) -> Column:
    """Places that keep a coordinate within a tenth of a pixel; null where six are not enough."""
    d = F.greatest(F.lit(0), F.ceil(F.log10(pixels * 0.5 / 0.1))).cast("int")
    return F.when(d <= 6, d)


def looks_target(quality: Column) -> Column:
    """Target score for a canvas quality, straight lines between the table's rows."""
    return _between(quality, 1, log=False)


def looks_distance(quality: Column) -> Column:
    """First-guess distance, straight lines between the logarithms of the table's rows."""
    return _between(quality, 2, log=True)


def _between(q: Column, at: int, log: bool) -> Column:
    out = F.when(q <= LOOKS[0][0], LOOKS[0][at])
    for low, high in zip(LOOKS, LOOKS[1:], strict=False):
        t = (q - low[0]) / (high[0] - low[0])
        line = F.exp(F.log(F.lit(low[at])) + t * (F.log(F.lit(high[at])) - F.log(F.lit(low[at])))) if log else low[at] + t * (high[at] - low[at])
        out = out.when(q <= high[0], line)
    return out.otherwise(LOOKS[-1][at])


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)


def error_code(message: Column) -> Column:
    return F.when(message.rlike(r"(?i)RangeError|out of memory|\bOOM\b|Array buffer allocation|Cannot enlarge memory"), "too-big").otherwise("engine")


def magic_within(content: Column, magic: bytes = b"%PDF-", last_offset: int = 1024) -> Column:
    """Whether the bytes start at an offset of at most ``last_offset``."""
    head = F.substring(content, 1, last_offset + len(magic))
    return F.coalesce(F.instr(F.hex(head), magic.hex().upper()) > 0, F.lit(False)) & _aligned(head, magic)


def _aligned(head: Column, magic: bytes) -> Column:
    """Guards against a hexadecimal match between two bytes."""
    return F.contains(head, F.lit(bytearray(magic)))


def positive(x: Column) -> Column:
    """The number where it is above 0, else null."""
    return F.when(x > 0, x)


def weights_for(deck: Column, limit: Column, budget: Column) -> Column:
    """What a deck weighs: itself, the message it makes, the mailbox's limit, and the raw budget."""
    return F.struct(deck.alias("deck"), message_bytes(deck).alias("email"), limit.alias("limit"), budget.alias("budget"))


def id_arguments(encrypted: Column) -> Column:
    """Options of a rewrite that give the same file each time; an encrypted file's id must stay."""
    return F.when(encrypted, F.array().cast("array<string>")).otherwise(F.array(F.lit("--deterministic-id")))


def encoder_settings(quality: Column, distance: Column | None = None) -> Column:
    """Settings for a canvas quality: the given distance or the table's, with halved colour and progressive scans."""
    at = looks_distance(quality) if distance is None else F.coalesce(distance, looks_distance(quality))
    return F.struct(at.alias("distance"), F.lit(True).alias("subsample420"), F.lit(True).alias("progressive"))


def name_list(value: Column) -> Column:
    """A VARIANT that is one name or a list of them, as an array of names; what is no name is left out."""
    one, many = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "array<variant>")
    names = F.filter(F.transform(many, lambda v: F.try_variant_get(v, "$", "string")), lambda x: x.isNotNull() & (x != ""))
    return F.when(many.isNotNull(), names).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
