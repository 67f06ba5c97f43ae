"""Personal data in text: patterns propose spans, checksums confirm them, context words move scores.

Kinds: email, ip, card, phone (always reported when valid), then iban and ssn (reported at a score of
0.5 or more). Cards pass Luhn, IBANs pass mod 97, address parts are at most 255. Offsets count code
points, ends are exclusive. Column expressions only.

Defined results: a null text is an empty text and has no span. Repeated rows stay repeated. Extra
columns are kept; a column named like an output is replaced. An empty table gives no row. Work is near linear in the length
of a text and in its spans: quantifiers are possessive and a failed run is not entered again, offsets are summed in
chunks, and pieces are cut from blocks of BLOCK characters, as cutting from a text counts its characters from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folded, let, packed, unpacked

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Lengths of account numbers by country (89 countries). Fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

# Run starts: a match cannot begin inside a run that was already tried, save right after a match (\G).
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A chain of digits is one match; chains of another length than 12 to 19 digits fail and are passed over whole.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?:"
    + "|".join(rf"{c}[0-9]{{2}}(?:\x20?+[0-9A-Z]){{{n - 4}}}+" for c, n in IBAN_LENGTHS.items())
    + r")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
# A test that is cheap and true wherever the kind can occur.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[0-9A-Z]{4}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|client",
    "card": "card|credit|debit|visa|mastercard|amex|payment|cvv",
    "phone": "phone|call|tel|mobile|cell|fax|contact",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
    "ssn": "ssn|social security|tax id|taxpayer",
}
REACH = 40
BLOCK = 1024
BOOST = 0.3
THRESHOLD = 0.5

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    s = F.translate(iban, " ", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def add(acc, c):
        digit = c.between("0", "9")
        v = F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(digit, 10).otherwise(100) + v) % 97

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: m.rlike(rf"^{part}\.{part}\.{part}\.{part}$"),
        "card": lambda: luhn(F.regexp_replace(m, "[^0-9]", "")),
        "phone": lambda: digits.between(9, 15),
        "iban": lambda: mod97(m),
        "ssn": lambda: F.lit(True),
    }[kind]()


def _proposed(text: Column, kind: str) -> Column:
    """Valid spans of a kind, by start. Each find begins where the last one ended (\\G), takes the gap
    lazily, then the pattern; lengths of gaps and matches add up to offsets."""
    pattern = rf"\G(?s)(.*?)({PATTERNS[kind]})"
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), 1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("hit")
    )
    rank = F.lit(KINDS.index(kind))

    def span(at, x):
        start = at + F.length(x["gap"])
        s = F.struct(start.alias("start"), rank.alias("rank"), (start + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("value"))
        return F.when(_valid(kind, x["hit"]), s)

    both = folded(pairs, F.lit(0).cast("long"), lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long"), lambda a, b: a + b, span)
    found = F.filter(both, lambda s: s.isNotNull()).cast(SPAN)
    return F.when(HINTS[kind](text), found).otherwise(F.array().cast(SPAN))


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK characters; a short one is one block."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0))


def _piece(blocks: Column, start: Column, size: Column) -> Column:
    """``size`` characters from the 0-based place ``start`` on."""
    i = F.floor(start / BLOCK).cast("int")
    n = F.floor((start + size) / BLOCK).cast("int") - i + 1
    return F.substring(F.array_join(F.slice(blocks, i + 1, n), ""), (start - i * BLOCK + 1).cast("int"), size.cast("int"))


def find_spans(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with ``out``: array of (start, rank, end, kind, value, score) by start, then kind."""
    kept = [c for c in df.columns if c != out]
    d = packed(df, text=F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("text")
    d = d.withColumns({f"_{k}": _proposed(text, k) for k in KINDS})
    spans = F.sort_array(F.concat(*(F.col(f"_{k}") for k in KINDS)))

    def scored(blocks):
        def score(s):
            before = F.greatest(s["start"] - REACH, F.lit(0).cast("long"))
            near = F.lower(F.concat(_piece(blocks, before, s["start"] - before), F.lit("\n"), _piece(blocks, s["end"], F.lit(REACH).cast("long"))))
            base, ctx = F.lit(0.0), F.lit(False)
            for k in KINDS:
                base = F.when(s["kind"] == k, F.lit(SCORES[k])).otherwise(base)
                ctx = F.when(s["kind"] == k, near.rlike(rf"(?<![\p{{L}}])(?:{CONTEXT[k]})")).otherwise(ctx)
            return s.withField("score", F.least(F.lit(1.0), base + F.when(ctx, F.lit(BOOST)).otherwise(F.lit(0.0))))

        return score

    d = d.withColumn("_all", spans)
    none = F.transform("_all", lambda s: s.withField("score", F.lit(0.0)))
    d = d.withColumn("_spans", F.when(F.size("_all") > 0, let(_blocks(text), lambda b: F.transform("_all", scored(b)))).otherwise(none))
    found = F.filter("_spans", lambda s: (s["rank"] < len(BASE)) | (s["score"] >= THRESHOLD))
    return d.select(*unpacked(kept), found.alias(out))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_text(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of its first kind in brackets."""

    def whole(blocks):
        def step(at, s):
            """What stands between the furthest end so far and a span, and its kind; nothing for one that overlaps."""
            new = F.concat(_piece(blocks, at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] >= at, new).otherwise(F.lit(""))

        parts = folded(spans, F.lit(0).cast("long"), lambda s: s["end"], lambda a, b: F.greatest(a, b), step)
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), _piece(blocks, last, F.length(text) - last))

    return F.when(F.size(spans) == 0, text).otherwise(let(_blocks(text), whole))


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` masked and ``n_chars``, if there, counted anew; a null text stays null."""
    d = find_spans(packed(df, text=F.col(text_col)))
    d = d.withColumn("masked", F.when(F.col("text").isNotNull(), mask_text(F.col("text"), F.col("spans"))))
    new = {text_col: F.col("masked")}
    if "n_chars" in df.columns and text_col == "text":
        new["n_chars"] = F.length("masked").cast(df.schema["n_chars"].dataType)
    return d.select(unpacked(df.columns, **new))
