"""Text functions as Column expressions: tokens, term quality, edit distance, caps, labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.porter import stems

# Words that carry no topic.
STOPWORDS = """
the a an and or but if then else of to in on at for with from by as is are was were be been being this that these those it its
do does did can could should would will shall may might must not no yes ok okay i you we they he she him her his our your their
what which who whom how why when where here there please let lets just only also more most some any all every each other than too
very much many few need want make made sure able part flow doing something thing things get got use used using update updated add
added fix fixed change changed check checked look looking go going know think see say
""".split()

#: Code points above ASCII whose letter without its marks is ASCII, found by decomposition.
_FOLD = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] in "abcdefghijklmnopqrstuvwxyz"}


def strip_marks(lowered: Column) -> Column:
    """Lower-case Latin letters without their diacritics."""
    return F.translate(lowered, "".join(_FOLD), "".join(_FOLD.values()))


def tokens(text: Column) -> Column:
    """Index tokens: lower case, no diacritics, split at everything that is not a letter or a digit. Not stemmed."""
    return F.regexp_extract_all(strip_marks(F.lower(text)), F.lit(r"[\p{L}\p{N}\p{Co}]+"), 0)


def index_tokens(text: Column) -> Column:
    """``tokens``, stemmed: what search, recall and related use unless told otherwise."""
    return stems(tokens(text))


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; the tokenizer that any SQL engine can repeat."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def bind(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dedupe_first(xs: Column) -> Column:
    """Elements whose lower-case form did not appear before, first casing kept. Sorts, so long arrays cost n log n."""
    by_form = F.sort_array(F.transform(xs, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))

    def first(s: Column) -> Column:
        kept = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["low"] != x["low"]))
        return F.transform(F.sort_array(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda y: y["x"])

    return bind(by_form, first)


def is_identifier_like(t: Column, extra: str = "") -> Column:
    caps = (F.length(t) >= 2) & t.rlike("[A-Z]") & ~t.rlike("[a-z]")
    return t.rlike(f"[0-9_{extra}-]") | caps


def is_distinctive(t: Column) -> Column:
    """An identifier (digit, _ or -, or capitals only) or a word of four or more bytes, and no stopword."""
    return ((F.octet_length(t) >= 4) | is_identifier_like(t)) & ~F.lower(t).isin(STOPWORDS)


def is_identifier(t: Column) -> Column:
    return is_identifier_like(t, ".")


def is_anchor(t: Column) -> Column:
    """An identifier, or six or more characters."""
    return is_identifier(t) | (F.length(t) >= 6)


def words(text: Column) -> Column:
    """Runs of letters, digits, points, _ and - as they come."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9._-]*"), 0)


def distinctive_words(text: Column) -> Column:
    """Distinctive terms as they come, repeats included."""
    return F.filter(words(text), is_distinctive)


def extract_terms(text: Column) -> Column:
    """Distinctive terms in order of first appearance, one per lower-case form, first casing kept."""
    return dedupe_first(distinctive_words(text))


def turn_tokens(lowered: Column) -> Column:
    """Parts between characters other than letters, numbers, _ and -."""
    return F.filter(F.split(lowered, r"[^\p{IsAlphabetic}\p{N}_-]+"), lambda x: x != "")


def token_matches(a: Column, b: Column) -> Column:
    """Equal, or one begins with the other."""
    return a.startswith(b) | b.startswith(a)


def token_matches_loose(a: Column, b: Column) -> Column:
    """``token_matches`` with _ and . read as -."""
    return token_matches(F.translate(a, "_.", "--"), F.translate(b, "_.", "--"))


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one substitution, insertion, deletion or swap of neighbours."""
    n = F.length(a)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    i, j = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    swap = (F.size(at) == 2) & (j == i + 1) & (F.substring(a, i, 1) == F.substring(b, j, 1)) & (F.substring(a, j, 1) == F.substring(b, i, 1))
    near = F.levenshtein(a, b, 2)
    return near.between(0, 1) | ((n == F.length(b)) & (near == 2) & F.coalesce(swap, F.lit(False)))


def trigrams(term: Column, cap: int = 24) -> Column:
    """Distinct character trigrams in order of first appearance."""
    n = F.length(term)
    all3 = F.when(n < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(term, i, 3)))
    return F.slice(F.array_distinct(all3), 1, cap)


def cap(x: Column, n: int) -> Column:
    """The first ``n`` characters, and an ellipsis if there were more."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def hook_cap(x: Column, n: int = 240) -> Column:
    """At most ``n`` characters, the ellipsis included."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def first_line(x: Column, n: int = 160) -> Column:
    """First line with a letter or digit, else first line that is not blank, trimmed and capped."""
    lines = F.transform(F.split(x, "\n"), lambda s: F.trim(s))
    word = F.get(F.filter(lines, lambda s: s.rlike(r"[\p{IsAlphabetic}\p{N}]")), F.lit(0))
    solid = F.get(F.filter(lines, lambda s: s != ""), F.lit(0))
    return cap(F.coalesce(word, solid, F.lit("")), n)


def sid8(x: Column) -> Column:
    return F.substring(x, 1, 8)


def date10(x: Column) -> Column:
    return F.substring(x, 1, 10)


def fmt_ts(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("?")).otherwise(F.replace(F.substring(x, 1, 16), F.lit("T"), F.lit(" ")))


def age_bucket(days: Column) -> Column:
    """Whole days to today, Nd, Nw, Nmo or Ny."""
    d = F.greatest(days.cast("long"), F.lit(0).cast("long"))
    text = lambda q, unit: F.concat(F.floor(d / q).cast("string"), F.lit(unit))
    return F.when(d < 1, F.lit("today")).when(d < 7, text(1, "d")).when(d < 30, text(7, "w")).when(d < 365, text(30, "mo")).otherwise(text(365, "y"))


def project_key(cwd: Column) -> Column:
    """A working directory as a project name: every character but letters and digits becomes -."""
    return F.regexp_replace(cwd, "[^A-Za-z0-9]", "-")


def git_slug(url: Column) -> Column:
    """owner/repo of an https or scp-like address, without .git; null for others."""
    s = F.regexp_extract(url, r"^(?:[a-z+]+://(?:[^/@]*@)?[^/]+/|[^@/]+@[^:/]+:)([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.when(s != "", s)


def human(n: Column) -> Column:
    """1234567 as 1.2M."""
    v = n.cast("double")
    one = lambda q, u: F.concat(F.format_string("%.1f", v / q), F.lit(u))
    a = F.abs(v)
    return F.when(a >= 1e12, one(1e12, "T")).when(a >= 1e9, one(1e9, "B")).when(a >= 1e6, one(1e6, "M")).when(a >= 1e3, one(1e3, "K")).otherwise(n.cast("string"))


def human_bytes(n: Column, space: bool = False) -> Column:
    """1500000 as 1.5MB (or 1.5 MB), 2000 as 2KB; digits as the binary quotient rounds, ties to even."""
    gap = " " if space else ""

    def one(w: Column, unit: str) -> Column:
        q = w / 1000.0
        # On a tie of the decimal digits the quotient lies a little below or above it, or on it: w - 1000 q tells, in two exact parts.
        high = F.floor(q * 1048576.0).cast("double") / 1048576.0
        off = (w - high * 1000.0) - (q - high) * 1000.0
        down = (w % 100 == 50) & ((off > 0) | ((off == 0) & (F.floor(w / 100) % 2 == 0)))
        return F.concat(F.regexp_replace(F.format_string("%.1f", q - F.when(down, 0.01).otherwise(0.0)), r"\.0$", ""), F.lit(gap + unit))

    v = n.cast("double")
    small = F.concat(n.cast("string"), F.lit(gap + "B"))
    return F.when(v >= 1e12, one(v / 1e9, "TB")).when(v >= 1e9, one(v / 1e6, "GB")).when(v >= 1e6, one(v / 1e3, "MB")).when(v >= 1e3, one(v, "KB")).otherwise(small)


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


# Directory names that tell nothing about a project.
CONTAINERS = ("users", "home", "desktop", "downloads", "documents", "library", "mobile documents", "com~apple~clouddocs", "clouddocs", "icloud", "git", "src", "code", "projects", "repos", "work", "dev", "claude", "github.com", "bitbucket.org", "gitlab.com")


def project_label(key: Column, cwd: Column, home: str = "") -> Column:
    """The last two telling parts of the directory, else of the key split at -, else the key or ?."""
    dull = [*CONTAINERS, home.lower()]
    two = lambda xs: F.array_join(F.slice(xs, F.greatest(F.size(xs) - 1, F.lit(1)), 2), "/")
    parts = F.filter(F.split(cwd, "/"), lambda x: ~x.isin("", "."))
    telling = F.filter(parts, lambda x: ~F.lower(x).isin(dull))
    from_key = F.filter(F.split(key, "-"), lambda x: (x != "") & ~F.lower(x).isin(dull))
    bare = F.when(key == "", F.lit("?")).otherwise(key)
    by_dir = F.when(F.size(telling) > 0, two(telling)).when(F.size(parts) > 0, F.try_element_at(parts, F.lit(-1))).otherwise(bare)
    return F.when(cwd.isNotNull(), by_dir).when(F.size(from_key) > 0, two(from_key)).otherwise(bare)
