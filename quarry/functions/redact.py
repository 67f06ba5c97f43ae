"""Masking of secrets by five ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import bind

# Fixed values. In order: later rules see what earlier ones left. Word boundaries are ASCII, word
# characters and white space Unicode, and a line ends at \n only.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
RULES = (
    ("private-key", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "‹redacted-private-key›"),
    ("aws-key", r"(?U)(?:AKIA|ASIA)[0-9A-Z]{16}\b", "‹redacted-aws-key›"),
    ("bearer", r"(?iU)\bbearer\s+[A-Za-z0-9._\-]{20,}", "Bearer ‹redacted›"),
    ("passphrase", rf"(?iUd){_EDGE}(\w*pass_?phrase){_EDGE}([^\S\n]*[=:][^\S\n]*)(.+)", "$1$2‹redacted›"),
    ("labeled-secret", rf"(?iU){_EDGE}(\w*(?:password|passwd|pwd|secret|token|api[_-]?key|mysql_pwd|access[_-]?key)){_EDGE}(\s*[=:]\s*)(\S+)", "$1$2‹redacted›"),
)

#: True wherever the rule can match.
HINTS = {
    "private-key": "PRIVATE KEY-----",
    "aws-key": "AKIA|ASIA",
    "bearer": "(?iu)bearer",
    "passphrase": "(?iu)pass_?phrase",
    "labeled-secret": "(?iu)password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key",
}


def redact(text: Column) -> Column:
    """The text with every secret masked. A rule runs only where a cheap test says that it may apply."""
    for name, pattern, new in RULES:
        text = bind(text, _step(HINTS[name], pattern, new))
    return text


def _step(hint: str, pattern: str, new: str):
    return lambda t: F.when(t.rlike(hint), F.regexp_replace(t, pattern, new)).otherwise(t)


def flagged(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``redacted`` and a flag per rule, each tested on what the earlier rules left."""
    d = df.withColumn("redacted", F.col(text_col))
    for name, pattern, new in RULES:
        flag = f"hit_{name.replace('-', '_')}"
        d = d.withColumn(flag, F.coalesce(F.col("redacted").rlike(pattern), F.lit(False)))
        d = d.withColumn("redacted", F.when(F.col(flag), F.regexp_replace("redacted", pattern, new)).otherwise(F.col("redacted")))
    return d


def report(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per rule: rows in which it applies; ``any`` counts rows that change."""
    d = flagged(df, text_col)
    sums = [F.count_if(F.col(f"hit_{n.replace('-', '_')}")).alias(n) for n, _, _ in RULES]
    one = d.agg(*sums, F.count_if(~F.col("redacted").eqNullSafe(F.col(text_col))).alias("any"))
    names = [*(n for n, _, _ in RULES), "any"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n_rows")) for n in names])).alias("x")).select("x.rule", "x.n_rows")


def by_session(df: DataFrame, session_col: str = "session_id", text_col: str = "text") -> DataFrame:
    """(session, n_changed): texts that masking changes. What a generator gives is not computed again by a filter on it."""
    d = df.select(session_col, text_col, F.explode(F.array(redact(F.col(text_col)))).alias("_r"))
    return d.where(~F.col("_r").eqNullSafe(F.col(text_col))).groupBy(session_col).agg(F.count(F.lit(1)).alias("n_changed"))
