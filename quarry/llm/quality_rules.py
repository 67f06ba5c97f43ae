"""Quality rules as a bitmask ledger.

Every rule runs once per document. The ledger keeps one bit per failed rule and the measurements
behind it; a policy is a versioned mask over those bits, so trying another policy, or asking what one
rule alone rejects, needs no second look at any text. Column expressions only.

Defined results: a null or blank text has no words and fails ``few_words``. Repeated rows stay
repeated. Extra columns of the input are kept unless they carry the name of a ledger column, in which
case the ledger's replaces them. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Rule names in bit order; a released rule never changes its bit.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals")

BASE = ("few_words", "repeated_words")

#: Policy versions: the rules that reject.
POLICIES = {"base": BASE, "v1": RULES}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def mask(names) -> int:
    return sum(1 << RULES.index(n) for n in names)


def repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in ``w``.

    Where all hashes of windows differ nothing is repeated. Else the windows are sorted by hash and position, so equal ones are
    neighbours, and neighbours of one hash are compared word by word; the positions of equal ones are sorted again and each adds the
    words up to the next one, three at most. O(n log n) per text.
    """
    n = F.size(w)
    none = F.lit(0).cast("long")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(hs: Column) -> Column:
        wins = F.transform(hs, lambda g, i: F.struct(g.alias("g"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(_covered(F.sort_array(wins), w))

    return F.when(n < 4, none).otherwise(let(hashes, covered))


def _covered(wins: Column, w: Column) -> Column:
    def hits(s: Column) -> Column:
        n = F.size(s)

        def same(i, j):
            a, b = F.get(s, i), F.get(s, j)
            words = [F.get(w, a["p"] + k) == F.get(w, b["p"] + k) for k in range(3)]
            return (a["g"] == b["g"]) & words[0] & words[1] & words[2]

        twice = lambda i: ((i > 0) & same(i, i - 1)) | ((i + 1 < n) & same(i, i + 1))
        at = F.filter(F.sequence(F.lit(0), n - 1), twice)
        return F.sort_array(F.transform(at, lambda i: F.get(s, i)["p"]))

    def length(p: Column) -> Column:
        n = F.size(p)
        return F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0).cast("long"),
            lambda acc, i: acc + F.when(i == n, F.lit(3)).otherwise(F.least(F.lit(3), F.get(p, i) - F.get(p, i - 1))).cast("long"),
        )

    return let(let(wins, hits), lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(length(p)))


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measurements and ``failed`` (long), bit i set where RULES[i] fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # With the words as an array column below, each measurement reads text or array once.
    df = df.drop(*(c for c in df.columns if c in (*MEASURES, "failed", "_w", "_ln") and c != text_col))
    d = df.withColumn("_w", words(text)).withColumn(
        "_ln", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09\x0B-\x0D]"))
    )
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_ln") - F.size(F.array_distinct("_ln"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_w")),
            "n_lines": F.size("_ln").cast("long"),
            "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
            "n_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long"),
        }
    ).drop("_w", "_ln")
    c = F.col
    tests = {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "capitals": 100 * c("n_upper") > 50 * c("n_letters"),
    }
    bits = F.lit(0).cast("long")
    for i, name in enumerate(RULES):
        bits = bits + F.when(tests[name], F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return d.withColumn("failed", bits)


def passes(policy: str = "v1") -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def sole_rule(policy: str = "v1") -> Column:
    """The rule of a policy that alone rejects a document, which would stay without it; null where none or several do."""
    bits = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    out = F.lit(None).cast("string")
    for r in POLICIES[policy]:
        out = F.when(bits == 1 << RULES.index(r), F.lit(r)).otherwise(out)
    return out


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    Equal bit patterns are counted first (at most 2 ** len(RULES) rows), then read bit by bit.
    """
    m = mask(POLICIES[policy])
    pats = led.groupBy(F.col("failed").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    return (
        pats.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def filter_documents(df: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows that pass a policy, with their own columns.

    A filter on a computed column is pushed below the projection that computes it, which would write every
    measurement out again inside the next; it does not pass a generator, so one stands between.
    """
    led = ledger(df.withColumn("_keep", F.struct("*")))
    judged = led.select(F.explode(F.array(F.struct("failed", "_keep"))).alias("_x")).select("_x.failed", "_x._keep")
    return judged.where(passes(policy)).select("_keep.*")
