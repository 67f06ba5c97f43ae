"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_quotes, collocations, hard_negatives, line_dedup, packing, pii, pu_classifier, quality_rules, simhash_dedup, sp_wfst, url_templates, vector_dedup, wavelet
from .common import Scratch, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    d = pii.find_spans(docs)
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", lambda s: F.round(100 * s["score"]).cast("int").cast("string")), ",").alias("scores"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id",
        *quality_rules.MEASURES,
        "failed",
        (~quality_rules.passes("base")).alias("base_failed"),
        quality_rules.passes("v1").alias("kept"),
        quality_rules.sole_rule("v1").alias("sole_rule"),
    )


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine; only queries ask, operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.formatted(chat_quotes.link(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", simhash_dedup.hexed("fp").alias("fingerprint"), "component_id")


def op8_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_wfst.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_classifier.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return url_templates.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), labels)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    e = e.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    e = e.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"),
    )
    return hard_negatives.mine(e, F.col("vec_id") % 100 == 0)


def op13_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = Scratch(spark, "token-files").base
    shards = wavelet.write(docs, folder, vocabulary("word_bpe_49k.json"))
    return wavelet.documents(shards, folder)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_quotation_links": op3_quotation_links,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_pivot_index": op5_pivot_index,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_wfst": op8_wfst,
    "op9_pu_quality": op9_pu_quality,
    "op10_url_templates": op10_url_templates,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_wavelet": op13_wavelet,
}

SQL = {}

SQL["op2_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
h AS (SELECT doc_id, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] AS s FROM g),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p+1, p+2]) AS q FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(ln)::BIGINT AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(t, '[^\p{L}]+', '', 'g'))::BIGINT AS n_letters
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 100 * n_upper > 50 * n_letters THEN 32 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT *, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept,
  CASE failed & 63 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'word_length' WHEN 32 THEN 'capitals' END AS sole_rule FROM b
"""


def _spans_sql(kind: str, pattern: str, valid: str) -> str:
    """Spans of one kind: the pieces between matches and the matches, with running lengths."""
    return f"""
SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, m[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)))
WHERE {valid}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k:
  CASE WHEN k % 2 = 1 THEN {_DIGITS}[length({_DIGITS}) - k + 1]::INT
       WHEN {_DIGITS}[length({_DIGITS}) - k + 1]::INT > 4 THEN 2 * {_DIGITS}[length({_DIGITS}) - k + 1]::INT - 9
       ELSE 2 * {_DIGITS}[length({_DIGITS}) - k + 1]::INT END)) % 10 = 0"""
_IP = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0"

# The documents at hand hold no IBAN and no social security number; those kinds are tested against plain Python instead.
SQL["op1_pii"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
 UNION ALL {_spans_sql("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", _IP)}
 UNION ALL {_spans_sql("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN)}
 UNION ALL {_spans_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")}),
c AS (SELECT s.doc_id, kind, s.s, e, lower(substr(t, greatest(s.s - 40, 0)::INT + 1, least(s.s, 40)::INT) || chr(10) || substr(t, e::INT + 1, 40)) AS near FROM s JOIN d ON d.doc_id = s.doc_id),
p AS (SELECT *, least(100, CASE kind {" ".join(f"WHEN '{k}' THEN {round(100 * pii.SCORES[k])} + CASE WHEN regexp_matches(near, '(^|[^\\p{{L}}])(?:{pii.CONTEXT[k]})') THEN 30 ELSE 0 END" for k in pii.BASE)} END) AS score FROM c),
j AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
        count(*) FILTER (kind = 'phone') AS n_phone, count(*) AS n_spans, string_agg(score::INT::VARCHAR, ',' ORDER BY s, list_position(['email', 'ip', 'card', 'phone'], kind)) AS scores,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, list_position(['email', 'ip', 'card', 'phone'], kind)) AS spans
      FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, 0::BIGINT AS n_iban, 0::BIGINT AS n_ssn, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(spans, '')) AS base_sha256,
  coalesce(scores, '') AS scores, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""

# Recursion over replies; the tables at hand quote little or nothing, so the operator is also tested against plain Python on planted quotes.
SQL["op3_quotation_links"] = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS t, row_number() OVER () AS rid FROM conversations),
s AS (SELECT rid, conv_id, turn, p, string_split(t, chr(10))[p] AS raw FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS p FROM m)),
l AS (SELECT rid, conv_id, turn, p, length(regexp_replace(regexp_extract(raw, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
        CASE WHEN regexp_matches(raw, '^[ \t]*>') THEN regexp_replace(raw, '^(?:[ \t]*>)+[ \t]?', '') ELSE raw END AS line FROM s),
n AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY rid ORDER BY p), 0) AS nxt,
        p - row_number() OVER (PARTITION BY rid, level ORDER BY p) AS run FROM l),
b AS (SELECT rid, sum((level > 0)::INT)::BIGINT AS nq, max(level)::BIGINT AS ml,
        string_agg(line, chr(10) ORDER BY p) FILTER (level = 0 AND NOT (nxt > 0 AND regexp_matches(line,
          '(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$'))) AS own FROM n GROUP BY rid),
w AS (SELECT m.*, nq, ml, CASE WHEN nq > 0 THEN regexp_replace(coalesce(own, ''), '^\s+|\s+$', '', 'g') ELSE t END AS body FROM m JOIN b USING (rid)),
o AS (SELECT conv_id, turn, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS k
      FROM (SELECT conv_id, turn, unnest([body] || string_split_regex(body, '\n\s*\n') || string_split(body, chr(10))) AS u FROM w)),
f AS (SELECT conv_id, k, min(turn) AS src FROM o WHERE k <> '' GROUP BY ALL),
q AS (SELECT conv_id, turn, level, line AS u FROM n WHERE level > 0
      UNION ALL SELECT conv_id, turn, level, string_agg(line, chr(10) ORDER BY p) FROM n WHERE level > 0 GROUP BY rid, conv_id, turn, level, run HAVING count(*) > 1),
a AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS k FROM q),
r AS (SELECT a.conv_id, a.turn, src, level, sum(length(a.k)) AS chars FROM a JOIN f ON a.conv_id = f.conv_id AND a.k = f.k AND src < a.turn GROUP BY ALL),
e AS (SELECT conv_id, turn, src AS parent FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, src DESC) = 1),
c AS (SELECT conv_id, turn, parent AS up, 1 AS depth FROM e UNION ALL SELECT c.conv_id, c.turn, e.parent, depth + 1 FROM c JOIN e ON e.conv_id = c.conv_id AND e.turn = c.up),
d AS (SELECT conv_id, turn, min(up) AS top, max(depth) AS depth FROM c GROUP BY ALL)
SELECT w.conv_id, w.turn, w.role, body, nq AS n_quoted_lines, ml AS max_level, parent AS parent_turn, coalesce(top, w.turn) AS thread_turn, coalesce(depth, 0)::BIGINT AS depth,
  row_number() OVER (PARTITION BY w.conv_id ORDER BY coalesce(top, w.turn), w.turn, body) - 1 AS position, '<|' || coalesce(w.role, 'user') || '|>' || chr(10) || body || chr(10) AS chat
FROM w LEFT JOIN e ON w.conv_id = e.conv_id AND w.turn = e.turn LEFT JOIN d ON w.conv_id = d.conv_id AND w.turn = d.turn
"""

SQL["op11_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, phrase, k, f AS a, w, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT x.*, fl.f AS l, fr.f AS r, ((2000000::HUGEINT * a) // (fl.f + fr.f)::HUGEINT)::BIGINT AS score FROM x
  JOIN f fl ON fl.lang = x.lang AND fl.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN f fr ON fr.lang = x.lang AND fr.phrase = array_to_string(x.w[x.cut + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
s AS (SELECT lang, f, k, w, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
o AS (SELECT lang, phrase, max(f) AS longer FROM s GROUP BY ALL),
q AS (SELECT z.* FROM z LEFT JOIN o ON o.lang = z.lang AND o.phrase = z.phrase WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * z.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT r.lang, rank, phrase, a, l, r.r, n, score, k::INT AS words, cut::INT AS cut FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""

SQL["op12_hard_negatives"] = r"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, other AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor, p.positive, p.score AS ps, s.other, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, other AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5
"""
