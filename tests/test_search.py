import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.porter import stems
from quarry.operators import recall, related, search, tags

TEXTS = [
    "deploying cache-prod today, password=‹redacted› should be masked",
    'Rolling out now.\ncheck the cluster first\n⚙ Bash {"command": "kubectl get pods", "flags": {"all": true, "n": 3}}',
    "↪ pod-1 Running\npod-2 Running",
    "TICKET-123 cache-prod rollout finished, latency back to normal",
    "cache prod cache-prod rollout",
]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [("aaaa-bbbb-1111", s, TEXTS[k], "user" if k % 2 == 0 else "assistant") for k, s in enumerate((0, 1, 2, 5))] + [("cccc", 0, TEXTS[4], "user")]
    d = spark.createDataFrame(rows, "session_id string, seq long, text string, role string")
    return d.withColumns({"project": F.lit("-tmp-demo"), "ts": F.lit("2026-06-12T01:05:00Z"), "is_meta": F.lit(0), "is_sidechain": F.lit(0)})


def fts(query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(TEXTS)))
    return {r[0]: r[1] for r in con.execute("select rowid, bm25(t) from t where t match ?", (query,))}


@pytest.mark.parametrize("terms, query, any_of", [(["cache-prod"], '"cache-prod"', False), (["rollout", "cache"], '"rollout" "cache"', False), (["deploy", "latency", "running"], '"deploy" OR "latency" OR "running"', True)])
def test_bm25_equals_sqlite(turns, terms, query, any_of):
    stemmed = lambda c: stems(T.tokens(c))
    got = {TEXTS.index(r.text): r.score for r in search.match_scores(turns, terms, any_of=any_of, tokenizer=stemmed).collect()}
    want = fts(query)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fold_and_limits(spark):
    hits = spark.createDataFrame([(s, i) for i, s in enumerate("abaca")], "session_id string, k int")
    fold = lambda n: [(r.session_id, r.n_more) for r in search.fold_sessions(hits, n, [F.col("k")]).collect()]
    assert fold(2) == [("a", 2), ("b", 0)] and fold(-1) == [("a", 2), ("b", 0), ("c", 0)]


def test_fuzzy(turns):
    found = lambda terms, **k: sorted((r.session_id, r.seq, r.nearest) for r in search.fuzzy(turns, terms, **k).collect())
    assert found(["latecny"]) == found(["latecny", "rollout"]) == [("aaaa-bbbb-1111", 5, True)]
    assert found(["atenc"]) == [("aaaa-bbbb-1111", 5, False)] and found(["qqqqqqq"]) == []
    with pytest.raises(ValueError):
        search.fuzzy(turns, ["ab"])


def test_usage_errors_and_none(turns):
    with pytest.raises(ValueError):
        search.match_scores(turns, [" "])
    assert search.keyword(turns, ["rollout"], 0).count() == 0 and search.keyword(turns, ["--"], 5).count() == 0
    with pytest.raises(ValueError):
        search.between_dates(F.col("ts"), "2026-13-01")


def test_semantic_order(spark):
    v = spark.createDataFrame([(9, [0.5, 0.0]), (4, [0.9, 0.0]), (2, [0.5, 0.0]), (7, [0.9, 0.0]), (1, [1.0]), (3, [5.0, 0.0])], "turn_id long, vec array<float>")
    assert [r.turn_id for r in search.semantic(v, [1.0, 0.0], -1).collect()] == [4, 7, 2, 9]
    assert tuple(search.corrupt(v, [1.0, 0.0]).first()) == (4, 2)


def test_tags(turns):
    got = [r.tag for r in tags.derive(turns.where("session_id <> 'cccc'")).orderBy(F.when(F.col("ns") == "tool", 0).otherwise(2), "rank").collect()]
    assert got == ["tool:bash", *(f"topic:{x}" for x in "cache-prod running deploying password masked rolling cluster command kubectl pod-1".split())]


def test_recall(turns):
    got = recall.run(turns, "how did we handle the cache-prod TICKET-123 rollout?", "-tmp-demo", "2027-01-12T00:00:00Z", live="zzz").collect()
    assert ("aaaa-bbbb-1111", 5) in [(r.session_id, r.seq) for r in got] and len({r.session_id for r in got}) == len(got)
    assert recall.run(turns, "short", "-tmp-demo", "2027-01-12T00:00:00Z").count() == 0
    assert recall.run(turns, "how did we handle the cache-prod TICKET-123 rollout?", "other", "2027-01-12T00:00:00Z").count() == 0


def test_related(turns):
    got = {r.low: r.n_sessions for r in related.terms(turns, "cache-prod").collect()}
    assert got == {"rollout": 2} or set(got) == {"rollout"}
    assert {r.session_id for r in related.sessions(turns, "cache-prod").collect()} == {"aaaa-bbbb-1111", "cccc"}


def test_snippets(spark, turns):
    from quarry.functions.snippet import snippet, snippet_of

    marked = "«TICKET-123» «cache-prod» «rollout» finished, latency back to normal"
    assert snippet_of(TEXTS[3], [["ticket", "123"], ["cache", "prod"], ["rollout"]], 20) == marked
    long = "a " * 30 + "needle pin " + "b " * 30
    got = snippet_of(long, [["needle"], ["pin"]], 4)
    assert got == "…«needle» «pin» b b…"
    assert turns.where("seq = 5").select(snippet(F.col("text"), [["ticket", "123"], ["cache", "prod"], ["rollout"]], 20)).first()[0] == marked


def test_hidden_facts(spark):
    rows = [("cache-prod.md", "cache-prod rollout", "TICKET-123 cache-prod rollout plan"), ("other.md", "unrelated things", "nothing here"), ("seen.md", "cache-prod rollout again", "TICKET-123 cache-prod rollout")]
    f = spark.createDataFrame([(p, t, t, h, "", "p", "active", None) for p, t, h in rows] + [(f"x{i}.md", "w", "w", "w", "", "p", "active", None) for i in range(30)],
        "leaf_path string, title string, name string, hook string, description string, project string, status string, superseded_at string")
    got = recall.hidden_facts(f, "how did we handle the cache-prod TICKET-123 rollout?", "p", ["seen.md"]).collect()
    assert [r.leaf_path for r in got] == ["cache-prod.md"]
    assert recall.hidden_facts(f, "short", "p").count() == 0


RAW = ["deploy* OR latency", "cache AND rollout", '"cache prod" NOT masked', "(pod OR ticket) AND (running OR 123)", "rolling cluster", "NEAR(cache rollout, 2)", "NEAR(rolling cluster)", '"rolling out" AND check* NOT pods', "run* NOT (pod OR cluster)"]


@pytest.mark.parametrize("query", RAW)
def test_raw_queries_equal_sqlite(turns, query):
    want = fts(query)
    got = {TEXTS.index(r.text): r.score for r in search.raw_scores(turns, query).collect()}
    assert set(got) == set(want), query
    if "NEAR" not in query:  # a NEAR group counts as one phrase a word here
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("query", ["", "(a", "AND a", "a OR", "a NOT"])
def test_broken_raw_queries_are_refused(turns, query):
    with pytest.raises(ValueError):
        search.raw_scores(turns, query)


def test_default_search_is_stemmed_and_marked(turns):
    assert [r.seq for r in search.keyword(turns, ["deploy"], 5).collect()] == [0]
    hit = search.keyword(turns, ["ticket", "rollout"], 5, snippet_words=12).first()
    assert hit.snip.startswith("«TICKET»-123 cache-prod «rollout» finished")
    assert search.keyword(turns, [], 5, raw='"cache prod" NOT masked', snippet_words=12).count() == 2


def test_nearest_vectors_where_nothing_matches(spark, turns):
    t = turns.withColumn("turn_id", F.col("seq") + F.length("session_id") * 100)
    v = t.select("turn_id", F.array((F.col("seq") / 10).cast("float"), F.lit(0.5).cast("float")).alias("vec"))
    mode, hits = search.keyword_or_nearest(t, ["rollout"], v, lambda x: [[1.0, 0.0]])
    assert mode == "keyword" and hits.count() == 2
    mode, hits = search.keyword_or_nearest(t, ["zzzz"], v, lambda x: [[1.0, 0.0]], 2, exclude=["ticket"])
    assert mode == "semantic" and [r.seq for r in hits.collect()] == [2, 1]


def test_recall_leaves_out_what_was_shown_and_caps_terms(spark, turns):
    ask = "how did we handle the cache-prod TICKET-123 rollout?"
    found = recall.run(turns, ask, "-tmp-demo", "2027-01-12T00:00:00Z", live="zz")
    best = found.first()
    seen = spark.createDataFrame([("x", f"turn:{best.session_id}/{best.seq}")], "session string, source string")
    again = recall.run(turns, ask, "-tmp-demo", "2027-01-12T00:00:00Z", live="zz", seen=seen)
    assert (best.session_id, best.seq) not in {(r.session_id, r.seq) for r in again.collect()}
    p = recall.read_prompt(spark, " ".join(f"word{chr(97 + k)}" for k in range(14)) + " ab12 LONGEST-identifier-9")
    assert len(p.terms) == 16 and len(p.match) == recall.MAX_MATCH_TERMS and p.match[0] == "LONGEST-identifier-9"
    full = spark.createDataFrame([("s", f"turn:{'x' * 1000}{k}", k) for k in range(30)], "session string, source string, n long")
    assert sorted(r.n for r in recall.trim_seen(full, max_bytes=5100).collect()) == list(range(25, 30))


def test_recall_through_the_index_equals_the_scan(spark, turns, tmp_path):
    from quarry.operators import index

    ask, now, folder = "how did we handle the cache-prod TICKET-123 rollout?", "2027-01-12T00:00:00Z", f"file://{tmp_path}/ix"
    index.build(turns, folder)

    def same(left, project="-tmp-demo", **more):
        shape = lambda d: [(r.session_id, r.seq, r.text, round(r.score, 9), round(r["rank"], 9)) for r in d.collect()]
        want = shape(recall.run(left, ask, project, now, **more))
        assert shape(recall.run_indexed(spark, folder, ask, project, now, **more)) == want
        return want

    best = same(turns, live="zzz")[0]
    assert same(turns, live=best[0]) != [best] and not same(turns, project="other")
    same(turns, seen=spark.createDataFrame([("x", f"turn:{best[0]}/{best[1]}")], "session string, source string"))
    index.forget(spark, folder, F.col("session_id") == best[0])
    assert best[0] not in {r[0] for r in same(turns.where(F.col("session_id") != best[0]))}
    assert recall.run_indexed(spark, folder, "short", "-tmp-demo", now).count() == 0


def later_turns(spark, folder):
    """Turns of project p1 from before and from after the time at which the recall queries ask, as a table of conversations."""
    said = ["erlich schsch work erheit", "erlich schsch", "erlich erheit hetion some more words here", "nothing of it at all", "other words only", "yet other ones"]
    rows = [(conv, 0, "user", said[k % 6]) for k, conv in enumerate([9, 3609, 4601, 4761, *range(17, 200, 2), *range(5001, 5100, 4)])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def by_sql(folder, query):
    import duckdb

    from quarry.plans.registry import SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    return con.execute(SQL[query]).fetchall()


def test_recall_lines_of_turns_after_the_asking_equal_their_sql(spark, tmp_path):
    from quarry.plans import queries

    folder = later_turns(spark, str(tmp_path))
    got = [tuple(r) for r in queries.QUERIES["recall_lines"](spark, folder).collect()]
    assert got == by_sql(folder, "recall_lines") and max(r[2] for r in got) > "2024-06-01"
    # By themselves they count as just written.
    ask = "how did the erlich and schsch work with erheit hetion?"
    plain = recall.run(queries.tables.turns(spark, folder), ask, "p1", "2024-06-01T00:00:00Z", live="1", tokenizer=T.ascii_tokens).collect()
    assert plain and all(r["rank"] >= r["score"] - 1.5 for r in plain)


def test_recall_lines_indexed_of_turns_after_the_asking_equal_their_sql(spark, tmp_path):
    from quarry.plans import queries

    folder = later_turns(spark, str(tmp_path))
    assert [tuple(r) for r in queries.QUERIES["recall_lines_indexed"](spark, folder).collect()] == by_sql(folder, "recall_lines_indexed")
