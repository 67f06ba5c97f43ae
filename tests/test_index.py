"""The stored index against a scan of the rows it should hold, after every kind of change."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index, related, search
from quarry.sources.store import StaleWriter, Store

WORDS = "deploy deployed deploying cache prod rollout roll rolling ticket of the café latency licensed license masked secret pod run running check".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS[: 6 if rng.random() < 0.4 else None]) for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(n)]


def frame(spark, ts, first=0):
    return spark.createDataFrame([(f"s{(first + i) % 7}", first + i, t, "p" if i % 2 else "q") for i, t in enumerate(ts)], "session_id string, seq long, text string, project string").repartition(3)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """The tables are tiny and look-ups many."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


ASKS = [(["deploys", "run"], {"any_of": True}), (["cache-prod"], {}), (["cache-prod"], {"exclude": ["masked"]}), (["rolling out"], {}), (["the", "of the"], {"any_of": True}), (["nothing here"], {}), (["..."], {})]
RAW = ['("of the" OR licensed) AND cache NOT masked', "deploy* NOT pod", "NEAR(cache secret, 3)", '"rolling ticket" OR check']


def equal(index_rows, scan_rows):
    got, want = ({r.seq: r.score for r in d.collect()} for d in (index_rows, scan_rows))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    return want


def same_as_scan(spark, folder, rows, asks=ASKS[:3:2], raw=RAW[1:2]):
    """Look-ups equal the scan of ``rows``; gives how many hits there were."""
    n, rows = 0, rows.cache()
    held = index.rows(spark, folder)
    assert sorted(map(tuple, held.select("seq", "text").collect())) == sorted(map(tuple, rows.select("seq", "text").collect()))
    for terms, more in asks:
        n += len(equal(index.match_scores(spark, folder, terms, **more).join(held, "rid"), search.match_scores(rows, terms, **more)))
    for q in raw:
        n += len(equal(index.raw_scores(spark, folder, q).join(held, "rid"), search.raw_scores(rows, q)))
    return n


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('index')}/i"
    df = frame(spark, texts(400)).cache()
    index.build(df, folder, buckets=3)
    return df, folder


def test_equals_the_scan(spark, built):
    df, folder = built
    assert same_as_scan(spark, folder, df, ASKS, RAW) > 100
    with pytest.raises(ValueError):
        index.match_scores(spark, folder, [" "])
    with pytest.raises(ValueError):
        index.build(df, folder)


def test_flags_of_a_look_up(spark, built):
    df, folder = built
    ids = ("session_id", "seq")
    cols = ["session_id", "seq", "n_more"]
    for limit in (3, 40, -1, 0):
        got = index.keyword(spark, folder, ["cache", "ticket"], limit, fold=True, any_of=True, id_cols=ids).select(cols).collect()
        assert got == search.keyword(df, ["cache", "ticket"], limit, any_of=True).select(cols).collect()
    got = index.keyword(spark, folder, ["cache"], 5, session="S3", id_cols=ids).select("seq").collect()
    assert got == search.keyword(df, ["cache"], 5, session="S3").select("seq").collect() != []
    got = index.keyword(spark, folder, ["cache"], 5, where=F.col("project") == "q", id_cols=ids).select("seq").collect()
    assert got == search.match_scores(df, ["cache"], where=F.col("project") == "q").orderBy("score", *ids).limit(5).select("seq").collect()
    tags = spark.createDataFrame([("s1", "topic:x"), ("s2", "topic:y")], "session_id string, tag string")
    hits = index.keyword(spark, folder, [], 50, raw="cache AND ticket", tags=(tags, ["x"]), snippet_words=4).collect()
    assert hits and {r.session_id for r in hits} == {"s1"} and all("«cache»" in r.snip or "«ticket»" in r.snip for r in hits)
    vectors = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "turn_id long, vec array<float>")
    assert index.keyword_or_nearest(spark, folder, ["cache"], vectors, None, 3)[0] == "keyword"


def test_append_reads_new_rows_alone_and_changes_follow(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    one, two = frame(spark, texts(150, 2)), frame(spark, texts(90, 3), 1000)
    index.build(one, folder, buckets=2)
    before = {f for fs in Store(spark, folder).manifest()["tables"].values() for f in fs}
    index.append(two, folder)
    m = Store(spark, folder).manifest()
    assert [len(m["tables"][t]) for t in ("rows", "postings", "stats")] == [2, 2, 2] and before < {f for fs in m["tables"].values() for f in fs}
    every = one.unionByName(two)
    assert same_as_scan(spark, folder, every) > 50
    index.forget(spark, folder, F.col("session_id") == "s2")
    every = every.where("session_id <> 's2'")
    assert same_as_scan(spark, folder, every) > 50
    masked = F.regexp_replace("text", "secret", "[MASKED]")
    index.replace(spark, folder, F.col("text").contains("secret"), masked)
    every = every.withColumn("text", masked)
    assert same_as_scan(spark, folder, every) > 50
    assert index.match_scores(spark, folder, ["secret"]).count() == 0
    index.append(two.where("session_id = 's2'"), folder)  # forgotten rows may come again
    every = every.unionByName(two.where("session_id = 's2'"))
    assert same_as_scan(spark, folder, every) > 50
    old = index.rows(spark, folder, 1).count()
    index.compact(spark, folder)
    assert old == 150 and same_as_scan(spark, folder, every) > 50
    m = Store(spark, folder).manifest()
    assert [len(m["tables"][t]) for t in ("rows", "postings", "stats", "removed", "gone")] == [1, 1, 1, 0, 0]
    index.append(frame(spark, texts(20, 4), 5000), folder)
    assert same_as_scan(spark, folder, every.unionByName(frame(spark, texts(20, 4), 5000))) > 50


def test_forgotten_text_leaves_the_files(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    index.build(frame(spark, ["hush zebrasecret one", "two words"]), folder, buckets=1)
    index.forget(spark, folder, F.col("text").contains("zebrasecret"))
    index.compact(spark, folder)
    assert index.vacuum(spark, folder)
    left = b"".join(f.read_bytes() for f in (tmp_path / "i").rglob("*.parquet"))
    assert b"zebrasecret" not in left and b"words" in left


@pytest.mark.parametrize("limit", [7, 5000])
def test_bounded_top_equals_the_whole_sort(spark, built, limit):
    df, folder = built
    for terms in (["licensing"], ["deploys", "rolling", "the", "the"], ["zzz", "pod"], ["zzz"], ["cache prod"]):
        got, _ = index.top(spark, folder, terms, limit, id_cols=("seq",))
        want = search.match_scores(df, terms, any_of=True).orderBy("score", "seq").limit(limit).collect()
        got = got.collect()
        assert [r.seq for r in got] == [r.seq for r in want] and all(abs(a.score - b.score) < 1e-9 for a, b in zip(got, want))


def test_bounded_top_skips_blocks(spark, tmp_path):
    """A frequent word in rows of very different lengths: a fraction of its postings is read."""
    rng = random.Random(6)
    ts = [" ".join(["the"] * rng.choice([1, 1, 1, 2, 9]) + [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 400]))]) for _ in range(6000)]
    folder = f"file://{tmp_path}/i"
    df = frame(spark, ts)
    index.build(df, folder, T.ascii_tokens, buckets=2)
    got, read = index.top(spark, folder, ["the"], 10, id_cols=("seq",), tokenizer=T.ascii_tokens)
    want = search.match_scores(df, ["the"], tokenizer=T.ascii_tokens).orderBy("score", "seq").limit(10)
    assert [r.seq for r in got.collect()] == [r.seq for r in want.collect()]
    assert read.all_postings == 6000 and read.postings < 1500, read
    for limit in (1, 10):  # the frequent word leads to no row; only its blocks that span the rows found are read
        got, read = index.top(spark, folder, ["the", "w7"], limit, id_cols=("seq",), tokenizer=T.ascii_tokens)
        want = search.match_scores(df, ["the", "w7"], any_of=True, tokenizer=T.ascii_tokens).orderBy("score", "seq").limit(limit)
        assert [r.seq for r in got.collect()] == [r.seq for r in want.collect()]
        assert limit > 1 or read.postings < 0.7 * read.all_postings, read


def test_a_look_up_reads_its_bucket_alone(spark, built):
    _, folder = built
    plan = index.Reader(spark, folder).blocks(["cache"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,cache)" in plan


FUZZY = [(["icens"], {}), (["roll", "che"], {}), (["roll", "zzzz"], {"any_of": True}), (["licesned"], {}), (["deplyo", "cache"], {}), (["licesned", "tikcet"], {"any_of": True}), (["zzz"], {}), (["afé"], {}), (["e p"], {})]


def test_trigrams_equal_the_scan(spark, built, tmp_path):
    df, _ = built
    folder = f"file://{tmp_path}/t"
    index.build_trigrams(df, folder, buckets=3)
    cols, hits = ["session_id", "seq", "nearest"], 0
    for terms, more in FUZZY:
        got, want = (d.select(*cols, F.round("score", 9).alias("score")).collect() for d in (index.fuzzy(spark, folder, terms, 20, **more), search.fuzzy(df, terms, 20, **more)))
        assert got == want, terms
        hits += len(got)
    assert hits > 60
    with pytest.raises(ValueError):
        index.fuzzy(spark, folder, ["ab"])
    # What the scan does not take: exclusions, filters, folding.
    got = index.fuzzy(spark, folder, ["ache"], 500, exclude=["icen"], where=F.col("project") == "q").collect()
    assert {r.seq for r in got} == {r.seq for r in df.collect() if "ache" in r.text and "icen" not in r.text and r.project == "q"}
    got = index.fuzzy(spark, folder, ["ache"], 100, fold=True).collect()
    assert len({r.session_id for r in got}) == len(got) == 7 and sum(r.n_more + 1 for r in got) == df.where("text LIKE '%ache%'").count()
    plan = index.Reader(spark, folder, None)
    c, _ = plan.counted(plan.phrases(["icens"]))
    assert "text" not in c._jdf.queryExecution().executedPlan().toString()
    index.forget(spark, folder, F.col("session_id") == "s1", None)
    index.append(frame(spark, ["licence licensed"], 9000), folder, None)
    now = df.where("session_id <> 's1'").unionByName(frame(spark, ["licence licensed"], 9000))
    assert index.fuzzy(spark, folder, ["icens"], 20).select(cols).collect() == search.fuzzy(now, ["icens"], 20).select(cols).collect()


def test_empty_and_odd_texts(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    df = spark.createDataFrame([("a", 1, None), ("a", 2, ""), ("b", 3, "x " * 20000), ("b", 3, "x " * 20000), ("c", 4, "x")], "session_id string, seq long, text string")
    index.build(df, folder, buckets=1)
    assert sorted((r.seq, r.score) for r in index.match_scores(spark, folder, ["x"]).join(index.rows(spark, folder), "rid").collect()) == sorted((r.seq, r.score) for r in search.match_scores(df, ["x"]).collect())
    other = f"file://{tmp_path}/e"
    index.build(df.limit(0), other)
    assert index.match_scores(spark, other, ["x"]).count() == 0 and index.top(spark, other, ["x"])[0].count() == 0
    index.append(df, other)
    assert index.match_scores(spark, other, ["x"]).count() == 3


def test_two_writers_from_one_version(spark, tmp_path):
    """The second is refused, and what readers see is one or the other whole."""
    store = Store(spark, f"file://{tmp_path}/s")
    store.write({"a": spark.range(3), "b": spark.range(3)})
    base = store.manifest()
    assert store.write({"a": spark.range(5), "b": spark.range(5)}, base) == 2
    with pytest.raises(StaleWriter):
        store.write({"a": spark.range(7), "b": spark.range(7)}, base)
    assert [store.read(t).count() for t in "ab"] == [5, 5] and [store.read(t, 1).count() for t in "ab"] == [3, 3]
    store.write({"a": spark.range(2)}, append=True)
    assert store.read("a").count() == 7 and store.version() == 3
    raced = []

    def change(s, m):
        if not raced:  # another writer comes between
            raced.append(store.write({"a": spark.range(1)}))
        return {"a": s.read("a", m).limit(0)}

    assert store.update(change) == 5 and store.read("a").count() == 0
    store.vacuum()
    assert store.read("a").count() == 0 and store.read("b").count() == 5
    with pytest.raises(Exception):
        store.read("a", 1)


@pytest.mark.parametrize("tokenizer", [T.index_tokens, T.ascii_tokens])
def test_related_terms_equal_the_scan(spark, tmp_path, tokenizer):
    df = frame(spark, [t.replace("cache prod", "cache-prod").replace("rolling ticket", "Rolling_Ticket") for t in texts(250, 9)])
    df = df.withColumns({"ts": F.concat(F.lit("2026-01-0"), F.col("seq") % 7 + 1), "is_meta": (F.col("seq") % 9 == 0).cast("int"), "is_sidechain": F.lit(0)}).cache()
    folder, forward = f"file://{tmp_path}/i", f"file://{tmp_path}/f"
    one = F.col("seq") % 3 < 2
    index.build(df.where(one), folder, tokenizer, buckets=2)
    index.append(df.where(~one), folder, tokenizer)
    related.add_to_forward(df.where(one), forward, 2)
    related.add_to_forward(df.where(~one), forward)
    got, want = related.indexed_terms(spark, folder, forward, "latency", 12, tokenizer=tokenizer), related.terms(df, "latency", 12, tokenizer=tokenizer)
    assert [tuple(r)[:4] for r in got.collect()] == [tuple(r)[:4] for r in want.collect()] != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan
    assert related.indexed_terms(spark, folder, forward, "zzz", tokenizer=tokenizer).count() == 0
