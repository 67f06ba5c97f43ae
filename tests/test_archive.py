import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import embed, facts as FA, hours, maint, sessions, stats
from quarry.sources import transcripts as S
from quarry.streaming.activity import active_windows
from quarry.operators.archive import Archive
from quarry.sources.store import StaleWriter, Store
from quarry.streaming.transcripts import _Reader, ingest

RECORDS = [
    {"type": "user", "timestamp": "2026-06-12T01:00:00Z", "message": {"role": "user", "content": "deploying cache-prod today, password=hunter2 should be masked"}},
    {"type": "assistant", "timestamp": "2026-06-12T01:01:00Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "Rolling out now.\ncheck the cluster first"}, {"type": "tool_use", "name": "Bash", "input": {"flags": {"n": 3, "all": True}, "command": "kubectl get pods"}}]}},
    {"type": "user", "timestamp": "2026-06-12T01:02:00Z", "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "pod-1 Running"}, "pod-2 Running"]}]}},
    {"type": "user", "message": {"content": "<command-name>/x</command-name>"}},
    {"type": "user", "isMeta": True, "message": {"content": "caveat"}},
    {"type": "user", "timestamp": "2026-06-12T01:05:00Z", "isSidechain": True, "message": {"content": "TICKET-123 cache-prod rollout finished, latency back to normal"}},
]


def write(root, project, session, text):
    d = root / project
    d.mkdir(parents=True, exist_ok=True)
    (d / f"{session}.jsonl").write_text(text)


def lines(n=None):
    return "".join(json.dumps(r) + "\n" for r in RECORDS[:n])


def test_transcripts(spark, tmp_path):
    write(tmp_path, "-tmp-demo", "aaaa-bbbb-1111", lines() + "\nnot json\n" + json.dumps(RECORDS[0]))
    got = S.read_transcripts(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.role, r.text) for r in got] == [
        (0, "user", "deploying cache-prod today, password=‹redacted› should be masked"),
        (1, "assistant", 'Rolling out now.\ncheck the cluster first\n⚙ Bash {"command": "kubectl get pods", "flags": {"all": true, "n": 3}}'),
        (2, "user", "↪ pod-1 Running\npod-2 Running"),
        (5, "user", "TICKET-123 cache-prod rollout finished, latency back to normal"),
    ]
    assert {(r.session_id, r.project) for r in got} == {("aaaa-bbbb-1111", "-tmp-demo")} and got[3].is_sidechain == 1
    files = S.list_transcripts(spark, str(tmp_path))
    state = files.select(F.col("path").alias("file_path"), F.col("size").alias("file_size"), F.col("mtime").alias("file_mtime"), F.lit(4).alias("num_turns"), F.col("size").alias("scan_offset"))
    assert maint.changed_files(files, state).count() == 0 and maint.changed_files(files, state.withColumn("file_size", F.lit(1).cast("long"))).count() == 1


def test_flatten_shapes():
    assert S.flatten({"type": "system"}) is None and S.flatten(None) is None and S.flatten({"type": "user"}) is None
    assert S.flatten({"type": "user", "message": {"content": [{"type": "thinking", "thinking": "x" * 3000}]}})[1] == "x" * 2000 + "…"
    assert S.result_text({"text": "a"}) == "a" and S.result_text(None) == "" and S.result_text({"b": 1, "a": [1]}) == '{"a": [1], "b": 1}' and S.result_text(True) == "true"


@pytest.mark.parametrize("size", [1 << 26, 50])
def test_stream_reads_appended_lines_once(spark, tmp_path, size):
    """Lines that arrive in steps, half a line among them, give the turns of one full read; a file that shrank keeps what was stored."""
    root, folder, ckpt = tmp_path / "root", f"file://{tmp_path}/store", f"file://{tmp_path}/ckpt"
    whole = lines()
    for stop in (whole.index("\n") + 1, whole.index("\n") + 40, len(whole), len(whole)):
        write(root, "p", "s1", whole[:stop])
        ingest(spark, f"file://{root}", folder, ckpt, size).awaitTermination(120)
    write(root, "q", "s2", lines(1))
    ingest(spark, f"file://{root}", folder, ckpt, size).awaitTermination(120)
    store = Store(spark, folder)
    full = S.read_transcripts(spark, str(root))
    cols = ["session_id", "project", "seq", "role", "text", "is_sidechain", "ts"]
    assert sorted(map(tuple, store.read("turns").select(cols).collect())) == sorted(map(tuple, full.select(cols).collect()))
    assert {r.path.split("/")[-1]: r["lines"] for r in store.read("cursors").collect()} == {"s1.jsonl": whole.count("\n"), "s2.jsonl": 1}
    n = store.read("turns").count()
    write(root, "q", "s2", "{}\n")
    ingest(spark, f"file://{root}", folder, ckpt, size).awaitTermination(120)
    write(root, "q", "s2", "{}\n" + json.dumps(RECORDS[0]) + "\n")
    ingest(spark, f"file://{root}", folder, ckpt, size).awaitTermination(120)
    assert store.read("turns").count() == n + 1 and {r.seq for r in store.read("turns").where("session_id = 's2'").collect()} == {0, 1}


def test_the_driver_lists_and_opens_nothing(tmp_path, monkeypatch):
    write(tmp_path, "p", "s1", lines())
    r = _Reader(f"file://{tmp_path}", (), 100)
    monkeypatch.setattr("builtins.open", None)
    end = r.latestOffset()
    assert list(end.values()) == [len(lines().encode())]
    parts = r.partitions({}, end)
    assert [p.start for p in parts] == list(range(0, parts[-1].stop, 100)) and parts[-1].stop == len(lines().encode())


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_a_file_in_any_number_of_ranges(spark, tmp_path, ranges):
    """Long lines, blank and broken ones, carriage returns, bytes that are no text, and a tail without an end."""
    rows = [json.dumps({"type": "user", "message": {"content": f"line {k} " + "é" * (k * 37 % 400)}}, ensure_ascii=False).encode() for k in range(300)]
    for k in range(0, 300, 7):
        rows[k] = [b"", b"{broken", rows[k] + b"\r", rows[k].replace(b"line", b"\xff\xfe"), b" \r"][k % 5]
    for name, body in (("a", b"\n".join(rows) + b"\n"), ("b", b"\n".join(rows)), ("c", b""), ("d", rows[1]), ("e", b"\n\n" + rows[1] + b"\n")):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / f"{name}.jsonl").write_bytes(body)
    want = sorted((name, r["seq"], r["text"]) for name in "abcde" for r in S.records((tmp_path / "p" / f"{name}.jsonl").read_bytes())[0])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(-(-(tmp_path / "p" / "a.jsonl").stat().st_size // ranges)))
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if ranges > 1 else "4194304")
    try:
        d = S.read_transcripts(spark, str(tmp_path))
        got = sorted((r.session_id, r.seq, r.text) for r in d.collect())
        assert got == want and len(got) > 500
        raw = spark.read.text(f"{tmp_path}/p/a.jsonl").select("_metadata.file_block_start").distinct().count()
        assert (raw == 1) if ranges == 1 else raw >= ranges - 1
        assert "binaryFile" not in d._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("ms, want", [([5], 120000), ([0, 1800000], 1920000), ([0, 1800001], 240000)])
def test_credited_time(spark, ms, want):
    d = spark.createDataFrame([("k", m) for m in ms], "k string, ms long")
    assert hours.credited(d, ["k"]).first().active_ms == want == hours.merged(d).first().active_ms
    w = active_windows(d.select("k", F.timestamp_millis("ms").alias("ts")), ["k"])
    assert w.agg(F.sum("active_ms")).first()[0] == want


def test_merged_time_over_days(spark):
    d = spark.createDataFrame([(86_400_000 - 60_000,), (86_400_000 + 60_000,), (86_400_000 + 60_000,), (5 * 86_400_000,)], "ms long")
    assert tuple(hours.merged(d).first()) == (4, 120_000 + 120_000 + 0 + 120_000)
    assert tuple(hours.merged(d.limit(0)).first()) == (0, 0)


def turns_of(spark, rows):
    return spark.createDataFrame([(s, q, None, f"2026-01-01T00:{q:02d}:00Z", r, t, 0, 0, "p", "/x") for s, q, r, t in rows], schema.TURNS)


def test_exchanges_card_resolve_dump(spark):
    t = turns_of(spark, [("s1", 0, "user", "first"), ("s1", 1, "assistant", "a"), ("s1", 2, "assistant", "b"), ("s1", 3, "assistant", "⚙ x"), ("s1", 4, "user", "↪ r"), ("s1", 5, "user", "second"), ("s2", 9, "user", "<x>")])
    got = [(r.seq, r.prompt, r.reply) for r in sessions.exchanges(t).orderBy("seq").collect()]
    assert got == [(0, "first", "b"), (5, "second", None)]
    s = sessions.rollup(t)
    assert tuple(sessions.card(t, s, "p").first())[2:] == ("first", "b") and sessions.card(t, s, "p", source="resume").count() == 0 and sessions.card(t, s, "p", live="s1").count() == 0
    assert [tuple(r) for r in sessions.resolve(s, "s").collect()] == [("ambiguous", "s1"), ("ambiguous", "s2")]
    assert sessions.resolve(s, "s1").first()[0] == "exact" and sessions.resolve(s, "x").first()[0] == "none"
    assert [r.seq for r in sessions.dump(t, "s1", 3).collect()] == [4, 5]


def test_merge_conflicts_and_sessions(spark):
    old = turns_of(spark, [("s", 0, "user", "a"), ("s", 2, "user", "b")])
    new = turns_of(spark, [("s", 0, "user", "a"), ("s", 1, "user", "x"), ("s", 2, "user", "c")])
    assert sorted((r.seq, r.why) for r in maint.conflicts(old, new).collect()) == [(1, "inserted"), (2, "changed")]
    assert sorted((r.seq, r.text) for r in maint.merge_turns(old, new).collect()) == [(0, "a"), (1, "x"), (2, "b")]
    row = lambda **k: spark.createDataFrame([{**dict.fromkeys([c.split()[0] for c in schema.SESSIONS.split(", ")]), "session_id": "s", **k}], schema.SESSIONS)
    grown = maint.upsert_sessions(row(first_ts="2", last_ts="5", file_size=9, scan_offset=9, cwd="/x"), row(first_ts="1", last_ts="4", file_size=12, scan_offset=12)).first()
    assert (grown.first_ts, grown.last_ts, grown.scan_offset, grown.cwd) == ("1", "5", 12, "/x")
    shrunk = maint.upsert_sessions(row(file_size=9, scan_offset=9), row(file_size=3, scan_offset=3)).first()
    assert shrunk.scan_offset == 3


def test_queue_rules(spark):
    s = spark.createDataFrame([("s", 5, -1)], "session_id string, last_seq long, checkpointed_seq long")
    q = spark.createDataFrame([("s", "t", 1)], schema.QUEUE)
    q2, s2 = maint.drop(q, s, "s", 3)
    assert q2.count() == 1 and s2.first().checkpointed_seq == 3
    q3, s3 = maint.drop(q, s, "s", 5)
    assert q3.count() == 0 and s3.first().checkpointed_seq == 5
    for bad in (lambda: maint.drop(q, s, "s", 9), lambda: maint.drop(q, s, "zz", 1), lambda: maint.drop(q, s, "s"), lambda: maint.clear(q), lambda: maint.forget({}, "s", "t")):
        with pytest.raises(ValueError):
            bad()
    f = spark.createDataFrame([], "origin_session string")
    with pytest.raises(ValueError):
        maint.mark_current(q, s, f, "s")
    assert maint.mark_current(q, s, f, "s", no_facts=True)[0].count() == 0
    gate = spark.createDataFrame([("a", "queued"), ("b", "pruned")], "session_id string, state string")
    assert [(r.session_id, r.enqueue_seq) for r in maint.enqueue(q, gate, "t").orderBy("enqueue_seq").collect()] == [("s", 1), ("a", 2)]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in (0, 1, 2, 9)], "n int").select(maint.backoff_seconds(F.col("n"))).collect()] == [3600, 3600, 7200, 86400]


def test_snapshots_keep_the_newest(spark, tmp_path):
    t = spark.range(3)
    for k in range(4):
        maint.snapshot({"t": t}, f"file://{tmp_path}/snap", f"2026-01-0{k + 1}", keep=2)
    assert sorted(p.name for p in (tmp_path / "snap").iterdir() if not p.name.startswith(".")) == ["2026-01-03", "2026-01-04"]
    assert spark.read.parquet(f"{tmp_path}/snap/2026-01-04/t").count() == 3


def leaf(name, description, body="", type_="project", extra=""):
    return f"---\nname: {name}\ndescription: {description}\ntype: {type_}\n{extra}---\n{body}"


def test_facts_doctor_links_and_index(spark):
    files = [
        ("a.md", leaf("alpha", "cache rollout latency budget plan", "see [[beta]] and [[Gone]] [[alpha]]\n```\n[[infence]]\n```\n")), ("b.md", leaf("beta", "cache rollout latency budget notes", "[[a]]")),
        ("c.md", "no front"), ("d.md", "---\nname: x\n"), ("e.md", leaf("alpha", "other words entirely", type_="odd")), ("f.md", leaf("fresh", "unrelated", "text\nmetadata:\n  name: a\n")),
    ]
    leaves = FA.parse_leaves(spark.createDataFrame(files, "leaf_path string, content string"))
    graph = sorted((r.src, r.target, r.dst) for r in FA.link_graph(leaves).collect() if r.src != "zz")
    assert [g for g in graph if g[2]] == [("a.md", "alpha", "a.md"), ("a.md", "beta", "b.md"), ("b.md", "a", "a.md")] and ("a.md", "Gone", None) in graph and len(graph) == 4
    row = lambda p, n, **k: {"leaf_path": p, "name": n, "status": "active", "type": "project", "description": "d", "hook": "h", "updated_at": "2026-01-01", "project": "p", **k}
    facts = spark.createDataFrame([row("a.md", "alpha", description="cache rollout latency budget plan"), row("b.md", "beta", description="cache rollout latency budget notes", hook="work in progress"), row("e.md", "alpha", description="other words entirely"), row("lost.md", "lost")], schema.FACTS)
    got = {(r.leaf_path, r.check_no): r.severity for r in FA.doctor(leaves, facts, "2026-06-01").collect()}
    for key, sev in {("a.md", 12): "warning", ("b.md", 13): "warning", ("b.md", 14): "warning", ("c.md", 3): "warning", ("d.md", 4): "warning", ("e.md", 7): "warning", ("e.md", 11): "error", ("f.md", 5): "warning", ("f.md", 15): "warning", ("lost.md", 1): "error"}.items():
        assert got.get(key) == sev, key
    assert ("a.md", 13) not in got and ("a.md", 15) not in got


def test_first_duplicates_equal_a_walk_over_all_pairs(spark):
    rng = random.Random(5)
    pick = lambda pool, k: [rng.choice(pool) for _ in range(rng.randint(0, k))]
    rows = [(f"{i:03d}.md", pick("mnopqr", 2), pick("xyz", 1), pick(["ab", "cd", "ef", "gh", "ij", "kl"], 4)) for i in range(400)]
    rows += [("400.md", None, None, None), ("401.md", ["m", None], ["x", None], [None]), (None, ["m"], ["x"], ["ab"])]
    want = {}
    for j, (b, nb, kb, tb) in enumerate(rows[:-1]):
        nb, kb, tb = ({x for x in v or () if x} for v in (nb, kb, tb))
        for a, na, ka, ta in rows[:j]:
            na, ka, ta = ({x for x in v or () if x} for v in (na, ka, ta))
            pct = len(ta & tb) * 100 // len(ta | tb) if ta and tb else 0
            if not na & nb and (ka & kb or pct >= 35):
                want[b] = (a, 0, None) if ka & kb else (a, 1, pct)
                break
    df = spark.createDataFrame(rows, "p string, n array<string>, k array<string>, t array<string>").repartition(7)
    got = FA.first_duplicates(df, "p", F.col("n"), F.col("k"), F.col("t"))
    assert {r.id: (r.of, r.how, r.pct) for r in got.collect()} == want and len(want) > 200
    assert FA.first_duplicates(df.limit(0), "p", F.col("n"), F.col("k"), F.col("t")).count() == 0


def test_first_duplicates_of_one_text(spark):
    """Equal texts cost a row each: as pairs these would be 80 million."""
    i = F.col("id").cast("string")
    d = spark.range(40_000).select("id", F.array(F.concat(F.lit("n"), i)).alias("n"), F.array(F.concat(F.lit("k"), i)).alias("k"), F.array(F.lit("cache"), F.lit("rollout")).alias("t"))
    got = FA.first_duplicates(d, "id", F.col("n"), F.col("k"), F.col("t"))
    assert tuple(got.agg(F.count(F.lit(1)), F.max("of"), F.min("pct"), F.max("how")).first()) == (39_999, 0, 100, 1)
    kept = FA._heads(d.select(F.lit("g").alias("g"), "id", F.col("n").alias("names"), F.lit(100).alias("pct")), 2)
    assert kept.count() <= 6


def test_index_budget_skips_and_goes_on(spark):
    rows = [{"project": "p", "leaf_path": f"{i}.md", "title": "t" * n, "hook": "", "type": "user", "index_seq": i, "status": "active", "pinned": 0, "hits": 0, "updated_at": "2026-01-01"} for i, n in enumerate((10, 60, 5, 1))]
    facts = spark.createDataFrame(rows, schema.FACTS)
    got = {r.leaf_path: r.included for r in FA.select_index(facts, budget=len(FA.HEADER) + 60).collect()}
    assert got == {"0.md": True, "1.md": False, "2.md": True, "3.md": True}
    assert FA.render_index(FA.select_index(facts, budget=10_000)).first().content.count("\n") == 2 + 4


def test_upsert_and_import(spark):
    text = "---\nname: 'X_y'\ndescription: \"new\"\npinned: true\n---\nb"
    leaves = FA.parse_leaves(spark.createDataFrame([("user_x.md", text), ("user_new_leaf.md", "---\ndescription: d\n---\n")], "leaf_path string, content string"))
    stored = spark.createDataFrame([{"leaf_path": "user_x.md", "name": "kept", "type": None, "title": "T", "hook": "old", "description": "old", "pinned": 0, "status": "archived", "hits": 3, "index_seq": 4}], schema.FACTS)
    old, new = FA.upsert(leaves, stored, now="n").orderBy(F.col("leaf_path").desc()).collect()
    # An archived fact is active again, a stored name stays, a hook that was the description follows it.
    assert (old["type"], old.title, old.hook, old.description, old.pinned, old.hits, old.name, old.status, old.index_seq) == ("user", "T", "new", "new", 0, 3, "kept", "active", 4)
    assert (new["name"], new.title, new.hook, new.index_seq, new.status) == (None, "user new leaf", "d", 5, "active")
    hand = FA.upsert(leaves, stored.withColumn("hook", F.lit("by hand")), now="n").where("leaf_path = 'user_x.md'").first()
    assert hand.hook == "by hand" and hand.kept_hand_hook
    lines = spark.createDataFrame([(0, "# h"), (1, "- [A](user_x.md) — hook"), (2, "- [Z](gone.md) - z")], "line_no int, value string")
    facts, summary = FA.import_index(leaves, FA.index_pointers(lines), stored.withColumn("pinned", F.lit(1)))
    got = {r.leaf_path: r for r in facts.collect()}
    assert (got["user_x.md"].title, got["user_x.md"].index_seq, got["user_x.md"].pinned, got["user_x.md"].status, got["user_x.md"].name) == ("A", 0, 1, "archived", "X_y")
    assert got["user_new_leaf.md"].title == "user new leaf" and got["user_new_leaf.md"].index_seq is None
    assert sorted(map(tuple, summary.collect())) == [("dangling", "gone.md", 1), ("orphan", "user_new_leaf.md", 1), ("type", "user", 2)]


def test_embeddings(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, "bb")], "turn_id long, text string")
    e = spark.createDataFrame([(4, "m", 2, [1.0, 0.0])], schema.EMBEDDINGS)
    new = embed.backfill(t, e, lambda xs: [[3.0, 4.0]] * len(xs), "m", 2)
    assert sorted((r.turn_id, [round(v, 3) for v in r.vec]) for r in new.collect()) == [(1, [0.6, 0.8]), (2, [0.6, 0.8])]
    assert embed.store(e, new, t).count() == 3 and tuple(stats.coverage(t, e, "m", 2).first()) == (3, 1, 2)
    assert embed.word_pieces("Unaffable, xyz", {"un": 0, "##aff": 1, "##able": 2, ",": 3}) == ["un", "##aff", "##able", ",", "[UNK]"]


def test_registered_queries_equal_their_sql(spark, sf):
    """A few of each kind; the driver compares all of them."""
    import duckdb

    from quarry.plans import queries as Q

    con = duckdb.connect()
    for name in ("documents", "conversations", "events", "part", "embeddings", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name in ("search_bm25", "recap_exchanges", "hours_merged", "facts_ranked", "redact_documents", "ingest_turns", "facts_doctor", "facts_upsert", "search_raw", "search_indexed"):
        df = Q.QUERIES[name](spark, sf)
        rel = con.execute(Q.SQL[name])
        cols = [c[0] for c in rel.description]
        assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect()), name


def test_archive_commits_whole_changes(spark, tmp_path):
    """Ingest, forget, mask, tag and merge, each a version; a writer that began too early is refused or begins again."""
    a = Archive(spark, f"file://{tmp_path}/a")
    a.create(turns_of(spark, [("s1", 0, "user", "password=hunter22 alpha-beta"), ("s2", 0, "user", "gamma")]).withColumn("turn_id", F.monotonically_increasing_id()))
    base = a.store.manifest()
    more = turns_of(spark, [("s1", 0, "user", "other"), ("s1", 1, "assistant", "more"), ("s3", 0, "user", "x")]).withColumn("turn_id", F.lit(7).cast("long"))
    assert a.ingest(more) == 2
    rows = lambda v=None: sorted((r.session_id, r.seq, r.text) for r in a.read("turns", v).collect())
    assert rows() == [("s1", 0, "password=hunter22 alpha-beta"), ("s1", 1, "more"), ("s2", 0, "gamma"), ("s3", 0, "x")]
    with pytest.raises(StaleWriter):
        a.store.write({"turns": a.read("turns").limit(0)}, base)
    with pytest.raises(ValueError):
        a.forget("s3", "2026")
    a.forget("s3", "2026", confirm=True)
    a.ingest(more)
    assert not [r for r in rows() if r[0] == "s3"] and {r.session_id for r in a.read("sessions").collect()} == {"s1", "s2"}
    a.redact()
    assert rows()[0][2] == "password=‹redacted› alpha-beta" and rows(1)[0][2].startswith("password=hunter22")
    a.retag(spark.createDataFrame([("s1",)], "session_id string"))
    assert "topic:alpha-beta" in {r.tag for r in a.read("tags").collect()}
    other = Archive(spark, f"file://{tmp_path}/b")
    other.create(turns_of(spark, [("s3", 0, "user", "no"), ("s4", 0, "user", "token=abcdefgh1234567890 yes")]).withColumn("turn_id", F.lit(9).cast("long")))
    a.merge(other)
    assert {r.session_id for r in a.read("sessions").collect()} == {"s1", "s2", "s4"} and a.read("turns").where("session_id = 's4'").count() == 1
    a.vacuum(1)
    assert len(rows()) == 4
    with pytest.raises(Exception):
        a.read("turns", 1)


def test_index_selection_in_rounds(spark):
    """Against the sequential rule, with one project that holds nearly all facts, lines of all lengths, ties and a null project."""
    rng = random.Random(3)
    rows = [("big" if rng.random() < 0.9 else rng.choice(["a", None]), f"l{i % 590}.md", "t", "h" * rng.choice([1, 5, 40, 200, 700]), rng.choice([0, 0, 0, 1]), rng.choice(["user", "note"]), rng.randrange(3), "2026", i, "active", None) for i in range(600)]
    f = spark.createDataFrame(rows, "project string, leaf_path string, title string, hook string, pinned int, type string, hits int, updated_at string, index_seq long, status string, superseded_at string")
    for budget, most in ((3000, 200), (900, 200), (20_000, 30), (60, 200), (5, 200)):
        ranked = sorted(FA.index_lines(f).collect(), key=lambda r: (r.project or "", r.place))
        want, state = Counter(), {}
        for r in ranked:
            used, n = state.get(r.project, (len(FA.HEADER), 2))
            if used + r.n_bytes <= budget and n < most:
                state[r.project] = used + r.n_bytes, n + 1
                want[r.project, r.line] += 1
        got = Counter((r.project, r.line) for r in FA.select_index(f, budget=budget, max_lines=most).where("included").collect())
        assert got == want and FA.select_index(f, budget=budget, max_lines=most).count() == 600
