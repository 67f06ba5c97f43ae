import random
import re
import time
from collections import defaultdict

from quarry.llm import chat_quotes as cq, queries


def brute(rows):
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    told, parsed = defaultdict(dict), []
    for conv, turn, role, text in rows:
        lines = []
        for raw in (text or "").split("\n"):
            m = re.match(r"(?:[ \t]*>)+", raw)
            lines.append((m[0].count(">"), re.sub(r"^(?:[ \t]*>)+[ \t]?", "", raw)) if m else (0, raw))
        if any(lv for lv, _ in lines):
            own = [x for i, (lv, x) in enumerate(lines) if lv == 0 and not (re.match(cq.ANNOUNCES, x) and i + 1 < len(lines) and lines[i + 1][0] > 0)]
            body = "\n".join(own).strip()
        else:
            body = text or ""
        parsed.append((conv, turn, role, body, lines))
        if conv is not None and turn is not None:
            for u in [body, *re.split(r"\n\s*\n", body), *body.split("\n")]:
                if k := norm(u):
                    told[conv][k] = min(told[conv].get(k, turn), turn)
    score = defaultdict(lambda: defaultdict(int))
    for conv, turn, role, body, lines in parsed:
        units = [x for x in lines if x[0] > 0]
        i = 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j][0] == lines[i][0]:
                j += 1
            if lines[i][0] > 0 and j - i > 1:
                units.append((lines[i][0], "\n".join(x for _, x in lines[i:j])))
            i = j
        for lv, u in units:
            src = told[conv].get(norm(u))
            if conv is not None and turn is not None and norm(u) and src is not None and src < turn:
                score[conv, turn][lv, src] += len(norm(u))
    parent = {k: max(v, key=lambda x: (-x[0], v[x], x[1]))[1] for k, v in score.items()}
    out = []
    for conv, turn, role, body, lines in parsed:
        top, depth = turn, 0
        while (conv, top) in parent:
            top, depth = parent[conv, top], depth + 1
        out.append((conv, turn, role, body, sum(lv > 0 for lv, _ in lines), max(lv for lv, _ in lines), parent.get((conv, turn)), top, depth))
    return sorted(out, key=str)


def rows_of(df):
    """Rows without their positions, which are checked here: the places by (thread, turn, body) in each conversation."""
    rows = [tuple(r) for r in df.collect()]
    by_conv = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            assert r[9] is None
        else:
            by_conv.setdefault(r[0], []).append(r)
    for own in by_conv.values():
        own.sort(key=lambda r: r[9])
        assert [r[9] for r in own] == list(range(len(own)))
        assert [(r[7], r[1], r[3].encode()) for r in own] == sorted((r[7], r[1], r[3].encode()) for r in own)
    return sorted((r[:9] for r in rows), key=str)


def planted():
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice("red green Blue old new fast slow cat dog".split()) for _ in range(rng.randrange(2, 9)))
    rows = []
    for conv in range(40):
        texts = []
        for turn in range(rng.randrange(1, 9)):
            own = "\n".join([say(), *(["", say()] if rng.random() < 0.4 else [])])
            if texts and rng.random() < 0.8:
                src = rng.choice(texts).split("\n")
                part = src if rng.random() < 0.6 else src[-1:]
                head = ["On Monday A. Body wrote:"] if rng.random() < 0.5 else []
                own = "\n".join(head + [rng.choice(["> ", ">", " >"]) + x for x in part] + ["", own])
            texts.append(own)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), own))
    return rows


def test_planted_quotes(spark):
    rows = planted()
    want = brute(rows)
    assert max(r[8] for r in want) >= 3 and max(r[5] for r in want) >= 3
    got = rows_of(cq.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == want
    assert not any(line.lstrip().startswith(">") for r in got for line in r[3].split("\n"))


def test_sql_on_planted_quotes(spark, tmp_path):
    import duckdb

    rows = planted()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted((r[:9] for r in con.execute(queries.SQL["op3_quotation_links"]).fetchall()), key=str) == brute(rows)


def test_many_lines_in_a_message(spark):
    """Eighty thousand lines in seconds."""
    text = "> a\n>> b\nown\n" * 27_000
    t = time.time()
    r = cq.link(spark.createDataFrame([(1, 0, "u", text)], "conv_id long, turn long, role string, text string")).first()
    assert (r.n_quoted_lines, r.max_level, r.position) == (54_000, 2, 0) and time.time() - t < 60


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 2, "u", "> nobody said this"), (None, 1, "u", "hello"), (None, 2, "u", "> hello"), (2, None, "u", "> x"), (2, 0, "u", "x"),
            (2, 1, "u", ">x"), (2, 1, "u", ">x"), (3, 0, "u", "line\n" * 4000), (3, 1, "u", "> line\n" * 60 + "yes"), (4, 5, "u", ">>>"), (4, 6, "u", "> > deep\n>> deep\n> x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    assert rows_of(cq.link(df)) == brute(rows)
    assert cq.link(df.limit(0)).count() == 0
    assert cq.formatted(cq.link(df)).where("chat is null").count() == 0
