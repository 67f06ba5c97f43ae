"""Curated facts: leaf files, upsert precedence, search, link graph, lint, index selection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import search
from quarry.session import shared_folder, ship

TYPES = ("user", "feedback", "project", "reference")
DUPLICATE_PCT = 35
STALE_DAYS = 60
BUDGET = 23000
MAX_LINES = 200
# Fixed value.
HEADER = "# Memory Index\n\n"
# Words of unfinished work, and lines that may follow a displaced frontmatter key.
STALE_CUES = r"(?i)\b(pending|wip|in[- ]progress|queued|uncommitted|unmerged|still open|to do|todo|tbd|next step|follow[- ]up|not yet)\b"
_AFTER_SPLICE = re.compile(r"^(?:---\s*$|\s+[A-Za-z_][\w-]*:|(?:metadata|originSessionId|node_type|name|type|description|pinned|tags):)")


# Leaf files.


def front(text: Column, key: str) -> Column:
    """First value of a key in the frontmatter, unquoted; null where there is none."""
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    v = F.trim(F.regexp_extract(head, rf"(?m)^[ \t]*{key}:[ \t]*(.*?)[ \t]*$", 1))
    v = F.regexp_replace(v, "^\"(.*)\"$|^'(.*)'$", "$1$2")
    return F.when(v != "", v)


def parse_leaves(files: DataFrame) -> DataFrame:
    """(leaf_path, content) to the leaf's own fields, body and content; ``error`` says why a file could not be read, if the input has it."""
    c = F.col("content")
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    closed = c.rlike(r"(?s)\A---[ \t]*\n(?:.*?\n)?---[ \t]*(?:\n|\z)")
    return files.select(
        "leaf_path", "content", "error", front(c, "name").alias("leaf_name"), front(c, "type").alias("leaf_type"), front(c, "description").alias("leaf_description"),
        front(c, "originSessionId").alias("leaf_origin"), front(c, "tags").alias("leaf_tags"), front(c, "pinned").alias("leaf_pinned"),
        c.startswith("---").alias("opens"), closed.alias("closes"),
        F.when(closed, F.regexp_replace(c, r"(?s)\A---[ \t]*\n(?:.*?\n)?---[ \t]*(?:\n|\z)", "")).otherwise(c).alias("body"),
    )


def index_pointers(lines: DataFrame) -> DataFrame:
    """(line_no, value) of an index to (leaf_path, title, hook, index_seq); a later line for a leaf replaces an earlier one's text."""
    pat = r"^- \[(.+?)\]\(([^)]+)\)\s*[—\-]\s*(.*)$"
    d = lines.where(F.col("value").rlike(pat)).select("line_no", *[F.regexp_extract("value", pat, i).alias(n) for i, n in ((1, "title"), (2, "leaf_path"), (3, "hook"))])
    d = d.withColumn("index_seq", F.row_number().over(Window.orderBy("line_no")) - 1)  # an index has MAX_LINES lines or so
    return d.groupBy("leaf_path").agg(*[F.max_by(c, "index_seq").alias(c) for c in ("title", "hook")], F.max("index_seq").cast("long").alias("index_seq"))


def guess_type(stem: Column) -> Column:
    """The type that a file name begins with, else reference."""
    out = F.lit("reference")
    for t in TYPES:
        out = F.when(stem.startswith(t), F.lit(t)).otherwise(out)
    return out


def type_weight(t: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(t, F.lit(""))))
    return F.when(x.isin("feedback", "user"), 40).when(x == "project", 20).when(x == "reference", 10).otherwise(15)


def _stem(leaf_path: str = "leaf_path") -> Column:
    return F.regexp_replace(leaf_path, r"\.md$", "")


def _said(c: Column | str) -> Column:
    """Null where there is nothing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def unquote(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^\"(.*)\"$|^'(.*)'$", "$1$2")


def drifted(leaf: Column, row: Column) -> Column:
    """Whether two descriptions, both given, differ."""
    return F.coalesce((F.trim(leaf) != "") & (F.trim(row) != "") & (unquote(leaf) != unquote(row)), F.lit(False))


def upsert(leaves: DataFrame, stored: DataFrame, flags: dict[str, str] | None = None, now: str = "", project: str | None = None) -> DataFrame:
    """The fact rows of parsed leaves, over the stored facts of one project.

    A flag wins; otherwise the type is the leaf's, the stored one or a guess, the title the stored one, the leaf's name or its stem.
    A hook that was only the description follows the leaf's description. A stored name is never rewritten; a stored fact becomes active
    again and keeps its place, pin, tags and origin; new ones go to the end of the project's order, by leaf.
    """
    g = {k: F.lit(v) for k, v in (flags or {}).items()}
    opt = lambda k: g.get(k, F.lit(None).cast("string"))
    kept = ("project", "name", "type", "title", "hook", "leaf_path", "description", "tags", "pinned", "hits", "created_at", "index_seq", "origin_session")
    s = stored.select(*[F.col(c).alias(f"s_{c}") for c in kept])
    d = leaves.join(s, F.col("leaf_path") == F.col("s_leaf_path"), "left")
    old = F.col("s_leaf_path").isNotNull()
    own = _said("s_hook").eqNullSafe(T.hook_cap(F.col("s_description"))) & _said("s_hook").isNotNull()
    hook = F.coalesce(opt("hook"), F.when(~(own & _said("leaf_description").isNotNull()), _said("s_hook")), F.col("leaf_description"), F.lit(""))
    top = stored.agg(F.coalesce(F.max("index_seq"), F.lit(-1)).alias("top"))
    fresh = d.where(~old).select("leaf_path", (F.row_number().over(Window.orderBy("leaf_path"))).alias("nth"))  # the leaves of one call
    d = d.join(fresh, "leaf_path", "left").join(F.broadcast(top))  # one row
    return d.select(
        F.coalesce("s_project", F.lit(project)).alias("project"), F.when(old, F.col("s_name")).otherwise(F.col("leaf_name")).alias("name"),
        F.coalesce(opt("type"), _said("leaf_type"), _said("s_type"), guess_type(_stem())).alias("type"),
        F.coalesce(opt("title"), _said("s_title"), F.replace(F.coalesce(_said("leaf_name"), _stem()), F.lit("_"), F.lit(" "))).alias("title"),
        T.hook_cap(hook).alias("hook"), "leaf_path", F.coalesce("leaf_description", "s_description").alias("description"), F.col("s_tags").alias("tags"),
        F.when(old, F.col("s_index_seq")).otherwise(F.col("top") + F.col("nth")).cast("long").alias("index_seq"),
        F.greatest(F.coalesce("s_pinned", F.lit(0)), F.lit(int("pin" in g))).alias("pinned"), F.lit("active").alias("status"),
        F.coalesce("s_hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("s_created_at", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"),
        F.lit(None).cast("string").alias("superseded_at"), F.coalesce(opt("origin_session"), "s_origin_session").alias("origin_session"),
        F.when(~old, F.lit("inserted")).otherwise(F.lit("updated")).alias("action"),
        (old & opt("hook").isNull() & _said("s_hook").isNotNull() & ~own & drifted(F.col("leaf_description"), F.col("s_description"))).alias("kept_hand_hook"),
    )


def import_index(leaves: DataFrame, pointers: DataFrame, stored: DataFrame | None = None, now: str = "", project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, summary): leaves with their index lines, merged with stored facts; counts by type, leaves without a line, lines without a leaf.

    A stored fact keeps its status, dates, hits and origin, and stays pinned once it was; all else is the leaf's.
    """
    d = leaves.join(pointers, "leaf_path", "left")
    listed = F.col("index_seq").isNotNull()
    facts = d.select(
        F.lit(project).cast("string").alias("project"), F.col("leaf_name").alias("name"), F.coalesce(_said(F.lower("leaf_type")), guess_type(_stem())).alias("type"),
        F.when(listed, F.col("title")).otherwise(F.coalesce(_said("leaf_name"), F.replace(_stem(), F.lit("_"), F.lit(" ")))).alias("title"),
        F.when(listed, F.col("hook")).otherwise(F.coalesce("leaf_description", F.lit(""))).alias("hook"), "leaf_path", F.col("leaf_description").alias("description"),
        F.col("leaf_tags").alias("tags"), "index_seq", F.lower(F.coalesce("leaf_pinned", F.lit(""))).isin("true", "yes", "1").cast("int").alias("pinned"),
        F.lit("active").alias("status"), F.lit(0).cast("long").alias("hits"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.col("leaf_origin").alias("origin_session"),
    )
    if stored is not None:
        keep = ("pinned", "status", "hits", "created_at", "origin_session")
        old = stored.select(F.col("leaf_path"), *[F.col(c).alias(f"s_{c}") for c in keep], F.lit(True).alias("s_here"))
        facts = facts.join(old, "leaf_path", "left")
        mine = {c: F.when(F.col("s_here"), F.col(f"s_{c}")).otherwise(F.col(c)) for c in keep if c != "pinned"}
        facts = facts.withColumns(mine | {"pinned": F.greatest(F.coalesce("s_pinned", F.lit(0)), "pinned")}).drop("s_here", *(f"s_{c}" for c in keep))
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), "what", "n")
    by_type = facts.groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    orphans = leaves.join(pointers, "leaf_path", "left_anti").select(F.col("leaf_path").alias("what"), F.lit(1).cast("long").alias("n"))
    dangling = pointers.join(leaves, "leaf_path", "left_anti").select(F.col("leaf_path").alias("what"), F.lit(1).cast("long").alias("n"))
    return facts, one("type", by_type).union(one("orphan", orphans)).union(one("dangling", dangling))


def with_status(facts: DataFrame, status: str = "active") -> DataFrame:
    active = (F.col("status") == "active") & F.col("superseded_at").isNull()
    return facts if status == "all" else facts.where(active if status == "active" else F.col("status") == status)


def listing(facts: DataFrame, status: str = "active") -> DataFrame:
    return with_status(facts, status).orderBy(F.col("pinned").desc(), F.col("index_seq").asc_nulls_last(), "leaf_path")


def find(facts: DataFrame, terms: list[str], limit: int = 10, status: str = "active", tokenizer=T.index_tokens) -> DataFrame:
    m = search.match_scores(facts, terms, tokenizer=tokenizer, text_cols=("title", "hook", "description"))
    return with_status(m, status).orderBy("score", "leaf_path").limit(limit)


def set_state(facts: DataFrame, leaf_path: str, now: str, **new) -> DataFrame:
    """Archive, pin or unpin: ``set_state(f, "x.md", now, status="archived")``."""
    hit = F.col("leaf_path") == leaf_path
    cols = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in new.items()}
    return facts.withColumns(cols | {"updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


# Index selection.


def index_order() -> list[Column]:
    """Pinned first, then by weight of the type, recency, hits and place."""
    return [
        F.coalesce("pinned", F.lit(0)).desc(), type_weight(F.col("type")).desc(), F.coalesce("updated_at", F.lit("")).desc(), F.coalesce("hits", F.lit(0)).desc(),
        F.coalesce("index_seq", F.lit(1 << 40)).asc(), F.col("leaf_path").asc(),
    ]


def index_lines(facts: DataFrame, include_orphans: bool = False) -> DataFrame:
    """Active facts with their index ``line``, ``n_bytes`` and ``place`` in their project."""
    return lines_of(facts, include_orphans).withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(*index_order())))


def lines_of(facts: DataFrame, include_orphans: bool = False) -> DataFrame:
    """Active facts with their index ``line`` and ``n_bytes``."""
    d = with_status(facts)
    if not include_orphans:
        d = d.where(F.col("index_seq").isNotNull() | (F.col("pinned") != 0))
    tail = F.when(F.coalesce("hook", F.lit("")) != "", F.concat(F.lit(" — "), "hook")).otherwise(F.lit(""))
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("leaf_path"), F.lit(")"), tail, F.lit("\n"))
    return d.withColumn("line", line).withColumn("n_bytes", F.octet_length("line"))


def select_index(facts: DataFrame, budget: int = BUDGET, include_orphans: bool = False, header: str = HEADER, max_lines: int = MAX_LINES) -> DataFrame:
    """(project, leaf_path, line, n_bytes, index_seq, included): per project, best facts first, each line that still fits goes in.

    In rounds: of the lines that are no longer than the room left, the best ones (as many as may still go in, so ``max_lines`` a project at
    most) go in up to the first that no longer fits. A line that was passed over is longer than the room, which only shrinks, so it
    never comes back. Each round takes a line or more in every project that is not done; few rounds are needed as few lines are passed over. Tasks keep
    their own best lines before any are sent, so no project is gathered.
    """
    spark = facts.sparkSession
    room, space = budget - len(header.encode()), max_lines - header.count("\n")
    folder = shared_folder(spark, "index-lines")
    keys = ["pinned", "type", "updated_at", "hits", "index_seq", "leaf_path"]
    d = lines_of(facts, include_orphans).select("project", *keys, "line", "n_bytes").withColumn("id", F.monotonically_increasing_id())
    d.write.parquet(f"{folder}/lines")
    d = spark.read.schema(d.schema).parquet(f"{folder}/lines")
    taken = spark.createDataFrame([], "project string, id long, n_bytes int").withColumn("project", F.col("project").cast(d.schema["project"].dataType))
    best = Window.partitionBy("project").orderBy(*index_order(), "id")
    so_far = best.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in range(max(0, space) if room > 0 else 0):
        used = taken.groupBy(F.col("project").alias("p")).agg(F.sum("n_bytes").alias("used"), F.count(F.lit(1)).alias("in"))
        left = d.select("project", *keys, "n_bytes", "id").join(used, F.col("project").eqNullSafe(F.col("p")), "left").drop("p")
        left = left.withColumns({"used": F.coalesce("used", F.lit(0)), "in": F.coalesce("in", F.lit(0))}).where(F.col("n_bytes") <= room - F.col("used"))
        left = left.join(taken.select("id"), "id", "left_anti").withColumn("k", F.row_number().over(best)).where((F.col("k") <= space) & (F.col("k") + F.col("in") <= space))
        new = left.withColumn("sum", F.sum("n_bytes").over(so_far)).where(F.col("sum") <= room - F.col("used")).select("project", "id", "n_bytes")
        new.write.parquet(f"{folder}/taken-{n:04d}")
        new = spark.read.schema(new.schema).parquet(f"{folder}/taken-{n:04d}")
        if new.isEmpty():
            break
        taken = taken.unionByName(new)
    out = d.join(taken.select("id", F.lit(True).alias("in")), "id", "left")
    return out.select("project", "leaf_path", "line", "n_bytes", F.col("index_seq").cast("long").alias("index_seq"), F.coalesce("in", F.lit(False)).alias("included"))


def render_index(selected: DataFrame, header: str = HEADER) -> DataFrame:
    """(project, content): the included lines in index order, at most MAX_LINES a project."""
    place = F.struct(F.coalesce("index_seq", F.lit(1 << 40)).alias("i"), "leaf_path", "line")
    lines = F.transform(F.sort_array(F.collect_list(place)), lambda x: x["line"])
    return selected.where("included").groupBy("project").agg(F.concat(F.lit(header), F.array_join(lines, "")).alias("content"))


# Links.


@F.pandas_udf(StringType())
def _unfenced(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: "\n".join(unfenced_lines(b or "")))


def unfenced_lines(body: str) -> list[str]:
    """Lines outside of fenced blocks: a fence is three or more ` or ~, indented three at most, closed by as many of the same."""
    out, fence = [], None
    for line in body.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        else:
            out.append(line)
    return out


def links(leaves: DataFrame) -> DataFrame:
    """(src, target): [[wiki links]] outside of fences, one per lower-case form."""
    d = leaves.withColumn("_b", _unfenced("body"))
    found = T.dedupe_first(F.transform(F.regexp_extract_all("_b", F.lit(r"\[\[([^\[\]\n]+)\]\]"), 1), lambda x: F.trim(x)))
    return d.select(F.col("leaf_path").alias("src"), F.explode(found).alias("target")).where("target <> ''")


def link_key(target: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(target), r"(?:\.md)+$", ""))


def link_graph(leaves: DataFrame) -> DataFrame:
    """(src, target, dst): each link and the leaf it names, by name first, else by file stem; null where it dangles."""
    stem = F.lower(_stem())
    names = leaves.where("leaf_name is not null").groupBy(F.lower("leaf_name").alias("k")).agg(F.min("leaf_path").alias("by_name"))
    stems = leaves.groupBy(stem.alias("k")).agg(F.min("leaf_path").alias("by_stem"))
    e = links(leaves).withColumn("k", link_key(F.col("target")))
    return e.join(names, "k", "left").join(stems, "k", "left").select("src", "target", F.coalesce("by_name", "by_stem").alias("dst"))


# Lint.


def jaccard_pairs(df: DataFrame, id_col: str, terms: Column, pct: int = DUPLICATE_PCT) -> DataFrame:
    """(a, b, pct): pairs a < b whose term sets share ``pct`` percent (integer division) of their union.

    Prefix filter: with terms in order of rarity, two sets that share enough must share one of their first
    size - ceil(pct/100 * size) + 1 terms, so only those are joined on. A pair is made at the first such term alone, if the sizes and
    what follows that term in both leave room for enough shared terms, and verified there. ``first_duplicates`` needs no pairs of equal sets.
    """
    d = df.select(F.col(id_col).alias("id"), F.array_distinct(terms).alias("ts")).where(F.size("ts") > 0)
    freq = d.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    order = d.select("id", F.explode("ts").alias("t")).join(freq, "t").groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("ts")
    )
    keep = F.size("ts") - F.ceil(F.size("ts") * F.lit(pct) / 100.0).cast("int") + 1
    post = order.select("id", "ts", keep.alias("keep"), F.posexplode(F.slice("ts", F.lit(1), keep)).alias("at", "t"))
    na, nb = F.size("a.ts"), F.size("b.ts")
    room = F.least(na - F.col("a.at"), nb - F.col("b.at"))
    enough = lambda n: n * (100 + pct) >= F.lit(pct) * (na + nb)
    first = F.get(F.array_intersect(F.slice("a.ts", F.lit(1), F.col("a.keep")), F.slice("b.ts", F.lit(1), F.col("b.keep"))), F.lit(0)) == F.col("a.t")
    pairs = post.alias("a").join(post.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & enough(room) & first)
    shared = F.size(F.array_intersect("a.ts", "b.ts"))
    p = F.floor(shared * 100 / (na + nb - shared)).cast("int")
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), p.alias("pct")).where(F.col("pct") >= pct)


def _meets_all(kept: list[frozenset], never: frozenset, most: int, picks: frozenset = frozenset()) -> bool:
    """Whether ``most`` names or fewer, none of them in ``never``, take one name or more from every set in ``kept``."""
    free = next((s for s in kept if not s & picks), None)
    if free is None:
        return True
    return len(picks) < most and any(_meets_all(kept, never, most, picks | {n}) for n in free - never)


def _heads(members: DataFrame, most: int) -> DataFrame:
    """Of each group ``g`` the members (g, id, names, pct) that may be the least one without certain names, whatever these are.

    In ascending order a member stays if some ``most`` names, not its own, occur in all that stay already: only a leaf with these
    names can want it. No more than binomial(2 * most, most) can stay (six, with two names a leaf). What stays of parts of a
    group stays for the whole, so tasks thin their own members before any are sent.
    """
    ship(members.sparkSession)

    def thin(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in rows:
            names = frozenset(r[1])
            if _meets_all([k[3] for k in kept], names, most):
                kept.append((*r[:3], names))
        return [k[:3] for k in kept]

    def frame(groups: dict) -> pd.DataFrame:
        return pd.DataFrame([(g, *r) for g, rs in groups.items() for r in rs], columns=["g", "id", "names", "pct"])

    def here(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict = {}
        for part in parts:
            for g, i, names, pct in part.itertuples(index=False):
                old = groups.get(g, [])
                groups[g] = thin(sorted([*old, (i, tuple(names), pct)])) if old else [(i, tuple(names), pct)]
            if len(groups) > 50_000:  # bounded memory; the rest is done after the shuffle
                yield frame(groups)
                groups = {}
        yield frame(groups)

    def sorted_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for part in parts:
            done: dict = {}
            for g, i, names, pct in part.itertuples(index=False):
                if g != now:
                    if kept:
                        done[now] = kept
                    now, kept = g, []
                kept = thin([*kept, (i, tuple(names), pct)])
            yield frame(done)
        if kept:
            yield frame({now: kept})

    kind = members.schema["id"].dataType.simpleString()
    schema = f"g string, id {kind}, names array<string>, pct int"
    d = members.select("g", "id", "names", F.col("pct").cast("int").alias("pct")).mapInPandas(here, schema)
    return d.repartition("g").sortWithinPartitions("g", "id").mapInPandas(sorted_groups, schema)


def first_duplicates(df: DataFrame, id_col: str, names: Column, keys: Column, terms: Column, pct: int = DUPLICATE_PCT, most_names: int = 2) -> DataFrame:
    """(id, of, how, pct): per row the least earlier id that shares a key with it (how 0, pct null) or ``pct`` percent of the terms (how 1).

    Rows with a name in common do not count; a row has ``most_names`` names at most. Without pairs of rows: rows of one
    term set are one class, only classes are compared, and of a class and all classes near it the few heads are kept. So n rows of one text
    cost n rows. Null ids are left out, null names, keys and terms are none; repeated ids are one row each.
    """
    none = F.array().cast("array<string>")
    clean = lambda c: F.coalesce(F.array_distinct(F.filter(c.cast("array<string>"), lambda x: x.isNotNull())), none)
    d = df.select(F.col(id_col).alias("id"), clean(names).alias("names"), clean(keys).alias("keys"), F.array_sort(clean(terms)).alias("ts")).where("id is not null")
    d = d.withColumn("c", F.when(F.size("ts") > 0, F.sha2(F.to_json("ts"), 256)))
    folder = shared_folder(df.sparkSession, "duplicates")

    def cut(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")

    d = cut(d, "rows")  # read several times, as are near classes and their heads
    keyed = d.select("id", "names", F.explode("keys").alias("g"))
    by_key = _heads(keyed.withColumn("pct", F.lit(None).cast("int")), most_names)
    termed = d.where("c is not null").select("id", "names", F.col("c").alias("g"), "ts")
    near = cut(jaccard_pairs(cut(termed.groupBy("g").agg(F.any_value("ts").alias("ts")), "classes"), "g", F.col("ts"), pct), "near")
    near = near.union(near.select("b", "a", "pct"))
    own = cut(_heads(termed.withColumn("pct", F.lit(100)), most_names), "heads")
    others = near.join(own.select(F.col("g").alias("b"), "id", "names"), "b").select(F.col("a").alias("g"), "id", "names", "pct")
    by_terms = _heads(own.unionByName(others), most_names)

    def found(rows: DataFrame, heads: DataFrame, how: int) -> DataFrame:
        h = heads.select("g", F.col("id").alias("of"), F.col("names").alias("theirs"), "pct")
        d = rows.select("g", "id", "names").join(h, "g").where((F.col("of") < F.col("id")) & ~F.arrays_overlap("names", "theirs"))
        return d.select("id", F.struct("of", F.lit(how).alias("how"), "pct").alias("m"))

    best = found(keyed, by_key, 0).union(found(termed, by_terms, 1)).groupBy("id").agg(F.min("m").alias("m"))
    return best.select("id", "m.of", "m.how", "m.pct")


@F.pandas_udf(BooleanType())
def _spliced(bodies: pd.Series) -> pd.Series:
    """Whether another frontmatter seems spliced into the body: it begins with ---, or shows a displaced tail."""

    def bad(b: str) -> bool:
        ls = unfenced_lines(b or "")
        tail = any(x.startswith(("metadata:", "originSessionId:")) and _AFTER_SPLICE.match(y) for x, y in zip(ls, ls[1:]))
        return ls[:1] != [] and ls[0].rstrip() == "---" or tail

    return bodies.map(bad)


def doctor(leaves: DataFrame, facts: DataFrame, now: str, duplicates: bool = True) -> DataFrame:
    """(leaf_path, check_no, severity, message), in leaf and check order. ``leaves`` are parsed; ``facts`` of one project.

    Check 13 writes tables of its own; without ``duplicates`` it is left out.
    """
    d = leaves.withColumn("spliced", _spliced("body")).join(facts, "leaf_path", "full_outer")
    listed, row = F.col("content").isNotNull() | F.col("error").isNotNull(), F.col("status").isNotNull()
    here = F.col("content").isNotNull() & F.col("error").isNull()
    ours = F.coalesce(F.col("status") == "active", F.lit(False))
    hard, soft = F.when(ours, F.lit("error")).otherwise(F.lit("warning")), F.lit("warning")
    fine = here & F.col("opens") & F.col("closes")
    known = lambda c: F.lower(c).isin(*TYPES)
    missing = F.concat_ws(", ", *[F.when(F.col(f"leaf_{k}").isNull(), F.lit(k)) for k in ("name", "description", "type")])
    age = F.datediff(F.try_to_date(F.lit(now[:10])), F.try_to_date(F.substring("updated_at", 1, 10)))
    checks = [
        (1, hard, ~listed, F.lit("leaf file missing")),
        (2, hard, F.col("error").isNotNull(), F.concat(F.lit("leaf unreadable: "), "error")),
        (3, hard, here & ~F.col("opens"), F.lit("no frontmatter")),
        (4, hard, here & F.col("opens") & ~F.col("closes"), F.lit("frontmatter never closes")),
        (5, hard, fine & F.col("spliced"), F.lit("splice debris in body")),
        (6, hard, fine & (missing != ""), F.concat(F.lit("missing "), missing)),
        (7, soft, here & ~F.coalesce(known(F.col("leaf_type")), F.lit(True)), F.concat(F.lit("unknown leaf type "), "leaf_type")),
        (8, soft, here & row & ~F.coalesce(known(_said("type")), F.lit(True)), F.concat(F.lit("unknown row type "), "type")),
        (9, soft, here & row & (F.lower("leaf_name") != F.lower(_said("name"))), F.concat(F.lit("name differs: "), "leaf_name", F.lit(" / "), "name")),
        (10, soft, here & ours & drifted(F.col("leaf_description"), F.col("description")), F.lit("description differs")),
        (14, soft, here & ours & (F.lower("type") == "project") & F.col("hook").rlike(STALE_CUES) & (age > STALE_DAYS),
            F.concat(F.lit("may be stale: "), F.lower(F.regexp_extract("hook", STALE_CUES, 1)))),
        (15, soft, here & ~row, F.lit("not registered")),
    ]
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check_no"), s.alias("severity"), m.alias("message"))) for n, s, c, m in checks]), lambda x: x.isNotNull())
    out = d.select("leaf_path", F.explode(hits).alias("x")).select("leaf_path", "x.check_no", "x.severity", "x.message")

    # A leaf claims a slug by its own name and by its row's, which upsert never rewrites.
    names = F.filter(F.array_distinct(F.array(F.lower("leaf_name"), F.lower("name"))), lambda x: x.isNotNull() & (x != ""))
    d = d.withColumns({"names": names, "ours": ours})
    claims = d.where(here).select("leaf_path", "ours", F.explode("names").alias("slug"))
    first = claims.groupBy("slug").agg(F.min("leaf_path").alias("first"), F.min(F.when(F.col("ours"), F.col("leaf_path"))).alias("first_active"))
    c = claims.join(first, "slug").where(F.col("leaf_path") != F.col("first"))
    clash = F.col("ours") & F.coalesce(F.col("first_active") < F.col("leaf_path"), F.lit(False))
    owner = F.when(clash, F.col("first_active")).otherwise(F.col("first"))
    dup = c.select("leaf_path", F.lit(11).alias("check_no"), F.when(clash, F.lit("error")).otherwise(soft).alias("severity"), F.concat(F.lit("duplicate name "), "slug", F.lit(", also "), owner).alias("message"))

    stems = d.select(F.lower(_stem()).alias("k")).union(d.select(F.explode("names"))).distinct()
    wanted = links(leaves.where("error is null")).withColumn("k", link_key(F.col("target"))).join(stems, "k", "left_anti")
    dangling = wanted.select(F.col("src").alias("leaf_path"), F.lit(12).alias("check_no"), soft.alias("severity"), F.concat(F.lit("dangling link "), "target").alias("message"))

    out = out.union(dup).union(dangling)
    if not duplicates:
        return out.orderBy("leaf_path", "check_no")
    live = d.where(here & F.col("ours"))
    terms = F.transform(T.extract_terms(F.coalesce("leaf_description", F.lit(""))), lambda t: F.regexp_replace(F.lower(t), r"\.+$", ""))
    fold = lambda x: F.replace(x, F.lit("_"), F.lit("-"))
    folded = F.transform(F.concat("names", F.array(F.lower(_stem()))), fold)
    # A pair with one exact name is a duplicate name already.
    similar = first_duplicates(live, "leaf_path", F.col("names"), folded, terms)
    why = F.when(F.col("how") == 0, F.lit("names differ only by - and _")).otherwise(F.concat(F.lit("descriptions share "), F.col("pct").cast("string"), F.lit("% of terms")))
    similar = similar.select(F.col("id").alias("leaf_path"), F.lit(13).alias("check_no"), soft.alias("severity"), F.concat(F.lit("possible duplicate of "), "of", F.lit(": "), why).alias("message"))
    return out.union(similar).orderBy("leaf_path", "check_no")


def doctor_totals(findings: DataFrame) -> DataFrame:
    """(errors, warnings) of a doctor's findings."""
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
