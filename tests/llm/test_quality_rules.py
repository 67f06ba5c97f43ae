from quarry.llm import quality_rules as qr


def test_measures_and_policies(spark):
    a, b = "one two three one two three four", "w " * 60
    rows = [(1, a, "x", 9), (2, None, "x", 9), (3, "", "x", 9), (4, b, "x", 9), (5, "A B\n\nA B\n \t\nc", "x", 9), (5, "A B\n\nA B\n \t\nc", "x", 9), (6, "a b   é😀 #$|", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, n_words int")
    led = {r.doc_id: r for r in qr.ledger(df).collect()}
    assert (led[1].n_words, led[1].n_repeat_words, led[1].word_chars) == (7, 6, 26)
    assert (led[4].n_words, led[4].n_repeat_words) == (60, 60) and led[4].failed & 3 == 2
    assert (led[2].n_words, led[2].failed & 1, led[3].failed, led[2].extra) == (0, 1, led[2].failed, "x")
    assert (led[5].n_dup_lines, led[5].n_lines, led[5].n_words) == (1, 3, 5)
    assert (led[6].n_words, led[6].word_chars, led[6].n_symbols) == (4, 9, 3)
    assert qr.ledger(df.limit(0)).count() == 0
    assert qr.ledger(df).count() == 7
    assert [r.doc_id for r in qr.filter_documents(df).collect()] == []


def test_ablation_counts_from_bits(spark):
    bits = [0, 1, 1, 3, 2, 4, 5]
    led = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id long, failed long")
    got = {r.rule: (r.n_failed, r.n_only) for r in qr.ablation(led, "v1").collect()}
    for k, name in enumerate(qr.RULES):
        assert got.get(name, (0, 0)) == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))
    base = {r.rule: (r.n_failed, r.n_only) for r in qr.ablation(led, "base").collect()}
    assert base["few_words"] == (4, 3) and base["repeated_words"] == (2, 1)
    assert [r.doc_id for r in led.where(qr.passes("base")).collect()] == [0, 5]


def test_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(20000))
    r = qr.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words) == (20000, 20000)


def test_texts_without_repeats_are_not_sorted(spark):
    """All windows differ: their hashes tell, and nothing else is built."""
    rows = [(1, " ".join(f"w{i}" for i in range(300))), (2, "a b c d a b c"), (3, "a b c d"), (4, "a\x0bb \x0b\n\x0b\n\x0c\nc\x85d # |")]
    led = qr.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "array_distinct(lambda " in led._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r for r in led.collect()}
    assert [got[i].n_repeat_words for i in (1, 2, 3, 4)] == [0, 6, 0, 0]
    assert (got[4].n_words, got[4].word_chars, got[4].n_symbols, got[4].n_lines) == (5, 7, 2, 2)
