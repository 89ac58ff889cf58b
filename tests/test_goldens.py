"""Operators against known cases: fiscal periods, merges, cells, bindings, gates, items, stubs, blocks, Markdown, runs, streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import functions, sources
from ledgerloom.operators import agents, blocks, fundamentals, headings, landing, markdown, scoring, sections, statements, tracking
from ledgerloom.streaming import lifecycle, sessions


def one(spark, column, **values):
    """The value of a column expression over one row of ``values``."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())).select(column).first()[0]


def test_fiscal_periods(spark):
    given = [(9, "2024-06-30", 2024, 3), (9, "2024-09-28", 2024, 4), (9, "2024-12-31", 2025, 1), (12, "2024-03-31", 2024, 1), (12, "2024-12-31", 2024, 4), (6, "2024-06-30", 2024, 4), (6, "2024-09-30", 2025, 1)]
    given += [(1, "2024-01-28", 2024, 4), (1, "2024-04-30", 2025, 1), (1, "2025-01-31", 2025, 4), (9, "2024-07-15", None, None), (9, "2024-11-30", None, None), (0, "2024-03-31", None, None), (13, "2024-03-31", None, None)]
    df = spark.createDataFrame([(m, datetime.date.fromisoformat(d), y, q) for m, d, y, q in given], "fye int, end date, y int, q int")
    for r in df.select("*", functions.fiscal_year(F.col("end"), F.col("fye")).alias("fy"), functions.fiscal_quarter(F.col("end"), F.col("fye")).alias("fq")).collect():
        assert r.fq == r.q and (r.fy == r.y or r.q is None)


def test_merge_keeps_other_columns(spark):
    base = spark.createDataFrame([("A", 1, 10, 20), ("B", 1, 5, 6)], "t string, y int, product long, rpo long").withColumn("total", F.lit(None).cast("long"))
    feed = spark.createDataFrame([("A", 1, 99), ("C", 1, 7)], "t string, y int, total long")
    got = {r.t: (r.product, r.rpo, r.total) for r in fundamentals.merge_columns(base, feed, ["t", "y"], ["total"]).collect()}
    assert got == {"A": (10, 20, 99), "B": (5, 6, None), "C": (None, None, 7)}


def test_cells(spark):
    want = {"": (None, None, None), "true": (True, None, None), "FALSE": (False, None, None), "12": (None, 12.0, None), "1_000": (None, 1000.0, None), "1d": (None, None, "1d"), "  ": (None, None, "  "), "0.20": (None, 0.2, None), "1__0": (None, None, "1__0"), "inf": (None, float("inf"), None)}
    df = spark.createDataFrame([(k,) for k in want], "cell string")
    got = {r.cell: (r.as_bool, r.as_double, r.as_string) for r in df.select("cell", *(c.alias(n) for n, c in sources.auto_typed(F.col("cell")).items())).collect()}
    assert got == want
    assert one(spark, sources.reject_reason(F.col("c"), "json"), c="[1,") == "not json" and one(spark, sources.reject_reason(F.col("c"), "json"), c="[1]") is None
    with pytest.raises(ValueError):
        sources.reject_reason(F.col("c"), "date")


def test_mapping_paths():
    for bad in ("", "input..x", "other.x", "input. x"):
        with pytest.raises(ValueError):
            sources.mapped({"a": bad})


def test_datasets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid,text\n1,"two\nlines, ""quoted"""\n', encoding="utf-8")
    assert sources.dataset(spark, str(tmp_path / "a.csv"), ["id", "text"]).first().text == 'two\nlines, "quoted"'
    with pytest.raises(ValueError, match="lacks"):
        sources.dataset(spark, str(tmp_path / "a.csv"), ["other"])
    (tmp_path / "b.csv").write_text("id,text\n")
    with pytest.raises(ValueError, match="no rows"):
        sources.dataset(spark, str(tmp_path / "b.csv"), ["id"])


def test_documented_schemas(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    known = sources.documented(df, {"a": "first", "b": "second"})
    assert known.schema["a"].metadata == {"comment": "first"}
    assert sources.schema_differences(known, sources.documented(df.withColumn("q", F.lit(1)), {"a": "first", "b": "other", "q": "quarter"}), {"q"}) == [("b", "int", "other"), ("b", "int", "second")]
    with pytest.raises(ValueError):
        sources.documented(df, {"a": "first"})


def scores(spark, ranks_hit, n_expected, same_path=False):
    results = spark.createDataFrame([("q", k, f"P{k} / x" if not same_path else "P / x", f"text {k}") for k in range(1, 11)], "query_id string, rank int, header_path string, text string")
    paths = [f"P{k} /" for k in ranks_hit] + ["none"] * (n_expected - len(ranks_hit))
    expected = spark.createDataFrame([("q", i, p, "") for i, p in enumerate(paths)], "query_id string, entry int, path string, snippet string")
    return scoring.bound_scores(results, expected).first()


def test_retrieval_scores(spark):
    assert scores(spark, [1, 2], 3).recall_5 == pytest.approx(2 / 3)
    assert scores(spark, [1], 5).recall_5 == pytest.approx(0.2)
    assert scores(spark, [1, 3], 2).average_precision == pytest.approx(0.8333, abs=1e-4)
    assert scores(spark, [2, 4], 2).average_precision == pytest.approx(0.5)
    assert scores(spark, [1], 3).average_precision == pytest.approx(1 / 3) and scores(spark, [3], 1).reciprocal_rank == pytest.approx(1 / 3)
    none = scores(spark, [], 2)
    assert (none.recall_5, none.reciprocal_rank, none.average_precision) == (0, 0, 0)


def test_one_chunk_serves_one_entry(spark):
    results = spark.createDataFrame([("q", 1, "P / a", "The Text"), ("q", 2, "P / b", "other")], "query_id string, rank int, header_path string, text string")
    expected = spark.createDataFrame([("q", 0, "P", "the text"), ("q", 1, "P / a", ""), ("q", 2, "P", "")], "query_id string, entry int, path string, snippet string")
    got = scoring.bound_scores(results, expected).first()
    assert got.recall_5 == pytest.approx(2 / 3) and got.average_precision == pytest.approx((1 + 2 / 2) / 3)
    assert [tuple(r) for r in scoring.hits(results, expected).orderBy("entry", "rank").collect()] == [("q", 0, 1), ("q", 1, 1), ("q", 2, 1), ("q", 2, 2)]


@pytest.mark.parametrize(
    ("cases", "floors", "status", "cause"),
    [
        ([("a", None, {"s": 1.0}, [])], [("s", 1.0)], "green", None),
        ([("a", None, {"s": 1.0}, []), ("b", None, {"s": 0.0}, [])], [("s", 0.6)], "red", "s: below floor"),
        ([("a", None, {"s": 1.0}, []), ("b", None, {}, [])], [("s", 1.0)], "green", None),
        ([("a", None, {}, [])], [("s", 1.0)], "red", "s: all cases skipped"),
        ([("a", None, {}, ["s"])], [("s", 1.0)], "red", "s: all cases errored"),
        ([("a", None, {}, ["s"]), ("b", None, {}, [])], [("s", 1.0)], "red", "s: every case errored or skipped"),
        ([("a", "boom", {}, []), ("b", None, {"s": 1.0}, [])], [("s", 1.0)], "red", "crashed: 1"),
        ([("a", "boom", {}, [])], [("s", 1.0)], "red", "crashed: 1"),
        ([], [("s", 1.0)], "red", "no cases"),
        ([("a", None, {"s": 1.0}, [])], [], "red", "no gated scorer"),
    ],
)
def test_gates(spark, cases, floors, status, cause):
    c = spark.createDataFrame([("x", *r) for r in cases], "scenario string, case_id string, task_error string, scores map<string,double>, scorer_errors array<string>")
    s = spark.createDataFrame([("x", *r) for r in floors], "scenario string, scorer string, floor double")
    got = scoring.gate(spark.createDataFrame([("x",)], "scenario string"), c, s).first()
    assert (got.status, got.failures) == (status, cause or "")


def test_row_subsets(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in scoring.selected(rows, ["b", " a", "z", "b"]).orderBy("pos").collect()] == [(0, "b", "found"), (1, "a", "found"), (2, "z", "unknown"), (3, "b", "repeated")]
    with pytest.raises(ValueError):
        scoring.selected(rows, ["a", " "])


def test_item_keys(spark):
    for raw, want in (("Item 1A.", "1a"), ("7", "7"), (" item 9c. ", "9c"), ("Item 17", None), ("Signatures", None)):
        assert one(spark, sections.strict_key(F.col("c")), c=raw) == want
    for raw, want in (("part_ii_item_7a", "7a"), ("Item 7A", "7a"), ("toc", None)):
        assert one(spark, sections.name_key(F.col("c")), c=raw) == want
    assert one(spark, sections.path_item(F.col("c")), c="Part I / Item 9A(T). Controls / x") == "Item 9A(T)" and one(spark, sections.path_item(F.col("c")), c="Cover") == "_unknown"


def test_boundaries(spark):
    first = lambda text, item: one(spark, sections.trim_to_item(F.col("c"), F.lit(item)), c=text)
    second = lambda text, item: one(spark, sections.trim_structural(F.col("c"), F.lit(item)), c=text)
    assert first("Item 11. Pay\nbody  Item 12. Next", "11") == "Item 11. Pay\nbody" and first("Item 11. see item 11. and 5.4", "11") == "Item 11. see item 11. and 5.4"
    for text, item, want in (
        ("Item 7. A\nsee Item 1A. Risk\nItem 8. B", "7", "Item 7. A\nsee Item 1A. Risk"),
        ("Item 9C. A ok53PART IIIItem 10. B", "9c", "Item 9C. A ok53"),
        ('x "Item 1. Business" (Item 2. y) LineItem 3. z', "7", 'x "Item 1. Business" (Item 2. y) LineItem 3. z'),
        ("a reference.Item 12. B", "11", "a reference."),
        ("  Item 5. B", "4", ""),
    ):
        assert second(text, item) == want


def test_stubs(spark):
    real = "Incorporated by reference. " + "Real words about the business follow here and go on. " * 4
    for text, v1, v2 in (
        ("Item 6. [ Reserved ]", True, True),
        ("The information is incorporated herein by reference to the proxy.", True, True),
        (real, False, False),
        ("Refer to the Market Risk Management section of the report.", False, True),
        ("None", False, False),
        ("", False, False),
    ):
        assert one(spark, sections.stub(F.col("c"))["is_stub"], c=text) is v1 and one(spark, sections.stub(F.col("c"), sections.POINTERS)["is_stub"], c=text) is v2


def test_empty_filings_are_rejected(spark):
    s = spark.createDataFrame([(1, 0, "Item 1", "Item 1. x"), (2, 0, "toc", "y"), (2, 1, "Item 6", "[Reserved]")], "filing_id long, seq long, name string, text string")
    assert [tuple(r) for r in sections.parsed_items(s).select("filing_id", "item", "ord").collect()] == [(1, "1", 1)]


def test_blocks_lose_no_line(spark):
    prose = "This is a long line of prose that says enough to follow a heading, as a paragraph does in a report."
    texts = [(1, 10, f"before\nFirst Part\n{prose}\nSecond Part\n{prose}"), (1, 11, "nothing here"), (1, 12, f"{'x ' * 1600}\nFirst Part\n{prose * 120}\nSecond Part\n{prose}")]
    rows = blocks.prepared(spark.createDataFrame(texts, "filing_id long, item_id long, text string"))
    md = spark.createDataFrame([(1, "### First Part"), (1, "### Second Part"), (1, "### PART II")], "filing_id long, line string")
    got = blocks.assembled(blocks.marked(rows, blocks.heading_candidates(md, F.lit(None).cast("string")))).orderBy("item_id", "block").collect()
    for _, item, text in texts:
        own = [x for r in got if r.item_id == item for x in (r.heading, r.text) if x]
        assert sorted(x.strip() for x in "\n".join(own).split("\n")) == sorted(x.strip() for x in text.split("\n"))
    assert {(r.item_id, r.block, r.source) for r in got} == {(10, 0, "markdown_h3"), (10, 1, "markdown_h3"), (10, 2, "markdown_h3"), (11, 0, None), (12, -1, "markdown_h3"), (12, 1, "markdown_h3"), (12, 2, "markdown_h3")}


def test_markdown_rules(spark):
    say = lambda rule, text: one(spark, rule(F.col("c")), c=text)
    assert say(markdown.strip_cover, "---\na: b\n---\ncover\n# Part I\nx") == "---\na: b\n---\n# Part I\nx" and say(markdown.strip_cover, "cover only") == "cover only"
    assert say(markdown.strip_pages, "a\n12\n---\n[Table of Contents](#x)\nb\n| --- |\n81\n---") == "a\nb\n| --- |\n"
    assert say(markdown.strip_stubs, "## Item 9. A\nx\n## Item 10. B\nIncorporated by reference.\n## Item 14. C\nshort") == "## Item 9. A\nx\n## Item 14. C\nshort"
    assert say(markdown.merge_titles, "## Item 1.\n\nBusiness of the Day\nx") == "## Item 1. Business of the Day\nx" and say(markdown.merge_titles, "## Item 1.\nThe company operates\n") == "## Item 1.\nThe company operates\n"
    assert say(markdown.merge_titles, "## ITEM 10.\n\n- DIRECTORS, OFFICERS\n") == "## ITEM 10. DIRECTORS, OFFICERS\n"
    for title, want in (("MANAGEMENT'S DISCUSSION OF MD&A AND THE 10-K", "Management's Discussion of MD&A and the 10-K"), ("Risk factors", "Risk Factors"), ("Risk Factors of the US", "Risk Factors of the US"), ("the end", "The End")):
        assert say(markdown.title_case, title) == want
    assert say(markdown.normal_headings, "# PART II.\n## ITEM 7A.\n## Item 8. fees") == "# Part II\n## Item 7A.\n## Item 8. Fees"


def test_page_blocks(spark):
    page = '<html><head><title>t</title></head><body><p>one <b>two</b>\n three<p>four<table><tr><td> five </table><div style="display: none">six</div><script>seven</script><pre>a\n  b</pre><ix:x>eight</ix:x></body>'
    got = [tuple(r)[1:] for r in headings.page_blocks(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id", "block_idx").collect()]
    assert got[:3] == [(0, "p", "one two three", False, True), (1, "p", "four", False, False), (2, "td", "five", True, False)]
    assert not any("six" in r[2] or "seven" in r[2] for r in got) and got[3][2].startswith("a\n  b")


def test_redaction(spark):
    for raw, want in (
        ("Traceback (most recent call last):\n  File x\n    y\nTimeoutError: late", "TimeoutError: late"),
        ("postgres://u:p@h:5/x failed", "[connection_string] failed"),
        ("Bearer abc.def then sk-abcdefghijkl", "[REDACTED] then [REDACTED]"),
        ("MY_API_KEY=abc  at db.internal:80", "[REDACTED] at [internal_host]"),
        ("no file /a/b/c.txt", "no file [path]"),
        ("C:\\Users\\me\\x.txt is gone", "[path] is gone"),
        ("Provider timeout", "Provider timeout"),
    ):
        assert one(spark, agents.redact(F.col("c")), c=raw) == want


def test_last_assistant_turn(spark):
    given = [(1, 0, "user"), (1, 1, "assistant"), (1, 2, "tool"), (1, 3, "assistant"), (1, 4, "user"), (2, 0, "user"), (3, 0, "assistant"), (3, 1, "user"), (3, 2, "assistant"), (3, 3, "tool")]
    df = spark.createDataFrame([(c, t, r, "") for c, t, r in given], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.target_turn for r in agents.regenerate_target(df).collect()} == {1: 1, 2: None, 3: 2}


def test_case_ids_are_never_cut(spark):
    df = spark.range(3).select(F.format_string("case-%02d", F.element_at(F.array(F.lit(7), F.lit(123), F.lit(124)), (F.col("id") + 1).cast("int"))).alias("c"))
    assert [r.c for r in df.collect()] == ["case-07", "case-123", "case-124"]


def test_late_events_are_dropped(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d)
    for k, rows in enumerate(([(1, day(1), "a")], [(2, day(9), "a")], [(3, day(1), "a"), (4, day(9), "a")])):
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(f"{tmp_path}/in/part=*")
        write = lambda out, batch: out.write.mode("append").parquet(f"{tmp_path}/out")
        sessions.hourly(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("hour").agg(F.max("n").alias("n")).collect()
    assert {r.hour: r.n for r in got} == {"2024-01-01 00:00:00": 1, "2024-01-09 00:00:00": 2}


def test_stream_and_windows_tell_the_same(spark):
    kinds = ["reasoning", "text", "text", "tool_call", "tool_result", "reasoning", "progress", "reasoning", "text", "tool_call", "tool_error", "text"]
    df = spark.createDataFrame([(1, k, kind) for k, kind in enumerate(kinds)] + [(2, 0, "tool_result")], "session_id long, seq long, kind string")
    got = [(r.type, r.id) for r in agents.lifecycle(df).where("session_id = 1").orderBy("seq", "ord").collect()]
    assert [t for t, _ in got] == "start reasoning-start reasoning-delta reasoning-end text-start text-delta text-delta text-end reasoning-start reasoning-delta reasoning-delta reasoning-end text-start text-delta text-end text-start text-delta text-end finish".split()
    assert [i for t, i in got if t == "text-start"] == ["text-0", "text-1", "text-2"] and [i for t, i in got if t == "reasoning-start"] == ["reasoning-0", "reasoning-1"]
    assert [r.type for r in agents.lifecycle(df).where("session_id = 2").collect()] == ["finish"]


def test_latest_filing_and_work(spark):
    d = lambda s: datetime.date.fromisoformat(s)
    rows = [("A", "10-K", d("2024-02-01"), 1, d("2023-12-31")), ("A", "10-K/A", d("2024-06-01"), 2, d("2023-12-31")), ("A", "10-K", d("2023-02-01"), 3, d("2022-12-31")), ("B", "20-F", d("2024-01-01"), 4, d("2023-12-31")), ("C", "10-Q", d("2024-01-01"), 5, d("2023-12-31"))]
    df = spark.createDataFrame(rows, "company string, form string, filing_date date, accession long, period date")
    assert {r.company: (r.status, r.fiscal_year) for r in landing.latest_filings(df).collect()} == {"A": ("found", 2023), "B": ("unsupported", None), "C": ("not found", None)}
    ask = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1)], "company string, fiscal_year int")
    got = landing.work_list(ask, ask.where("company = 'A'"), ask.where("company <> 'C'"))
    assert {r.company: r.action for r in got.collect()} == {"A": "search", "B": "embed", "C": "fetch and embed"}


NBSP = " "


def of_text(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_headings_with_no_break_spaces(spark):
    assert of_text(spark, f"Item{NBSP}1A.", sections.strict_key) == "1a"
    assert of_text(spark, f"{NBSP}item{NBSP}7A. ", sections.strict_key) == "7a"
    assert of_text(spark, f"Item{NBSP}7", sections.name_key) == "7"
    assert of_text(spark, f"Item 7. A{NBSP}\nItem{NBSP}8.{NBSP}B", lambda t: sections.trim_structural(t, F.lit("7"))) == "Item 7. A"
    assert of_text(spark, f"Item 7. A{NBSP}Item{NBSP}8.{NBSP}B", lambda t: sections.trim_to_item(t, F.lit("7"))) == "Item 7. A"
    assert of_text(spark, f"It is incorporated{NBSP}by{NBSP}reference.", sections.stub)["is_stub"]


def test_structural_headings(spark):
    cut = lambda t: of_text(spark, t, lambda x: sections.trim_structural(x, F.lit("7")))
    assert cut("Item 7. A" + "\n" + " \t" * 200 + "Item 8. B") == "Item 7. A"  # any indent
    assert cut("x\x01y Item 7. a\nItem 9C. b") == "x\x01y Item 7. a"  # no character is lost
    assert cut("A" + "PART" + " " * 50 + "IIIItem 10. B") == "A"
    for kept in ("SubItem 1. x", 'See "Item 1. Business" above', "see (Item 1. x)", "under Item 1A. Risk", "worth Item 5.4 percent", "Item 7. a\n Item 7. b", f"a{NBSP}Item 8. b"):
        assert cut(kept) == kept
    assert cut("Item 8. only") == "" and cut("   Item 8. only") == "" and cut("53Item 8. x") == "53"


def test_long_runs_of_lines(spark):
    blank = "\n" * 100_000
    trace = "Traceback (most recent call last):\n" + "  File x\n" * 100_000 + "TimeoutError: late"
    assert of_text(spark, trace, agents.redact) == "TimeoutError: late"
    assert of_text(spark, f"## Item 1.\n{blank}Business\nx", markdown.merge_titles) == "## Item 1. Business\nx"
    assert of_text(spark, "a" + " " * 100_000 + "b" + blank, functions.stripped) == "a" + " " * 100_000 + "b"
    assert of_text(spark, "Item 7. a" + blank + "Item 8. b", lambda t: sections.trim_structural(t, F.lit("7"))) == "Item 7. a"


def test_next_text_after_a_line_of_white_space(spark):
    text = f"Intro of it\nOverview Of Things\n\t{NBSP}\n" + "Long prose goes on and on. " * 5
    rows = blocks.prepared(spark.createDataFrame([(1, 1, text)], "filing_id long, item_id long, text string"))
    assert rows.select(blocks.fallback_lines(F.col("lines"))).first()[0] == [1]


RUN = [
    ("text", "m1", None, None, "Hel"), ("text", "m1", None, None, ""), ("text", None, None, None, "lo"), ("reasoning", "m1", None, None, "hm"), ("reasoning", "m1", None, None, "a second part"), ("reasoning", "m2", None, None, ""),
    ("progress", None, "c1", None, "too early"), ("tool_start", "m2", "c1", "quote", None), ("call", None, "c1", "quote", '{"t": "A"}'), ("progress", None, "c1", None, '{"p": 1}'), ("error", None, "c1", None, "timed out"), ("progress", None, "c1", None, "too late"),
    ("usage", "m3", None, None, None), ("failure", None, None, None, "broke"), ("text", "m4", None, None, "after the end"),
]
TOLD = [
    ("start", "m1", None), ("text-start", "text-0", None), ("text-delta", "text-0", "Hel"), ("text-delta", "text-0", "lo"), ("reasoning-start", "reasoning-0", None), ("reasoning-delta", "reasoning-0", "hm"), ("reasoning-end", "reasoning-0", None), ("reasoning-start", "reasoning-1", None),
    ("reasoning-delta", "reasoning-1", "a second part"), ("reasoning-end", "reasoning-1", None), ("reasoning-start", "reasoning-2", None), ("reasoning-end", "reasoning-2", None), ("text-end", "text-0", None), ("tool-call", "c1", '{"t": "A"}'), ("tool-progress", "c1", '{"p": 1}'),
    ("tool-error", "c1", "timed out"), ("error", None, "broke"), ("finish", None, "error"),
]


def raw_log(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(1, k, start + datetime.timedelta(seconds=k), 0 if k < 5 else k, *x[:3], x[3], x[4], 10, 1) for k, x in enumerate(RUN)]
    rows += [(1, 100, start + datetime.timedelta(days=3), 100, "text", "m5", None, None, "again", 7, 2), (2, 5, start, 5, "progress", None, None, None, "x", None, None)]
    return spark.createDataFrame(rows, lifecycle.RAW)


def test_a_run_is_told_whole(spark):
    out = lifecycle.told(raw_log(spark)).orderBy("session_id", "seq", "ord").collect()
    assert [(r.type, r.id, r.text) for r in out if r.session_id == 1 and r.seq < 100] == TOLD
    assert [(r.type, r.id) for r in out if r.session_id == 1 and r.seq == 100] == [("start", "m5"), ("text-start", "text-0"), ("text-delta", "text-0"), ("text-end", "text-0"), ("finish", None)]
    assert [(r.seq, r.tokens_in, r.tokens_out) for r in out if r.type == "finish"] == [(13, 80, 8), (100, 7, 2), (5, 0, 0)]
    assert [r.type for r in out if r.session_id == 2] == ["finish"]


def test_run_status_and_usage(spark):
    log = raw_log(spark)
    out = lifecycle.told(log)
    assert {(r.session_id, r.seq): (r.status, r.error) for r in lifecycle.results(log, out).collect()} == {(1, 13): ("failed", "broke"), (1, 100): ("finished", None), (2, 5): ("finished", None)}
    assert [tuple(r) for r in lifecycle.usage(out).orderBy("session_id", "turn").collect()] == [(1, 1, 80, 8), (1, 2, 7, 2), (2, 1, 0, 0)]
    # an error of a tool alone doesn't fail a run that ends well
    fine = log.where("seq < 12 and session_id = 1")
    assert [(r.status, r.error) for r in lifecycle.results(fine, lifecycle.told(fine)).collect()] == [("finished", None)]


def test_wire_records_of_all_kinds(spark):
    rows = [(1, k, 0, t, "i", "n", '{"a": [1, "é\\"]}' if t == "tool-call" else '{"a": 1}' if t.startswith("tool") else 'say "x"\n', 3, 4) for k, t in enumerate(lifecycle.TYPES)]
    got = {r.seq: r.record for r in lifecycle.records(spark.createDataFrame(rows, lifecycle.TOLD)).collect()}
    got = {t: json.loads(got[k].removeprefix("data: ")) for k, t in enumerate(lifecycle.TYPES)}
    said = 'say "x"\n'
    assert got == {
        "start": {"type": "start", "messageId": "i", "messageMetadata": {"sessionId": "1"}}, "text-start": {"type": "text-start", "id": "i"}, "text-delta": {"type": "text-delta", "id": "i", "delta": said}, "text-end": {"type": "text-end", "id": "i"},
        "tool-call": {"type": "tool-input-available", "toolCallId": "i", "toolName": "n", "input": '{"a": [1, "é\\"]}'}, "tool-result": {"type": "tool-output-available", "toolCallId": "i", "output": {"a": 1}}, "tool-error": {"type": "tool-output-error", "toolCallId": "i", "errorText": '{"a": 1}'},
        "tool-progress": {"type": "data-tool-progress", "id": "i", "data": {"a": 1}, "transient": True}, "reasoning-start": {"type": "reasoning-start", "id": "i"}, "reasoning-delta": {"type": "reasoning-delta", "id": "i", "delta": said}, "reasoning-end": {"type": "reasoning-end", "id": "i"},
        "error": {"type": "error", "errorText": said}, "finish": {"type": "finish", "finishReason": said, "messageMetadata": {"usage": {"totalTokens": 7}}},
    }


def test_replayed_batches_leave_their_rows_once(spark, tmp_path):
    write = lifecycle.sink(f"{tmp_path}/rows")
    rows = spark.range(5)
    for batch in (0, 1, 1, 0):
        write(rows, batch)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 10


def test_late_and_missing_outcomes(spark):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    rows = [(1, 1, at(0), "tool_start", "a"), (1, 2, at(1), "result", "a"), (1, 3, at(2), "error", "a"), (1, 4, at(20), "result", "a"), (1, 5, at(3), "tool_start", "b"), (1, 6, at(4), "result", "c"), (2, 7, at(1), "result", "b")]
    log = spark.createDataFrame(rows, "session_id long, seq long, ts timestamp, kind string, call_id string")
    got = {(r.session_id, r.call_id, r.call_seq, r.end_seq, r.status) for r in lifecycle.outcomes(lifecycle.started(log), lifecycle.ended(log)).collect()}
    assert got == {(1, "a", 1, 2, "result"), (1, "a", 1, 3, "error"), (1, "a", None, 4, "unexpected"), (1, "b", 5, None, "pending"), (1, "c", None, 6, "unexpected"), (2, "b", None, 7, "unexpected")}


def test_entries_with_several_paths_and_snippets(spark):
    results = spark.createDataFrame([(1, 1, "A / x", "one"), (1, 2, "B / y", "two"), (1, 3, "A / x", "one"), (1, 4, "C", "three")], "query_id int, rank int, header_path string, text string")
    expected = spark.createDataFrame([(1, 0, "Z", ""), (1, 0, "B", "TWO"), (1, 1, "A", None)], "query_id int, entry int, path string, snippet string")
    r = scoring.bound_scores(results, expected).first()
    assert (r.n_expected, r.recall_5, r.reciprocal_rank, r.average_precision) == (2, 1.0, 1.0, 1.0)
    # one chunk, though it stands at two ranks, can't be two entries'
    twice = spark.createDataFrame([(1, 0, "A", ""), (1, 1, "A", "one")], "query_id int, entry int, path string, snippet string")
    r = scoring.bound_scores(results, twice).first()
    assert (r.recall_5, r.average_precision) == (0.5, 0.5)


def test_dataset_rows(spark):
    rows = [(1, '["A / x", "a / x", "Q"]', '["ONE", "", ""]'), (2, "", ""), (3, "[]", None), (4, '{"a": 1}', ""), (5, '["A"', ""), (6, '["A / x"]', '["nine"]'), (7, '["A"]', "x"), (8, '[""]', '["two"]'), (9, "[12]", "")]
    chunks = spark.createDataFrame([("A / x", "is One"), ("B", "two"), ("12 / z", "")], "header_path string, text string")
    got = {(r.row_id, r.place): r.status for r in scoring.validated(spark.createDataFrame(rows, "row_id int, paths string, snippets string"), chunks).collect()}
    assert got == {(1, 0): "ok", (1, 1): "near miss", (1, 2): "failed", (2, None): "skipped", (3, None): "skipped", (4, None): "malformed", (5, None): "malformed", (6, 0): "no snippet", (7, None): "malformed", (8, 0): "ok", (9, 0): "ok"}


def test_outline_closes_deeper_headings(spark):
    md = "intro\n# A\n### B\n## C/D\n### E\n### E\n# F\n```\n## no\n```\n## F"
    got = [r.header_path for r in markdown.outline(spark.createDataFrame([(1, md), (2, "# only"), (3, "\n \n## x")], "doc_id int, md string")).orderBy("doc_id", "node").collect()]
    assert got == ["", "A", "A / B", "A / C/D", "A / C / D / E", "A / C / D / E", "F", "F", "only", "x"]


def test_failed_jobs_are_logged(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.when(F.col("id") == 70, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")))
    log = f"{tmp_path}/log"
    with pytest.raises(Exception, match="bad row"):
        tracking.tracked(rows, lambda r: r.write.parquet(f"{tmp_path}/a"), log, "p", "t", metadata={"try": 1})
    tracking.tracked(spark.range(7), lambda r: r.write.parquet(f"{tmp_path}/b"), log, "p", "t", {"top": F.max("id")}, {"try": 2})
    got = {json.loads(r.metadata)["try"]: r for r in spark.read.parquet(log).collect()}
    assert (got[1].status, got[1].rows_written, bool(got[1].error_class)) == ("error", 0, True) and "bad row" in got[1].error_message
    assert (got[2].status, got[2].rows_written, got[2].error_message, json.loads(got[2].metadata)["top"]) == ("success", 7, None, 6)
    assert all(r.finished_at >= r.started_at for r in got.values())


def test_domains_by_suffix(spark):
    urls = ["https://www.reuters.com/a", "http://REUTERS.com:80/b", "https://notreuters.com/c", "https://reuters.com.evil.org/", "https://u@markets.reuters.com?x", "ftp://x", "no url", None, "https://a.cnbc.com/1"]
    results = spark.createDataFrame([(1, k, u) for k, u in enumerate(urls)] + [(2, k, f"https://reuters.com/{k}") for k in range(9)], "query int, rank int, url string")
    got = tracking.trusted(results, spark.createDataFrame([("reuters.com",), ("CNBC.com",)], "domain string")).collect()
    assert sorted((r.query, r.rank, r.place) for r in got) == [(1, 0, 1), (1, 1, 2), (1, 4, 3), (1, 8, 4)] + [(2, k, k + 1) for k in range(5)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_stores_are_read_where_they_lie(spark, tmp_path):
    rows = spark.range(1000).withColumn("part", F.col("id") % 10)
    sources.save(rows, f"{tmp_path}/store", ["part"])
    assert "PartitionFilters: [isnotnull(part" in plan(spark.read.parquet(f"{tmp_path}/store").where("part = 3"))
    a, b = sources.bucketed(rows, ["id"], 4), sources.bucketed(rows.withColumnRenamed("part", "other"), ["id"], 4)
    joined = a.hint("merge").join(b, "id").groupBy("id").agg(F.max("other"))
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined) and joined.count() == 1000


def test_statements(spark):
    q = spark.createDataFrame([(1, 2023, k, datetime.date(2023, 3 * k, 28), 100, 60, 40, 10, 5, 25, 30, 5, 35, 10, 25, 50, -20, 30, 1.0, 20, 80) for k in (1, 2, 3, 4)], "company int, fiscal_year int, fiscal_quarter int, period_end date, total_revenue long, cost_of_revenue long, gross_profit long, research_and_development long, selling_general_admin long, operating_income long, long_term_debt long, current_debt long, total_debt long, cash long, net_debt long, operating_cash_flow long, capital_expenditure long, free_cash_flow long, diluted_eps double, ebitda long, equity long")
    assert statements.broken(q).count() == 0
    off = q.withColumn("free_cash_flow", F.lit(70)).withColumn("gross_profit", F.lit(None).cast("long"))
    assert {(r.identity.split(" =")[0], r.off) for r in statements.broken(off).collect()} == {("free cash flow", 40)}
    market = spark.createDataFrame([(1, datetime.date(2024, 1, 2), 20.0, 10, 5.0, 10.0, 1.0), (1, datetime.date(2023, 10, 1), 20.0, 10, -1.0, 0.0, 0.0), (2, datetime.date(2024, 1, 2), 20.0, 10, 1.0, 1.0, 0.0)], "company int, as_of date, price double, shares long, forward_eps double, growth_pct double, dividend double")
    got = {(r.company, r.as_of.year): tuple(r)[2:] for r in statements.valuations(market, q).collect()}
    assert got[1, 2024] == (200.0, 225.0, 5.0, 4.0, 2.5, 0.5, 2.8125, 0.5, 5.0)
    assert got[1, 2023] == (200.0, 225.0, None, None, 2.5, None, None, None, 0.0) and got[2, 2024][1] is None
    rows = [(1, "annual", None, 0.5), (2, "annual", 1, 0.5), (3, "quarterly", None, 0.5), (4, "quarterly", 5, 1.5), (5, None, 1, None)]
    got = {(r.slice_id, r.rule) for r in statements.slice_faults(spark.createDataFrame(rows, "slice_id int, period_type string, fiscal_quarter int, share double")).collect()}
    assert got == {(2, "annual without a quarter"), (3, "annual without a quarter"), (4, "quarter in 1..4"), (4, "share in 0..1"), (5, "period is annual or quarterly")}


def test_heading_variants_and_faults(spark):
    kinds = {
        "# PART I.": "UPPER+period", "# PART II": "UPPER", "## Part IV.": "Mixed+period", "# Part III": "Standard", "## ITEM 1.BUSINESS": "UPPER+nospace", "## ITEM 1A. RISK FACTORS": "UPPER+UPPERtitle", "## ITEM 7. Review": "UPPER+mixedtitle", "## Item 8. STATEMENTS": "Item+UPPERtitle", "#### Item 9A. Controls": "Standard", "## Item 16.": "empty-title",
    }
    rows = spark.createDataFrame(list(enumerate(kinds)), "doc_id int, md string")
    assert {r.samples: r.variant for r in markdown.heading_variants(rows).collect()} == kinds
    # an empty rest of a line takes the next text, a period with it
    both = spark.createDataFrame([(1, "# PART I.\n\nBusiness\n## Item 5.\nMarket")], "doc_id int, md string")
    assert {(r.kind, r.variant) for r in markdown.heading_variants(both).collect()} == {("part", "UPPER"), ("item", "Standard")}
    text = "---\nt: x\n---\n## Item 1C. Cyb.\nshort\n## Item 9A. Controls\n" + "y" * 300 + "\n12\n| - | - |\n---\n## Item 5."
    r = markdown.audit(spark.createDataFrame([(1, text)], "doc_id int, md string")).first()
    assert (r.n_truncated, r.n_empty, r.dash_gap, r.n_table_risks, r.has_1c, r.stub_1c, r.has_9a, r.has_9b) == (1, 1, 1, 1, True, True, True, False)


def test_diagnostic_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, x int")
    some = scoring.diagnostic_rows(rows, "d", "v1", "l", "g", ["c", "a"]).orderBy("pos").collect()
    assert [(r.id, r.x, r.diagnostic_id, r.is_full_dataset) for r in some] == [("c", 3, "d::l::c", False), ("a", 1, "d::l::a", False)]
    assert json.loads(some[0].metadata) == {"dataset_name": "d", "dataset_version": "v1", "run_label": "l", "agent_version": "g", "row_id": "c", "is_full_dataset": False}
    assert all(r.is_full_dataset for r in scoring.diagnostic_rows(rows, "d", "v1", "l", "g").collect())
    for ids, error in ((["z"], "unknown id z"), (["a", "a"], "repeated id a"), ([" "], "ids")):
        with pytest.raises(ValueError, match=error):
            scoring.diagnostic_rows(rows, "d", "v1", "l", "g", ids)
    for odd in ([("a", 1), ("a", 2)], [(None, 1)], [("x::y", 1)], [("", 1)]):
        with pytest.raises(ValueError, match="dataset ids"):
            scoring.diagnostic_rows(spark.createDataFrame(odd, "id string, x int"), "d", "v1", "l", "g")
    with pytest.raises(ValueError, match="label"):
        scoring.diagnostic_rows(rows, "d", "v1", "l::m", "g")


def test_short_titles(spark):
    md = "## ITEM 1.BUS\n## Item 2. Properties\n## Item 3. \n## Item 4. Mine"
    got = markdown.short_titles(spark.createDataFrame([(1, md)], "doc_id int, md string")).collect()
    assert [(r.line_idx, r.heading) for r in got] == [(0, "## Item 1. Bus"), (3, "## Item 4. Mine")]
