"""Operators on small inputs, one case per behaviour that the design names."""

import random

import pytest
from pyspark.sql import functions as F

from contextlake.functions.jsonblocks import minify_blocks
from contextlake.functions.text import percent_saved, skip_greedy
from contextlake.operators import code, diffs, keywords, logs, prose, repomap, session, symbols, tokens, vectors


def prose_of(spark, text, preset="default"):
    return prose.compress(spark.createDataFrame([(text,)], "text string"), preset=preset).first()


@pytest.mark.parametrize(
    ("text", "preset", "want"),
    [
        ("Could you please fix this bug", "default", "fix this bug"),
        ("In order to build, use it", "default", "to build, use it"),
        ("I think that it works!!", "default", "it works!"),
        ("a  b\n\n\n\nc  ", "light", "a b\n\nc"),
        ("Please check `please  keep` now", "default", "check `please  keep` now"),
        ("please ```\nplease  x\n``` go", "default", "```\nplease  x\n``` go"),
        ("<KEEP>please  a</KEEP> please b <keep>c</keep>", "default", "please  a b c"),
        ("the configuration is actually simple", "aggressive", "the config is simple"),
        ("it completely eliminate d", "default", "it eliminate d"),
        ("", "default", ""),
    ],
)
def test_prose(spark, text, preset, want):
    assert prose_of(spark, text, preset).output == want


def test_prose_reports_rules_that_fired(spark):
    r = prose_of(spark, "Could you please go on !!")
    assert r.rules_applied == ["politeness", "punctuation"]
    assert r.percent_saved > 0 and prose_of(spark, "plain").rules_applied == []
    assert prose_of(spark, None).output is None


def code_of(spark, text, preset="default"):
    return code.trim(spark.createDataFrame([(text,)], "text string"), preset=preset).first()


@pytest.mark.parametrize(
    ("text", "preset", "want"),
    [
        ("x = 1; // note\ny", "default", "x = 1;\ny"),
        ('u = "http://a"; // b', "default", 'u = "http://a";'),
        ("u = 'it//s' + `a//b`", "default", "u = 'it//s' + `a//b`"),
        ("x /// doc", "default", "x /// doc"),
        ("/* a\n b */\nx", "default", "x"),
        ("console.log(1)\n  console.error(2)\nx", "default", "x"),
        ("import a\nimport b\n import a\nx", "default", "import a\nimport b\nx"),
        ("abc\nabc\nab\nab", "aggressive", "abc\nab\nab"),
        ("a  \n\n\n\nb", "light", "a\n\nb"),
        ("<keep>// one</keep>\n// two\n<keep>// three</keep>", "default", "// one\n\n// three"),
    ],
)
def test_code(spark, text, preset, want):
    r = code_of(spark, text, preset)
    assert r.output == want and "Trimmed trailing whitespace" in r.rules_applied


def log_of(spark, text, preset="balanced"):
    return logs.compress(spark.createDataFrame([(1, text)], "doc_id long, text string"), preset=preset).first()


def test_log_steps(spark):
    assert log_of(spark, "\x1b[31mred\x1b[0m").output == "red"
    assert log_of(spark, "\n".join(["same"] * 50)).output == "same  (×50)"
    assert log_of(spark, "\n".join(f"item {i}" for i in range(20))).output == "item 0\n  …[18 similar lines collapsed]\nitem 19"
    assert log_of(spark, "2024-01-15T10:23:45.123Z up\n[2024-01-15 10:23:45] b\n[10:23:45] c").output == "[T] up\n[[T]] b\n[T] c"
    trace = "Error: x\n" + "\n".join(["    at f (a.js:1:2)"] * 6)
    assert log_of(spark, trace).output == trace
    assert log_of(spark, "y" * 600).output == "y" * 500 + " …[+100 chars]"
    assert log_of(spark, "WARN a 1\nx\nWARN a 2\ny\nWARN a 3\nz\nWARN a 4").output == 'WARN a 1\nx\nWARN a 2\ny\nz\n\n[Warnings summary]\n  • "WARN a #" — +2 more similar'


def test_json_blocks():
    assert minify_blocks('a\n{\n "b": 1.0,\n "2": [1, 2.5]\n}\nz') == 'a\n{"2":[1,2.5],"b":1}\nz'
    assert minify_blocks("{\nnot json\n}") == "{\nnot json\n}"
    assert minify_blocks("{\n[\n1\n]") == "{\n[1]"


def model_runs(lines, protected, key, ok, least):
    out, i = [], 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and ok(lines[i], protected[i]) and ok(lines[j], protected[j]) and key(lines[j]) == key(lines[i]):
            j += 1
        out.append((i, j - i))
        i = j
    return out


def test_runs_equal_a_plain_model_per_document(spark):
    rng = random.Random(3)
    docs = {d: [rng.choice(["a", "b 1", "b 2", "", "    at f (x.js:1:1)", "Error: q", "c"]) for _ in range(rng.randrange(1, 40))] for d in range(25)}
    rows = [(d, n, x) for d, ls in docs.items() for n, x in enumerate(ls)]
    masked = logs.protect_traces(spark.createDataFrame(rows, "doc_id long, line_no long, line string").repartition(5)).cache()
    mask = {d: [p for _, p in sorted((r.line_no, r.protected) for r in masked.collect() if r.doc_id == d)] for d in docs}
    got = {d: [] for d in docs}
    for r in logs.collapse_duplicates(masked).orderBy("doc_id", "line_no").collect():
        got[r.doc_id].append(r.line)
    for d, lines in docs.items():
        state, want_mask = False, []
        for i, x in enumerate(lines):
            frame = x.startswith("    at")
            state = True if frame or x.startswith("Error") else state and x != ""
            above = i + 1 < len(lines) and lines[i + 1].startswith("    at")
            want_mask.append(frame or above or (state and x != ""))
        assert mask[d] == want_mask
        want = []
        for i, n in model_runs(lines, mask[d], lambda x: x, lambda x, p: not p, 3):
            want += [f"{lines[i]}  (×{n})"] if n >= 3 else lines[i : i + n]
        assert got[d] == want


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Fix the MyWidget in load_data, MyWidget `Ignored` Foo")], "doc_id long, text string")
    got = {r.keyword: (r.score, r.rank) for r in keywords.extract(df).collect()}
    assert got == {"mywidget": (8, 1), "load_data": (3, 2), "foo": (1, 3)}
    assert len(set(keywords.STOPWORDS)) == len(keywords.STOPWORDS) == 223


def test_skip_greedy_is_not_a_running_sum(spark):
    df = spark.createDataFrame([([30, 50, 40],)], "x array<long>")
    assert df.select(skip_greedy(F.col("x"), lambda v: v, F.lit(75)).alias("k")).first().k == [30, 40]
    assert df.select(skip_greedy(F.col("x"), lambda v: v, F.lit(500), F.lit(2)).alias("k")).first().k == [30, 50]


@pytest.mark.parametrize(
    ("source", "want"),
    [("#!/usr/bin/env python\n'''doc'''\nimport os\nfrom a.b import c\n\nx = 1\nimport z", (2, 3)), ("x = 1\nimport a", None), ("// c\nconst a = require('b')\n", (1, 1)), ("#include <a>\nint x;", (0, 0))],
)
def test_import_ranges(spark, source, want):
    lines = logs.explode_lines(spark.createDataFrame([(1, source)], "doc_id long, text string"))
    r = symbols.import_ranges(lines).first()
    assert (r and (r.start_line, r.end_line)) == want


def test_function_around(spark):
    text = "a\nfunction f() {\n  x = {\n  }\n}\nb\ndef g():\n  y\n\nz"
    lines = logs.explode_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    cursors = spark.createDataFrame([(1, 2), (2, 7)], "doc_id long, cursor long")
    assert {tuple(r) for r in symbols.function_around(lines, cursors).collect()} == {(1, 1, 4), (2, 6, 8)}


def test_scopes(spark):
    df = spark.createDataFrame([(1, "fix @scope:fn  and @scope:class:My.Cls @scope:nope")], "prompt_id long, text string")
    assert [tuple(r)[1:] for r in symbols.scope_tags(df).collect()] == [(0, "fn", None), (1, "class", "My.Cls")]
    assert df.select(symbols.strip_scopes(F.col("text")).alias("t")).first().t == "fix and @scope:nope"


def test_diff_budget(spark):
    diff = "\n".join(f"diff --git a/{f} b/{f}\n" + "\n".join(f"@@ {h} @@\n" + "+ line of text\n" * 8 for h in range(6)) for f in range(5))
    rows = spark.createDataFrame([(diff,), (None,), ("",), ("no files\n@@ x",)], "diff string")
    cut = {n: [r.truncated for r in diffs.truncate(rows, n).collect()] for n in (0, 5, 300, 10_000)}
    headers = [x for x in diff.split("\n") if x.startswith("diff --git")]
    assert "omitted to fit budget]" in cut[300][0] and [x for x in cut[300][0].split("\n") if x.startswith("diff --git")] == headers[: cut[300][0].count("diff --git")]
    assert cut[10_000][0] == cut[0][0] == diff and cut[5][0].startswith("[diff truncated") and all(h in cut[5][0] for h in headers)
    assert all(c[1:] == [None, "", "no files\n@@ x"] for c in cut.values())


def test_tree_and_sizes(spark):
    assert repomap.draw_tree([]) == "(no files)"
    assert repomap.draw_tree([("a", "1b"), ("a/b", "2b"), ("a", "3b")]) == "├── a/\n│   └── b (2b)\n└── a (3b)"
    assert repomap.draw_tree([("b.ts", "42b"), ("a/c.ts", None)]) == "├── a/\n│   └── c.ts\n└── b.ts (42b)"
    sizes = spark.createDataFrame([(42,), (2048,), (2_500_000,)], "n long").select(repomap.size_text(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == ["42b", "2.0k", "2.4M"]
    text = "\n\n".join(f"block {i} " + "x" * 60 for i in range(20))
    cut = spark.createDataFrame([(text,)], "m string").select(repomap.cut(F.col("m"), 100).alias("c")).first().c
    assert cut.endswith("[+15 more file blocks omitted to fit budget]")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0, 5.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, -1.0, 0.0]


def test_window_chunks(spark):
    text = "\n".join(f"line number {i} with some text" for i in range(500)) + "\n" * 3
    chunks = vectors.chunk_windows(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).orderBy("start_line").collect()
    assert [(c.start_line, c.end_line) for c in chunks] == [(0, 199), (180, 379), (360, 502)]


def test_index_update(spark):
    files = spark.createDataFrame([("a", "some body text that is long enough"), ("b", "another body text, long enough too")], "path string, body string")
    empty = spark.createDataFrame([], "path string, chunk_no long, start_line long, end_line long, text string, content_hash string, embedding array<double>, sha1 string, model_id string")
    first = vectors.update_index(empty, files, "m1")
    again = vectors.update_index(first, files.withColumn("body", F.when(F.col("path") == "b", "changed body text, long enough").otherwise(F.col("body"))), "m1")
    before, after = ({r.path: r.text for r in x.collect()} for x in (first, again))
    assert before["a"] == after["a"] and after["b"].startswith("changed")
    assert vectors.index_stats(again).first().file_count == 2


def test_session(spark):
    rows = [(1, 7, "2024-01-01 00:00:00", "k"), (2, 7, "2024-01-01 00:10:00", "k"), (3, 7, "2024-01-01 00:20:01", "k"), (4, 8, "2024-01-01 00:00:10", "k")]
    e = spark.createDataFrame(rows, "entry_id long, session long, ts string, key string").withColumn("ts", F.to_timestamp("ts"))
    assert {r.entry_id: (r.seconds_ago, r.minutes) for r in session.recent(e).collect()} == {1: (None, None), 2: (600, 10), 3: (None, None), 4: (None, None)}


def test_costs_and_percent(spark):
    df = spark.createDataFrame([(1000, "gpt-4o"), (10, "claude-haiku"), (1000, "other")], "n long, model string")
    got = {r.model: (r.encoding, r.t) for r in tokens.with_model(df).select("model", "encoding", tokens.cost_text(F.col("n") * F.col("price")).alias("t")).collect()}
    assert got == {"gpt-4o": ("o200k_base", "$0.0050"), "claude-haiku": ("cl100k_base", "$0.0008¢"), "other": ("cl100k_base", "$0.0050")}
    assert spark.range(1).select(percent_saved(F.lit(0), F.lit(5)).alias("p")).first().p == 0


def test_whole_prompts(spark):
    from contextlake.operators import scopes

    p = spark.createDataFrame([(1, "Could you please fix @scope:symbol:Foo @scope:symbol:foo @scope:class:Nope @scope:symbol @scope:types", "a.ts")], "prompt_id long, text string, rel_path string")
    table = spark.createDataFrame([("a.ts", "Foo", 0, 4), ("a.ts", "Shape", 1, 10)], "rel_path string, name string, symbol_no long, kind_code long")
    files = spark.createDataFrame([("a.ts", "x")], "rel_path string, body string")
    tags = symbols.scope_tags(p).join(p.select("prompt_id", "rel_path"), "prompt_id")
    r = scopes.assemble(scopes.file_blocks(tags, files, table)).first()
    assert r.labels == ["scope:symbol:Foo", "scope:symbol:foo (deduped)", "scope:class:Nope", "scope:symbol", "scope:types"]
    assert "[Context: symbol:a.ts#Foo — already included above (dedup)]" in r.context
    assert '[Class "Nope" not found in file]' in r.context and "[Missing symbol name: use @scope:symbol:<name>]" in r.context
    done = scopes.account(scopes.optimise(p).withColumn("context", F.lit("\n\nabcd"))).first()
    assert done.clean == "Could you please fix" and done.prose == "fix" and done.prose_saved == done.prose_in - 1 and not done.alert


def test_every_scope_kind_gives_a_block_or_a_message(spark):
    from contextlake.operators import scopes

    kinds = ["fn", "file", "imports", "types", "symbol:Foo", "class:Foo", "diff", "staged", "last-commit", "auto", "repo-map", "semantic"]
    p = spark.createDataFrame([(1, " ".join(f"@scope:{k}" for k in kinds), "a.ts", 3, 7), (2, "@scope:fn @scope:imports", "b.ts", 1, 8)], "prompt_id long, text string, rel_path string, cursor long, diff_id long")
    table = spark.createDataFrame([("b.ts", "Foo", 0, 4, 1, 1)], "rel_path string, name string, symbol_no long, kind_code long, start_line long, end_line long")
    files = spark.createDataFrame([("a.ts", "import a\n\nfunction f() {\n  x\n}\ny"), ("b.ts", "q\nr\ns")], "rel_path string, body string")
    changes = spark.createDataFrame([(7, "diff", "diff --git a b\n+++ b\n@@ -1 @@\n+ x")], "diff_id long, kind string, diff string")
    tags = symbols.scope_tags(p).join(p.drop("text"), "prompt_id")
    blocks = scopes.file_blocks(tags, files, table)
    for more in (scopes.function_blocks(tags, files, table), scopes.import_blocks(tags, files), scopes.diff_blocks(tags, changes), scopes.unresolved_blocks(tags)):
        blocks = blocks.unionByName(more)
    got = {(r.prompt_id, r.tag): (r.key, r.block) for r in blocks.collect()}
    assert {t for i, t in got if i == 1} == {f"scope:{k}" for k in kinds}
    assert got[1, "scope:fn"] == ("fn:a.ts:2-4", "[Context: lines 3–5]\n```\nfunction f() {\n  x\n}\n```")
    assert got[2, "scope:fn"] == ("symbol:b.ts#Foo", '[Context: class "Foo" (lines 2–2)]\n```\nr\n```')
    assert got[1, "scope:imports"] == ("imports:a.ts", "[Context: imports of a.ts (lines 1–1)]\n```\nimport a\n```")
    assert got[2, "scope:imports"] == (None, "[No imports detected at top of file]")
    assert got[1, "scope:diff"] == ("diff:working", "[Context: uncommitted (working tree): 1 file changed, +1]\n```diff\ndiff --git a b\n+++ b\n@@ -1 @@\n+ x\n```")
    assert got[1, "scope:staged"] == (None, "[No staged changes]") and got[1, "scope:auto"][0] is None


def test_nul_and_null_texts(spark):
    """U+0000 and the marks that rules use are ordinary characters of a text."""
    texts = ["a\x00b", "\x00K\x00 <keep>x \x00</keep>", "\x01\x02\x00K0\x00\x01", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for op in (code.trim, prose.compress):
        got = {r.doc_id: r.output for r in op(rows, preset="light").collect()}
        assert got[0] == texts[0] and got[1] == "\x00K\x00 x \x00" and got[2] == texts[2] and got[3] is None and got[4] == ""
    got = {r.doc_id: (r.output, r.input_lines) for r in logs.compress(rows).collect()}
    assert len(got) == 5 and got[3] == ("", 1)


def test_search_in_blocks(spark, monkeypatch):
    index = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id int, embedding array<double>")
    asked = index.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, vectors.search(index, asked).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 6)
    assert sorted(map(tuple, vectors.search(index, asked).collect())) == whole


def test_repeated_lines_go_by_their_first_place(spark):
    long = "\n".join(f"line {i % 9000}" for i in range(40_000))
    text = "  b\nab\na\n abc \nabc\nxyz\n\n\nabc  \nxyz"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, long)], "id int, t string")
    got = dict(df.select("id", code.dedup_lines(F.col("t"))).collect())
    assert got[1] == "  b\nab\na\n abc \nxyz\n\n" and got[2] is None and got[3] == ""
    assert got[4] == "\n".join(f"line {i}" for i in range(9000))


def test_file_hits_by_any_part_of_a_name(spark):
    words = spark.createDataFrame([(1, "order", 1), (2, "order", 7), (2, "zzz", 1), (1, "widget7", 2)], "doc_id long, keyword string, rank long")
    files = spark.createDataFrame([("src/reorder.ts",), ("src/Order.ts",), ("order/none.ts",)], "rel_path string")
    symbols = spark.createDataFrame([("src/a.ts", "borderline", 1), ("src/b.ts", "Widget70", 2), ("src/b.ts", "widget", 3)], "rel_path string, name string, symbol_no long")
    got = sorted(map(tuple, keywords.file_hits(words, files, symbols).collect()))
    assert got == [(1, "src/Order.ts", 5), (1, "src/a.ts", 3), (1, "src/b.ts", 3), (1, "src/reorder.ts", 5), (2, "src/a.ts", 3)]


def test_file_hits_by_keywords_of_every_length(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("ab1_") for _ in range(n)) for n in range(1, 70) for _ in range(3)})
    cuts = [(n, rng.randint(3, len(n))) for n in names if len(n) >= 3]
    wanted = sorted({n[(i := rng.randint(0, len(n) - k)) : i + k] for n, k in cuts} | {n + "x" for n in names if len(n) > 2})
    words = spark.createDataFrame([(d, w, 1) for d, w in enumerate(wanted)], "doc_id long, keyword string, rank long")
    files = spark.createDataFrame([(f"d/{n}",) for n in names], "rel_path string")
    symbols = spark.createDataFrame([("s", n, i % 5) for i, n in enumerate(names)], "rel_path string, name string, symbol_no long")
    want = {(d, f"d/{n}"): 5 for d, w in enumerate(wanted) for n in [n for n in names if w in n][:4]}
    want |= {(d, "s"): 3 * min(4, sum(w in n for n in names)) for d, w in enumerate(wanted) if any(w in n for n in names)}
    assert {(r[0], r[1]): r[2] for r in keywords.file_hits(words, files, symbols, most=4).collect()} == want
