import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import graphs, sheets, structure, tools, trees
from lodestrata.sources import formats, sinks


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_packing_matches_a_loop(spark):
    rng = random.Random(1)

    def loop(lines, limit, tail):
        out = []
        for line in lines:
            if out and len(out[-1]) + len(line) + 1 <= limit:
                out[-1] += "\n" + line
            else:
                out.append(line)
        if len(out) > 1 and len(out[-1]) < tail:
            out[-2:] = ["\n".join(out[-2:])]
        return out

    cases = [["x" * rng.randrange(0, 40) for _ in range(rng.randrange(0, 15))] for _ in range(40)] + [["y" * 500], []]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, lines array<string>")
    got = {r.k: r.p for r in df.select("k", structure.pack_lines(F.col("lines"), 60, 20).alias("p")).collect()}
    assert got == {k: loop(c, 60, 20) for k, c in enumerate(cases)}


def test_text_lines_like_splitlines(spark):
    texts = ["a\nb\r\nc\rd", "", "x\n", "\n\n", "p q\x85r", None, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in formats.text_lines(df, "k", "t").orderBy("k", "line_no").collect():
        got.setdefault(r.k, []).append(r.line)
    assert got == {k: t.splitlines() for k, t in enumerate(texts) if t}  # an empty text has no line


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# A\na1\n## B\nb1\nb2\n# C\n### D\nd"), (2, None), (3, "")], "k int, t string")
    got = {(r.section_no, r.path, r.body) for r in formats.markdown_sections(df, "k", "t").collect()}
    assert got == {(0, "", "intro"), (1, "A", "a1"), (2, "A / B", "b1\nb2"), (3, "C", ""), (4, "C / D", "d")}


def test_html_to_markdown():
    page = "<html><nav>menu</nav><h2>Title &amp; more</h2><p>One <b>two</b></p><script>x()</script><ul><li>a<li>b</ul><table>\n<tr><td>1</td></tr>\n</table><img alt='pic'>"
    assert formats.html_to_markdown(page).split("\n") == ["## Title & more", "One two", "- a", "- b", "<table> <tr><td>1</td></tr> </table>", "[Image: pic]"]
    assert formats.html_to_markdown(None) is None and formats.html_to_markdown("") == ""


def test_delimited_with_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines, here"\n2,\n', encoding="utf-8")
    got = formats.read_delimited(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in got] == [("1", "two\nlines, here"), ("2", None)]
    v = spark.createDataFrame([("7",), ("2.5",), ("=A1",), ("",), (None,)], "x string").select(formats.coerced(F.col("x")).alias("c")).collect()
    assert [(r.c.whole, r.c.number, r.c.text) for r in v] == [(7, 7.0, "7"), (None, 2.5, "2.5"), (None, None, "=A1"), (None, None, None), (None, None, None)]


def test_chunk_records(spark):
    df = spark.createDataFrame([("t", "a/b", "odd", "x; word, two;y", None, "[1, 2, x]", "{bad"), (None, None, "table", "aa,b", "s", None, '{"summary":"q"}')], "content string, path string, type string, keywords string, summary string, page_nums string, extra string")
    a, b = sorted(formats.chunk_records(df).collect(), key=lambda r: r.content, reverse=True)
    assert (a.chunk_type, a.keywords, a.page_nums, a.length) == ("text", ["word, two"], [1, 2], 1)
    assert (b.chunk_type, b.keywords, b.metadata.summary, b.length) == ("table", ["aa"], "q", 0)


@pytest.mark.parametrize(
    ("html", "grid"),
    [
        ("<table><tr><th colspan=2>A</th></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>", [["A", "A"], ["x", "1"], ["x", "2"]]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", [["a", "b"], ["c", ""]]),
        ("<table><tr><td>a &lt; b</td></tr><tr><td> </td></tr></table>", [["a < b"]]),
        ("no table", []),
        (None, None),
    ],
)
def test_grids(html, grid):
    assert sheets.grid_of(html) == grid


def test_query_table_and_sanitiser(spark):
    html = "<table><tr><th>Name</th><th>2 Qty</th><th>name</th></tr><tr><td>b</td><td>10</td><td>x</td></tr><tr><td>a</td><td>9</td><td>y</td></tr></table>"
    assert [tuple(r) for r in sheets.query_table(spark, html, "select name, c_2_qty from t order by try_cast(c_2_qty as int)").collect()] == [("a", "9"), ("b", "10")]
    assert sheets.identifiers(["Name", "2 Qty", "name", ""]) == ["name", "c_2_qty", "name_2", "col_4"]
    assert sheets.checked_select("SELECT 1").endswith("LIMIT 50") and "LIMIT 50" not in sheets.checked_select("select 1 limit 3")
    for bad in ("with x as (select 1) select * from x", "select 1; select 2", "select 'drop' from t", "delete from t", ""):
        with pytest.raises(ValueError):
            sheets.checked_select(bad)


def test_headers_and_html(spark):
    df = spark.createDataFrame([([["A", "A", "B"], ["x", "A", "B"], ["1", "<2>", "3"]],)], "g array<array<string>>")
    r = df.select(sheets.flat_headers(F.col("g"), 2).alias("h"), sheets.grid_html(F.col("g")).alias("t"), sheets.coarse_text(F.col("g")).alias("c")).first()
    assert r.h == ["A-->x", "A", "B"] and "<td>&lt;2&gt;</td>" in r.t and r.c == "A\nB\nx\n1\n<2>\n3"


def test_regions_hosts_and_references(spark):
    filled = [(r, c) for r in (0, 1) for c in (0, 1)] + [(r, c) for r in (4, 5) for c in (0, 1, 3)] + [(9, 0), (9, 2)]
    cells = spark.createDataFrame([("s", r, c, "v") for r, c in filled] + [("s", 7, 7, " "), ("e", 0, 0, None)], "sheet string, row int, col int, value string")
    got = {tuple(r)[2:] for r in sheets.sheet_regions(cells).collect()}
    assert got == {(0, 0, 1, 1, 4), (4, 0, 5, 1, 4), (4, 3, 5, 3, 2), (9, 0, 9, 2, 2)}
    rect = "sheet string, id string, r0 int, c0 int, r1 int, c1 int"
    a, b = spark.createDataFrame([("s", "sat", 5, 5, 5, 5)], rect), spark.createDataFrame([("s", "h1", 0, 0, 3, 5), ("s", "h2", 5, 7, 6, 8), ("s", "far", 50, 50, 51, 51), ("o", "h3", 5, 5, 5, 5)], rect)
    assert rows(sheets.nearest_hosts(a, b)) == {("sat", "h1", 2), ("sat", "h2", 2)}
    assert rows(sheets.overlapping(a, b.withColumn("r1", F.lit(60)).withColumn("c1", F.lit(60)))) == {("sat", "h1")}
    f = spark.createDataFrame([("s", 1, 1, "=SUM(A1:$B$2)+'My Sheet'!C3*A1:B2"), ("s", 2, 1, '=INDIRECT("A1")'), ("s", 3, 1, "text A1"), ("s", 4, 1, "=Other!A9")], "sheet string, row int, col int, formula string")
    assert rows(sheets.formula_references(f)) == {("s", 1, 1, "s", "A1:B2", False), ("s", 1, 1, "My Sheet", "C3", False), ("s", 2, 1, None, None, True), ("s", 4, 1, "Other", "A9", False)}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30)] + [(100, 101), (7, 7), (102, 100), (None, 5), (50, 51), (51, 50)], "a int, b int")
    got = {r.node: r.component for r in graphs.components(edges, spark.createDataFrame([(999,)], "node int")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100, 50: 50, 51: 50, 999: 999}


def test_connections(spark):
    link = "array<struct<target:string,relation:string>>"
    chunks = spark.createDataFrame([("r", "c1", "text", 1, [("i1", "embeds"), ("c2", "embedded_by")]), ("r", "c0", "page", 0, [("i1", "related")]), ("r", "i1", "image", 2, None), ("r", "c2", "text", 3, None)], f"revision string, chunk_id string, chunk_type string, sort_order int, connect_to {link}")
    wanted = spark.createDataFrame([("r", "c1")], "revision string, chunk_id string")
    assert {(r.host, r.chunk_id) for r in graphs.connected(chunks, wanted).collect()} == {("c1", "i1")}
    assert {(r.asset, r.host) for r in graphs.hosts(chunks).collect()} == {("i1", "c0")}
    links = spark.createDataFrame([("h", "t", "embeds", None), ("h", "t", "embeds", 5), ("h", "t", "embeds", 5), ("h", "u", "embeds", None)], "host string, target string, relation string, position int")
    assert rows(graphs.merge_connections(links)) == {("h", "t", "embeds", 5), ("h", "u", "embeds", None)}


def test_tools(spark):
    c = spark.createDataFrame([("a", "r", "x / y", "text", "Soil Survey one", 1), ("b", "r", "x", "text", "soil survey two", 0), ("t", "r", "x", "table", "soil", 2)], "id string, job_result_id string, path string, chunk_type string, text string, sort_order int")
    assert [(r.id, r.at) for r in tools.REGISTRY.dispatch("corpus.grep", c, terms=["SOIL SURVEY"]).collect()] == [("b", 1)]
    assert {(r.ref, r.status, r.id) for r in tools.read(c, ["x", "a", "zz"], "descendants").collect()} == {("x", "ok", "a"), ("x", "ok", "b"), ("a", "ok", "a"), ("zz", "failed", None)}
    assert [r.id for r in tools.REGISTRY.dispatch("corpus.assets", c, kind="table", query="SOIL").collect()] == ["t"]
    for name, args in (("nope", {}), ("corpus.grep", {}), ("corpus.grep", {"terms": "x"}), ("corpus.grep", {"terms": [], "more": 1})):
        with pytest.raises(ValueError):
            tools.REGISTRY.dispatch(name, c, **args)
    pages = spark.createDataFrame([("r", "p1", "body"), ("r", "p2", "see [SAME-AS p1 p3]."), ("r", "p3", "[SAME-AS gone]")], "revision string, path string, text string")
    assert {r.text for r in tools.resolve_same_as(pages).collect()} == {"body", "see body.", "(not found: gone)"}
    usage = spark.createDataFrame([("m", "t", 1_000_000, 500_000, 0), ("m", "t", 0, 500_000, 10), ("q", "t", 1, 1, 1)], "model string, task string, input_tokens bigint, output_tokens bigint, audio_seconds bigint")
    costs, missing = tools.token_costs(usage, spark.createDataFrame([("m", 1.0, 2.0, 0.5)], "model string, input_rate double, output_rate double, audio_rate double"))
    assert rows(costs) == {("m", "t", 8.0)} and rows(missing) == {("q",)}


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "t")
    one, two = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sinks.publish(one, root, "v1") and not sinks.publish(two, root, "v1") and rows(sinks.current(spark, root)) == {(1, "a")}
    assert sinks.publish(sinks.upsert(one, two, ["k"]), root, "v2") and rows(sinks.current(spark, root)) == {(1, "b"), (2, "c")}
    assert rows(sinks.upsert(one, two, ["k"], replace=False)) == {(1, "a"), (2, "c")} and sinks.verified_write(two, str(tmp_path / "w")) == 2
    chunks = spark.createDataFrame([("r", "A / B", "page", 3, "", 0), ("r", "A / B", "text", None, "sum", 1), ("r", "A", "image", None, "img", 2), ("q", "T", "table", None, None, 0)], "revision string, path string, chunk_type string, n_pages int, summary string, sort_order int")
    assert rows(sinks.navigation(chunks)) == {("r", "A", 0, 4, 1, None), ("r", "A / B", 4, 4, 2, "sum"), ("q", "T", 1, 1, 1, None)}
    assert rows(sinks.package_statistics(chunks)) == {("r", 3, 1, 1, 0, 1), ("q", 1, 0, 0, 1, 0)}


def test_text_functions(spark):
    df = spark.createDataFrame([("a∕b/c",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(text.unescape_segment(text.escape_segment(F.col("t"))).alias("x")).collect()] == ["a∕b/c", "", None]
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.tokens(F.lit("Été x 中 ab12, été"))) == ["été", "ab12", "été"]
    assert get(text.normal_path(F.lit(" a //b/ "))) == "a / b" and get(text.normal_path(F.lit(None).cast("string"))) == "Root" and get(text.parent_path(F.lit("a / b"))) == "a"
    assert get(text.preview(F.lit(" ".join(map(str, range(9)))), 2, 2)) == "0 1 … 7 8" and get(text.mask_key(F.lit("abcdefghij"))) == "abcd...ghij"
    assert get(structure.time_range(F.lit(1000), F.lit(3_661_000))) == "[00:00:01–01:01:01]"
    assert get(structure.inline_assets(F.lit("a {i} b"), F.array(F.struct(F.lit("{i}").alias("ref"), F.lit("T").alias("body")), F.struct(F.lit("{j}").alias("ref"), F.lit("U").alias("body"))))) == "a T b\nU"
    chain = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "b", "D")], "node string, parent string, title string")
    assert rows(structure.collapse_single_chains(chain)) == {("a", None, "A / B"), ("c", "a", "C"), ("d", "a", "D")}


def test_node_filter_of_nothing(spark):
    df = spark.createDataFrame([("s", "A / B", 1)], "scope string, path string, v int")
    assert trees.node_filter(df, "scope", F.col("v") > 5).count() == 0 and isinstance(sheets.split_regions(pd.DataFrame({"row": [], "col": [], "value": []})), pd.DataFrame)
