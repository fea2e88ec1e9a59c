"""What a worker or the driver holds must not grow with the tables."""

import tracemalloc

import pyarrow as pa

from folioweave.operators import compose, metadata, sections, traverse, validate
from folioweave.operators.graph import Graph, build
from folioweave.sources.batches import slices


class Caught:
    """Stands for a DataFrame and keeps the function that would run on its batches."""

    def select(self, *columns):
        return self

    join = where = withColumn = select

    def mapInArrow(self, run, shape):  # noqa: N802
        self.run = run
        return self


def peak_mb(run, batch):
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak / 1e6


def pages(n, words):
    return [{"path": f"/w/d{i}.md", "content": f"# D\n\n```yaml\nsection: d{i}\n```\n\n" + "word " * words} for i in range(n)]


def test_slices_hold_all_rows_in_order():
    rows = pages(50, 30) + pages(1, 5000) + [{"path": "/w/null.md", "content": None}]
    parts = list(slices(pa.RecordBatch.from_pylist(rows), 2000))
    assert [r for p in parts for r in p.to_pylist()] == rows
    assert all(p.nbytes <= 2000 or p.num_rows == 1 for p in parts)
    assert [p.num_rows for p in slices(pa.RecordBatch.from_pylist(rows[:0], pa.schema([("path", pa.string())])))] == [0]


def test_parsing_holds_a_slice_of_a_batch(spark):
    rows, mb = peak_mb(sections.parse(Caught()).run, pa.RecordBatch.from_pylist(pages(2000, 2000)))  # 20 MB
    assert rows == 2000 and mb < 8


def test_hops_send_no_table_to_the_driver(spark, monkeypatch):
    plans, real = [], traverse.kept
    monkeypatch.setattr(traverse, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    pairs = [(f"/w/d{i}.md#d{i}", f"/w/d{i + 1}.md#d{i + 1}") for i in range(4)] + [("/w/d4.md#d4", "/w/d3.md#d3")]
    directives = spark.createDataFrame([(a, "/w", 0, "include", b, None) for a, b in pairs], "src_uri string, file_path string, ord int, type string, target_uri string, label string")
    nodes = spark.createDataFrame([(a,) for a, _ in pairs], "uri string").distinct()
    graph = Graph(nodes, directives, None)
    assert traverse.impact(graph, "/w/d4.md#d4").count() == 4
    assert traverse.nodes_on_cycles(graph.edges.select("src", "dst")).count() == 2
    assert traverse.explain(graph, "/w/d0.md#d0", "/w/d2.md#d2").count() == 3
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 10 and not any("Broadcast" in p for p in joins)


def test_composition_sends_no_text_to_the_driver(spark):
    text = "# A\r\n\r\n```yaml\r\nsection: a\r\n```\r\n\r\none\rtwo\n[@include: b](b.md#b)\n\nlast\r\n"
    graph = build(spark.createDataFrame([("/w/a.md", text), ("/w/b.md", "# B\n\n```yaml\nsection: b\n```\n")], "path string, content string"))
    composed, _ = compose.compose(graph)
    assert "Broadcast" not in composed._jdf.queryExecution().executedPlan().toString()
    want = "# A\n\n```yaml\nsection: a\n```\n\none\ntwo\n## B\n\n```yaml\nsection: b\n```\n\nlast"
    assert {r["root"]: r["content"] for r in composed.collect()}["/w/a.md#a"] == want


def test_schema_checks_hold_a_slice_of_a_batch(spark):
    meta, caught = '{"schema": "s.json", "x": "' + "word " * 2000 + '"}', Caught()
    validate.schema_findings(Graph(caught, None, None), {"/w/s.json": {"required": ["y"]}})
    rows = [{"uri": f"/w/d{i}.md#d{i}", "meta_json": meta, "schema_ref": "s.json", "schema_path": "/w/./s.json"} for i in range(2000)]
    n, mb = peak_mb(caught.run, pa.RecordBatch.from_pylist(rows))
    assert n == 2000 and mb < 8


def test_edits_hold_a_slice_of_a_batch(spark):
    edits = spark.createDataFrame([("/w/d1.md", "d1", "a", "1")], "path string, id string, key string, value_json string")
    rows = [{**p, "edits": [{"id": p["path"][3:-3], "key": "a", "value_json": "1"}]} for p in pages(2000, 2000)]
    n, mb = peak_mb(metadata.edit(Caught(), edits).run, pa.RecordBatch.from_pylist(rows))
    assert n == 2000 and mb < 8
