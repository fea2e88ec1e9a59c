import random
from datetime import date

import pytest

from folioweave.operators import compose, diff, lookup, markers, metadata, next_id, packages, traverse, validate
from folioweave.operators.graph import Graph, ParseFailed, build, update
from folioweave.operators.predicates import QueryError, compile_query
from pyspark.sql import functions as F


def page(name, links="", **meta):
    lines = "".join(f"{k}: {v}\n" for k, v in meta.items())
    return (f"/w/{name}.md", f"# {name.title()}\n\n```yaml\nsection: {name}\n{lines}```\n\n{links}\n")


def u(name):
    return f"/w/{name}.md#{name}"


def graph_of(spark, *pages, **how):
    return build(spark.createDataFrame(list(pages), "path string, content string"), **how)


@pytest.fixture(scope="module")
def wiki(spark):
    return graph_of(
        spark,
        page("intro", "[@ref: a](a.md#a)\n[@include: b](b.md#b)", title="Start", tags="x, y", status="done"),
        page("a", "see [@include](c.md#c) inline", tags="[x, z]", owner="{name: N, team: T}"),
        page("b", "[@include: c](c.md#c)\n[@include: gone](no.md#no)", status="todo"),
        page("c", "[@include: b](b.md#b)", retries=3),
    )


def uris(df, col="uri"):
    return sorted(r[col] for r in df.collect())


def test_lookups(wiki):
    assert uris(lookup.search(wiki, "tag:x")) == [u("a"), u("intro")]
    assert uris(lookup.search(wiki, "id=a")) == [u("a")] and uris(lookup.search(wiki, "section=a")) == [] and uris(lookup.search(wiki, "nonsense")) == []
    assert uris(lookup.query(wiki, "section=a OR title~=star")) == [u("a"), u("intro")]
    assert uris(lookup.query(wiki, "NOT (status=done OR status=todo) AND id~=/^[ac]/")) == [u("a"), u("c")]
    assert len(uris(lookup.query(wiki, ""))) == 4
    assert uris(lookup.query(wiki, "status=done AND")) == [u("intro")]
    with pytest.warns(UserWarning):
        assert uris(lookup.query(wiki, "status=done status=todo")) == [u("intro")]
    with pytest.raises(QueryError):
        compile_query("status=done status=todo", strict=True)
    with pytest.raises(QueryError):
        compile_query("id~=/[/")
    assert uris(lookup.query(wiki, "owner~=\"'team': 'T'\"")) == [u("a")]
    assert [tuple(r) for r in lookup.backlinks(wiki, u("c")).collect()] == [(u("c"), u("a"), "include"), (u("c"), u("b"), "include")]
    row = lookup.context(wiki, u("intro")).first()
    assert [tuple(x) for x in row["outgoing"]] == [(u("a"), "ref"), (u("b"), "include")] and row["incoming"] == []
    assert lookup.get(wiki, u("c")).first()["source_end_line"] == 8
    assert lookup.metadata(wiki, "owner.team", u("a")).first()["value"] == '"T"'
    assert lookup.metadata(wiki, "owner.none", u("a")).isEmpty()
    with pytest.raises(ValueError):
        lookup.section(wiki, "no fragment")


def test_traversals(wiki):
    assert [tuple(r) for r in traverse.impact(wiki, u("c")).collect()] == [(u("a"), "direct"), (u("b"), "direct"), (u("c"), "indirect"), (u("intro"), "indirect")][:2] + [(u("intro"), "indirect")]
    assert {(r["uri"], r["distance"], r["direction"]) for r in traverse.neighbors(wiki, u("b"), 1).collect()} == {(u("c"), 1, "outgoing"), (u("no"), 1, "outgoing"), (u("intro"), 1, "incoming")}
    assert {r["path_id"] for r in traverse.explain(wiki, u("intro"), u("c")).collect()} == {" > ".join(map(u, p)) for p in (("intro", "a", "c"), ("intro", "b", "c"))}
    assert traverse.explain(wiki, u("c"), u("intro")).isEmpty() and traverse.explain(wiki, u("c"), u("c")).count() == 1
    assert uris(traverse.include_cycles(wiki)) == [u("b"), u("c")]
    rows = [(r["uri"], r["depth"], r["cycle"]) for r in traverse.tree(wiki, u("b")).collect()]
    assert rows == [(u("b"), 0, False), (u("c"), 1, False), (u("b"), 2, True), (u("no"), 1, False)]
    assert traverse.tree(wiki, u("b"), depth=0).count() == 1
    assert [r["last"] for r in traverse.last_children(traverse.tree(wiki, u("b"))).collect()] == [True, False, True, True]
    files = wiki.sections.select(F.col("file_path").alias("path"))
    assert uris(traverse.reachable_files(wiki, ["/w/b.md"], files), "file_path") == ["/w/b.md", "/w/c.md"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_digraphs_against_plain_python(spark, seed):
    rng = random.Random(seed)
    n = 14
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(18)})
    name = "n{}".format
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "src string, dst string")
    out = {i: [b for a, b in pairs if a == i] for i in range(n)}

    def dist(start):
        d, q = {start: 0}, [start]
        for x in q:
            for y in out[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    q.append(y)
        return d

    seeds = spark.createDataFrame([(name(i), name(i)) for i in range(4)], "seed string, uri string")
    got = {(r["seed"], r["uri"], r["distance"]) for r in traverse.bfs(edges.withColumn("direction", F.lit("o")), seeds).collect()}
    assert got == {(name(i), name(k), v) for i in range(4) for k, v in dist(i).items()}
    cyclic = {name(i) for i in range(n) if any(i in dist(y) for y in out[i])}
    assert {r["uri"] for r in traverse.nodes_on_cycles(edges).collect()} == cyclic


def test_compose(spark, wiki):
    text, notes = compose.compose(wiki, u("b"))
    body = text.first()["content"]
    assert body.startswith("# B\n") and "\n## C\n" in body and '<!-- unresolved uri="/w/no.md#no" -->' in body
    assert {tuple(r) for r in notes.collect()} == {(u("b"), "cycle", u("b")), (u("b"), "missing", u("no"))}
    assert compose.compose_once(wiki, u("b")) == body
    flat = compose.compose(wiki, u("b"), depth=0)[0].first()["content"]
    assert "## C" not in flat and "@include" not in flat
    with pytest.raises(compose.MissingSection):
        compose.compose(wiki, u("b"), strict=True)
    with pytest.raises(compose.MissingSection):
        compose.compose(wiki, u("zzz"))
    inline = compose.compose(wiki, u("a"))[0].first()["content"]
    assert "[@include](c.md#c) inline" in inline
    cut = compose.context_compose(wiki, u("b"), token_limit=5).first()
    assert cut["content"] == body[:20] and cut["token_estimate"] == 5 and cut["truncated"]
    twice = graph_of(spark, page("r", "[@include](s.md#s)\n[@include](s.md#s)\n```\n# not code\n```"), page("s"))
    once = compose.compose_once(twice, u("r"))
    assert once.count("## S") == 1 and f"@ref({u('s')})" in once
    assert compose.compose(twice, u("r"))[0].first()["content"].count("## S") == 2


def test_diff_and_update(spark, wiki):
    new = graph_of(spark, page("intro", "[@ref: a](a.md#a)", status="open"), page("a"), page("d"))
    rows = {tuple(r) for r in diff.diff(wiki, new).collect()}
    assert ("section", "added", u("d"), None) in rows and ("section", "removed", u("b"), None) in rows and ("edge", "removed", u("intro"), u("b")) in rows
    assert {tuple(r) for r in diff.metadata_changes(wiki, new).where("key = 'status'").collect()} == {(u("intro"), "status", "done", "open")}
    docs = spark.createDataFrame([page("a"), page("b", status="one")], "path string, content string")
    empty = spark.createDataFrame([], "path string, sha256 string, sections array<struct<id:string>>, problems array<string>")
    from folioweave.operators.sections import parse

    first = parse(docs).join(docs.select("path", F.sha2("content", 256).alias("sha256")), "path").select("path", "sha256", "sections", "problems")
    now = spark.createDataFrame([page("a"), page("b", status="two"), page("c")], "path string, content string")
    merged, plan = update(spark, first, now)
    assert {tuple(r) for r in plan.collect()} == {("/w/a.md", "reuse"), ("/w/b.md", "parse"), ("/w/c.md", "parse")}
    assert merged.count() == 3 and empty.isEmpty()


def test_validation(spark, wiki, tmp_path):
    files = wiki.sections.select(F.col("file_path").alias("path")).union(spark.createDataFrame([("/w/CONSTITUTION.md",), ("/w/.hidden/x.md",)], "path string"))
    flows = [{"name": "w", "section_pattern": "[ab]", "allowed_statuses": ["done"]}, {"name": "bad", "section_pattern": "["}]
    found = validate.validate(wiki, workflows=flows, files=files, root="/w")
    kinds = sorted(r["type"] for r in found.collect())
    assert kinds == sorted(["broken_include", "cycle", "cycle", "workflow_status_error", "workflow_status_error"] + ["unreachable_file"] * 4)
    row = validate.summary(wiki, found).first()
    assert tuple(row) == (4, 6, 9, 0)
    g = graph_of(spark, page("s", schema="s.json", n="true"), page("t", schema="none.json"), page("v", schema="s.json", n=5), page("w", schema="[1]"))
    rows = {(r["uri"], r["type"], r["path"]) for r in validate.schema_findings(g, {"/w/s.json": {"properties": {"n": {"type": "integer", "minimum": 6}}}}).collect()}
    assert rows == {(u("s"), "schema_validation_error", "n"), (u("t"), "schema_not_found", "schema"), (u("v"), "schema_validation_error", "n"), (u("w"), "schema_validation_error", "schema")}
    with pytest.raises(ParseFailed):
        graph_of(spark, ("/w/x.md", "# X\n\ntext\n\n```yaml\nsection: x\n```\n"), permissive=False)
    wiki.save(str(tmp_path / "g"))
    assert Graph.load(spark, str(tmp_path / "g")).edges.count() == 6


def test_metadata_edits(spark):
    path, text = page("a", "tail", owner="{name: N}", status="todo")
    new = metadata.updated(text, "a", "owner.team", '"T"')
    assert metadata.read(new, "a", "owner") == {"name": "N", "team": "T"} and new.endswith("tail\n")
    assert "status" not in metadata.read(metadata.unset(text, "a", "status"), "a")
    for bad in ("section", "status.x", "a..b"):
        with pytest.raises(KeyError):
            metadata.updated(text, "a", bad, "1")
    docs = spark.createDataFrame([(path, text)], "path string, content string")
    edits = spark.createDataFrame([(path, "a", "status", '"done"'), (path, "zz", "x", "1")], "path string, id string, key string, value_json string")
    assert metadata.edit(docs, edits).first()["error"]


def test_next_id(spark):
    g = graph_of(spark, page("B-001"), page("B-015"), page("other"))
    assert next_id.next_id(g, "B", r"B-(\d+)") == "B-016"
    assert next_id.next_id(g, "X_", r"X-(\d{4})") == "X_0001"
    assert next_id.next_id(g, "Y/", r"Y-\d\d") == "Y/01"


def test_packages_and_markers(spark):
    files = {"manifest.yaml": b"name: p\nvariables:\n- {name: who, default: you}\n- {name: xs, default: [1, 2]}\nfiles:\n- {template: a.md.j2, target: '{{ who }}.md'}\n", "en/a.md.j2": b"hi {{ who }}{% for x in xs %} {{ x }}{% endfor %}"}
    archive = packages.pack(files)
    assert archive == packages.pack(dict(reversed(files.items())))
    back = packages.unpack(archive)
    assert packages.instantiate(back, {"who": "me"}) == {"me.md": "hi me 1 2\n"}
    with pytest.raises(packages.PackageError):
        packages.unpack(archive, "00")
    with pytest.raises(packages.PackageError, match="not there: a.md.j2"):
        packages.pack({"manifest.yaml": files["manifest.yaml"]})
    dated = {"manifest.yaml": b"name: p\nfiles:\n- {template: d.j2, target: d}\n", "d.j2": b"{{ created_at }}"}
    assert packages.instantiate(dated, {}, today=date(2024, 5, 1)) == {"d": "2024-05-01\n"} and packages.instantiate(dated, {"created_at": "x"}) == {"d": "x\n"}
    for unsafe in ("../x", "/x"):
        with pytest.raises(packages.PackageError):
            packages.pack({**files, unsafe: b""})
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    assert packages.digest(df).first()["digest"] == packages.sign(files)["digest"]
    texts = spark.createDataFrame([("old\n",), (None,), ("<s>\nx\n<e>",)], "t string")
    put = texts.select(markers.upsert(F.col("t"), "b$1\\", "<s>", "<e>", at_top=False).alias("t"))
    assert [r[0] for r in put.collect()] == ["old\n\n<s>\nb$1\\\n<e>\n", "<s>\nb$1\\\n<e>\n", "<s>\nb$1\\\n<e>"]
    assert [r[0] for r in put.select(markers.removed(F.col("t"), "<s>", "<e>")).collect()] == ["old\n", None, None]


def test_sources(spark, tmp_path):
    import subprocess

    from folioweave.sources.readers import configuration, git_snapshot, markdown_folder, package_folder
    from folioweave.streaming.ingest import current, ingest

    root = tmp_path / "docs dir"
    (root / ".h").mkdir(parents=True)
    for name in ("a.md", ".h/b.md", "c.txt"):
        (root / name).write_text(page("a")[1])
    assert sorted(r["path"] for r in markdown_folder(spark, str(root), f"{root}/.h").collect()) == [f"{root}/.h/b.md", f"{root}/a.md"]
    assert sorted(r["path"] for r in package_folder(spark, str(root)).collect()) == ["a.md", "c.txt"]
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init")
    git("add", "-A")
    git("commit", "-m", "one")
    (root / "a.md").write_text("# changed")
    assert git_snapshot(spark, str(root), "HEAD").where("path like '%/a.md'").first()["content"] == page("a")[1]
    assert configuration("a: [") == {} and configuration("memory_root: m") == {"memory_root": "m"}
    for _ in range(2):
        ingest(spark, str(root), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert current(spark, str(tmp_path / "t")).count() == 1


def test_width_of_a_first_number():
    from folioweave.operators.next_id import width_of

    assert [width_of(p) for p in (r"d(\d+)", r"d(\d{4})", r"(\d\d)", "d", r"(\d{2,5})", r"(\d{2,})")] == [1, 4, 2, 3, 2, 1]


def test_directive_labels_and_include_lines():
    from folioweave.operators.sections import directive_of, include_of

    assert directive_of("@ref: a: b") == ("ref", "a: b") and directive_of("@query") == ("query", "")
    assert directive_of("ref: a") is None and directive_of("@refer") is None
    assert include_of("[@include: x](a.md#b)") == "a.md#b" and include_of("[@include](a.md)") == "a.md"
    assert all(include_of(x) is None for x in ("[@ref: x](a.md)", "[@include: x](a.md) more", "[@include: a]b](c.md)", "", "[x]"))
