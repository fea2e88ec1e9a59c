"""Registered queries over the tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose, diff, lookup, markers, metadata, next_id, packages, traverse, validate
from ..operators.graph import Graph, build, from_parsed, update
from ..operators.sections import parse
from ..sources.readers import schema_document
from .corpus import SCHEMA, WORKFLOWS, corpus_documents, corpus_graph, key_graph, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The same graph in closed form; it never parses.
FACTS = """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT doc_id AS i, '/corpus/d' || doc_id || '.md#d' || doc_id AS uri, lang, source,
        ['todo', 'doing', 'done', 'blocked'][doc_id % 4 + 1] AS status, 'team' || (doc_id % 7) AS owner FROM documents),
dirs AS (
  SELECT i, 0 AS ord, 'ref' AS type, (7 * i + 3) % (n.n + 5) AS j, 'next' AS label FROM d, n
  UNION ALL SELECT i, 1, 'include', 3, 'three' FROM d WHERE i = 0
  UNION ALL SELECT i, 2, 'include', i // 2, 'half' FROM d WHERE i >= 1 AND i % 3 <> 0
  UNION ALL SELECT i, 3, 'include', i + 1, 'pair' FROM d, n WHERE i % 100 = 98 AND i + 1 < n.n
  UNION ALL SELECT i, 3, 'include', i - 1, 'pair' FROM d WHERE i % 100 = 99),
edges AS (SELECT i, j, arg_min(type, ord) AS type FROM dirs GROUP BY i, j)
"""


def uri(i: str) -> str:
    return f"'/corpus/d' || {i} || '.md#d' || {i}"


def registered(sql: str | None, plain: bool = False):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if plain else FACTS + sql
        return f

    return add


def node(i: int) -> str:
    return f"/corpus/d{i}.md#d{i}"


@registered("SELECT uri, 'd' || i AS id, 'Doc ' || i AS heading_text, 1 AS heading_level, 1 AS start_line, 'Document ' || i AS title, status, owner, lang || ',' || source AS tags FROM d")
def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = from_parsed(parse(corpus_documents(spark, sf_dir))).sections
    return s.select("uri", "id", "heading_text", "heading_level", "start_line", "title", "status", "owner", F.concat_ws(",", "tags").alias("tags"))


@registered(f"SELECT {uri('i')} AS src_uri, type, {uri('j')} AS target_uri, label FROM dirs")
def directive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_parsed(parse(corpus_documents(spark, sf_dir))).directives.select("src_uri", "type", "target_uri", "label")


def _found(name: str, how: str, text: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = from_parsed(parse(corpus_documents(spark, sf_dir)))
        return (lookup.search if how == "search" else lookup.query)(graph, text).select("uri")

    run.__name__ = name
    registered(f"SELECT uri FROM d WHERE {where}")(run)


_found("search_exact", "search", "status=done", "status = 'done'")
_found("search_substring", "search", "source~=SRC1", "contains(lower(source), 'src1')")
_found("search_tag", "search", "tag:fr", "lang = 'fr'")
_found("query_bool", "query", "(tag:en OR tag:de) AND status=done AND NOT owner=team3", "lang IN ('en', 'de') AND status = 'done' AND owner <> 'team3'")
_found("query_not", "query", "NOT NOT tag:es OR NOT status~=O", "lang = 'es' OR NOT contains(lower(status), 'o')")
_found("query_regex", "query", r"id~=/^d\d*7$/", "regexp_matches('d' || i, '^d[0-9]*7$')")
_found("query_pseudo", "query", "path~=/D12 OR heading=\"Doc 7\" OR section=d9", "contains('/corpus/d' || i || '.md', '/d12') OR i IN (7, 9)")
_found("query_values", "query", "reviewed=True AND priority=3 OR tags~=src1 AND created=2024-01-05", "(i % 2 = 0 AND i % 7 = 3) OR (contains(source, 'src1') AND i % 28 = 4)")
_found("query_differs", "query", "status!=todo AND missing=x OR lang!=en", "lang <> 'en'")


@registered(f"""SELECT uri, (SELECT string_agg({uri('e.j')} || ' ' || e.type, ',' ORDER BY {uri('e.j')}, e.type) FROM edges e WHERE e.i = d.i) AS outgoing,
coalesce((SELECT string_agg({uri('e.i')} || ' ' || e.type, ',' ORDER BY {uri('e.i')}, e.type) FROM edges e WHERE e.j = d.i), '') AS incoming FROM d""")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(" ", x["uri"], x["type"]))).alias(c)
    return lookup.context(corpus_graph(spark, sf_dir)).select("uri", flat("outgoing"), flat("incoming"))


@registered(f"SELECT {uri('j')} AS target, {uri('i')} AS uri, type FROM edges")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.backlinks(corpus_graph(spark, sf_dir))


@registered("SELECT (SELECT count(*) FROM d) AS total_sections, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM dirs, n WHERE j >= n.n) AS errors, CAST(0 AS BIGINT) AS warnings")
def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = corpus_graph(spark, sf_dir)
    return validate.summary(graph, validate.broken_targets(graph))


@registered(f"SELECT 'broken_' || type AS type, {uri('i')} AS uri, 'no section ' || {uri('j')} AS detail FROM dirs, n WHERE j >= n.n")
def broken_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.broken_targets(corpus_graph(spark, sf_dir)).select("type", "uri", "detail")


@registered(f""", back AS (SELECT CAST(0 AS BIGINT) AS i UNION SELECT edges.i FROM back JOIN edges ON edges.j = back.i)
SELECT {uri('i')} AS uri, CASE WHEN i IN (SELECT i FROM edges WHERE j = 0) THEN 'direct' ELSE 'indirect' END AS scope
FROM back WHERE i <> 0 OR 0 IN (SELECT i FROM edges WHERE j = 0)""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.impact(corpus_graph(spark, sf_dir), node(0))


BOTH = """, pairs AS (SELECT i, j, 'outgoing' AS direction FROM edges UNION ALL SELECT j, i, 'incoming' FROM edges),
one AS (SELECT i AS seed, j, max(direction) AS direction FROM pairs WHERE i <> j GROUP BY 1, 2),
two AS (SELECT one.seed, pairs.j, max(pairs.direction) AS direction FROM one JOIN pairs ON pairs.i = one.j
  WHERE pairs.j <> one.seed GROUP BY 1, 2)
"""


@registered(f"""{BOTH} SELECT {uri('seed')} AS seed, {uri('j')} AS uri, 1 AS distance, direction FROM one JOIN d ON d.i = seed
UNION ALL SELECT {uri('seed')}, {uri('two.j')}, 2, direction FROM two JOIN d ON d.i = seed
WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.seed = two.seed AND one.j = two.j)""")
def neighbors_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighbors(corpus_graph(spark, sf_dir), depth=2)


@registered(""", go AS (SELECT CAST(1 AS BIGINT) AS i UNION SELECT edges.j FROM go JOIN edges ON edges.i = go.i, n WHERE edges.j < n.n)
SELECT '/corpus/d' || i || '.md' AS file_path FROM go""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpus_documents(spark, sf_dir)
    return traverse.reachable_files(build(documents), ["/corpus/d1.md"], documents.select("path"))


@registered(f""", inc AS (SELECT DISTINCT i, j, type FROM dirs WHERE type = 'include'),
walk AS (SELECT CAST(398 AS BIGINT) AS i, [CAST(398 AS BIGINT)] AS path FROM n
  UNION ALL SELECT e.j, list_append(path, e.j) FROM walk JOIN inc e ON e.i = walk.i WHERE NOT list_contains(path, e.j) AND walk.i <> 24),
done AS (SELECT path, array_to_string([{uri('x')} for x in path], ' > ') AS path_id FROM walk WHERE i = 24),
steps AS (SELECT path_id, path, unnest(range(len(path))) AS step FROM done)
SELECT path_id, CAST(step AS INTEGER) AS step, {uri('path[step + 1]')} AS uri, e.type AS edge_type
FROM steps LEFT JOIN inc e ON step > 0 AND e.i = path[step] AND e.j = path[step + 1]""")
def explain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All simple paths over include edges, of any length."""
    graph = corpus_graph(spark, sf_dir)
    return traverse.explain(Graph(graph.sections, graph.directives.where("type = 'include'"), graph.problems), node(398), node(24))


def _tree_sql(src: str, dst: str) -> str:
    path = "array_to_string([" + uri("x") + " for x in path], ' > ')"
    return f""", walk AS (SELECT i AS root, i, [i] AS path, 0 AS depth, CAST(NULL AS VARCHAR) AS type, false AS cycle FROM d
  UNION ALL SELECT root, e.{dst}, list_append(path, e.{dst}), depth + 1, e.type, list_contains(path, e.{dst})
  FROM walk JOIN edges e ON e.{src} = walk.i WHERE NOT walk.cycle AND depth < 2)
SELECT {uri('root')} AS root, {path} AS path, {uri('i')} AS uri, depth, type, cycle FROM walk"""


def _tree(graph: Graph, incoming: bool) -> DataFrame:
    t = traverse.tree(graph, depth=2, incoming=incoming)
    return t.withColumn("path", F.concat_ws(" > ", "path"))


@registered(_tree_sql("i", "j"))
def tree_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(corpus_graph(spark, sf_dir), False)


@registered(_tree_sql("j", "i"))
def tree_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(corpus_graph(spark, sf_dir), True)


@registered("SELECT uri FROM d, n WHERE (i % 100 = 98 AND i + 1 < n.n) OR i % 100 = 99")
def include_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.include_cycles(corpus_graph(spark, sf_dir))


@registered(None)
def compose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; SQL would hold each composed text several times, so there is none."""
    text, _ = compose.compose(corpus_graph(spark, sf_dir))
    return text.select("root", F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("size"))


@registered(None)
def context_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compose.context_compose(corpus_graph(spark, sf_dir), token_limit=1000)
    return out.select("root", F.sha2("content", 256).alias("digest"), F.col("token_estimate").cast("long").alias("token_estimate"), "truncated")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    return build(corpus_documents(spark, sf_dir, step=11, shift=1).where("doc_id % 10 <> 0")), corpus_graph(spark, sf_dir)


@registered("SELECT 'section' AS kind, 'added' AS change, uri AS src FROM d WHERE i % 10 = 0")
def diff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff(*_snapshots(spark, sf_dir)).where("kind = 'section'").select("kind", "change", "src")


@registered("SELECT 'section' AS kind, 'removed' AS change, uri AS src FROM d WHERE i % 10 = 0")
def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    less, all_ = _snapshots(spark, sf_dir)
    return diff.diff(all_, less).where("kind = 'section'").select("kind", "change", "src")


@registered(f""", old AS (SELECT DISTINCT i, j FROM (SELECT i, (11 * i + 1) % (n.n + 5) AS j FROM d, n UNION ALL SELECT i, j FROM dirs WHERE ord > 0) WHERE i % 10 <> 0),
new AS (SELECT i, j FROM edges)
SELECT 'added' AS change, {uri('i')} AS src, {uri('j')} AS dst FROM (FROM new EXCEPT FROM old)
UNION ALL SELECT 'removed', {uri('i')}, {uri('j')} FROM (FROM old EXCEPT FROM new)""")
def diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff(*_snapshots(spark, sf_dir)).where("kind = 'edge'").select("change", "src", "dst")


@registered("SELECT uri, 'status' AS key, ['todo', 'doing', 'done', 'blocked'][(i + 1) % 4 + 1] AS old, status AS new FROM d")
def diff_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.metadata_changes(corpus_graph(spark, sf_dir, status=1), corpus_graph(spark, sf_dir))


@registered("SELECT 'workflow_status_error' AS type, uri, 'status ''' || status || ''' is not allowed in workflow ''even''' AS detail FROM d WHERE i % 2 = 0 AND status <> 'done'")
def workflow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.workflow_findings(corpus_graph(spark, sf_dir), WORKFLOWS)
    return found.select("type", "uri", "detail")


@registered(""", moves AS (SELECT i, uri, status, ['todo', 'doing', 'done', 'blocked'][(i + 3) % 4 + 1] AS old FROM d),
bad AS (SELECT uri, old, status, 'even' AS w FROM moves WHERE i % 2 = 0 AND status = 'done' AND NOT (old = 'blocked' AND status = 'done')
  UNION ALL SELECT uri, old, status, 'seven' FROM moves WHERE CAST(i AS VARCHAR) LIKE '7%' AND NOT ((old = 'todo' AND status IN ('doing', 'done')) OR (old = 'done' AND status = 'blocked')))
SELECT uri, 'status may not go from ''' || old || ''' to ''' || status || ''' in workflow ''' || w || '''' AS detail FROM bad""")
def workflow_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = validate.status_history(corpus_graph(spark, sf_dir, status=3))
    found = validate.workflow_findings(corpus_graph(spark, sf_dir), WORKFLOWS, history)
    return found.where("type = 'workflow_transition_error'").select("uri", "detail")


@registered("""SELECT 'schema_validation_error' AS type, uri, '/corpus/schema.json' AS schema_path, CASE WHEN i % 7 = 6 THEN 'priority' ELSE 'status' END AS path,
CASE WHEN i % 7 = 6 THEN 'priority fails maximum 5' ELSE 'status fails enum [''todo'', ''doing'', ''done'']' END AS detail
FROM d WHERE i % 5 = 0 AND (i % 7 = 6 OR i % 4 = 3)""")
def schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.schema_findings(corpus_graph(spark, sf_dir), {"/corpus/schema.json": SCHEMA})
    return found.select("type", "uri", "schema_path", "path", "detail")


@registered("""SELECT CASE i % 4 WHEN 0 THEN 'schema_validation_error' WHEN 1 THEN 'schema_not_found' WHEN 2 THEN 'schema_invalid' ELSE 'schema_unreachable_uri' END AS type, uri
FROM d WHERE i % 5 = 0 AND (i % 4 > 0 OR i % 7 = 6)""")
def schema_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sections with a schema one in four is checked; the others name one that is missing, unusable or out of reach."""
    kind = F.col("doc_id") % 4
    ref = F.when(kind == 1, "none.json").when(kind == 2, "list.json").when(kind == 3, "https://example.invalid/s.json").otherwise("schema.json")
    documents = corpus_documents(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\nschema: schema.json\n"), F.concat(F.lit("\nschema: "), ref, F.lit("\n"))))
    known = {"/corpus/schema.json": SCHEMA, "/corpus/list.json": schema_document("[1, 2]"), "https://example.invalid/s.json": None}
    return validate.schema_findings(build(documents), known).select("type", "uri")


@registered(""", go AS (SELECT CAST(1 AS BIGINT) AS i UNION SELECT edges.j FROM go JOIN edges ON edges.i = go.i, n WHERE edges.j < n.n)
SELECT 'unreachable_file' AS type, '/corpus/d' || i || '.md' AS uri FROM d WHERE i NOT IN (SELECT i FROM go)""")
def unreachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = spark.createDataFrame([("/corpus/CONSTITUTION.md", "# Top\n```yaml\nsection: top\n```\n[@ref: one](d1.md#d1)\n")], "path string, content string")
    documents = corpus_documents(spark, sf_dir).select("path", "content").union(top)
    return validate.conformity(build(documents), documents.select("path"), "/corpus").select("type", "uri")


@registered(f"""SELECT type, count(*) AS n FROM (SELECT 'broken_' || type AS type FROM dirs, n WHERE j >= n.n
UNION ALL SELECT 'cycle' FROM d, n WHERE (i % 100 = 98 AND i + 1 < n.n) OR i % 100 = 99
UNION ALL SELECT 'schema_validation_error' FROM d WHERE i % 5 = 0 AND (i % 7 = 6 OR i % 4 = 3)
UNION ALL SELECT 'workflow_status_error' FROM d WHERE i % 2 = 0 AND status <> 'done'
UNION ALL SELECT 'missing_constitution') GROUP BY type""")
def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpus_documents(spark, sf_dir)
    found = validate.validate(build(documents), {"/corpus/schema.json": SCHEMA}, WORKFLOWS, files=documents.select("path"), root="/corpus")
    return found.groupBy("type").agg(F.count("*").alias("n"))


@registered("SELECT 'd-' || (max(i) + 1) AS next_id FROM d")
def next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = from_parsed(parse(corpus_documents(spark, sf_dir)))
    return spark.createDataFrame([(next_id.next_id(graph, "d", r"#d(\d+)"),)], "next_id string")


@registered("SELECT uri, CAST(i % 9 AS VARCHAR) AS value FROM d")
def metadata_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.metadata(from_parsed(parse(corpus_documents(spark, sf_dir))), "limits.retries")


@registered("SELECT uri, CASE WHEN i % 2 = 0 THEN '42' ELSE CAST(i % 9 AS VARCHAR) END AS value, CASE WHEN i % 2 = 0 THEN '' ELSE owner END AS owner FROM d")
def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpus_documents(spark, sf_dir)
    some = documents.where("doc_id % 2 = 0").select("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    edits = some.select("path", "id", F.lit("limits.retries").alias("key"), F.lit("42").alias("value_json")).union(some.select("path", "id", F.lit("owner"), F.lit(None).cast("string")))
    changed = metadata.edit(documents, edits).select("path", "content")
    after = documents.join(changed.select("path"), "path", "left_anti").select("path", "content").union(changed)
    graph = build(after)
    owners = graph.sections.select("uri", F.coalesce("owner", F.lit("")).alias("owner"))
    return lookup.metadata(graph, "limits.retries").join(owners, "uri")


@registered("SELECT '/corpus/d' || i || '.md' AS path, CASE WHEN i % 10 = 0 OR i % 4 = 1 THEN 'parse' ELSE 'reuse' END AS action FROM d UNION ALL SELECT '/corpus/gone.md', 'drop'")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = corpus_documents(spark, sf_dir).select("path", "content", "doc_id")
    old = now.where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 4 == 1, F.concat("content", F.lit("old"))).otherwise(F.col("content"))).select("path", "content")
    old = old.union(spark.createDataFrame([("/corpus/gone.md", "# gone\n")], "path string, content string"))
    stored = old.select("path", F.sha2("content", 256).alias("sha256")).withColumns({"sections": F.lit(None), "problems": F.lit(None)})
    return update(spark, stored, now.select("path", "content"))[1]


@registered(f"""SELECT '/corpus/d' || i || '.md' AS path, CASE i % 50 WHEN 7 THEN 'missing_payload' WHEN 11 THEN 'duplicate_id' WHEN 13 THEN 'payload_not_first' ELSE 'duplicate_payload' END AS type
FROM d WHERE i % 50 IN (7, 11, 13, 17)""")
def parse_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpus_documents(spark, sf_dir)
    kind, id_ = F.col("doc_id") % 50, F.col("doc_id").cast("string")
    payload = F.concat(F.lit("\n```yaml\nsection: d"), id_, F.lit("\n```\n"))
    spoilt = (
        F.when(kind == 7, F.regexp_replace("content", r"section: d\d+", "section:"))
        .when(kind == 11, F.concat("content", F.lit("\n# Again\n"), payload))
        .when(kind == 13, F.regexp_replace("content", "\n\n```yaml", "\n\nfirst\n\n```yaml"))
        .when(kind == 17, F.concat("content", payload))
        .otherwise(F.col("content"))
    )
    return from_parsed(parse(documents.withColumn("content", spoilt))).problems.select("path", "type")


@registered("SELECT sha256(string_agg('nation/' || n_nationkey || '.txt ' || sha256(n_name), chr(10) ORDER BY 'nation/' || n_nationkey || '.txt')) AS digest FROM nation", plain=True)
def package_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select(F.format_string("nation/%d.txt", "n_nationkey").alias("path"), F.col("n_name").cast("binary").alias("content"))
    return packages.digest(files)


@registered("SELECT 'nation/' || n_nationkey || '.txt' AS path, CASE n_nationkey % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'unsigned' WHEN 3 THEN 'size' ELSE 'checksum' END AS problem FROM nation WHERE n_nationkey % 5 > 0", plain=True)
def package_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    files = table(spark, sf_dir, "nation").select("n_nationkey", F.format_string("nation/%d.txt", "n_nationkey").alias("path"), F.col("n_name").alias("content"))
    signed = packages.checksums(files.where(k != 2))
    changed = F.when(k == 3, F.concat("content", F.lit("!"))).when(k == 4, F.concat(F.lit("?"), F.expr("substring(content, 2)"))).otherwise(F.col("content"))
    return packages.verify(files.where(k != 1).select("path", changed.cast("binary").alias("content")), signed)


START, END = "<!-- block start -->", "<!-- block end -->"


@registered(f"SELECT doc_id, sha256('{START}' || chr(10) || 'two' || chr(10) || '{END}' || chr(10) || chr(10) || text) AS digest FROM documents", plain=True)
def marker_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = markers.upsert(F.col("text"), "one", START, END)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(markers.upsert(once, "two", START, END), 256).alias("digest"))


@registered(f"SELECT doc_id, sha256(text || chr(10)) AS digest FROM (SELECT doc_id, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0)", plain=True)
def marker_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = markers.upsert(F.col("text"), "one", START, END, at_top=False)
    docs = table(spark, sf_dir, "documents").where("text is not null and length(trim(text)) > 0")
    return docs.select("doc_id", F.sha2(markers.removed(put, START, END), 256).alias("digest"))


KEYS = """WITH RECURSIVE e AS (SELECT 'nation#' || n_nationkey AS src, 'region#' || n_regionkey AS dst FROM nation
UNION SELECT 'customer#' || c_custkey, 'nation#' || c_nationkey FROM customer UNION SELECT 'supplier#' || s_suppkey, 'nation#' || s_nationkey FROM supplier
UNION SELECT 'orders#' || o_orderkey, 'customer#' || o_custkey FROM orders UNION SELECT 'orders#' || l_orderkey, 'part#' || l_partkey FROM lineitem)
"""


@registered(KEYS + """, back AS (SELECT 'region#1' AS u UNION SELECT e.src FROM back JOIN e ON e.dst = back.u)
SELECT u AS uri, CASE WHEN u LIKE 'nation#%' THEN 'direct' ELSE 'indirect' END AS scope FROM back WHERE u <> 'region#1'""", plain=True)
def key_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.impact(key_graph(spark, sf_dir), "region#1")


@registered(KEYS + "SELECT dst AS target, count(*) AS n FROM e GROUP BY dst", plain=True)
def key_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_graph(spark, sf_dir).edges.groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n"))


@registered(KEYS + """, walk AS (SELECT 'orders#1' AS u, ['orders#1'] AS path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM walk JOIN e ON e.src = walk.u)
SELECT array_to_string(path, ' > ') AS path, u AS uri, len(path) - 1 AS depth FROM walk""", plain=True)
def key_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traverse.tree(key_graph(spark, sf_dir), "orders#1")
    return t.select(F.concat_ws(" > ", "path").alias("path"), "uri", F.col("depth").cast("long").alias("depth"))
