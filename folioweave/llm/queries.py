"""One registered query for each operator of this subpackage, under the production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: A demonstration key; production passes its own secret.
PII_KEY = "folioweave-demo-key"


def op1_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .feistel import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY, count_col="n_replaced").withColumn("n_chars", F.length("text").cast("long"))


def op2_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), width=50, give_text=False)


def _remainder(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(_remainder(3) != 1), lang_col="lang")
    return toxicity(docs, model, lang_col="lang").select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted", "predicted_lang")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_pitmanyor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitmanyor import score

    return score(_table(spark, sf_dir, "documents"), _remainder(5) == 1)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(_remainder(5) != 0), order=F.xxhash64("doc_id"))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, topic_of

    docs = _table(spark, sf_dir, "documents")
    mixed = mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}, fraction=0.8)
    return mixed.select("doc_id", *(c for c in mixed.columns if c.startswith("mix_")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel": op1_feistel,
    "op2_itq": op2_itq,
    "op3_minhash": op3_minhash,
    "op4_substring": op4_substring,
    "op5_toxicity": op5_toxicity,
    "op6_nearest": op6_nearest,
    "op7_pitmanyor": op7_pitmanyor,
    "op8_packing": op8_packing,
    "op9_langid": op9_langid,
    "op10_mixing": op10_mixing,
}

LINKED = """
closure(id, root) AS (SELECT id, id FROM ids UNION SELECT e.b, c.root FROM closure c JOIN edges e ON e.a = c.id),
component AS (SELECT id, min(root) AS component_id FROM closure GROUP BY id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_itq": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
u AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
edges AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id AND list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
ids AS (SELECT vec_id AS id FROM embeddings), {LINKED}
SELECT id AS vec_id, (SELECT count(*) FROM edges WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM component""",
    "op3_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM w),
h AS MATERIALIZED (SELECT id, unnest(s) AS x, len(s) AS n FROM s),
edges AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM h p JOIN h q ON p.x = q.x AND p.id <> q.id AND 100 * p.n >= 80 * q.n AND 100 * q.n >= 80 * p.n
  GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
ids AS (SELECT doc_id AS id FROM documents), {LINKED}
SELECT id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM component JOIN s USING (id)""",
    "op4_substring": r"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], chr(1))) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
bad AS (SELECT doc_id, i FROM win JOIN low USING (h) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM bad),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_nearest": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
p AS (SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.id <> c.id AND q.id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 20""",
}
