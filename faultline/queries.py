"""The engine's queries over the test tables, and their twins in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .functions import classify
from .functions import text as T
from .operators import conform, eightd, graph, ingest, knowledge, metric, ordered, quality, texteval, vectors
from .plans.fixtures import fmea_rows, kb_cause, kb_vec, query_vector, sent, table, with_views
from .sources.files import route, shared_folder
from .streaming.incremental import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(views, sql) if views else sql.strip()
        return f

    return register


# --- SQL pieces -------------------------------------------------------------------------------------------------


def _d(a: str, b: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), lambda s, v: s + v)"


def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), lambda s, v: s + v)"


def _cos(a: str, b: str) -> str:
    return f"{_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"


def _key(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '^\\s+|\\s+$', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _spaces(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({_plain(x)}, ' '), lambda t: t <> '')"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")" if parts else "false"


def _discipline(x: str) -> str:
    cases = " ".join(f"WHEN list_has_any(regexp_extract_all({_key(x)}, '[a-z0-9]+'), {_list(words)}) THEN '{name}'" for name, words in classify.DISCIPLINES.items())
    return f"CASE {cases} END"


def _number(x: str) -> str:
    t = f"trim({x})"
    return f"CASE WHEN lower({t}) IN ('', 'n/a', 'na', 'null', 'none', '-') THEN NULL WHEN regexp_full_match({t}, '[+-]?\\d+') OR (regexp_full_match({t}, '[+-]?\\d*\\.\\d*([eE][+-]?\\d+)?') AND regexp_matches({t}, '\\d\\.|\\.\\d')) THEN CAST({t} AS DOUBLE) END"


def _content(x: str) -> str:
    return f"list_filter(regexp_extract_all({_spaces(x)}, '[\\p{{L}}\\p{{N}}]+'), lambda t: regexp_full_match(t, '\\p{{L}}{{3,}}') AND NOT list_contains({_list(T.STOP_WORDS)}, t))"


def _set_coverage(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({a})) > 0 THEN len(list_intersect(list_distinct({a}), {b})) / CAST(len(list_distinct({a})) AS DOUBLE) ELSE 0.0 END"


#: Limits that part the test vectors, where the usual ones take all or none of them.
ISOLATED, CONFUSED = 1.45, -0.01

# --- Vector search -----------------------------------------------------------------------------------------------


def _role_queries(spark: SparkSession, sf_dir: str, first: int) -> dict[str, list[float]]:
    return {r: query_vector(spark, sf_dir, first + i) for i, r in enumerate(("failure_mode", "failure_element", "failure_effect"))}


def _search_sql(first: int, k: int) -> str:
    return f"""q AS (SELECT role AS q_role, embedding AS q FROM kb_vec WHERE vec_id BETWEEN {first} AND {first + 2}),
h AS (SELECT failure_id, role, vec_id, {_d("embedding", "q")} AS dist FROM kb_vec JOIN q ON role = q_role),
t AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY dist, vec_id) AS place FROM h),
m AS (SELECT failure_id, sum(CASE role WHEN 'failure_mode' THEN 0.5::DOUBLE WHEN 'failure_element' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * (1 - dist)) AS score, count(DISTINCT role) AS n_roles FROM t WHERE place <= {k} GROUP BY failure_id),
top AS (SELECT * FROM m ORDER BY round(score, 9) DESC, n_roles DESC, failure_id LIMIT {k})"""


@query("WITH " + _search_sql(0, 5) + " SELECT failure_id, round(score, 6) AS score, n_roles FROM top", "kb_vec")
def failure_search_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.search_failures(kb_vec(spark, sf_dir), _role_queries(spark, sf_dir, 0), 5)
    return hits.select("failure_id", F.round("score", 6).alias("score"), "n_roles")


@query(f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT failure_id, cause_id, round({_d('embedding', 'q')}, 6) AS dist FROM kb_cause, q WHERE failure_id = 3 ORDER BY {_d('embedding', 'q')}, cause_id LIMIT 5", "kb_cause")
def cause_search_under_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.search_causes(kb_cause(spark, sf_dir), query_vector(spark, sf_dir, 7), 5, failure_id=3)
    return hits.select("failure_id", "cause_id", F.round("dist", 6).alias("dist"))


@query(f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT failure_id, cause_id, round({_d('embedding', 'q')}, 6) AS dist FROM kb_cause, q ORDER BY {_d('embedding', 'q')}, cause_id LIMIT 5", "kb_cause")
def cause_search_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.search_causes(kb_cause(spark, sf_dir), query_vector(spark, sf_dir, 7), 5)
    return hits.select("failure_id", "cause_id", F.round("dist", 6).alias("dist"))


def _sentence_ids(cause: str):
    return F.array(F.col(cause) * 2 + 1, F.col(cause) * 2, F.col(cause) + 1_000_000)


@query("WITH " + _search_sql(12, 3) + f""",
c AS (SELECT c.failure_id, score, cause_id, {_d("c.embedding", "e.embedding")} AS dist FROM kb_cause c JOIN top USING (failure_id), embeddings e WHERE e.vec_id = 5),
r AS (SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY dist, cause_id) AS place FROM c),
x AS (SELECT failure_id, score, cause_id, dist, unnest([cause_id * 2 + 1, cause_id * 2, cause_id + 1000000]) AS sid, unnest([0, 1, 2]) AS ord FROM r WHERE place <= 5)
SELECT failure_id, round(score, 6) AS score, cause_id, round(dist, 6) AS dist, coalesce(string_agg(CAST(s.sentence_id AS VARCHAR), ',' ORDER BY ord) FILTER (s.sentence_id IS NOT NULL), '') AS evidence
FROM x LEFT JOIN sent s ON sid = s.sentence_id GROUP BY failure_id, score, cause_id, dist""", "kb_vec kb_cause sent")
def failure_cause_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c, s = kb_vec(spark, sf_dir), kb_cause(spark, sf_dir), sent(spark, sf_dir)
    out = vectors.evidence_chain(v, v, c.withColumn("sentence_ids", _sentence_ids("cause_id")), s, _role_queries(spark, sf_dir, 12), query_vector(spark, sf_dir, 5), 3, 5)
    return out.select("failure_id", F.round("score", 6).alias("score"), "cause_id", F.round("dist", 6).alias("dist"), F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("evidence"))


@query(f"""WITH v AS (SELECT s.sentence_id, source_section, assertion_level AS role, CAST(label AS BIGINT) AS failure_id, e.embedding FROM sent s JOIN embeddings e ON s.sentence_id = e.vec_id),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 11)
SELECT sentence_id, role, failure_id, round({_d("embedding", "q")}, 6) AS dist FROM v, q WHERE failure_id = 2 AND role IN ('observed', 'suspected') ORDER BY {_d("embedding", "q")}, sentence_id LIMIT 10""", "sent")
def sentence_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sentence_id"), F.col("label").cast("long").alias("failure_id"), "embedding")
    v = sent(spark, sf_dir).select("sentence_id", F.col("assertion_level").alias("role")).join(e, "sentence_id")
    hits = vectors.search_sentences(v, query_vector(spark, sf_dir, 11), 10, failure_id=2, roles=("observed", "suspected"))
    return hits.select("sentence_id", "role", "failure_id", F.round("dist", 6).alias("dist"))


_PAIRS = f"p AS (SELECT a.vec_id, a.role AS own, b.role AS other, b.vec_id AS neighbour, {_d('a.embedding', 'b.embedding')} AS dist FROM kb_vec a, kb_vec b)"
_COHESION = _PAIRS + """, n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS place FROM p WHERE own = other),
s AS (SELECT vec_id, own AS role, avg(dist) AS avg_dist FROM n WHERE place <= 6 AND dist > 1e-6 GROUP BY vec_id, own)"""


@query("WITH " + _COHESION + " SELECT vec_id, role, round(avg_dist, 6) AS avg_dist FROM s", "kb_vec")
def knn_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cohesion(kb_vec(spark, sf_dir)).select("vec_id", "role", F.round("avg_dist", 6).alias("avg_dist"))


@query("WITH " + _COHESION + ", l AS (SELECT role, avg(avg_dist) + 2.0 * stddev_pop(avg_dist) AS lim FROM s GROUP BY role) SELECT vec_id, s.role, round(avg_dist, 6) AS avg_dist FROM s JOIN l USING (role) WHERE avg_dist > lim", "kb_vec")
def cohesion_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cohesion_outliers(vectors.cohesion(kb_vec(spark, sf_dir))).select("vec_id", "role", F.round("avg_dist", 6).alias("avg_dist"))


@query("WITH " + _COHESION + f" SELECT vec_id, role, round(avg_dist, 6) AS avg_dist FROM s WHERE avg_dist > {ISOLATED}", "kb_vec")
def extreme_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of ISOLATED (default 0.85), which parts the test vectors."""
    return vectors.isolated(vectors.cohesion(kb_vec(spark, sf_dir)), ISOLATED).select("vec_id", "role", F.round("avg_dist", 6).alias("avg_dist"))


@query(f"""WITH p AS (SELECT a.cause_id, b.cause_id AS neighbour, {_d('a.embedding', 'b.embedding')} AS dist FROM kb_cause a, kb_cause b),
n AS (SELECT *, row_number() OVER (PARTITION BY cause_id ORDER BY dist, neighbour) AS place FROM p)
SELECT cause_id, round(avg(dist), 6) AS avg_dist FROM n WHERE place <= 6 AND dist > 1e-6 GROUP BY cause_id""", "kb_cause")
def cause_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kb_cause(spark, sf_dir).withColumnRenamed("cause_id", "vec_id")
    return vectors.cohesion(items, group=None).select(F.col("vec_id").alias("cause_id"), F.round("avg_dist", 6).alias("avg_dist"))


def _confusion_sql(where: str, agg: str, test: str) -> str:
    return f"""WITH {_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY vec_id, other ORDER BY dist, neighbour) AS place FROM p {where}),
g AS (SELECT vec_id, own AS role, other, {agg}(dist) AS d FROM n WHERE place <= 3 GROUP BY vec_id, own, other),
c AS (SELECT vec_id, role, max(CASE WHEN role = other THEN d END) AS cur, arg_min(other, (d, CASE other WHEN 'failure_element' THEN 0 WHEN 'failure_mode' THEN 1 ELSE 2 END)) AS best_role, min(d) AS best FROM g GROUP BY vec_id, role)
SELECT vec_id, role, best_role, round(cur, 6) AS current, round(best, 6) AS best FROM c WHERE best_role <> role AND {test}"""


@query(_confusion_sql("WHERE vec_id <> neighbour", "avg", "cur > 0 AND (cur - best) / cur > 0.1"), "kb_vec")
def role_confusion_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.role_confusion(kb_vec(spark, sf_dir)).select("vec_id", "role", "best_role", F.round("current", 6).alias("current"), F.round("best", 6).alias("best"))


_TWINS = "kb_twin AS (SELECT * FROM kb_vec UNION ALL SELECT failure_id, 'failure_element', vec_id + 1000000, embedding FROM kb_vec WHERE vec_id % 5 = 0)"


@query("WITH " + _TWINS + ", " + _confusion_sql("", "min", f"cur - best > {CONFUSED}").replace("kb_vec", "kb_twin")[5:], "kb_vec")
def role_confusion_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's own role holds itself, at distance 0, so no positive margin (default 0.05) finds any: with a margin of CONFUSED, over vectors of which a fifth have a twin among the elements."""
    v = kb_vec(spark, sf_dir)
    v = v.unionByName(v.where("vec_id % 5 = 0").withColumns({"role": F.lit("failure_element"), "vec_id": F.col("vec_id") + 1_000_000}))
    return vectors.role_confusion(v, margin=CONFUSED, relative=False).select("vec_id", "role", "best_role", F.round("current", 6).alias("current"), F.round("best", 6).alias("best"))


@query(f"""WITH p AS (SELECT a.failure_id AS failure_a, b.failure_id AS failure_b, a.role, {_cos('a.embedding', 'b.embedding')} AS c FROM kb_vec a JOIN kb_vec b ON a.role = b.role AND a.failure_id < b.failure_id),
g AS (SELECT failure_a, failure_b, sum(CASE role WHEN 'failure_mode' THEN 0.5::DOUBLE WHEN 'failure_element' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * c) AS score, string_agg(role, ',' ORDER BY role) AS roles FROM p GROUP BY ALL)
SELECT failure_a, failure_b, round(score, 4) AS score, roles FROM g WHERE score >= 0.3""", "kb_vec")
def near_dup_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a threshold of 0.3 (default 0.92), so that the test vectors have such pairs."""
    return vectors.near_duplicate_failures(kb_vec(spark, sf_dir), threshold=0.3)


@query(f"""WITH f AS (SELECT DISTINCT failure_id FROM kb_cause)
SELECT a.failure_id AS failure_a, b.failure_id AS failure_b, a.cause_id AS cause_a, b.cause_id AS cause_b, round({_cos('a.embedding', 'b.embedding')}, 4) AS similarity
FROM kb_cause a JOIN kb_cause b ON a.failure_id < b.failure_id WHERE {_cos('a.embedding', 'b.embedding')} >= 0.4""", "kb_cause")
def near_dup_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all failure pairs, with a threshold of 0.4 (default 0.90), so that the test vectors have such pairs."""
    return vectors.near_duplicate_causes(None, kb_cause(spark, sf_dir), 0.4)


@query(f"""WITH r AS (SELECT a.failure_id AS failure_a, b.failure_id AS failure_b, sum(CASE a.role WHEN 'failure_mode' THEN 0.5::DOUBLE WHEN 'failure_element' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * {_cos('a.embedding', 'b.embedding')}) AS score FROM kb_vec a JOIN kb_vec b ON a.role = b.role AND a.failure_id < b.failure_id GROUP BY ALL),
p AS (SELECT failure_a, failure_b FROM r WHERE score >= 0.1)
SELECT a.failure_id AS failure_a, b.failure_id AS failure_b, a.cause_id AS cause_a, b.cause_id AS cause_b, round({_cos('a.embedding', 'b.embedding')}, 4) AS similarity
FROM p JOIN kb_cause a ON p.failure_a = a.failure_id JOIN kb_cause b ON p.failure_b = b.failure_id WHERE {_cos('a.embedding', 'b.embedding')} >= 0.1""", "kb_vec kb_cause")
def near_dup_causes_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes of the failure pairs that the failure scan gives, with thresholds of 0.1, so that the test vectors have such pairs."""
    causes = kb_cause(spark, sf_dir)
    # Pairs of failures without causes give none, so only failures with causes are scanned.
    named = kb_vec(spark, sf_dir).join(causes.select("failure_id").distinct(), "failure_id", "left_semi")
    return vectors.near_duplicate_causes(vectors.near_duplicate_failures(named, threshold=0.1), causes, 0.1)


@query("WITH " + _COHESION + " SELECT vec_id, role, round(avg_dist, 6) AS avg_dist FROM s", "kb_vec")
def metric_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_cohesion by the metric index."""
    return metric.cohesion(metric.build(kb_vec(spark, sf_dir))).select("vec_id", "role", F.round("avg_dist", 6).alias("avg_dist"))


@query(f"""SELECT a.role, a.vec_id AS a, b.vec_id AS b, round({_cos('a.embedding', 'b.embedding')}, 4) AS similarity FROM kb_vec a JOIN kb_vec b ON a.role = b.role AND a.vec_id < b.vec_id
WHERE {_cos('a.embedding', 'b.embedding')} >= 0.4""", "kb_vec")
def metric_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of one role from a cosine of 0.4 on, by a range scan of the metric index."""
    v = kb_vec(spark, sf_dir)
    pairs = metric.cosine_pairs(v, 0.4, "role").join(v.select(F.col("vec_id").alias("a"), "role"), "a")
    return pairs.select("role", "a", "b", F.round("similarity", 4).alias("similarity"))


@query("SELECT vec_id, failure_id, role FROM kb_vec WHERE vec_id IN (3, 4, 5)", "kb_vec")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.by_ids(kb_vec(spark, sf_dir), [3, 4, 5]).select("vec_id", "failure_id", "role")


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of components are free, so no SQL twin."""
    return vectors.project(kb_vec(spark, sf_dir), 2)


@query("WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type), c AS (SELECT event_type, least(CAST(floor((value - lo) / (hi - lo) * 50) AS INT), 49) AS bin, count(*) AS n FROM events JOIN r USING (event_type) GROUP BY ALL), e AS (SELECT *, unnest(range(50)) AS bin FROM r) SELECT event_type, CAST(e.bin AS INT) AS bin, round(lo + (hi - lo) * e.bin / 50, 6) AS low, round(lo + (hi - lo) * (e.bin + 1) / 50, 6) AS high, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (event_type, bin)")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the projection's histogram, over a column that SQL can read."""
    bins = vectors.histogram(table(spark, sf_dir, "events"), "value", "event_type")
    return bins.select("event_type", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query()
def projection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first principal component by role; a test holds it against numpy."""
    return vectors.histogram(vectors.project(kb_vec(spark, sf_dir), 1), "pc1", "role")


def _upsert_sql(order: str) -> str:
    return f"SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn {order}) AS p FROM conversations) WHERE p = 1"


@query(_upsert_sql("DESC"))
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.upsert(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(_upsert_sql("ASC"))
def add_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.upsert(table(spark, sf_dir, "conversations"), "conv_id", "turn", first_wins=True).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def _top_rates(original: str, rephrased: str) -> str:
    """Rates over x and y: bools (o1, ok) of the original and (r1, rk) of the rephrased queries by i."""
    rate = lambda c: f"round(avg(CAST({c} AS INT)), 6)"
    return f"SELECT count(*) AS n, {rate('o1')} AS original_top1, {rate('ok')} AS original_recall, {rate('r1')} AS rephrased_top1, {rate('rk')} AS rephrased_recall, {rate('o1 AND NOT r1')} AS regression_rate FROM {original} x JOIN {rephrased} y USING (i)"


@query(f"""WITH n AS (SELECT e.vec_id AS q, cause_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_d('c.embedding', 'e.embedding')}, cause_id) AS p FROM embeddings e, kb_cause c),
t AS (SELECT vec_id AS i, coalesce(lead(vec_id) OVER (ORDER BY vec_id), min(vec_id) OVER ()) AS j FROM embeddings),
x AS (SELECT i, bool_or(cause_id = i AND p = 1) AS o1, bool_or(cause_id = i AND p <= 3) AS ok FROM t JOIN n ON q = i GROUP BY i), y AS (SELECT i, bool_or(cause_id = i AND p = 1) AS r1, bool_or(cause_id = i AND p <= 3) AS rk FROM t JOIN n ON q = j GROUP BY i)
{_top_rates('x', 'y')}""", "kb_cause")
def retrieval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes: each vector as an original query, the next one by number as its rephrased one."""
    causes = kb_cause(spark, sf_dir).select(F.col("cause_id").alias("vec_id"), "embedding")
    near = vectors.nearest(causes, 3, None)
    ids = near.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "neighbour"))), lambda s: s["neighbour"]).alias("ids"))
    return quality.retrieval_accuracy(_original_and_next(ids, "vec_id"))


def _original_and_next(ids: DataFrame, key: str) -> DataFrame:
    """(truth, original_ids, rephrased_ids): results of each query, and of the one that follows it, the first after the last."""
    turn = ids.select(F.col(key).alias("truth"))
    # Numbers of queries alone go through the window.
    turn = turn.withColumn("next", F.coalesce(F.lead("truth").over(Window.orderBy("truth")), F.min("truth").over(Window.partitionBy())))
    original = turn.join(ids.select(F.col(key).alias("truth"), F.col("ids").alias("original_ids")), "truth").select("truth", "original_ids")
    rephrased = turn.join(ids.select(F.col(key).alias("next"), F.col("ids").alias("rephrased_ids")), "next").select("truth", "rephrased_ids")
    return quality.retrieval_pairs(original, rephrased, ("truth",), check=False).select("truth", "o.original_ids", "r.rephrased_ids")


@query(f"""WITH p AS (SELECT a.failure_id AS q, b.failure_id AS f, a.role, b.vec_id, {_d('a.embedding', 'b.embedding')} AS dist FROM kb_vec a JOIN kb_vec b ON a.role = b.role),
h AS (SELECT *, row_number() OVER (PARTITION BY q, role ORDER BY dist, vec_id) AS place FROM p),
m AS (SELECT q, f, sum(CASE role WHEN 'failure_mode' THEN 0.5::DOUBLE WHEN 'failure_element' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * (1 - dist)) AS score, count(DISTINCT role) AS roles FROM h WHERE place <= 3 GROUP BY q, f),
n AS (SELECT q, f, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, roles DESC, f) AS p FROM m),
k AS (SELECT DISTINCT failure_id AS i FROM kb_vec), t AS (SELECT i, coalesce(lead(i) OVER (ORDER BY i), min(i) OVER ()) AS j FROM k),
x AS (SELECT i, bool_or(f = i AND p = 1) AS o1, bool_or(f = i AND p <= 3) AS ok FROM t JOIN n ON q = i GROUP BY i), y AS (SELECT i, bool_or(f = i AND p = 1) AS r1, bool_or(f = i AND p <= 3) AS rk FROM t JOIN n ON q = j GROUP BY i)
{_top_rates('x', 'y')}""", "kb_vec")
def retrieval_accuracy_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures: the three role vectors of each as an original query, those of the next failure as its rephrased one."""
    best = vectors.search_failures_batch(kb_vec(spark, sf_dir), 3)
    ids = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "failure_id"))), lambda s: s["failure_id"]).alias("ids"))
    return quality.retrieval_accuracy(_original_and_next(ids, "query_id"))


# --- Text functions -----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_key('text')}) AS key_md5, md5({_plain('text')}) AS plain_md5, md5({_spaces('text')}) AS spaces_md5 FROM documents")
def normalize_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_key(t)).alias("key_md5"), F.md5(T.normalize_plain(t)).alias("plain_md5"), F.md5(T.normalize_spaces(t)).alias("spaces_md5"))


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, unnest(range(len(s))) AS ord, unnest(s) AS sentence FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ord", "sentence")).withColumn("ord", F.col("ord").cast("long"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with one benchmark item: items take turns in the order of their numbers, all of them and all documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("sentence"))
    turn = items.select("item_id").distinct()
    turn = turn.join(turn.select(F.col("item_id").alias("before")), F.col("before") < F.col("item_id"), "left").groupBy("item_id").agg(F.count("before").alias("turn"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source")).withColumn("turn", F.pmod("doc_id", F.lit(max(1, turn.count()))))
    return docs.repartition(F.xxhash64("doc_id")).join(items.join(turn, "item_id").drop("item_id"), "turn")


_PAIR_SQL = "i AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS turn FROM benchmark), x AS (SELECT doc_id, d.text AS source, i.text AS sentence FROM documents d JOIN i ON i.turn = d.doc_id % (SELECT count(*) FROM benchmark))"


@query(f"WITH {_PAIR_SQL}, t AS (SELECT doc_id, {_tokens('sentence')} AS a, {_tokens('source')} AS b FROM x) SELECT doc_id, round({_set_coverage('a', 'b')}, 6) AS set_coverage, round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda t: list_contains(b, t))) / CAST(len(a) AS DOUBLE) ELSE 0.0 END, 6) AS bag_coverage, round(len(list_intersect(list_distinct(a), b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS jaccard FROM t")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("doc_id", T.tokens(F.col("sentence")).alias("a"), T.tokens(F.col("source")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.select("doc_id", F.round(T.set_coverage(a, b), 6).alias("set_coverage"), F.round(T.bag_coverage(a, b), 6).alias("bag_coverage"), F.round(T.jaccard(a, b), 6).alias("jaccard"))


@query(f"WITH {_PAIR_SQL}, t AS (SELECT doc_id, contains({_spaces('source')}, {_spaces('sentence')}) AS is_exact, {_content('sentence')} AS a, {_content('source')} AS b FROM x) SELECT doc_id, is_exact, round({_set_coverage('a', 'b')}, 6) AS coverage FROM t")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texteval.exact_or_covered(_pairs(spark, sf_dir)).select("doc_id", "is_exact", "coverage")


@query()
def faithfulness_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the token-set ratio, which SQL has not; tests hold it against a plain version."""
    return texteval.faithfulness(_pairs(spark, sf_dir)).select("doc_id", "faithful_type", "faithful_score", "faithful")


@query(f"WITH s AS (SELECT doc_id, text, array_to_string({_SENTENCES}[1:3], ' ') AS summary FROM documents), t AS (SELECT doc_id, len({_tokens('text')}) AS a, len({_tokens('summary')}) AS b FROM s) SELECT doc_id, CAST(a AS INT) AS source_tokens, CAST(b AS INT) AS summary_tokens, round(b / CAST(greatest(a, 1) AS DOUBLE), 6) AS compression_ratio FROM t")
def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"), F.array_join(F.slice(T.sentences(F.col("text")), 1, 3), " ").alias("summary"))
    return texteval.compression(docs).select("doc_id", "source_tokens", "summary_tokens", "compression_ratio")


@query()
def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the token-set ratio; the first two sentences are the summary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"), F.slice(T.sentences(F.col("text")), 1, 2).alias("summary_sentences"))
    return texteval.compression_report(docs)


_VALUABLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\b\\d{1,2}-\\d{1,2}-\\d{4}\\b', '', 'g'), 'motor\\s*\\d+', 'motor', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT doc_id, {_VALUABLE} AS text FROM documents), l AS (SELECT doc_id, {_SENTENCES} AS s FROM n),
r AS (SELECT doc_id, unnest(range(len(s))) AS ord, unnest(s) AS sentence FROM l),
w AS (SELECT *, list_distinct(regexp_extract_all(sentence, '[a-z0-9]+(?:-[a-z0-9]+)*')) AS words FROM r WHERE len(string_split(sentence, ' ')) > 6),
v AS (SELECT doc_id, ord, sentence, round(len(list_intersect(words, {_list(T.FAIL_WORDS)})) * 2 + len(list_intersect(words, {_list(T.CAUSE_WORDS)})) + least(len(words) / 20.0::DOUBLE, 1.0::DOUBLE), 6) AS value FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, ord) AS place FROM v) SELECT doc_id, place, sentence, value FROM p WHERE place <= 10""")
def sentence_value_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texteval.valuable_sentences(table(spark, sf_dir, "documents"))


_NUMBERS = ("7", " 7 ", "7.5", "1e3", "1.e3", ".5", "nan", "N/A", "-", "tbd", "", "-3", "+4.0", "abc", "inf", ".")


@query(f"WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_list(_NUMBERS)}[1 + (event_id // 2) % {len(_NUMBERS)}] ELSE CAST(round(value, 2) AS VARCHAR) END AS raw FROM events) SELECT event_id, {_number('raw')} AS number FROM e")
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.element_at(F.array(*map(F.lit, _NUMBERS)), (F.pmod(F.floor(F.col("event_id") / 2), F.lit(len(_NUMBERS))) + 1).cast("int"))
    raw = F.when(F.col("event_id") % 2 == 0, odd).otherwise(F.round("value", 2).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_number(raw).alias("number"))


_PREFIXED = ("[S01F01] X", "[S01 - HW] Encoder noise", "[A][B] y", "no prefix", "[S02 - esw]", "", "[x] ", "[broken text", "[a-MCH]  two  spaces ")


@query(f"WITH p AS (SELECT p_partkey, concat({_list(_PREFIXED)}[1 + p_partkey % {len(_PREFIXED)}], p_name) AS raw FROM part) SELECT p_partkey, trim(regexp_replace(raw, '^\\[[^\\]]+\\]\\s*', '')) AS stripped, regexp_extract(raw, '^\\[[^\\]-]*-\\s*([A-Za-z]+)\\]\\s*(.*)', 1) AS discipline, CASE WHEN regexp_matches(raw, '^\\[[^\\]-]*-\\s*([A-Za-z]+)\\]\\s*(.*)') THEN trim(regexp_extract(raw, '^\\[[^\\]-]*-\\s*([A-Za-z]+)\\]\\s*(.*)', 2)) ELSE trim(regexp_replace(raw, '^\\[[^\\]]+\\]\\s*', '')) END AS cause FROM p")
def strip_prefix_discipline(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.element_at(F.array(*map(F.lit, _PREFIXED)), (F.col("p_partkey") % len(_PREFIXED) + 1).cast("int")), "p_name")
    both = T.discipline_and_cause(raw)
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_prefix(raw).alias("stripped"), both["discipline"].alias("discipline"), both["cause"].alias("cause"))


@query("SELECT event_id, regexp_extract(concat('Answer: ', props, ' end.'), '(?s)\\{.*\\}', 0) AS json FROM events")
def json_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.json_slice(F.concat(F.lit("Answer: "), "props", F.lit(" end."))).alias("json"))


_TYPES = ("Electronics / General", "Motor/ Connectors", "Mechanics", "Pump / Power board", "Software / Timing", "Pump / Impeller", "Assembly / Specification", "Filter/ Switch", "a/b/c", "Design / Approval", "General", "Firmware")


@query(f"WITH t AS (SELECT p_partkey, concat({_list(_TYPES)}[1 + p_partkey % {len(_TYPES)}], CASE WHEN p_partkey % 5 = 0 THEN concat(' ', p_type) ELSE '' END) AS ft FROM part) SELECT p_partkey, {_discipline('ft')} AS discipline FROM t")
def discipline_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failure_types(spark, sf_dir).select("p_partkey", classify.discipline(F.col("ft")).alias("discipline"))


def _failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = F.concat(F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % len(_TYPES) + 1).cast("int")), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" "), "p_type")).otherwise(F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", ft.alias("ft"))


def _parts_sql(ft: str) -> tuple[str, str]:
    """Discipline and element of a failure type."""
    left, right = _key(f"split_part({ft}, '/', 1)"), _key(f"substr({ft}, strpos({ft}, '/') + 1)")
    generic = f"{right} IN ({', '.join(repr(x) for x in classify.GENERIC_RIGHT)})"
    element = f"(list_has_any(regexp_extract_all({right}, '[a-z0-9]+'), {_list(classify.ELEMENT_RIGHT)}) OR {_any(right, classify.ELEMENT_PARTS)})"
    of_left = _discipline(f"split_part({ft}, '/', 1)")
    d = f"CASE WHEN NOT contains({ft}, '/') THEN {_discipline(ft)} WHEN {generic} THEN {of_left} WHEN {element} THEN NULL ELSE {of_left} END"
    e = f"CASE WHEN NOT contains({ft}, '/') OR {generic} THEN NULL WHEN {element} OR {of_left} IS NULL THEN concat({left}, ' / ', {right}) END"
    return d, e


@query("WITH t AS (SELECT p_partkey, concat(" + _list(_TYPES) + f"[1 + p_partkey % {len(_TYPES)}], CASE WHEN p_partkey % 5 = 0 THEN concat(' ', p_type) ELSE '' END) AS ft FROM part) SELECT p_partkey, {_parts_sql('ft')[0]} AS discipline, {_parts_sql('ft')[1]} AS element FROM t")
def failure_type_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failure_types(spark, sf_dir).select("p_partkey", classify.failure_type_parts(F.col("ft")).alias("p")).select("p_partkey", "p.discipline", "p.element")


_HITS = f"list_filter({_list(classify.PROCESS_PARTS)}, lambda w: contains(lower(cause), w))"


@query(f"WITH c AS (SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Operator packing torque' WHEN 1 THEN ' solder Joint' ELSE '' END) AS cause FROM part) SELECT p_partkey, array_to_string({_HITS}, ',') AS hits, CASE WHEN len({_HITS}) >= 1 THEN 'process' ELSE 'non-process' END AS level FROM c")
def process_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("p_partkey") % 4 == 0, " Operator packing torque").when(F.col("p_partkey") % 4 == 1, " solder Joint").otherwise("")
    cause = F.concat("p_name", extra)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(classify.process_hits(cause), ",").alias("hits"), classify.fmea_level(cause).alias("level"))


_ENTITY = tuple(classify.DENIED)


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sent(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, (*_ENTITY, "unknown"))), (F.col("sentence_id") % 6 + 1).cast("int"))
    return s.withColumns({"entity_type": kind, "faithful_type": F.when(F.col("faithful_score") > 90, F.lit("fuzzy")).when(F.col("sentence_id") % 3 == 0, F.lit("partial")).otherwise(F.lit("hallucinated"))})


def _rule_sql(table_: dict, column: str, text: str, deny: bool) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {'NOT ' if deny else ''}{_any(text, v)}" for k, v in table_.items())
    return f"CASE {column} {cases} {'' if deny else chr(87) + 'HEN ' + chr(39) + 'observed' + chr(39) + ' THEN true'} ELSE false END"


_RATED = f"""r AS (SELECT *, {_list((*_ENTITY, 'unknown'))}[1 + sentence_id % 6] AS entity_type, CASE WHEN faithful_score > 90 THEN 'fuzzy' WHEN sentence_id % 3 = 0 THEN 'partial' ELSE 'hallucinated' END AS faithful_type, {_spaces('text')} AS t FROM sent),
c AS (SELECT *, NOT {_any('t', classify.CONJUNCTIONS)} OR length(t) - length(replace(t, ',', '')) <= 1 AS atomic, {_rule_sql(classify.DENIED, 'entity_type', 't', True)} AS entity_ok, {_rule_sql(classify.ASSERTION_MARKS, 'assertion_level', 't', False)} AS assertion_ok FROM r)"""


@query(f"WITH {_RATED} SELECT sentence_id, atomic, entity_ok, assertion_ok FROM c", "sent")
def sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _rated(spark, sf_dir).select("sentence_id", classify.is_atomic(t).alias("atomic"), classify.entity_rule(F.col("entity_type"), t).alias("entity_ok"), classify.assertion_rule(F.col("assertion_level"), t).alias("assertion_ok"))


def _rate(c: str) -> str:
    return f"round(count(*) FILTER ({c}) / CAST(greatest(1, count(*)) AS DOUBLE), 6)"


@query(f"""WITH {_RATED} SELECT count(*) AS total, {_rate("faithful_type IN ('exact', 'fuzzy')")} AS strong_faithfulness_rate, {_rate("faithful_type = 'partial'")} AS weak_faithfulness_rate, {_rate("faithful_type = 'hallucinated'")} AS hallucination_rate,
{_rate('atomic')} AS atomicity_rate, {_rate('entity_ok')} AS entity_rule_pass_rate, {_rate('assertion_ok')} AS assertion_rule_pass_rate, {_rate("assertion_level = 'confirmed'")} AS confirmed_ratio, {_rate("faithful_type = 'exact'")} AS exact_ratio, {_rate("faithful_type = 'fuzzy'")} AS fuzzy_ratio, {_rate("faithful_type = 'partial'")} AS partial_ratio FROM c""", "sent")
def iteration_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texteval.iteration_rates(_rated(spark, sf_dir))


@query(f"WITH {_RATED}, n AS (SELECT source_section, entity_type, count(*) AS n FROM c GROUP BY ALL) SELECT source_section, bool_or(entity_type = 'symptom') AS has_symptom, bool_or(entity_type IN ('root_cause_evidence', 'investigation')) AS has_root_or_investigation, CAST(sum(n) AS BIGINT) AS sentence_count, string_agg(concat(entity_type, ':', CAST(n AS VARCHAR)), ',' ORDER BY concat(entity_type, ':', CAST(n AS VARCHAR))) AS type_counts FROM n GROUP BY source_section", "sent")
def type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texteval.type_coverage(_rated(spark, sf_dir), "source_section")


# --- Ingest -------------------------------------------------------------------------------------------------------

_INGEST = f"""n AS (SELECT *, CASE WHEN source_type = 'new_fmea' THEN concat_ws('|', 'n', {_key('system_name')}, {_key('system_element')}, {_key('function_name')}, {_key('failure_mode')}, {_key('failure_effect')}) ELSE concat_ws('|', 'o', {_key('failure_type')}, {_key('failure_mode')}, {_key('failure_effect')}) END AS sig, {_number('severity')} AS sev FROM fmea_rows),
g AS (SELECT file_ord, sig, min(row_ord) AS group_ord, max(sev) AS severity FROM n GROUP BY ALL),
g1 AS (SELECT g.*, n.file_name, n.source_type, n.failure_mode, n.failure_effect, n.function_name, CASE WHEN n.source_type = 'new_fmea' THEN n.system_name END AS sys, CASE WHEN n.source_type = 'new_fmea' THEN n.system_element ELSE {_parts_sql('n.failure_type')[1]} END AS element, CASE WHEN n.source_type <> 'new_fmea' THEN {_parts_sql('n.failure_type')[0]} END AS discipline FROM g JOIN n ON n.file_ord = g.file_ord AND n.row_ord = g.group_ord),
g2 AS (SELECT *, concat_ws('|', {_key('failure_mode')}, {_key('failure_effect')}, {_key('element')}, {_key('sys')}) AS k FROM g1),
g3 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY file_ord, group_ord) = 1 AS wins FROM g2),
g4 AS (SELECT *, CASE WHEN wins THEN concat(file_name, '__F', CAST(CAST(sum(CAST(wins AS INT)) OVER (PARTITION BY file_ord ORDER BY group_ord) AS BIGINT) AS VARCHAR)) END AS own FROM g3),
g5 AS (SELECT *, max(own) OVER (PARTITION BY k) AS failure_id FROM g4),
c AS (SELECT g5.failure_id, n.file_ord, g5.group_ord, n.row_ord, n.failure_cause, g5.failure_mode, g5.element, g5.failure_effect, g5.discipline, row_number() OVER (PARTITION BY g5.failure_id, {_key('n.failure_cause')} ORDER BY n.file_ord, g5.group_ord, n.row_ord) AS p FROM n JOIN g5 ON n.file_ord = g5.file_ord AND n.sig = g5.sig WHERE coalesce(n.failure_cause, '') <> ''),
causes AS (SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY file_ord, group_ord, row_ord) AS n, concat(failure_id, '_C', CAST(row_number() OVER (PARTITION BY failure_id ORDER BY file_ord, group_ord, row_ord) AS VARCHAR)) AS cause_id FROM c WHERE p = 1)"""


@query(f"WITH {_INGEST}, i AS (SELECT failure_id, string_agg(cause_id, ',' ORDER BY n) AS cause_ids FROM causes GROUP BY failure_id) SELECT g5.failure_id, failure_mode, element AS failure_element, failure_effect, sys AS system, function_name, severity, source_type, coalesce(cause_ids, '') AS cause_ids FROM g5 LEFT JOIN i ON i.failure_id = g5.failure_id WHERE wins", "fmea_rows")
def fmea_ingest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures, _ = ingest.ingest(fmea_rows(spark, sf_dir))
    return failures.select("failure_id", "failure_mode", "failure_element", "failure_effect", "system", "function_name", "severity", "source_type", F.array_join("cause_ids", ",").alias("cause_ids"))


@query(f"WITH {_INGEST} SELECT cause_id, failure_id, failure_mode, element AS failure_element, failure_effect, failure_cause, discipline FROM causes", "fmea_rows")
def fmea_ingest_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, causes = ingest.ingest(fmea_rows(spark, sf_dir))
    return causes.select("cause_id", "failure_id", "failure_mode", "failure_element", "failure_effect", "failure_cause", "discipline")


@query("""WITH r AS (SELECT file_name, row_ord, source_type, failure_mode, failure_cause, failure_effect, function_name FROM fmea_rows)
SELECT concat_ws('_', file_name, CAST(row_ord AS VARCHAR), 'failure') AS sentence_id, 'failure' AS role, CASE WHEN source_type = 'new_fmea' THEN concat(failure_mode, ' in ', coalesce(function_name, 'system'), '.') ELSE concat('Failure mode ', failure_mode, '.') END AS text FROM r WHERE failure_mode <> ''
UNION ALL SELECT concat_ws('_', file_name, CAST(row_ord AS VARCHAR), 'cause'), 'cause', concat(failure_cause, ' causes ', failure_mode, '.') FROM r WHERE failure_cause <> ''
UNION ALL SELECT concat_ws('_', file_name, CAST(row_ord AS VARCHAR), 'effect'), 'effect', concat(failure_mode, ' leads to ', failure_effect, '.') FROM r WHERE failure_effect <> ''""", "fmea_rows")
def record_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sentences_of(fmea_rows(spark, sf_dir)).select("sentence_id", "role", "text")


@query("SELECT file_name, row_ord, concat('Failure mode ', failure_mode, '. Cause ', failure_cause, ' leads to effect ', failure_effect, '. Severity ', severity, ', Occurrence , Detection , RPN . Action .') AS text FROM fmea_rows WHERE source_type = 'old_fmea'", "fmea_rows")
def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fmea_rows(spark, sf_dir).where("source_type = 'old_fmea'")
    return rows.select("file_name", "row_ord", ingest.record_text(rows).alias("text"))


@query(f"WITH {_INGEST}, f AS (SELECT failure_id, failure_mode, element AS failure_element, failure_effect FROM g5 WHERE wins), u AS (SELECT failure_id, 'failure_mode' AS role, failure_mode AS text FROM f UNION ALL SELECT failure_id, 'failure_element', failure_element FROM f UNION ALL SELECT failure_id, 'failure_effect', failure_effect FROM f) SELECT failure_id, role, text FROM u WHERE text IS NOT NULL AND lower(trim(text)) NOT IN ('', '-', 'n/a', 'na', 'null', 'none', 'tbd', 'to be defined')", "fmea_rows")
def role_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures, _ = ingest.ingest(fmea_rows(spark, sf_dir))
    return vectors.role_rows(failures)


@query("""WITH m AS (SELECT failure_effect, severity, failure_mode, list_sort(list(DISTINCT failure_cause)) AS causes FROM fmea_rows WHERE failure_effect IS NOT NULL AND severity IS NOT NULL AND failure_mode IS NOT NULL GROUP BY ALL)
SELECT failure_effect, severity, failure_mode, array_to_string(causes, '|') AS causes FROM m""", "fmea_rows")
def effect_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = ingest.effect_centred(fmea_rows(spark, sf_dir))
    return nested.select("failure_effect", "severity", F.inline("failure_modes")).select("failure_effect", "severity", "failure_mode", F.array_join("causes", "|").alias("causes"))


@query("""WITH m AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT e.event_id, (SELECT arg_max(m.event_id, (m.ts, m.event_id)) FROM m WHERE m.user_id = e.user_id AND (m.ts < e.ts OR (m.ts = e.ts AND m.event_id < e.event_id))) AS marker_id FROM events e""")
def context_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of the first kind that a user had strictly before each event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kind = e.agg(F.min("event_type")).first()[0]
    return e.select("event_id", ingest.last_before(e, F.col("event_type") == kind, F.col("event_id"), ["user_id"], ["ts", "event_id"]).alias("marker_id"))


@query("WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN value END AS value FROM events) SELECT event_id, last_value(kind IGNORE NULLS) OVER w AS kind, last_value(value IGNORE NULLS) OVER w AS value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value"))
    return ingest.forward_fill(e, ["kind", "value"], ["user_id"], "event_id").select("event_id", "kind", "value")


@query("WITH r AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS number, concat(event_type, CASE WHEN event_id % 7 = 0 THEN ' pfmea' ELSE '' END) AS name, CASE event_id % 3 WHEN 0 THEN '8d report' WHEN 1 THEN 'Design FMEA' ELSE 'memo' END AS category, CASE WHEN event_id % 5 = 0 THEN 'C:\\x' ELSE 'n:\\y' END AS path FROM events ORDER BY event_id DESC LIMIT 100) SELECT n, number, name, CASE WHEN contains(upper(category), '8D') THEN '8D' ELSE 'FMEA' END AS kind FROM r WHERE NOT contains(upper(name), 'PFMEA') AND NOT contains(upper(name), 'PROCESS') AND starts_with(upper(path), 'N:') AND category <> 'memo'")
def inventory_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i.alias("n"), F.col("user_id").cast("string").alias("number"), F.concat("event_type", F.when(i % 7 == 0, " pfmea").otherwise("")).alias("name"), F.when(i % 3 == 0, "8d report").when(i % 3 == 1, "Design FMEA").otherwise("memo").alias("category"), F.when(i % 5 == 0, "C:\\x").otherwise("n:\\y").alias("path"))
    return route(rows).select("n", "number", "name", "kind")


# --- Integrity ----------------------------------------------------------------------------------------------------


def _failure_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as failures with planted gaps."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(k.cast("string").alias("failure_id"), F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("failure_element"), F.when(k % 11 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("failure_mode"), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("late")).alias("failure_effect"), F.when(k % 13 == 0, F.lit(None)).otherwise(F.array(F.concat(k.cast("string"), F.lit("_1")), F.concat(k.cast("string"), F.lit("_9")))).alias("cause_ids"), F.when(k % 17 == 0, k + 1).otherwise(k).cast("string").alias("inner_id"))


def _cause_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as causes; some point nowhere."""
    l = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    return l.select(F.concat_ws("_", key.cast("string"), F.col("l_linenumber").cast("string")).alias("cause_id"), F.when(F.col("l_partkey") % 19 == 0, F.lit(None)).when(F.col("l_partkey") % 23 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("failure_id"), F.when(F.col("l_suppkey") % 9 == 0, F.lit("")).otherwise(F.col("l_returnflag")).alias("failure_cause"))


_STORES = """f AS (SELECT CAST(o_orderkey AS VARCHAR) AS failure_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS failure_element, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS failure_mode, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'late' END AS failure_effect, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE [concat(o_orderkey, '_1'), concat(o_orderkey, '_9')] END AS cause_ids, CAST(CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS VARCHAR) AS inner_id FROM orders),
c AS (SELECT concat_ws('_', l_orderkey, l_linenumber) AS cause_id, CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN concat('x', l_orderkey) ELSE CAST(l_orderkey AS VARCHAR) END AS failure_id, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE l_returnflag END AS failure_cause FROM lineitem)"""


@query(f"""WITH {_STORES} SELECT failure_id AS id, 'missing failure_element' AS message FROM f WHERE failure_element IS NULL OR trim(failure_element) = '' UNION ALL SELECT failure_id, 'missing failure_mode' FROM f WHERE trim(failure_mode) = '' UNION ALL SELECT failure_id, 'missing failure_effect' FROM f WHERE trim(failure_effect) = ''
UNION ALL SELECT cause_id, 'missing failure_id (in cause)' FROM c WHERE failure_id IS NULL UNION ALL SELECT cause_id, 'missing root_cause' FROM c WHERE failure_cause = ''""")
def k1_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failure_schema(_failure_store(spark, sf_dir)).unionByName(quality.cause_schema(_cause_store(spark, sf_dir)))


@query(f"""WITH {_STORES} SELECT failure_id AS id, 'failure_effect is "" (prefer null)' AS message FROM f WHERE trim(failure_effect) = '' UNION ALL SELECT failure_id, 'cause_ids is null (prefer [])' FROM f WHERE cause_ids IS NULL UNION ALL SELECT cause_id, 'failure_cause is "" (must be non-empty)' FROM c WHERE failure_cause = ''""")
def k2_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failure_nulls(_failure_store(spark, sf_dir)).unionByName(quality.cause_nulls(_cause_store(spark, sf_dir), "failure_cause"))


@query(f"WITH {_STORES} SELECT failure_id AS id, inner_id FROM f WHERE inner_id <> failure_id")
def k3_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.id_mismatch(_failure_store(spark, sf_dir), "failure_id", "inner_id")


@query(f"WITH {_STORES}, x AS (SELECT failure_id, unnest(cause_ids) AS cause_id FROM f) SELECT 'cause' AS missing, failure_id, cause_id FROM x WHERE cause_id NOT IN (SELECT cause_id FROM c) UNION ALL SELECT 'failure', c.failure_id, c.cause_id FROM c LEFT JOIN f ON f.failure_id = c.failure_id WHERE f.failure_id IS NULL")
def k4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = _failure_store(spark, sf_dir), _cause_store(spark, sf_dir)
    a = quality.orphan_causes(f, c).select(F.lit("cause").alias("missing"), "failure_id", "cause_id")
    return a.unionByName(quality.orphan_failures(f, c).select(F.lit("failure").alias("missing"), "failure_id", "cause_id"))


@query(f"""WITH {_STORES}, m AS (SELECT 'ids' AS "check", concat_ws(': ', failure_id, inner_id) AS message FROM f WHERE inner_id <> failure_id UNION ALL SELECT 'orphan failures', concat_ws(': ', c.cause_id, coalesce(c.failure_id, 'null')) FROM c LEFT JOIN f ON f.failure_id = c.failure_id WHERE f.failure_id IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY message) AS p FROM m) SELECT "check", count(*) AS n, string_agg(message, ';' ORDER BY message) FILTER (p <= 5) AS samples FROM r GROUP BY "check" """)
def integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = _failure_store(spark, sf_dir), _cause_store(spark, sf_dir)
    return quality.summary({"ids": quality.id_mismatch(f, "failure_id", "inner_id"), "orphan failures": quality.orphan_failures(f, c)}).withColumn("samples", F.array_join("samples", ";"))


# --- Graph --------------------------------------------------------------------------------------------------------


def _kept_base(spark: SparkSession, sf_dir: str) -> knowledge.KnowledgeBase:
    """A base that got the records of these files in two batches, as they arrive."""
    rows = fmea_rows(spark, sf_dir)
    base = knowledge.KnowledgeBase(spark, shared_folder(spark))
    for batch in ("file_ord < 3", "file_ord >= 3"):
        base.add(rows.where(batch))
    return base


_GRAPHS: dict[tuple[str, str], str] = {}


def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The stored graph of these records: ingested and saved once a session and folder, then read by label and relation."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _GRAPHS:
        path = shared_folder(spark)
        ingest.ingest(fmea_rows(spark, sf_dir))[1].write.parquet(f"{path}/causes")
        graph.Graph.from_causes(spark.read.parquet(f"{path}/causes")).save(path)
        _GRAPHS[key] = path
    return graph.Graph.load(spark, _GRAPHS[key])


_GRAPH = _INGEST + """,
b AS (SELECT concat('Failure::failure_id::', failure_id) AS f, concat('FailureElement::name::', coalesce(element, 'None')) AS e, concat('FailureMode::text::', coalesce(failure_mode, 'None')) AS m, concat('FailureEffect::text::', coalesce(failure_effect, 'None')) AS x, concat('FailureCause::cause_id::', cause_id) AS cc, * FROM causes),
nodes AS (SELECT DISTINCT f AS id, 'Failure' AS label, failure_id AS name FROM b UNION SELECT e, 'FailureElement', coalesce(nullif(element, ''), e) FROM b UNION SELECT m, 'FailureMode', coalesce(nullif(failure_mode, ''), m) FROM b UNION SELECT x, 'FailureEffect', coalesce(nullif(failure_effect, ''), x) FROM b UNION SELECT cc, 'FailureCause', failure_cause FROM b),
edges AS (SELECT f AS src, 'HAS_ELEMENT' AS rel, e AS dst FROM b UNION SELECT f, 'HAS_MODE', m FROM b UNION SELECT e, 'HAS_MODE', m FROM b UNION SELECT f, 'HAS_EFFECT', x FROM b UNION SELECT m, 'LEADS_TO', x FROM b UNION SELECT cc, 'CAUSES', m FROM b)"""


@query(f"WITH {_GRAPH} SELECT id, label, name FROM nodes", "fmea_rows")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes.select("id", "label", graph.node_text(F.col("props"), F.col("id")).alias("name"))


@query(f"WITH {_GRAPH} SELECT src, rel, dst FROM edges", "fmea_rows")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges


@query(f"WITH {_INGEST}, i AS (SELECT failure_id, string_agg(cause_id, ',' ORDER BY n) AS cause_ids FROM causes GROUP BY failure_id) SELECT g5.failure_id, failure_mode, element AS failure_element, failure_effect, severity, coalesce(cause_ids, '') AS cause_ids FROM g5 LEFT JOIN i ON i.failure_id = g5.failure_id WHERE wins", "fmea_rows")
def incremental_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches merged into a kept base give the failures of one ingest."""
    return _kept_base(spark, sf_dir).failures().select("failure_id", "failure_mode", "failure_element", "failure_effect", "severity", F.array_join("cause_ids", ",").alias("cause_ids"))


@query(f"WITH {_GRAPH} SELECT 'node' AS kind, id AS a, label AS b, name AS c FROM nodes UNION ALL SELECT 'edge', src, rel, dst FROM edges", "fmea_rows")
def incremental_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches merged into a kept base give the nodes and edges of one build."""
    g = _kept_base(spark, sf_dir).graph()
    nodes = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), graph.node_text(F.col("props"), F.col("id")).alias("c"))
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("rel").alias("b"), F.col("dst").alias("c")))


@query(f"""WITH {_GRAPH}, s AS (SELECT 'Failure::failure_id::FMEA_3__F2' AS id), md AS (SELECT dst AS id FROM edges JOIN s ON src = s.id WHERE rel = 'HAS_MODE'),
h AS (SELECT 'failure_element' AS kind, dst AS id FROM edges JOIN s ON src = s.id WHERE rel = 'HAS_ELEMENT' UNION SELECT 'failure_mode', id FROM md UNION SELECT 'failure_effect', dst FROM edges JOIN s ON src = s.id WHERE rel = 'HAS_EFFECT' UNION SELECT 'failure_cause', src FROM edges JOIN md ON dst = md.id WHERE rel = 'CAUSES')
SELECT kind, name AS value FROM h JOIN nodes ON h.id = nodes.id""", "fmea_rows")
def graph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).chain("FMEA_3__F2")


@query(f"WITH {_GRAPH} SELECT DISTINCT 'failure_mode' AS kind, name AS value FROM edges JOIN nodes ON dst = id WHERE src = 'FailureElement::name::pump / impeller' AND rel = 'HAS_MODE'", "fmea_rows")
def modes_under_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return graph.modes_under_element(g.nodes, g.edges, "pump / impeller")


@query(f"WITH {_GRAPH}, t AS (SELECT min(failure_mode) AS mode FROM causes) SELECT 'failure_cause' AS kind, name AS value FROM t, edges JOIN nodes ON src = id WHERE dst = concat('FailureMode::text::', mode) AND rel = 'CAUSES'", "fmea_rows")
def causes_for_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    mode = spark.read.parquet(f"{_GRAPHS[spark.sparkContext.applicationId, sf_dir]}/causes").agg(F.min("failure_mode")).first()[0]
    return graph.causes_for_mode(g.nodes, g.edges, mode)


@query(f"WITH {_GRAPH}, l AS (SELECT cause_id, failure_mode AS mode FROM causes WHERE n = 1 UNION ALL SELECT cause_id, 'no such mode' FROM causes WHERE n = 2) SELECT cause_id, mode, EXISTS (SELECT 1 FROM edges WHERE rel = 'CAUSES' AND src = concat('FailureCause::cause_id::', cause_id) AND dst = concat('FailureMode::text::', mode)) AS valid FROM l", "fmea_rows")
def validate_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    causes = spark.read.parquet(f"{_GRAPHS[spark.sparkContext.applicationId, sf_dir]}/causes")
    first, second = (causes.where(F.col("cause_id").endswith(f"_C{n}")) for n in (1, 2))
    links = first.select("cause_id", F.col("failure_mode").alias("mode")).unionByName(second.select("cause_id", F.lit("no such mode").alias("mode")))
    return graph.valid_links(g.nodes, g.edges, links)


@query(f"WITH {_GRAPH} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel", "fmea_rows")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return graph.counts(g.nodes, g.edges)


# --- 8D -----------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, concat(conv_id, '_', 'D', CAST(2 + length(role) % 3 AS VARCHAR), '_S', lpad(CAST(row_number() OVER (PARTITION BY conv_id, length(role) % 3 ORDER BY turn) AS VARCHAR), 3, '0')) AS sentence_id FROM conversations")
def sentence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("source_section", F.concat(F.lit("D"), (2 + F.length("role") % 3).cast("string")))
    return eightd.sentence_ids(c, "conv_id", "source_section", "turn").select("conv_id", "turn", "sentence_id")


@query("SELECT sentence_id, source_section FROM sent WHERE sentence_id NOT IN (SELECT doc_id FROM labels)", "sent")
def unused_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sentence_id"))
    return eightd.unused(sent(spark, sf_dir), used).select("sentence_id", "source_section")


@query("SELECT sentence_id % 100 AS failure_id, CASE WHEN bool_or(source_section = 'D2' AND assertion_level IN ('observed', 'confirmed') AND faithful_score >= 95) THEN 'supported' ELSE 'hypothesis' END AS status FROM sent GROUP BY sentence_id % 100", "sent")
def supported_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sent(spark, sf_dir).withColumn("failure_id", F.col("sentence_id") % 100)
    return eightd.support_status(s, s)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE lang END AS review_status, CASE WHEN doc_id % 4 = 0 THEN 'V0' ELSE source END AS version, '' AS last_updated FROM documents")
def maintenance_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    null = F.lit(None).cast("string")
    tag = F.struct(F.when(i % 3 != 0, F.col("lang")).alias("review_status"), F.when(i % 4 != 0, F.col("source")).alias("Version"), null.alias("last_updated"), null.alias("supersedes"))
    return table(spark, sf_dir, "documents").select("doc_id", eightd.maintenance(tag).alias("m")).select("doc_id", "m.review_status", "m.version", "m.last_updated")


_LINE = "concat_ws(' ', concat('- [id:', conv_id, '_', turn, ']'), CASE WHEN turn % 3 = 2 AND turn % 2 = 0 THEN concat('[subject:', role, ']') END, text, concat('(status=', CASE WHEN turn % 4 = 0 THEN '?' ELSE role END, ', faithful_score=', turn, ', type=?)'))"


@query("SELECT conv_id, " + ", ".join(f"coalesce(string_agg({_LINE}, chr(10) ORDER BY turn) FILTER (turn % 3 = {i}), '- (none)') AS D{i + 2}" for i in range(3)) + " FROM conversations GROUP BY conv_id")
def signal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", turn.alias("ord"), F.concat_ws("_", F.col("conv_id").cast("string"), turn.cast("string")).alias("sentence_id"), "text", F.concat(F.lit("D"), (2 + turn % 3).cast("string")).alias("source_section"),
        F.when(turn % 4 != 0, F.col("role")).alias("status"), turn.alias("faithful_score"), F.lit(None).cast("string").alias("faithful_type"), F.when(turn % 2 == 0, F.col("role")).alias("subject"))
    return eightd.signals(c, "conv_id")


@query("WITH p AS (SELECT conv_id AS file, turn, role = 'user' AS head, text FROM conversations), s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY file ORDER BY turn) AS section FROM p) SELECT file, CAST(section AS BIGINT) AS section, max(CASE WHEN head THEN trim(text) END) AS title, coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (NOT head AND trim(text) <> ''), '') AS content FROM s WHERE section > 0 GROUP BY file, section")
def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "Heading 2").otherwise("Normal").alias("style"), "text")
    return eightd.sections(c).select("file", "section", "title", "content")


#: What the props of clicks are held against: device is required, versions are numbers, items are not declared.
PROPS = t.StructType([
    t.StructField("k", t.LongType(), False),
    t.StructField("device", t.StructType([t.StructField("os", t.StringType(), False), t.StructField("ver", t.DoubleType())]), False),
    t.StructField("tags", t.ArrayType(t.StringType(), False)),
])
_KIND = "CASE json_type(v) WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DECIMAL' ELSE json_type(v) END"


def _fault_sql(path: str, values: str, expected: str, takes: str, required: bool) -> str:
    """Faults of the values (click_id, path, v) of one declared place; v is null where there is none."""
    absent = f"SELECT click_id, {path} AS path, 'missing' AS fault, '{expected}' AS expected, NULL AS found FROM {values} WHERE v IS NULL UNION ALL " if required else ""
    null = f"SELECT click_id, {path}, 'null', '{expected}', 'NULL' FROM {values} WHERE json_type(v) = 'NULL' UNION ALL " if required else ""
    return absent + null + f"SELECT click_id, {path}, 'type', '{expected}', {_KIND} FROM {values} WHERE json_type(v) NOT IN ('NULL', {takes})"


@query(f"""WITH j AS (SELECT click_id, CASE WHEN json_valid(props) THEN CAST(props AS JSON) END AS v FROM clicks),
d AS (SELECT click_id, json_extract(v, '$.device') AS v FROM j WHERE json_type(v) = 'OBJECT'),
k AS (SELECT click_id, json_extract(v, '$.k') AS v FROM j WHERE json_type(v) = 'OBJECT'),
o AS (SELECT click_id, json_extract(v, '$.os') AS v FROM d WHERE json_type(v) = 'OBJECT'),
r AS (SELECT click_id, json_extract(v, '$.ver') AS v FROM d WHERE json_type(v) = 'OBJECT'),
g AS (SELECT click_id, json_extract(v, '$.tags') AS v FROM j WHERE json_type(v) = 'OBJECT'),
i AS (SELECT click_id, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS n, v AS a FROM g WHERE json_type(v) = 'ARRAY'),
x AS (SELECT click_id, n, json_extract(a, '$[' || n || ']') AS v FROM i),
u AS (SELECT click_id, '$.' || name AS path, json_extract(v, '$.' || name) AS v FROM (SELECT click_id, v, unnest(json_keys(v)) AS name FROM j WHERE json_type(v) = 'OBJECT') WHERE name NOT IN ('k', 'device', 'tags')
  UNION ALL SELECT click_id, '$.device.' || name, json_extract(v, '$.' || name) FROM (SELECT click_id, v, unnest(json_keys(v)) AS name FROM d WHERE json_type(v) = 'OBJECT') WHERE name NOT IN ('os', 'ver'))
SELECT click_id, '$' AS path, CASE WHEN props IS NULL THEN 'missing' ELSE 'broken' END AS fault, 'OBJECT' AS expected, NULL AS found FROM clicks WHERE props IS NULL OR NOT json_valid(props)
UNION ALL SELECT click_id, '$', 'type', 'OBJECT', {_KIND} FROM j WHERE json_type(v) <> 'OBJECT'
UNION ALL {_fault_sql("'$.k'", "k", "BIGINT", "'BIGINT', 'UBIGINT'", True)} UNION ALL {_fault_sql("'$.device'", "d", "OBJECT", "'OBJECT'", True)}
UNION ALL {_fault_sql("'$.device.os'", "o", "STRING", "'VARCHAR'", True)} UNION ALL {_fault_sql("'$.device.ver'", "r", "DOUBLE", "'BIGINT', 'UBIGINT', 'DOUBLE'", False)}
UNION ALL {_fault_sql("'$.tags'", "g", "ARRAY", "'ARRAY'", False)} UNION ALL {_fault_sql("concat('$.tags[', n, ']')", "x", "STRING", "'VARCHAR'", True)}
UNION ALL SELECT click_id, path, 'unknown', NULL, {_KIND} FROM u""")
def props_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.faults(table(spark, sf_dir, "clicks"), "click_id", "props", PROPS)


@query("SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS number FROM lineitem")
def spread_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups that hold all rows, each numbered over all tasks."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return ordered.numbered(rows, ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query("SELECT click_id, client_id, ts, last_value(kind IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, arrived_at NULLS FIRST, kind NULLS FIRST ROWS UNBOUNDED PRECEDING) AS kind FROM clicks")
def spread_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known kind of each client's clicks; clients with very many clicks lie in several tasks."""
    rows = table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts", "arrived_at", "kind")
    return ordered.filled(rows, "kind", ["ts", "click_id", "arrived_at", "kind"], ["client_id"]).drop("arrived_at")


@query("SELECT doc_id FROM documents ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 40")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample_by_hash(table(spark, sf_dir, "documents").select("doc_id"), 40, "doc_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"))


from . import case_queries, source_queries  # noqa: E402, F401  register their queries
