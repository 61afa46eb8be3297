"""Joins, set operations, sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import duplicates, matching
from .registry import ASSETS, ITEMS, assets, items, query, rounded, table


@query("j1_asset_group", "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal > 0 AND n.n_regionkey <> 2")
def asset_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("j2_item_result", "SELECT o.o_orderkey, l.l_partkey, l.l_extendedprice FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'P'")
def item_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", "l_extendedprice")


@query("j3_has_result", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND x.quality = 1) OR d.doc_id % 2 = 0")
def has_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").where((F.col("quality") == 1) | (F.col("doc_id") % 2 == 0)).select("doc_id", "lang", "quality")


@query("j4_latest_tag", f"WITH {ITEMS} SELECT job_id, image_id, score FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, image_id DESC) AS rn FROM items WHERE status = 'selected') t WHERE rn = 1")
def latest_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = items(spark, sf_dir).where("status = 'selected'")
    return chosen.groupBy("job_id").agg(F.max_by(F.struct("image_id", "score"), F.struct("created_at", "image_id")).alias("t")).select("job_id", "t.image_id", "t.score")


@query(
    "j5_same_content",
    """WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents) SELECT a.doc_id, (SELECT max(b.doc_id) FROM h b WHERE b.sha = a.sha AND b.doc_id <> a.doc_id) AS source_id FROM h a""",
)
def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("doc_id").alias("at"))
    return duplicates.exact_source(docs, "sha", "doc_id", "at")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets(spark, sf_dir).select("asset_id", "group_id", vector.bits(vector.average_hash(F.col("vector"))).alias("h"))


HASHES = f"""{ASSETS}, bits AS (SELECT asset_id, group_id, list_transform(vector, lambda x: x >= list_sum(vector) / len(vector)) AS b FROM assets),
    near AS (SELECT a.group_id, a.asset_id AS a, b.asset_id AS b, list_sum(list_transform(list_zip(a.b, b.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS distance
    FROM bits a JOIN bits b ON a.group_id = b.group_id AND a.asset_id < b.asset_id)"""


@query("j6_near_pairs", f"WITH {HASHES} SELECT * FROM near WHERE distance <= 20")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_pairs(_hashes(spark, sf_dir), 20, "asset_id", "h", "group_id")


@query(
    "j6_nearest_duplicate",
    f"WITH {HASHES}, two AS (SELECT a AS asset_id, b AS other, distance FROM near UNION ALL SELECT b, a, distance FROM near) SELECT asset_id, other, distance FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY distance, other) AS rn FROM two WHERE distance <= 20) t WHERE rn = 1",
)
def nearest_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_pairs(spark, sf_dir)
    both = pairs.select(F.col("a").alias("asset_id"), F.col("b").alias("other"), "distance").unionByName(pairs.select(F.col("b").alias("asset_id"), F.col("a").alias("other"), "distance"))
    return both.groupBy("asset_id").agg(F.min(F.struct("distance", "other")).alias("m")).select("asset_id", "m.other", "m.distance")


@query(
    "j6b_exact_then_near",
    """WITH h AS (SELECT doc_id, sha256(text) AS sha, n_chars FROM documents), e AS (SELECT a.doc_id, (SELECT max(b.doc_id) FROM h b WHERE b.sha = a.sha AND b.doc_id <> a.doc_id) AS exact FROM h a),
    n AS (SELECT n_chars, min(doc_id) AS near FROM h GROUP BY n_chars) SELECT h.doc_id, coalesce(e.exact, CASE WHEN n.near <> h.doc_id THEN n.near END) AS source_id FROM h JOIN e USING (doc_id) JOIN n USING (n_chars)""",
)
def exact_then_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    near = docs.groupBy("n_chars").agg(F.min("doc_id").alias("near"))
    return docs.join(same_content(spark, sf_dir), "doc_id").join(near, "n_chars").select("doc_id", F.coalesce("source_id", F.when(F.col("near") != F.col("doc_id"), F.col("near"))).alias("source_id"))


@query("j7_exists_children", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def exists_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(failed, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j8_no_children", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
def no_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j9_unprotected_keys", "SELECT DISTINCT source || '/' || lang AS key FROM documents WHERE source || '/' || lang NOT IN (SELECT source || '/' || lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)")
def unprotected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("key"))
    kept = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("key")
    return docs.select("key").distinct().join(kept, "key", "left_anti")


@query("j10_match_chain", "SELECT d.doc_id, l.quality, b.item_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = l.doc_id AND l.quality = 1")
def match_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    marks = table(spark, sf_dir, "benchmark").select("item_id")
    chain = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return chain.join(marks, (F.col("item_id") == F.col("doc_id")) & (F.col("quality") == 1), "left").select("doc_id", "quality", "item_id")


TREE = "nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"


@query("j11_tree_paths", f"WITH RECURSIVE {TREE}, paths AS (SELECT id, name AS path, 1 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, p.path || '/' || n.name, p.depth + 1 FROM nodes n JOIN paths p ON n.parent = p.id) SELECT id, path, depth FROM paths")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda t, key, up, name: table(spark, sf_dir, t).select(F.concat(F.lit(key[0]), key[1]).alias("id"), (F.concat(F.lit(up[0]), up[1]) if up else F.lit(None).cast("string")).alias("parent"), F.col(name).alias("name"))
    nodes = part("region", ("r", "r_regionkey"), None, "r_name").unionByName(part("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), "n_name")).unionByName(part("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "s_name"))
    nodes.createOrReplaceTempView("tree_nodes")
    return spark.sql(
        "WITH RECURSIVE paths(id, path, depth) AS (SELECT id, name, 1 FROM tree_nodes WHERE parent IS NULL UNION ALL SELECT n.id, concat(p.path, '/', n.name), p.depth + 1 FROM tree_nodes n JOIN paths p ON n.parent = p.id) SELECT id, path, depth FROM paths"
    )


@query("j12_leaves_with_assets", "SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)")
def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("n_nationkey")


@query("j13_ranked_update", f"WITH {ASSETS}, r AS (SELECT asset_id, row_number() OVER (PARTITION BY group_id ORDER BY asset_id) AS rn FROM assets) SELECT a.asset_id, r.rn <= 6 AS is_prototype, CASE WHEN r.rn <= 6 THEN r.rn END AS prototype_rank FROM assets a LEFT JOIN r ON r.asset_id = a.asset_id")
def ranked_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("group_id").orderBy("asset_id"))
    ranked = assets(spark, sf_dir).select("asset_id", rn.alias("rn"))
    return ranked.select("asset_id", (F.col("rn") <= 6).alias("is_prototype"), F.when(F.col("rn") <= 6, F.col("rn")).alias("prototype_rank"))


def query_vectors(spark: SparkSession, sf_dir: str, every: int = 10) -> tuple[DataFrame, DataFrame]:
    """Queries (ids divisible by `every`) and the library of all other assets, of length 1."""
    unit = matching.unit_vectors(assets(spark, sf_dir))
    asked = unit.where(F.col("asset_id") % every == 0).select(F.col("asset_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("group_id").alias("expected"))
    return asked, unit.where(F.col("asset_id") % every != 0)


SCORES = f"""{ASSETS}, unit AS (SELECT asset_id, group_id, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS v FROM assets WHERE list_dot_product(vector, vector) > 0),
    scores AS (SELECT q.asset_id AS query_id, q.group_id AS expected, a.asset_id, a.group_id, greatest(0.0, least(1.0, list_dot_product(q.v, a.v))) AS similarity FROM unit q CROSS JOIN unit a WHERE q.asset_id % 10 = 0 AND a.asset_id % 10 <> 0)"""


@query("j14_dense_scores", f"WITH {SCORES} SELECT query_id, count(*) AS n, round(max(similarity), 4) AS best, round(sum(similarity), 2) AS total FROM scores GROUP BY query_id")
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = matching.scored(*query_vectors(spark, sf_dir))
    return scores.groupBy("query_id").agg(F.count("*").alias("n"), rounded(F.max("similarity")).alias("best"), rounded(F.sum("similarity"), 2).alias("total"))


@query(
    "j15_exact_first",
    """WITH h AS (SELECT doc_id, sha256(text) AS sha, lang FROM documents), q AS (SELECT * FROM h WHERE doc_id % 10 = 0), lib AS (SELECT * FROM h WHERE doc_id % 10 <> 0),
    e AS (SELECT q.doc_id, min(lib.doc_id) AS asset FROM q JOIN lib ON q.sha = lib.sha GROUP BY q.doc_id), f AS (SELECT lang, min(doc_id) AS asset FROM lib GROUP BY lang)
    SELECT doc_id, asset, 'exact' AS how FROM e UNION ALL SELECT q.doc_id, f.asset, 'retrieved' FROM q JOIN f ON f.lang = q.lang WHERE q.doc_id NOT IN (SELECT doc_id FROM e)""",
)
def exact_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    asked, library = hashes.where("doc_id % 10 = 0"), hashes.where("doc_id % 10 <> 0")
    # The first of each hash stands for all: a hash that many share stays one row.
    exact = asked.join(library.groupBy("sha").agg(F.min("doc_id").alias("asset")), "sha").select("doc_id", "asset", F.lit("exact").alias("how"))
    rest = asked.join(exact, "doc_id", "left_anti").join(library.groupBy("lang").agg(F.min("doc_id").alias("asset")), "lang")
    return exact.unionByName(rest.select("doc_id", "asset", F.lit("retrieved").alias("how")))


@query("j16_counts", "SELECT n.n_nationkey, coalesce(c.n, 0) AS assets FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) c ON c.s_nationkey = n.n_nationkey")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").join(n, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("assets"))


@query("j17_catalog_sync", "SELECT doc_id FROM documents a WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 1 AND b.source = a.source AND b.n_chars = a.n_chars)")
def catalog_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.where("doc_id % 2 = 0").join(docs.where("doc_id % 2 = 1"), ["source", "n_chars"], "left_anti").select("doc_id")


@query(
    "j18_change_data",
    """WITH a AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey END AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 11 <> 0)
    SELECT a.id, CASE WHEN coalesce(i.id, n.id) IS NULL THEN 'created' WHEN (CASE WHEN i.id IS NOT NULL THEN i.v ELSE n.v END) IS DISTINCT FROM a.v THEN 'updated' ELSE 'unchanged' END AS change FROM a LEFT JOIN b i ON i.id = a.id LEFT JOIN b n ON n.name = a.name""",
)
def change_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    a = rows.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    b = rows.where("c_custkey % 11 <> 0").select(F.expr("IF(c_custkey % 7 = 0, -c_custkey, c_custkey)").alias("id2"), F.col("c_name").alias("name2"), F.expr("IF(c_custkey % 3 = 0, NULL, c_acctbal)").alias("v2"))
    by_id = a.join(b.select(F.col("id2").alias("id"), F.col("v2").alias("vi"), F.lit(True).alias("is_id")), "id", "left")
    both = by_id.join(b.select(F.col("name2").alias("name"), F.col("v2").alias("vn"), F.lit(True).alias("is_name")), "name", "left")
    old = F.when(F.col("is_id"), F.col("vi")).otherwise(F.col("vn"))
    change = F.when(F.col("is_id").isNull() & F.col("is_name").isNull(), "created").when(~old.eqNullSafe(F.col("v")), "updated").otherwise("unchanged")
    return both.select("id", change.alias("change"))


@query("j19_leakage", "SELECT sha256(text) AS sha FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 5 <> 0")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return docs.where("doc_id % 5 = 0").select("sha").intersect(docs.where("doc_id % 5 <> 0").select("sha"))


@query("j20_orphans", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "labels"), F.col("item_id") == F.col("doc_id"), "left_anti").select("item_id")


MESSAGES = "messages AS (SELECT event_id AS seq, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'other' ELSE 'target' END AS task, user_id AS entity FROM events), pending AS (SELECT DISTINCT user_id AS entity FROM events WHERE event_type = 'view' AND user_id % 4 <> 0)"
KEPT = """kept AS (SELECT m.seq, CASE WHEN task IS NULL THEN 'kept_unparseable' WHEN task <> 'target' THEN 'kept_other' WHEN p.entity IS NULL THEN 'dropped_inactive'
    WHEN row_number() OVER (PARTITION BY task, m.entity ORDER BY seq) > 1 THEN 'dropped_duplicate' ELSE 'kept_target' END AS outcome FROM messages m LEFT JOIN pending p ON p.entity = m.entity)"""


def queue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    task = F.when(F.col("event_id") % 13 == 0, None).when(F.col("event_id") % 3 == 0, "other").otherwise("target")
    messages = events.select(F.col("event_id").alias("seq"), task.alias("task"), F.col("user_id").alias("entity"))
    pending = events.where("event_type = 'view' AND user_id % 4 <> 0").select(F.col("user_id").alias("entity")).distinct().withColumn("active", F.lit(True))
    # The first message of an entity is a minimum, not a window over all of its messages.
    firsts = messages.where("task = 'target'").groupBy("entity").agg(F.min("seq").alias("first"))
    met = messages.join(pending, "entity", "left").join(firsts, "entity", "left")
    outcome = F.when(F.col("task").isNull(), "kept_unparseable").when(F.col("task") != "target", "kept_other").when(F.col("active").isNull(), "dropped_inactive").when(F.col("seq") != F.col("first"), "dropped_duplicate").otherwise("kept_target")
    return met.select("seq", outcome.alias("outcome"))


@query("j23_queue_dedupe", f"WITH {MESSAGES}, {KEPT} SELECT seq, outcome FROM kept WHERE outcome LIKE 'kept%'")
def queue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_outcomes(spark, sf_dir).where(F.col("outcome").startswith("kept"))


@query("d20_queue_statistics", f"WITH {MESSAGES}, {KEPT} SELECT outcome, count(*) AS n FROM kept GROUP BY outcome")
def queue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query("l1_page", f"WITH {ITEMS} SELECT image_id, score FROM items ORDER BY score DESC, image_id LIMIT 20 OFFSET 40")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("image_id", "score").orderBy(F.desc("score"), "image_id").offset(40).limit(20)


@query("l2_history_page", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    top = orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)
    return top.crossJoin(F.broadcast(orders.agg(F.count("*").alias("total"))))


@query("l3_nearest", f"WITH {SCORES} SELECT query_id, rank, asset_id, round(similarity, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, asset_id) AS rank FROM scores) t WHERE rank <= 20")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest(matching.best_scored(*query_vectors(spark, sf_dir), top=20, by_group=False, larger=False), 20).select("query_id", "rank", "asset_id", rounded(F.col("similarity")).alias("similarity"))


@query("l4_group_order", f"WITH {SCORES} SELECT query_id, group_id, asset_id, row_number() OVER (PARTITION BY query_id ORDER BY group_id, similarity DESC, asset_id) AS place FROM scores")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.placed_by_group(*query_vectors(spark, sf_dir)).select("query_id", "group_id", "asset_id", "place")


@query("l5_priority", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 100")
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey").limit(100)


@query("l7_chunks", f"WITH {ITEMS} SELECT image_id, job_id, (row_number() OVER (PARTITION BY job_id ORDER BY image_id) - 1) // 25 AS chunk FROM items")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("job_id").orderBy("image_id"))
    return items(spark, sf_dir).select("image_id", "job_id", F.floor((rn - 1) / 25).alias("chunk"))


@query("l8_oldest", f"WITH {ITEMS} SELECT image_id FROM items WHERE status IN ('analyzing', 'enhancing') ORDER BY created_at, image_id LIMIT 500")
def oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(F.col("status").isin("analyzing", "enhancing")).orderBy("created_at", "image_id").limit(500).select("image_id")


@query("u1_union_all", "SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")).unionAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("u2_ordered_distinct", "SELECT job_id, string_agg(event_type, ',' ORDER BY first, event_type) AS kinds FROM (SELECT user_id AS job_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) t GROUP BY job_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's distinct event types, in the order of their first event."""
    firsts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id"), "event_type").agg(F.min("event_id").alias("first"))
    in_order = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return firsts.groupBy("job_id").agg(F.array_join(F.transform(in_order, lambda e: e["event_type"]), ",").alias("kinds"))


@query("u3_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("u4_intersection", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where("lang = 'en'").select("source").intersect(docs.where("lang = 'fr'").select("source"))


@query("u5_schema_drift", "WITH actual AS (SELECT column_name AS name FROM (DESCRIBE SELECT * FROM documents)), expected(name) AS (VALUES ('doc_id'), ('text'), ('lang'), ('checksum')) SELECT coalesce(a.name, e.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' ELSE 'unchanged' END AS state FROM actual a FULL JOIN expected e ON a.name = e.name")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = spark.createDataFrame([(c,) for c in table(spark, sf_dir, "documents").columns], "name string").withColumn("actual", F.lit(True))
    expected = spark.createDataFrame([("doc_id",), ("text",), ("lang",), ("checksum",)], "name string").withColumn("expected", F.lit(True))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("unchanged")
    return actual.join(expected, "name", "full").select("name", state.alias("state"))
