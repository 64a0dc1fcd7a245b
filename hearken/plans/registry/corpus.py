"""Group routes, thinning, pair files and the corpus build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.operators import groups, thinning
from hearken.plans.corpus import attach_routes, build_corpus
from hearken.plans.registry.base import query, table
from hearken.session import scratch_path
from hearken.sources import readers, writers

_SIZES = "SELECT text, min(doc_id) AS group_id, count(*) AS n FROM documents GROUP BY text"
_ROUTE = """CASE WHEN n = 1 THEN 'single' WHEN n < 4 OR n <= 5 THEN 'kept_all'
    ELSE 'clustered' END"""
_CONTEXT = "lang || '/' || source"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Language and source stand in for the question, the text for the answer."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"),
        F.concat_ws("/", "lang", "source").alias("context"),
        F.col("text").alias("response"),
    )


@query(f"SELECT group_id, n, {_ROUTE} AS route FROM ({_SIZES})")
def route_groups(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return groups.route_groups(docs, "doc_id", "text").select("group_id", "n", "route")


@query(
    f"""SELECT doc_id AS pair_id, group_id, n, {_ROUTE} AS route
    FROM documents JOIN ({_SIZES}) USING (text)"""
)
def route_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("context")
    )
    return attach_routes(docs).select("pair_id", "group_id", "n", "route")


_REPORT = """SELECT sum(CASE WHEN route = 'clustered' THEN 5 ELSE n END)::BIGINT AS rows_out,
    count(*) AS contexts_out, count(*) FILTER (route = 'clustered') AS clustered,
    count(*) FILTER (route = 'kept_all') AS kept_all, count(*) FILTER (route = 'single') AS single,
    0::BIGINT AS no_context, sum(n)::BIGINT AS rows_in,
    round(100.0 * (1 - sum(CASE WHEN route = 'clustered' THEN 5 ELSE n END)::DOUBLE / sum(n)), 1)
        AS reduction_pct"""


@query(f"{_REPORT} FROM (SELECT n, {_ROUTE} AS route FROM ({_SIZES}))")
def reduction_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return groups.reduction_report(groups.route_groups(docs, "doc_id", "text"))


@query(
    """SELECT min(doc_id) AS first_id, count(*) AS n FROM documents
    GROUP BY text HAVING count(*) > 1"""
)
def multi_representatives(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return groups.multi_representatives(docs, "doc_id", "text").select("first_id", "n")


@query(
    """SELECT doc_id, source FROM documents WHERE text = (
        SELECT text FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY min(doc_id) LIMIT 1)"""
)
def sample_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return groups.sample_report(docs, "doc_id", "text").select("doc_id", "source")


@query(
    """WITH cells AS (SELECT label, unnest(embedding::DOUBLE[]) AS x,
        generate_subscripts(embedding, 1) AS pos FROM embeddings),
    mean AS (SELECT label, list(value ORDER BY pos) AS centre FROM (
        SELECT label, pos, avg(x) AS value FROM cells GROUP BY label, pos) GROUP BY label),
    scored AS (SELECT e.label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6)
        AS score FROM embeddings e JOIN mean m USING (label))
    SELECT label, vec_id, score FROM scored
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1"""
)
def cluster_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """One centre per label; the member closest to it."""
    members = table(spark, sf, "embeddings").withColumn("cluster", F.lit(0))
    centres = thinning.centroids(members, "label", "cluster")
    best = thinning.nearest_to_centroids(members, centres, "label", "cluster", "vec_id")
    return best.drop("cluster")


def _label_members(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    return vectors.join(sizes, "label").select(
        F.col("label").cast("long").alias("group_id"),
        F.col("vec_id").alias("pair_id"),
        "n",
        "embedding",
    )


@query()
def thin_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Five answers per label, each label clustered in one task."""
    return thinning.pick_representatives(_label_members(spark, sf))


@query()
def thin_large_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The same picks by rounds over slices, as for groups too large for one task."""
    return thinning.pick_representatives(_label_members(spark, sf), group_rows=25, max_rounds=20)


@query(
    """SELECT label::BIGINT AS group_id, least(5, count(*))::BIGINT AS n_picks, true AS own_members,
        true AS same_in_slices FROM embeddings GROUP BY label"""
)
def thinned_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Picks per label are its own members, and rounds over slices make the same picks."""
    members = _label_members(spark, sf)
    whole = thinning.pick_representatives(members)
    sliced = thinning.pick_representatives(members, group_rows=25).select(
        "group_id", "cluster", F.col("pair_id").alias("other")
    )
    own = members.select("group_id", "pair_id", F.lit(True).alias("own"))
    key = F.coalesce("cluster", F.lit(-1))
    both = whole.withColumn("cluster", key).join(
        sliced.withColumn("cluster", key), ["group_id", "cluster"], "left"
    )
    return both.join(own, ["group_id", "pair_id"], "left").groupBy("group_id").agg(
        F.count("*").alias("n_picks"),
        F.every(F.coalesce("own", F.lit(False))).alias("own_members"),
        F.every(F.coalesce(F.col("pair_id") == F.col("other"), F.lit(False))).alias("same_in_slices"),
    )


@query(
    f"""{_REPORT} FROM (SELECT n, {_ROUTE} AS route FROM (
        SELECT {_CONTEXT} AS context, count(*) AS n FROM documents GROUP BY 1))"""
)
def build_corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    return build_corpus(_pairs(spark, sf))[1]


@query(
    f"""SELECT {_CONTEXT} AS context, CASE WHEN count(*) > 5 THEN 5 ELSE count(*) END AS n,
        true AS own_answers FROM documents GROUP BY 1"""
)
def build_corpus_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows kept per context, and whether every kept answer is one of its own."""
    pairs = _pairs(spark, sf)
    kept, _ = build_corpus(pairs)
    own = pairs.withColumn("own", F.lit(True))
    checked = kept.join(own, ["pair_id", "context", "response"], "left")
    return checked.groupBy("context").agg(
        F.count("*").alias("n"), F.every(F.coalesce("own", F.lit(False))).alias("own_answers")
    )


@query(f"SELECT {_CONTEXT} AS context, text AS response FROM documents")
def pairs_through_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs_csv")
    writers.write_pairs(_pairs(spark, sf), path)
    return readers.read_pairs_csv(spark, path).select("context", "response")


@query(f"SELECT {_CONTEXT} AS context, text AS response FROM documents")
def pairs_by_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same files, cut into records by ranges."""
    path = scratch_path(spark, "pairs_csv")
    writers.write_pairs(_pairs(spark, sf), path)
    return readers.read_pairs_csv_ranges(spark, path).select("context", "response")


@query(f"SELECT {_CONTEXT} AS context, text AS response FROM documents")
def pairs_through_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs_json")
    writers.write_pairs_json(_pairs(spark, sf), path)
    return readers.read_pairs_json(spark, path).select("context", "response")


@query("""SELECT text AS "Context", lang AS "Response" FROM documents WHERE trim(text) <> ''""")
def documents_through_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "documents_csv")
    docs = table(spark, sf, "documents").select(
        F.col("text").alias("context"), F.col("lang").alias("response")
    )
    writers.write_pairs(docs, path)
    return readers.read_documents(spark, path)
