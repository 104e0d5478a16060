"""Registered queries over links and postings, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import labels as L
from ..operators import postings as PO
from ..operators import provenance as P
from ..session import shared_folder, spread, table
from ..sources import versions as VS


def claim_cycles(spark, d):
    """Orders as a customer's claims, each derived from the order before; the first one of every third customer from the
    last, which closes a cycle, and of some from an order in the middle."""
    o = spark.sql("""
        SELECT o_custkey AS run_id, o_orderkey AS claim_ref,
               CASE WHEN row_number() OVER w > 1 THEN lag(o_orderkey) OVER w WHEN o_custkey % 3 = 0 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) WHEN o_custkey % 3 = 1 THEN lead(o_orderkey, 2) OVER w END AS parent_ref
        FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""", orders=table(spark, d, "orders"))
    return P.has_cycle(o, ["run_id"])


CLAIM_CYCLES = """
WITH RECURSIVE o AS (
  SELECT o_custkey AS run_id, o_orderkey AS claim_ref,
         CASE WHEN row_number() OVER w > 1 THEN lag(o_orderkey) OVER w WHEN o_custkey % 3 = 0 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) WHEN o_custkey % 3 = 1 THEN lead(o_orderkey, 2) OVER w END AS parent_ref
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
walk AS (SELECT run_id, claim_ref, parent_ref AS up FROM o WHERE parent_ref IS NOT NULL
         UNION SELECT w.run_id, w.claim_ref, o.parent_ref FROM walk w JOIN o ON o.run_id = w.run_id AND o.claim_ref = w.up WHERE o.parent_ref IS NOT NULL)
SELECT DISTINCT run_id, claim_ref FROM walk WHERE claim_ref = up
"""


def array_containment(spark, d):
    """AJ1: for each order, the suppliers of its lines as an array; the orders of which the array has all suppliers of another
    order with two or three."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))
    asked = lines.where(F.size("suppliers").between(2, 3)).select(F.col("l_orderkey").alias("query_key"), "suppliers")
    return PO.containing(asked, lines, ("query_key", "suppliers"), ("l_orderkey", "suppliers")).where("query_key <> l_orderkey")


ARRAY_CONTAINMENT = """
WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1)
SELECT q.l_orderkey AS query_key, r.l_orderkey FROM l q JOIN n ON n.l_orderkey = q.l_orderkey AND n.n BETWEEN 2 AND 3 JOIN l r ON r.l_suppkey = q.l_suppkey AND r.l_orderkey <> q.l_orderkey
GROUP BY 1, 2 HAVING count(*) = any_value(n.n)
"""


def cover_density_shortlist(spark, d):
    """T4: the 50 first documents of each benchmark item by cover density, with the oldest others where fewer have any."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("created_at", F.col("doc_id") % 97)
    return PO.cover_shortlist(table(spark, d, "benchmark"), docs, ("item_id", "text"), ("doc_id", "text", "created_at"), 50).select("item_id", "rank", "doc_id", L.half_away(F.col("score"), 9).alias("score"))


_PLACES = "SELECT {key}, unnest(list_zip(range(0, len(w)), w)) AS x FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w FROM {tab})"
COVER_DENSITY_SHORTLIST = f"""
WITH q AS (SELECT DISTINCT item_id, x[2] AS term FROM ({_PLACES.format(key='item_id', tab='benchmark')})), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
p AS (SELECT doc_id, x[1] AS pos, x[2] AS term FROM ({_PLACES.format(key='doc_id', tab='documents')})),
met AS (SELECT q.item_id, d.doc_id FROM q JOIN (SELECT DISTINCT doc_id, term FROM p) d USING (term) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) = any_value(n.n)),
e AS (SELECT m.item_id, m.doc_id, p.pos, p.term, row_number() OVER (PARTITION BY m.item_id, m.doc_id ORDER BY p.pos) AS nth FROM met m JOIN p USING (doc_id) JOIN q ON q.item_id = m.item_id AND q.term = p.term),
latest AS (SELECT a.item_id, a.doc_id, a.pos, a.nth, b.term, max(b.pos) AS last_at, max(b.nth) AS last_nth FROM e a JOIN e b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.pos <= a.pos GROUP BY ALL),
runs AS (SELECT l.item_id, l.doc_id, l.pos, l.nth, min(last_at) AS start, min(last_nth) AS start_nth FROM latest l JOIN n USING (item_id) GROUP BY 1, 2, 3, 4 HAVING count(*) = any_value(n.n)),
cover AS (SELECT item_id, doc_id, start, start_nth, min(pos) AS pos, min(nth) AS nth FROM runs GROUP BY ALL),
score AS (SELECT item_id, doc_id, sum(CAST(0.1 AS DOUBLE) / (1 + (pos - start) - (nth - start_nth))) AS score FROM cover GROUP BY 1, 2),
every AS (SELECT b.item_id, d.doc_id, d.doc_id % 97 AS created_at, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN score s ON s.item_id = b.item_id AND s.doc_id = d.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, created_at, doc_id) AS INTEGER) AS rank, doc_id, round(score, 9) AS score
FROM every QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, created_at, doc_id) <= 50
"""

def source_versions(spark, d):
    """IO17, IO18: a run for each year of orders brings the priority of each customer's last order in
    it; a version is added where it isn't that of the customer's last version. The last run is made twice."""
    o = table(spark, d, "orders").selectExpr("o_custkey AS source", "year(o_orderdate) AS run_id", "o_orderpriority", "o_orderdate", "o_orderkey")
    runs = o.groupBy("source", "run_id").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("content"))
    years = sorted(r[0] for r in runs.select("run_id").distinct().collect())  # a row for each year
    schema = StructType.fromDDL("source bigint, version int, content string, run_id int")
    versions = VS.BucketTable(spark, f"{shared_folder(spark)}/factloom/versions-{uuid.uuid4().hex}", schema, "source", 16)
    for year in [*years, *years[-1:]]:
        versions.commit(year, runs.where(F.col("run_id") == year).select(F.col("source").cast("long").alias("source"), "content", "run_id"), VS.next_versions("source", "content", "run_id"))
    return versions.read()


SOURCE_VERSIONS = """
WITH r AS (SELECT o_custkey AS source, CAST(year(o_orderdate) AS INTEGER) AS run_id, o_orderpriority AS content FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
c AS (SELECT *, lag(content) OVER (PARTITION BY source ORDER BY run_id) AS before FROM r)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY run_id) AS INTEGER) AS version, content, run_id FROM c WHERE before IS DISTINCT FROM content
"""

QUERIES = {f.__name__: f for f in (claim_cycles, array_containment, cover_density_shortlist, source_versions)}
ORACLES = {"source_versions": SOURCE_VERSIONS, "claim_cycles": CLAIM_CYCLES, "array_containment": ARRAY_CONTAINMENT, "cover_density_shortlist": COVER_DENSITY_SHORTLIST}
