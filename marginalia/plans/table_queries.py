"""Joins, set operations, scalar parsing and integrity checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as P
from ..operators import quality as Q
from ..sources import readers
from .base import brands, query, sql, table


@query("merged_balances", """SELECT c_custkey, coalesce(o.total, s.s_acctbal, c_acctbal) AS amount, CASE WHEN o.total IS NOT NULL THEN 'orders' WHEN s.s_acctbal IS NOT NULL THEN 'supplier' ELSE 'customer' END AS source
FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN supplier s ON s_suppkey = c_custkey""")
def merged_balances(spark, sf_dir):
    """JOI-3: three sources by priority."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left").join(s, "c_custkey", "left")
    source = F.when(F.col("total").isNotNull(), "orders").when(F.col("s_acctbal").isNotNull(), "supplier").otherwise("customer")
    return rows.select("c_custkey", F.coalesce("total", "s_acctbal", "c_acctbal").alias("amount"), source.alias("source"))


@query("merge_report", """SELECT count(*) AS customers, count(*) FILTER (o.k IS NULL) AS without_orders, count(*) FILTER (s.s_suppkey IS NULL) AS without_supplier, count(*) FILTER (s.s_acctbal IS NOT NULL AND s.s_acctbal <> c_acctbal) AS conflicts
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey LEFT JOIN supplier s ON s_suppkey = c_custkey""")
def merge_report(spark, sf_dir):
    """JOI-3, SNK-5: misses and conflicts of the merge, counted."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    rows = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").join(s, "c_custkey", "left")
    return rows.agg(F.count("*").alias("customers"), F.count_if(F.col("k").isNull()).alias("without_orders"), F.count_if(F.col("s_acctbal").isNull()).alias("without_supplier"), F.count_if(F.col("s_acctbal") != F.col("c_acctbal")).alias("conflicts"))


@query("traced_lines", """SELECT r_name, n_name, p_brand, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""")
def traced_lines(spark, sf_dir):
    """JOI-1, JOI-2, JOI-4: a line traced through all its dimensions; the planner broadcasts the small ones by size."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.groupBy("r_name", "n_name", "p_brand").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("customers_without_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def customers_without_orders(spark, sf_dir):
    """JOI-5."""
    return Q.orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_custkey")


@query("unlabelled_documents", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_documents(spark, sf_dir):
    """JOI-6, SET-4."""
    return Q.broken(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source")


@query("order_sizes", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders")
def order_sizes(spark, sf_dir):
    """JOI-7: a correlated count, as one aggregate and a join."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"))


@query("memberships", """WITH u AS (SELECT l_orderkey AS unit, p_brand AS concept, l_linenumber AS pos FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT l_orderkey, s_name, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT unit, concept, min(pos)::BIGINT AS pos FROM u GROUP BY 1, 2""")
def memberships(spark, sf_dir):
    """JOI-8, SET-2, AGG-3: concepts of an order by either of two memberships, at the earliest position."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), "l_partkey", "l_suppkey", F.col("l_linenumber").alias("pos"))
    a = li.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("unit", F.col("p_brand").alias("concept"), "pos")
    b = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("unit", F.col("s_name").alias("concept"), "pos")
    return a.unionByName(b).groupBy("unit", "concept").agg(F.min("pos").cast("long").alias("pos"))


@query("membership_strength", """WITH w AS (SELECT l_orderkey AS unit, p_brand AS concept, greatest(l_discount, l_tax) AS s, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT unit, concept, round(sum(s), 6) AS strength, count(DISTINCT l_suppkey) AS suppliers, round(sum(s) / nullif(max(sum(s)) OVER (PARTITION BY unit), 0), 6) AS confidence FROM w GROUP BY 1, 2""")
def membership_strength(spark, sf_dir):
    """REL-19, REL-20, REL-21: strength of a unit's concepts, relative to the strongest."""
    w = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    s = w.groupBy(F.col("l_orderkey").alias("unit"), F.col("p_brand").alias("concept")).agg(F.sum(F.greatest("l_discount", "l_tax")).alias("s"), F.count_distinct("l_suppkey").alias("suppliers"))
    top = F.max("s").over(Window.partitionBy("unit"))
    return s.select("unit", "concept", F.round("s", 6).alias("strength"), "suppliers", F.round(F.col("s") / F.nullif(top, F.lit(0.0)), 6).alias("confidence"))


@query("unit_signatures", """WITH w AS (SELECT p_brand AS concept, l_orderkey AS unit, round(sum(greatest(l_discount, l_tax)), 6) AS strength, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT *, max(strength) OVER (PARTITION BY concept) AS top, row_number() OVER (PARTITION BY concept ORDER BY strength DESC, suppliers DESC, unit) AS r FROM w)
SELECT concept, r::INT AS r, CASE WHEN r <= 25 THEN 25 WHEN r <= 50 THEN 50 ELSE 100 END AS depth, unit, strength, suppliers, round(coalesce(strength / nullif(top, 0), 0), 6) AS confidence FROM r WHERE r <= 100""")
def unit_signatures(spark, sf_dir):
    """REL-21: the 25, 50 and 100 units that activate a concept most, relative to the strongest; ``depth`` is the least list that holds a unit."""
    w = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    s = w.groupBy(F.col("p_brand").alias("concept"), F.col("l_orderkey").alias("unit")).agg(F.round(F.sum(F.greatest("l_discount", "l_tax")), 6).alias("strength"), F.count_distinct("l_suppkey").alias("suppliers"))
    best = Window.partitionBy("concept").orderBy(F.desc("strength"), F.desc("suppliers"), "unit")
    top = s.withColumn("r", F.row_number().over(best)).where("r <= 100").withColumn("top", F.max("strength").over(Window.partitionBy("concept")))
    depth = F.when(F.col("r") <= 25, 25).when(F.col("r") <= 50, 50).otherwise(100)
    return top.select("concept", "r", depth.alias("depth"), "unit", "strength", "suppliers", F.round(F.coalesce(F.col("strength") / F.nullif("top", F.lit(0.0)), F.lit(0.0)), 6).alias("confidence"))


@query("page_numbers", "SELECT count(*) AS n, count(DISTINCT page_id) AS keys, min(page_id) AS least, max(page_id) AS most, count(*) = count(DISTINCT page_id) AND max(page_id) - min(page_id) + 1 = count(*) AS gapless FROM pages")
def page_numbers(spark, sf_dir):
    """SRC-6: page numbers are a column of the source, checked instead of read off the order of rows."""
    return readers.key_report(table(spark, sf_dir, "pages"), "page_id")


@query("group_signatures", sql("brands", """SELECT group_id, item, r::INT AS r, round(k::DOUBLE / units, 6) AS density, round(k::DOUBLE / tot, 6) AS share, round((k::DOUBLE / tot) / (c::DOUBLE / (SELECT sum(c) FROM m)), 6) AS lift FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY k DESC, item) AS r FROM gk) JOIN m USING (item) WHERE r <= 10""", """
gk AS (SELECT i.group_id, i.item, count(*) AS k, any_value(u.units) AS units, any_value(u.tot) AS tot FROM inc i JOIN (SELECT group_id, count(DISTINCT unit_seq) AS units, count(*) AS tot FROM inc GROUP BY 1) u USING (group_id) GROUP BY 1, 2)"""))
def group_signatures(spark, sf_dir):
    """REL-22: the ten items that mark a group, with density, share and lift."""
    inc = brands(spark, sf_dir)
    u = inc.groupBy("group_id").agg(F.count_distinct("unit_seq").alias("units"), F.count("*").alias("tot"))
    m = inc.groupBy("item").agg(F.count("*").alias("c"))
    t = m.agg(F.sum("c").alias("t"))
    k = inc.groupBy("group_id", "item").agg(F.count("*").alias("k")).withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("k"), "item"))).where("r <= 10")
    share = F.col("k") / F.col("tot")
    return k.join(u, "group_id").join(m, "item").join(F.broadcast(t)).select("group_id", "item", "r", F.round(F.col("k") / F.col("units"), 6).alias("density"), F.round(share, 6).alias("share"), F.round(share / (F.col("c") / F.col("t")), 6).alias("lift"))


@query("contained_orders", """WITH d AS (SELECT DISTINCT l_orderkey AS rel, p_type AS node FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT rel FROM d GROUP BY 1 HAVING bool_and(node IN ('ECONOMY', 'STANDARD', 'PROMO'))""")
def contained_orders(spark, sf_dir):
    """JOI-18: orders all of whose types are in a set."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("rel"), F.col("p_type").alias("node"))
    return d.groupBy("rel").agg(F.bool_and(F.col("node").isin("ECONOMY", "STANDARD", "PROMO")).alias("all_in")).where("all_in").select("rel")


@query("disjoint_orders", "SELECT DISTINCT l_orderkey AS rel FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#1', 'Brand#2'))")
def disjoint_orders(spark, sf_dir):
    """JOI-19: orders that survive the removal of two brands."""
    li = table(spark, sf_dir, "lineitem")
    gone = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2")).select(F.col("p_partkey").alias("l_partkey"))
    hit = li.join(gone, "l_partkey", "left_semi").select("l_orderkey")
    return li.select("l_orderkey").join(hit, "l_orderkey", "left_anti").distinct().withColumnRenamed("l_orderkey", "rel")


@query("common_groups", sql("brands", """SELECT a.item AS x, b.item AS y, count(*) AS groups FROM (SELECT DISTINCT item, group_id FROM inc) a JOIN (SELECT DISTINCT item, group_id FROM inc) b ON a.group_id = b.group_id AND a.item < b.item GROUP BY 1, 2"""))
def common_groups(spark, sf_dir):
    """SET-3: intersections of items' groups."""
    d = brands(spark, sf_dir).select("item", "group_id").distinct()
    return d.select(F.col("item").alias("x"), "group_id").join(d.select(F.col("item").alias("y"), "group_id"), "group_id").where("x < y").groupBy("x", "y").agg(F.count("*").alias("groups"))


@query("distinct_baskets", sql("brands", "SELECT items, min(unit_seq) AS first, count(*) AS n FROM (SELECT unit_seq, string_agg(item, '|' ORDER BY item) AS items FROM inc GROUP BY 1) GROUP BY 1"))
def distinct_baskets(spark, sf_dir):
    """SET-5: equal member sets once, by the first unit."""
    sets = brands(spark, sf_dir).groupBy("unit_seq").agg(F.array_join(F.array_sort(F.collect_set("item")), "|").alias("items"))
    return sets.groupBy("items").agg(F.min("unit_seq").alias("first"), F.count("*").alias("n"))


@query("never_bought", """SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49""")
def never_bought(spark, sf_dir):
    """SET-4: a difference of sets."""
    return table(spark, sf_dir, "supplier").select("s_suppkey").subtract(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")))


@query("integrity", """SELECT "check", failures, failures = 0 AS passed FROM (
  SELECT 'orphan_customers' AS "check", count(*) AS failures FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'broken_orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'broken_parts', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'repeated_lines', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
  UNION ALL SELECT 'wrong_lengths', count(*) FROM documents WHERE length(text) <> n_chars)""")
def integrity(spark, sf_dir):
    """AGG-6, JOI-5, JOI-6, SNK-5: checks as rows."""
    t = lambda n: table(spark, sf_dir, n)
    return Q.report({
        "orphan_customers": Q.orphans(t("customer"), "c_custkey", t("orders"), "o_custkey"),
        "broken_orders": Q.broken(t("orders"), "o_custkey", t("customer"), "c_custkey"),
        "broken_parts": Q.broken(t("lineitem"), "l_partkey", t("part"), "p_partkey"),
        "repeated_lines": Q.repeated_keys(t("lineitem"), ["l_orderkey", "l_linenumber"]),
        "wrong_lengths": t("documents").where(F.length("text") != F.col("n_chars")),
    })


_LETTERS = {"a": "A", "b": "B", "g": "J", "x": "X", "$": "S"}


@query("parsed_names", """SELECT p_partkey, translate(p_name, 'abgx$', 'ABJXS') AS written, translate(p_name, 'aeiou', '') AS consonants, translate(trim(p_name), 'ei', 'aa') AS folded,
  CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS brand, CASE WHEN contains(p_type, 'ECO') THEN 'low' WHEN contains(p_type, 'PRO') THEN 'sale' ELSE 'plain' END AS tier,
  p_partkey - 226 AS shifted, len(regexp_extract_all(p_name, '[a-z]')) AS letters FROM part""")
def parsed_names(spark, sf_dir):
    """PRJ-1 to PRJ-3, PRJ-5 to PRJ-7, PRJ-9, PRJ-10."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        P.transliterate(name, _LETTERS).alias("written"),
        P.without(name, "aeiou").alias("consonants"),
        P.folded(name, "ei", "a").alias("folded"),
        P.without_prefixes(F.col("p_brand"), "Brand#").alias("brand"),
        P.by_substring(F.col("p_type"), [("ECO", "low"), ("PRO", "sale")], "plain").alias("tier"),
        (F.col("p_partkey") - 226).alias("shifted"),
        F.regexp_count("p_name", F.lit("[a-z]")).cast("long").alias("letters"),
    )


_FEATURES = "concat('STEM|POS:', upper(substr(c_mktsegment, 1, 1)), '|', (c_custkey % 3) + 1, 'MS|ROOT:', lower(substr(c_mktsegment, 1, 3)), '|', CASE WHEN c_custkey % 2 = 0 THEN 'NOM' ELSE 'GEN' END)"


@query("parsed_features", f"""WITH f AS (SELECT c_custkey, {_FEATURES} AS x FROM customer)
SELECT c_custkey, split_part(x, '|', 1) AS segment, substr(split_part(x, '|', 2), 5) AS pos, substr(split_part(x, '|', 4), 6) AS root, split_part(x, '|', 5) AS grammatical_case, NULL::VARCHAR AS mood, regexp_extract(x, '(?:^|[^A-Za-z0-9])([123])MS(?:$|[^A-Za-z0-9])', 1) AS person FROM f""")
def parsed_features(spark, sf_dir):
    """PRJ-4, PRJ-8: feature strings, and the person out of a compound tag."""
    x = F.expr(_FEATURES)
    f = P.features(F.col("x"), {"segment": ("STEM", "PREFIX", "SUFFIX"), "grammatical_case": ("NOM", "ACC", "GEN"), "mood": ("IND", "SUBJ", "JUS")}, {"pos": "POS:", "root": "ROOT:"})
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x")).select("c_custkey", f["segment"].alias("segment"), f["pos"].alias("pos"), f["root"].alias("root"), f["grammatical_case"].alias("grammatical_case"), f["mood"].alias("mood"), P.person(F.col("x")).alias("person"))


@query("parsed_coordinates", "SELECT l_orderkey, l_linenumber, l_orderkey AS s, l_linenumber::BIGINT AS a, l_suppkey AS w, l_partkey AS t FROM lineitem")
def parsed_coordinates(spark, sf_dir):
    """PRJ-12."""
    x = F.format_string("(%d:%d:%d:%d)", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(P.coordinate(x), "sawt", strict=True)))


@query("event_fields", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1")
def event_fields(spark, sf_dir):
    """SRC-4: JSON fields by path."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("k"), F.count_distinct(k).alias("kinds"))


@query("item_ids", sql("brands", "SELECT item, printf('CONCEPT_%03d', row_number() OVER (ORDER BY c DESC, item)) AS id, c FROM m"))
def item_ids(spark, sf_dir):
    """Identifiers by rank over a total order."""
    m = brands(spark, sf_dir).groupBy("item").agg(F.count("*").alias("c"))
    return m.select("item", F.format_string("CONCEPT_%03d", F.row_number().over(Window.orderBy(F.desc("c"), "item"))).alias("id"), "c")  # a vocabulary


@query("table_digests")
def table_digests(spark, sf_dir):
    """SNK-3: rows and order-free digests of the tables; the hash is Spark's own."""
    parts = [readers.digest(table(spark, sf_dir, n)).withColumn("table", F.lit(n)) for n in ("customer", "nation", "region", "supplier", "part")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
