"""Queries of the evaluation operators over the driver's tables, which stand in for the domain's own.

An order is a recipe, its lines in a fixed total order are the reference list, and a perturbed copy of the lines
is the answer. Each query has SQL of the same name in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.functions.quantity import parse_quantity, round_trips
from assayer.operators import audit, checks, metrics, report
from assayer.operators import events as ev
from assayer.operators.matching import match_kth_occurrence
from assayer.sources import recipes

LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag",
    "l_linestatus",
]
QUERIES, SQL = {}, {}

#: The reference list and the answer, in SQL.
LISTS = """
    WITH lines AS (
        SELECT l_orderkey AS recipe, l_partkey AS item, CAST(l_quantity AS BIGINT) AS amount, l_returnflag AS section,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                                  l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS position
        FROM lineitem
    ), refs AS (
        SELECT l.*, CASE WHEN p_size <= 10 THEN 'primary' WHEN p_size <= 30 THEN 'secondary' ELSE 'tertiary' END AS tier,
               p_size % 7 = 0 AS optional
        FROM lines l JOIN part ON p_partkey = item
    ), said AS (
        SELECT recipe, CASE WHEN (recipe + position) % 11 = 0 THEN -item ELSE item END AS item,
               CASE WHEN position % 5 = 0 THEN NULL WHEN position % 4 = 0 THEN amount + 1 ELSE amount END AS amount,
               row_number() OVER (PARTITION BY recipe ORDER BY CASE WHEN recipe % 3 = 0 THEN -position ELSE position END) AS idx
        FROM refs WHERE (recipe * 7 + position) % 9 <> 0
    ), pairs AS (
        SELECT coalesce(r.recipe, s.recipe) AS recipe, r.position, s.idx, r.tier, r.optional, r.section,
               r.amount AS known, s.amount AS said
        FROM (SELECT *, row_number() OVER (PARTITION BY recipe, item ORDER BY position) AS nth FROM refs) r
        FULL JOIN (SELECT *, row_number() OVER (PARTITION BY recipe, item ORDER BY idx) AS nth FROM said) s
          ON r.recipe = s.recipe AND r.item = s.item AND r.nth = s.nth
    )
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = lines.select(
        F.col("l_orderkey").alias("recipe"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").cast("long").alias("amount"),
        F.col("l_returnflag").alias("section"),
        nth.alias("position"),
    )
    tier = F.when(F.col("p_size") <= 10, "primary").when(F.col("p_size") <= 30, "secondary").otherwise("tertiary")
    parts = read(spark, sf_dir, "part").select("p_partkey", tier.alias("tier"), (F.col("p_size") % 7 == 0).alias("optional"))
    return lines.join(parts, F.col("item") == F.col("p_partkey")).drop("p_partkey")


def said_lines(refs: DataFrame) -> DataFrame:
    back = F.when(F.col("recipe") % 3 == 0, -F.col("position")).otherwise(F.col("position"))
    at = F.col("position")
    return refs.filter((F.col("recipe") * 7 + at) % 9 != 0).select(
        "recipe",
        F.when((F.col("recipe") + at) % 11 == 0, -F.col("item")).otherwise(F.col("item")).alias("item"),
        F.when(at % 5 == 0, None).when(at % 4 == 0, F.col("amount") + 1).otherwise(F.col("amount")).alias("said"),
        F.row_number().over(Window.partitionBy("recipe").orderBy(back)).alias("idx"),
    )


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = reference_lines(spark, sf_dir)
    known = refs.withColumnRenamed("amount", "known")
    return match_kth_occurrence(said_lines(refs), known, ["recipe"], "item", ["idx"], ["position"])


@query(
    LISTS
    + """
    SELECT c_mktsegment AS segment, count(idx) AS candidates, count(position) AS references_n,
           count(*) FILTER (idx IS NOT NULL AND position IS NOT NULL) AS true_positives,
           count(*) FILTER (idx IS NOT NULL AND position IS NOT NULL) / count(idx)::DOUBLE AS precision,
           count(*) FILTER (idx IS NOT NULL AND position IS NOT NULL) / count(position)::DOUBLE AS recall,
           2.0 * count(*) FILTER (idx IS NOT NULL AND position IS NOT NULL) / (count(idx) + count(position)) AS f1
    FROM pairs JOIN orders ON o_orderkey = recipe JOIN customer ON c_custkey = o_custkey GROUP BY 1
"""
)
def identity_micro_f1(spark, sf_dir):
    """Micro-averaged identity scores by market segment."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recipe"), "o_custkey")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    per = paired(spark, sf_dir).groupBy("recipe").agg(*report.pair_counts())
    return report.micro_scores(per.join(orders, "recipe").join(customers, "o_custkey"), ["segment"])


@query(
    LISTS
    + """
    SELECT recipe % 100 AS bucket,
           count(*) FILTER (NOT optional AND idx IS NOT NULL) / nullif(count(*) FILTER (NOT optional), 0)::DOUBLE AS required_recall,
           count(*) FILTER (optional AND idx IS NOT NULL) / nullif(count(*) FILTER (optional), 0)::DOUBLE AS optional_recall,
           count(*) FILTER (tier = 'primary' AND idx IS NOT NULL) / nullif(count(*) FILTER (tier = 'primary'), 0)::DOUBLE AS primary_recall,
           sum(CASE WHEN idx IS NULL THEN 0 WHEN tier = 'primary' THEN 5 WHEN tier = 'secondary' THEN 2 ELSE 1 END)
             / sum(CASE tier WHEN 'primary' THEN 5 WHEN 'secondary' THEN 2 ELSE 1 END)::DOUBLE AS weighted_recall
    FROM pairs WHERE position IS NOT NULL GROUP BY 1
"""
)
def tier_weighted_recall(spark, sf_dir):
    """Recall of required, optional and primary references, and by tier weight."""
    df = paired(spark, sf_dir).filter("position IS NOT NULL")
    return df.groupBy((F.col("recipe") % 100).alias("bucket")).agg(*report.recall_columns(F.col("idx").isNotNull()))


@query(
    LISTS
    + """
    SELECT recipe % 50 AS bucket, status, count(*) AS n,
           count(*) / sum(count(*)) OVER (PARTITION BY recipe % 50)::DOUBLE AS rate
    FROM (SELECT recipe, CASE WHEN said IS NULL THEN 'missing' WHEN said = known THEN 'exact' ELSE 'wrong' END AS status
          FROM pairs WHERE idx IS NOT NULL AND position IS NOT NULL) GROUP BY recipe % 50, status
"""
)
def quantity_status_rates(spark, sf_dir):
    """Statuses of matched quantities through the quantity parser, and their rates."""
    df = paired(spark, sf_dir).filter("idx IS NOT NULL AND position IS NOT NULL")
    # Whole amounts: one parse for each distinct amount, then equality of the parsed values.
    amounts = df.select(F.col("known").alias("n")).union(df.select("said")).filter("n IS NOT NULL").distinct()
    parsed = amounts.withColumn("q", parse_quantity(F.concat(F.col("n").cast("string"), F.lit(" cups"))))
    said = parsed.select(F.col("n").alias("said"), F.col("q").alias("q_said"))
    known = parsed.select(F.col("n").alias("known"), F.col("q").alias("q_known"))
    df = df.join(known, "known").join(said, "said", "left")
    status = metrics.quantity_status(F.col("q_said"), F.col("q_said.raw"), F.col("q_known"), F.col("q_known.raw"))
    counts = df.groupBy((F.col("recipe") % 50).alias("bucket"), status.alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("bucket")))


@query(
    LISTS
    + """
    , matched AS (SELECT * FROM pairs WHERE idx IS NOT NULL AND position IS NOT NULL),
    sections AS (SELECT recipe, section, min(position) AS rank FROM refs GROUP BY 1, 2)
    SELECT a.recipe,
           count(*) FILTER (b.idx > a.idx AND b.position > a.position) / nullif(count(*) FILTER (b.idx > a.idx), 0)::DOUBLE AS pairwise_accuracy,
           count(*) FILTER (b.idx > a.idx AND a.section <> b.section AND y.rank > x.rank)
             / nullif(count(*) FILTER (b.idx > a.idx AND a.section <> b.section), 0)::DOUBLE AS section_order_accuracy,
           avg(abs(a.idx - a.position)) FILTER (a.idx = b.idx) AS mean_absolute_displacement
    FROM matched a JOIN matched b ON a.recipe = b.recipe
    JOIN sections x ON x.recipe = a.recipe AND x.section = a.section
    JOIN sections y ON y.recipe = b.recipe AND y.section = b.section
    GROUP BY 1
"""
)
def order_metrics(spark, sf_dir):
    """Pairwise and section order accuracy and displacement of each order's matched lines."""
    refs = reference_lines(spark, sf_dir).groupBy("recipe").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "section"))), lambda r: r).alias("references")
    )
    df = paired(spark, sf_dir).filter("idx IS NOT NULL AND position IS NOT NULL")
    entry = F.struct(
        (F.col("idx") - 1).alias("candidate_index"), F.col("position").alias("reference_position"), F.lit("exact_key").alias("method")
    )
    lists = df.groupBy("recipe").agg(F.array_sort(F.collect_list(entry)).alias("matches")).join(refs, "recipe")
    made = metrics.order_metrics(F.col("matches"), F.col("references"), F.col("matches"))
    return lists.withColumn("o", made).select(
        "recipe", "o.pairwise_accuracy", "o.section_order_accuracy", "o.mean_absolute_displacement"
    )


@query("""
    SELECT concat_ws(' | ', CASE WHEN grouping(c_mktsegment) = 0 THEN c_mktsegment END,
                     CASE WHEN grouping(n_name) = 0 THEN n_name END,
                     CASE WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority END) AS label,
           grouping(c_mktsegment) * 4 + grouping(n_name) * 2 + grouping(o_orderpriority) AS grouping_set,
           count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS failed,
           CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS cost
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    GROUP BY GROUPING SETS ((o_orderpriority), (c_mktsegment, o_orderpriority), (n_name, o_orderpriority), (c_mktsegment, n_name, o_orderpriority))
""")
def report_grouping_sets(spark, sf_dir):
    """The four grouping sets of the report in one pass, with labels."""
    df = (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return report.grouped(
        df,
        "c_mktsegment",
        "n_name",
        "o_orderpriority",
        [
            F.count("*").alias("attempts"),
            F.count_if(F.col("o_orderstatus") == "F").alias("failed"),
            F.round(F.sum("o_totalprice"), 2).alias("cost"),
        ],
    )


@query("""
    WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
    a AS (SELECT doc_id, unnest(list_transform(list_zip(w[1:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS g FROM t WHERE len(w) > 1),
    x AS (SELECT doc_id, g, count(*) AS n FROM a GROUP BY 1, 2),
    b AS (SELECT item_id, unnest(list_transform(list_zip(w[1:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS g
          FROM (SELECT item_id, string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark) WHERE len(w) > 1),
    y AS (SELECT item_id, g, count(*) AS n FROM b GROUP BY 1, 2),
    o AS (SELECT doc_id, item_id, sum(least(x.n, y.n)) AS shared FROM x JOIN y USING (g) GROUP BY 1, 2)
    SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, shared / nx.n::DOUBLE AS bigram_precision, shared / ny.n::DOUBLE AS bigram_recall
    FROM o JOIN (SELECT doc_id, sum(n) AS n FROM x GROUP BY 1) nx USING (doc_id) JOIN (SELECT item_id, sum(n) AS n FROM y GROUP BY 1) ny USING (item_id)
    WHERE shared >= 0.5 * ny.n
""")
def bigram_overlap(spark, sf_dir):
    """Documents that hold at least half of a benchmark item's bigrams, copies counted."""
    items = report.bigram_counts(read(spark, sf_dir, "benchmark"), "item_id", "text")
    docs = report.bigram_counts(read(spark, sf_dir, "documents"), "doc_id", "text", items.select("gram").distinct())
    return report.bigram_matches(docs, items, "doc_id", "item_id", least_recall=0.5)


@query("""
    SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b
      ON contains(trim(regexp_replace(replace(lower(d.text), 'ß', 'ss'), '\\s+', ' ', 'g')), trim(regexp_replace(replace(lower(b.text), 'ß', 'ss'), '\\s+', ' ', 'g')))
""")
def leakage_join(spark, sf_dir):
    """Prompts (documents) that contain a protected text (benchmark items), through a shared rare word sequence."""
    return report.containing(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", "text"
    )


@query("""
    SELECT o_orderkey, lines,
           CASE WHEN lines <= 7 THEN 1 WHEN lines <= 10 THEN 2 WHEN lines <= 14 THEN 3 WHEN lines <= 18 THEN 4 ELSE 5 END AS complexity
    FROM (SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
""")
def complexity_bins(spark, sf_dir):
    """The derived complexity score of each order's number of lines."""
    orders, lines = read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "lineitem").select("l_orderkey")
    counts = checks.counted_children(orders, lines, "o_orderkey", "l_orderkey", "lines")
    return counts.withColumn("complexity", checks.complexity_score(F.col("lines")))


SYNTH = """
    SELECT p_partkey, p_size, p_name, p_type,
           concat(CAST(p_size AS VARCHAR), CASE WHEN p_size % 3 = 0 THEN ' 1/2' ELSE '' END, ' cups ', p_name, ', ', p_type) AS line FROM part
"""


def _synthetic(spark, sf_dir):
    size = F.col("p_size").cast("string")
    half = F.when(F.col("p_size") % 3 == 0, " 1/2").otherwise("")
    return read(spark, sf_dir, "part").withColumn(
        "line", F.concat(size, half, F.lit(" cups "), F.col("p_name"), F.lit(", "), F.col("p_type"))
    )


@query(f"""
    SELECT p_partkey, concat(CAST(p_size AS VARCHAR), CASE WHEN p_size % 3 = 0 THEN ' 1/2' ELSE '' END, ' cups') AS raw, 'cup' AS unit,
           CAST(CASE WHEN p_size % 3 = 0 THEN p_size * 2 + 1 ELSE p_size END AS BIGINT) AS num, CAST(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS den,
           p_name AS phrase, p_type AS modifier FROM ({SYNTH})
""")
def ingredient_line_parse(spark, sf_dir):
    """Lines of the form quantity, unit, name, comma, modifier, through the line parser."""
    from assayer.functions.lines import parse_lines

    return parse_lines(_synthetic(spark, sf_dir).select("p_partkey", "line"), "line").select(
        "p_partkey",
        F.col("quantity.raw").alias("raw"),
        F.col("quantity.unit").alias("unit"),
        F.col("quantity.lo_num").alias("num"),
        F.col("quantity.lo_den").alias("den"),
        "phrase",
        "modifier",
    )


@query("SELECT count(*) AS lines, count(*) AS round_trips, CAST(0 AS BIGINT) AS issues FROM part")
def round_trip_audit(spark, sf_dir):
    """Synthetic lines whose parsed quantity equals the quantity parsed on its own."""
    from assayer.functions.lines import parse_lines

    df = _synthetic(spark, sf_dir).withColumn("alone", F.substring_index("line", " cups ", 1))
    df = parse_lines(df.withColumn("alone", F.concat("alone", F.lit(" cups"))), "line")
    ok = round_trips(F.col("quantity"), parse_quantity(F.col("alone"))) & (F.col("phrase") == F.col("p_name"))
    return df.agg(F.count("*").alias("lines"), F.count_if(ok).alias("round_trips"), F.count_if(~ok).alias("issues"))


_SING = """CASE WHEN t IN ('cheeses','halves','knives','leaves','loaves') THEN map {'cheeses':'cheese','halves':'half','knives':'knife','leaves':'leaf','loaves':'loaf'}[t]
      WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 4 AND t LIKE '%oes' THEN t[:-3]
      WHEN length(t) > 4 AND (t LIKE '%ches' OR t LIKE '%shes' OR t LIKE '%xes' OR t LIKE '%zes') THEN t[:-3]
      WHEN length(t) > 3 AND t LIKE '%s' AND NOT (t LIKE '%ss' OR t LIKE '%us' OR t LIKE '%is') THEN t[:-2] ELSE t END"""


@query(f"""
    SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda t: {_SING}), ' ') AS key FROM part
""")
def key_normalize(spark, sf_dir):
    """Ingredient keys of part names and types."""
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.ingredient_key(F.concat_ws(" ", "p_name", "p_type")).alias("key")
    )


@query("""
    SELECT conv_id, turn, kind, CASE kind WHEN 0 THEN 'refusal_only' WHEN 1 THEN 'refusal_with_alternative' WHEN 2 THEN 'abstention' WHEN 3 THEN 'false_premise'
      ELSE CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'unrelated_or_error' ELSE 'paraphrase_or_summary' END END AS response_class
    FROM (SELECT conv_id, turn, text, (conv_id + turn) % 5 AS kind FROM conversations)
""")
def response_classify(spark, sf_dir):
    """Classes of turns with a sentence put in front that settles them."""
    from assayer.operators.responses import response_class

    df = read(spark, sf_dir, "conversations").withColumn("kind", (F.col("conv_id") + F.col("turn")) % 5)
    front = F.create_map(
        F.lit(0), F.lit("I can’t provide that recipe. "),
        F.lit(1), F.lit("I cannot share it, but here is a similar recipe. "),
        F.lit(2), F.lit("I do not know. "),
        F.lit(3), F.lit("The recipe does not exist. "),
    )
    said = F.concat(F.coalesce(F.try_element_at(front, F.col("kind").cast("int")), F.lit("")), F.coalesce("text", F.lit("")))
    return df.select("conv_id", "turn", "kind", response_class(said, F.lit(False)).alias("response_class"))


@query("""
    SELECT 'lineitem.l_orderkey' AS fk, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'lineitem.l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer.c_nationkey', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)
""")
def fk_violations(spark, sf_dir):
    """Orphans of each foreign key; the last against a part of the parent table, so that there are some."""
    t = lambda name: read(spark, sf_dir, name)
    keys = [
        ("lineitem.l_orderkey", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        ("lineitem.l_partkey", t("lineitem"), "l_partkey", t("part"), "p_partkey"),
        ("orders.o_custkey", t("orders"), "o_custkey", t("customer"), "c_custkey"),
        ("customer.c_nationkey", t("customer"), "c_nationkey", t("nation").filter("n_regionkey < 4"), "n_nationkey"),
    ]
    return checks.foreign_keys(keys)


@query("""
    SELECT o_orderkey, declared, actual FROM (
      SELECT o_orderkey, o_orderkey % 7 AS declared, count(l_orderkey) AS actual FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    WHERE declared <> actual
""")
def having_mismatch(spark, sf_dir):
    """Orders whose declared number of lines isn't the actual one."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("declared"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey")
    return checks.count_mismatches(orders, lines, "o_orderkey", "l_orderkey", "declared").withColumnRenamed("n", "actual")


@query("""
    SELECT min(n) AS least, max(n) AS most, count(*) AS parents, count(*) FILTER (n = 0) AS childless
    FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
""")
def minmax_group_count(spark, sf_dir):
    """Least and most lines of an order."""
    return checks.child_count_range(
        read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey"
    )


@query("""
    SELECT p_brand, count(DISTINCT (p_type, p_size)) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT (p_type, p_size)) > 1
""")
def func_dependency(spark, sf_dir):
    """Brands that don't determine type and size."""
    return checks.dependency_violations(read(spark, sf_dir, "part"), ["p_brand"], ["p_type", "p_size"])


@query("""
    SELECT tables, expected, actual, expected = actual AS agrees FROM (
      SELECT 'orders' AS tables, (SELECT count(DISTINCT o_orderkey) FROM orders) AS expected, (SELECT count(*) FROM orders) AS actual
      UNION ALL SELECT 'lineitem', (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem), (SELECT count(*) FROM lineitem)
      UNION ALL SELECT 'part', (SELECT count(DISTINCT p_partkey) FROM part), (SELECT count(*) FROM part))
""")
def reconcile_counts(spark, sf_dir):
    """Rows against distinct keys of each table."""
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"]}
    return checks.key_counts({name: (read(spark, sf_dir, name), key) for name, key in keys.items()})


@query("SELECT doc_id, sha256(text) AS text_sha256, strlen(text) + 32 AS token_estimate FROM documents")
def sha_check(spark, sf_dir):
    """SHA-256 of exact text and the byte-based token estimate."""
    from assayer.operators.planning import token_estimate

    return read(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), token_estimate(F.col("text")).cast("long").alias("token_estimate")
    )


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT), 0) AS BIGINT) AS searches FROM events
""")
def json_props(spark, sf_dir):
    """Numbers out of raw JSON, with zero for a path that isn't there."""
    get = lambda path: F.try_variant_get(F.try_parse_json("props"), path, "bigint")
    return read(spark, sf_dir, "events").select("event_id", get("$.k").alias("k"), F.coalesce(get("$.missing"), F.lit(0)).alias("searches"))


@query("""
    SELECT p_partkey AS recipe_id, 'size' AS dimension, CAST(p_size % 5 + 1 AS INTEGER) AS score, 'v1' AS rubric_version FROM part
    UNION ALL SELECT p_partkey, 'name', CAST(length(p_name) % 5 + 1 AS INTEGER), 'v1' FROM part
""")
def unpivot_ratings(spark, sf_dir):
    """Score columns to a row for each dimension."""
    size, name = (F.col("p_size") % 5 + 1).cast("string").alias("size"), (F.length("p_name") % 5 + 1).cast("string").alias("name")
    return recipes.ratings(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("recipe_id"), size, name), ["size", "name"], "v1")


@query("""
    SELECT p_partkey AS recipe_id, CAST(position AS INTEGER) AS position, word
    FROM (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) AS position FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part))
""")
def posexplode_arrays(spark, sf_dir):
    """Elements of JSON lists with their 1-based position."""
    cells = F.to_json(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("cells")
    return recipes.listed(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("recipe_id"), cells), "cells", "word")


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS cost FROM events
""")
def reported_costs(spark, sf_dir):
    """The cost in usage objects: as cost, as total_cost beside a truth value, or as the bare number."""
    k, i = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").cast("string"), F.col("event_id") % 3
    usage = F.when(i == 0, F.concat(F.lit('{"cost": '), k, F.lit("}"))).when(i == 1, F.concat(F.lit('{"cost": true, "total_cost": '), k, F.lit("}"))).otherwise(k)
    return read(spark, sf_dir, "events").select("event_id", ev.reported_cost(F.try_parse_json(usage)).cast("double").alias("cost"))


@query("""
    SELECT count(DISTINCT l_orderkey) AS recipes, count(*) AS ingredients, count(*) AS identity_matches, count(*) AS populated_quantities,
           count(*) FILTER (nth % 10 <> 0) AS quantity_matches,
           (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) < 10)) AS perfect_recipes
    FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS nth FROM lineitem)
""")
def reference_audit(spark, sf_dir):
    """The audit of orders as recipes; each tenth line's exact text has another quantity than its own field."""
    lines = reference_lines(spark, sf_dir)
    amount = lambda n: F.concat(n.cast("string"), F.lit(" cups"))
    name = F.concat(F.lit("spice "), F.translate(F.conv(F.col("position").cast("string"), 10, 2), "01", "ab"))
    said = amount(F.when(F.col("position") % 10 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    records = lines.select(
        F.col("recipe").alias("recipe_id"), "position", F.concat(said, F.lit(" "), name).alias("text_exact"), amount(F.col("amount")).alias("quantity_text_exact"),
        name.alias("ingredient_key"), name.alias("ingredient_text"), "tier", "optional", F.lit(False).alias("subrecipe_reference"), "section",
    )
    return audit.summary(audit.audited(records))
