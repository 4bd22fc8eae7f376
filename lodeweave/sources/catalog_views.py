"""The provenance catalog over the sample star schema: namespaces, datasets, fields, column edges and a query log.

``frames`` builds each table with DataFrame operations. ``SQL`` holds the same definitions as common table
expressions for the checks.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import ids
from lodeweave.functions.scalars import SCALED, SIZED, TYPE_NAMES, type_name
from lodeweave.sources.scratch import shared_folder
from lodeweave.sources.statement_shapes import SHAPES

#: Order in which sample fields take type codes; then an unknown code and null.
CODES = [*TYPE_NAMES, "D", *SCALED, *SIZED, "ZZ", None]
#: Line items to a bucket of edges, at most: one task sorts a bucket in its memory, whatever the size of the input.
BUCKET_ROWS = 1_500_000


class Frames:
    """Tables of one folder; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def namespace(self) -> DataFrame:
        r = self.table("region")
        uri = F.concat(F.lit("warehouse://"), F.lower("r_name"), F.lit(":1025"))
        return r.select(
            ids.namespace_id(uri).alias("namespace_id"), uri.alias("namespace_uri"), F.lit(None).cast("string").alias("description"),
            F.when(F.col("r_regionkey") > 0, "2-0-2").alias("spec_version"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("r_regionkey"))).alias("created_at"),
            F.col("r_regionkey").alias("regionkey"),
        )

    @property
    def dataset(self) -> DataFrame:
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        s = s.join(self.namespace.select("namespace_id", "regionkey"), F.col("n_regionkey") == F.col("regionkey"))
        name = F.concat("n_name", F.lit(".T"), F.col("s_suppkey").cast("string"))
        return s.select(
            ids.dataset_id(F.col("namespace_id"), name).alias("dataset_id"), "namespace_id", name.alias("name"),
            F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("Supplier feed "), "s_name")).alias("description"),
            F.when(F.col("s_suppkey") % 7 == 0, "VIEW").otherwise("TABLE").alias("source_type"), F.lit("Y").alias("is_active"), F.col("s_suppkey").alias("suppkey"),
        )

    @property
    def columns(self) -> DataFrame:
        return self._columns(self.table("lineitem").select("l_suppkey", "l_partkey"))

    @property
    def column_names(self) -> DataFrame:
        """Distinct names of all columns: far fewer than columns, and read without them."""
        used = self.table("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
        return self.table("part").select("p_partkey").join(used, "p_partkey", "left_semi").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("column_name"))

    def _columns(self, items: DataFrame) -> DataFrame:
        """Dictionary rows: one for each distinct supplier and part of the line items, which are moved to their parts and to their suppliers,
        in as many parts as their number asks for."""
        pairs = items.repartition(self.parts, "l_partkey").distinct()
        p = self.table("part").select("p_partkey", "p_size")
        codes = F.array(*[F.lit(c) for c in CODES])
        place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))
        return pairs.join(p, F.col("l_partkey") == F.col("p_partkey")).repartition(self.parts, "l_suppkey").select(
            F.col("l_suppkey").alias("suppkey"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("column_name"), F.get(codes, F.col("p_size") % len(CODES)).alias("column_type"),
            (10 + F.col("p_partkey") % 90).cast("int").alias("column_length"), (10 + F.col("p_size") % 8).cast("int").alias("digits"), (F.col("p_size") % 4).cast("int").alias("fraction"),
            place.alias("column_id"), F.when(F.col("p_partkey") % 3 == 0, "Y").when(F.col("p_partkey") % 3 == 1, "N").alias("nullable"),
        )

    @property
    def field(self) -> DataFrame:
        return self._fields(self.columns, self.dataset)

    def fields_of(self, datasets: DataFrame) -> DataFrame:
        """The fields of some datasets (suppkey, dataset_id): line items of others go before anything is sorted."""
        own = F.col("l_suppkey") == F.col("suppkey")
        items = self.table("lineitem").select("l_suppkey", "l_partkey").join(datasets.select("suppkey"), own, "left_semi")
        return self._fields(self._columns(items), datasets)

    def _fields(self, columns: DataFrame, datasets: DataFrame) -> DataFrame:
        c = columns.join(datasets.select("suppkey", "dataset_id"), "suppkey")
        return c.select(
            ids.field_id(F.col("dataset_id"), F.col("column_name")).alias("field_id"), "dataset_id", F.col("column_name").alias("field_name"),
            type_name(F.col("column_type"), F.col("column_length"), F.col("digits"), F.col("fraction")).alias("field_type"), F.col("column_id").alias("ordinal_position"), "nullable",
        )

    @property
    def edges(self) -> DataFrame:
        """Column provenance: consecutive line items of an order. A table in buckets of the source, sorted in each, so what joins or counts
        edges by their source leaves them where they are."""
        return self._bucketed("src")

    @property
    def edges_by_target(self) -> DataFrame:
        """The same edges in buckets of the target, for steps upstream."""
        return self._bucketed("tgt")

    def toward(self, direction: str) -> DataFrame:
        return self.edges if direction == "downstream" else self.edges_by_target

    @property
    def parts(self) -> int:
        """Parts of edges or fields, of which a task sorts one: their number grows with the line items, and a part does not."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table("lineitem").count() // BUCKET_ROWS))

    def _bucketed(self, key: str) -> DataFrame:
        """The table, which the first query of the session over this folder writes into the shared folder. What both ends tell, the names
        of their tables and columns and the edge's id, is not stored but read off them."""
        name = f"edges_{key}_{hashlib.md5(self.dir.encode()).hexdigest()[:12]}"
        if not self.spark.catalog.tableExists(name):
            path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
            buckets = self.parts
            if key == "src":
                rows = self._edges(buckets)
            else:
                self._bucketed("src")
                rows = self.spark.table(name.replace("_tgt_", "_src_")).repartition(buckets, key)
            rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        return self._whole(self.spark.table(name))

    def release(self) -> None:
        """Delete the bucketed tables of this folder; a later query writes them anew."""
        for key in ("src", "tgt"):
            name = f"edges_{key}_{hashlib.md5(self.dir.encode()).hexdigest()[:12]}"
            if self.spark.catalog.tableExists(name):
                path = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first()["data_type"]
                self.spark.sql(f"DROP TABLE {name}")
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _edges(self, buckets: int) -> DataFrame:
        """src, tgt and what edges store, in ``buckets`` parts by src. Values of few words are numbers in their order until they are least."""
        w = Window.partitionBy("l_orderkey").orderBy(*[F.asc_nulls_last(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
        kind = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
        active = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7), 0).otherwise(1)
        cols = ["l_suppkey", "l_partkey"]
        li = self.table("lineitem").select("l_orderkey", "l_linenumber", *cols, kind.alias("kind"), active.alias("active"), F.round(1 - F.col("l_discount"), 2).cast("decimal(3,2)").alias("confidence_score"))
        li = li.repartition(buckets, "l_orderkey").withColumns({f"next_{c}": F.lead(c).over(w) for c in cols}).filter("next_l_suppkey is not null")
        # The tables' names: few nations, and suppliers by the size of two of their columns.
        nation = self.table("nation").join(self.namespace.select("regionkey"), F.col("n_regionkey") == F.col("regionkey")).select("n_nationkey", "n_name")
        out = li.drop("l_orderkey", "l_linenumber")
        for end, of, before in (("source", "l_", ""), ("target", "next_l_", "next_")):
            own = self.table("supplier").select(F.col("s_suppkey").alias(f"{of}suppkey"), F.col("s_nationkey").alias("n_nationkey"))
            out = out.join(own, f"{of}suppkey").join(F.broadcast(nation), "n_nationkey").drop("n_nationkey")
            out = out.withColumn(f"{end}_dataset", F.concat("n_name", F.lit(".T"), F.col(f"{of}suppkey").cast("string"))).withColumn(f"{end}_field", F.concat(F.lit("P"), F.col(f"{before}l_partkey").cast("string"))).drop("n_name")
        ends = {"src": ids.node_id(F.col("source_dataset"), F.col("source_field")), "tgt": ids.node_id(F.col("target_dataset"), F.col("target_field"))}
        odd = [F.when(ends[node].isNull(), F.col(f"{end}_{c}")).alias(f"{end}_{c}") for node, end in (("src", "source"), ("tgt", "target")) for c in ("dataset", "field")]
        out = out.select(*[c.alias(k) for k, c in ends.items()], *odd, "kind", "active", "confidence_score").repartition(buckets, "src")
        least = out.groupBy("src", "tgt", "source_dataset", "source_field", "target_dataset", "target_field").agg(F.min("kind").alias("kind"), F.min("confidence_score").alias("confidence_score"), F.min("active").alias("active"))
        word = lambda words, k: F.get(F.array(*[F.lit(x) for x in words]), F.col(k))
        return least.select(
            "src", "tgt", "source_dataset", "source_field", "target_dataset", "target_field", word(("AGGREGATION", "CALCULATION", "DIRECT"), "kind").alias("transformation_type"), "confidence_score", word("NY", "active").alias("is_active"),
        )

    @staticmethod
    def _whole(stored: DataFrame) -> DataFrame:
        """Stored edges with all their columns. A column's name has no point; names are stored where an end is null."""
        field = lambda node: F.substring_index(node, ".", -1)
        dataset = lambda node: F.substring(node, F.lit(1), F.length(node) - F.length(field(node)) - 1)
        of = lambda c, node, part: F.coalesce(F.col(c), part(F.col(node))).alias(c)
        return stored.select(
            ids.provenance_id(F.col("src"), F.col("tgt")).alias("provenance_id"), of("source_dataset", "src", dataset), of("source_field", "src", field), of("target_dataset", "tgt", dataset), of("target_field", "tgt", field),
            "transformation_type", "confidence_score", "is_active", "src", "tgt",
        )

    @property
    def log(self) -> DataFrame:
        return log_of(self.table("events"))


def log_of(e: DataFrame) -> DataFrame:
    """Logged statements of the events, a batch or a stream: header (query_id, proc_id, statement_type, start_time, ...) and text in one row.
    Errors stand for statements with nested queries, of one shape after the other, and for plain queries."""
    shape = F.when(F.col("event_type") == "error", F.col("event_id") % (len(SHAPES) + 1)).cast("int")
    shaped = lambda k: F.get(F.array(*[F.lit(x[k]) for x in SHAPES]), shape)
    kind = F.when(F.col("event_type") == "click", "Insert").when(F.col("event_type") == "view", "Create View").when(F.col("event_type") == "purchase", "Merge Into").when(F.col("event_type") == "signup", "Update").otherwise(F.coalesce(shaped(0), F.lit("Select")))
    u = F.concat(F.lit(""), (F.col("user_id") % 50).cast("string"))
    sql = (
        F.when(F.col("event_id") % 97 == 0, F.lit(None))
        .when(F.col("event_type") == "click", F.concat(F.lit("INSERT INTO stg.t"), u, F.lit(" (id, full_name, total)  SELECT s.id, s.first || ' ' || s.last AS full_name, SUM(o.amount) FROM src.c"), u, F.lit(" s JOIN src.o"), u, F.lit(" o ON s.id = o.id GROUP BY s.id;")))
        .when(F.col("event_type") == "view", F.concat(F.lit("CREATE VIEW rpt.v"), u, F.lit(" AS SELECT a.k AS k, a.v AS v FROM dim.d"), u, F.lit(" a")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("MERGE INTO dim.m"), u, F.lit(" USING stg.t"), u, F.lit(" s ON s.id = m.id WHEN MATCHED THEN UPDATE SET total = s.total")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("UPDATE dim.m"), u, F.lit(" FROM stg.t"), u, F.lit(" s SET name = s.full_name")))
        .otherwise(F.coalesce(F.replace(shaped(1), F.lit("{u}"), u), F.lit("SELECT 1")))
    )
    return e.select(
        F.col("event_id").alias("query_id"), F.lit(1).alias("proc_id"), kind.alias("statement_type"), F.col("ts").alias("start_time"), F.lit("stg").alias("default_database"),
        F.when(F.col("event_id") % 10 == 0, 3807).otherwise(0).alias("error_code"), F.when(F.col("event_id") % 13 == 0, 2).otherwise(1).alias("sql_row_no"), sql.alias("sql_text"),
    )


_CODES_SQL = ", ".join("NULL" if c is None else f"'{c}'" for c in CODES)
_SHAPES_SQL = ", ".join(f"({k}, '{x[0]}')" for k, x in enumerate(SHAPES))
_NAMES_SQL = ", ".join(f"('{k}', '{v}')" for k, v in TYPE_NAMES.items())
SQL = f"""
ol_namespace AS (
  SELECT substr(md5('warehouse://' || lower(r_name) || ':1025'), 1, 16) AS namespace_id, 'warehouse://' || lower(r_name) || ':1025' AS namespace_uri, CAST(NULL AS VARCHAR) AS description,
         CASE WHEN r_regionkey > 0 THEN '2-0-2' END AS spec_version, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(r_regionkey AS INTEGER)) AS created_at, r_regionkey AS regionkey FROM region),
ol_dataset AS (
  SELECT namespace_id || '/' || n_name || '.T' || s_suppkey AS dataset_id, namespace_id, n_name || '.T' || s_suppkey AS name, CASE WHEN s_suppkey % 5 <> 0 THEN 'Supplier feed ' || s_name END AS description,
         CASE WHEN s_suppkey % 7 = 0 THEN 'VIEW' ELSE 'TABLE' END AS source_type, 'Y' AS is_active, s_suppkey AS suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN ol_namespace ON n_regionkey = regionkey),
dict_column AS (
  SELECT l_suppkey AS suppkey, 'P' || p_partkey AS column_name, [{_CODES_SQL}][1 + p_size % {len(CODES)}] AS column_type, CAST(10 + p_partkey % 90 AS INTEGER) AS column_length,
         CAST(10 + p_size % 8 AS INTEGER) AS digits, CAST(p_size % 4 AS INTEGER) AS fraction, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS column_id,
         CASE p_partkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS nullable
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey),
type_names(code, label) AS (VALUES {_NAMES_SQL}),
ol_dataset_field AS (
  SELECT dataset_id || '/' || column_name AS field_id, dataset_id, column_name AS field_name,
         CASE WHEN column_type IS NULL THEN 'UNKNOWN' WHEN column_type = 'D' THEN 'DECIMAL(' || digits || ',' || fraction || ')' WHEN column_type = 'TS' THEN 'TIMESTAMP(' || fraction || ')'
              WHEN column_type = 'AT' THEN 'TIME(' || fraction || ')' WHEN column_type = 'CF' THEN 'CHAR(' || column_length || ')' WHEN column_type = 'BF' THEN 'BYTE(' || column_length || ')'
              WHEN column_type = 'CV' THEN 'VARCHAR(' || column_length || ')' WHEN column_type = 'BV' THEN 'VARBYTE(' || column_length || ')' ELSE coalesce(label, column_type) END AS field_type,
         CAST(column_id AS INTEGER) AS ordinal_position, nullable
  FROM dict_column JOIN ol_dataset USING (suppkey) LEFT JOIN type_names ON code = column_type),
line_pairs AS (
  SELECT l_suppkey AS s1, l_partkey AS p1, lead(l_suppkey) OVER w AS s2, lead(l_partkey) OVER w AS p2,
         CASE l_returnflag WHEN 'A' THEN 'DIRECT' WHEN 'N' THEN 'CALCULATION' ELSE 'AGGREGATION' END AS kind, CAST(round(1 - l_discount, 2) AS DECIMAL(3, 2)) AS conf,
         CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 'N' ELSE 'Y' END AS active
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
ol_column_provenance AS (
  SELECT substr(md5(s.name || '.P' || p1 || '->' || t.name || '.P' || p2), 1, 24) AS provenance_id, s.name AS source_dataset, 'P' || p1 AS source_field, t.name AS target_dataset, 'P' || p2 AS target_field,
         min(kind) AS transformation_type, min(conf) AS confidence_score, min(active) AS is_active, s.name || '.P' || p1 AS src, t.name || '.P' || p2 AS tgt
  FROM line_pairs JOIN ol_dataset s ON s.suppkey = s1 JOIN ol_dataset t ON t.suppkey = s2 WHERE s2 IS NOT NULL GROUP BY s.name, p1, t.name, p2),
query_log AS (
  SELECT event_id AS query_id, 1 AS proc_id, CASE event_type WHEN 'click' THEN 'Insert' WHEN 'view' THEN 'Create View' WHEN 'purchase' THEN 'Merge Into' WHEN 'signup' THEN 'Update' ELSE coalesce(shape_type, 'Select') END AS statement_type,
         ts AS start_time, 'stg' AS default_database, CASE WHEN event_id % 10 = 0 THEN 3807 ELSE 0 END AS error_code, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS sql_row_no, event_type, user_id % 50 AS u,
         event_id % 97 = 0 AS no_text, shape
  FROM events LEFT JOIN (VALUES {_SHAPES_SQL}) AS shapes(shape, shape_type) ON event_type = 'error' AND event_id % {len(SHAPES) + 1} = shape)
"""
