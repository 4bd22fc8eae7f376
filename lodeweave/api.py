"""The engine's calls over the tables of a catalog: listings, search, traversal, impact, and edges of single statements.

``tables`` has the frames namespace, dataset, field and edges as attributes (``sources.catalog_views.Frames``, or any object with
frames of those columns). Every call returns a DataFrame and starts no job but those that a traversal's levels need. An unknown id
or name gives no rows; a search text of under two characters raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import as_boolean, database_of, match_score
from lodeweave.operators import extract, graph, serve, traverse


class Catalog:
    def __init__(self, tables):
        self.tables = tables

    def namespaces(self) -> DataFrame:
        return serve.namespaces(self.tables.namespace)

    def namespace(self, namespace_id: str) -> DataFrame:
        return serve.namespaces(self.tables.namespace.filter(F.col("namespace_id") == namespace_id))

    def datasets(self, namespace_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return serve.dataset_page(self.tables.dataset.filter(F.col("namespace_id") == namespace_id), limit, offset)

    def dataset(self, wanted: str) -> DataFrame:
        """The fields of a dataset, by its id or name, in order of their position, then name."""
        one = serve.resolve(self.tables.dataset, wanted).select("dataset_id", "name")
        fields = self.tables.field.join(one, "dataset_id")
        return fields.select("dataset_id", "name", "field_name", "field_type", "ordinal_position", as_boolean(F.col("nullable"), True).alias("nullable")).orderBy("dataset_id", "ordinal_position", "field_name")

    def statistics(self, wanted: str, stats: DataFrame) -> DataFrame:
        """``stats``: dataset_id, row_count and perm, as recorded by the warehouse."""
        return serve.statistics(serve.resolve(self.tables.dataset, wanted), stats, "dataset_id")

    def ddl(self, wanted: str) -> DataFrame:
        one = serve.resolve(self.tables.dataset, wanted)
        return serve.ddl(one, self.tables.field.join(one.select("dataset_id"), "dataset_id", "left_semi"))


class Search:
    def __init__(self, tables):
        self.tables = tables

    def datasets(self, text: str, limit: int = 50) -> DataFrame:
        return serve.search(self.tables.dataset, text).orderBy("name", "dataset_id").limit(limit)

    def unified(self, text: str, limit: int = 50) -> DataFrame:
        """kind (database or dataset), name and matches: the first ``limit`` datasets, and the databases of all matches."""
        found = serve.search(self.tables.dataset, text)
        db = found.groupBy(database_of(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("matches"))
        first = found.orderBy("name", "dataset_id").limit(limit)
        return db.select(F.lit("database").alias("kind"), "name", "matches").unionByName(first.select(F.lit("dataset").alias("kind"), "name", F.lit(1).cast("long").alias("matches")))

    def assets(self, text: str, types: tuple[str, ...] = ("database", "table", "column"), limit: int = 50) -> DataFrame:
        """asset_type, asset_id, label and score of the best matches, ties by type and id."""
        text = serve.checked_query(text)
        found = serve.assets(self.tables.dataset, self.tables.field).filter(F.col("asset_type").isin(*types))
        return found.withColumn("score", match_score(F.col("label"), text)).filter("score > 0").orderBy(F.desc("score"), "asset_type", "asset_id").limit(limit)


class Provenance:
    """Traversals of the active edges. Directions are upstream, downstream and both."""

    def __init__(self, tables):
        self.tables = tables

    def field(self, dataset: str, field: str, direction: str = "both", max_depth: int = 5) -> DataFrame:
        return traverse.field_provenance(self.tables.edges, dataset, field, direction, max_depth, getattr(self.tables, "edges_by_target", None) if direction != "downstream" else None)

    def _edges(self, way: str) -> DataFrame:
        """Active edges, in buckets of the end that steps of the direction start from, where the tables have them."""
        return traverse.active(self.tables.edges_by_target if way == "upstream" and hasattr(type(self.tables), "edges_by_target") else self.tables.edges)

    def table(self, dataset: str, direction: str = "both", max_depth: int = 3) -> DataFrame:
        """All fields of a table in one traversal for each direction."""
        out = None
        for way in ("upstream", "downstream") if direction == "both" else (direction,):
            e = self._edges(way)
            end, node = ("source_dataset", "src") if way == "downstream" else ("target_dataset", "tgt")
            roots = e.filter(F.col(end) == dataset).select(F.col(node).alias("root")).distinct()
            found = traverse.edges_of(traverse.walk(e, roots, direction=way, max_depth=max_depth)).withColumn("direction", F.lit(way))
            out = found if out is None else out.unionByName(found)
        return out

    def database(self, database: str, direction: str = "both", max_depth: int = 1) -> DataFrame:
        """Edges around a database: those that touch it, and those within ``max_depth`` of them."""
        return graph.expand_database(traverse.active(self.tables.edges), database, direction=direction, max_depth=max_depth)

    def upstream(self, node: str, max_depth: int = 10) -> DataFrame:
        return self._reach(node, "upstream", max_depth)

    def downstream(self, node: str, max_depth: int = 10) -> DataFrame:
        return self._reach(node, "downstream", max_depth)

    def impact(self, node: str, max_depth: int = 10) -> DataFrame:
        e = traverse.active(self.tables.edges)
        return graph.impact(e, self._root(e, node), max_depth)

    def _root(self, e: DataFrame, node: str) -> DataFrame:
        return e.sparkSession.createDataFrame([(node,)], "root string")

    def _reach(self, node: str, way: str, max_depth: int) -> DataFrame:
        e = self._edges(way)
        return traverse.reach(e, self._root(e, node), direction=way, max_depth=max_depth)


def statement_edges(spark: SparkSession, text: str, default_database: str) -> DataFrame:
    """Column edges of one statement, as ``extract_edges`` has them for a log; none if it has none."""
    log = spark.createDataFrame([(0, text, default_database)], "query_id long, sql_text string, default_database string").withColumn("start_time", F.lit(None).cast("timestamp"))
    return extract.first_of_each(extract.edge_rows(extract.extract(log))).drop("query_id", "start_time")
