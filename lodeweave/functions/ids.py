"""Identifiers of the provenance catalog as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def namespace_id(uri: Column) -> Column:
    return F.substring(F.md5(uri), 1, 16)


def provenance_id(source: Column, target: Column, size: int = 24) -> Column:
    """Of the paths database.table.column of both ends; the legacy form has 16 characters."""
    return F.substring(F.md5(F.concat(source, F.lit("->"), target)), 1, size)


def dataset_id(namespace: Column, name: Column) -> Column:
    return F.concat(namespace, F.lit("/"), name)


def field_id(dataset: Column, field: Column) -> Column:
    return F.concat(dataset, F.lit("/"), field)


def node_id(dataset: Column, field: Column) -> Column:
    return F.concat(dataset, F.lit("."), field)


def edge_id(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit("->"), target)
