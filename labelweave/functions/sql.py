"""Choosing labels from SQL.

    register(spark)
    SELECT * FROM top_labels(TABLE(scores), k => 3)
    SELECT * FROM top_labels(TABLE(SELECT * FROM scores JOIN weights USING (label_id)), k => 3, gain => 'a * eta + b')
    SELECT * FROM labels_from(TABLE(scores), threshold => '0.5')

The functions fit themselves to the table: only the columns that `instance`, `label` and `gain` name reach
Python, with their own types. A table may also be packed, a row for each instance and an array `cells` of structs, in
whose fields `label`, `gain` and `threshold` are then expressions as they are in columns; large tables should be:

    SELECT * FROM top_labels(TABLE(SELECT instance_id, collect_list(struct(label_id, eta)) AS cells FROM scores GROUP BY instance_id), k => 3)

There Spark chooses within the row, and only chosen labels reach Python. Of other tables top_labels takes the rows by
instance and in order of gain, and an instance's reading ends with its k-th label; labels_from filters rows first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import SkipRestOfInputTableException, udtf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


def _text(given: AnalyzeArgument | None, default: str) -> str:
    return default if given is None or given.value is None else str(given.value)


def _fields(table: AnalyzeArgument, instance: str, label: str) -> tuple[StructType, list[str] | None]:
    """The type of the result, and the fields of a packed table's cells."""
    if not table.isTable:
        raise ValueError("the first argument has to be a table")
    fields = {f.name.lower(): f for f in table.dataType.fields}
    cells, of_labels = None, fields
    if label.lower() not in fields and "cells" in fields and isinstance(fields["cells"].dataType, ArrayType) and isinstance(fields["cells"].dataType.elementType, StructType):
        cells = fields["cells"].dataType.elementType.fieldNames()
        of_labels = {f.name.lower(): f for f in fields["cells"].dataType.elementType.fields}
    for name, known in ((instance, fields), (label, of_labels)):
        if name.lower() not in known:
            raise ValueError(f"the table has no column {name}")
    return StructType([StructField("instance_id", fields[instance.lower()].dataType), StructField("label_id", of_labels[label.lower()].dataType), StructField("value", DoubleType())]), cells


def _each(cells: list[str], expression: str) -> str:
    """The expression for each cell, in which the cells' fields are names."""
    for name in cells:  # an array of one field's value, whose variable has the field's name
        expression = f"transform(array(`a cell`.`{name}`), `{name}` -> {expression})[0]"
    return f"transform(cells, `a cell` -> {expression})"


class TopLabels:
    """The k labels with the largest gain of each instance, ties to smaller labels; cells with a null gain don't count."""

    def __init__(self):
        self.found = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument, gain: AnalyzeArgument = None, instance: AnalyzeArgument = None, label: AnalyzeArgument = None) -> AnalyzeResult:
        if k.value is None or int(k.value) < 1:
            raise ValueError("k has to be 1 or more")
        instance, label, gain = _text(instance, "instance_id"), _text(label, "label_id"), f"CAST({_text(gain, 'eta')} AS DOUBLE)"
        schema, cells = _fields(table, instance, label)
        if cells:
            keyed = _each(cells, f"struct({gain} AS g, `{label}` AS label)")
            ordered = f"sort_array(transform(filter({keyed}, x -> x.g IS NOT NULL), x -> struct(NOT isnan(x.g) AS number, -x.g AS g, x.label AS label)))"
            return AnalyzeResult(schema=schema, select=[SelectedColumn(f"`{instance}`", "instance_id"), SelectedColumn(f"slice({ordered}, 1, {int(k.value)}).label", "labels")])
        return AnalyzeResult(
            schema=schema,
            select=[SelectedColumn(f"`{instance}`", "instance_id"), SelectedColumn(f"`{label}`", "label_id"), SelectedColumn(gain, "gain")],
            partitionBy=[PartitioningColumn(f"`{instance}`")],
            orderBy=[OrderingColumn(gain, ascending=False, overrideNullsFirst=False), OrderingColumn(f"`{label}`")],
        )

    def eval(self, row, k: int, gain: str | None = None, instance: str | None = None, label: str | None = None) -> Iterator[tuple]:
        if "labels" in row:
            for chosen in row["labels"] or ():
                yield row["instance_id"], chosen, 1.0
            return
        if row["gain"] is not None:
            self.found += 1
            yield row["instance_id"], row["label_id"], 1.0
        if row["gain"] is None or self.found >= k:
            raise SkipRestOfInputTableException("no more labels")


class LabelsFrom:
    """The labels of each instance whose gain is at least a threshold, which is an expression of the table's columns too."""

    @staticmethod
    def analyze(table: AnalyzeArgument, threshold: AnalyzeArgument, gain: AnalyzeArgument = None, instance: AnalyzeArgument = None, label: AnalyzeArgument = None) -> AnalyzeResult:
        instance, label = _text(instance, "instance_id"), _text(label, "label_id")
        passes = f"({_text(gain, 'eta')}) >= ({_text(threshold, '0.5')})"
        schema, cells = _fields(table, instance, label)
        if cells:
            found = f"transform(filter({_each(cells, f'struct({passes} AS passes, `{label}` AS label)')}, x -> x.passes), x -> x.label)"
            found = f"IF(size({found}) > 0, array(struct(`{instance}` AS instance_id, {found} AS labels)), array())"
        else:
            found = f"IF({passes}, array(struct(`{instance}` AS instance_id, array(`{label}`) AS labels)), array())"
        return AnalyzeResult(schema=schema, select=[SelectedColumn(f"explode({found})", "found")])

    def eval(self, row, threshold: str, gain: str | None = None, instance: str | None = None, label: str | None = None) -> Iterator[tuple]:
        own = row["found"]
        for chosen in own["labels"]:
            yield own["instance_id"], chosen, 1.0


def register(spark: SparkSession) -> None:
    """Make top_labels and labels_from known to the session's SQL."""
    spark.udtf.register("top_labels", udtf(TopLabels))
    spark.udtf.register("labels_from", udtf(LabelsFrom))
