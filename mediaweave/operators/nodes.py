"""Pages to DOM nodes.

``nodes`` is the one place in the batch path that needs Python: a page is
scanned once, in Arrow batches, into one row per element.  Each row carries the
little of its surroundings that later operators ask for (class and style of the
parent, attributes of the enclosing link, video and form), so they stay
row-local and never shuffle the node table to find an ancestor.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaweave import constants as K
from mediaweave.functions.urls import any_of
from mediaweave.operators import scanner
from mediaweave.session import settled

# Executors need no copy of this package: the scanner travels with the task.
cloudpickle.register_pickle_by_value(scanner)

_ATTRS = T.MapType(T.StringType(), T.StringType())
NODE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("page_url", T.StringType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", _ATTRS),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("own_text", T.StringType()),
        T.StructField("anchor_id", T.IntegerType()),
        T.StructField("picture_id", T.IntegerType()),
        T.StructField("form_id", T.IntegerType()),
        T.StructField("video_id", T.IntegerType()),
        T.StructField("first_of_kind", T.BooleanType()),
        T.StructField("parent_attrs", _ATTRS),
        T.StructField("anchor_attrs", _ATTRS),
        T.StructField("anchor_parent_attrs", _ATTRS),
        T.StructField("video_attrs", _ATTRS),
        T.StructField("form_attrs", _ATTRS),
    ]
)


def _arrow_schema() -> pa.Schema:
    text_map = pa.map_(pa.string(), pa.string())
    kinds = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.StringType(): pa.string(),
        T.BooleanType(): pa.bool_(),
        _ATTRS: text_map,
        T.ArrayType(T.StringType()): pa.list_(pa.string()),
    }
    return pa.schema([(f.name, kinds[f.dataType]) for f in NODE_SCHEMA])


def nodes(pages: DataFrame, marked_only: bool = False) -> DataFrame:
    """One row per element of every page; pages without a body yield none.

    ``marked_only`` leaves out elements without attributes that are not scripts.
    No media or link operator looks at those, and they are most of a page.
    """
    schema = _arrow_schema()
    return pages.select("page_id", "url", "html").mapInArrow(
        lambda batches: scanner.scan_batches(batches, schema, marked_only), NODE_SCHEMA
    )


# --- row tests --------------------------------------------------------------

_HIDDEN_CLASS = r"(?:^|\s)" + any_of(K.HIDDEN_CLASSES) + r"(?:\s|$)"
_HIDDEN_STYLE = any_of(K.HIDDEN_STYLES)


def _hides(attrs: Column) -> Column:
    by_class = F.coalesce(attrs["class"].rlike(_HIDDEN_CLASS), F.lit(False))
    by_style = F.coalesce(F.lower(attrs["style"]).rlike(_HIDDEN_STYLE), F.lit(False))
    return by_class | by_style


def is_visible(attrs: Column | None = None, parent: Column | None = None) -> Column:
    """Not hidden by its own attributes or by the class or style of itself or its parent."""
    attrs = F.col("attrs") if attrs is None else attrs
    parent = F.col("parent_attrs") if parent is None else parent
    flagged = attrs["hidden"].isNotNull() | F.coalesce(attrs["aria-hidden"] == "true", F.lit(False))
    return ~(flagged | _hides(attrs) | _hides(parent))


def visible(node_table: DataFrame) -> DataFrame:
    return node_table.withColumn("visible", is_visible())


def with_relative(node_table: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Left join each node to the node its ``key`` points at (parent, anchor, form, ...).

    General form for attributes the node rows do not carry themselves.  Rows
    without the key skip the shuffle's hot NULL group by being unioned back.
    """
    node_table = settled(node_table)
    linked = node_table.filter(F.col(key).isNotNull())
    alone = node_table.filter(F.col(key).isNull())
    other = node_table.select(
        F.col("page_id"), F.col("node_id").alias(key), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    fields = {f.name: f.dataType for f in node_table.schema}
    for source, name in columns.items():
        alone = alone.withColumn(name, F.lit(None).cast(fields[source]))
    joined = linked.join(other, ["page_id", key], "left")
    return joined.select(*alone.columns).unionByName(alone)
