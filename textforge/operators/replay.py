"""Rows as flat columns and back: structs become dotted columns, maps and arrays text, so that a table can be kept as CSV and filtered again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructField, StructType

#: The column that tells whether a struct is there: it ends in this mark.
THERE = "?"


def _quoted(path: tuple[str, ...]) -> Column:
    out = F.col(f"`{path[0]}`")
    for name in path[1:]:
        out = out.getField(name)
    return out


def _name(path: tuple[str, ...]) -> str:
    """Parts joined by dots; a dot or backslash in a part is escaped, so that no two paths have one name."""
    return ".".join(p.replace("\\", "\\\\").replace(".", "\\.") for p in path)


def _leaves(kind: DataType, path: tuple[str, ...]) -> Iterator[tuple[str, Column, DataType]]:
    """(name, value, type) of the flat columns of a value, whatever its depth."""
    if isinstance(kind, StructType):
        if path:
            yield _name((*path, THERE)), _quoted(path).isNotNull(), BooleanType()
        for f in kind:
            yield from _leaves(f.dataType, (*path, f.name))
    elif isinstance(kind, MapType | ArrayType):
        yield _name(path), F.to_json(_quoted(path), {"ignoreNullFields": "false"}), StringType()
    else:
        yield _name(path), _quoted(path), kind


def flattened(df: DataFrame) -> DataFrame:
    """One column for each leaf: a struct's fields by dotted names, with a column that tells whether the struct is null; maps and arrays as JSON.

    Nulls stay null at any depth. restored() undoes it, given the schema.
    """
    return df.select(*[c.alias(n) for n, c, _ in _leaves(df.schema, ())])


def flat_schema(schema: StructType) -> StructType:
    """The schema of flattened(), as a reader of plain text needs it."""
    return StructType([StructField(n, t) for n, _, t in _leaves(schema, ())])


#: A text form that loses nothing: nulls differ from empty texts, blanks, quotes and line ends stay.
CSV = {
    "header": True, "multiLine": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def write_flat(df: DataFrame, path: str) -> None:
    """df as CSV files of flat columns."""
    flattened(df).write.options(**CSV, emptyValue='""').csv(path)


def read_flat(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that write_flat() was given."""
    return restored(spark.read.schema(flat_schema(schema)).options(**CSV, emptyValue="").csv(path), schema)


def _rebuilt(kind: DataType, path: tuple[str, ...]) -> Column:
    here = F.col(f"`{_name(path)}`")
    if isinstance(kind, StructType):
        inner = F.struct(*[_rebuilt(f.dataType, (*path, f.name)).alias(f.name) for f in kind])
        return F.when(F.col(f"`{_name((*path, THERE))}`"), inner)
    if isinstance(kind, MapType | ArrayType):
        return F.from_json(here, kind)
    return here.cast(kind)


def restored(df: DataFrame, schema: StructType) -> DataFrame:
    """The rows that flattened() was given."""
    return df.select(*[_rebuilt(f.dataType, (f.name,)).alias(f.name) for f in schema])
