"""Canonical JSON text of payloads of any shape: what a row hash or a signature is taken of."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _plain(value: object, kind: T.DataType) -> object:
    """The value with maps as objects; what JSON has no form for is left to ``str``."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.MapType):
        return {k: _plain(v, kind.valueType) for k, v in value}
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    return value


def canonical_text(value: object) -> str:
    """Sorted keys, ``", "`` and ``": "``, ASCII only, shortest form of a float, ``str`` of times and decimals."""
    return json.dumps(value, sort_keys=True, default=str)


def with_canonical_payload(df: DataFrame, column: str, name: str = "payload") -> DataFrame:
    """Add the canonical text of a struct, map or array column, or of a column of JSON texts.

    JSON texts may have any nesting, whole numbers of any size, and repeated keys (the last counts). A null value
    is ``{}``; a text that is not JSON is null. Payloads of a few fixed members are quicker by ``json_object``, which
    gives the same text.
    """
    kind = df.schema[column].dataType
    own = df.columns.index(column)

    def text(value: object) -> str | None:
        if value is None:
            return "{}"
        if not isinstance(kind, T.StringType):
            return canonical_text(_plain(value, kind))
        try:
            return canonical_text(json.loads(value))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([text(v) for v in batch.column(own).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


__all__ = ["canonical_text", "with_canonical_payload"]
