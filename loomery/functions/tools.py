"""Schemas of tools from the hints of Python functions, and their use as columns."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable

from pyspark.sql import types as T

_JSON = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array"}
_SPARK = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}


def _hints(function: Callable) -> dict[str, tuple[object, bool]]:
    hints = typing.get_type_hints(function)
    return {n: (hints.get(n, str), p.default is inspect.Parameter.empty) for n, p in inspect.signature(function).parameters.items()}


def json_schema(function: Callable) -> dict:
    """The JSON schema of a function's parameters; what has no hint, or an unknown one, is a string."""

    def one(hint: object) -> dict:
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if origin is list:
            return {"type": "array", "items": one(args[0] if args else str)}
        return {"type": _JSON.get(origin or hint, "string")}

    hints = _hints(function)
    return {"type": "object", "properties": {n: one(h) for n, (h, _) in hints.items()}, "required": [n for n, (_, needed) in hints.items() if needed]}


def struct_type(function: Callable) -> T.StructType:
    """The same as a Spark type, to read the JSON arguments of calls with."""

    def one(hint: object) -> T.DataType:
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if origin is list or hint is list:
            return T.ArrayType(one(args[0]) if args else T.StringType())
        if origin is dict or hint is dict:
            return T.MapType(T.StringType(), T.StringType())
        return _SPARK.get(hint, T.StringType())

    return T.StructType([T.StructField(n, one(h), not needed) for n, (h, needed) in _hints(function).items()])
