"""JSON: typed columns by plan-time recursion over the schema, free JSON text by a walker in Arrow batches."""

from __future__ import annotations

import json
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import model
from ..functions.model import Policy
from ..functions.rules import Detection
from .detect import candidates, exclude, let, resolve
from .mask import ENTRY, substitute


def mask_typed(df: DataFrame, column: str, d: Detection = Detection(), p: Policy = Policy(), max_depth: int = 32) -> DataFrame:
    """Every string leaf of a nested column masked with leaf scope, in place; names, numbers and map keys stay."""

    def walk(c: Column, t: T.DataType, depth: int) -> Column:
        if depth > max_depth:
            raise ValueError(f"schema deeper than max_depth={max_depth}")
        if isinstance(t, T.StringType):
            return F.when(c.isNotNull(), let(let(candidates(c, d), lambda x: exclude(resolve(x, c, d), d)), lambda s: F.when(F.size(s) > 0, substitute(c, s, p)["masked_text"]).otherwise(c)))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, depth + 1).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType, depth + 1))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: walk(v, t.valueType, depth + 1))
        return c

    return df.withColumn(column, walk(F.col(column), df.schema[column].dataType, 0))


def mask_free(df: DataFrame, column: str, d: Detection = Detection(), p: Policy = Policy(), max_depth: int = 32, max_items: int = 10_000) -> DataFrame:
    """masked_json and mapping for a column of JSON text, one session a row; integers keep their digits' number whatever
    their size. Null stays null; text that is no JSON, or too deep or large, gives null and its reason in json_error."""
    @F.pandas_udf(f"struct<masked_json:string,mapping:array<{ENTRY}>,json_error:string>")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for x in batch:
            s = model.Session(d, p, None)
            out, why = None, None
            if x is not None:
                try:
                    out = json.dumps(s.mask_json(json.loads(x), max_depth, max_items), ensure_ascii=False)
                except (ValueError, RecursionError) as e:
                    why = "not JSON" if isinstance(e, json.JSONDecodeError) else str(e)
            rows.append((out, [] if out is None else [{"token": e.token, "entity_type": e.entity_type, "strategy": e.strategy, "reversible": e.reversible, "original": e.original} for e in s.mapping()], why))
        return pd.DataFrame(rows, columns=["masked_json", "mapping", "json_error"])

    return df.withColumn("_j", run(column)).select(*df.columns, "_j.masked_json", "_j.mapping", "_j.json_error")
