"""Payload generators over page tables, in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import payloads as P

BOXES = "array<struct<id:int,type:string,x:double,y:double,w:double,h:double,confidence:double>>"
LAYOUT = f"struct<model:string,page_index:int,boxes:{BOXES},reading_order:array<int>,page_size:struct<w:double,h:double>>"
DOCUMENT = "model string, page_index int, text string, tables array<string>, key_values map<string,string>, tree string, confidence double"


def layout(job: Column, page: Column) -> Column:
    """The layout of each page as a struct (through JSON, which keeps nested types exact)."""

    @F.pandas_udf("string")
    def made(jobs: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(P.layout(j, int(p))) for j, p in zip(jobs, pages, strict=True)])

    return F.from_json(made(job.cast("string"), page), LAYOUT)


def document(job: Column, page: Column) -> Column:
    """The second stage's output of each page; the tree is JSON, as trees have no bound on depth."""

    @F.pandas_udf(DOCUMENT)
    def made(jobs: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = [P.document(j, int(p)) for j, p in zip(jobs, pages, strict=True)]
        for r in rows:
            r["tree"] = json.dumps(r["tree"])
        return pd.DataFrame(rows, columns=["model", "page_index", "text", "tables", "key_values", "tree", "confidence"])

    return made(job.cast("string"), page)
