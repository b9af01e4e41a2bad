"""Arrow-batched wrappers of the HTML functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.shared import bound_batches, lean

BLOCK = (
    "kind string, text string, url string, uri string, alt string, language string, depth int, display boolean, space_after boolean, link_start int, "
    "links array<struct<url:string,start:int,end:int>>, ranges array<struct<start:int,end:int>>, definitions array<struct<term:string,definitions:array<string>>>, "
    "rows array<array<struct<text:string,row_span:int,col_span:int,header:boolean>>>, header_rows int, column_count int"
)
_FIELDS = ["kind", "text", "url", "uri", "alt", "language", "depth", "display", "space_after", "link_start", "links", "ranges", "definitions", "rows", "header_rows", "column_count"]
PROFILE = ("text_chars", "images", "figures", "captions", "definitions", "tables", "table_cells", "spanning_cells", "lists", "links", "code_blocks", "math_nodes")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "content", "base_href", "scope")]))
def snapshot(pages: pd.Series) -> pd.DataFrame:
    from lectern.html.snapshot import prepare

    found = [prepare(p) if p else None for p in pages]
    return pd.DataFrame([(s.title, s.content, s.base_href, s.scope) if s else (None,) * 4 for s in found], columns=["title", "content", "base_href", "scope"])


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in PROFILE]))
def profile(pages: pd.Series) -> pd.DataFrame:
    from lectern.html.snapshot import profile as count

    return pd.DataFrame([count(p or "") for p in pages], columns=list(PROFILE)).astype("int64")


def decode(text: Column) -> Column:
    return _decode(text)


@F.pandas_udf(T.StringType())
def _decode(values: pd.Series) -> pd.Series:
    from lectern.html.dom import decode_entities

    return values.map(lambda v: None if v is None else decode_entities(v))


@F.pandas_udf(T.StringType())
def text_without_surroundings(pages: pd.Series) -> pd.Series:
    from lectern.html.dom import one_line, parse_fragment
    from lectern.html.snapshot import strip_ignored

    return pages.map(lambda p: None if p is None else one_line(strip_ignored(parse_fragment(p)).text()))


#: Block rows that a worker holds before it hands them on.
BLOCK_ROWS = 1000


def blocks(pages: DataFrame, key: str, html: str = "html", url: str | None = "url", fields: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """(key, pos, fields): one row per block of each page.

    Pages come in batches of a few megabytes and blocks leave by BLOCK_ROWS, so that a worker's memory does not grow with
    the pages of its task; fields that a caller does not name are not sent."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lectern.html.blocks import content_blocks

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["k", "pos", *fields]).astype(object)
            return out.where(out.notna(), None)

        rows: list[tuple] = []
        for pdf in batches:
            for k, text, at in zip(pdf["k"], pdf["html"], pdf["url"], strict=True):
                for i, b in enumerate(content_blocks(text, at) if text else []):
                    rows.append((k, i, *(b.get(f) for f in fields)))
                    if len(rows) == BLOCK_ROWS:
                        yield frame(rows)
                        rows = []
        yield frame(rows)

    source = pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("html"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"))
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(BLOCK).fields}
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("pos", T.IntegerType()), *(T.StructField(f, kinds[f]) for f in fields)])
    return source.mapInPandas(lean(run), schema).withColumnRenamed("k", key)
