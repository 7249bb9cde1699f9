"""Body decoding (FN-2).

Candidate charsets, first strict success wins: the ``charset=`` of the
headers, then a ``charset=`` in the first 4096 bytes, then UTF-8, then
GB18030; when none decodes, UTF-8 with replacement characters.

Native path: a row whose first candidate is UTF-8 (or undeclared) and whose
bytes are valid UTF-8 is decoded by ``decode`` in the JVM. Only the other
rows hand their bytes to a vectorised (Arrow) UDF using the standard
library's codecs; the rest pass a null, so the Python side costs nothing
for them.
"""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._util import col_of

#: ``charset=token`` or ``charset="token"``, as in a Content-Type parameter.
_CHARSET = r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:\-]+)"


def header_text(headers) -> Column:
    """'k: v' pairs joined by spaces, in map order."""
    h = F.coalesce(col_of(headers), F.create_map().cast("map<string,string>"))
    return F.array_join(F.transform(F.map_entries(h), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")


def first_decoding(body: bytes, names: list[str]) -> str:
    """``body`` in the first of the codecs that takes it, else UTF-8 with
    replacement characters."""
    for name in names:
        with contextlib.suppress(LookupError, ValueError):
            return body.decode(name)
    return body.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def _decode_udf(body: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else first_decoding(b, n.split()) for b, n in zip(body, names)], dtype=object)


def decode_body(body, headers) -> Column:
    """FN-2 as a Column: native UTF-8 when possible, else the codec UDF."""
    b = col_of(body)
    declared = F.lower(F.regexp_extract(header_text(headers), _CHARSET, 1))
    meta = F.lower(F.regexp_extract(F.substring(b, 1, 4096).cast("string"), _CHARSET, 1))
    names = F.filter(F.array(declared, meta, F.lit("utf-8"), F.lit("gb18030")), lambda n: n != "")
    native_ok = names[0].isin("utf-8", "utf8") & F.is_valid_utf8(b.cast("string"))
    native = F.when(native_ok, F.decode(b, "UTF-8"))
    fallback = _decode_udf(F.when(~native_ok, b), F.when(~native_ok, F.array_join(F.array_distinct(names), " ")))
    return F.coalesce(native, fallback)


def decode_bodies(df: DataFrame, body: str = "body", headers: str = "headers", out: str = "text") -> DataFrame:
    """FN-2 over a table of archived responses."""
    return df.withColumn(out, decode_body(body, headers))
