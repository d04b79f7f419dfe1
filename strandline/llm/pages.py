"""One spelling per page of a URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.keys import let
from strandline.functions.urls import decode_unreserved, selecting_parameters, stripped


def page_key(c: Column) -> Column:
    """One spelling per page: what does not select the page is taken away.

    That is scheme, ``www.``, port 80 or 443, the host's case, fragment, tracking
    parameters, parameter order, a closing slash, white space around and
    percent codes of plain characters. NULL and blank give NULL.
    """

    def selecting(query: Column) -> Column:
        return F.when(query == "", "").otherwise(F.array_join(F.array_sort(selecting_parameters(decode_unreserved(query))), "&"))

    def key(u: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^www\.|\.?(:80|:443)?$", "")
        path = F.regexp_replace(decode_unreserved(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)), r"/+$", "")
        query = let(let(F.regexp_extract(u, r"\?(.*)$", 1), selecting), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.nullif(F.concat(host, path, query), F.lit(""))

    return let(F.regexp_replace(F.regexp_replace(stripped(c), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), key)
