"""URL pieces by regular expression: unlike parse_url they never fail and leave user info out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_value

_URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]+))?)?([^?#]*)(?:\?([^#]*))?"


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, _URL_RE, 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, _URL_RE, 2)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _URL_RE, 4)


def request_path(uri: Column) -> Column:
    """Path of a request URI, '' when there is none."""
    return F.regexp_extract(uri, r"(?i)^(?:[a-z][a-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def query_value(uri: Column, name: str) -> Column:
    """Decoded, cleaned value of a query parameter; the last one wins, '' when missing."""
    query = F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)
    values = F.regexp_extract_all(query, F.lit(rf"(?:^|&){name}=([^&]*)"), F.lit(1))
    return clean_value(F.try_url_decode(F.try_element_at(values, F.lit(-1))))


def markdown_url(canonical: Column) -> Column:
    """Address of the Markdown copy: the path without trailing slashes plus '.md', '/.md' for the root.
    Scheme (https if missing), host, port and query stay, user info and fragment go (J5)."""
    port = F.regexp_extract(canonical, _URL_RE, 3)
    path = F.rtrim(url_path(canonical), F.lit("/\\"))
    query = F.regexp_extract(canonical, r"^[^#?]*(\?[^#]*)?", 1)
    scheme = url_scheme(canonical)
    url = F.concat(
        F.when(scheme == "", "https").otherwise(scheme),
        F.lit("://"),
        url_host(canonical),
        F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/.md").otherwise(F.concat(path, F.lit(".md"))),
        query,
    )
    return F.when(F.coalesce(canonical, F.lit("")) == "", "").otherwise(url)
