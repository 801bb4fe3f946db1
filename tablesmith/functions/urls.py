"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = ["utm_source", "utm_medium", "utm_campaign", "ref"]


_SCHEME, _REST = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://", r"[^/?#\\]*"


def scheme(url: Column) -> Column:
    """In lower case; empty for null and for what is no URL with ://."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _SCHEME, 1))


def _authority(url: Column) -> Column:
    """Host and port in lower case, without user and default port."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), f"{_SCHEME}({_REST})", 2))
    found = F.regexp_replace(F.regexp_replace(found, "^.*@", ""), ":$", "")
    usual = F.when(scheme(url) == "http", ":80").when(scheme(url) == "https", ":443")
    return F.when(found.endswith(usual), F.regexp_replace(found, ":[0-9]+$", "")).otherwise(found)


def host(url: Column) -> Column:
    """The host in lower case, without port; `unknown` where there is none."""
    found = F.regexp_replace(_authority(url), ":[0-9]*$", "")
    return F.when(found == "", "unknown").otherwise(found)


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, without a default port; empty where there is no host."""
    return F.when(_authority(url) == "", "").otherwise(F.concat(scheme(url), F.lit("://"), _authority(url)))


def path(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), f"{_SCHEME}{_REST}([^?#]*)", 2)
    return F.when(found == "", "/").otherwise(found)


def is_pdf(url: Column, content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False)) | F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False))


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (_authority(url) != "")


def normalize(url: Column) -> Column:
    """Without fragment, tracking parameters, leading www. and trailing slash (beyond the original's URL handling)."""
    out = F.regexp_replace(url, "#.*$", "")
    out = F.regexp_replace(out, rf"([?&])(?:{'|'.join(TRACKING)})=[^&]*", "$1")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    return F.regexp_replace(F.regexp_replace(out, "://www\\.", "://"), "/+$", "")
