"""URL functions. Two canonical forms exist on purpose: for retrieval (S22) and for provenance."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import vectorized

# Fixed values.
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid"]
METADATA_HOSTS = ["metadata", "metadata.google.internal", "metadata.azure.internal", "instance-data", "169.254.169.254", "100.100.100.200"]


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def host(url: Column) -> Column:
    """Lower-case host without a final dot; empty where the URL has none."""
    return F.coalesce(F.regexp_replace(F.lower(url_part(url, "HOST")), r"\.$", ""), F.lit(""))


def port(url: Column) -> Column:
    """The port named in the URL, as a number; null without one."""
    return F.regexp_extract(F.coalesce(url_part(url, "AUTHORITY"), F.lit("")), r":(\d+)$", 1).try_cast("int")


@vectorized("string")
def _idna(hosts: pd.Series) -> pd.Series:
    def one(h):
        try:
            return h.encode("idna").decode("ascii")
        except (UnicodeError, AttributeError):
            return None

    return hosts.map(one)


def canonical_url(url: Column, idna: bool = False) -> Column:
    """Null for other schemes than HTTP, credentials, or no host. Default ports and fragments go, tracking keys go from
    the query, whose pairs are sorted. idna: also encode hosts with other than ASCII letters (by an Arrow function); without
    it such URLs give null."""
    u = F.trim(url)
    scheme, name, number = F.lower(url_part(u, "PROTOCOL")), host(u), port(u)
    scheme_ok = scheme.isin("http", "https")
    usable = scheme_ok & (name != "") & ~F.contains(F.coalesce(url_part(u, "AUTHORITY"), F.lit("")), F.lit("@"))
    # the JVM's parser knows no host with other letters: it is then cut out of the authority
    loose = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#@:]+)", 1)), r"\.$", "")
    name = F.coalesce(F.nullif(name, F.lit("")), loose) if idna else name
    usable = scheme_ok & (name != "") & ~F.contains(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1), F.lit("@")) if idna else usable
    ascii_ = F.rlike(name, F.lit(r"^[\x00-\x7f]*$"))
    display = F.when(ascii_, name).otherwise(_idna(name)) if idna else F.when(ascii_, name)
    default = F.when(scheme == "http", 80).otherwise(443)
    suffix = F.when(number.isNull() | (number == default), "").otherwise(F.concat(F.lit(":"), number))
    pairs = F.filter(F.split(F.coalesce(url_part(u, "QUERY"), F.lit("")), "&"), lambda x: x != "")
    key = lambda x: F.lower(F.substring_index(x, "=", 1))
    kept = F.filter(pairs, lambda x: ~F.startswith(key(x), F.lit("utm_")) & ~key(x).isin(TRACKING_KEYS))
    whole = F.transform(kept, lambda x: F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))))
    in_order = F.array_join(F.transform(F.array_sort(F.transform(whole, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), x.alias("x")))), lambda p: p["x"]), "&")
    path = F.coalesce(F.nullif(url_part(u, "PATH"), F.lit("")), F.lit("/"))
    return F.when(usable & display.isNotNull(), F.concat(scheme, F.lit("://"), display, suffix, path, F.when(in_order == "", "").otherwise(F.concat(F.lit("?"), in_order))))


def source_url(url: Column) -> Column:
    """Ports 80 and 443 go for any scheme, so does a final slash; the query stays as it is. What can't be parsed stays."""
    number = port(url)
    suffix = F.when(number.isNull() | number.isin(80, 443), "").otherwise(F.concat(F.lit(":"), number))
    path = F.coalesce(F.nullif(F.regexp_replace(F.coalesce(url_part(url, "PATH"), F.lit("")), "/+$", ""), F.lit("")), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), F.nullif(url_part(url, "QUERY"), F.lit(""))), F.lit(""))
    return F.coalesce(F.concat(F.lower(url_part(url, "PROTOCOL")), F.lit("://"), host(url), suffix, path, query), url)


@vectorized("boolean")
def is_public_address(values: pd.Series) -> pd.Series:
    """A global address, neither multicast nor unspecified."""

    def one(v):
        try:
            a = ipaddress.ip_address(str(v).split("%", 1)[0])
        except ValueError:
            return False
        return bool(a.is_global and not a.is_multicast and not a.is_unspecified)

    return values.map(one)


def is_metadata_host(name: Column) -> Column:
    """S24."""
    return F.lower(name).isin(METADATA_HOSTS)


def domain_matches(actual: Column, registered: Column) -> Column:
    """J15 as a predicate; domain_suffixes() makes it an equi-join."""
    a, r = F.regexp_replace(F.lower(actual), r"\.$", ""), F.regexp_replace(F.lower(registered), r"\.$", "")
    return (a == r) | F.endswith(a, F.concat(F.lit("."), r))


def domain_suffixes(name: Column) -> Column:
    """A.b.c gives [a.b.c, b.c, c], to be exploded and joined on equality."""
    parts = F.split(F.regexp_replace(F.lower(name), r"\.$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
