"""URL normalisation for result de-duplication (Catalyst expressions only).

normalize_url(u):
  lower-case the whole URL; drop the fragment and ``;params`` of the last
  path segment; strip trailing '/' of the path; in the query decode keys
  and values ('+' is a space), drop pairs without '=' or with an empty
  value, drop tracking keys, group repeated keys at their first position,
  re-encode (space -> '+', '~' kept, '*' -> %2A); scheme, port, user-info
  and 'www.' are kept.
url_domain(u): the authority (user-info and port included) of a
  normalised URL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TRACKING_PARAMS

_SCHEME = r"^([a-z][a-z0-9+.\-]*):"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _decode(x: Column) -> Column:
    # a % that starts no escape stands for itself
    return F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url) -> Column:
    u = F.regexp_extract(F.lower(_c(url)), r"(?s)^([^#]*)", 1)
    scheme = F.regexp_extract(u, _SCHEME, 1)
    rest = F.regexp_replace(u, _SCHEME, "")
    has_net = F.startswith(rest, F.lit("//"))
    netloc = F.when(has_net, F.regexp_extract(rest, r"^//([^/?]*)", 1)).otherwise(F.lit(""))
    after = F.when(has_net, F.regexp_replace(rest, r"^//[^/?]*", "")).otherwise(rest)
    path = F.regexp_extract(after, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(after, r"(?s)^[^?]*\?(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"/+$", "")

    pairs = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0)
    # url_decode itself reads '+' as a space
    kv = F.transform(pairs, lambda p: F.struct(
        _decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
        F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1).alias("raw")))
    tracking = F.array(*[F.lit(t) for t in TRACKING_PARAMS])
    kept = F.filter(kv, lambda x: (x["raw"] != "") & ~F.array_contains(tracking, x["k"]))
    return _assemble(scheme, has_net, netloc, path, kept)


def _assemble(scheme, has_net, netloc, path, kept) -> Column:
    keys = F.array_distinct(F.transform(kept, lambda x: x["k"]))
    grouped = F.flatten(F.transform(keys, lambda key: F.transform(
        F.filter(kept, lambda x: x["k"] == key),
        lambda x: F.concat(_encode(key), F.lit("="),
                           _encode(_decode(x["raw"]))))))
    q = F.array_join(grouped, "&")
    net_path = F.when(has_net | (netloc != ""),
                      F.concat(F.lit("//"), netloc,
                               F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path))
                                .otherwise(path))).otherwise(path)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), net_path,
                    F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def url_domain(norm_url) -> Column:
    """Authority of an already normalised URL ('' when there is none)."""
    rest = F.regexp_replace(_c(norm_url), _SCHEME, "")
    return F.when(F.startswith(rest, F.lit("//")), F.regexp_extract(rest, r"^//([^/?]*)", 1)).otherwise(F.lit(""))
