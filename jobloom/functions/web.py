"""URL helpers and listing flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobloom.constants import BOARD_BASE_URL


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remote_type(location, flag=None) -> Column:
    """X9: 'Remote' when the flag is set or the location mentions remote."""
    cond = F.coalesce(F.lower(_c(location)).contains("remote"), F.lit(False))
    if flag is not None:
        cond = F.coalesce(_c(flag), F.lit(False)) | cond
    return F.when(cond, F.lit("Remote")).otherwise(F.lit(None).cast("string"))


def job_url_from_key(key, base: str = BOARD_BASE_URL) -> Column:
    """Base + '/viewjob?jk=' + key, or '' without a key."""
    k = _c(key)
    return F.when(F.coalesce(k, F.lit("")) != "", F.concat(F.lit(base + "/viewjob?jk="), k)) \
        .otherwise(F.lit(""))


def item_job_url(key, url, base: str = BOARD_BASE_URL) -> Column:
    """X10 item variant: a given url wins; a relative url gets the base prefix."""
    u = F.coalesce(_c(url), F.lit(""))
    k = F.coalesce(_c(key), F.lit(""))
    return (F.when((k != "") & (u == ""), F.concat(F.lit(base + "/viewjob?jk="), k))
            .when((u != "") & ~u.startswith("http"), F.concat(F.lit(base), u))
            .otherwise(u))


def resolve_company_url(url, direct=None, base: str = BOARD_BASE_URL) -> Column:
    """X11: a direct url wins; a relative url gets the base prefix."""
    u = _c(url)
    resolved = F.when(u.isNotNull() & (u != "") & ~u.startswith("http"),
                      F.concat(F.lit(base), u)).otherwise(u)
    if direct is None:
        return resolved
    d = _c(direct)
    return F.when(F.coalesce(d, F.lit("")) != "", d).otherwise(resolved)


def snippet_fallback(snippet, items) -> Column:
    """Snippet, else the snippet items joined by ' '."""
    return F.coalesce(F.nullif(_c(snippet), F.lit("")),
                      F.array_join(F.coalesce(_c(items), F.array().cast("array<string>")), " "))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def url_domain(url) -> Column:
    """Host of a URL (netloc, else path), minus 'www.', cut at '/'; needs a '.'."""
    u = _c(url)
    rest = F.regexp_replace(u, _SCHEME, "")
    has_auth = rest.startswith("//")
    netloc = F.when(has_auth, F.regexp_extract(rest, r"^//([^/?#]*)", 1)).otherwise(F.lit(""))
    path = F.when(has_auth, F.regexp_extract(rest, r"^//[^/?#]*([^?#]*)", 1)) \
        .otherwise(F.regexp_extract(rest, r"^([^?#]*)", 1))
    dom = F.when(netloc != "", netloc).otherwise(path)
    dom = F.when(dom.startswith("www."), F.substring(dom, 5, 1 << 30)).otherwise(dom)
    cut = F.substring_index(dom, "/", 1)
    return F.when(u.isNull() | ~dom.contains("."), F.lit(None).cast("string")) \
        .otherwise(F.nullif(cut, F.lit("")))
