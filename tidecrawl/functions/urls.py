"""URL functions as native column expressions. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, user, host, port, path and query of the generic URI syntax; the fragment is left out.
PARTS = r"(?s)^(?:([^:/?#]+):)?(?://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::([^/?#]*))?)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
DEFAULT_PORTS = {"http": 80, "https": 443}
MARK = "\x01"


def _col(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def stripped(url: Column | str) -> Column:
    return F.regexp_replace(_col(url), r"(?U)^\s+|\s+$", "")


def _with_parts(url: Column | str, use) -> Column:
    """use(parts) with the URL taken apart once; parts has fields scheme, user, host, port, path, query."""
    found = F.split(F.regexp_replace(stripped(url), PARTS, MARK.join(f"${k}" for k in range(1, 7))), MARK)
    names = ("scheme", "user", "host", "port", "path", "query")
    return F.get(F.transform(F.array(found), lambda p: use({n: F.get(p, F.lit(i)) for i, n in enumerate(names)})), F.lit(0))


def _led(mark: str, x: Column) -> Column:
    return F.when(x == "", "").otherwise(F.concat(F.lit(mark), x))


def scheme_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(stripped(url), r"^([^:/?#]+):", 1))


def host_of(url: Column | str) -> Column:
    """Lower-case host without user, port and brackets; '' if there is none."""
    return _with_parts(url, lambda p: F.lower(F.regexp_replace(p["host"], r"[\[\]]", "")))


def normalize_url(url: Column | str) -> Column:
    """Key of a URL: scheme and host in lower case; no user, default port, fragment or trailing slashes.

    Path case and query stay as they are. A port that isn't a number up to 65535 gives null.
    """

    def key(p):
        scheme, number = F.lower(p["scheme"]), p["port"].try_cast("int")
        default = F.coalesce(*[F.when(scheme == s, F.lit(n)) for s, n in DEFAULT_PORTS.items()], F.lit(-1))
        port = F.when((p["port"] == "") | (number == default), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        path = F.regexp_replace(p["path"], "/+$", "")
        head = F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":")))
        whole = F.concat(head, F.lit("//"), F.lower(p["host"]), port, F.when(path == "", "/").otherwise(path), _led("?", p["query"]))
        return F.when((p["port"] == "") | number.between(0, 65535), whole)

    return _with_parts(url, key)


def origin_of(url: Column | str) -> Column:
    """scheme://authority in lower case; user and port stay."""
    user = lambda p: F.when(p["user"] == "", "").otherwise(F.concat(p["user"], F.lit("@")))
    return _with_parts(url, lambda p: F.lower(F.concat(p["scheme"], F.lit("://"), user(p), p["host"], _led(":", p["port"]))))


def path_of(url: Column | str) -> Column:
    """Path, / if empty, and the query."""
    return _with_parts(url, lambda p: F.concat(F.when(p["path"] == "", "/").otherwise(p["path"]), _led("?", p["query"])))


def agent_token(agent: Column | str) -> Column:
    """Lower-case product name of a user agent; * if blank."""
    found = F.lower(F.regexp_extract(stripped(agent), r"^([^/\s]+)", 1))
    return F.when(found == "", "*").otherwise(found)


def is_web(url: Column | str) -> Column:
    return scheme_of(url).isin(*DEFAULT_PORTS)


def resolve_simple(base: Column | str, href: Column | str) -> Column:
    """href against base where no dot segments need to be merged; null for other references."""
    b, h = _col(base), F.regexp_replace(stripped(href), "#.*$", "")
    root = F.regexp_extract(b, "^([^:/?#]+://[^/?#]*)", 1)
    plain = ~h.rlike(r"(^|/)\.{1,2}(/|$|\?)")
    return F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(b, "^([^:/?#]+:)", 1), h)).when(h.startswith("/") & plain, F.concat(root, h))
