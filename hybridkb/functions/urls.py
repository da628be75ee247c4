"""URLs: parsing in the manner of browsers, resolution, canonical form, keys and crawl scopes.

``canonical_url`` and ``url_path`` are Column expressions for URLs that are already normalised (as
those of a stored index are); ``canonicalise_udf`` and ``url_key_udf`` take any spelling, by Arrow batch.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from hybridkb.functions.udf import arrow_function

DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_PATH_SAFE = "!$%&'()*+,-./:;=@[]^_|~"
_QUERY_SAFE = "!$%&()*+,-./:;=?@[]^_`{|}~\\"
_FORBIDDEN_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


class Url(NamedTuple):
    scheme: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    def text(self, fragment: bool = True) -> str:
        at = f":{self.port}" if self.port is not None else ""
        head = f"{self.scheme}://{self.host}{at}" if self.host or self.scheme == "file" else f"{self.scheme}:"
        tail = f"?{self.query}" if self.query is not None else ""
        mark = f"#{self.fragment}" if fragment and self.fragment is not None else ""
        return f"{head}{self.path}{tail}{mark}"


def _dots(path: str) -> str:
    """The path without dot segments."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low, last = p.lower().replace("%2e", "."), i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        return raw.lower() if raw.endswith("]") else None
    if "%" in raw:
        from urllib.parse import unquote

        raw = unquote(raw)
    if not raw.isascii():
        try:
            import idna

            raw = idna.encode(raw, uts46=True).decode()
        except Exception as e:  # the host is no valid name
            if type(e).__module__.startswith("idna") or isinstance(e, (UnicodeError, ImportError)):
                try:
                    raw = raw.encode("idna").decode()
                except UnicodeError:
                    return None
            else:
                raise
    raw = raw.lower()
    return None if not raw or _FORBIDDEN_HOST.search(raw) else _ipv4(raw)


def _ipv4(host: str) -> str | None:
    """Numeric hosts in dotted form; None where a number is out of range."""
    parts = host.rstrip(".").split(".")
    if not re.fullmatch(r"0x[0-9a-f]*|\d+", parts[-1]):
        return host
    if len(parts) > 4:
        return None
    try:
        n = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    if any(x > 255 for x in n[:-1]) or n[-1] >= 256 ** (5 - len(n)):
        return None
    v = n[-1] + sum(x << (8 * (3 - i)) for i, x in enumerate(n[:-1]))
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """The URL, or None where the text is none."""
    if text is None:
        return None
    s = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    s, mark, frag = s.partition("#")
    fragment = quote(frag, safe=_QUERY_SAFE + "'\"") if mark else None
    m = _SCHEME.match(s)
    if m and (base is None or m[1].lower() != base.scheme or s[m.end() :].startswith(("/", "\\")) or m[1].lower() not in DEFAULT_PORTS):
        scheme, rest = m[1].lower(), s[m.end() :]
    elif base is None:
        return None
    else:
        scheme, rest = base.scheme, s[m.end() :] if m else s
        special = scheme in DEFAULT_PORTS or scheme == "file"
        body, q, query = rest.partition("?")
        body = body.replace("\\", "/") if special else body
        if not body.startswith("//"):
            query_text = quote(query, safe=_QUERY_SAFE) if q else None
            if not body:
                return base._replace(query=query_text if q else base.query, fragment=fragment)
            path = body if body.startswith("/") else base.path.rpartition("/")[0] + "/" + body
            return base._replace(path=_dots(quote(path, safe=_PATH_SAFE)), query=query_text, fragment=fragment)
        rest = body + q + query
    body, q, query = rest.partition("?")
    query_text = quote(query, safe=_QUERY_SAFE) if q else None
    if scheme not in DEFAULT_PORTS and scheme != "file":
        return Url(scheme, "", None, quote(body, safe=_PATH_SAFE), query_text, fragment)
    body = body.replace("\\", "/")
    if scheme == "file":
        host, _, path = body[2:].partition("/") if body.startswith("//") else ("", "", body.lstrip("/"))
        return Url(scheme, host.lower(), None, _dots("/" + quote(path, safe=_PATH_SAFE)), query_text, fragment)
    authority, slash, path = body.lstrip("/").partition("/")
    authority = authority.rpartition("@")[2]
    host_text, port = authority, None
    p = re.search(r":(\d*)$", authority)
    if p:
        host_text = authority[: p.start()]
        if p[1]:
            port = int(p[1])
            if port > 65535:
                return None
    host = _host(host_text)
    if host is None:
        return None
    return Url(scheme, host, None if port == DEFAULT_PORTS[scheme] else port, _dots("/" + quote(path, safe=_PATH_SAFE)), query_text, fragment)


def resolve(base: str | Url, href: str) -> Url | None:
    """``href`` as a link on the page ``base``."""
    at = parse(base) if isinstance(base, str) else base
    return parse(href, at) if at else parse(href)


def canonical_of(u: Url) -> str:
    path = u.path[:-1] if len(u.path) > 1 and u.path.endswith("/") else u.path or "/"
    kept = sorted((q for q in (u.query or "").split("&") if q), key=lambda q: q.encode())
    return f"{u.scheme}://{u.host}" + (f":{u.port}" if u.port is not None else "") + path + ("?" + "&".join(kept) if kept else "")


@lru_cache(65536)
def canonicalise(text: str | None) -> str | None:
    """Lower-case host, no default port, user, fragment or one trailing slash; query parts sorted."""
    u = parse(text)
    return None if u is None else canonical_of(u)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(65536)
def url_key(text: str | None) -> int | None:
    """XXH3-64 of the canonical form as a signed long; None for what is no URL."""
    c = canonicalise(text)
    return None if c is None else signed(xxhash.xxh3_64_intdigest(c.encode()))


@arrow_function("string")
def canonicalise_udf(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: canonicalise(u) if isinstance(u, str) else None).astype(object)


@arrow_function("long")
def url_key_udf(urls: pd.Series) -> pd.Series:
    return pd.Series([url_key(u) if isinstance(u, str) else None for u in urls], dtype="Int64")


@arrow_function("string")
def resolve_udf(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    """The link's URL without fragment where it is http(s), else null."""

    def one(b, h):
        if not isinstance(b, str) or not isinstance(h, str):
            return None
        u = resolve(b, h)
        return u.text(fragment=False) if u and u.scheme in ("http", "https") else None

    return pd.Series([one(b, h) for b, h in zip(bases, hrefs)], dtype=object)


@arrow_function("long")
def content_hash_udf(bodies: pd.Series) -> pd.Series:
    """XXH3-64 of the bytes (of a string's UTF-8)."""

    def one(b):
        if b is None or isinstance(b, float):
            return None
        return signed(xxhash.xxh3_64_intdigest(b.encode() if isinstance(b, str) else bytes(b)))

    return pd.Series([one(b) for b in bodies], dtype="Int64")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def host_of(url: Column) -> Column:
    """The lower-case host without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the authority up to '?' or '#', '/' where that is empty; a text without '://' whole."""
    path = F.regexp_extract(url, r"^[^:]+://[^/]*(/[^?#]*)", 1)
    return F.when(~url.contains("://"), url).when(path == "", F.lit("/")).otherwise(path)


def canonical_url(url: Column) -> Column:
    """The canonical form of a URL whose parts need no percent-encoding, in Column expressions."""
    scheme, host = scheme_of(url), host_of(url)
    port = F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    raw = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*(/[^?#]*)?", 1)
    path = F.when(raw == "", "/").when((F.length(raw) > 1) & raw.endswith("/"), F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda x: x != ""))
    return F.concat(scheme, F.lit("://"), host, F.when((port != "") & ~default, F.concat(F.lit(":"), port)).otherwise(""), path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def host_under(host: Column, base: Column) -> Column:
    return (host == base) | host.endswith(F.concat(F.lit("."), base))


def in_scope(root: Column, candidate: Column, scope: str = "path", allow: list[str] | None = None) -> Column:
    """Whether ``candidate`` lies in the crawl scope of ``root``: 'path' (same host, the path equal or
    below at a '/' boundary), 'host', 'subdomains' or 'allowlist'. Scheme and port don't count; a URL
    without host is never in scope."""
    rh, ch, rp, cp = host_of(root), host_of(candidate), url_path(root), url_path(candidate)
    both = (rh != "") & (ch != "")
    if scope == "path":
        below = cp.startswith(F.when(rp.endswith("/"), rp).otherwise(F.concat(rp, F.lit("/"))))
        return F.coalesce(both & (rh == ch) & ((cp == rp) | below), F.lit(False))
    if scope == "host":
        return F.coalesce(both & (rh == ch), F.lit(False))
    if scope == "subdomains":
        return F.coalesce(both & host_under(ch, rh), F.lit(False))
    if scope != "allowlist":
        raise ValueError(f"no such scope: {scope}")
    ok = F.lit(False)
    for base in allow or []:
        ok = ok | host_under(ch, F.lit(base.removeprefix(".")))
    return F.coalesce(both & ok, F.lit(False))


#: Extensions of files that hold no document, by kind.
ASSETS = ["avi", "mov", "mp3", "mp4", "wav"] + ["gz", "tar", "zip"] + ["eot", "ttf", "woff", "woff2"] + ["css", "js", "map", "mjs", "wasm"] + ["gif", "ico", "jpeg", "jpg", "png", "svg", "webp"]


def extension_of(path: Column) -> Column:
    """Lower-case text after the last '.' of the last segment; '' where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_asset(url: Column) -> Column:
    return extension_of(url_path(url)).isin(ASSETS)


def extension_allowed(url: Column, extensions: list[str]) -> Column:
    """No extensions allow all; otherwise a URL without one is refused."""
    if not extensions:
        return F.lit(True)
    return extension_of(url_path(url)).isin([e.lstrip(".").lower() for e in extensions])


def path_allowed(url: Column, required: list[str]) -> Column:
    """Whether the path contains each text."""
    ok = F.lit(True)
    for r in required:
        ok = ok & url_path(url).contains(r)
    return ok
