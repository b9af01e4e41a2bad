"""Addresses: canonical form, input normalisation, resolution against a base, checks before fetching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?i)^\s*(https?)://(?:([^/?#@]*)@)?(\[[0-9a-f:.]+\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def canonical(url: Column) -> Column:
    """The address by which a resource is known; null if it is no http(s) address with a host.

    Scheme and host in small letters, no fragment, no default port, `/` for an empty path, dot segments resolved; the
    query is kept as it is. International host names and percent-encoding are left as written.
    """
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, user, host, port = F.lower(part(1)), part(2), F.lower(part(3)), part(4)
    keep_port = (F.length(port) > 0) & ~(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")))
    segments = F.split(F.regexp_replace(F.regexp_replace(part(5), r"\s+$", ""), "^/", ""), "/")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    step = lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s))
    last = F.element_at(segments, -1)
    walked = F.aggregate(segments, F.array().cast("array<string>"), step)
    path = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(last.isin(".", "..") & (F.size(walked) > 0), "/").otherwise(""))
    whole = F.concat(scheme, F.lit("://"), F.when(F.length(user) > 0, F.concat(user, F.lit("@"))).otherwise(""), host, F.when(keep_port, F.concat(F.lit(":"), port)).otherwise(""), path, F.regexp_replace(part(6), r"\s+$", ""))
    return F.when(url.rlike(_PARTS) & (F.length(host) > 0) & ~host.rlike(r"\s"), whole)


def web_url(text: Column) -> Column:
    """What a reader typed as an address: http(s) as it is, a bare host with a dot gets https, all else is null."""
    value = F.regexp_replace(text, r"^\s+|\s+$", "")
    bare = F.contains(value, F.lit(".")) & ~value.rlike(r"[\s<]|://")
    ok = F.when(value.rlike(r"(?i)^https?://"), value).when(bare & (F.length(value) > 0), F.concat(F.lit("https://"), value))
    return F.when(ok.rlike(r"(?i)^https?://[^/?#\s]+[^\s<]*$"), ok)


def is_public_ipv4(ip: Column) -> Column:
    """Whether a dotted address is public: none of the reserved, private, shared, test or multicast blocks."""
    o = [F.try_element_at(F.split(ip, r"\."), F.lit(i + 1)).try_cast("int") for i in range(4)]
    a, b, c = o[0], o[1], o[2]
    # Blocks that are not public.
    closed = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    valid = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & (a <= 255) & (b <= 255) & (c <= 255) & (o[3] <= 255)
    return F.coalesce(valid & ~closed, F.lit(False))


def is_public_ip(text: str) -> bool:
    """The same for one literal of either family."""
    import ipaddress

    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return False
    if ip.version == 6:
        if ip.ipv4_mapped:
            return is_public_ip(str(ip.ipv4_mapped))
        head = int(ip) >> 96
        # fc00::/7, fe80::/10, 2001:db8::/32.
        return not (ip.is_unspecified or ip.is_loopback or ip.is_multicast or int(ip) >> 121 == 0x7E or int(ip) >> 118 == 0x3FA or head == 0x20010DB8)
    # Blocks that are not public.
    blocks = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3"
    return not any(ip in ipaddress.ip_network(n) for n in blocks.split())


def check_public_url(url: str) -> str | None:
    """Why an address must not be fetched, or None. Names are not resolved here; the connector checks every answer."""
    m = re.match(r"(?i)^(https?)://([^/?#]*)", url.strip())
    if not m:
        return "scheme"
    authority = m[2]
    if "@" in authority:
        return "credentials"
    host = re.sub(r":\d*$", "", authority) if not authority.endswith("]") else authority
    host = host.strip("[]").rstrip(".").lower()
    if not host:
        return "host"
    if host == "localhost" or host.endswith(".localhost"):
        return "local"
    if ":" in host:
        return None if is_public_ip(host) else "address"
    pieces = host.split(".")
    number = re.compile(r"^(0x[0-9a-f]*|[0-9]+)$")
    if number.match(pieces[-1]):  # numeric spellings of an IPv4 address
        if len(pieces) > 4 or not all(number.match(p) for p in pieces):
            return "address"
        value = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8) if p.startswith("0") and len(p) > 1 and set(p) <= set("01234567") else int(p) if p.isdigit() else -1 for p in pieces]
        whole = sum(v << (8 * (3 - i)) for i, v in enumerate(value[:-1])) + value[-1]
        if min(value) < 0 or whole >= 1 << 32 or any(v > 255 for v in value[:-1]):
            return "address"
        return None if is_public_ip(".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))) else "address"
    return None


def _walk(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for p in parts:
        if p == "..":
            if out and out[-1] != "":
                out.pop()
        elif p != ".":
            out.append(p)
    if parts[-1] in (".", "..") and (not out or out[-1] != ""):
        out.append("")
    return "/".join(out)


def resolve(link: str, base: str | None) -> str | None:
    """A link as an absolute address. `//host` is https; without a base only absolute links resolve."""
    link = link.strip()
    if re.match(r"(?i)^https?://", link):
        return link
    if link.startswith("//"):
        return "https:" + link
    m = re.match(r"(?i)^(https?://[^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$", base.strip()) if base else None
    if not m or not link or re.match(r"(?i)^[a-z][a-z0-9+.-]*:", link):
        return None
    origin, path, query = m[1], m[2] or "/", m[3] or ""
    if link.startswith("#"):
        return origin + path + query + link
    if link.startswith("?"):
        return origin + path + link
    cut = re.match(r"([^?#]*)(.*)$", link, re.S)
    target = cut[1] if link.startswith("/") else path[: path.rfind("/") + 1] + cut[1]
    return origin + _walk(target) + cut[2]


def link_target(href: str, base: str | None) -> str | None:
    """Where a link leads: nothing for empty, bare `#`, script, data and about links; mail, telephone and web as they are."""
    href = href.strip()
    if not href or href == "#" or re.match(r"(?i)^(javascript|data|about):", href):
        return None
    if re.match(r"(?i)^(mailto:|tel:|https?://)", href):
        return href
    return resolve(href, base) or href
