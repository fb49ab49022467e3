"""Fetching pages over HTTP, with every address judged before a request is sent to it."""

from __future__ import annotations

import http.client
import ipaddress
import socket
from urllib.parse import urljoin, urlsplit

from ..functions.web import decoded

#: Networks that are no public target and that the address classes below don't name.
CLOSED = tuple(ipaddress.ip_network(n) for n in ("0.0.0.0/8", "100.64.0.0/10", "fc00::/7", "fec0::/10"))


class Refused(ValueError):
    """A target that may not be fetched."""


def address_reason(address: str) -> str | None:
    """Why a resolved address may not be fetched; null if it may."""
    ip = ipaddress.ip_address(address.split("%")[0])
    inner = getattr(ip, "ipv4_mapped", None) or getattr(ip, "sixtofour", None)
    if inner is None and ip.version == 6 and ip in ipaddress.ip_network("64:ff9b::/96"):
        inner = ipaddress.ip_address(int(ip) & 0xFFFFFFFF)
    if inner is not None:
        return address_reason(str(inner))
    for closed, why in ((ip.is_loopback, "loopback target"), (ip.is_unspecified, "unspecified address"), (ip.is_link_local, "link-local target"), (ip.is_multicast, "multicast target")):
        if closed:
            return why
    if any(ip.version == n.version and ip in n for n in CLOSED) or ip.is_private or ip.is_reserved:
        return "private network target"
    return None


class Fetcher:
    """url -> (status, text). Names are resolved and all of their addresses judged, the address that was connected to is
    judged again before the request is sent, and so is every redirect's target."""

    def __init__(self, agent: str = "seekframe", timeout: float = 10, limit: int = 4 << 20, redirects: int = 5, allow_private: bool = False, resolve=socket.getaddrinfo) -> None:
        self.agent, self.timeout, self.limit, self.redirects, self.allow_private, self.resolve = agent, timeout, limit, redirects, allow_private, resolve

    def reason(self, url: str) -> str | None:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https"):
            return "only http(s) targets are crawled"
        if not parts.hostname:
            return "url has no host"
        if self.allow_private:
            return None
        try:
            found = {x[4][0] for x in self.resolve(parts.hostname, parts.port or 80, type=socket.SOCK_STREAM)}
        except OSError:
            return f"host does not resolve: {parts.hostname}"
        return next((why for address in sorted(found) if (why := address_reason(address))), None if found else f"host does not resolve: {parts.hostname}")

    def __call__(self, url: str) -> tuple[int, str]:
        for _ in range(self.redirects + 1):
            if why := self.reason(url):
                raise Refused(why)
            parts = urlsplit(url)
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            connection = kind(parts.hostname, parts.port, timeout=self.timeout)
            try:
                connection.connect()
                if not self.allow_private and (why := address_reason(connection.sock.getpeername()[0])):
                    raise Refused(why)
                connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": self.agent, "Accept-Encoding": "identity"})
                answer = connection.getresponse()
                if answer.status in (301, 302, 303, 307, 308) and (to := answer.getheader("Location")):
                    url = urljoin(url, to)
                    continue
                return answer.status, decoded(answer.read(self.limit), answer.getheader("Content-Type"))
            finally:
                connection.close()
        raise Refused("too many redirects")
