"""Credentials for fetches. Secrets never become columns and never show in a repr."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from hybridkb.functions import urls


@dataclass(frozen=True)
class Credential:
    headers: dict[str, str] = field(default_factory=dict, repr=False)


class Anonymous:
    def credential(self, url: str) -> Credential:
        return Credential()


class Presigned(Anonymous):
    """The URL is signed already and goes out as it is, for hosts where another provider would add a header."""

    def __init__(self, others=None, is_signed: Callable[[str], bool] = lambda url: True):
        self._others, self._is_signed = others, is_signed

    def credential(self, url: str) -> Credential:
        return Credential() if self._others is None or self._is_signed(url) else self._others.credential(url)


class StaticToken:
    """A header for all hosts, or for one host and those below it."""

    def __init__(self, header: str, value: str, host: str | None = None, exact: tuple[str, ...] = ()):
        self._header, self._value, self.host, self.exact = header, value, host.lower() if host else None, exact

    @classmethod
    def bearer(cls, token: str, host: str | None = None) -> StaticToken:
        return cls("Authorization", f"Bearer {token}", host)

    @classmethod
    def repository(cls, token: str) -> StaticToken:
        """For the two repository hosts alone, not for hosts below them."""
        return cls("Authorization", f"Bearer {token}", exact=("api.github.com", "raw.githubusercontent.com"))

    def credential(self, url: str) -> Credential:
        u = urls.parse(url)
        host = u.host if u else ""
        if self.exact and host not in self.exact:
            return Credential()
        if self.host and host != self.host and not host.endswith("." + self.host):
            return Credential()
        return Credential({self._header: self._value})

    def __repr__(self) -> str:
        return f"StaticToken({self._header}, ***, host={self.host})"


class RefreshingToken:
    """A bearer token from ``source() -> (token, expiry in epoch seconds)``, renewed ``buffer`` seconds
    before it ends, by one thread at a time."""

    def __init__(self, source: Callable[[], tuple[str, float]], buffer: float = 60.0, clock: Callable[[], float] = time.time):
        self._source, self.buffer, self._clock = source, buffer, clock
        self._token: tuple[str, float] | None = None
        self._lock = threading.Lock()

    def _stale(self) -> bool:
        return self._token is None or self._clock() + self.buffer >= self._token[1]

    def credential(self, url: str) -> Credential:
        if self._stale():
            with self._lock:
                if self._stale():
                    self._token = self._source()
        return Credential({"Authorization": f"Bearer {self._token[0]}"})

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lock"}

    def __setstate__(self, state):
        self.__dict__.update(state, _lock=threading.Lock())

    def __repr__(self) -> str:
        return "RefreshingToken(***)"
