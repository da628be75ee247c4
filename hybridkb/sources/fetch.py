"""HTTP fetches by host, with pacing, retries, size limits and robots rules."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.functions import urls
from hybridkb.sources.auth import Anonymous
from hybridkb.sources.crawl import CrawlConfig, backoff_ms

RETRY_MS = (1_000, 300_000)
ROBOTS_BYTES = 512 << 10
FETCHED = "url string, status int, content_type string, etag string, final_url string, body binary, attempts int, error string"
_DATE = re.compile(r"(?:[^,]*, )?(\d{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (\d{1,4}) (\d{1,2}):(\d{1,2}):(\d{1,2}) GMT\s*")


def imf_date_ms(text: str | None) -> int | None:
    """Epoch milliseconds of an HTTP date; None for all else and for times before 1970."""
    m = _DATE.fullmatch(text or "")
    if not m or int(m[6]) > 60:
        return None
    try:
        at = datetime(int(m[3]), "JanFebMarAprMayJunJulAugSepOctNovDec".index(m[2]) // 3 + 1, int(m[1]), int(m[4]), int(m[5]), tzinfo=timezone.utc)
    except ValueError:
        return None
    ms = int(at.timestamp() + int(m[6])) * 1000
    return ms if ms >= 0 else None


def imf_date(value: Column) -> Column:
    """``imf_date_ms`` as a Column expression."""
    bare = F.regexp_extract(value, r"^(?:[^,]*, )?(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT)$", 1)
    return F.unix_millis(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))


def retry_after(seconds: Column, date_ms: Column, reset_s: Column, now_ms: Column) -> Column:
    """Milliseconds to wait: Retry-After in seconds, else as a date, else the reset time, else one second; within bounds."""
    told = F.coalesce(seconds * 1000, F.greatest(date_ms - now_ms, F.lit(0)), F.greatest(reset_s * 1000 - now_ms, F.lit(0)), F.lit(RETRY_MS[0]))
    return F.least(F.greatest(told, F.lit(RETRY_MS[0])), F.lit(RETRY_MS[1]))


def retry_after_ms(headers: dict[str, str], now_ms: int) -> int:
    low = {k.lower(): v.strip() for k, v in headers.items()}
    value, told = low.get("retry-after"), None
    if value is not None:
        told = int(value) * 1000 if value.isdigit() else (None if (at := imf_date_ms(value)) is None else max(0, at - now_ms))
    if told is None and low.get("x-ratelimit-reset", "").isdigit():
        told = max(0, int(low["x-ratelimit-reset"]) * 1000 - now_ms)
    return min(max(RETRY_MS[0] if told is None else told, RETRY_MS[0]), RETRY_MS[1])


class Robots:
    """Rules by scheme and authority; whatever goes wrong allows all."""

    def __init__(self, get: Callable[[str], bytes | None], agent: str = "*"):
        self._get, self.agent, self._rules = get, agent, {}

    def _of(self, url: str) -> urllib.robotparser.RobotFileParser | None:
        u = urls.parse(url)
        key = f"{u.scheme}://{u.host}" + (f":{u.port}" if u.port is not None else "")
        if key not in self._rules:
            rules = None
            try:
                body = self._get(key + "/robots.txt")
                if body is not None and len(body) <= ROBOTS_BYTES:
                    rules = urllib.robotparser.RobotFileParser()
                    rules.parse(body.decode("utf-8", "replace").splitlines())
            except OSError:
                rules = None
            self._rules[key] = rules
        return self._rules[key]

    def allowed(self, url: str) -> bool:
        rules = self._of(url)
        return rules is None or rules.can_fetch(self.agent, url)

    def delay_ms(self, url: str) -> int:
        rules = self._of(url)
        return int(1000 * float(rules.crawl_delay(self.agent) or 0)) if rules else 0


class Pacer:
    """The next time at which each host may be asked."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self._clock, self._next = clock, {}

    def reserve(self, host: str, interval: float) -> float:
        """Seconds to wait; the slot after it is taken."""
        now = self._clock()
        slot = max(self._next.get(host, now), now)
        self._next[host] = slot + interval
        return slot - now


def http_get(url: str, etag: str | None, max_bytes: int, headers: dict[str, str], timeout: float = 30.0) -> dict:
    """One GET; a body over ``max_bytes`` is an error whatever length was announced."""
    request = urllib.request.Request(url, headers={**headers, **({"If-None-Match": etag} if etag else {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            body = r.read(max_bytes + 1)
            if len(body) > max_bytes:
                return {"status": r.status, "error": f"more than {max_bytes} bytes"}
            return {"status": r.status, "content_type": r.headers.get("Content-Type"), "etag": r.headers.get("ETag"), "final_url": r.url if r.url != url else None, "body": body}
    except urllib.error.HTTPError as e:
        return {"status": e.code, "headers": dict(e.headers), "error": None if e.code == 304 else f"status {e.code}"}
    except (OSError, ValueError) as e:
        return {"status": None, "error": str(e) or type(e).__name__}


def fetch(requests: DataFrame, config: CrawlConfig = CrawlConfig(), auth=None, get: Callable = http_get, robots: bool = False, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row (``FETCHED``) for each of ``requests`` (url, etag). A host is asked from ``config.concurrency`` lanes, each
    of which waits so many times the delay, so that the host sees the asked rate whatever their number;
    retriable failures are tried again ``config.retries`` times."""
    signer, lanes = auth or Anonymous(), max(1, config.concurrency)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pacer = Pacer()
        rules = Robots(lambda u: get(u, None, ROBOTS_BYTES, {}).get("body"), config.user_agent or "*") if robots else None
        for part in parts:
            out = []
            for url, etag in zip(part["url"], part["etag"]):
                u = urls.parse(url)
                if u is None or u.scheme not in ("http", "https"):
                    out.append({"url": url, "error": "not an http URL", "attempts": 0})
                    continue
                if rules and not rules.allowed(url):
                    out.append({"url": url, "error": "disallowed by robots", "attempts": 0})
                    continue
                wait = max(config.min_delay_ms, rules.delay_ms(url) if rules else 0) * lanes / 1000
                headers = dict(signer.credential(url).headers)
                if config.user_agent:
                    headers["User-Agent"] = config.user_agent
                for attempt in range(config.retries + 1):
                    sleep(pacer.reserve(u.host, wait))
                    got = get(url, etag, config.max_bytes, headers)
                    told = got.pop("headers", {})
                    again = got.get("status") in (None, 408, 429, 500, 502, 503, 504) and got.get("error")
                    if not again or attempt == config.retries:
                        break
                    sleep(backoff_ms(attempt, retry_after_ms(told, int(time.time() * 1000)) if got.get("status") == 429 else None) / 1000)
                out.append({**got, "url": url, "attempts": attempt + 1})
            names = ["url", "status", "content_type", "etag", "final_url", "body", "attempts", "error"]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in names})

    return requests.select("url", "etag").repartition(urls.host_of(F.col("url")), F.pmod(F.xxhash64("url"), F.lit(lanes))).mapInPandas(run, FETCHED)
