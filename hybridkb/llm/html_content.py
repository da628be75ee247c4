"""Main-content extraction from HTML by text-to-tag ratio.

The standard library's parser streams events; text and tags are gathered per line, a line ending at
block-level tags and at line feeds. The ratios text / max(1, tags) are smoothed by a Gaussian over
neighbouring lines, and lines above ``weight`` standard deviations of the smoothed ratios
are content.

Scale: a map over pages; Arrow batches of few rows, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hybridkb.session import pick

BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe li link main menu meta nav noscript ol option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
CODE = frozenset(("script", "style"))
HIDDEN = frozenset(("template", "noscript"))


class LineEvents(HTMLParser):
    """Collects (text, tags) per line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.clear()

    def clear(self) -> None:
        self.reset()
        self.lines: list[tuple[str, int]] = []
        self.words: list[str] = []
        self.tags = 0
        self.code = 0
        self.hidden = 0
        self.mark = 0

    def _end_line(self) -> None:
        text = " ".join(" ".join(self.words).split())
        if text or self.tags:
            self.lines.append((text, self.tags))
        self.words, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        if tag in CODE:
            self.code += 1
        elif tag in HIDDEN:
            self.hidden += 1
            if self.hidden == 1:
                self.mark = len(self.lines)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self._end_line()
        self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in CODE and self.code:
            self.code -= 1
        if tag in BLOCK:
            self._end_line()
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
            if not self.hidden:  # only what a closing tag ends is known to be hidden
                self.lines[self.mark :] = [("", k) for _, k in self.lines[self.mark :] if k]
        elif tag in ("body", "html"):
            self.hidden = 0

    def handle_data(self, data):
        if self.code:
            return
        first, *rest = data.split("\n")
        self.words.append(first)
        for x in rest:
            self._end_line()
            self.words.append(x)

    def finish(self) -> list[tuple[str, int]]:
        self.close()
        self._end_line()
        return self.lines


def gaussian(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothed ratios; the kernel reaches 3 sigma and is renormalised at the ends."""
    if not len(ratios) or sigma <= 0:
        return ratios
    r = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[r : r + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[r : r + len(ratios)]


def content_lines(lines: list[tuple[str, int]], sigma: float, weight: float) -> list[str]:
    if not lines:
        return []
    ratio = np.array([len(t) / max(1, k) for t, k in lines])
    smooth = gaussian(ratio, sigma)
    edge = weight * float(smooth.std())
    kept = [t for (t, _), x in zip(lines, smooth) if t and x > edge]
    return kept or [t for t, _ in lines if t] if edge == 0 else kept


def extract_content(html: str | None, sigma: float = 1.0, weight: float = 1.0, parser: LineEvents | None = None) -> tuple[str, int, int]:
    """(content text, lines kept, lines). Null gives empty text; markup that the parser can't
    finish is taken as far as it came."""
    parser = parser or LineEvents()
    parser.clear()
    try:
        parser.feed(html or "")
        lines = parser.finish()
    except (AssertionError, ValueError):
        parser._end_line()
        lines = parser.lines
    kept = content_lines(lines, sigma, weight)
    return "\n".join(kept), len(kept), len(lines)


def extract_pages(pages: DataFrame, sigma: float = 1.0, weight: float = 1.0) -> DataFrame:
    """(page_id, url, content, n_kept, n_lines), one row for each row of ``pages``.

    Null or empty html gives an empty content and zero lines; null ids and URLs stay null. Pages
    whose lines all have the same smoothed ratio keep every line. Text after a template or noscript
    that nothing closes counts; a script that nothing closes reaches the page's end. Pages of any length are read whole.
    Repeated pages keep their rows; an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = LineEvents()
        for b in batches:
            got = [extract_content(h, sigma, weight, parser) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                names=["page_id", "url", "content", "n_kept", "n_lines"],
            )

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, content string, n_kept int, n_lines int")
