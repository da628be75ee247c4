"""What a web page says: title, language, headings, visible text, outbound links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from hybridkb.functions.udf import arrow_function, chunked_function

CONTENT = frozenset("a blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph.
_BLOCK = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: start tag -> (elements that it ends, elements beyond which it doesn't look).
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "caption"}, {"table"}),
    "a": ({"a"}, {"td", "th", "table", "caption"}),
    "option": ({"option"}, {"select"}),
}


class _Page(HTMLParser):
    """One pass: every open content element collects the text inside it, so nested ones repeat it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.bodies: list[list[str]] = []
        self.headings: list[tuple[int, list[str]]] = []
        self.titles: list[list[str]] = []
        self.title_at: tuple[int, int, int] | None = None
        self.lang: str | None = None
        self.seen_html = False

    def _close_to(self, k: int) -> None:
        del self.open[k:]

    def _end(self, names, stops) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in stops:
                return
            if self.open[k][0] in names:
                self._close_to(k)
                if names <= {"li", "p", "a", "option"}:
                    return
                return self._end(names, stops)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "html":
            if not self.seen_html:
                self.seen_html = True
                value = dict(reversed(attrs)).get("lang")
                if value is not None:
                    self.lang = re.split(r"[-_]", value, maxsplit=1)[0].strip() or None
            return
        if tag in ("head", "body"):
            return
        if tag in _BLOCK:
            self._end({"p"}, {"table", "td", "th", "caption", "button"})
        if tag in _HEADINGS and self.open and self.open[-1][0] in _HEADINGS:
            self._close_to(len(self.open) - 1)
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        if tag in _VOID:
            return
        own: list[str] | None = None
        if tag in CONTENT or tag == "title":
            own = []
            if tag in CONTENT:
                self.bodies.append(own)
            if tag in ("h1", "h2", "h3"):
                self.headings.append((int(tag[1]), own))
            if tag == "title":
                self.titles.append(own)
                if self.title_at is None:
                    self.title_at = (*self.getpos(), len(self.get_starttag_text()))
        self.open.append((tag, own))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag or tag in _HEADINGS and name in _HEADINGS:
                return self._close_to(k)
            if name in ("td", "th", "table", "caption") and tag not in ("tr", "tbody", "thead", "tfoot", "table"):
                return

    def handle_data(self, data: str) -> None:
        for _, own in self.open:
            if own is not None:
                own.append(data)


def _title_source(html: str, p: _Page) -> str | None:
    """The first title as it is written, its references undecoded; None where it is blank, has tags within or no end."""
    if p.title_at is None:
        return None
    line, column, tag = p.title_at
    start = 0
    for _ in range(line - 1):
        start = html.index("\n", start) + 1
    start += column + tag
    end = html.find("<", start)
    return html[start:end].strip() or None if end >= 0 and html[end : end + 7].lower() == "</title" else None


def page_facts(html: str) -> dict:
    """title (the first <title>, else the first h1, where not blank), lang, headings and levels (h1 to h3, eight at most), body;
    title_source is the <title> before its references are decoded."""
    p = _Page()
    p.feed(html)
    p.close()
    title = "".join(p.titles[0]).strip() if p.titles else ""
    if not title:
        first = next((c for level, c in p.headings if level == 1), [])
        title = "".join(first).strip()
    heads = [(level, t) for level, c in p.headings if (t := "".join(c).strip())][:8]
    body = "".join(f"{t} " for own in p.bodies for c in own if (t := c.strip()))
    return {"title": title or None, "title_source": _title_source(html, p), "lang": p.lang, "headings": [t for _, t in heads], "levels": [level for level, _ in heads], "body": body}


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]+|#\d+|amp|lt|gt|quot|apos);")


def decode_entities(text: str) -> str:
    """The five named entities and numeric ones; all else stays."""

    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] != "#":
            return _NAMED[e]
        n = int(e[2:], 16) if e[1] in "xX" else int(e[1:])
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


_TAG = re.compile(r"[A-Za-z0-9]+")
_ATTR = re.compile(r"""\s*(?:/|([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?|["'=])""")


def extract_links(html: str) -> list[str]:
    """Hrefs of <a> tags in document order, trimmed and decoded; comments and the text of scripts
    and styles are skipped. Broken markup gives what can be read, never an error."""
    out: list[str] = []
    i, n = 0, len(html)
    while (i := html.find("<", i)) >= 0:
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            if end < 0:
                break
            i = end + 3
            continue
        if html[i + 1 : i + 2] in ("/", "!", "?"):
            end = html.find(">", i + 1)
            if end < 0:
                break
            i = end + 1
            continue
        m = _TAG.match(html, i + 1)
        if not m:
            i += 1
            continue
        name, j, href = m[0].lower(), m.end(), None
        if name in ("script", "style"):
            close = re.compile(f"</{name}", re.I).search(html, j)
            if not close:
                break
            i = close.start()
            continue
        edge = j >= n or html[j].isspace() or html[j] in ">/"
        while j < n:
            while j < n and html[j].isspace():
                j += 1
            if j < n and html[j] == ">":
                break
            a = _ATTR.match(html, j)
            if not a or a.end() == j:
                j += 1
                continue
            if href is None and a[1] and a[1].lower() == "href":
                href = next((g for g in (a[2], a[3], a[4]) if g is not None), None)
            j = a.end()
        if edge and name == "a" and href is not None and (got := decode_entities(href).strip()):
            out.append(got)
        i = j + 1
    return out


def _text(body) -> str:
    return "" if body is None or isinstance(body, float) else body if isinstance(body, str) else bytes(body).decode("utf-8", "replace")


_FACTS = {"title": pa.string(), "title_source": pa.string(), "lang": pa.string(), "headings": pa.list_(pa.string()), "levels": pa.list_(pa.int32()), "body": pa.string()}


@chunked_function("struct<title:string,title_source:string,lang:string,headings:array<string>,levels:array<int>,body:string>", pa.struct(list(_FACTS.items())))
def page_facts_udf(html: str | bytes | None) -> dict:
    return page_facts(_text(html))


@arrow_function("array<string>")
def links_udf(html: pd.Series) -> pd.Series:
    return pd.Series([extract_links(_text(h)) for h in html], dtype=object)


@arrow_function("string")
def decode_entities_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: decode_entities(t) if isinstance(t, str) else None).astype(object)
