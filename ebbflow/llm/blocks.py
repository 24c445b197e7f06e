"""Leaf blocks of an HTML page: the text between block borders, with the path of
elements around it.

One pass over the markup in linear time.  Elements that show no prose (scripts,
styles, the head's title and the like) are left out with their content; inline
elements do not end a block; character references are decoded after that and
white space inside a block becomes one space.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements (fixed values of the HTML standard).
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search
    section select summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math object audio video canvas".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
         "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
         "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"})}
_CLOSES_P = BLOCK - {"button", "label", "option", "optgroup", "select", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Za-z]+|[0-9]+")
_ENDING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}


#: Elements of a path; a deeper one stands in place of the last.
MAX_DEPTH = 64


@dataclass(slots=True)
class Leaf:
    """A block's text, the elements around it (outermost first), and how many of its letters stand in links."""

    text: str
    path: tuple[str, ...]
    linked: int


def element(name: str, attributes: str) -> str:
    """An element as words: its name, then those of its class, id and role."""
    words = [name]
    if attributes:
        for kind, *values in _ATTRIBUTE.findall(attributes):
            kind, value = kind.lower(), next((v for v in values if v), "")
            if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                words.append("hidden")
            elif kind != "style":
                for w in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)):
                    words.append(w.lower())
    return " ".join(words)


def leaves(page: str | None) -> list[Leaf]:
    """Blocks with text, in page order.  Null and empty pages have none."""
    if not page:
        return []
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    path: tuple[str, ...] = ()
    parts: list[tuple[str, bool]] = []
    endless: set[str] = set()
    link = False
    at, n = 0, len(page)

    def end() -> None:
        if parts:
            text = " ".join(html.unescape("".join([p for p, _ in parts])).split())
            if text:
                linked = sum(len(p) for p, inside in parts if inside)
                out.append(Leaf(text, path, min(linked, len(text))))
            parts.clear()

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            parts.append((page[at:], link))
            break
        if begin > at:
            parts.append((page[at:begin], link))
        mark = page[begin + 1:begin + 2]
        if mark == "!" or mark == "?":
            if page.startswith("<!--", begin):
                close = page.find("-->", begin + 4)
                at = n if close < 0 else close + 3
                if page.startswith("<!-->", begin):
                    at = begin + 5
            elif page.startswith("<![CDATA[", begin):
                close = page.find("]]>", begin)
                at = n if close < 0 else close + 3
            else:
                close = page.find(">", begin)
                at = n if close < 0 else close + 1
            continue
        tag = _TAG.match(page, begin)
        if not tag:
            if mark == "/" or mark.isascii() and mark.isalpha():
                if mark == "/" and not page[begin + 2:begin + 3].isalpha():     # a comment, as browsers read it
                    close = page.find(">", begin)
                    at = n if close < 0 else close + 1
                    continue
                break                                   # the tag never ends
            parts.append(("<", link))
            at = begin + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if name == "a":
                link = False
            elif name in BLOCK:
                end()
                heading = name in HEADINGS              # any heading's end closes the open one
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name or heading and stack[k][0] in HEADINGS:
                        del stack[k:]
                        path = stack[-1][1] if stack else ()
                        break
                if name in ("td", "th", "li", "div", "section", "article", "nav"):
                    link = False
            continue
        if name in RAW:
            if not tag[3].rstrip().endswith("/") or name not in ("svg", "math"):
                close = _ENDING[name].search(page, at) if name not in endless else None
                if close:
                    at = close.end()
                    continue
                endless.add(name)                       # not looked for again
                if name in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"):
                    break                               # its content runs to the end
            continue
        if name == "a":
            link = True
        elif name == "br":
            parts.append((" ", link))
        elif name in BLOCK:
            end()
            if name in _CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            if name in _ENDS:
                ended, until = _ENDS[name]
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in until and stack[k][0] not in ended:
                    k -= 1
                if k >= 0 and stack[k][0] in ended:
                    while k > 0 and stack[k - 1][0] in ended:
                        k -= 1
                    del stack[k:]
            path = stack[-1][1] if stack else ()
            if name not in VOID:
                path = (*path[:MAX_DEPTH - 1], element(name, tag[3]))
                stack.append((name, path))
    end()
    return out
