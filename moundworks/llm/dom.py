"""Web pages as trees: elements and runs of text in page order, for the extraction of main text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<rest>[^>]*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Kinds of elements in the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg math select object video audio canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
SCOPE = frozenset("html table td th caption button".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
MARK = "data-main"


@dataclass
class Page:
    """A node is an element or a run of text; parents come before children. ``flow`` holds text nodes
    in page order, and -1 where a block begins or ends."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sign: list[tuple] = field(default_factory=list)  # (tag, class id role, inside an article); of text: ("#text", in a link)
    text: list[str] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)  # 1 and 0: main text or not, as marked here or above
    flow: list[int] = field(default_factory=list)

    def add(self, parent: int, sign: tuple, text: str = "", mark: int | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.sign.append(sign)
        self.text.append(text)
        self.mark.append(mark if mark is not None else self.mark[parent] if parent >= 0 else 0)
        return len(self.parent) - 1

    def joined(self, kept: list[bool]) -> str:
        """Texts of the nodes kept, blocks apart by a space, white space as one space."""
        return " ".join("".join([" " if n < 0 else self.text[n] if kept[n] else "" for n in self.flow]).split())


def attributes(source: str) -> dict[str, str]:
    return {n.lower(): html.unescape(a or b or c) for n, a, b, c in ATTRIBUTE.findall(source)}


def parse(source: str) -> Page:
    """The tree, with end tags that may be left out put in, and what has no open element passed over.
    Scripts, styles, form controls, embedded things, comments and titles leave no text."""
    page = Page()
    stack, tags = [page.add(-1, ("#page",))], ["#page"]
    opened: dict[str, int] = {}
    for tag in ("html", "body"):  # where the page leaves them out
        if not re.search(rf"<{tag}[\s>]", source, re.I):
            stack.append(page.add(stack[-1], (tag, "", False)))
            tags.append(tag)
            opened[tag] = 1
            if tag == "html" and re.search(r"<body[\s>]", source, re.I):
                break
    links = main = 0

    def pop_to(size: int) -> None:
        nonlocal links, main
        while len(stack) > size:
            stack.pop()
            t = tags.pop()
            opened[t] -= 1
            links -= t == "a"
            main -= t in ("article", "main")

    def say(text: str) -> None:
        if text.isspace():
            page.flow.append(-1)
        elif text:
            page.flow.append(page.add(stack[-1], ("#text", links > 0), html.unescape(text)))

    def find(names: tuple[str, ...], until: frozenset | tuple, inline: bool = False) -> int | None:
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in names:
                return k
            if tags[k] in until or (inline and tags[k] not in INLINE):
                return None
        return None

    at, lower = 0, None
    for m in iter(lambda: TOKEN.search(source, at), None):
        say(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                say(m["cdata"])
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if not inline:
            page.flow.append(-1)
        if m["end"]:
            if opened.get(tag):
                k = find((tag,), SCOPE - {tag} if tag not in TABLE else ("#page",), inline)
                if k is not None:
                    pop_to(k)
            continue
        if tag in CLOSES_P and opened.get("p"):
            k = find(("p",), SCOPE)
            if k is not None:
                pop_to(k)
        if tag in SIBLINGS and any(opened.get(t) for t in SIBLINGS[tag]):
            k = find(SIBLINGS[tag], HOLDS[tag])
            if k is not None:
                pop_to(k)
                if tag == "tr" and tags[-1] == "tr":
                    pop_to(len(tags) - 1)
        if tag in VOID:
            continue
        if tag in RAW:  # up to its own end tag, whatever is inside
            lower = lower if lower is not None else source.lower()
            end = lower.find(f"</{tag}", at)
            if end >= 0:
                stop = lower.find(">", end)
                at = stop + 1 if stop >= 0 else len(source)
            elif tag not in ("object", "select", "noscript", "svg", "math", "video", "audio", "canvas"):
                at = len(source)
            continue
        raw = m["attrs"] if m["attrs"] is not None else m["rest"]
        a = attributes(raw) if raw and "=" in raw else {}
        names = " ".join(a[k] for k in ("class", "id", "role", "itemprop") if k in a)
        mark = int(a[MARK]) if a.get(MARK) in ("0", "1") else None
        if raw and raw.endswith("/") and tag in ("path", "use", "circle"):
            continue
        stack.append(page.add(stack[-1], (tag, names, main > 0), mark=mark))
        tags.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        main += tag in ("article", "main")
    say(source[at:])
    return page
