"""Problem 5: clean text from HTML, Markdown, wiki and LaTeX sources.

HTML is parsed into a tree (broken tags included); a text holds HTML if the tree
has an element or an end of one.  The body is found by composite text density:
for every node the characters per tag, adjusted by how much of them are links;
the densities of the children are summed, and the subtree of the largest sum is
kept whole.  What lies outside it is kept if its density reaches the least on
the path from there to the root, or if it holds text without links.  This goes
for whole pages and fragments alike: where the text of a fragment stands under
its root, the largest sum is the root's and nothing is left out.  The root of a
page (with html, head or body, or declared as one) holds the page round the text
as well, so even where its sum is the largest its children must pass.

The clean form keeps structure in plain signs: a heading is a paragraph of its
own, a list item a line that starts with a bullet or its number, a code block is
indented by four blanks and its lines stay as they were, a formula stays as its
source (simple fractions become a/b), table cells are set apart by tabs.

Defined results: null stays null with no kinds; text without markup comes back
as it was; an unclosed element ends with the text; lone signs, verse numbers and
bracketed words stay; further columns are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.markup_kinds import BROKEN, COMMENT, ENTITY, HINT, TAG, TAGS, others
from lexloom.session import read, spread

_BLOCK = set("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul poem gallery".split())
_VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
_DROP = set("script style head template svg canvas object iframe noscript math select option button".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
_KNOWN = set(TAGS)


class Node:
    __slots__ = ("tag", "kids", "up", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up = tag, up
        self.kids: list[Node | str] = []


class Tree(HTMLParser):
    """A tolerant tree: unknown tags are text, unclosed elements end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.seen = 0  # elements, ends of elements, comments and declarations

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _KNOWN:
            self.at.kids.append(self.get_starttag_text() or "")
            return
        self.seen += 1
        if tag in ("html", "body"):
            return
        over = _CLOSES.get(tag)
        while over and self.at.up is not None and self.at.tag in over:
            self.at = self.at.up
        n = Node(tag, self.at)
        self.at.kids.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _KNOWN:
            self.seen += 1
            self.at.kids.append(Node(tag, self.at))
        else:
            self.at.kids.append(self.get_starttag_text() or "")

    def handle_endtag(self, tag: str) -> None:
        self.seen += tag in _KNOWN
        n = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def _post_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in n.kids if isinstance(k, Node)]
    return out[::-1]


def densities(root: Node) -> None:
    """Composite text density of every node and the sum over its children."""
    nodes = _post_order(root)
    for n in nodes:
        kids = [k for k in n.kids if isinstance(k, Node)]
        n.chars = sum(len(k.strip()) for k in n.kids if isinstance(k, str)) + sum(k.chars for k in kids)
        n.tags = sum(1 + k.tags for k in kids)
        if n.tag in _DROP:
            n.chars = 0
        link = n.tag == "a"
        n.link_chars = n.chars if link else sum(k.link_chars for k in kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
    whole = root.chars or 1
    ratio = root.link_chars / whole
    for n in nodes:
        if not n.chars:
            n.density = 0.0
            continue
        base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + ratio * n.chars + math.e)
        x = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
        n.density = n.chars / max(1, n.tags) * (math.log(max(x, 1.0)) / base if base > 0 else 0.0)
    for n in nodes:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node))


def body_text(root: Node, page: bool) -> None:
    """Takes away what lies outside the subtree of the largest sum of densities and below the least density on its path to the root."""
    densities(root)
    centre = max((n for n in _post_order(root) if n.tag not in _DROP), key=lambda n: (n.total, n is root))
    path: set[int] = set()
    least, n = centre.density, centre
    while n is not None:
        path.add(id(n))
        least, n = min(least, n.density), n.up
    stack = [root]
    while stack:
        n = stack.pop()
        if n is centre and not (page and n is root):
            continue
        n.kids = [k for k in n.kids if isinstance(k, str) or id(k) in path or k.density >= least or k.tag not in _BLOCK or (k.chars and not k.link_chars)]
        stack += [k for k in n.kids if isinstance(k, Node) and id(k) in path]


class Store:
    """Code and formulas are set aside under private marks while the rest is rewritten."""

    def __init__(self) -> None:
        self.kept: list[str] = []

    def put(self, text: str) -> str:
        self.kept.append(text)
        return f"\ue000{len(self.kept) - 1}\ue001"

    def back(self, text: str) -> str:
        for _ in range(3):  # a kept piece may hold another's mark
            text = re.sub("\ue000(\\d+)\ue001", lambda m: self.kept[int(m[1])], text)
        return text


def _code(store: Store, code: str) -> str:
    lines = code.strip("\n").split("\n")
    return "\n\n" + store.put("\n".join("    " + x for x in lines)) + "\n\n"


def _render(root: Node, store: Store) -> str:
    """The text of a tree with its structure as plain signs; iterative, so depth is no matter."""
    out: list[str] = []
    stack: list[tuple[str, object]] = [("open", root)]
    counters: list[int | None] = []
    while stack:
        what, n = stack.pop()
        if what == "text":
            out.append(n)  # type: ignore[arg-type]
            continue
        tag = n.tag  # type: ignore[attr-defined]
        if what == "close":
            if tag in ("ul", "ol"):
                counters.pop()
            out.append("\t" if tag in ("td", "th") else "\n" if tag in ("li", "tr", "dd", "dt") else "\n\n" if tag in _BLOCK else "")
            continue
        if tag in _DROP:
            continue
        if tag in ("pre", "code", "tt", "xmp", "samp", "kbd"):
            inner, todo = [], [n]
            while todo:
                k = todo.pop()
                if isinstance(k, str):
                    inner.append(k)
                else:
                    if k.tag == "br":  # type: ignore[attr-defined]
                        inner.append("\n")
                    todo += k.kids[::-1]  # type: ignore[attr-defined]
            text = "".join(inner)
            out.append(_code(store, text) if "\n" in text.strip("\n") or tag in ("pre", "xmp") else store.put(text))
            continue
        if tag == "br":
            out.append("\n")
        elif tag in ("ul", "ol"):
            counters.append(0 if tag == "ol" else None)
            out.append("\n")
        elif tag == "li":
            if counters and counters[-1] is not None:
                counters[-1] += 1
            out.append(f"\n{counters[-1]}. " if counters and counters[-1] is not None else "\n• ")
        elif tag in ("tr", "dd", "dt"):
            out.append("\n")
        elif tag in _BLOCK and tag not in ("td", "th"):
            out.append("\n\n")
        stack.append(("close", n))
        stack += [("text" if isinstance(k, str) else "open", k) for k in n.kids[::-1]]  # type: ignore[attr-defined]
    return "".join(out)


_PAGE = re.compile(r"<(?:html|body|head)\b|\A\s*(?:<\?xml\b[^>]*>\s*)?<!doctype\s+html\b", re.I)
_LESS = re.compile(r"<(?![/!?]?[A-Za-z])")
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", re.I | re.S)


def parse(t: str) -> Tree | None:
    """The tree of a text that holds HTML; null for others."""
    if "<" not in t and ">" not in t:
        return None
    tree = Tree()
    tree.feed(_LESS.sub("&lt;", _REF.sub("", COMMENT.sub("", t))))
    rest = tree.rawdata  # what the parser holds back at an unclosed tag
    if rest:
        tree.at.kids.append(BROKEN.sub("", rest))
    return tree if tree.seen or TAG.search(t) or BROKEN.search(t) or COMMENT.search(t) else None


def from_html(tree: Tree, t: str, store: Store) -> str:
    if not tree.seen:
        return BROKEN.sub("", _REF.sub("", COMMENT.sub("", t)))
    body_text(tree.root, _PAGE.search(t) is not None)
    return BROKEN.sub("", _render(tree.root, store))


_SIMPLE = re.compile(r"\\(?:emph|text\w*|underline|mbox|mathrm|mathbf|footnote|caption|title|author|uppercase|lowercase|enquote)\*?\s*(?:\[[^\]\n]*\])?\{([^{}]*)\}")


def from_latex(t: str, store: Store) -> str:
    t = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*\n?(.*?)(?:\\end\{\1\*?\}|\Z)", lambda m: _code(store, m[2]), t, flags=re.S)
    formula = lambda m: store.put(re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", m[1].strip()))
    t = re.sub(r"\\begin\{(equation|align|displaymath|eqnarray|gather|multline|math)\*?\}(.*?)\\end\{\1\*?\}", lambda m: "\n\n" + store.put(m[2].strip()) + "\n\n", t, flags=re.S)
    for p in (r"\$\$(.+?)\$\$", r"\\\[(.+?)\\\]", r"\\\((.+?)\\\)", r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[\\^_{=+][^$\n]*?)(?<=\S)\$(?![\w$])"):
        t = re.sub(p, formula, t, flags=re.S if "$$" in p or "[" in p[:3] else 0)
    t = re.sub(r"(?<!\\)%[^\n]*\\[^\n]*", "", t) if "\\documentclass" in t else t
    t = re.sub(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph)\*?\s*(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\n\n\1\n\n", t)
    t = re.sub(r"\\(?:cite\w*|ref|label|pageref|index|usepackage|documentclass|bibliography\w*|includegraphics|vspace|hspace|input|include)\*?\s*(?:\[[^\]\n]*\])*\{[^{}]*\}", "", t)
    t = re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", t)
    t = re.sub(r"[ \t]*\\item\b\s*(?:\[([^\]\n]*)\])?[ \t]*", lambda m: f"\n{m[1]}: " if m[1] else "\n• ", t)
    t = re.sub(r"\\(?:begin|end)\s*\{[^{}\n]*\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*", "\n", t)
    for _ in range(6):
        new = _SIMPLE.sub(r"\1", t)
        new = re.sub(r"\{\\[A-Za-z]+\b\s*([^{}]*)\}", r"\1", new)
        if new == t:
            break
        t = new
    t = re.sub(r"\\[A-Za-z]+\*?\s*(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"[ \t]*\\\\(?:\[[^\]\n]*\])?[ \t]*(?:\n|$)", "\n", t)
    t = re.sub(r"\\\\(?:\[[^\]\n]*\])?", "\n", t)
    t = re.sub(r"\\([&%#_{}$])", r"\1", t)
    t = re.sub(r"``([^`'\n]+)''", r'"\1"', t)
    t = re.sub(r"\\[A-Za-z]+\*?[ \t]?|\\[,;!\- ]", " ", t)
    return t


def from_wiki(t: str, store: Store) -> str:
    def table(m: re.Match) -> str:
        rows = []
        for row in re.split(r"^\|-[^\n]*$", m[0], flags=re.M):
            cells = [re.sub(r"^(?:[^|\[\]{}]*=\s*\"?[^|\"]*\"?\s*)\|(?!\|)", "", c).strip() for line in row.split("\n") if line[:1] in "|!" and not line.startswith(("|}", "|+")) for c in re.split(r"\|\||!!", line[1:])]
            if any(cells):
                rows.append("\t".join(cells))
        return "\n" + "\n".join(rows) + "\n"

    t = re.sub(r"^\{\|.*?(?:^\|\}|\Z)", table, t, flags=re.M | re.S)
    for _ in range(4):
        new = re.sub(r"\{\{([^{}]*)\}\}", lambda m: " ".join(x.strip() for x in m[1].split("|")[1:] if "=" not in x), t)
        if new == t:
            break
        t = new
    t = re.sub(r"\[\[(?:File|Image|Category|படிமம்|பகுப்|கோப்பு):[^\[\]\n]*\]\]", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", t)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]([^\]\n]*))?\]", lambda m: m[1] or "", t)
    t = re.sub(r"^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", r"\n\2\n", t, flags=re.M)
    t = re.sub(r"'''''(.+?)'''''|'''(.+?)'''|''(.+?)''", lambda m: m[1] or m[2] or m[3], t)
    t = re.sub(r"^[*#:;]*([*#])[ \t]*(?=\S)(?<![*#]\*)", lambda m: "• ", t, flags=re.M) if re.search(r"^[*#:;]{2,}|^(?:[#*][ \t]+[^\n]*(?:\n|$)){2,}", t, re.M) else t
    t = re.sub(r"^[:;*#]*[:;][ \t]*(?=\S)", "", t, flags=re.M)
    t = re.sub(r"^-{4,}[ \t]*$|__[A-Z]{3,}__|^#REDIRECT[ \t]*|(?<!~)~{3,5}(?!~)", "", t, flags=re.M | re.I if False else re.M)
    return t


def from_markdown(t: str, store: Store) -> str:
    t = re.sub(r"^ {0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", lambda m: _code(store, m[2]), t, flags=re.M | re.S)
    t = re.sub(r"^ {0,3}(?:```|~~~)[^\n]*$", "", t, flags=re.M)
    t = re.sub(r"`([^`\n]+)`", lambda m: store.put(m[1]), t)
    t = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]*)\]\((?:<[^<>\n]*>|[^()\s]+)(?:\s+[\"'][^\"'\n]*[\"'])?\)", r"\1", t)
    t = re.sub(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", t)
    t = re.sub(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S+[^\n]*$", "", t, flags=re.M)
    t = re.sub(r"^([^\n]+)\n(?:={3,}|-{3,})[ \t]*$", r"\n\1\n", t, flags=re.M)
    t = re.sub(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*(?:\n|$)", "\ue002", t, flags=re.M)
    if "\ue002" in t:
        t = re.sub(r"^[ \t]*\|(.*?)\|?[ \t]*$", lambda m: "\t".join(x.strip() for x in m[1].split("|")), t.replace("\ue002", ""), flags=re.M)
    t = re.sub(r"^ {0,3}#{1,6}[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", r"\n\1\n", t, flags=re.M)
    t = re.sub(r"^ {0,3}(?:>[ \t]?)+(?=[ \t]*\S)", "", t, flags=re.M)
    t = re.sub(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", "", t, flags=re.M)
    t = re.sub(r"^([ \t]*)[*+\-][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", r"\1• ", t, flags=re.M) if re.search(r"^(?:[ \t]*[*+\-][ \t]+[^\n]*(?:\n|$)){2,}|^ {0,3}[*+\-][ \t]+\[[ xX]\]", t, re.M) else t
    t = re.sub(r"(?<![*\w\\])\*{1,3}(?=[^\s*])([^*\n]*?[^\s*]|[^\s*])\*{1,4}(?![*\w])", r"\1", t)
    t = re.sub(r"(?<![_\w\\])_{1,3}(?=[^\s_])([^_\n]*?[^\s_]|[^\s_])_{1,3}(?![_\w])", r"\1", t)
    return re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", t)


def kinds(t: str | None) -> list[str]:
    """The kinds of markup in a text: html, entity, markdown, wiki, latex."""
    if not t or not HINT.search(t):
        return []
    return ["html"] * (parse(t) is not None) + ["entity"] * ("&" in t and ENTITY.search(t) is not None) + others(t)


def clean(t: str | None) -> tuple[list[str], str | None]:
    """(kinds of markup, clean text)."""
    if not t or not HINT.search(t):
        return [], t
    tree = parse(t)
    found = ["html"] * (tree is not None) + ["entity"] * ("&" in t and ENTITY.search(t) is not None) + others(t)
    if not found:
        return [], t
    store = Store()
    t = t.replace("\r\n", "\n").replace("\r", "\n").replace("\ue000", "").replace("\ue001", "").replace("\ue002", "")
    if "markdown" in found:  # fences first: what they hold is no markup
        t = re.sub(r"^ {0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", lambda m: _code(store, m[2]), t, flags=re.M | re.S)
    for _ in range(3):  # escaped markup shows itself only after its entities are resolved
        tree = parse(t)
        if tree is not None:
            t = from_html(tree, t, store)
        elif "&" in t and ENTITY.search(t):
            t = html.unescape(t)
        else:
            break
    for kind, f in (("latex", from_latex), ("wiki", from_wiki), ("markdown", from_markdown)):
        if kind in found:
            t = f(t, store)
    t = re.sub(r"[ \t]+$|^[ \t]+(?=•|\d+\. )", "", t, flags=re.M)
    t = re.sub(r"\n{3,}", "\n\n", t).strip()
    for mark in ("•", r"\d+\."):  # items of one list stand together
        t = re.sub(rf"^({mark} [^\n]*)\n\n(?={mark} )", r"\1\n", t, flags=re.M)
    return found, store.back(t).strip("\n")


def clean_markup(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``markup`` (kinds found) and ``clean_text``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([clean(t) for t in s], columns=["markup", "clean_text"])

    f = F.pandas_udf(run, "markup array<string>, clean_text string")  # type: ignore[call-overload]
    x = df.withColumn("__markup", f(F.col(text_col)))
    return x.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__markup.markup").alias("markup"), F.col("__markup.clean_text").alias("clean_text"))


def _units(spark, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tab"), F.col("chunk_id").alias("record_id"), F.col("original_text").alias("text"))
    b = read(spark, sf_dir, "definitions").select(F.lit("definitions").alias("tab"), F.col("def_id").cast("string").alias("record_id"), F.col("meaning").alias("text"))
    return clean_markup(spread(a), "text").unionByName(clean_markup(spread(b), "text"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).where("size(markup) > 0").select("tab", "record_id").distinct()


def p5_clean(spark, sf_dir: str) -> DataFrame:
    """Every unit and definition with its kinds of markup and its clean text."""
    return _units(spark, sf_dir).select("tab", "record_id", F.array_join("markup", ",").alias("markup"), "clean_text").distinct()


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean}
