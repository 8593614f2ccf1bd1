"""Which markup a text holds: the recognisers shared by finding and cleaning."""

from __future__ import annotations

import re

# HTML element names (fixed values of the HTML standard, with the obsolete ones old pages use).
TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress "
    "q rb rp rt ruby s samp script section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt "
    "u ul var video wbr xmp ref references nowiki gallery poem syntaxhighlight"
).split()
_T = "(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + ")"
_ATTR = r"(?:\s+[\w:\-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))?)*"
TAG = re.compile(rf"<(/?)({_T})\b({_ATTR})\s*(/?)>", re.I)
_VALUE = r"(?:\"[^\"<>\n]*\"|'[^'<>\n]*'|[^\s\"'<>]+)"
_NAMED = r"\s+(?:href|src|class|style|align|border|color|size|width|height|name|id)="
#: A tag that was cut off at the end, lost its bracket, or has an unclosed attribute.  Where much text follows on its line, only
#: what can be the tag's is taken: values in quotes or without blanks, and an open quote up to the line's end.
BROKEN = re.compile(
    rf"</{_T}\b[^<>\n]{{0,40}}(?=[<\n]|$)|<{_T}(?:\s+[\w:\-]+\s*=[^<>\n]{{0,200}}|\s*/?)(?=<|\n|$)|(?:^|(?<=[\s>]))/?{_T}{_NAMED}[\"']?[^<>\n\"']{{0,100}}[\"']?\s*/?>"
    rf"|</{_T}\b(?![^<>\n]*>)|<{_T}(?=\s+[\w:\-]+\s*=)(?![^<>\n]*>)(?:\s+[\w:\-]+\s*=\s*{_VALUE})*(?:\s+[\w:\-]+\s*=\s*(?:\"[^\"<>\n]*|'[^'<>\n]*)(?=<|\n|$))?"
    rf"|(?:^|(?<=[\s>]))/?{_T}{_NAMED}{_VALUE}(?:\s+[\w:\-]+\s*=\s*{_VALUE})*\s*/?>",
    re.I,
)
COMMENT = re.compile(r"<!--.*?(?:-->|$)|<!doctype\b[^>]*>|<!\[CDATA\[.*?(?:\]\]>|$)|<\?xml\b.*?\?>", re.I | re.S)
#: References, also those that lost their semicolon and that parsers still read.
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});|&(?:nbsp|amp|lt|gt|quot|copy|reg|shy|middot|laquo|raquo|deg|sect|para|[AEIOUaeiou](?:acute|grave|circ|uml))(?![A-Za-z0-9=])|&#(?:\d{2,6}|[xX][0-9a-fA-F]{2,5})(?![0-9A-Za-z])")
MARKDOWN = re.compile(
    r"!?\[[^\[\]\n]*\]\((?:<[^<>\n]*>|[^()\s]+)(?:\s+[\"'][^\"'\n]*[\"'])?\)|!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^ {0,3}\[[^\[\]\n]+\]:\s*\S+"
    r"|(?<![*\w\\])\*\*(?=[^\s*])[^\n]*?[^\s*]\*\*(?!\*)|(?<![_\w\\])__(?=[^\s_])[^\n]*?[^\s_]__(?![_\w])|(?<![*\w\\])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![*\w])|(?<![*\w\\])\*[^\s*]\*(?![*\w])|(?<![_\w\\])_(?=[^\s_])[^_\n]*[^\s_]_(?![_\w])"
    r"|(?<![*\w\\])\*{3}(?=[^\s*])[^*\n]+?[^\s*]\*{3}(?!\*)|(?<![*\w\\])\*{1,3}(?=[^\s*])[^*\n]*[^\s*]\*{1,4}(?![*\w])|~~(?=\S)[^~\n]+~~|^ {0,3}(?:```|~~~+[\w.+\-]*[ \t]*$)|`[^`\n]+`|^ {0,3}#{1,6}[ \t]+(?!\d+[ \t]*$)\S|^[^\n]+\n(?:={3,}|-{3,})[ \t]*$|^ {0,3}>[ \t]*(?!\d)\S|^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
    r"|^ {0,3}[*+\-][ \t]+\[[ xX]\][ \t]|^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^(?:[ \t]*[*+\-][ \t]+[^\n]*\S[^\n]*(?:\n|$)){2,}",
    re.M,
)
WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|\{\{[^{}]+\}\}|^\{\||^\|[}\-]|'''?(?=[^\s'])[^'\n]+'''?|^(={1,6})[ \t]*[^=\n]+?[ \t]*\1[ \t]*$|\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\]"
    r"|^[*#:;]{2,}[ \t]*\S|^:[ \t]*\S|^;[ \t]*[^\s:][^\n:]*(?::|\n[:;])|^(?:[#*][ \t]+[^\n]*(?:\n|$)){2,}|^-{4,}[ \t]*$|__[A-Z]{3,}__|(?<!~)~{3,5}[ \t]*$|^#(?:REDIRECT|redirect)\b|^#[ \t]+(?!\d+[ \t]*$)\S",
    re.M,
)
LATEX = re.compile(
    r"\\(?:begin|end)\s*\{[^{}\n]*\}|\\[A-Za-z]+\*?\s*(?:\[[^\]\n]*\])?\{|\{\\[A-Za-z]+\b|(?<![\w:\\])\\[A-Za-z]{3,}\b|(?<![\w:\\])\\(?:item|par|noindent|newline|newpage|hline|centering|bf|it|em|sc|tt|rm|large|small|ldots|dots|quad|qquad|hfill|indent|maketitle|alpha|beta|gamma|frac|times|cdot|sqrt|sum|int|leq|geq|neq|infty|pm|to)\b"
    r"|\\\\(?:\[[^\]\n]*\])?\s*$|\\[(\[][^\n]+?\\[)\]]|\$\$[^$]+\$\$|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n\\^_{=+]*[\\^_{=+])[^$\n]+(?<=[^\s$])\$(?![\w$])|\\[&%#_{}$](?=\W|\w)|``[^`'\n]+''|\\(?:,|;|!|-)(?=\s|\w)",
    re.M,
)
HINT = re.compile(r"[<>&*_`#=|\[\]{}\\$~'\-+:;]")


def others(t: str) -> list[str]:
    """The kinds of markup that are no HTML: markdown, wiki, latex."""
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    return [k for k, p in (("markdown", MARKDOWN), ("wiki", WIKI), ("latex", LATEX)) if p.search(t)]
