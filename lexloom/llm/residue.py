"""Problem 1: records that are what a template or a failed page left behind.

Messages of servers and browsers, filler and script notices are matched with one
multi-pattern automaton over phrases of several languages; what the phrases, and
what failed programs print, cover is compared with the length of the record and
of every line of it: a record that contains a left-over message is to be found
too, and there the message is a line that is mostly match, while prose that
speaks of an error is a long line with a short match.  Nothing but an unfilled
placeholder of a form that only templates use counts without that share.
``coverage`` is the share of the whole record.

Defined results: null, empty and blank texts are no residue (kind null, coverage
0); matching ignores case, marks of form and invisible characters; every row of
the input gives one row; further columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.lookalikes import Rewriter, classes, representatives
from lexloom.session import read, spread

COVERED = 0.5  #: share of a line's (or the record's) letters and digits that must be message

FAILURE = """
not found|page not found|file not found|the requested url|was not found on this server|could not be found on this server|the page you asked for does not exist
the page you are looking for|the page you requested|page you asked for|does not exist|no longer exists|no longer available|may have been moved|has been removed
sorry we couldn t find that page|sorry we could not find|we couldn t find|we can t find|couldn t find that page|this page isn t available|nothing was found here|nothing here
internal server error|bad gateway|gateway timeout|gateway time out|service unavailable|service temporarily unavailable|temporarily unavailable|bad request|method not allowed
unauthorized|forbidden|request blocked|permission denied|access denied|access is denied|access forbidden|you don t have permission|you do not have permission|to access this resource
your session|session has expired|session expired|has expired|has timed out|timed out|request timed out|connection refused|connection reset|connection timed out|could not connect
too many requests|rate limit exceeded|retry after|try again later|please try again later|please try again|try again in|please wait|please stand by|could not load|failed to load
unable to load|error loading|an error occurred|an error has occurred|an unexpected error|something went wrong|oops something went wrong|unexpected error|unknown error|server error
application error|database error|error establishing a database connection|fatal error|parse error|out of memory|uncaught exception|unhandled exception|stack trace|segmentation fault
no route to|undefined variable|undefined index|null pointer|nullpointerexception|syntax error|warning connect|on line|traceback most recent call last|request id|error code|error id
forbidden request blocked|forbidden request|your request was blocked|request has been blocked|error the page
loading|loading please wait|under maintenance|down for maintenance|scheduled maintenance|contact the administrator|contact the webmaster|go back to the home page|return to the homepage
seite nicht gefunden|zugriff verweigert|interner serverfehler|ein fehler ist aufgetreten|bitte versuchen sie es später|wird geladen|nicht verfügbar
page non trouvée|page introuvable|accès refusé|erreur interne du serveur|une erreur est survenue|veuillez réessayer|chargement en cours|service indisponible
página no encontrada|acceso denegado|error interno del servidor|se ha producido un error|inténtalo de nuevo|cargando|servicio no disponible|página não encontrada
pagina non trovata|accesso negato|errore interno del server|pagina niet gevonden|страница не найдена|доступ запрещён|ошибка сервера|页面不存在|服务器错误|ページが見つかりません
पृष्ठ नहीं मिला|सर्वर त्रुटि|பக்கம் கிடைக்கவில்லை|பக்கம் காணப்படவில்லை|பக்கம் இல்லை|நீங்கள் தேடிய பக்கம்|தேடிய பக்கம் இல்லை|சேவையகப் பிழை|சேவையக பிழை|வழங்கிப் பிழை
பிழை ஏற்பட்டது|பின்னர் முயலவும்|மீண்டும் முயலவும்|மீண்டும் முயற்சிக்கவும்|பின்னர் முயற்சிக்கவும்|அணுகல் மறுக்கப்பட்டது|அனுமதி மறுக்கப்பட்டது|அனுமதி இல்லை|ஏற்றப்படுகிறது|ஏற்றுகிறது
தயவுசெய்து காத்திருக்கவும்|காத்திருக்கவும்|சேவை கிடைக்கவில்லை|இணைப்பு துண்டிக்கப்பட்டது|அமர்வு காலாவதியானது|உள்ளடக்கம் கிடைக்கவில்லை|ஏற்ற முடியவில்லை
"""
SCRIPTS = """
enable javascript|please enable javascript|javascript is disabled|javascript is required|javascript required|requires javascript|this site requires javascript|this page requires javascript
turn on javascript|turn javascript on|javascript must be enabled|activate javascript|without javascript|javascript and cookies|enable cookies|cookies|for the full text|to view this page
to view this site|to view this text|to view this|to read this|in your browser|your browser|your browser does not support|browser is not supported|you need scripts turned on|scripts turned on
you need to enable|scripts must be enabled|active scripting must be on|active scripting|noscript|needs javascript|you need javascript|javascript to run this app|javascript
checking your browser before|checking your browser|checking if the site connection is secure|verify you are human|verifying you are human|complete the captcha|are you a robot|i m not a robot
ddos protection by|just a moment|ray id|enable scripts|scripts are disabled|scripting is disabled
bitte aktivieren sie javascript|veuillez activer javascript|activez javascript|habilite javascript|active javascript|por favor activa javascript|abilita javascript|включите javascript|请启用javascript
இப்பக்கத்தைக் காண|javascript தேவை|பக்கத்தைக் காண|உங்கள் உலாவியில்|உலாவியில்|ஸ்கிரிப்ட் இயக்கப்பட வேண்டும்|ஸ்கிரிப்ட் தேவை|ஸ்கிரிப்டை இயக்கவும்|இயக்கப்பட வேண்டும்|ஜாவாஸ்கிரிப்ட் தேவை|ஜாவாஸ்கிரிப்டை இயக்கவும்|ஜாவாஸ்கிரிப்ட்|ஸ்கிரிப்ட்|உலாவியைச் சரிபார்க்கிறது
"""
FILLER = """
lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea
commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum
sample text for layout|sample text|dummy text|placeholder text|placeholder|filler text|text goes here|goes here|content goes here|your text here|insert text here|insert your text|blah blah|asdf|qwerty|asdfgh|qwertyuiop
test test|foo bar baz|foo bar|xxx xxx|xxxx|todo paste|todo add|todo insert|todo write|todo fill|fixme|tbd|to be added|to be announced|to be written|content to be added|content coming soon|text coming soon|coming soon|under construction
this section is under construction|this page is under construction|page under construction|work in progress|nothing to see here yet|no content yet|no content|no description available|not yet available|untitled document
undefined|null|nan|none|object object|n a n a
உரை உரை|மாதிரி உரை|சோதனை உரை|மாதிரி மாதிரி|சோதனை சோதனை|உரை இங்கே|உரையை இங்கே|இங்கே உள்ளிடவும்|விரைவில் வரும்|விரைவில் வெளிவரும்|விரைவில் சேர்க்கப்படும்|உரை விரைவில் சேர்க்கப்படும்|உருவாக்கத்தில் உள்ளது|பின்னர் சேர்க்கப்படும்
"""
#: Words that are filler only in company: they count where the line has one of the words that head the list.
_LATIN = ("lorem", "ipsum", "consectetur", "adipiscing", "eiusmod", "incididunt", "dolor", "tempor", "labore")

_NAME = r"[^\W\d][\w.\-]*"
#: Marks that only templates use; they count wherever they stand, as a record that holds one was not filled.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]+%\}|<%[=\-#]?[^%\n]+%>|<\?(?:php|=)[^?\n]*\?>|[$#]\{[^{}\n]+\}|%\(" + _NAME + r"\)[sdfr]|%%" + _NAME + r"%%|@@" + _NAME + r"@@"
    r"|(?<!\w)__[A-Z][A-Z\d]*(?:_[A-Z\d]+)*__(?!\w)|\[\[?%[^%\n]+%\]?\]|<(" + _NAME + r")>\s*(?:…|\.\.\.)\s*</\1>|\[[Oo]bject [Oo]bject\]"
    r"|(?i:\[(?:insert|your|enter|add|type|put|replace)\b[^\]\n]*\b(?:here|goes here|below)\b[^\]\n]*\])"
)
#: Forms that an editor may write too: they count by the share of their line that they cover.
DOUBTFUL = re.compile(r"(?<!\w)__[^\W_](?:\w*[^\W_])?__(?!\w)|\{\d+\}|\[(?:insert|enter|your) [^\]\n]+\]|<(?:insert|enter|your) [^>\n]+>", re.I)
#: What failed programs print, by line; it counts by the share of the line that it covers.
PROGRAM = re.compile(
    r"traceback \(most recent call last\).*|^\s*file \"[^\"]*\", line \d+.*|.*\.php on line \d+.*|^(?:[a-z_]\w*\.)*[a-z]\w*(?:error|exception)(?:: .*|$)|^\W*<noscript\b.*|^\s*at [\w.$]+\([\w.]+:\d+\)"
    r"|(?<![\w\-])ray(?: id)?:? (?=[a-f]*\d)[0-9a-f]{6,}\W*$|^http/\d(?:\.\d)? \d{3}.*|^(?:http )?(?:error )?[45]\d\d(?: error)?[.!]?$|^\W*(?:todo|fixme) *: *(?:paste|add|insert|write|fill|supply|put|complete|translate|replace)\b.*"
    r"|^(?:error )?[45]\d\d[ :\-–]+(?:not found|forbidden|unauthorized|bad request|gone|internal server error|bad gateway|service unavailable|gateway time-?out|too many requests)\.?$",
    re.I,
)
#: A text without any of these has no placeholder and no program line.
_SIGNS = re.compile(r"[A-Za-z{}\[<%@]|[45]\d\d|__")
_WORDS = re.compile(r"[^\W\d_][\w஀-௿]*|\d+[^\W\d_]\w*")


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, text in (("failure", FAILURE), ("script", SCRIPTS), ("filler", FILLER)):
        for phrase in text.replace("\n", "|").split("|"):
            if phrase.strip():
                auto.add_word(f" {phrase.strip()} ", (len(phrase.strip()), kind))
    auto.make_automaton()
    return auto


class Finder:
    """(kind, share of the text that is residue) of a text."""

    def __init__(self, covered: float = COVERED):
        self.auto, self.covered = automaton(), covered
        self.form = Rewriter(representatives({}, classes()))

    def line(self, line: str) -> tuple[dict[str, int], int]:
        """Letters and digits the messages of each kind cover, and all of the line."""
        bare = _REFERENCE.sub("", line)
        words = [w for w in _WORD.findall(bare.replace("_", " ")) if not w.isdigit()]
        if not words:
            words = _WORD.findall(line)
            n = sum(map(len, words))
            if n and PROGRAM.search(line):
                return {"failure": n}, n
            held = sum(len(w) for m in DOUBTFUL.finditer(line) for w in _WORD.findall(m[0]))
            return ({"placeholder": held} if held else {}), n
        text = f" {' '.join(words)} "
        spans: list[tuple[int, int, str]] = []
        latin = False
        for end, (n, kind) in self.auto.iter(text):
            spans.append((end - n, end, kind))
            latin = latin or text[end - n : end] in _LATIN
        if not latin:  # short Latin words are filler only beside the telling ones
            spans = [s for s in spans if s[2] != "filler" or text[s[0] : s[1]] not in _SHORT]
        got: dict[str, int] = {}
        at, total = 0, sum(map(len, words))
        for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
            a = max(a, at)
            if b > a:
                got[kind] = got.get(kind, 0) + sum(not c.isspace() and not c.isdigit() for c in text[a:b])
                at = b
        for kind, pattern in (("failure", PROGRAM), ("placeholder", DOUBTFUL)):
            for m in pattern.finditer(line):
                size = sum(map(len, _WORD.findall(m[0].replace("_", " "))))
                kind = "script" if "noscript" in m[0].lower() else kind
                got[kind] = max(got.get(kind, 0), min(size, total))
        while sum(got.values()) > total:  # what two kinds cover counts once
            least = min(got, key=got.get)
            got[least] = max(0, total - sum(v for k, v in got.items() if k != least))
            if not got[least]:
                del got[least]
        return got, total

    def __call__(self, t: str | None) -> tuple[str | None, float]:
        """The kind and the share of the record that is message."""
        if t is None or not t.strip():
            return None, 0.0
        t = self.form(t)
        plain = _SIGNS.search(t) is not None
        if plain and PLACEHOLDER.search(t) is not None:
            return "placeholder", min(1.0, sum(x.end() - x.start() for x in PLACEHOLDER.finditer(t)) / max(1, len(t.strip())))
        low = t.lower().replace("’", "'")
        if next(self.auto.iter(f" {' '.join(_WORDS.findall(low))} "), None) is None and not (plain and (DOUBTFUL.search(low) or any(map(PROGRAM.search, low.splitlines())))):
            return None, 0.0
        total, held, best = 0, {}, (None, 0.0)
        for line in re.split(r"[\r\n]+", low):
            got, n = self.line(line)
            total += n
            for k, v in got.items():
                held[k] = held.get(k, 0) + v
            share = sum(got.values()) / n if n else 0.0
            if share >= self.covered and share > best[1]:
                best = (max(got, key=got.get), share)
        whole = sum(held.values()) / total if total else 0.0
        kind = best[0] or (max(held, key=held.get) if whole >= self.covered else None)
        return kind, min(1.0, whole)


_WORD = re.compile(r"[\w஀-௿]+")
_REFERENCE = re.compile(r"[\[(]\s*[\w./:#\-]+\s*[\])]\s*$")  # a number or id at the end of a line
_SHORT = {w for w in FILLER.split("non|proident")[0].replace("\n", "|").split("|") if " " not in w} - set(_LATIN) | set("non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())


def find_residue(df: DataFrame, text_col: str, covered: float = COVERED) -> DataFrame:
    """``df`` with ``residue`` (placeholder, failure, script, filler or null) and ``coverage``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = Finder(covered)
        for s in batches:
            yield pd.DataFrame([find(t) for t in s], columns=["residue", "coverage"])

    f = F.pandas_udf(run, "residue string, coverage double")  # type: ignore[call-overload]
    x = df.withColumn("__residue", f(F.col(text_col)))
    return x.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__residue.residue").alias("residue"), F.round("__residue.coverage", 6).alias("coverage"))


def _found(spark, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "semantic_preparation").select("chunk_id", "suppression_reason", "cleaned_text")
    return find_residue(spread(t), "cleaned_text")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).where("residue is not null").select("chunk_id").distinct()


def p1_prepared(spark, sf_dir: str) -> DataFrame:
    """Every unit with the reason it is to be left out for, residue before what was stored."""
    x = _found(spark, sf_dir)
    why = F.when(F.col("residue").isNotNull(), F.concat(F.lit("residue_"), "residue")).otherwise(F.col("suppression_reason"))
    return x.select("chunk_id", why.alias("suppression_reason"), "coverage").distinct()


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_prepared": p1_prepared}
