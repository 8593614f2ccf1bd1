import pytest

from lexloom.llm.residue import Finder, find_residue

find = Finder()

RESIDUE = [
    "{{author}}", "x\n— {{ a | b }}", "${meaning}", "#{line}: பாடல்", "%(canto)s — %(body)s", "<%= work.body %>", "@@work@@ / @@line@@", "__STANZA__ __LINE__", "Abc: %%BODY%%", "{0} {1}: {2}", "<urai>…</urai>", "[Insert title here]", "[object Object]",
    "404 Not Found\nThe requested URL /a/1.html was not found on this server.", "502 Bad Gateway\nRequest id: a-1", "Forbidden - request 12 blocked", "Access denied. Your session 1 has expired.", "COULD NOT LOAD BODY. PLEASE TRY AGAIN LATER.",
    "பாடல் வரி ஒன்று\nFatal error: out of memory in a.php on line 3", "Traceback (most recent call last):\n  File \"a.py\", line 1, in render\nKeyError: 'x'", "Please enable JavaScript to view this page.", "<noscript> active scripting must be on for x", "Checking your browser before opening a.example … Ray 12ab9",
    "Lorem ipsum dolor sit amet consectetur", "Elit ut sit lorem do labore", "blah blah blah (7)", "asdf asdf qwerty 4", "undefined: abc, null", "Text coming soon.", "TODO: paste body for abc", "உரை உரை உரை", "பக்கம் கிடைக்கவில்லை", "சேவையகப் பிழை ஏற்பட்டது, பின்னர் முயலவும்",
    "Plea​se enable Jаvascript to view this page.", "Seite nicht gefunden", "Página no encontrada",
]
GENUINE = [
    None, "", "  \n", "அறம் செய விரும்பு", "{சொடை} முன்றூனை", "[raalaisor] ஒந்தாரில்", "#42 முறின்", "x < y : z", "a & b", "word* வரி", "பண் - காந்தாரம்", "தோழி கூற்று", "Source: x Published by: Y", "Abc: desk@abc.example", "Back", "(Verse 9, Abc)",
    "The commentator of X says an error crept into line 559 because the template of the metre was misread.", "Verse 404 was not found in the copy of X; the scribe left the leaf blank and went on with the next canto.",
    "the x-ray faded after a week and the scholar kept copying the leaves of the book", "None of the poets is named in it; of the old names there were none.", "todo - the grammarian's list\nஅறம் செய விரும்பு என்னும் பாடல்", "அறம் செய விரும்பு என்னும் பழம்பாடல் இது {1} என உரை கூறும்",
    "In X the guards answer that access is denied to the suitor, and he waits 9 days at the gate.", "Sample verses of this kind, says the note, stand on page 9 of the X manuscript.", "என்னும் பக்கம் ஏட்டில் கிடைக்கவில்லை என உரையாசிரியர் குறிப்பிடுகிறார்; மேலும் பல பாடல் வரிகள்",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    kind, share = find(text)
    assert kind and share > 0


@pytest.mark.parametrize("text", GENUINE)
def test_genuine(text):
    assert find(text)[0] is None


def test_long_text_with_a_mention():
    assert find("வரி " * 50_000 + "the page was not found there")[0] is None


def test_table(spark):
    df = spark.createDataFrame([("a", None, "k"), ("b", "{{x}}", "k"), ("b", "{{x}}", "k"), ("c", "", None)], "id string, t string, coverage_ string")
    got = find_residue(df, "t").collect()
    assert len(got) == 4 and [r.residue for r in sorted(got, key=lambda r: r.id)] == [None, "placeholder", "placeholder", None]
    assert find_residue(df.limit(0), "t").count() == 0
