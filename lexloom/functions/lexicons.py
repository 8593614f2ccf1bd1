"""Alphabets, lexicons and patterns that the text operators take as parameters."""

from __future__ import annotations

# The defaults below must hold these entries, in this order, for right results.
SUFFIXES = (
    "பட்டுள்ளது", "ப்பட்டுள்ளது", "பட்டது", "படுவது", "க்கும்போது", "ும்போது", "போது", "க்கவோ", "கவோ", "வோ",
    "க்கின்றது", "கின்றது", "க்கின்ற", "கின்ற", "க்கிறது", "கிறது", "க்கின்றன", "கின்றன", "கிற",
    "க்கிறான்", "க்கிறாள்", "க்கிறார்", "க்கிறார்கள்", "கிறான்", "கிறாள்", "கிறார்", "கிறார்கள்",
    "ந்தான்", "ந்தாள்", "ந்தார்", "ந்தார்கள்", "ந்தது", "த்தான்", "த்தாள்", "த்தார்", "த்தார்கள்", "த்தது",
    "ட்டான்", "ட்டாள்", "ட்டார்", "ட்டார்கள்", "ட்டது", "க்கும்", "கும்", "க்க", "க", "உம்",
    "க்கி", "த்து", "ந்து", "ண்டு", "ட்டு", "ிட்ட", "ட்ட", "த்த", "ந்த", "இய", "ய",
    "ங்களின்", "களின்", "ங்களின்", "ங்கள்", "கள்", "னுடைய", "முடைய", "உடைய", "த்திற்கு", "த்துக்கு", "ுக்கு", "க்கு",
    "த்தினுடைய", "த்தினில்", "த்தில்", "த்தினால்", "த்தை", "த்தின்", "த்தன்", "த்து", "உடன்", "ஓடு", "லிருந்து", "இருந்து",
    "லால்", "ஆல்", "லில்", "இல்", "ல்", "னை", "வை", "யை", "ஐ", "ரின்", "னின்", "லின்", "மின்", "யின்", "வின்", "இன்", "ன்",
)
STOPWORDS = (
    "ஒரு", "ஓர்", "இந்த", "அந்த", "இது", "அது", "என்று", "என", "போன்ற", "மட்டுமே", "மற்றும்", "ஆகிய", "போன்றவை", "இவை", "அவை", "உள்ள", "உள்ளது", "வேண்டும்",
    "என்பது", "தன்", "தனது", "அவன்", "அவள்", "அவர்", "அவர்கள்", "நான்", "நாம்", "நீ", "நீங்கள்", "எ", "கா", "முதலியன", "ஆகியவை", "கொண்டு", "கொண்ட", "செய்யும்",
    "வரை", "உண்டு", "இல்லை", "நன்றாக", "அழகாக", "கொடு", "நில்", "செல்கிறேன்", "கூட", "மட்டும்", "ஆன", "ஆக", "உடன்",
)
# Fixed values.
GENUS = ("பகுதி", "வகை", "இடம்", "பொருள்", "ஒன்று", "பெயர்", "நிலை", "முறை")
QUANTITY = (
    "கிலோ", "கிலோகிராம்", "கிராம்", "மில்லிகிராம்", "டன்", "பவுண்டு", "குவிண்டால்", "வீசை", "பலம்", "கழஞ்சு", "துலாம்", "குன்றிமணி", "தொடி", "சேர்", "பவுன்",
    "லிட்டர்", "மில்லிலிட்டர்", "படி", "ஆழாக்கு", "உழக்கு", "மரக்கால்", "நாழி", "குறுணி", "பதக்கு", "கலம்", "முகத்தல்",
    "மீட்டர்", "சென்டிமீட்டர்", "மில்லிமீட்டர்", "கிலோமீட்டர்", "அடி", "இன்ச்", "கஜம்", "மைல்", "சாண்", "முழம்", "விரற்கடை", "காணி", "குழி", "மா", "ஏக்கர்", "ஹெக்டேர்", "சென்ட்",
    "மணி", "வினாடி", "நொடி", "நிமிடம்", "நாழிகை", "நாள்", "வாரம்", "மாதம்", "வருடம்", "ஆண்டு",
    "பங்கு", "பகுதி", "பாகம்", "கூறு", "வீதம்", "விழுக்காடு", "சதவீதம்", "அளவு", "மடங்கு", "ரூபாய்", "காசு", "பைசா", "பணம்",
)
FRACTION_SENSE = ("பங்கு", "நான்கில்", "பாதி", "அரை", "காற்பங்கு", "முக்கால்", "அரைக்கால்", "நாலினொன்று", "பங்கிட்ட", "எண்", "கீழ்வாய்", "பின்னம்", "பின்ன", "கூறு")
SOMATIC = (
    "வலி", "வலிக்கிறது", "வலிக்கும்", "வலித்தது", "நோவு", "நோகிறது", "காயம்", "வீக்கம்", "முறிவு", "முறிந்தது", "சுளுக்கு", "சுளுக்கியது", "தேய்மானம்",
    "நொண்டி", "நொண்டுகிறான்", "நொண்டுகிறாள்", "நலிவு", "புண்", "ரத்தம்", "இரத்தம்", "அடி", "அடிபட்டது",
    "நட", "நடக்க", "நடக்கும்போது", "நடத்தல்", "நடந்தான்", "நடந்தாள்", "ஓடு", "ஓட", "ஓடும்போது", "குதி", "குதித்தல்", "தாவு", "மிதி", "மிதித்தல்",
    "வழுக்கு", "வழுக்கி", "வழுக்கியது", "ஊன்று", "ஊன்றி", "மடக்கு", "நீட்டு", "உடல்", "உறுப்பு", "பாதம்", "கை", "விரல்", "தசை", "எலும்பு", "மூட்டு",
    "தோல்", "சதை", "மருத்துவர்", "சிகிச்சை", "மருந்து",
)
ANATOMY_SENSE = ("உடல் உறுப்பு", "உறுப்பு", "பாதம்", "விலங்கு", "மாந்தர்", "மனிதர்", "தசை", "எலும்பு", "மூட்டு")
FURNITURE = ("நாற்காலி", "முக்காலி", "மேஜை", "மேசை", "கட்டில்", "பீடம்", "இருக்கை", "கருவி", "தூண்", "மஞ்சம்", "பலகை", "வண்டி", "தேர்")
FURNITURE_SENSE = ("நாற்காலி", "முக்காலி", "இருக்கை", "தாங்கி", "தாங்கும் பகுதி", "தாங்கி நிற்கும் பகுதி", "தாங்கி நிற்கும்")
# Fixed values.
CASES = {"nom": "Nominative", "acc": "Accusative", "dat": "Dative", "gen": "Genitive", "loc": "Locative", "soc": "Sociative", "abl": "Ablative", "ins": "Instrumental", "voc": "Vocative"}
NUMBERS = {"pl": "Plural", "sg": "Singular"}
TENSES = {"past": "Past", "pres": "Present", "present": "Present", "fut": "Future", "future": "Future"}
VOWELS = {"aa": "ஆ", "ii": "ஈ", "uu": "ஊ", "ee": "ஏ", "oo": "ஓ", "ai": "ஐ", "au": "ஔ", "a": "அ", "i": "இ", "u": "உ", "e": "எ", "o": "ஒ"}
SIGNS = {"aa": "ா", "ii": "ீ", "uu": "ூ", "ee": "ே", "oo": "ோ", "ai": "ை", "au": "ௌ", "a": "", "i": "ி", "u": "ு", "e": "ெ", "o": "ொ"}
CONSONANTS = {
    "ng": "ங", "nj": "ஞ", "sh": "ஷ", "n2": "ன", "k": "க", "c": "ச", "T": "ட", "t": "த", "p": "ப", "R": "ற", "N": "ண", "n": "ந",
    "m": "ம", "y": "ய", "r": "ர", "l": "ல", "v": "வ", "z": "ழ", "L": "ள", "s": "ஸ", "j": "ஜ", "h": "ஹ",
}
VIRAMA = "்"
TOKEN_SIGNS = "ஂாிீுூெேைொோௌ்ௗ"

# First-match rules of eligibility on the cleaned text, (reason, pattern).
ELIGIBILITY = (
    ("musical_stub", r"^பண்\s*[-:]\s*[\x{0B80}-\x{0BFF}\s]+$"),
    ("speaker_attribution", r"^(?:(?:குறிஞ்சி|முல்லை|மருதம்|நெய்தல்|பாலை)\s*[-:]\s*)?[\x{0B80}-\x{0BFF}\s]{1,40}\s*கூற்று$"),
    ("speaker_attribution", r"^[^\n\.;]{1,70}\s*(?:சொல்லியது|கூறியது|உரைத்தது)$"),
    ("structural_metadata", r"^\d+\s+(?:குறிஞ்சி|முல்லை|மருதம்|நெய்தல்|பாலை)\s*-\s*[\x{0B80}-\x{0BFF}\s\(\)\?]+$"),
    ("structural_metadata", r"^[^\n]+(?:மின்பதிப்பு|\(\d+\s*-\s*\d+\))\s*$"),
    ("structural_metadata", r"^(?:\d+\s+[\x{0B80}-\x{0BFF}\s]{2,25}|(?:அறத்து|பொருட்|காமத்து)ப்பால்(?:\s*\(.*?\))?.*)$"),
)
# Fixed values.
EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
CONTACT_IDS = ("PM-SILAP_MADURAI-0003",)
HEADER_IDS = ("PM-CHINTHAMANI-0003",)
COUPLET_WORKS, COUPLET_PREFIX = ("திருக்குறள்",), "PM-TK-"
APHORISM_WORKS, APHORISM_PREFIXES = ("ஆத்திசூடி", "கொன்றை வேந்தன்"), ("PM-AATHI-", "PM-KONRAI-")
CLASSICAL_PERIODS = ("Sangam", "Epic")
# Headings of divisions, as patterns of a stripped line of at most 60 characters.
HEADING_PATTERNS = (
    r"(?:காண்டம்|காதை|படலம்|பதிகம்|வருக்கம்)$", r"(?:^|\s)அதிகாரம்(?:\s+\d+|\s*:.*)?$", r"^\d+[.\s]+[\x{0B80}-\x{0BFF}\s]+அதிகாரம்$", r"திருமுறை(?:\s*\(.*?\))?$",
    r"^(?:\d+[.\d\s]*\s+)?[\x{0B80}-\x{0BFF}]{3,15}(?:வியல்|இயல்)$", r"^(?:பகுதி|பாகம்)\s*[-:]?\s*\d+", r"^(?:முதல்|இரண்டாம்|மூன்றாம்|நான்காம்)\s*(?:பகுதி|பாகம்)$",
    r"^(?:கடவுள் வாழ்த்து|நூல் முகம்|தற்சிறப்புப் பாயிரம்|பொதுப் பாயிரம்|சிறப்புப் பாயிரம்)$",
)
NO_HEADING = r"[,.;?!]$"
DIVISION_END = "வருக்கம்"
# Titles that stand in collections, sections of the couplets, labels after a verse number.
COLLECTION_TITLES = ("ஆத்திசூடி", "கொன்றை வேந்தன்", "மூதுரை", "நல்வழி")
COUPLET_SECTIONS = ("அறத்துப்பால்", "பொருட்பால்", "காமத்துப்பால்")
LAND_DIVISIONS = ("குறிஞ்சி", "முல்லை", "மருதம்", "நெய்தல்", "பாலை")
OPENING_LABELS = ("கடவுள் வாழ்த்து", "நூல்", "பாயிரம்", "சிறப்புப் பாயிரம்", "பொதுப் பாயிரம்")
SCENE_LABELS = ("கூற்று", "திணை", "துறை", "பாடியவர்")
# What marks a block as boilerplate of the source's pages (in lower case; anywhere; the whole block; in short blocks).
BOILERPLATE_LOWER = ("in tamil script", "unicode format", "unicode encoding", "unicode/utf-8", "utf-8 format")
BOILERPLATE = (
    "Project Madurai", "மதுரைத் திட்டம்", "உள்ளுறை அட்டவணைக்குத் திரும்ப", "அட்டவணைக்குத் திரும்ப", "இம்மின்னுரை", "மின்னூலாக்கம்", "உரிமை - பொதுக் களம்", "இப்பதிவினைச் செய்தவர்கள்", "கி.ஆ.பெ.விசுவநாதம்",
    "Our Sincere thanks go to", "Our sincere thanks go to", "Sincere thanks go to", "This webpage presents", "This page was first put up", "To view the Tamil text correctly", "Unicode fonts containing Tamil Block",
    "Feel free to send the corrections", "send the corrections by email", "In case of difficulties send an email", "தட்டச்சு செய்தவர்", "பிழை திருத்தியவர்", "சரிபார்த்தவர்",
)
BOILERPLATE_WHOLE = ("உள்ளடக்கம்", "பொருளடக்கம்", "பொருள் அடக்கம்", "உள்ளுறை", "பொருளடக்கம்:")
BOILERPLATE_SHORT = (
    "(எட்டுத்தொகை நூல்களில் ஒன்று)", "(ஐம்பெருங்காப்பியங்களில் ஒன்று)", "எட்டுத்தொகை நூல்களுள் ஒன்றான", "(பதினெண்கீழ்க்கணக்கு நூல்களில் ஒன்று)", "(பதினென் கீழ்க்கணக்கு நூல்)", "(பதினெண்கீழ்க்கணக்கு நூல்)", "(பதினெண் கீழ்க்கணக்கு நூல்)",
    "(ஆசிரியர் - சீத்தலைச்சாத்தனார்)",
)
BOILERPLATE_PLACE = r"^இத்தலம்\s+[\x{0B80}-\x{0BFF}\s]+நாட்டிலுள்ளது\s*\.?$"
# Where a work begins and ends in a file of several works: work id, start marker, end marker.
SECTION_MARKERS = (
    ("AATHI", "1.  ஆத்திசூடி", "2.  கொன்றை வேந்தன்"), ("KONRAI", "2.  கொன்றை வேந்தன்", "3.  மூதுரை"), ("MOODHURAI", "3.  மூதுரை", "4.  நல்வழி"), ("NALVAZHI", "4.  நல்வழி", None),
    ("INIYAVAI", "இனியவை நாற்பது : பூதஞ்சேந்தனார்", "3.  களவழி நாற்பது"), ("ELATHI", "2. கணிமேதையார் அருளிய", "3. காரியாசான்"), ("SIRUPANCHA", "3. காரியாசான்", "சிறுபஞ்சமூலம் முற்றிற்று"),
    ("THIRUPPALLANDU", "பெரியாழ்வார் அருளிச்செய்த   திருப்பல்லாண்டு", "பெரியாழ்வார் திருமொழி"), ("THIRUPPAVAI", "ஸ்ரீ ஆண்டாள் அருளிச் செய்த திருப்பாவை", "ஸ்ரீ: ஆண்டாள் அருளிச்செய்த நாச்சியார் திருமொழி"),
)
# Fractions a sense may name (words in it, gloss, sign), and what a unit is called in the gloss.
FRACTIONS = (
    (("நான்கில் ஒரு பங்கு", "காற்பங்கு", "1/4"), "நான்கில் ஒரு பங்கு", "¼"), (("பாதி", "அரை", "1/2"), "பாதி (இரண்டில் ஒரு பங்கு)", "½"), (("முக்கால்", "3/4"), "முக்கால் பங்கு", "¾"), (("அரைக்கால்", "1/8"), "அரைக்கால் பங்கு", "⅛"),
)
UNIT_GENITIVES = {
    "கிலோ": "கிலோவின்", "கிலோகிராம்": "கிலோகிராமின்", "கிராம்": "கிராமின்", "லிட்டர்": "லிட்டரின்", "மில்லிலிட்டர்": "மில்லிலிட்டரின்", "மீட்டர்": "மீட்டரின்", "கிலோமீட்டர்": "கிலோமீட்டரின்", "மணி": "மணியின்",
    "படி": "படியின்", "ஆழாக்கு": "ஆழாக்கின்", "பலம்": "பலத்தின்", "வீசை": "வீசையின்", "ரூபாய்": "ரூபாயின்",
}
QUARTERS = {
    "கிலோ": "¼ kg / 250g", "கிலோகிராம்": "¼ kg / 250g", "லிட்டர்": "¼ L / 250ml", "மீட்டர்": "¼ m / 25cm", "கிலோமீட்டர்": "¼ km / 250m", "மணி": "15 நிமிடங்கள் / ¼ hour", "ரூபாய்": "25 பைசா / ¼ rupee",
}
SHARES = ("பங்கு", "பகுதி", "பாகம்", "கூறு")
BODY_PREFIX, BODY_START = "உடல் உறுப்பு / பாதம் — ", "உடல் உறுப்பு"
SUPPORT_START = "நாற்காலியைத் தாங்கும் பகுதி"
CLASSICAL_WORKS = ("குறுந்தொகை", "நற்றிணை", "புறநானூறு", "அகநானூறு", "கலித்தொகை", "பரிபாடல்", "பதிற்றுப்பத்து", "சிலப்பதிகாரம்", "மணிமேகலை", "சீவக சிந்தாமணி")
