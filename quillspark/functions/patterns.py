"""Fixed values that results depend on: word lists, patterns and small catalogs, in natural order."""

# Marginalia: lines that are page furniture. Fixed values, in natural order and case; a whole stripped line must match.
MARGINALIA = [
    r"\d{1,4}", r"\d{1,4}\s*", r"\s*\d{1,4}\s*", r"\d{1,4}\s*[-–—]\s*", r"[-–—]\s*\d{1,4}\s*[-–—]",
    r"[ivxlcdm]{1,7}", r"[IVXLCDM]{1,7}",
    r"(page|chapter|ch\.|chap)\s*\d+", r"\d+\s+(chapter|ch\.|chap|page)\s*\d*", r"chapter\s+[ivxlcdm]+", r"chapter\s+[IVXLCDM]+",
    r"[A-Z][a-z]+\s+Story", r"The\s+[A-Z][a-z]+\s+Story", r"[A-Z][a-zA-Z\s]+,\s+Independence", r"Growing\s+Up", r"The\s+Japanese\s+Invaders?",
    r"After\s+the\s+Liberation", r"My\s+[A-Z][a-zA-Z\s]+\s+Days", r"Work,\s+Wedding\s+and\s+Politics",
    r"[A-Z][A-Z\s]{10,50}", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){2,8}",
    r"[\-_=]{3,}", r"\s*[|\-_=•]{2,}\s*", r"\s*(left|right|verso|recto)\s*", r"\s*\*{2,}\s*", r"\s*#{2,}\s*",
    r"©.*", r"copyright.*", r"\d{4}.*copyright.*", r"ISBN.*", r"published.*",
    r"\d+\s+of\s+\d+", r"page\s+\d+\s+of\s+\d+",
    r"[a-zA-Z]", r"[a-zA-Z]{1,2}\d*", r"\d+[a-zA-Z]{1,2}",
]
REAR_MATTER = ["index", "glossary", "chronology", "appendix", "bibliography", "references", "notes", "colophon", "about the author", "afterword", "acknowledgements"]
ATTRIBUTION_VERBS = ["said", "asked", "replied", "answered", "whispered", "shouted", "exclaimed", "declared", "announced", "stated", "remarked", "observed", "noted", "added", "continued", "explained", "insisted", "protested", "admitted", "confessed", "agreed", "disagreed", "argued", "countered", "interrupted", "interjected"]
SEGMENT_VERBS = ["said", "asked", "replied"]
NOT_SPEAKERS = ["said", "asked", "replied", "answered", "told", "explained", "continued", "however", "therefore", "moreover", "furthermore", "meanwhile", "consequently", "chapter", "section", "part", "page", "book", "story", "novel", "author", "narrator", "voice", "character", "person", "people", "everyone", "someone", "anyone", "nobody", "everybody", "somebody", "anybody"]
FORMAL = ["therefore", "however", "furthermore", "moreover", "consequently", "nevertheless", "nonetheless", "accordingly", "thus", "hence"]
CASUAL = ["yeah", "okay", "yep", "nope", "gonna", "wanna", "gotta", "dunno", "kinda", "sorta"]
EXCITED = ["amazing", "awesome", "fantastic", "incredible", "wonderful", "excellent"]
CALM = ["certainly", "indeed", "perhaps", "possibly", "naturally", "obviously", "clearly"]
# Spoken forms: pattern and replacement, in order of application.
SPELT = [
    (r"(?i)\bA\.M\.?\b", "A M"), (r"(?i)\bP\.M\.?\b", "P M"), (r"\bAM\b", "A M"), (r"\bPM\b", "P M"),
    (r"(?i)\bU\.S\.A\.?\b", "U S A"), (r"(?i)\bU\.K\.?\b", "U K"), (r"(?i)\bF\.B\.I\.?\b", "F B I"), (r"(?i)\bC\.I\.A\.?\b", "C I A"), (r"(?i)\bN\.A\.S\.A\.?\b", "N A S A"),
    (r"\bUSA\b", "U S A"), (r"\bUK\b", "U K"), (r"\bFBI\b", "F B I"), (r"\bCIA\b", "C I A"), (r"\bNASA\b", "N A S A"),
]
DEGREES = [(r"(?i)\bPh\.?D\.?\b", "P H D"), (r"(?i)\bM\.?D\.?\b", "M D"), (r"(?i)\bM\.?A\.?\b", "M A"), (r"(?i)\bB\.?A\.?\b", "B A")]
TITLES = [(r"\bDr\.", "Doctor"), (r"\bMr\.", "Mister"), (r"\bMrs\.", "Missus"), (r"\bMs\.", "Miss"), (r"\bProf\.", "Professor"), (r"\bSt\.", "Saint"), (r"\bAve\.", "Avenue"), (r"\bRd\.", "Road")]
UNITS = [
    (r"\b(\d+)\s*ft\.?\b", "$1 feet"), (r"\b(\d+)\s*in\.?\b", "$1 inches"), (r"\b(\d+)\s*lbs?\.?\b", "$1 pounds"), (r"\b(\d+)\s*kg\.?\b", "$1 kilograms"),
    (r"\b(\d+)\s*mph\b", "$1 miles per hour"), (r"\b(\d+)\s*km/h\b", "$1 kilometers per hour"),
]
NUMBERS = [(r"\b19(\d{2})\b", "nineteen $1"), (r"\b20(\d{2})\b", "twenty $1"), (r"\b(\d{1,3}),(\d{3})\b", "$1 thousand $2"), (r"\b([A-Z])\. ([A-Z][a-z]+)\b", "$1 $2")]
# Clause separators of an over-long sentence: pattern and the separator put back.
CLAUSES = [
    (r";\s+", "; "), (r",\s+(?=\w+ing\b|\w+ed\b|which|that|who|where|when|while|although|because|since|if|unless|after|before)", ", "), (r",\s+", ", "),
    (r"\s+(?:and|but|or|yet|so|for|nor)\s+", " "), (r"\s+[-–—]\s+", " - "), (r"\s+", " "),
]
# Voice id, traits: the catalog of the greedy assigner.
VOICES = [("jenny_female_us", ["warm", "professional", "clear"]), ("david_male_us", ["authoritative", "deep", "formal"]), ("mary_female_uk", ["gentle", "sophisticated", "calm"]), ("narrator_neutral", ["steady", "clear", "narrative"])]
# Our own marker words, a parameter of the language profile.
LANG_MARKERS = [("de", ["der", "die", "und", "den", "ist", "nicht", "zu"]), ("en", ["the", "and", "of", "to", "is", "that", "for"]), ("es", ["el", "los", "las", "una", "por", "del", "para"]), ("fr", ["le", "les", "des", "et", "une", "du", "pour"])]
# Titles by patterns over a page's text, in order. Fixed values.
TITLE_PATTERNS = [r"The\s+([A-Z][a-zA-Z\s]+)\s+Story", r"The\s+([A-Z][a-zA-Z\s]{5,30})", r"Memoirs?\s+of\s+([A-Z][a-zA-Z\s\.]{5,40})", r"^([A-Z][a-zA-Z\s]{10,50})$"]
# Display names of languages. Fixed values; others are their code with a capital.
LANG_NAMES = {"en": "English", "ms": "Malay", "zh": "Chinese", "zh-cn": "Chinese", "ta": "Tamil", "hi": "Hindi", "af": "Afrikaans", "unknown": "Unknown"}
# Voices of the scoring assigner: id, class, description. Fixed values.
SCORED_VOICES = [
    ("p225", "female", "Female English"), ("p226", "male", "Male English"), ("p227", "male", "Male English Deep"), ("p228", "female", "Female English Soft"),
    ("p229", "female", "Female English Clear"), ("p230", "female", "Female English Warm"), ("p231", "female", "Female English Professional"), ("p232", "male", "Male English Narrator"),
    ("p233", "female", "Female English Bright"), ("p234", "female", "Female English Calm"), ("p236", "female", "Female English Gentle"), ("p237", "male", "Male English Strong"),
    ("p238", "female", "Female English Confident"), ("p239", "female", "Female English Smooth"), ("p240", "female", "Female English Authoritative"), ("p241", "male", "Male English Serious"),
    ("p243", "male", "Male English Friendly"), ("p244", "male", "Male English Relaxed"), ("p245", "male", "Male English Dynamic"), ("p246", "male", "Male English Crisp"),
    ("p247", "male", "Male English Rich"), ("p248", "female", "Female English Elegant"), ("p249", "female", "Female English Melodic"), ("p250", "female", "Female English Expressive"),
]
# Paragraphs: what a line starts with if it opens one, and if it continues the one before, without regard to case. Fixed values.
OPENERS = [r"(Chapter|Section|Part|\d+\.|•|\*|-)\s", r"\"", r"[A-Z][a-z]+,", r"In \d{4}"]
CONTINUATIONS = [
    r"(and|or|but|yet|so|for|nor)\s", r"(because|since|although|though|while|whereas)\s", r"(that|which|who|whom|whose|where|when|why|how)\s",
    r"(to|from|with|without|under|over|through|during)\s", r"(he|she|it|they|we|you|I)\s",
]
UNFINISHED = "[^.!?:;]$"  # a paragraph that ends so goes on
SECTION_WORDS = ["chapter", "section", "part"]  # a line that starts so is not joined in the second pass
