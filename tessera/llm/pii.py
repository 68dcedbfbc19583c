"""Personal information in free text: typed spans and the text with placeholders (problem 7).

Patterns propose spans, check digits confirm them, and words nearby raise or lower the score; a span is kept from
a score of 1 on. Names of persons are proposed as sequences of capitalised words, initials and particles in any
script (and of words in any case where a lexicon has one); the lexicon, titles, words like "written by", other
personal data beside them and how ordinary their words are add up to the score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe

KINDS = ("email", "id_number", "phone", "address", "name")  #: of overlapping spans the kind named first wins
LEXICON_ROWS = 200_000  #: a reference list, checked; beyond that the caller has to cut it
SLICE_ROWS = 512


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# --- check digits ---------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """The Luhn check of card and insurance numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return bool(digits) and total % 10 == 0


def mod97_key(digits: str) -> bool:
    """A body of thirteen digits followed by the two-digit key 97 - body mod 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def letter_23(number: str) -> bool:
    """Eight digits and the letter that stands for their remainder by 23."""
    # Fixed value: the letters in order of the remainder.
    return len(number) == 9 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number[:8]) % 23] == number[8].upper()


def mod11_10(digits: str) -> bool:
    """ISO 7064 mod 11,10 over eleven digits."""
    product = 10
    for d in digits[:-1]:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return len(digits) == 11 and (11 - product) % 10 == int(digits[-1])


# --- patterns -------------------------------------------------------------------------------------

_GAP = r"[ \t   ]"
_AT_SIGNS = ("@", "＠", "&#64;", "&#x40;", "%40")
_AT_LINKS = ("_at_", "_AT_")
_AT_BRACKETS = rf"[\[({{<]{_GAP}?(?:at|AT|At){_GAP}?[\])}}>]"
_AT = rf"(?:{_GAP}?(?:{'|'.join(_AT_SIGNS)}){_GAP}?|{_GAP}?{_AT_BRACKETS}{_GAP}?|{'|'.join(_AT_LINKS)})"
_DOT = rf"(?:\.|{_GAP}?[\[({{<]{_GAP}?(?:dot|DOT|Dot){_GAP}?[\])}}>]{_GAP}?|{_GAP}+(?:dot|DOT){_GAP}+|_dot_|_DOT_)"
_LOCAL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_EMAIL = re.compile(rf"{_LOCAL}{_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])")
_EMAIL_WORDS = re.compile(rf"{_LOCAL}{_GAP}+(?:at|AT){_GAP}+{_HOST}(?:{_GAP}+(?:dot|DOT){_GAP}+{_HOST})*{_GAP}+(?:dot|DOT){_GAP}+[A-Za-z]{{2,24}}(?![A-Za-z0-9])")

# Without what these find, the costlier patterns above find nothing.
_AT_WORD = re.compile(_AT_BRACKETS)
_DOT_WORD = re.compile(rf"{_GAP}(?:dot|DOT){_GAP}")

# Labels of numbers that identify a person.
_ID_LABEL = re.compile(
    r"(?i)(?<![a-z])(?:SSN|soc(?:ial|\.)? sec(?:urity|\.)? ?(?:no\b\.?|number|nr\b\.?|#)|social insurance (?:no\b\.?|number)|(?:national )?insurance (?:no\b\.?|number)"
    r"|N\.?I\.? (?:no\b\.?|number)|NINO|NIR|num[ée]ro de s[ée]curit[ée] sociale|n[°º] de s[ée]curit[ée] sociale|tax(?:payer)? (?:ID|identification)(?: no\b\.?| number)?|TIN|ITIN"
    r"|steuer-?id(?:entifikationsnummer|entnummer|-nr\b\.?)?|steuernummer|sozialversicherungsnummer|passport(?: no\b\.?| number| nr\b\.?)?|reisepass(?:-?nr\b\.?|nummer)?|passeport(?: n[°º])?|pasaporte(?: n\.º| núm\.)?"
    r"|national ID(?: no\b\.?| number| card)?|identity (?:card|no\b\.?|number)(?: no\b\.?| number)?|ID card(?: no\b\.?| number)?|ID (?:no\b\.?|number)|personalausweis(?:-?nr\b\.?|nummer)?|carte d['’]identit[ée](?: n[°º])?"
    r"|DNI|NIF|NIE|CPF|INSEE|PESEL|BSN|AHV|student (?:ID|no\b\.?|number|card)(?: no\b\.?| number)?|matric(?:ulation)? (?:no\b\.?|number)|matrikel-?(?:nr\b\.?|nummer)|enrol?ment (?:no\b\.?|number)"
    r"|n[°ºo]\.? d['’]étudiant|numéro d['’]étudiant|паспорт|СНИЛС|ИНН|身份证号?码?|护照号?码?|学号)(?![a-z])"
)
_ID_BETWEEN = re.compile(r"[ \t ]*(?:(?:no|nr|number|num|n)\b\.?|n[°º]|#)?[ \t ]*(?:[:：=|(（#,，]|is\b|ist\b|est\b|es\b|是|为|was\b|lautet\b)?[ \t ]*[(]?", re.I)
_ID_NUMBER = re.compile(r"(?:[A-Z]{1,3}[ \-]?)?\d(?:[  .\-/]?[A-Z]?\d)*(?:[  \-]?[A-Z](?![A-Za-z]))?")
_ID_BARE = re.compile(
    r"(?<![\w.\-+$^/=])(?:(?P<nino>[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D])|(?P<nir>[12][  ]?\d\d[  ]?\d\d[  ]?\d\d[  ]?\d{3}[  ]?\d{3}[  ]?\d\d|\d[  ]\d\d[  ]\d\d[  ]\d\d[  ]\d{3}[  ]\d{3}[  ]\d\d|\d[  ]\d\d[  ]\d\d[  ]\d\d[  ]\d\d[A-Z\d]?[  ]\d{3}[  ]\d{3}[  ]\d\d)"
    r"|(?P<dni>\d{8}-?[A-Z])|(?P<card>[A-Z]\d{3}[A-Z]\d{3}[A-Z]\d)|(?P<tax>\d{2} ?\d{3} ?\d{3} ?\d{3})|(?P<nine>\d{3}[ \-]?\d{3}[ \-]?\d{3}))(?![\w\-^]|[.,]\d)"
)
# How sure each form alone makes it; what is under 1 needs its check digit or words nearby.
_ID_SCORE = {"nino": 1.0, "nir": 0.4, "dni": 0.4, "card": 0.8, "tax": 0.15, "nine": 0.1}
_LONG = re.compile(r"\d(?:[ \u00a0\u202f\-]?[0-9A-Z]){5,}")  # a run of digits, letters between
_ID_WEAK = re.compile(r"(?<![A-Za-z])(?:ID|Id|id|I\.D\.|ident(?:ification|ity|ifier)?|Ident(?:ification|ity|ifikation|ifier)?|identité|identidad|[Pp]ersonal number|[Pp]ersonennummer|[Kk]ennnummer|[Kk]ennziffer|[Cc]édula|удостоверени[ея]|证件号?码?)(?![A-Za-z])[.]?")
_ID_PERSON = re.compile(r"(?i)(?<![a-z])(?:born|citizen|resident|holder|patient|employee|applicant|insured|taxpayer|member|student|pupil|bürger|versicherte|geboren|inhaber|née?|titulaire|assurée?|citoyen|ciudadan[oa]|nacid[oa]|titular|гражданин|родил[а-я]+|出生|公民)(?![a-z])")

_S = r"[ .\-   ‑]"
_PHONE = re.compile(
    rf"(?<![\w.+\-/^$])(?:"
    rf"(?P<world>(?:\+|00){_S}?[1-9]\d{{0,2}}{_S}?(?:\(0\){_S}?)?(?:\(\d{{1,4}}\){_S}?)?\d(?:[{_S[1:-1]}/]?\d){{6,11}})"
    rf"|(?P<ten>(?:1{_S})?(?:\([2-9]\d\d\){_S}?|[2-9]\d\d{_S})\d{{3}}{_S}\d{{4}})"
    rf"|(?P<eleven>1[2-9]\d{{9}})"
    rf"|(?P<pairs>0[1-9](?:{_S}\d\d){{4}})"
    rf"|(?P<national>(?:\(0[1-9]\d{{1,3}}\)|0[1-9]\d{{1,3}})[{_S[1:-1]}/]?\d{{3,8}}(?:{_S}?\d{{2,4}}){{0,2}})"
    rf"|(?P<nine>[6-9]\d\d(?:{_S}\d\d{_S}\d\d{_S}\d\d|{_S}\d{{3}}{_S}\d{{3}}))"
    rf"|(?P<local>[2-9]\d\d-\d{{4}})"
    rf")(?![\w/]|[\-.]\d|{_S}\d)"
)
_DIALLED = re.compile(rf"[+(\d][{_S[1:-1]}()/\d]{{6,}}")  # where a telephone number may stand
# How sure each shape alone makes it, and words nearby that speak for or against a telephone number.
_PHONE_SCORE = {"world": 1.0, "ten": 0.7, "eleven": 0.6, "pairs": 0.7, "national": 0.65, "nine": 0.6, "local": 0.2}
_PHONE_FOR = re.compile(r"(?i)(?<![a-z])(?:tel|tél|telefon|telefonisch|telephone|téléphone|teléfono|phone|fax|mobile|mobil|cell|handy|portable|móvil|call|ring|dial|text|sms|whatsapp|hotline|help ?desk|office|line|contact|erreichbar|unter|ruf|ruft|anruf|anrufen|rückfragen|llam[ae]|llamar|appelez|appeler|joindre|reach|number|nummer|numéro|número)(?![a-z])|电话|手机|致电|拨打|联系|телефон|тел\.|звоните|справок|номер")
_SENTENCE = re.compile(r"[.!?。]\s+(?=[^\W\d_a-z])")
_COUNTED = re.compile(r"[ \t][^\W\d_]{3,}")  # a bare number before a noun counts something
_PHONE_AGAINST = re.compile(r"(?i)pattern|interval|range|order|exercise|version|isbn|issn|doi|compute|calculator|sequence|key|code|equation|remainder|sum of|digits|≈|approx")

_EN_TYPE = r"(?:Street|Road|Avenue|Lane|Drive|Close|Way|Crescent|Terrace|Court|Place|Square|Boulevard|Grove|Gardens|Hill|Row|Walk|Mews|Parkway|Highway|St|Rd|Ave|Ln|Dr|Cl|Cres|Ter|Ct|Pl|Sq|Blvd)"
_W = r"[A-ZÀ-ÖØ-ÞŁ][\w'’]*"
_FR_TYPE = r"(?:rue|avenue|av\.|boulevard|bd|impasse|chemin|place|allée|allee|quai|route|cours|passage|ruelle|sentier|square|Rue|Avenue|Boulevard|Impasse|Chemin|Place|Allée|Quai|Route)"
_FR_LINK = r"(?:(?:de la|de l['’]|du|des|de|d['’]|la|le|les|l['’]|aux|au|à la|en) ?)"
_FR_NAME = rf"{_FR_LINK}{{0,2}}{_W}(?:-[\w'’]+)*(?: {_FR_LINK}?{_W}(?:-[\w'’]+)*){{0,3}}"
_EN = re.compile(rf"(?<![\w.,/\-])\d{{1,4}}(?:{_GAP}?[A-Z])?,?{_GAP}(?:(?:North|South|East|West|N\.|S\.|E\.|W\.|NORTH|SOUTH|EAST|WEST){_GAP})?(?:{_W}{_GAP}){{1,3}}?(?:{_EN_TYPE}|{_EN_TYPE.upper()})(?![\w'’])")
_FR = re.compile(rf"(?<![\w.,/\-])\d{{1,4}}(?:{_GAP}?[a-zA-Z](?![\w'’])|{_GAP}(?:bis|ter|quater))?,?{_GAP}{_FR_TYPE}{_GAP}{_FR_NAME}")
_FR_UPPER = re.compile(rf"(?<![\w.,/\-])\d{{1,4}}(?:{_GAP}(?:BIS|TER))?,?{_GAP}(?:RUE|AVENUE|BOULEVARD|IMPASSE|CHEMIN|PLACE|ALLÉE|QUAI|ROUTE)(?:{_GAP}[A-ZÀ-ÖØ-Þ'’\-]{{2,}}){{1,5}}")
_HOUSE = rf"{_GAP}\d{{1,4}}(?:{_GAP}?[a-zA-Z](?![\w'’]))?(?![\w/]|[.,]\d)"
_DE_TAIL = r"(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer|ring|steig|pfad|STRASSE|STRAßE|STR\.|GASSE|WEG|PLATZ|ALLEE|DAMM|UFER|RING)"
_DE = re.compile(rf"(?<![\w'’])(?:{_W}(?:-{_W})*?{_DE_TAIL}|{_W}(?:-|{_GAP})(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee)){_HOUSE}")
_DE_AT = re.compile(rf"(?<![\w'’])(?:Am|An der|An den|Auf dem|Auf der|Unter den|Hinter dem|Hinter der|Zum|Zur|AM|AN DER|AUF DEM){_GAP}(?P<am>[A-ZÄÖÜ][\wäöüß\-]+){_HOUSE}")
_ES = re.compile(
    rf"(?<![\w'’])(?:[Cc]alle|C/|c/|[Aa]vda\.?|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Tt]ravesía|[Cc]uesta|CALLE|AVDA\.?|AVENIDA|PLAZA|PASEO){_GAP}?(?:(?:de los|de las|de la|del|de|DE LA|DEL|DE){_GAP})?{_W}(?:{_GAP}(?:(?:de la|del|de|y){_GAP})?{_W}){{0,3}},?"
    rf"{_GAP}(?:(?:n\.º|núm\.|n\.°|nº|n°|número|No\.|N\.º|NÚM\.){_GAP}?)?\d{{1,4}}(?:{_GAP}?[A-Za-z](?![\w'’]))?(?![\w/]|[.,]\d)"
)
# What follows such a preposition in other phrases.
_NO_STREET = {"jahr", "jahre", "fall", "ende", "anfang", "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag", "kapitel", "abschnitt", "beispiel", "schritt", "punkt", "teil", "aufgabe", "seite", "zeit", "uhr", "zahl", "stelle", "übung", "blatt", "tag", "januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"}
_BOX = re.compile(rf"(?<![\w.])(?:P\.?{_GAP}?O\.?{_GAP}?Box|p\.o\. box|PO BOX|P\.O\. BOX|Post Office Box|Postfach|POSTFACH|Boîte postale|boîte postale|B\.?P\.?|Apartado(?:{_GAP}de{_GAP}[Cc]orreos)?|Apdo\.?(?:{_GAP}de{_GAP}[Cc]orreos)?|Casilla(?:{_GAP}postal)?|а/я){_GAP}(?:n[°º.]{_GAP}?)?\d{{1,6}}(?:{_GAP}\d\d)?(?![\w]|[.,]\d)")

# Lower-case strings at which the costlier patterns are tried, by pattern.
_TRIGGERS = {
    "id": "ssn|soc. sec|social sec|soc sec|social insurance|insurance n|ni n|n.i. n|nino|nir|curité sociale|tax id|taxpayer id|itin|steuer-id|steuerid|steuernummer|sozialvers|passport|reisepass|passeport|pasaporte|national id|identity card|identity n|id card|id n|personalausweis|carte d|dni|nif|nie|cpf|insee|pesel|bsn|ahv|student id|student n|student card|matric|matrikel|enrolment n|enrollment n|étudiant|паспорт|снилс|инн|身份证|护照|学号".split("|"),
    "en": [f" {x.lower()}" for x in _EN_TYPE[3:-1].split("|")],
    "fr": [f" {x}" for x in "rue|avenue|av.|boulevard|bd|impasse|chemin|place|allée|allee|quai|route|cours|passage|ruelle|sentier|square".split("|")],
    "de": "straße|strasse|str.|gasse|weg|platz|allee|damm|ufer|ring|steig|pfad".split("|"),
    "es": "calle|c/|avda|avenida|plaza|paseo|camino|ronda|travesía|cuesta".split("|"),
    "am": ["am ", "am\u00a0", "an der", "an den", "auf de", "unter den", "hinter de", "zum ", "zur ", "zum\u00a0", "zur\u00a0"],
    "box": "box|postfach|postale|bp|b.p|apartado|apdo|casilla|а/я".split("|"),
}

# --- names ----------------------------------------------------------------------------------------

# Titles before names, and words that stand before a family name without being a given name.
_TITLES = set("dr prof mr mrs ms miss sir mme mlle herr frau sra sr srta don doña dra professor profesor profesora professeur lehrer lehrerin teacher tutor docteur доктор проф м".split())
_NOT_GIVEN = set(
    "the a an and or of by to from with for at in on as is are was were this that these those see use using both like since when if but not no also per via under over about between "
    "name names contact contacts author authors maintainer written posted asked graded homework thanks thank danke merci gracias regards sincerely yours best dear hello hi "
    "der die das ein eine und oder von mit für nach bei im am zum zur den dem des nicht auch an auf als wie siehe satz lemma ungleichung grüße beste viele bearbeitet autor "
    "le la les un une et ou de du des avec pour par chez au aux à sur dans comme selon auteur cordialement voir "
    "el los las uno una y o con por para en al del segun según como autor saludo saludos ver "
    "и или в на с по от для как это theorem inequality conjecture identity formula rule method proof corollary proposition equation lemma’s support office our pupil student class key reader second first place worksheet".split()
)
# What follows a family name that stands for a result of mathematics.
_RESULT = re.compile(r"(?i)(?:['’]s)?[  ]+(?:lemma|theorem|inequality|conjecture|identity|formula|criterion|method|rule|constant|number|matrix|series|transform|function|algorithm|ungleichung|satz|théorème|inégalité|teorema|desigualdad)\b")
# Words after which a person is named, and titles; the first group is sure, the second is not.
_NAME_CUE = re.compile(
    r"(?i)(?<![^\W\d_])(?:(?P<sure>(?:written|posted|asked|graded|checked|submitted|prepared|solved|answered|reviewed|edited|translated|created|compiled|taught|contributed|signed|marked|corrected|drawn|sent|given) by|(?:verfasst|geschrieben|bearbeitet|gestellt|eingereicht|korrigiert|übersetzt) von|(?:écrit|posé|rédigé|corrigé|proposé) par|(?:escrito|corregido|enviado|resuelto|propuesto) por"
    r"|(?:full |first |last |family )?names?|vorname|nachname|nom|nombre|authors?|autor(?:in)?|auteur|autora|maintainers?|contact|kontakt|tutor|teacher|lehrer(?:in)?|student|pupil|schüler(?:in)?|élève|alumn[oa]|instructor|editor|(?:from|to|cc|attn)(?=[ \t]?[:：])|homework of|thanks(?: to)?|thank you|danke(?: an)?|merci(?: à)?|gracias(?: a)?|regards|sincerely|grüße(?:n)?|grüßen|cordialement|saludos?|hochachtungsvoll|signed|gezeichnet|copyright|dear|\\\\author)|(?P<weak>by|von|par|por|with|mit|avec|con|und|and|et|y|&|hello|hi|hallo|bonjour|hola))"
    r"[ \t]?[:：,.]?[{(]?[ \t]*(?:\r?\n[ \t]*)?[|]?[ \t]*$|(?:\(c\)|©)[ \t]*(?:\d{4}[ \t,]*)?$|(?:автор|имя|от|спасибо|谢谢|作者|姓名|老师|教授|感谢)[:：,，]?[ \t]*$"
)
_TITLE = re.compile(r"(?i)(?<![^\W\d_])(?:dr|prof|mrs?|ms|miss|sir|mme|mlle|herrn?|frau|sra?|srta|don|doña|dra|professor(?:in)?|profesora?|professeur|docteur|доктор|проф|м)\.?[ \t   ]{1,2}$|(?:教授|老师|先生|女士)$")
# Ends of what introduces persons, in lower case; a capital after one of them is looked at.
_CUES = "by|von|par|por|name|vorname|nachname|nom|nombre|names|author|authors|autor|autorin|auteur|autora|maintainer|contact|kontakt|tutor|teacher|lehrer|lehrerin|student|pupil|élève|alumno|alumna|instructor|editor|from|to|cc|attn|of|danke an|merci à|gracias a|regards|sincerely|gruß|grüße|grüßen|cordialement|saludo|saludos|signed|copyright|dear|hello|dr|prof|mr|mrs|ms|miss|sir|mme|mlle|herr|herrn|frau|sr|sra|srta|doña|dra|professor|professorin|profesora|profesor|professeur|docteur|автор|спасибо|danke|merci|gracias|thanks|thank you|доктор|проф|谢谢|作者|姓名|教授|感谢|老师".split("|")
_AFTER_CUE = re.compile(r"(?:\.?[ \t   ]{1,2}|[ \t]?[:：,.]?[{(]?[ \t]*(?:\r?\n[ \t]*)?[|]?[ \t]*)(?=[^\W\d_])")
_JOINED = re.compile(r",?[ \t\n]{1,2}(?:and|und|et|y|e|&|и|和)[ \t\n]{1,2}(?=[^\W\d_])")
_NEXT = re.compile(r"-?[^\W\d_]*[ \t\u00a0\u202f\u2009]{1,2}([^\W\d_]+)")
_WORD = r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]{2})|[\u0300-\u036f])*"
_PIECE = re.compile(rf"(?P<initial>[^\W\d_]\.(?:-?[^\W\d_]\.)*)|(?P<word>{_WORD}(?:-{_WORD})*)|(?P<comma>,)")
_PARTICLES = frozenset("van de der den von della dalla del la los di da dos du des ter ten zu zur zum el al bin ibn le af av y".split())
_SPACE = frozenset(" \t\u00a0\u202f\u2009")
_REACH = 70  #: characters of its line on either side of an anchor in which a name is looked for


class Piece(NamedTuple):
    start: int
    end: int
    text: str
    low: str
    kind: str


class NameFinder:
    """Proposes and scores names of persons; made from the lexicon and a public vocabulary, once per worker.

    ``ranks`` is a byte-pair vocabulary by frequency: a word that has a token of its own in lower case, sooner than
    with a capital, is an ordinary word.
    """

    def __init__(self, lexicon: Iterable[tuple[str | None, str | None]], ranks: dict[bytes, int] | None = None):
        rows = [(w.strip().lower(), k) for w, k in lexicon if w and w.strip()]
        self.families = {w for w, k in rows if k == "family"}
        self.given = {w for w, k in rows if k == "given"}
        self.ranks = ranks or {}
        self._ordinary: dict[str, float] = {}
        triggers: dict[str, set[str]] = defaultdict(set)
        for kind, keys in (_TRIGGERS | {"name": self.families | self.given, "cue": set(_CUES)}).items():
            for key in keys:
                triggers[key].add(kind)
        self.automaton = ahocorasick.Automaton()
        for key, kinds in triggers.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(kinds))))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[str, dict[str, list[tuple[int, int]]]]:
        """The text in lower case, of the same length, and the places of each pattern's triggers."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for last, (length, kinds) in self.automaton.iter(low):
            for kind in kinds:
                places[kind].append((last + 1 - length, last + 1))
        return low, places

    def ordinary(self, word: str) -> float:
        """1 for an ordinary word, -0.5 for one that the vocabulary rather knows with a capital, 0 where it tells nothing."""
        known = self._ordinary.get(word)
        if known is None:
            small, large = (self.ranks.get(f" {w}".encode()) for w in (word, word[:1].upper() + word[1:]))
            known = 0.0 if small is None and large is None else -0.5 if small is None or large is not None and large < small else 1.0
            if len(self._ordinary) > 200_000:
                self._ordinary.clear()
            self._ordinary[word] = known
        return known

    def _may_start(self, text: str, low: str, start: int, end: int) -> bool:
        """Is this lexicon word a whole word beside what could be the rest of a name?"""
        if start and low[start - 1].isalpha() or end < len(low) and low[end].isalpha():
            return False
        if text[start - 2 : start] == ", " or text[end : end + 1] == ",":
            return True
        word = low[start:end]
        after = _NEXT.match(text, end)
        if after:
            other = after.group(1)
            if other[0].isupper() or other.lower() in _PARTICLES or other.lower() in self.families or other.lower() in self.given:
                return True
            if text[start].islower() and self.ordinary(word) <= 0 and self.ordinary(other.lower()) <= 0 and other.lower() not in _NOT_GIVEN:
                return True
        return word in self.families and bool(start) and text[start - 1] in _SPACE

    def find(self, text: str, low: str, places: list[tuple[int, int]], cues: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[Span]:
        """Names that score 1 or more, the best first where they overlap."""
        anchors = {start for start, end in places if self._may_start(text, low, start, end)}
        for start, end in cues:
            if start and low[start - 1].isalpha() and low[start] < "一" or end < len(low) and low[end].isalpha() and low[end] < "一":
                continue
            m = _AFTER_CUE.match(text, end)
            if m and m.end() < len(text) and text[m.end()].lower() != text[m.end()]:
                anchors.add(m.end())
        for start, end in taken:  # a name may stand on the line of other personal data or on the one before
            line = text.rfind("\n", 0, start) + 1
            for at in (line, text.rfind("\n", 0, max(0, line - 1)) + 1):
                m = _PIECE.search(text, at, at + 12)
                if m:
                    anchors.add(m.start())
            m = _PIECE.search(text, end, min(len(text), end + 6))
            if m:
                anchors.add(m.start())
        made: dict[tuple[int, int], float] = {}
        seen: set[tuple[int, int]] = set()
        queue = sorted(anchors)
        for at in queue:  # grows by names that are joined to others
            before = len(made)
            self._propose(text, low, at, taken, made, seen)
            for _, end in list(made)[before:]:
                m = _JOINED.match(text, end)
                if m and m.end() not in anchors:
                    anchors.add(m.end())
                    queue.append(m.end())
        kept: list[tuple[int, int]] = []
        for (start, end), score in sorted(made.items(), key=lambda x: (-x[1], x[0][0] - x[0][1], x[0])):
            if all(end <= a or b <= start for a, b in kept):
                kept.append((start, end))
                yield Span(start, end, "name", score)

    def _propose(self, text: str, low: str, at: int, taken: list[tuple[int, int]], made: dict[tuple[int, int], float], seen: set[tuple[int, int]]) -> None:
        begin = max(text.rfind("\n", 0, at) + 1, at - _REACH)
        stop = text.find("\n", at)
        stop = min(len(text) if stop < 0 else stop, at + _REACH)
        pieces = [Piece(m.start(), m.end(), m.group(), low[m.start() : m.end()], m.lastgroup) for m in _PIECE.finditer(text, begin, stop)]
        i = next((k for k, p in enumerate(pieces) if p.start <= at < p.end), None)
        if i is None:
            return

        def joined(k: int) -> bool:
            """Is piece k + 1 right after piece k?"""
            between = text[pieces[k].end : pieces[k + 1].start]
            return pieces[k + 1].kind == "comma" and not between or 1 <= len(between) <= 2 and set(between) <= _SPACE

        for g in range(max(0, i - 5), i + 1):
            if pieces[g].kind == "comma":
                continue
            for first, end, given, family, order in self._sequences(pieces, g, joined):
                if not first <= i <= end:
                    continue
                span = pieces[first].start, pieces[end].end
                if span in seen:
                    continue
                seen.add(span)
                score = self._score(text, pieces, first, end, given, family, order, taken, made)
                if score >= 1:
                    made[span] = score

    def _sequences(self, pieces: list[Piece], g: int, joined) -> Iterator[tuple[int, int, int, int, str]]:
        """(first, last, given, family, order) of the names that may start at piece g."""
        n = len(pieces)
        j = g
        while j + 1 < n and joined(j) and (pieces[j + 1].kind == "initial" or pieces[j + 1].low in _PARTICLES):
            j += 1
        if j + 1 < n and joined(j) and pieces[j + 1].kind == "word" and pieces[g].low not in _PARTICLES:
            yield g, j + 1, g, j + 1, "forward"
            k = j + 1
            if k + 1 < n and joined(k) and pieces[k + 1].kind == "word" and not {pieces[k].low, pieces[k + 1].low} & (self.families | self.given):
                yield g, k + 1, g, k, "double"  # two family names, where something introduces the person
            if pieces[k].low in self.given and pieces[g].kind == "word":  # two given names
                while k + 1 < n and joined(k) and (pieces[k + 1].kind == "initial" or pieces[k + 1].low in _PARTICLES):
                    k += 1
                if k + 1 < n and joined(k) and pieces[k + 1].kind == "word":
                    yield g, k + 1, g, k + 1, "forward"
        if pieces[g].kind != "word":
            return
        f, order = g, ""
        if g + 2 < n and pieces[g + 1].kind == "comma" and joined(g) and joined(g + 1):
            f, order = g + 2, "comma"
        elif g + 1 < n and joined(g) and pieces[g].low in self.families and pieces[g + 1].low in self.given:
            f, order = g + 1, "reverse"
        if order and pieces[f].kind != "comma":
            end = f
            while end + 1 < n and joined(end) and pieces[end + 1].kind == "initial":
                end += 1
            yield g, end, f, g, order

    def _score(self, text: str, pieces: list[Piece], first: int, end: int, g: int, f: int, order: str, taken: list[tuple[int, int]], made: dict[tuple[int, int], float]) -> float:
        given, family = pieces[g], pieces[f]
        start, stop = pieces[first].start, pieces[end].end
        if any(a < stop and start < b for a, b in taken):
            return 0.0
        follows = text[stop : stop + 1]
        if follows in ("@", "–", "_", "＠") or follows == "." and text[stop + 1 : stop + 2].isalnum() or _RESULT.match(text, stop) or start and text[start - 1] in "@._+/–-":
            return 0.0
        if start and text[start - 1] == "\\":
            return 0.0  # a command
        large = given.text[0].isupper(), family.text[0].isupper()
        caseless = family.text[0].lower() == family.text[0].upper()
        if large[0] != large[1] and not caseless:
            return 0.0
        score = 0.4 if all(large) else 0.0
        parts = family.low.split("-")
        known_given = given.low in self.given or any(p in self.given for p in given.low.split("-"))
        known_family = family.low in self.families or any(p in self.families for p in parts)
        if given.kind == "initial":
            score += 0.35 if large[0] else -1.0
            lead = pieces[first - 1] if first else None
            if lead and lead.kind == "word" and lead.text[0].isupper() and set(text[lead.end : start]) <= _SPACE and self._of(lead, False) == 0 and len(lead.text) > 2:
                score -= 0.5  # a middle initial, rather
        else:
            score += self._of(given, known_given) - 0.6 * (given.low in self.families and not known_given)
            if not known_given and self.ordinary(given.low) < 0:
                score += 0.2
        score += self._of(family, known_family)
        if not known_family:
            score += 0.2 if self.ordinary(family.low) <= 0 else 0.0
            score -= 0.4 * (family.low in self.given)
        score += 0.15 * min(2, sum(pieces[k].kind == "initial" for k in range(first, end + 1) if k != g))
        known = known_given + known_family
        if all(large) and family.text.isupper() and len(family.text) > 2 and self._shouted(text, start, stop):
            score -= 0.4  # in a text in capitals they say nothing
        context = self._context(text, start, stop, taken, made)
        if order == "double":
            last = pieces[end]
            score += 0.05 if context >= 0.5 and last.text[0].isupper() and self.ordinary(last.low) <= 0 and last.low not in _NOT_GIVEN else -2.0
        if order == "comma" and known < 2 and context < 0.5:
            score -= 0.5
        if order == "forward" and not all(large) and not known:
            score -= 0.5
        if context < 0.5:  # ordinary words that also occur as names
            score -= 0.4 * (known_given and self.ordinary(given.low) > 0) + 0.7 * (known_family and self.ordinary(family.low) > 0)
        return score + context

    @staticmethod
    def _shouted(text: str, start: int, stop: int) -> bool:
        """Is a word beside it in capitals too?"""
        around = re.findall(r"([^\W\d_]+)[ \t]{1,2}$", text[max(0, start - 16) : start]) + re.findall(r"^[ \t]{1,2}([^\W\d_]+)", text[stop : stop + 16])
        return any(w.isupper() for w in around)

    def _of(self, piece: Piece, known: bool) -> float:
        """What a word adds for being in the lexicon, or takes away for being an ordinary word."""
        if piece.low in _NOT_GIVEN or piece.low in _TITLES or len(piece.low) < 2:
            return -2.0
        if known:
            return 0.6
        return -0.6 if self.ordinary(piece.low) > 0 else 0.0

    def _context(self, text: str, start: int, stop: int, taken: list[tuple[int, int]], made: dict[tuple[int, int], float]) -> float:
        """What stands around: a title, a word that introduces persons, other personal data, another name."""
        left = text[max(0, start - 40) : start]
        if _TITLE.search(left):
            return 0.7
        cue = _NAME_CUE.search(left)
        best = 0.0
        if cue:
            weak = cue.group("weak")
            best = 0.6 if not weak else 0.1
            if weak and any(start - len(weak) - 4 <= b <= start for _, b in made):
                best = 0.5  # joined to another name
        line = text.rfind("\n", 0, start) + 1
        after = text.find("\n", stop)
        after = len(text) if after < 0 else after
        lead = text[line:start].strip(" \t\r|*-•>")
        next_line = text.find("\n", after + 1)
        next_line = len(text) if next_line < 0 else next_line
        for a, b in taken:
            if 0 <= a - stop <= 12 and "\n" not in text[stop:a] or 0 <= start - b <= 6 and "\n" not in text[b:start]:
                best = max(best, 0.5)  # beside it
            elif not lead and (not text[stop:after].strip(" \t\r|,.;") and after < a <= next_line and not text[after:a].strip() or line and b < start and not text[b:line].strip(" .\t\r\n") and not text[stop:after].strip(" \t\r|,.;")):
                best = max(best, 0.5)  # a line of its own above or below it
        if not lead and not text[stop:after].strip(" \t\r|,.;"):
            best = max(best, 0.3)  # all of its line
        return best


# --- all kinds ------------------------------------------------------------------------------------


def _emails(text: str) -> Iterator[Span]:
    if any(x in text for x in _AT_SIGNS + _AT_LINKS) or _AT_WORD.search(text):
        for m in _EMAIL.finditer(text):
            yield Span(m.start(), m.end(), "email", 1.5)
    if ("dot" in text or "DOT" in text) and _DOT_WORD.search(text):
        for m in _EMAIL_WORDS.finditer(text):
            yield Span(m.start(), m.end(), "email", 1.2)


def _checked(number: str) -> bool:
    """Does a check digit of the number's length and form hold?"""
    bare = re.sub(r"[^0-9A-Za-z]", "", number).upper()
    if len(bare) == 15 and bare.isdigit():
        return mod97_key(bare)
    if len(bare) == 9 and bare[:8].isdigit() and bare[8].isalpha():
        return letter_23(bare)
    if len(bare) == 11 and bare.isdigit():
        return mod11_10(bare)
    return len(bare) in (9, 10) and bare.isdigit() and luhn(bare)


def _ids(text: str, places: list[tuple[int, int]]) -> Iterator[Span]:
    """Numbers after a label, and numbers of a known form: the label, the check digit and words nearby make the score."""

    def near(start: int) -> float:
        left = text[max(0, start - 60) : start]
        return 0.3 * bool(_ID_PERSON.search(left)) - 0.8 * bool(_PHONE_AGAINST.search(left[-40:])) - 0.6 * bool(_PHONE_FOR.search(left[-20:]))

    labelled = set()
    for start, end in places:
        at = _ID_LABEL.search(text, max(0, start - 30), end + 30)
        while at:  # every label in the window, also one inside another
            if at.start() not in labelled:
                labelled.add(at.start())
                m = _ID_LABEL.match(text, at.start())  # not cut by the window's end
                n = m and _ID_NUMBER.match(text, _ID_BETWEEN.match(text, m.end()).end())
                if n and 6 <= sum(c.isalnum() for c in n.group()) <= 18 and sum(c.isdigit() for c in n.group()) >= 5:
                    yield Span(n.start(), n.end(), "id_number", 1.2 + 0.7 * _checked(n.group()))
            at = _ID_LABEL.search(text, at.start() + 1, end + 30)
    for run in _LONG.finditer(text):  # the forms below stand in or around such a run
        begin, stop = max(0, run.start() - 3), min(len(text), run.end() + 3)
        weak = None
        for weak in _ID_WEAK.finditer(text, max(0, begin - 24), run.start()):
            pass
        n = weak and _ID_NUMBER.match(text, _ID_BETWEEN.match(text, weak.end()).end())
        if n and n.end() > run.start() and 9 <= sum(c.isalnum() for c in n.group()) <= 18:  # after a label that other numbers have too
            yield from _sure(Span(n.start(), n.end(), "id_number", 0.5 + 0.7 * _checked(n.group()) + near(weak.start())))
        for m in _ID_BARE.finditer(text, begin, stop):
            score = _ID_SCORE[m.lastgroup] + near(m.start())
            if score >= 0.3:
                yield from _sure(Span(m.start(), m.end(), "id_number", score + 0.7 * _checked(m.group())))


def _sure(span: Span) -> Iterator[Span]:
    if span.score >= 1:
        yield span


def _phones(text: str) -> Iterator[Span]:
    for m in (m for run in _DIALLED.finditer(text) for m in _PHONE.finditer(text, run.start(), min(len(text), run.end() + 3))):
        shape, digits = m.lastgroup, sum(c.isdigit() for c in m.group())
        if shape == "national" and not 9 <= digits <= 12 or not m.group().isascii() and not all(c.isascii() or c in "   ‑" for c in m.group()):
            continue
        line = text.rfind("\n", 0, m.start()) + 1
        stop = text.find("\n", m.end())
        stop = len(text) if stop < 0 else stop
        left, right = text[max(line, m.start() - 40) : m.start()], text[m.end() : min(stop, m.end() + 24)]
        score = _PHONE_SCORE[shape]
        if _PHONE_FOR.search(left) or _PHONE_FOR.search(right):
            score += 1.0
        elif not left.strip(" \t|*-•>%#(") and not right.strip(" \t\r|)."):
            score += 0.8  # a line of its own, as in a signature
        elif left.endswith("(") and right.startswith(")"):
            score += 0.5
        else:
            score += 0.35 - 0.3 * (shape in ("nine", "eleven") and bool(_COUNTED.match(right)))
        if shape == "nine" and re.search(r"\d[ \u00a0\u202f]$", left):
            score -= 1.0  # the end of a longer number
        if _PHONE_AGAINST.search(_SENTENCE.split(left)[-1]):
            score -= 2.0
        if score >= 1:
            yield Span(m.start(), m.end(), "phone", score)


def _addresses(text: str, low: str, places: dict[str, list[tuple[int, int]]]) -> Iterator[Span]:
    def near(rx: re.Pattern, kind: str, left: int, right: int, boundary: bool = True) -> Iterator[re.Match]:
        for start, end in places.get(kind, ()):
            if boundary and end < len(low) and low[end].isalnum():
                continue
            stop = min(len(text), end + right)
            m = rx.search(text, max(0, start - left), stop)
            while m and m.end() <= start:  # an earlier address in the window
                m = rx.search(text, m.end(), stop)
            if m and m.start() <= end:
                yield m

    for m in near(_EN, "en", 60, 1):
        yield Span(m.start(), m.end(), "address", 1.2)
    for rx in (_FR, _FR_UPPER):
        for m in near(rx, "fr", 12, 80):
            yield Span(m.start(), m.end(), "address", 1.2)
    for m in near(_DE, "de", 50, 10):
        yield Span(m.start(), m.end(), "address", 1.2)
    for m in near(_ES, "es", 0, 80, boundary=False):
        yield Span(m.start(), m.end(), "address", 1.2)
    for m in near(_BOX, "box", 16, 24):
        yield Span(m.start(), m.end(), "address", 1.3)
    for start, _ in places.get("am", ()):
        m = _DE_AT.match(text, start)
        if m and m.group("am").lower() not in _NO_STREET:
            yield Span(m.start(), m.end(), "address", 1.2)


def find_spans(text: str, names: NameFinder) -> list[Span]:
    """Spans in order, none overlapping; of overlapping ones the kind first in KINDS wins, then the longer."""
    low, places = names.scan(text)
    kept: list[Span] = []

    def free(span: Span) -> bool:
        return all(span.end <= k.start or k.end <= span.start for k in kept)

    for found in (_emails(text), _ids(text, places.get("id", [])), _phones(text), _addresses(text, low, places)):
        for span in sorted(found, key=lambda s: (s.start - s.end, s.start)):
            if free(span):
                kept.append(span)
    for span in names.find(text, low, places.get("name", []), places.get("cue", []), [(k.start, k.end) for k in kept]):
        if free(span):
            kept.append(span)
    return sorted(kept)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for span in spans:
        out += [text[at : span.start], f"[{span.kind.upper()}]"]
        at = span.end
    return "".join([*out, text[at:]])


_MADE: dict[int, tuple[object, NameFinder]] = {}


def _finder(shared: tuple[list, bytes]) -> NameFinder:
    if id(shared) not in _MADE:
        _MADE.clear()
        _MADE[id(shared)] = (shared, NameFinder(shared[0], bpe.read_ranks(shared[1])))
    return _MADE[id(shared)][1]


def detect(documents: DataFrame, lexicon: DataFrame, redacted: bool = True, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, text with placeholders (unless ``redacted`` is false) and the spans of each document.

    ``spans`` is an array of kind, found_text, start, score in order of the text. A null text stays null and has
    no spans, as has an empty one; repeated rows each come out; whole texts are searched, however long; other
    columns are ignored. An empty lexicon leaves titles, introducing words and other personal data to tell names.
    Narrow: no shuffle. The lexicon is a reference list of at most LEXICON_ROWS rows, checked, and goes to every
    worker. A name of the lexicon that is also an ordinary word (a token of its own in a public vocabulary)
    counts only with such words beside it.
    """
    rows = lexicon.select("word", "word_kind").limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"the lexicon has over {LEXICON_ROWS} rows")
    shared = documents.sparkSession.sparkContext.broadcast(([tuple(r) for r in rows], bpe.vocabulary_bytes(vocabulary)))  # the vocabulary at most 64 MB, checked
    spans_type = "array<struct<kind:string,found_text:string,start:int,score:double>>"
    arrow_spans = pa.list_(pa.struct([("kind", pa.string()), ("found_text", pa.string()), ("start", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = _finder(shared.value)
            for batch in (whole.slice(i, SLICE_ROWS) for i in range(0, whole.num_rows, SLICE_ROWS)):
                texts = batch.column(1).to_pylist()
                spans = [find_spans(t, names) if t else [] for t in texts]
                told = pa.array([[(s.kind, t[s.start : s.end], s.start, s.score) for s in ss] for t, ss in zip(texts, spans, strict=True)], arrow_spans)
                columns = [batch.column(0), *([pa.array([t if t is None else redact(t, ss) for t, ss in zip(texts, spans, strict=True)], pa.string())] if redacted else []), told]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(["text"] if redacted else []), "spans"])

    schema = "doc_id bigint, " + ("text string, " if redacted else "") + f"spans {spans_type}"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def found(detected: DataFrame) -> DataFrame:
    """One row for each document, kind and distinct text found."""
    return detected.filter(F.size("spans") > 0).select("doc_id", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s.kind.alias("kind"), s.found_text.alias("found_text"))))).alias("s")).select("doc_id", "s.kind", "s.found_text").distinct()
