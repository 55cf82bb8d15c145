"""Personal data in free text: found, typed and replaced by placeholders.

Patterns propose spans of e-mail addresses, phone numbers, identity numbers, street addresses and names; validators
(Luhn, mod-97, mod-11, Verhoeff, check letters, assigned ranges) confirm them, and words nearby adjust their score.
Patterns alone stay below the score that is kept, unless their form is unmistakable: a right checksum lifts a number
over it, a wrong one pushes it down so far that only a clear label nearby ("passport no.") still does. Numbers of
accounts and cards are no identity numbers: with right check digits they are claimed, so that no part of them is taken
for something else, and left as they are. Names have no pattern of their own: sequences of capitalised words are
proposed, and a small character n-gram classifier, fitted on a bounded sample of labelled rows, scores their words;
without labelled rows only titles and labels tell names. Overlaps go to the better score, then the longer span.

Patterns are tried only where a text has a digit, a code or an "@" that they can begin at, not at every character.

Texts are handled whole, each in its partition; only the fitted weights (a fixed size) are broadcast.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import map_batches

TYPES = ("email", "phone", "identity_number", "street_address", "name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}
#: Score from which a span is kept, and the number of labelled rows that the name classifier is fitted on.
KEPT, SAMPLE_ROWS = 0.5, 2000
#: Characters of all rows together that the classifier is fitted on, a bound on the sample as SAMPLE_ROWS is (20 MB on
#: the driver): a row that doesn't fit is passed over. Every text is searched, however long.
SAMPLE_CHARS = 20_000_000
#: Size of the hashed feature space of the name classifier.
FEATURES = 1 << 15

@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


# --- e-mail ---------------------------------------------------------------------------------------------------------
_AT = r"(?: ?@ ?|\s?[(\[{<]\s?(?:at|AT|ät)\s?[)\]}>]\s?|\s(?:\(at\)|\[at\])\s)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|punkt|point|punto)\s?[)\]}>]\s?)"
_email = re.compile(
    rf"(?<![\w.+%-])[A-Za-z0-9_%+'-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+'-]{{1,64}}){{0,6}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,6}}{_DOT}[A-Za-z]{{2,24}}(?![\w@-])"
)

_at_sign = re.compile(r"@|[(\[{<]\s?(?:at|AT|ät)\s?[)\]}>]")
_dot_word = re.compile(r"dot|DOT|punkt|point|punto")
_REACH = 520  # characters of the longest local part or domain that the pattern can have


def _email_spans(text: str) -> Iterator[Span]:
    """Around each sign for "at": from the last white space before it, or from farther where dots are spelt out."""
    done = 0
    for at in _at_sign.finditer(text):
        if at.start() < done:
            continue
        low = max(done, at.start() - _REACH)
        before = text[low : at.start()]
        if not _dot_word.search(before):
            low = at.start() - len(before.rstrip().rsplit(None, 1)[-1]) - (len(before) - len(before.rstrip())) if before.strip() else at.start()
        m = _email.search(text, low, at.end() + _REACH)
        if m:
            done = m.end()
            yield Span(m.start(), m.end(), "email", 1.5)


# --- numbers --------------------------------------------------------------------------------------------------------
_S = r"[\s]{1,6}"
_T = r"(?:[ \t\u00a0]{1,2}|[.\-/])"  # within a line; known numbering plans may also be wrapped
_V = r"(?:\s{1,6}|[.\-/])"
_NOT_BEFORE, _NOT_AFTER = r"(?<![\w+.,/$€£-])", r"(?![\w])(?![.,/-]\d)"
_PLANS = "|".join([
    rf"1{_V}?(?:\([2-9]\d\d\)|[2-9]\d\d){_V}?[2-9]\d\d{_V}?\d{{4}}",  # North America
    rf"33{_V}?(?:\(0\){_V}?)?[1-9](?:{_V}?\d\d){{4}}",  # France
    rf"44{_V}?(?:\(0\){_V}?)?(?:\d\d{_V}\d{{4}}{_V}\d{{4}}|\d{{3}}{_V}\d{{3}}{_V}\d{{4}}|\d{{4}}{_V}\d{{6}}|\d{{10}})",  # United Kingdom
    rf"49{_V}?(?:\(0\){_V}?)?[1-9]\d{{1,4}}{_V}\d{{3,4}}{_V}\d{{4}}",  # Germany
    rf"34(?:{_V}?\d{{3}}){{3}}",  # Spain
])
_phones = [
    (1.0, re.compile(rf"{_NOT_BEFORE}(?:\+|00)(?:{_PLANS}){_NOT_AFTER}")),
    (0.9, re.compile(rf"{_NOT_BEFORE}\+\d{{1,3}}(?:(?:{_T}|{_T}?\(0?\d{{0,4}}\){_T}?)\d{{1,5}}){{1,6}}{_NOT_AFTER}")),
    (0.9, re.compile(rf"{_NOT_BEFORE}\+\d{{8,15}}{_NOT_AFTER}")),
    (0.8, re.compile(rf"{_NOT_BEFORE}00\d{{2,3}}(?:{_T}\d{{1,5}}){{2,6}}{_NOT_AFTER}")),
    (0.8, re.compile(rf"{_NOT_BEFORE}(?:1[\s.-])?\([2-9]\d{{2}}\){_S}?[2-9]\d{{2}}{_V}\d{{4}}{_NOT_AFTER}")),
    (0.8, re.compile(rf"{_NOT_BEFORE}(?:1[\s.-])?[2-9]\d{{2}}([.\-])[2-9]\d{{2}}\1\d{{4}}{_NOT_AFTER}")),
    (0.55, re.compile(rf"{_NOT_BEFORE}[2-9]\d{{2}}{_S}[2-9]\d{{2}}{_S}\d{{4}}{_NOT_AFTER}")),
    (0.8, re.compile(rf"{_NOT_BEFORE}0\d([\s.\-])\d{{2}}(?:\1\d{{2}}){{3}}{_NOT_AFTER}")),
    (0.7, re.compile(rf"{_NOT_BEFORE}(?:\(0\d{{2,4}}\)|0\d{{2,4}}){_V}\d{{3,4}}(?:{_S}|-)\d{{3,4}}{_NOT_AFTER}(?![ ]\d)")),
    (0.5, re.compile(rf"{_NOT_BEFORE}0\d{{9,10}}{_NOT_AFTER}")),
    (0.3, re.compile(rf"{_NOT_BEFORE}[2-9]\d{{2}}[2-9]\d{{6}}{_NOT_AFTER}")),
]
_PHONES_BY_START = {"+": (0, 1, 2), "(": (4, 8), "0": (0, 3, 7, 8, 9), "1": (4, 5)} | dict.fromkeys("23456789", (5, 6, 10))
_number_start = re.compile(r"(?<!\w)(?=[+(]?\d)")
_number_run = re.compile(r"[+(]?\d[\d\s().\-/]{0,40}")
_code_start = re.compile(r"(?<![\w-])[A-Z]{1,6}(?=[-\s]{0,6}\d)")
#: Pattern, kind of check, score by pattern alone.
_number_identities = [
    (0.32, "verhoeff", re.compile(rf"(?<![\w.,/+$€£-])\d{{4}}{_S}\d{{4}}{_S}\d{{4}}(?![\w])(?![.,/-]\d)(?![ ]\d)")),
    (0.35, "area", re.compile(rf"(?<![\w.,/+$€£-])(?!000)\d{{3}}(?:-\d{{2}}-|{_S}\d{{2}}{_S})(?!0000)\d{{4}}(?![\w])(?![.,/-]\d)")),
    (0.35, "nir", re.compile(r"(?<![\w.,/+-])[12]\s?\d{2}\s?(?:0[1-9]|1[0-2])\s?\d[\dAB]\s?\d{3}\s?\d{3}\s?\d{2}(?![\w])")),
    (0.35, "dni", re.compile(r"(?<![\w-])\d{8}-?[A-Z](?![\w-])")),
    (0.15, "digits", re.compile(rf"(?<![\w.,/+$€£-])(?:\d{{2}}{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d{{3}}|\d{{3}}{_S}\d{{3}}{_S}\d{{3,4}})(?![\w])(?![.,/-]\d)(?![ ]\d)")),
    (0.15, "digits", re.compile(r"(?<![\w.,/+$€£-])\d{8,12}(?![\w])(?![.,/-]\d)")),
    (0.3, "card", re.compile(rf"(?<![\w.,/+$€£-])\d{{4}}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}(?![\w])(?![.,/-]\d)")),
]
_code_identities = [
    (0.9, "form", re.compile(r"(?<![\w-])[A-Z]{5}\d{4}[A-Z](?![\w-])")),
    (0.9, "form", re.compile(rf"(?<![\w-])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?:{_S}?\d{{2}}){{3}}{_S}?[A-D](?![\w-])")),
    (0.85, "form", re.compile(rf"(?<![\w-])QQ(?:{_S}?\d{{2}}){{3}}{_S}?[A-D](?![\w-])")),
    (0.7, "form", re.compile(r"(?<![\w-])[A-Z]{1,2}\d{7,8}(?![\w-])")),
    (0.55, "prefix", re.compile(r"(?<![\w-])([A-Z]{2,6})-(?:\d{4}-)?\d{4,9}(?![\w-])")),
    (0.35, "dni", re.compile(r"(?<![\w-])[XYZ]-?\d{7}-?[A-Z](?![\w-])")),
    (0.4, "iban", re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,3})?(?![\w-])")),
]
#: What a right and a wrong checksum add; what a clear and a vague label nearby add, and one of a transaction.
RIGHT, WRONG, LABELLED, HINTED, TRADED = 0.3, -0.05, 0.45, 0.25, -0.8
# Prefixes of numbers that belong to a person, and of those that belong to a transaction.
_PERSON_PREFIX = frozenset("STU HOSP MRN PAT PID LAB MED INS STUD MAT MATR EMP SSN TIN PASS ID NID SV KV POL".split())
_BUSINESS_PREFIX = frozenset("INV PO CN ST REF AB TRK ORD SO RE RG BATCH LOT RMA SKU DOC VAT RF FA AN LS BL EORI ISO DIN EN RFC COVID".split())
_label_of = re.compile(
    r"(?i)\b(?:(?:id|identity|national|tax|insurance|patient|student|member|passport|document|licen[cs]e|social security|medical record)\s*(?:id|no|number|card|code)\b|passport|passeport|pasaporte|reisepass|ausweis\w*|steuer\w*|ssn|nif|nie|dni|nino|aadhaar|"
    r"pan|mrn|matrikel\w*|versicherung\w*|seguro|assurance|holder|pièce|documento)[\s.:#°-]*(?:no\.?|number|nummer|id|card)?[\s.:#°-]*$"
)
_near_identity = re.compile(
    r"(?i)\b(?:id(?:entity)?(?: card)?|national|tax|social security|insurance|patient|student|licen[cs]e|member|document number|id no|no|n\w{1,4}[b6]er|nummer|numéro|número|holder)\b[\s.:#°-]*(?:no\.?|number|nummer|id|card)?[\s.:#°-]*$"
)
_near_business = re.compile(
    r"(?i)\b(?:invoice|order|orders|tracking|trk|parcel|batch|lot|reference|statement|receipt|voucher|quoting|registered under|recorded under|room|building|version|iban|account|konto|factura|facture|rechnung|"
    r"bestell\w*|pedido|commande|amount|total|units?)\b[\s.:#°-]*(?:no\.?|number|nummer|id)?[\s.:#°-]*$"
)
_near_phone = re.compile(r"(?i)\b(?:tel|telephone|telefon|téléphone|teléfono|phone|mobile|mobil|cell|fax|call|calling|reach|unter|au|al|on|under|dial)\b(?:[^\n\w]{0,3}(?:no|number|nummer|numéro|número)\b)?[^\n\w]{0,6}$")

# --- addresses ------------------------------------------------------------------------------------------------------
_U = r"[^\W\d_a-zß-öø-ÿ]"  # an upper-case letter
_W = rf"{_U}[^\W\d_]*(?:['’-][^\W\d_]+){{0,4}}"
_G = r"[ \t]*\r?\n?[ \t]*"  # a gap within an address, at most one line end
_C = rf",?{_G}"
_CITY = rf"{_W}(?:[ ](?:{_W}|(?:an|am|im|sur|sous|en|de|del|la|upon|on|der|den|bei|ob)(?=[ ])(?:[ ](?:der|dem|den|la|le|las|los))?[ ]{_W}))*"
_CITY_MORE = rf"{_W}(?:\s(?:{_W}|(?:an|am|im|sur|upon|on|bei|ob|de|del)\s(?:(?:der|dem|den|la|le|las|los)\s)?{_W}))*"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Suite|Ste\.?|Unit|Floor|Room|Fl\.)"
_EN_KIND = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Terrace|Ter|Row|Way|Place|Pl|Square|Sq|Close|Crescent|Gardens|Parkway|Pkwy|Highway|Hill|Mews|Walk|Circle|Cir|Trail|Quay|Alley)"
_UK = r"[A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2}"
_US = r"[A-Z]{2}\s+\d{5}(?:-\d{4})?"
_FR_KIND = r"(?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|quai|impasse|route|cours|passage|square|ruelle|Rue|Avenue|Boulevard|Place|Chemin|Allée|Quai|Impasse|Route)"
_DE_STREET = rf"(?:{_W}[ ])?(?:{_U}[^\W\d_]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm|steig|graben|hof|markt|chaussee)|(?:{_W}[ -])?(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ring|Ufer|Damm))"
_ES_KIND = r"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Carrera|calle|avenida|plaza|paseo)"
_TAIL_EN = rf"(?:{_C}{_UNIT}\s+\w+)?(?:{_C}(?:{_CITY_MORE}){_C}(?:{_US}|{_UK}|\d{{5}})|{_C}(?:{_US}|{_UK}))"
_addresses = [
    re.compile(rf"(?<![\w.,$€£-])(?:{_UNIT}\s+\w+{_C})?\d{{1,5}}[A-Za-z]?\s+(?:{_W}\s+){{1,4}}?{_EN_KIND}\b\.?{_TAIL_EN}(?![\w])"),
    re.compile(rf"(?<![\w.,$€£-])\d{{1,5}}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s+{_FR_KIND}\s+[^\W\d_][^\d\n,;.!?]*?(?:\n[^\d\n,;.!?]*?)?{_C}\d{{5}}\s+{_CITY}(?![\w])"),
    re.compile(rf"(?<![\w-]){_DE_STREET}\s+\d{{1,5}}\s?[a-z]?{_C}(?:D-)?\d{{5}}\s+{_CITY}(?![\w])"),
    re.compile(rf"(?<![\w-]){_ES_KIND}\s+[^\d\n;!?]{{2,50}}?,?\s*(?:n[.º°]*\s*)?\d{{1,4}}(?:{_C}[^\n,;]{{1,15}})?{_C}\d{{5}}\s+{_CITY}(?![\w])"),
    # without postal code and town
    re.compile(rf"(?<![\w.,$€£-])(?:{_UNIT}\s+\w+{_C})?\d{{1,5}}[A-Za-z]?\s+(?:{_W}\s+){{1,3}}?(?:Street|Avenue|Road|Lane|Drive|Court|Boulevard|Blvd|Terrace)\b(?:{_C}{_UNIT}\s+\w+)?(?:{_C}{_CITY}(?=[\n.;)]))?(?![\w])"),
]

# --- names ----------------------------------------------------------------------------------------------------------
_BREAK = r"(?:-[ \t]*\n[ \t]*[^\W\d_]+)?"  # a word divided between two lines
_NAME_WORD = rf"(?:[DLO]['’])?{_U}[^\W\d_]*(?:['’][^\W\d_]+){{0,2}}(?:-(?:[ \t]*\n[ \t]*)?{_U}[^\W\d_]+){{0,4}}{_BREAK}"
_INITIAL = rf"{_U}\.(?:-?{_U}\.)*"
_PARTICLE = r"(?:von\s{1,4}der|von\s{1,4}dem|van\s{1,4}der|van\s{1,4}den|van\s{1,4}de|de\s{1,4}la|de\s{1,4}las|de\s{1,4}los|de\s{1,4}los|della|delle|von|van|vom|zu|zur|zum|de|del|der|den|di|da|do|dos|du|la|le|al|el|bin|ben|ten|ter|af|av)"
_sequence = re.compile(rf"(?<![\w@.+-])(?:{_INITIAL}|{_NAME_WORD})(?:\s{{1,4}}(?:{_PARTICLE}\s{{1,4}})?(?:{_INITIAL}|{_NAME_WORD}))*(?![\w@]|-\d)")
_piece = re.compile(rf"(?:(?<=\s)|^)(?:({_PARTICLE})\s{{1,4}})?(?:({_INITIAL})|({_NAME_WORD}))")
_TITLES = frozenset("dear liebe lieber cher chère estimado estimada dr mr mrs ms miss mx prof professor doctor herr frau hr fr m mme mlle monsieur madame maître sr sra srta señor señora don doña dott sig signora sir dame".split())
_title_before = re.compile(r"(?i)(?<!\w)(?:dr|mr|mrs|ms|miss|prof|herrn?|frau|hr|fr|m|mme|mlle|monsieur|madame|sr|sra|srta|señora?|don|doña)\.?\s{1,4}$")
_company_after = re.compile(r"^(?:\s*&\s*(?:Sons|Söhne|Co|Partners|Partner|Fils|Hijos)\b|\s+(?:GmbH|AG|KG|SE|Ltd|LLC|LLP|Inc|PLC|plc|Corp|Corporation|Company|Group|Holding|Holdings|S\.A\.|S\.L\.|SARL|SAS|S\.p\.A|N\.V\.|B\.V\.|Foundation|University|Institute|Hospital|Clinic|Bank)\b)")
_COMPANY = r"(?:GmbH|AG|KG|SE|Ltd|LLC|LLP|Inc|PLC|plc|Corp|Corporation|Company|Group|Holdings?|S\.A\.|S\.L\.|SARL|SAS|S\.p\.A|N\.V\.|B\.V\.)"
_company_line = re.compile(rf"(?:{_W}[ ]){{1,4}}(?:&[ ](?:Sons|Söhne|Co|Partners?)[ .]*)?{_COMPANY}(?![\w])")
_person_before = re.compile(
    r"(?i)(?:\b(?:name|holder|candidate|patient|student|contact|attn|authors?|registrar|physician|dear|sincerely|regards|by|of|from|to|for|with|notify|inform|reach|thank|bill to|reports to|employee|applicant|signed|"
    r"mit|wurde|von|an|herrn?|frau|arbeitete|händen|joindre|avec|à|par|con|a|por|de|erreichen|contactar|telephone)\b[\s.:,;]*|[:;]\s*)$"
)
_name_label = re.compile(r"(?i)\b(?:name|holder|candidate|patient|student|contact|attn\.?|physician|registrar|nom|nombre|titulaire|titular)\s?:\s*$|\b(?:dear|sincerely,?|liebe[r]?|cher|chère|estimad[oa])\s+$")
_place_before = re.compile(r"(?i)\b(?:in|at|near|project|figure|table|street|office|site|en|bei|aus|nach|location|city|town|department|position)\b[\s:]*$")


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return len(digits) > 1 and total % 10 == 0


def mod97(iban: str) -> bool:
    """An IBAN's check digits."""
    s = re.sub(r"\s", "", iban).upper()
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def verhoeff(digits: str) -> bool:
    """The check digit of 12-digit identity numbers, in the dihedral group of ten elements."""

    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    power = [list(range(10)), [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]]
    while len(power) < 8:
        power.append([power[-1][power[1][i]] for i in range(10)])
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = times(c, power[i % 8][int(d)])
    return c == 0


def nir(number: str) -> bool:
    """The key of a French social security number: 97 less the rest by 97."""
    s = re.sub(r"\s", "", number).replace("2A", "19").replace("2B", "18")
    return len(s) == 15 and s.isdigit() and 97 - int(s[:13]) % 97 == int(s[13:])


def dni(number: str) -> bool:
    """The check letter of a Spanish identity number."""
    s = number.replace("-", "")
    digits = s[:-1].translate(str.maketrans("XYZ", "012"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == s[-1]


def sin(digits: str) -> bool:
    """Nine digits of a social insurance number: Luhn."""
    return len(digits) == 9 and luhn(digits)


def nhs(digits: str) -> bool:
    """The check digit of a ten-digit patient number: weights 10 to 2, 11 less the rest by 11."""
    check = 11 - sum((10 - i) * int(c) for i, c in enumerate(digits[:9])) % 11
    return len(digits) == 10 and check % 11 == int(digits[9]) and check != 10


def steuer_id(digits: str) -> bool:
    """The check digit of an eleven-digit tax number: mod 11, 10."""
    product = 10
    for c in digits[:10]:
        product = (((int(c) + product) % 10 or 10) * 2) % 11
    return len(digits) == 11 and (11 - product) % 10 == int(digits[10])


def area(digits: str) -> bool:
    """Whether nine digits lie in the ranges that are assigned: no area 000 or 666, and from area 900 on (taxpayers) only
    some groups."""
    first, group = int(digits[:3]), int(digits[3:5])
    return first not in (0, 666) and group > 0 and (first < 900 or 50 <= group <= 65 or 70 <= group <= 88 or 90 <= group <= 92 or 94 <= group)


def check(kind: str, value: str) -> bool | None:
    """Whether a number's check digits are right; None where its kind has none."""
    digits = re.sub(r"\D", "", value)
    if kind == "digits":
        return {9: sin, 10: nhs, 11: steuer_id, 12: verhoeff}.get(len(digits), lambda _: None)(digits)
    if kind == "verhoeff":
        return verhoeff(digits)
    if kind == "area":
        return area(digits)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return {"nir": nir, "dni": dni, "iban": mod97}[kind](value) if kind in ("nir", "dni", "iban") else None


def _before(text: str, start: int) -> str:
    """What stands before, in one line, with divided words joined."""
    return re.sub(r"\s+", " ", re.sub(r"(?<=[^\W\d_])[-¬\xad]\s+", "", text[max(0, start - 48) : start]))


def _identity(text: str, at: int, patterns: list, before: str | None) -> Iterator[Span]:
    for score, kind, pattern in patterns:
        m = pattern.match(text, at)
        if not m:
            continue
        right = check(kind, m[0])
        if kind in ("card", "iban"):  # of an account: claimed, but not a person's number
            if right:
                yield Span(at, m.end(), "", 2.0)
            continue
        if before is None:
            before = _before(text, at)
        s = score + (0.0 if right is None else RIGHT if right else WRONG)
        if kind == "prefix":
            s += 0.4 if m[1] in _PERSON_PREFIX else -1 if m[1] in _BUSINESS_PREFIX else 0
        if _label_of.search(before):
            s += LABELLED
        elif _near_identity.search(before):
            s += HINTED
        if _near_business.search(before):
            s += TRADED
        elif kind == "digits" and _near_phone.search(before):
            s -= 0.3
        yield Span(at, m.end(), "identity_number", s)


def _number_spans(text: str) -> Iterator[Span]:
    """Phone and identity numbers, and addresses that begin with a house number: one look at every number."""
    for begin in _number_start.finditer(text):
        at = begin.start()
        first = text[at]
        if first.isdigit() and _house.match(text, at):
            for n in _BY_NUMBER:
                m = _addresses[n].match(text, at)
                if m:
                    yield Span(at, m.end(), "street_address", _ADDRESS_SCORES[n])
        run = _number_run.match(text, at)
        if not run or run.end() - at < 8:
            continue
        before = None
        for n in _PHONES_BY_START.get(first, ()):
            score, pattern = _phones[n]
            m = pattern.match(text, at)
            if not m:
                continue
            digits = re.sub(r"\D", "", m[0])
            if not 8 <= len(digits) <= (17 if digits.startswith("00") else 15) or len(set(digits)) <= 2:
                continue
            before = _before(text, at) if before is None else before
            if _near_phone.search(before):
                score += 0.2
            elif score < 0.9:  # such digits may as well be another number
                score -= 0.5 if _label_of.search(before) else 0.35 if _near_identity.search(before) else 0
            yield Span(at, m.end(), "phone", score - 0.6 * (_near_business.search(before) is not None))
        if first.isdigit():
            yield from _identity(text, at, _number_identities, before)


def _code_spans(text: str) -> Iterator[Span]:
    for begin in _code_start.finditer(text):
        yield from _identity(text, begin.start(), _code_identities, None)


#: Which address patterns begin with a house number, with a unit before it, with a street's name, with its kind.
_BY_NUMBER, _BY_UNIT, _BY_STREET, _BY_KIND = (0, 1, 4), (0, 4), 2, 3
_ADDRESS_SCORES = (1.2, 1.2, 1.2, 1.2, 0.6)
_house = re.compile(r"\d{1,5}(?:\s?(?:bis|ter|quater)|\s?[A-Za-z])?,?\s+[^\W\d_]")  # what each of the first begins with
_unit = re.compile(rf"(?<![\w.,$€£-]){_UNIT}\s")
_before_number = re.compile(r"\s+(?=\d)")
_STREET_ENDS = tuple("straße strasse str. gasse weg platz allee ring ufer damm steig graben hof markt chaussee Straße Strasse Str. Gasse Weg Platz Allee Ring Ufer Damm".split())
_KIND_WORDS = ("Calle", "C/", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Ronda", "Carrera", "calle", "avenida", "plaza", "paseo")


def _address_spans(text: str) -> Iterator[Span]:
    """Addresses that don't begin with a number; `_number_spans` has the others."""
    for begin in _unit.finditer(text):
        for n in _BY_UNIT:
            m = _addresses[n].match(text, begin.start())
            if m:
                yield Span(m.start(), m.end(), "street_address", _ADDRESS_SCORES[n])
    for gap in _before_number.finditer(text):
        if text.endswith(_STREET_ENDS, 0, gap.start()):
            line = max(0, gap.start() - 120)  # a street of two words
            for m in _addresses[_BY_STREET].finditer(text, line):
                if m.start() >= gap.start():
                    break
                if m.end() > gap.end():
                    yield Span(m.start(), m.end(), "street_address", _ADDRESS_SCORES[_BY_STREET])
                    break
    if any(word in text for word in _KIND_WORDS):
        for m in _addresses[_BY_KIND].finditer(text):
            yield Span(m.start(), m.end(), "street_address", _ADDRESS_SCORES[_BY_KIND])


# --- the name classifier --------------------------------------------------------------------------------------------
def _features(word: str) -> np.ndarray:
    """Hashed character n-grams of a word in title case; the parts of a compound count together."""
    marked = f"^{word[:1].upper()}{word[1:].lower()}$"
    grams = {marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)}
    grams |= {"<" + marked[-k:] for k in (4, 5, 6)} | {">" + marked[:k] for k in (4, 5)}
    return np.array(sorted({xxhash.xxh32_intdigest(g) % FEATURES for g in grams}))


def _fit_words(words: list[str], labels: list[int], weights: list[float], epochs: int = 40, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression by adaptive gradient steps in a fixed order: FEATURES weights and the intercept."""
    w, g = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-3)
    rows = [np.append(_features(x), FEATURES) for x in words]
    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            at = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at].sum(), -30, 30)))
            step = weights[i] * (p - labels[i]) + decay * w[at]
            g[at] += step * step
            w[at] -= rate * step / np.sqrt(g[at])
    return w


_label_names = re.compile(
    rf"(?m)(?:^[ \t]*(?:Full Name|Patient Name|Name|Holder|Candidate|Student|Contact|Attn\.|Dear|Registrar|Reports To|Attending Physician|Emergency contact|Insurance holder|Issued to|Note from|Sincerely,)[:,]?\s+|\b(?:Dr|Mr|Mrs|Ms|Prof)\.\s+)"
    rf"({_NAME_WORD}(?:[ ](?:{_PARTICLE}[ ])?{_NAME_WORD}){{0,3}}(?:,[ ]{_NAME_WORD})?)"
)
_word = re.compile(_NAME_WORD)


def _parts(word: str) -> list[str]:
    """The parts of a compound; what stands before an apostrophe ("O'") is none."""
    return [p for p in re.split(r"[-\s'’]+", word) if len(p) > 1]


def fit_names(rows: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of two classifiers, from (text, labels as JSON [{type, value}]) of labelled rows.

    The first tells words of names from other capitalised words, the second surnames from given names. Labels are
    hints: values are used where they stand in the text, with the names after titles and form labels.
    """
    yes, seen, first, last = Counter(), Counter(), Counter(), Counter()
    for text, truth in rows:
        if not text:
            continue
        try:
            items = json.loads(truth) if truth else []
        except ValueError:
            items = []
        lowered = text.lower()
        found = [m[1] for m in _label_names.finditer(text)]
        for item in items if isinstance(items, list) else []:
            if isinstance(item, dict) and item.get("type") == "NAME" and isinstance(item.get("value"), str):
                at = lowered.find(item["value"].lower())
                if at >= 0:
                    found.append(text[at : at + len(item["value"])])
        for word in _word.findall(text):
            for part in _parts(word):
                seen[part.title()] += 1
        for name in set(found):
            words = [w for w in _word.findall(name) if len(w) > 1]
            for word in words:
                for part in _parts(word):
                    yes[part.title()] += 1
            if "," in name and len(words) == 2:
                words = words[::-1]
            if len(words) >= 2 and ("," not in name or len(words) == 2):
                first[_parts(words[0])[0].title() if _parts(words[0]) else words[0]] += 1
                for part in _parts(words[-1]):
                    last[part.title()] += 1
    words = sorted(seen)
    labels = [int(yes[w] >= 0.2 * seen[w]) for w in words]
    name_weights = _fit_words(words, labels, [min(3.0, 1 + np.log(seen[w])) for w in words])
    both = sorted({*first, *last})
    place = _fit_words(both, [int(last[w] > first[w]) for w in both], [1.0] * len(both))
    return name_weights, place


class NameScorer:
    """Scores of words, remembered: likely in a name (> 0), and as a surname (> 0). Without weights every word may be
    one, and only titles and labels before a name tell."""

    def __init__(self, weights: np.ndarray | None = None, place: np.ndarray | None = None):
        self.weights, self.place = weights, place
        self.known: dict[str, tuple[float, float]] = {}
        self.dull: set[str] = set()  # sequences without a word that may be in a name

    def __call__(self, word: str) -> tuple[float, float]:
        if self.weights is None:
            return 0.01, 0.0
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            rows = [np.append(_features(p), FEATURES) for p in _parts(re.sub(r"-\s+(?=[a-zß-öø-ÿ])", "", word)) or [word]]
            got = self.known[word] = (min(float(self.weights[r].sum()) for r in rows), max(float(self.place[r].sum()) for r in rows))
        return got


@dataclass
class _Word:
    start: int
    end: int
    begin: int  # with its particle
    initial: bool
    name: float
    surname: float


def _name_runs(text: str, score: NameScorer) -> Iterator[list[_Word]]:
    """Maximal runs of words that look like names, with initials and particles between them."""
    for m in _sequence.finditer(text):
        if m[0] in score.dull:
            continue
        run: list[_Word] = []
        dull = True
        for p in _piece.finditer(m[0]):
            a = m.start() + (p.start(2) if p[2] else p.start(3))
            word = p[2] or p[3]
            initial = p[2] is not None
            name, surname = (0.5, 0.0) if initial else score(word)
            if not initial and (word.lower() in _TITLES or len(word) < 2 or name <= 0 or word.isupper() and len(word) <= 3):
                if run:
                    yield run
                run = []
                continue
            dull = False
            begin = m.start() + p.start(1) if p[1] and run else a
            if run and begin == a and p[1]:
                yield run
                run = []
            if run and "\n" in text[run[-1].end : begin] and (score.weights is None or _company_line.match(text, a)):
                yield run  # the company on the next line
                run = []
            if run and not initial and not run[-1].initial and "\n" in text[run[-1].end : begin] and len(run) >= 2 and surname < 0 < run[-1].surname:
                yield run  # another name begins on the next line
                run = []
            run.append(_Word(a, a + len(word), begin, initial, name, surname))
        if run:
            yield run
        if dull and len(m[0]) < 60:
            if len(score.dull) > 300_000:
                score.dull.clear()
            score.dull.add(m[0])


def _split_run(run: list[_Word]) -> Iterator[list[_Word]]:
    """A run of several names in a row is cut before a given name that follows a surname."""
    part: list[_Word] = []
    for i, word in enumerate(run):
        if len(part) >= 2 and not word.initial and word.surname < -1 and part[-1].surname > 1 and i + 1 < len(run):
            yield part
            part = []
        part.append(word)
    yield part


def _name_spans(text: str, score: NameScorer) -> Iterator[Span]:
    runs = [part for run in _name_runs(text, score) for part in _split_run(run)]
    used = set()
    for i, run in enumerate(runs):
        if i in used:
            continue
        while run and run[-1].initial:
            run = run[:-1]  # an initial at the end is the end of a sentence or of something else
        words = [w for w in run if not w.initial]
        if not words:
            continue
        start, end = run[0].start, run[-1].end
        if _company_after.match(text[end : end + 40]):
            continue
        before = _before(text, start)
        titled = _title_before.search(before) is not None
        if score.weights is None and not titled and not _name_label.search(before):
            continue
        # surname first: one surname, a comma, a given name or two
        if len(run) == 1 and words[0].surname > 0 and i + 1 < len(runs):
            after = runs[i + 1]
            given = [w for w in after if not w.initial]
            gap = text[end : after[0].start]
            if re.fullmatch(r",\s{1,4}", gap) and given and len(after) <= 3 and all(w.surname < 0.5 for w in given) and not _company_after.match(text[after[-1].end : after[-1].end + 40]):
                used.add(i + 1)
                while after[-1].initial and text[after[-1].end : after[-1].end + 1] == "\n":
                    after = after[:-1]
                yield Span(start, after[-1].end, "name", 1.0)
                continue
        if len(run) == 1:
            if titled and words[0].name > 0:
                yield Span(start, end, "name", 0.9)
            continue
        mean = sum(w.name for w in words) / len(words)
        value = 0.42 + min(0.4, mean / 8) + 0.2 * titled + 0.1 * (_person_before.search(before) is not None) - 0.3 * (_place_before.search(before) is not None and not titled)
        if run[0].initial and mean < 1 and not titled:
            value -= 0.2
        yield Span(start, end, "name", value)


def spans_of(text: str, score: NameScorer) -> list[Span]:
    """The spans kept in a text, in order, without overlaps."""
    found = [*_email_spans(text), *_number_spans(text), *_code_spans(text), *_address_spans(text), *_name_spans(text, score)]
    out: list[Span] = []
    taken = bytearray(len(text))
    for s in sorted((x for x in found if x.score >= KEPT), key=lambda x: (-round(x.score, 6), x.start - x.end, x.start)):
        if not any(taken[s.start : s.end]):
            taken[s.start : s.end] = b"\1" * (s.end - s.start)
            if s.kind:
                out.append(s)
    return sorted(out, key=lambda x: x.start)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its placeholder and nothing else changed."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join(out) + text[at:]


def labelled_rows(df: DataFrame, key: str, text: str, truth: str, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str | None, str | None]]:
    """At most `sample_rows` rows with labels and `sample_chars` characters of text, the same ones whatever the order of
    the input: those of least hash, long ones too as far as there is room."""
    labelled = df.where(F.col(truth).isNotNull() & F.col(text).isNotNull())
    picked = labelled.select(F.xxhash64(F.col(key)).alias("_at"), F.xxhash64(text, truth).alias("_own"), F.length(text).alias("_n"))
    rows, left = [], sample_chars
    for r in picked.orderBy("_at", "_own").limit(sample_rows).collect():  # three numbers a row
        if r._n <= left:
            left -= r._n
            rows.append((r._at, r._own))
    if not rows:
        return []
    wanted = df.sparkSession.createDataFrame(rows, "_at long, _own long").distinct()
    own = labelled.select(F.col(text).alias("_text"), F.col(truth).alias("_truth"), F.xxhash64(F.col(key)).alias("_at"), F.xxhash64(text, truth).alias("_own"))
    taken = own.join(F.broadcast(wanted), ["_at", "_own"], "left_semi").orderBy("_at", "_own").limit(len(rows)).collect()
    return [(r._text, r._truth) for r in taken]


def find(df: DataFrame, key: str, text: str, truth: str, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, with_values: bool = False) -> DataFrame:
    """`key`, redacted, found ARRAY<STRUCT<pii_type, pii_value>> of every row; with_values: also values ARRAY<STRING>, what
    each placeholder stands for, in order and as it stands.

    pii_value is the value as it stands with every run of white space made one space; each distinct value of a text
    comes once. A null text gives null and an empty array; without labelled rows only names after a title or a label are
    found. Repeated rows repeat; null keys stay; other columns are not read. sample_rows and sample_chars bound what the
    name classifier is fitted on.
    """
    rows = labelled_rows(df, key, text, truth, sample_rows, sample_chars)
    weights = fit_names(rows) if rows else ()
    shared = df.sparkSession.sparkContext.broadcast(tuple(w.astype(np.float32) for w in weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = NameScorer(*shared.value)
        for batch in batches:
            masked, found, values = [], [], []
            for value in batch.column(1).to_pylist():
                spans = spans_of(value, score) if value else []
                masked.append(redact(value, spans) if value is not None else None)
                pairs = dict.fromkeys((s.kind, re.sub(r"\s+", " ", value[s.start : s.end])) for s in spans)
                found.append([{"pii_type": k, "pii_value": v} for k, v in pairs])
                values.append([value[s.start : s.end] for s in spans])
            kind = pa.list_(pa.struct([("pii_type", pa.string()), ("pii_value", pa.string())]))
            arrays = [batch.column(0), pa.array(masked, pa.string()), pa.array(found, kind)] + [pa.array(values, pa.list_(pa.string()))] * with_values
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "redacted", "found"] + ["values"] * with_values)

    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kept.schema['key'].dataType.simpleString()}, redacted string, found array<struct<pii_type:string,pii_value:string>>" + ", values array<string>" * with_values
    return map_batches(kept, run, schema).withColumnRenamed("key", key)
