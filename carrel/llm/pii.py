"""Problem 3: personal details in free text, found and replaced by typed placeholders.

Details are found by formats with checks (e-mail, phone, identity numbers, addresses) and, for names, by the places where
names stand (after 'Patient:', 'Dear Dr.', 'Signed:' and the like) together with a lexicon of given and family names that is
learnt from those places over all tables. Numbers are replaced by format-preserving pseudonyms: a keyed Feistel network
permutes their digits within the format, so that equal values stay linked across documents; names, e-mails and addresses
get keyed tags. Everything else of a text stays as it is.

Defined results: null or empty text holds no detail; repeated rows count once; overlapping finds are settled in favour of the
earlier, then the longer one; dates, organisations, devices, lots, signs and scores are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.session import cut, table

TYPES = ("NAME", "EMAIL", "PHONE", "ID", "ADDRESS")

# ---- numbers, mails, addresses --------------------------------------------------------------------------------------
_AT = r"\s*(?:@|\(\s*at\s*\)|\[\s*at\s*\]|\{\s*at\s*\}|<at>)\s*"
_DOT = r"(?:\.|\s*(?:\(\s*dot\s*\)|\[\s*dot\s*\]|\{\s*dot\s*\}|<dot>)\s*)"
EMAIL = re.compile(rf"(?<![\w.+-])[\w%+-]+(?:{_DOT}[\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])", re.I)

_AT_SIGN = re.compile(r"[(\[{<]\s*at\s*[)\]}>]", re.I)
_SEP = r"[\s./-]"
PHONE = re.compile(
    r"(?<![\w.,/+-])(?:"
    rf"(?:\+?1{_SEP}?)?(?:\([2-9]\d\d\)\s?|[2-9]\d\d{_SEP}?)[2-9]\d\d{_SEP}?\d{{4}}"  # North America
    rf"|(?:\+|(?<!\d[\s-])00)[1-9]\d{{0,2}}{_SEP}?(?:\(0\){_SEP}?)?\d{{1,5}}(?:{_SEP}?\d{{2,8}}){{1,5}}"  # with a country code
    r"|(?<!\d[\s-])0\d{1,4}[\s/-]\d{3,8}(?:[\s-]\d{1,5}){0,2}"  # area code with a leading 0
    r"|\(0\d{1,5}\)\s?\d{3,8}(?:[\s-]\d{1,5}){0,2}"
    r"|(?<!\d[\s-])0\d(?:[\s.]\d\d){4}"
    r")(?![\w/]|[.,-]\d)"
)
# Labels of identity numbers, and words before numbers that are none.
ID_LABEL = (
    r"(?:MRN|SSN|NHS(?:\s*(?:no|number))?|Social\s+security\s+(?:no|number|nr)|Soc\.?\s*sec\.?\s*(?:no|number)|Versicherten(?:nr|nummer)|Versicherungs(?:nr|nummer)|KVNR|Passport(?:\s+(?:no|number|nr))?|"
    r"Pass(?:nr|nummer)|Member(?:ship)?\s+(?:no|number|id|nr)|Patient(?:en)?[\s-]?(?:ID|no|number|nr|nummer)|Ausweis(?:nr|nummer)?|Medical\s+record\s+(?:no|number)|Insurance\s+(?:no|number)|Hospital\s+(?:no|number)|ID(?:\s*(?:no|number))?)"
)
ID = re.compile(rf"(?<!\w){ID_LABEL}\.?\s*[:#=]?\s*(?P<id>(?=[\w-]*\d)[A-Z]{{0,4}}-?\d[\dA-Z]*(?:[\s-]\d[\dA-Z]*){{0,4}}(?<=[\d\w]))(?!\w)", re.I)
# Without a label: national numbers by their general form (and check, id_holds), then forms of passports, insurers and hospitals,
# which have no public check; 000 and 666 are areas never issued, which specimens use.
ID_BARE = re.compile(
    r"(?<![\w-])(?P<id>(?P<ssn>\d{3}-\d\d-\d{4}|(?<!\d\s)\d{3} \d\d \d{4}|000\s\d\d\s\d{4})|(?P<nhs>(?<!\d\s)[1-9]\d\d \d{3} \d{4})"
    r"|[A-Z]{2,4}-\d{4,6}-\d\d|[A-Z]\d{9}|[A-Z]{2}\d{7}|P\d{6}|00\d{6})(?![\w-]|\.\d)"
)
_DIALLED = re.compile(r"(?:\+|(?<!\d)00)\d{1,3}[\s./-]?(?:\(0\)\s?)?$|\)\s?$")
_CALL = re.compile(r"(?:call|phone|telephone|tel|mobile|cell|fax|pager|reachable|contact)\b[\s:.]*(?:at|on|no|number)?[\s:.]*$", re.I)


def id_holds(m: re.Match) -> bool:
    """Whether a find of ID_BARE passes the check of its kind: SSN areas, groups and serials, NHS check digits."""
    before = m.string[max(0, m.start() - 40) : m.start()]
    if _NO_DETAIL.search(before):
        return False
    digits = re.sub(r"\D", "", m["id"])
    if m["ssn"]:
        area, group, serial = digits[:3], digits[3:5], digits[5:]
        if area in ("000", "666"):
            return True
        # from 900 on: taxpayer numbers, by their groups
        n = int(group)
        return not _DIALLED.search(before) and serial != "0000" and (n > 0 if area < "900" else 50 <= n <= 65 or 70 <= n <= 99 and n not in (89, 93))
    if m["nhs"]:
        # a number of the fictional exchange 555 or behind a word for calling is a phone's
        check = -sum(w * int(d) for w, d in zip(range(10, 1, -1), digits)) % 11
        return check == int(digits[9]) and digits[3:6] != "555" and not _DIALLED.search(before) and not _CALL.search(before)
    return True


_NO_DETAIL = re.compile(r"(?:serial|lot|batch|device|accession|readings?\s+(?:were|was|of)|sequence|series|request|form|protocol|code|ref(?:erence)?|order|model|version|catalogue|article|invoice)\b[\s:#.]*(?:no|nr|number)?[\s:#.]*$", re.I)

# How streets end or begin.
_STREET_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Drive|Dr|Avenue|Ave|Close|Court|Ct|Place|Pl|Way|Crescent|Cres|Terrace|Square|Sq|Row|Walk|Hill|Gardens|Grove|Boulevard|Blvd|Mews|Parade|Highway|Hwy|Circle|Cir)"
_STREET_DE = r"(?:stra(?:ß|ss)e|str\.?|weg|gasse|platz|allee|ring|kamp|grund|ufer|damm|steig|markt|hof|wall|berg|feld|stieg|pfad|chaussee|promenade)"
ADDRESS = [
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}\s?[A-Za-z]?\s+(?:[A-ZÄÖÜ][\w'-]+\s+){{1,3}}{_STREET_EN}(?!\w)(?:(?<=St)\.)?"),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}\s?[A-Z]?\s+(?:[A-ZÄÖÜ][A-ZÄÖÜ'-]+\s+){{1,3}}{_STREET_EN.upper()}\b(?:(?<=ST)\.)?"),
    re.compile(rf"(?<![\w-])[A-ZÄÖÜ][\wäöüß-]*?(?:{_STREET_DE})\s+\d{{1,4}}\s?[a-z]?(?![\w.]\w|\w)"),
    re.compile(rf"(?<![\w-])[A-ZÄÖÜ][A-ZÄÖÜ-]*?(?:STRASSE|STRAßE|STR\.?|WEG|GASSE|PLATZ|ALLEE|RING|KAMP|GRUND)\s+\d{{1,4}}\s?[A-Za-z]?(?!\w)"),
    re.compile(rf"(?<![\w-])[A-ZÄÖÜ][\wäöüß-]+\s+(?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee|Ring|Ufer|Damm)\s+\d{{1,4}}\s?[a-z]?(?!\w)"),
    re.compile(r"(?<![\w-])(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Unter der|Hinter der|Bei der|Beim|Vor dem|AM|IM|AN DER|ZUM|ZUR)\s+(?:[A-ZÄÖÜ][\wäöüß-]+\s+){1,3}\d{1,4}\s?[A-Za-z]?(?!\w|\.\d)"),
    re.compile(r"(?<!\w)(?:P\.?\s?O\.?\s*Box|PO\s*Box|Postbox|Postfach|Post\s+Office\s+Box)\s+\d{1,6}(?!\w)", re.I),
]
#: Where phone numbers may begin.
_PHONE_AT = re.compile(r"(?<![\w.,/+-])[+(\d]")
#: Where numbers without a label may begin.
_BARE_AT = re.compile(r"(?<![\w-])(?:\d{3}|[A-Z]{1,4}-?\d{4})")
_WARD = re.compile(r"^\d{1,4}\s+(?:mg|ml|mm|cm|kg|days?|weeks?|hours?|year)", re.I)

# ---- names ----------------------------------------------------------------------------------------------------------
_CAP = r"[A-ZÄÖÜÁÉÍÓÚÀÈÇÑØÅ][\w'’]+"
_PARTICLE = r"(?:(?:van|von|de|del|della|der|den|du|la|le|zu|ter|VAN|VON|DE|DER|DEN|Van|Von|De)\s+){0,2}"
_FAMILY = rf"{_PARTICLE}{_CAP}(?:-{_CAP})*"
_FULL = rf"(?:{_FAMILY},\s+{_CAP}(?:\s+[A-Z]\.)?(?![\w-])|{_CAP}(?:-{_CAP})?\s+(?:[A-Z]\.\s+)?{_FAMILY}|[A-Z]\.\s+(?:[A-Z]\.\s+)?{_FAMILY})"
_TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Herr|Frau|Herrn|Sr|Sra|Mme|Mlle)\b\.?"
# What stands before a name in notes, letters and reports.
_PLACES = (
    r"(?:Patient|Name|Patientin|Pat\.|Dear|seeing|Signed|Reviewed\s+by|Dictated\s+by|Read\s+by|Reported\s+by|Approved\s+by|Verified\s+by|Attending\s+physician|Attending|Physician|Radiologist|Consultant|Next\s+of\s+kin|telephone\s+to|phone\s+to|"
    r"According\s+to|Copy\s+to|Cc|discussed\s+with|informed|gez\.|Referred\s+by|Referring\s+physician|c/o|contact|reported\s+by|daughter|son|wife|husband|mother|father|sister|brother|for)"
)
PLACED = re.compile(rf"(?<!\w)(?:{_PLACES})\s*[:/]?\s+(?:{_TITLE}\s+)*(?P<name>{_FULL})(?!\w)")
TITLED = re.compile(rf"(?<!\w)(?:{_TITLE}\s+)+(?P<name>{_FULL}|{_FAMILY})(?!\w)")
SLASHED = re.compile(rf"\d{{4}}-\d\d-\d\d\s*/\s*(?P<name>{_FULL})(?!\w)")
_NO_PERSON = re.compile(
    r"\s*(?:['’]s\s+)?(?:sign|score|test|criteria|index|syndrome|disease|scale|classification|grade|manoeuvre|reflex|line|point|view|method|Clinic|Hospital|General|Day\s+Surgery|Imaging|Centre|Center|Medical|Klinikum|Practice|Health|Institute|University)\b",
    re.I,
)
# Capitalised words that begin sentences or name houses and offices, never people.
NOT_NAMES = frozenset(
    """the a an and of no if he she they we at on in for with from this that there it is was results home please call write read results family history findings
    blood pressure oxygen saturation patient patients name date note notes summary letter visit report clinic hospital general centre center klinikum surgery day imaging medical record records
    discharge admission operation telephone referral emergency indication comparison impression technique ct mri xr us echo chest abdomen brain contrast device reachable seen born social security passport
    member mrn ssn versichertennr id address email mail phone incidental compared potassium sodium calcium platelet urea lactate bilirubin axial coronal sagittal delayed venous arterial post
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
    consultant neurology cardiology oncology radiology nephrology pulmonology orthopaedics physiotherapy endocrinology""".split()
) - {"march", "may", "day"}


def _words(name: str) -> list[str]:
    return [w for w in re.findall(r"[\w'’]+", name)]


_TOKEN, _PART = re.compile(r"[\w'’]+"), re.compile(r"\w+")


def name_pieces(text: str) -> set[str]:
    """Lower-case forms of a text that may be words of the lexicon: words, and their parts between apostrophes."""
    low = text.lower()
    out = set(_PART.findall(low))
    if "'" in low or "’" in low:
        for token in _TOKEN.findall(low):
            if "'" in token or "’" in token:
                parts = re.findall(r"\w+|['’]", token)
                out.update("".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1))
    return out


class Lexicon:
    """Known given and family names, lower case; a part of a double name counts by itself."""

    def __init__(self, given: frozenset[str], family: frozenset[str], rest: DataFrame | None = None) -> None:
        self.given, self.family = given, family
        #: (kind, word) of the words that are too many to travel to the tasks; texts meet them in a join
        self.rest = rest

    def given_in(self, text: str) -> Iterator[tuple[int, int]]:
        """Where given names stand, by look-up of the words, however many names there are; of names at one place the longest."""
        hits = self.given & name_pieces(text)
        if not hits:
            return
        low = text.lower()
        if len(low) != len(text):  # letters whose small form is longer
            low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        found = []
        for word in hits:
            s = low.find(word)
            while s >= 0:
                e = s + len(word)
                before, after = text[s - 1 : s], text[e : e + 1]
                if not (before.isalnum() or before in ("_", "@", ".", "-") or after.isalnum() or after in ("_", "@")):
                    found.append((s, -e))
                s = low.find(word, s + 1)
        at = 0
        for s, e in sorted(found):
            if s >= at:
                yield s, -e
                at = -e

    def is_family(self, text: str) -> bool:
        parts = [p for p in re.split(r"[\s-]+", text.lower()) if p not in ("van", "von", "de", "der", "den")]
        return bool(parts) and all(p in self.family for p in parts)


def placed_names(text: str) -> Iterator[tuple[int, int]]:
    """Names by the place they stand at alone."""
    slash = "/" in text
    for pattern in (PLACED, TITLED, SLASHED):
        if pattern is SLASHED and not slash:
            continue
        for m in pattern.finditer(text):
            if _plausible(m["name"]) and not _NO_PERSON.match(text, m.end("name")):
                yield m.span("name")


def _plausible(name: str) -> bool:
    words = [w.lower() for w in _words(name) if len(w) > 1]
    return bool(words) and not any(w in NOT_NAMES or any(c.isdigit() for c in w) for w in words)


def name_words(text: str) -> Iterator[tuple[str, str]]:
    """('given' or 'family', word) of names whose place is sure."""
    for start, end in placed_names(text):
        name = re.sub(r"\s+", " ", text[start:end])
        if "," in name:
            family, given = name.split(",", 1)
        else:
            given, _, family = name.partition(" ")
            if not family:
                family, given = given, ""
        given = _words(given)[0].lower() if _words(given) else ""
        if len(given) > 2 and given not in ("van", "von", "der", "den"):
            yield "given", given
        for w in re.split(r"[\s-]+", family):
            if len(w.strip(".")) > 2 and w.lower() not in ("van", "von", "der", "den"):
                yield "family", w.lower()


_AFTER_GIVEN = re.compile(rf"\s+(?:[A-Z]\.?\s+)?(?P<family>{_PARTICLE}[\w'’]+(?:-[\w'’]+)*)", re.I)
_BEFORE_GIVEN = re.compile(rf"(?P<family>{_PARTICLE}{_CAP}(?:-{_CAP})*),\s+$")
_INITIAL = re.compile(rf"(?<![\w.])[A-Z]\.\s+(?P<family>{_FAMILY})(?![\w])")


def lexicon_names(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """Names with a known given name, or an initial and a known family name."""
    if lexicon.given:
        for start, end in lexicon.given_in(text):
            lower = text[start].islower()
            after = _AFTER_GIVEN.match(text, end)
            if after:
                family = after["family"]
                known = lexicon.is_family(family)
                capital = family.split()[-1][0].isupper() and not lower
                if (known and (capital or family.islower() == lower or text[start:end].isupper())) or (capital and _plausible(family) and not family.split()[-1].lower() in lexicon.given):
                    if not _NO_PERSON.match(text, after.end("family")):
                        yield start, after.end("family")
                        continue
            before = _BEFORE_GIVEN.search(text, max(0, start - 60), start)
            if before and (before["family"].isupper() or lexicon.is_family(before["family"])) and _plausible(before["family"]):
                initial = re.compile(r"\s+[A-Z]\.(?!\w)").match(text, end)
                yield before.start("family"), initial.end() if initial and not re.match(r"\s+[A-Z]", text[initial.end() : initial.end() + 3] or "") else end
                continue
            if not lower and not _NO_PERSON.match(text, end) and not re.match(r"-\w", text[end : end + 2]):
                yield start, end
    for m in _INITIAL.finditer(text):
        if lexicon.is_family(m["family"]) and not _NO_PERSON.match(text, m.end()):
            yield m.span()
    if _SAYS.search(text):
        for m in _FAMILY_ALONE.finditer(text):
            if lexicon.is_family(m["family"]):
                yield m.span("family")


_SPEAKS = r"\s+(?:says|reports|said|states|told|feels|asked|denies|complains|was\s+seen|is\s+seen|has\s+been\s+seen)\b"
_SAYS = re.compile(r"[\w'’]" + _SPEAKS)
_FAMILY_ALONE = re.compile(rf"(?<![\w.-])(?P<family>{_FAMILY})(?={_SPEAKS})")


def _from(starts: re.Pattern, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """pattern.finditer(text), tried only where one of the starts stands, without which it cannot match."""
    at = 0
    for m in starts.finditer(text):
        if m.start() >= at and (hit := pattern.match(text, m.start())):
            yield hit
            at = hit.end()


def find_details(text: str | None, lexicon: Lexicon, alone: bool = False) -> list[tuple[str, int, int]]:
    """(type, start, end) of the details of a text, in order and without overlap. alone: the text is a single field."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text or _AT_SIGN.search(text):
        found += [("EMAIL", *m.span()) for m in EMAIL.finditer(text)]
    for m in ID.finditer(text):
        found.append(("ID", *m.span("id")))
    for m in _from(_BARE_AT, ID_BARE, text):
        if id_holds(m):
            found.append(("ID", *m.span("id")))
    for m in _from(_PHONE_AT, PHONE, text):
        digits = sum(c.isdigit() for c in m[0])
        if 7 <= digits <= 15 and not _NO_DETAIL.search(text, max(0, m.start() - 40), m.start()):
            found.append(("PHONE", *m.span()))
    low = text.lower()
    box = "box" in low or "postfach" in low
    for k, pattern in enumerate(ADDRESS):
        if k == 6 and not box:
            continue
        for m in pattern.finditer(text):
            if not _WARD.match(m[0]):
                found.append(("ADDRESS", *m.span()))
    for start, end in (*placed_names(text), *lexicon_names(text, lexicon)):
        found.append(("NAME", start, end))
    rank = {"EMAIL": 0, "ID": 1, "PHONE": 2, "ADDRESS": 3, "NAME": 4}
    kept: list[tuple[str, int, int]] = []
    for t, s, e in sorted(found, key=lambda x: (rank[x[0]], -(x[2] - x[1]), x[1])):
        if all(e <= ks or s >= ke for _, ks, ke in kept):
            kept.append((t, s, e))
    return sorted(kept, key=lambda x: x[1])


# ---- pseudonyms -----------------------------------------------------------------------------------------------------
def _round(key: bytes, tweak: str, i: int, value: str, modulus: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{value}".encode(), key=key[:64], digest_size=16).digest(), "big") % modulus


def feistel_digits(digits: str, key: bytes, tweak: str = "", rounds: int = 8, back: bool = False) -> str:
    """Keyed permutation of the decimal strings of one length, by an alternating Feistel network."""
    n = len(digits)
    if n < 2:
        return str((int(digits or 0) + (-1 if back else 1) * _round(key, tweak, 0, str(n), 10)) % 10) if n else ""
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in reversed(range(rounds)) if back else range(rounds):
        m = u if i % 2 == 0 else n - u
        if back:
            c, b = b, a
            a = str((int(c) - _round(key, tweak, i, b, 10**m)) % 10**m).zfill(m)
        else:
            c = str((int(a) + _round(key, tweak, i, b, 10**m)) % 10**m).zfill(m)
            a, b = b, c
    return a + b


def pseudonym_number(text: str, key: bytes, back: bool = False) -> str:
    """The digits of a number permuted in place; letters and signs stay. Spellings of one number stay linked by their digits."""
    digits = re.sub(r"\D", "", text)
    new = iter(feistel_digits(digits, key, f"number{len(digits)}", back=back))
    return re.sub(r"\d", lambda _: next(new), text)


FIRST_DAY, DAYS = date(1900, 1, 1), 73_000


def pseudonym_date(iso: str, key: bytes, first: date = FIRST_DAY, days: int = DAYS, back: bool = False) -> str:
    """A date of the given span permuted within it, by walking the cycles of a five-digit Feistel permutation."""
    n = (date.fromisoformat(iso) - first).days
    if not 0 <= n < days:
        return iso
    while True:
        n = int(feistel_digits(str(n).zfill(5), key, "date", back=back))
        if n < days:
            return (first + timedelta(days=n)).isoformat()


# Dates by their notation: year first, day first with full stops, month first with slashes.
DATE = re.compile(r"(?<![\w./-])(?:(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)|(?P<d2>\d{1,2})\.(?P<m2>\d{1,2})\.(?P<y2>\d{4})|(?P<m3>\d{1,2})/(?P<d3>\d{1,2})/(?P<y3>\d{4}))(?![\w/-]|\.\d)")


def pseudonym_dates(text: str, key: bytes, back: bool = False) -> str:
    """Every valid date of a text permuted within its notation; notations of one day stay linked. Other text stays."""

    def other(m: re.Match) -> str:
        kind = next(k for k in ("", "2", "3") if m["y" + k])
        try:
            iso = date(int(m["y" + kind]), int(m["m" + kind]), int(m["d" + kind])).isoformat()
        except ValueError:
            return m[0]
        y, mo, d = pseudonym_date(iso, key, back=back).split("-")
        if kind == "":
            return f"{y}-{mo}-{d}"
        return f"{d}.{mo}.{y}" if kind == "2" else f"{mo}/{d}/{y}"

    return DATE.sub(other, text)


def placeholder(kind: str, text: str, key: bytes) -> str:
    """[TYPE pseudonym]: numbers permuted within their format, a keyed tag for anything else. Equal details have equal ones."""
    plain = re.sub(r"\s+", " ", text).strip()
    if kind in ("PHONE", "ID"):
        return f"[{kind} {pseudonym_number(plain, key)}]"
    tag = hashlib.blake2b(f"{kind}|{plain.casefold()}".encode(), key=key[:64], digest_size=4).hexdigest()
    return f"[{kind} {tag}]"


def redact(text: str | None, lexicon: Lexicon, key: bytes, dates: bool = False) -> str | None:
    """The text with every detail replaced by its placeholder. dates: days are permuted as well, each within its notation."""
    if not text:
        return text
    out, at = [], 0
    keep = (lambda t: pseudonym_dates(t, key)) if dates else (lambda t: t)
    for kind, s, e in find_details(text, lexicon):
        out += [keep(text[at:s]), placeholder(kind, text[s:e], key)]
        at = e
    return "".join(out) + keep(text[at:])


# ---- tables ---------------------------------------------------------------------------------------------------------
def learn_lexicon(texts: DataFrame, least: int = 2, most: int = 200_000) -> Lexicon:
    """Name words that stand at sure places at least `least` times over all texts (column text). The `most` most frequent
    of each kind travel to the tasks, the others are the rest that texts meet in a join."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in parts:
            for text in pdf["text"]:
                seen.update(name_words(text))
        yield pd.DataFrame([(k, w, n) for (k, w), n in seen.items()], columns=["kind", "word", "n"])

    counted = texts.select("text").where("text IS NOT NULL").mapInPandas(count, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = cut(counted)  # read once for each kind
    words: dict[str, frozenset] = {}
    beyond = None
    for kind in ("given", "family"):
        rows = counted.where(F.col("kind") == kind).orderBy(F.desc("n"), "word").limit(most + 1).collect()
        if len(rows) > most:
            first = rows.pop()
            rarer = (F.col("kind") == kind) & ((F.col("n") < first["n"]) | ((F.col("n") == first["n"]) & (F.col("word") >= first["word"])))
            beyond = rarer if beyond is None else beyond | rarer
        words[kind] = frozenset(r["word"] for r in rows if r["word"] not in NOT_NAMES)
    rest = None if beyond is None else cut(counted.where(beyond & ~F.col("word").isin(sorted(NOT_NAMES))).select("kind", "word"))
    return Lexicon(words["given"], words["family"], rest)


def with_rest(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """texts with a column rest: array<struct<kind, word>> of the words of lexicon.rest that each text holds, or null."""
    if lexicon.rest is None:
        return texts.withColumn("rest", F.lit(None).cast("array<struct<kind: string, word: string>>"))

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(k, w) for k, t in zip(pdf["key"], pdf["text"]) for w in name_pieces(t)], columns=["key", "word"])

    # equal texts hold equal words
    pieces = texts.where("text IS NOT NULL").select(F.md5("text").alias("key"), "text").dropDuplicates(["key"]).mapInPandas(split, "key string, word string")
    held = pieces.join(lexicon.rest, "word").groupBy("key").agg(F.collect_list(F.struct("kind", "word")).alias("rest"))
    return texts.withColumn("key", F.md5("text")).join(held, "key", "left").drop("key")


def lexicon_of(text: str, known: Lexicon, rest) -> Lexicon:
    """The lexicon as far as it concerns a text: the known one, or where the text holds words of the rest, what it holds of both."""
    if rest is None or not len(rest):
        return known
    pieces = name_pieces(text)
    more = {kind: {r["word"] for r in rest if r["kind"] == kind} for kind in ("given", "family")}
    return Lexicon(frozenset(pieces & known.given | more["given"]), frozenset(pieces & known.family | more["family"]))


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, text) of the three tables, repeated rows once."""
    one = lambda name, i, t: table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(i).cast("bigint").alias("record_id"), F.col(t).alias("text"))
    rows = one("extract_train", "record_id", "document_text").unionByName(one("radiology_train", "report_id", "report_text")).unionByName(one("phi_entity", "entity_id", "value_text"))
    return rows.where("record_id IS NOT NULL AND text IS NOT NULL").distinct()


def details(texts: DataFrame, lexicon: Lexicon, key: bytes) -> DataFrame:
    """(source_table, record_id, phi_type, phi_text, placeholder, char_start, char_end) of all details.

    placeholder is what stands for the detail in the redacted text, under the key.
    """
    names = ["source_table", "record_id", "phi_type", "phi_text", "placeholder", "char_start", "char_end"]
    given, family = lexicon.given, lexicon.family

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Lexicon(given, family)
        for pdf in parts:
            out = []
            for source, i, text, rest in zip(pdf["source_table"], pdf["record_id"], pdf["text"], pdf["rest"]):
                for kind, s, e in find_details(text, lexicon_of(text, known, rest)):
                    plain = re.sub(r"\s+", " ", text[s:e]).strip()
                    out.append((source, i, kind, plain, placeholder(kind, plain, key), s, e))
            yield pd.DataFrame(out, columns=names)

    return with_rest(texts, lexicon).mapInPandas(run, "source_table string, record_id bigint, phi_type string, phi_text string, placeholder string, char_start bigint, char_end bigint")


#: Key of the queries; a real one is a secret of at least 16 bytes.
DEMO_KEY = b"demonstration key"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = all_texts(spark, sf_dir)
    return details(texts, learn_lexicon(texts), DEMO_KEY).select("source_table", "record_id", "phi_type", "phi_text").distinct()


def redacted(texts: DataFrame, lexicon: Lexicon, key: bytes, dates: bool = False) -> DataFrame:
    """(source_table, record_id, text) with every detail replaced by its placeholder, and with dates every day permuted."""
    given, family = lexicon.given, lexicon.family

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Lexicon(given, family)
        for pdf in parts:
            done = [redact(t, lexicon_of(t, known, rest), key, dates) for t, rest in zip(pdf["text"], pdf["rest"])]
            yield pdf.assign(text=done).drop(columns="rest")

    return with_rest(texts, lexicon).mapInPandas(run, "source_table string, record_id bigint, text string")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with placeholders, under a fixed demonstration key."""
    texts = all_texts(spark, sf_dir)
    return redacted(texts, learn_lexicon(texts), DEMO_KEY)
