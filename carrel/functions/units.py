"""Quantities in mixed units: a small grammar, exponent vectors, scale and offset.

A unit is (scale, offset, exponents). Exponents are over (length, mass, time, temperature, angle);
multiplying units adds exponents, powers multiply them. A value in unit u is value * scale + offset
in the canonical unit of its dimension (metre, kilogram, second, kelvin, radian).

Defined results: null or blank text holds no quantity; a number without any unit anywhere is no
quantity; a text of several current dimensions yields the largest; earlier sizes, normal limits and
image, series, level or segment numbers never count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

Exponents = tuple[int, int, int, int, int]
NONE: Exponents = (0, 0, 0, 0, 0)
LENGTH: Exponents = (1, 0, 0, 0, 0)


@dataclass(frozen=True)
class Unit:
    scale: Fraction
    exponents: Exponents
    offset: Fraction = Fraction(0)

    def times(self, other: "Unit", power: int = 1) -> "Unit":
        exps = tuple(a + power * b for a, b in zip(self.exponents, other.exponents))
        return Unit(self.scale * other.scale**power, exps)

    def power(self, n: int) -> "Unit":
        return Unit(self.scale**n, tuple(n * e for e in self.exponents), self.offset if n == 1 else Fraction(0))


def _base(i: int) -> Exponents:
    return tuple(int(k == i) for k in range(5))


# SI prefixes, unit names and their definitions.
PREFIXES = {"n": Fraction(1, 10**9), "µ": Fraction(1, 10**6), "u": Fraction(1, 10**6), "m": Fraction(1, 1000), "c": Fraction(1, 100), "d": Fraction(1, 10), "k": Fraction(1000)}
LONG_PREFIXES = {"nano": "n", "micro": "µ", "milli": "m", "centi": "c", "zenti": "c", "deci": "d", "kilo": "k"}
PREFIXED = {
    "m": Unit(Fraction(1), _base(0)),
    "g": Unit(Fraction(1, 1000), _base(1)),
    "s": Unit(Fraction(1), _base(2)),
    "l": Unit(Fraction(1, 1000), (3, 0, 0, 0, 0)),
}
LONG_NAMES = {
    "metre": "m", "metres": "m", "meter": "m", "meters": "m", "litre": "l", "litres": "l", "liter": "l", "liters": "l",
    "gram": "g", "grams": "g", "second": "s", "seconds": "s",
}
PLAIN = {
    "in": Unit(Fraction(254, 10000), LENGTH),
    "inch": Unit(Fraction(254, 10000), LENGTH),
    "inches": Unit(Fraction(254, 10000), LENGTH),
    '"': Unit(Fraction(254, 10000), LENGTH),
    "''": Unit(Fraction(254, 10000), LENGTH),
    "″": Unit(Fraction(254, 10000), LENGTH),
    "ft": Unit(Fraction(3048, 10000), LENGTH),
    "feet": Unit(Fraction(3048, 10000), LENGTH),
    "foot": Unit(Fraction(3048, 10000), LENGTH),
    "micron": Unit(Fraction(1, 10**6), LENGTH),
    "microns": Unit(Fraction(1, 10**6), LENGTH),
    "cc": Unit(Fraction(1, 10**6), (3, 0, 0, 0, 0)),
    "min": Unit(Fraction(60), _base(2)),
    "h": Unit(Fraction(3600), _base(2)),
    "bpm": Unit(Fraction(1, 60), (0, 0, -1, 0, 0)),
    "%": Unit(Fraction(1, 100), NONE),
    "hu": Unit(Fraction(1), NONE),
    "°": Unit(Fraction(17453292519943, 10**15), _base(4)),
    "deg": Unit(Fraction(17453292519943, 10**15), _base(4)),
    "degree": Unit(Fraction(17453292519943, 10**15), _base(4)),
    "degrees": Unit(Fraction(17453292519943, 10**15), _base(4)),
    "°c": Unit(Fraction(1), _base(3), Fraction(27315, 100)),
    "°f": Unit(Fraction(5, 9), _base(3), Fraction(45967, 180)),
}
POWERS = {"²": 2, "³": 3, "⁻": -1}


@lru_cache(maxsize=4096)
def unit_symbol(name: str) -> Unit | None:
    """One unit name without powers; upper-case spellings count, a capital M after a blank prefix does not mean mega."""
    low = name.lower().replace("μ", "µ")
    if low in PLAIN:
        return PLAIN[low]
    if low.endswith("s") and len(low) == 3 and low[:-1] in ("mm", "cm"):  # "cms", "mms"
        low = low[:-1]
    for long, short in LONG_PREFIXES.items():
        if low.startswith(long) and low[len(long) :] in LONG_NAMES:
            return _prefixed(short + LONG_NAMES[low[len(long) :]])
    if low in LONG_NAMES:
        return PREFIXED[LONG_NAMES[low]]
    return _prefixed(low)


def _prefixed(low: str) -> Unit | None:
    if low in PREFIXED:
        return PREFIXED[low]
    if len(low) == 2 and low[0] in PREFIXES and low[1] in PREFIXED:
        u = PREFIXED[low[1]]
        return Unit(u.scale * PREFIXES[low[0]], u.exponents)
    return None


_NAME = r"(?:[A-Za-zµμ]+|°[CF]?|%|\"|''|″)"
_FACTOR = re.compile(rf"\s*({_NAME})\.?(\^?-?[1-9](?![\d.,])|[²³])?")
_LINK = re.compile(r"\s*(/|per\b|\*|·)\s*")


def parse_unit(text: str, at: int = 0) -> tuple[Unit, int] | None:
    """unit := factor (('/' | 'per' | '*') factor)*; factor := name power?. Gives the unit and where it ends."""
    m = _FACTOR.match(text, at)
    if not m:
        return None
    first = unit_symbol(m[1])
    if first is None:
        return None
    unit, end = first.power(_power(m[2])), m.end()
    while link := _LINK.match(text, end):
        f = _FACTOR.match(text, link.end())
        nxt = f and unit_symbol(f[1])
        if not nxt:
            break
        unit = unit.times(nxt.power(_power(f[2])), -1 if link[1] in ("/", "per") else 1)
        end = f.end()
    return unit, end


def _power(text: str | None) -> int:
    if not text:
        return 1
    return POWERS.get(text) or int(text.lstrip("^"))


_DIGITS = r"(?:\d+(?:[.,]\d+)?|[.,]\d+)(?:\s+(\d)/(\d))?"
_NUMBER = re.compile(rf"(?<![\w.,]){_DIGITS}")
#: A number that may follow a unit or a cross directly.
_NUMBER_HERE = re.compile(_DIGITS)
_TIMES = re.compile(r"\s*(?:x|×|\*|by)\s*(?=[\d.,])", re.I)
_RANGE = re.compile(r"\s*(?:-|–|to)\s*(?=[\d.,])", re.I)
# Words before a number that say it is no current size.
_OTHER_BEFORE = re.compile(
    r"(?:\b(?:previously|previous|prev\.?|prior|before|was|were|formerly|earlier|initially|old|from|vorher|zuvor|"
    r"normal(?:\s+(?:limit|range|value|up to))?|norm\.?|limit|reference|ref\.?|range|upper limit|"
    r"series|image|images|img|im\.?|se\.?|level|segment|slice|no\.?|nr\.?|number|grade|type)|[<>≤≥])\s*[:=]?\s*(?:size\s*)?(?:of\s*)?(?:[<>≤≥]\s*)?$",
    re.I,
)


@dataclass(frozen=True)
class Quantity:
    value: Fraction
    unit: Unit | None
    start: int
    end: int
    other: bool  # an earlier size, a limit or a number of something

    @property
    def canonical(self) -> Fraction:
        return self.value * self.unit.scale + self.unit.offset


def _value(m: re.Match) -> Fraction:
    whole = m[0]
    if m[1]:
        whole = re.split(r"\s+", whole)[0]
        return Fraction(whole.replace(",", ".")) + Fraction(int(m[1]), max(1, int(m[2])))
    return Fraction(whole.replace(",", "."))


def quantities(text: str | None) -> list[Quantity]:
    """All numbers of a text with their units; in a product or range, a missing unit is the next one given."""
    out: list[Quantity] = []
    if not text:
        return out
    at = 0
    while m := _NUMBER.search(text, at):
        # the words before a number, at most 48 characters besides the white space next to it
        before = m.start()
        while before and text[before - 1].isspace():
            before -= 1
        other = bool(_OTHER_BEFORE.search(text, max(0, before - 48), m.start()))
        group: list[tuple[Fraction, Unit | None, int, int]] = []
        while True:
            unit, end = _unit_after(text, m.end())
            group.append((_value(m), unit, m.start(), end))
            link = _TIMES.match(text, end) or (_RANGE.match(text, end) if not other else None)
            nxt = link and _NUMBER_HERE.match(text, link.end())
            if not nxt:
                break
            m = nxt
        unit = None
        filled = []
        for value, own, s, e in reversed(group):
            unit = own or unit
            filled.append(Quantity(value, unit, s, e, other))
        # a unit given only with the first member holds for the whole product
        lead = next((u for _, u, _, _ in group if u), None)
        out += [q if q.unit else Quantity(q.value, lead, q.start, q.end, q.other) for q in reversed(filled)]
        at = max(end, m.end())
    return out


_PREPOSITION = re.compile(r"\s*in\s+(?:the\s+)?(?:long|largest|greatest|maximum|axial|coronal|sagittal)\b", re.I)
_GLUED = re.compile(r"\s*(" + _NAME + r")\.?(?=\d|[.,]\d)")


def _unit_after(text: str, at: int) -> tuple[Unit | None, int]:
    if _PREPOSITION.match(text, at):
        return None, at
    # "12 mmx9 mm": the cross may be written on to the unit
    glued = _GLUED.match(text, at)
    if glued and glued[1][-1] in "xX" and (unit := unit_symbol(glued[1][:-1])):
        return unit, glued.end(1) - 1
    if at < len(text) and text[at] in "xX×":
        return None, at
    found = parse_unit(text, at)
    if not found:
        return None, at
    unit, end = found
    if end < len(text) and (text[end].isalnum() and not text[end - 1] in "\"'%°"):
        return None, at
    return unit, end


def largest_length(field: str | None) -> tuple[Fraction | None, Fraction | None]:
    """(largest current length in metres, largest current bare number); the second only where no unit stands in the field."""
    found = [q for q in quantities(field) if not q.other]
    if any(q.unit for q in found):
        lengths = [q.canonical for q in found if q.unit and q.unit.exponents == LENGTH]
        # the leading quantity decides what is measured: "27 mm/m²" or "12 mL" is no length
        first = next(q for q in found if q.unit)
        return (max(lengths), None) if lengths and first.unit.exponents == LENGTH else (None, None)
    return None, max((q.value for q in found), default=None)


_BARE = re.compile(r"\s*(?:[~<>≈]|about|approx\.?|ca\.?|max\.?|up to)?\s*(?:\d+(?:[.,]\d+)?|[.,]\d+)(?:\s*(?:x|×|by)\s*(?:\d+(?:[.,]\d+)?|[.,]\d+))*\s*", re.I)
# Phrases that name the unit of a measure next to its number.
_DECLARED = re.compile(
    r"(?:\bsize in|\bsizes? (?:given|measured) in|\bdimensions?(?: are)?(?: given)? in|\bmeasure(?:d|ments?)(?: given)? in|\bunits?:?|\ball (?:values|sizes|dimensions) in)\s+(" + _NAME + r")(?![\w/²³^])",
    re.I,
)
_USED_FOR_ALL = re.compile(r"(?<![\w/])(" + _NAME + r")\s+used for all\b", re.I)


def _length_unit(name: str) -> Unit | None:
    u = unit_symbol(name)
    return u if u and u.exponents == LENGTH else None


def declared_unit(text: str | None) -> Unit | None:
    """The length unit that a neighbouring text states for all of its sizes."""
    for pattern in (_DECLARED, _USED_FOR_ALL):
        for m in pattern.finditer(text or ""):
            if u := _length_unit(m[1]):
                return u
    return None


_IN_BRACKETS = re.compile(r"\s*[(\[]\s*(?:in\s+)?(" + _NAME + r")\s*[)\]]")
_CLAUSE_END = re.compile(r"\.\s|\n|;|,\s")


def labelled_unit(text: str | None, label: re.Pattern, field: str) -> Unit | None:
    """The unit that stands beside the same measure: 'LABEL (mm): 47.7', 'LABEL 53 mm', for the value typed in the field."""
    wanted = {q.value for q in quantities(field)}
    for m in label.finditer(text or ""):
        if (p := _IN_BRACKETS.match(text, m.end())) and (u := _length_unit(p[1])):
            return u
        stop = _CLAUSE_END.search(text, m.end())
        for q in quantities(text[m.end() : stop.start() if stop else len(text)]):
            if q.value in wanted and q.unit:
                return q.unit if q.unit.exponents == LENGTH else None
    return None


def micrometres(metres: Fraction) -> int:
    """Whole micrometres, halves rounded up."""
    return int((metres * 10**6 + Fraction(1, 2)).__floor__())


def field_length(field: str | None) -> tuple[Fraction | None, Fraction | None]:
    """(length in metres, None) of a field that tells its unit, (None, number) of a bare number, (None, None) of anything else."""
    metres, bare = largest_length(field)
    return (None, bare) if metres is None and bare is not None and _BARE.fullmatch(field) else (metres, None)


def observed_length_um(field: str | None, neighbour: str | None, label: re.Pattern | None = None, of_field=field_length) -> int | None:
    """Length of one typed measurement in micrometres, the unit from the field or, for a bare number, its neighbouring text."""
    metres, bare = of_field(field)
    if metres is None and bare is not None:
        unit = labelled_unit(neighbour, label, field) if label else None
        unit = unit or declared_unit(neighbour)
        if unit is None and label is None:
            unit = _restated(field, neighbour)
        metres = bare * unit.scale if unit else None
    return None if metres is None else micrometres(metres)


def _restated(field: str, neighbour: str | None) -> Unit | None:
    """The unit of the same number in the neighbouring text: '3.6' and 'nodule measuring 3.6 cm'."""
    wanted = {q.value for q in quantities(field)}
    for q in quantities(neighbour):
        if q.unit and q.value in wanted and not q.other:
            return q.unit if q.unit.exponents == LENGTH else None
    return None
