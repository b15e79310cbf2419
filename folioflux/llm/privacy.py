"""Problem 3: personal information in free text, found and replaced.

spans() finds e-mail addresses, phone numbers, identity numbers, street addresses and names by
their written form; names also by a table of name parts. Replacements are surrogates: an entity
gets the same replacement wherever it stands and however it is spelt (coreference), made from a
secret key, of its own type, script, letter case and format. All of them are made by keyed
permutations, so two entities of a kind never get the same replacement in any record; within a
text that is checked again. Placeholders with a keyed tag are the other form.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import spread

KINDS = ("email", "id_number", "address", "phone", "name")
#: Name parts that a session broadcasts at most.
MOST_NAMES = 2_000_000

_L = r"[^\W\d_]"
_DOT = r"(?:\.|\s+dot\s+|\s*[(\[{]\s*(?:dot|punkt|point|punto)\s*[)\]}]\s*)"
_HOST = rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,24}}"
_EMAIL = re.compile(
    rf"(?<![\w.+-])[\w.%+'-]*\w(?:@|\s*[(\[{{<]\s*(?:at|@|arroba)\s*[)\]}}>]\s*){_HOST}(?![\w-])|(?<![\w.+-])[\w.%+-]*\w\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+(?![\w-])",
    re.IGNORECASE,
)
_EMAIL_HINT = re.compile(r"@|[(\[{<]\s*(?:at|arroba)\s*[)\]}>]|\sat\s+\S+\s+dot\s", re.IGNORECASE)

#: Labels of numbers that an authority or bank gives to a person, lower-cased. Fixed values.
_ID_LABEL = (
    r"(?:social\s+security|national\s+insurance|ssn|ni(?=\s+(?:no|num))|nino|tax|tin|passport|identity\s+card|id\s+card|national\s+id|driving\s+licence|bank\s+account|account|iban|"
    r"sozialversicherung|steuer(?:-?id(?:nr\.?)?|identifikation)?|reisepass|personalausweis|bankkonto|konto|"
    r"s[ée]curit[ée]\s+sociale|num[ée]ro\s+fiscal|passeport|carte\s+d['’]identit[ée]|compte(?:\s+bancaire)?|seguridad\s+social|pasaporte|documento\s+de\s+identidad|dni|nif|nie|cuenta(?:\s+bancaria)?|"
    r"דרכון|תעודת\s+זהות|ת\.ז\.?|חשבון\s+בנק|ביטוח\s+לאומי)"
)
_ID_VALUE = (
    r"[a-z]{2}\d{2}(?:\s?[a-z]{4})?(?:\s?\d{4}){2,7}(?:\s?\d{1,3})?(?!\d)|[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d]\b|\d{3}(?:-\d{2}-|\s\d{2}\s|\d{2})\d{4}\b|\d{2,3}/\d{3}/\d{4,5}\b|"
    r"\d{2}\s\d{3}\s\d{3}\s\d{3}\b|\d{7,8}-?[a-z]\b|[a-z]-?\d{7,8}-?[a-z]?\b|[a-z]{1,2}\d{6,9}\b|[a-z]{2}\d{10,30}\b|\d{6,20}\b"
)
#: Runs on lower-cased text and begins with plain letters, so that the regex engine can skip ahead.
_ID = re.compile(rf"{_ID_LABEL}s?(?:-?\s*(?:numbers?|nummer|num[ée]ro|número|no\b\.?|nr\b\.?|n[°º]|id\b|מספר))?\s*[:#]?\s*({_ID_VALUE})")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?:\s\d{4}){3,7}(?:\s\d{1,3})?(?!\w)")

def _phone(gap: str) -> re.Pattern:
    """Phone numbers whose groups stand apart by the given white space or by marks."""
    sep = rf"(?:{gap}|[.\-/])"
    return re.compile(
        r"(?<![\w+.\-/@#:])(?:"
        rf"\+\d{{1,3}}{sep}?(?:\(0?\d{{0,4}}\){sep}?)?\d{{1,5}}(?:{sep}\d{{2,8}}){{1,5}}"
        r"|\+\d{8,15}"
        rf"|00\d{{2}}(?:{gap}|-)(?:\(0\){gap}?)?\d{{1,5}}(?:{sep}\d{{2,8}}){{1,5}}"
        rf"|\(0?\d{{2,4}}\){gap}?\d{{3,8}}(?:{sep}\d{{2,4}}){{0,3}}"
        rf"|0\d{{1,4}}(?:{gap}|[/-])\d{{2,8}}(?:(?:{gap}|-)\d{{2,6}}){{0,4}}"
        r"|\d{3}[.-]\d{3}[.-]\d{4}"
        r"|\d{3}-\d{4}"
        rf")(?:,?(?:{gap})*(?:ext(?:ension)?\b\.?|x|poste|durchwahl|dw)(?:{gap})*\d{{1,6}})?(?![\w/-]|\.\d)",
        re.IGNORECASE,
    )


_PHONE, _PHONE_WRAPPED = _phone(r"[^\S\r\n]"), _phone(r"\s")
#: A line of so many characters before its end may be wrapped text, so that a number goes on in the next one.
_WRAPPED = 45
_PHONE_HINT = re.compile(r"\d[\d\s().\-/]{5,}\d")
_TOWN = rf"{_L}[\w'’]*(?:-{_L}[\w'’]*)*"
_TOWNS = rf"(?:{_TOWN}\s+){{0,2}}{_TOWN}"
_EN_STREET = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|close|way|place|pl|square|sq|terrace|row|crescent|gardens|grove|hill|parkway|pkwy|walk|mews)"
_ADDRESS = (
    re.compile(
        rf"(?<![\w/-])\d{{1,5}}[A-Za-z]?\s+(?:{_L}[\w'’.-]*\s+){{1,3}}?{_EN_STREET}\b\.?(?:,?\s+(?:unit|apt|apartment|flat|suite|ste|floor)\b\.?\s*\w+)?,?\s+{_TOWNS},?\s+(?:[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}})(?!\w)",
        re.IGNORECASE,
    ),
    re.compile(
        rf"(?<![\w/-])\d{{1,4}}(?:\s+(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|impasse|all[ée]e|chemin|place|quai|route|cours|passage|square|ruelle|sentier|voie|faubourg)\s+(?:{_L}+[\s'’-]+){{0,5}}?{_L}+,?\s+\d{{5}}\s+{_TOWN}(?!\w)",
        re.IGNORECASE,
    ),
    re.compile(
        rf"(?<!\w)(?:(?:am|an\s+der|im|in\s+der|zum|zur|auf\s+dem|lange|alte|neue|obere|untere|große|kleine)\s+)?{_L}[\w-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|graben|markt|hof)\s+\d{{1,4}}\s?[a-z]?,?\s+\d{{5}}\s+{_TOWN}(?!\w)",
        re.IGNORECASE,
    ),
    re.compile(
        rf"(?<!\w)(?:calle|c/|c\.|avda\.?|avenida|av\.|plaza|pza\.?|paseo|camino|carretera|ctra\.?|ronda|traves[íi]a|callej[óo]n)\s+(?:{_L}+\s+){{0,4}}?{_L}+,?\s+(?:n\.?[º°]\s*)?\d{{1,4}},?\s+\d{{5}}\s+{_TOWN}(?!\w)",
        re.IGNORECASE,
    ),
)
#: The end of an address by country; the street is looked for in so many characters before it.
_ZIP_TOWN = re.compile(rf"(?<![\w.,/-])\d{{5}}\s+{_TOWN}")
_POSTCODE = re.compile(r"\b[A-Za-z]{1,2}(?:\s+\d{5}|\d[A-Za-z\d]?\s?\d[A-Za-z]{2})\b")
_ADDRESS_REACH = 400


#: A letter of any script.
_LETTER = r"[^\W\d_]"
_LETTER_WORD = re.compile(rf"{_LETTER}+")
#: Particles that stand between given and family name. Fixed values.
_PARTICLES = r"(?:van|von|vom|zu|zur|de|der|den|del|della|di|da|dos|du|des|la|le|af|av|ten|ter|bin|ben|al|el|y)"
_INITIALS = re.compile(rf"(?:(?<!{_LETTER}){_LETTER}\.\s*)*(?:(?<!{_LETTER}){_PARTICLES}\s+)*$", re.IGNORECASE)
_WORD_BEFORE = re.compile(rf"(?<!{_LETTER})({_LETTER}+)(?:-{_LETTER}+)?\s+$")
_AFTER = re.compile(rf",\s*(?:({_LETTER}+)(?!{_LETTER}|[@+]|\.\w)|{_LETTER}\.(?![\w@]))((?:\s+{_LETTER}\.(?![\w@]))*)", re.IGNORECASE)
_NEXT = re.compile(rf"[ \t]+({_LETTER}+)(?!{_LETTER}|[@+._-]\w)")


class Names:
    """Name parts by kind, lower-cased: rows of (part, given or family) or (part, kind, gender)."""

    def __init__(self, rows):
        kinds: dict[str, set] = {}
        for p, k, *gender in rows:
            if p and k in ("given", "family"):
                kinds.setdefault(p.lower(), set()).add((k, *gender))
        self.is_given = frozenset(p for p, k in kinds.items() if any(x[0] == "given" for x in k))
        self.is_family = frozenset(p for p, k in kinds.items() if any(x[0] == "family" for x in k))
        # Parts that may stand for each other: of the same kinds, genders (where the table has them) and script.
        alike: dict[tuple, list[str]] = {}
        for p in sorted(kinds):
            alike.setdefault((*sorted(map(str, kinds[p])), unicodedata.name(p[0], "?").split()[0]), []).append(p)
        self.groups = {p: (parts, i, "|".join(like)) for like, parts in alike.items() if len(parts) > 1 for i, p in enumerate(parts)}


def _names(text: str, names: Names, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    family, given = names.is_family, names.is_given
    if family.isdisjoint(_LETTER_WORD.findall(text.lower())):
        return out
    starts = [a for a, _ in taken]
    for m in _LETTER_WORD.finditer(text):
        if m[0].lower() not in family:
            continue
        a, b = m.span()
        k = bisect_right(starts, a) - 1
        if (k >= 0 and taken[k][1] > a) or text[a - 1 : a] in ("_", "@") or text[b : b + 1] in ("_", "@"):
            continue
        if out and out[-1][1] > a:
            continue
        low = max(out[-1][1] if out else 0, a - 200)
        held = _INITIALS.search(text, low, a)
        word = _WORD_BEFORE.search(text, low, held.start())
        if word and word[1].lower() in given:
            out.append((word.start(), b))
            continue
        if "." in held[0]:
            first = _LETTER_WORD.search(text, held.start(), a)
            out.append((first.start(), b))
            continue
        after = _AFTER.match(text, b)
        if after and (after[1] is None or after[1].lower() in given):
            out.append((a, after.end()))
            continue
        following = _NEXT.match(text, b)
        if following and following[1].lower() in given:
            then = _LETTER_WORD.search(text, following.end())
            if not (then and then[0].lower() in family and text[following.end() : then.start()].isspace()):
                out.append((a, following.end()))
    return out


def spans(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what was found, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []

    def add(kind: str, a: int, b: int) -> None:
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    def add_phone(a: int, b: int) -> None:
        if 7 <= sum(c.isdecimal() for c in text[a:b]) <= 21:
            add("phone", a, b)

    if _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            add("email", *m.span())
    low = text.lower()
    if len(low) != len(text):  # keep places where a letter has a longer lower case
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    for m in _ID.finditer(low):
        if not (m.start() and low[m.start() - 1].isalnum() and low[m.start()].isascii()):
            add("id_number", *m.span(1))
    for end, patterns in ((_POSTCODE, _ADDRESS[:1]), (_ZIP_TOWN, _ADDRESS[1:])):
        for tail in end.finditer(text):
            from_ = max(0, tail.start() - _ADDRESS_REACH)
            for pattern in patterns:
                if m := next((m for m in pattern.finditer(text, from_, tail.end()) if m.end() == tail.end()), None):
                    add("address", *m.span())
    if _PHONE_HINT.search(text):
        for m in _IBAN.finditer(text):
            add("id_number", *m.span())
        for m in _PHONE.finditer(text):
            add_phone(*m.span())
        if "\n" in text:
            for m in _PHONE_WRAPPED.finditer(text):
                cut = text.find("\n", m.start(), m.end())
                if cut >= 0 and cut - text.rfind("\n", 0, m.start()) > _WRAPPED:
                    add_phone(*m.span())
    taken = sorted((a, b) for a, b, k in found)
    found += [(a, b, "name") for a, b in _names(text, names, taken)]
    return sorted(found)


def items(text: str, names: Names) -> set[tuple[str, str]]:
    """(kind, item as written with single spaces) of a text."""
    return {(k, " ".join(text[a:b].split())) for a, b, k in spans(text, names)}


# --- replacement ---------------------------------------------------------------------------------

#: Letters that are replaced by each other: Latin vowels, consonants and letters with marks, Hebrew
#: letters and final letters. Letters of other scripts are replaced within their 64 code points. Fixed values.
_ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "אבגדהוזחטיכלמנסעפצקרשת", "ךםןףץ", "0123456789")
_OF_LETTER = {c: x for x in _ALPHABETS for c in x}
_LATIN_LETTERS, _FIRST_DIGIT = "abcdefghijklmnopqrstuvwxyz", "123456789"
#: Country codes of two digits; 1 and 7 stand alone, all others have three. Fixed values.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Top-level domains that belong to nobody. Fixed values.
_RESERVED = frozenset(("example", "invalid", "test", "localhost"))
_AT = re.compile(r"\s*(?:@|[(\[{<]\s*(?:at|@|arroba)\s*[)\]}>]|(?<=\s)at(?=\s))\s*", re.IGNORECASE)
_DOTS = re.compile(rf"({_DOT})", re.IGNORECASE)
_EXTENSION = re.compile(r"(?:,?\s*(?:ext(?:ension)?\b\.?|x|poste|durchwahl|dw)\s*)(\d+)$", re.IGNORECASE)
_PARTICLE = re.compile(rf"{_PARTICLES}$", re.IGNORECASE)
#: Words of an address that say what it is and not where. Fixed values.
_KEPT = re.compile(
    rf"(?:{_EN_STREET}|unit|apt|apartment|flat|suite|ste|floor|bis|ter|quater|rue|avenue|boulevard|impasse|all[ée]e|chemin|place|quai|route|cours|passage|square|ruelle|sentier|voie|faubourg|"
    r"am|an|im|in|zum|zur|auf|dem|der|lange|alte|neue|obere|untere|große|kleine|calle|c|avda|avenida|av|plaza|pza|paseo|camino|carretera|ctra|ronda|travesía|travesia|callejón|callejon|n|de|del|des|du|la|le|les|l|d|el|los|las|y)$",
    re.IGNORECASE,
)
_SUFFIX = re.compile(r"(?:stra(?:ß|ss)e|str|weg|gasse|platz|allee|ring|damm|ufer|steig|graben|markt|hof)$", re.IGNORECASE)
_RUN = re.compile(r"\d+|[^\W\d_]+")


def canonical(kind: str, item: str) -> str:
    """What all spellings of an entity have in common: e-mails without disguise, phone and identity
    numbers without separators, names in any order and without particles; lower-cased."""
    low = item.lower()
    if kind == "email":
        at = _AT.search(low)
        return f"{low[: at.start()]}@{_DOTS.sub('.', low[at.end() :])}" if at else low
    if kind == "phone":
        number = _EXTENSION.search(low)
        kept, rest = _phone_digits(low[: number.start()] if number else low)
        return "".join(low[i] for i in kept + rest if low[i].isdecimal()).removeprefix("00") + (f"x{number[1]}" if number else "")
    if kind == "id_number":
        return "".join(c for c in low if c.isalnum())
    words = [w for w in _RUN.findall(low)]
    return " ".join(sorted(w for w in words if len(w) == 1 or not _PARTICLE.match(w)) if kind == "name" else words)


def _phone_digits(text: str) -> tuple[list[int], list[int]]:
    """Places of a phone number's digits: those of the country code, and those of the subscriber without trunk prefix."""
    places = [i for i, c in enumerate(text) if c.isdecimal()]
    trunk = re.search(r"\(0\)", text)
    if trunk:
        places.remove(trunk.start() + 1)
    digits = "".join(text[i] for i in places)
    skip = 0
    if text.lstrip("( ").startswith("+") or digits.startswith("00"):
        skip = 2 if digits.startswith("00") else 0
        code = digits[skip:]
        skip += 1 if code[:1] in ("1", "7") else 2 if code[:2] in _TWO_DIGIT_CODES else 3
    rest = places[skip:]
    if not skip and digits.startswith("0"):
        rest = places[1:]
    return places[:skip], rest


class Surrogates:
    """Keyed replacements. The same entity and key always give the same replacement, in whatever spelling.

    Letters and digits are replaced where they stand, by a keyed permutation of all strings of the
    same shape (kinds of letters, digits); name parts of the table by a permutation of the parts
    of their kind, and gender where the table tells it; nothing stays itself. So two entities of one kind never get the
    same replacement, in whatever records they stand, and script, letter case and format stay.
    """

    def __init__(self, key: bytes, names: Names):
        self.key, self.names, self.known = key, names, {}

    def _number(self, *parts: str) -> int:
        return int.from_bytes(hmac.new(self.key, "\0".join(parts).encode(), hashlib.sha256).digest(), "big")

    def permuted(self, value: int, size: int, salt: str, back: bool = False) -> int:
        """A keyed permutation of 0 .. size - 1, or its inverse: a Feistel network over the next square, walked until inside."""
        if size < 2:
            return value
        side = math.isqrt(size - 1) + 1
        while True:
            left, right = divmod(value, side)
            for r in reversed(range(6)) if back else range(6):
                if back:
                    left, right = (right - self._number(salt, str(r), str(left))) % side, left
                else:
                    left, right = right, (left + self._number(salt, str(r), str(right))) % side
            value = left * side + right
            if value < size:
                return value

    def moved(self, value: int, size: int, salt: str) -> int:
        """A keyed permutation that leaves nothing in its place: the next one in a permuted order."""
        return self.permuted((self.permuted(value, size, salt) + 1) % size, size, salt, True) if size > 1 else value

    def _again(self, text: str, alphabets: list[str | None], salt: str) -> str:
        """A text's characters that have an alphabet replaced by one permutation of all texts of the shape; case stays."""
        value, size, shape = 0, 1, []
        for c, letters in zip(text, alphabets):
            if letters:
                value, size = value * len(letters) + letters.index(c.lower()), size * len(letters)
                shape.append(letters[0])
        value = self.moved(value, size, f"{salt}\0{''.join(shape)}")
        out = list(text)
        for i in range(len(text) - 1, -1, -1):
            if letters := alphabets[i]:
                value, at = divmod(value, len(letters))
                new = letters[at]
                out[i] = new.upper() if text[i].isupper() and len(new.upper()) == 1 else new
        return "".join(out)

    def digits(self, text: str, salt: str) -> str:
        """All decimal digits of a text replaced, the rest kept."""
        return self._again(text, [_ALPHABETS[-1] if "0" <= c <= "9" else None for c in text], salt)

    def word(self, text: str, salt: str, plain: bool = False) -> str:
        """Letters and digits replaced, each by one of its kind; plain: Latin letters by any."""

        def letters(c: str) -> str | None:
            low = c.lower()
            if len(low) != 1:
                return None
            if plain and low in _LATIN_LETTERS:
                return _LATIN_LETTERS
            if low in _OF_LETTER:
                return _OF_LETTER[low]
            if not c.isalpha() or low.upper().lower() != low:
                return None
            start = ord(low) & ~63
            return "".join(x for x in map(chr, range(start, start + 64)) if x.isalpha() and x == x.lower() and x.upper().lower() == x)

        return self._again(text, list(map(letters, text)), salt)

    def part(self, word: str) -> str:
        """Another name part: of the table's parts of its kind, or, outside of the table, one that isn't in it."""
        group = self.names.groups.get(word.lower())
        if group:
            parts, at, salt = group
            new = parts[self.moved(at, len(parts), salt)]
            return new.upper() if word.isupper() and len(word) > 1 else new if word.islower() else new[:1].upper() + new[1:]
        new = self.word(word, "name")
        while new.lower() in self.names.groups:  # walks on within the words that aren't in the table
            new = self.word(new, "name")
        return new

    def replace(self, kind: str, item: str) -> str:
        found = self.known.get((kind, item))
        if found is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            found = self.known[kind, item] = getattr(self, f"_{kind}")(item)
        return found

    def _name(self, item: str) -> str:
        return _LETTER_WORD.sub(lambda m: m[0] if _PARTICLE.match(m[0]) and m[0].lower() not in self.names.groups and len(m[0]) > 1 else self.part(m[0]), item)

    def _email(self, item: str) -> str:
        at = _AT.search(item)
        if not at:
            return self.word(item, "email", True)
        *labels, top = _DOTS.split(item[at.end() :])
        host = "".join(self.word(x, "host", True) if i % 2 == 0 else x for i, x in enumerate(labels)) + top
        if top.lower() not in _RESERVED:
            host += (labels[-1] if labels else ".") + ("EXAMPLE" if top.isupper() else "example")
        return self.word(item[: at.start()], "email", True) + at[0] + host

    def _phone(self, item: str) -> str:
        extension = _EXTENSION.search(item)
        cut = extension.start() if extension else len(item)
        rest = set(_phone_digits(item[:cut])[1])
        number = self._again(item[:cut], [_ALPHABETS[-1] if i in rest and "0" <= c <= "9" else None for i, c in enumerate(item[:cut])], "phone")
        return number + (self.digits(item[cut:], "extension") if extension else "")

    def _id_number(self, item: str) -> str:
        keep = 2 if re.match(r"[A-Za-z]{2}\d{2}\s?[A-Za-z0-9]{4}\s?\d{4}", item) else 0  # an account's country
        return item[:keep] + self.word(item[keep:], "id_number", True)

    def _address(self, item: str) -> str:
        out, at = [], 0
        for m in _RUN.finditer(item):
            w = m[0]
            out.append(item[at : m.start()])
            at = m.end()
            if w[0].isdecimal():
                out.append(self._again(w, [_FIRST_DIGIT if i == 0 and c in _FIRST_DIGIT else _ALPHABETS[-1] if "0" <= c <= "9" else None for i, c in enumerate(w)], "house"))
            elif _KEPT.match(w):
                out.append(w)
            else:
                tail = _SUFFIX.search(w)
                cut = tail.start() if tail else len(w)
                out.append((self.word(w[:cut], "place", w.isupper()) if cut else "") + w[cut:])
        return "".join([*out, item[at:]])


def redact(text: str | None, names: Names, key: bytes, surrogates: bool = False, make: Surrogates | None = None) -> str | None:
    """The text with typed placeholders ([NAME-1a2b3c4d5e6f]) or surrogates; null stays null, the rest is untouched.

    Placeholders carry a keyed tag of the entity, so that the same entity has the same placeholder
    everywhere, however it is spelt. If two entities of a text would get the same replacement, the
    later one is tagged on."""
    if not text:
        return text
    make = make or Surrogates(key, names)
    out, at, used = [], 0, {}
    for a, b, kind in spans(text, names):
        item = " ".join(text[a:b].split())
        identity = f"{kind}\0{canonical(kind, item)}"
        new = make.replace(kind, item) if surrogates else f"[{kind.upper()}-{make._number(identity) >> 208:012x}]"
        while used.setdefault(f"{kind}\0{new.lower()}", identity) != identity:
            new += "'"
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


# --- tables --------------------------------------------------------------------------------------


def read_names(name_parts: DataFrame) -> list[tuple]:
    """The table of name parts (name_part, part_kind and, if there is one, gender); raises where it has more rows than may be broadcast."""
    rows = name_parts.select("name_part", "part_kind", *(c for c in name_parts.columns if c == "gender")).distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} name parts")
    return [tuple(r) for r in rows]


def records(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, text) of segments and chunks; null texts and ids are left out."""
    s = segments.select(F.lit("segment").alias("rec_kind"), F.col("ord").cast("string").alias("rec_id"), F.col("content").alias("text"))
    c = chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), "text")
    keep = F.col("rec_id").isNotNull() & F.col("text").isNotNull()
    return spread(s.where(keep)).unionByName(spread(c.where(keep)))


def detected(records: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, pii_kind, item), distinct."""
    shared = records.sparkSession.sparkContext.broadcast(read_names(name_parts))

    def find(batches):
        names = Names(shared.value)
        for batch in batches:
            kinds, ids, texts = (c.to_pylist() for c in batch.columns)
            out = [(kinds[i], ids[i], k, x) for i in range(len(ids)) for k, x in items(texts[i], names)]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["rec_kind", "rec_id", "pii_kind", "item"])

    return records.select("rec_kind", "rec_id", "text").mapInArrow(find, "rec_kind string, rec_id string, pii_kind string, item string").distinct()


def redacted(records: DataFrame, name_parts: DataFrame, key: bytes, surrogates: bool = False) -> DataFrame:
    """(rec_kind, rec_id, text): every record with its personal information replaced."""
    shared = records.sparkSession.sparkContext.broadcast(read_names(name_parts))

    def run(batches):
        names = Names(shared.value)
        make = Surrogates(key, names)
        for batch in batches:
            texts = [redact(t, names, key, surrogates, make) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["rec_kind", "rec_id", "text"])

    return records.select("rec_kind", "rec_id", "text").mapInArrow(run, "rec_kind string, rec_id string, text string")
