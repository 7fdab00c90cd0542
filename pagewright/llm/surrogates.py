"""Keyed surrogates of mentions: type, script, format and gender stay, the value goes.

A surrogate hangs on the canonical value of a mention: the digits of a number, an
address without obfuscation, each part of a name by itself; so one value written in
several ways has one surrogate written in these ways. Given and family names that
are listed become other listed ones of the same script and gender; the rest is
replaced letter by letter, each by the next of a keyed cycle that depends on the
letters before, so no letter stays and different values stay different. A name's
initial is replaced alike in all names of its script, so that an initial is that of
the full name's surrogate.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

# Common given names, in Latin and Cyrillic script.
GIVEN = """
Adam Adrian Agnes Ahmed Alan Albert Alexander Alfred Ali Alice Amara Amelia Amir Amy Ana Andrea Andreas Andrew Anna Anne
Anton Antonio Arthur Astrid Aylin Barbara Ben Benjamin Bernard Boris Brigitte Bruno Camille Carla Carlos Carmen Caroline
Catherine Cecilia Charles Charlotte Chiara Chloe Christian Christine Claire Clara Claudia Daniel Daniela David Denis Diana
Diego Dmitri Dora Edith Edward Elena Elias Elif Elisabeth Elise Elizabeth Ella Emil Emilia Emily Emma Eric Erik Esther Eva
Evelyn Fatima Felix Fernando Fiona Florian Frances Francesca Francis Frank Franz Frederik Gabriel Georg George Gerda
Giulia Grace Greta Hana Hannah Hans Harriet Hassan Heinrich Helen Helena Henrik Henry Hiroshi Hugo Ibrahim Ida Igor Ines
Ingrid Irene Iris Isabel Ivan Jack Jacob James Jan Jana Jane Javier Jean Joan Johan Johannes John Jonas Jorge Jose Josef
Joseph Juan Julia Julian Karin Karl Katarina Kenji Klaus Lars Laura Lea Leila Lena Leo Leon Lina Linda Lisa Louis Louise
Lucas Lucia Luis Luisa Luka Lydia Magnus Marco Marcus Margaret Maria Marie Marina Mario Mark Markus Marta Martha Martin
Mary Mateo Matilda Matteo Max Maya Mehmet Mia Michael Michel Miguel Mila Milan Miriam Mohammed Monica Nadia Natalia Nathan
Nicolas Nikita Nina Noah Nora Olaf Olga Oliver Olivia Omar Oscar Otto Pablo Patrick Paul Paula Pavel Pedro Peter Petra
Philip Pierre Priya Rachel Raj Ralph Rebecca Richard Rita Robert Roberto Rosa Ruth Samir Samuel Sandra Sara Sarah Sebastian
Sergei Silvia Simon Sofia Sophia Sophie Stefan Stella Stephen Susan Sven Tariq Teresa Theo Theresa Thomas Tim Tomas Ulrike
Ursula Valentina Vera Victor Viktor Vincent Vladimir Walter Werner William Wolfgang Yara Yasmin Yuki Yusuf Zoe
Алексей Алина Анастасия Андрей Анна Борис Вера Виктор Владимир Дарья Дмитрий Екатерина Елена Иван Игорь Ирина Ксения
Лев Людмила Мария Михаил Надежда Наталья Никита Николай Олег Ольга Павел Пётр Светлана Сергей София Татьяна Фёдор Юлия
""".split()
# Listed women's names that do not end in a, and men's that do.
WOMEN = """Agnes Alice Amy Anne Astrid Aylin Brigitte Camille Carmen Caroline Catherine Charlotte Chloe Christine Claire Edith Elif Elisabeth
Elise Elizabeth Emily Esther Evelyn Frances Grace Hannah Harriet Helen Ines Ingrid Irene Iris Isabel Jane Joan Karin Louise Margaret Marie Mary
Miriam Rachel Ruth Sarah Sophie Susan Ulrike Yasmin Yuki Zoe""".split()
MEN = "Luka Nikita Никита".split()
# Common family names.
FAMILY = """
Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Jackson Clarke Moore
Miller Davis Anderson Martin Lee Harris Lewis Young Allen Scott Baker Adams Nelson Carter Mitchell Turner Phillips Campbell Parker Murphy Kelly
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann
Garcia García Martinez Lopez López Gonzalez Rodriguez Fernandez Perez Sanchez Ramirez Torres Flores Rivera Gomez Diaz Cruz Morales Ortiz
Martin Bernard Dubois Moreau Laurent Lefebvre Michel Leroy Roux Fournier Girard Rossi Russo Ferrari Esposito Bianchi Romano Ricci Marino
Silva Santos Oliveira Souza Pereira Costa Jansen Visser Bakker Johansson Andersson Nilsson Hansen Olsen Larsen Nowak Kowalski Novak Horvat
Sharma Patel Singh Kumar Gupta Khan Ahmed Hussain Ali Zhang Wang Chen Liu Yang Huang Zhao Zhou Kim Park Choi Nguyen Tran Tanaka Suzuki Sato
Иванов Петров Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков
""".split()
# Particles before family names.
PARTICLES = "van der|van den|von der|de la|de los|van|von|der|de|del|della|da|di|du|al|el|bin|ibn|ben|ter|zu|zum|le|la"

_PARTICLE_WORDS = frozenset(PARTICLES.replace(" ", "|").split("|"))


def gender(name: str) -> str:
    """f or m, of a listed given name."""
    return "f" if name in WOMEN or (name[-1] in "aая" and name not in MEN) else "m"


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def _classes() -> dict[str, str]:
    """Each lower-case letter or digit with the alphabet it is replaced within: vowels and consonants of its script, plain and accented."""
    alphabets: dict[tuple, list[str]] = {}
    vowels = set("aeiouæœøаеиоуыэюяєіαεηιουω")
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0xDF, 0x180), (0x3AC, 0x3CF), (0x430, 0x460)):
        for c in map(chr, range(lo, hi)):
            if c.isalnum() and c == c.lower() and c != "ς":
                base = unicodedata.normalize("NFD", c)[0]
                cased = len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c
                usual = c.isascii() or 0x430 <= ord(c) < 0x450 or (ord(c) > 0x380 and base == c)
                alphabets.setdefault((_script(c), base in vowels, usual, cased or c.isdigit()), []).append(c)
    return {c: "".join(own) for own in alphabets.values() if len(own) > 1 for c in own}


_CLASS = _classes()
#: Scripts whose letters are turned within one range: kana, ideographs, syllables of Korean, letters of Thai, Hindi, Hebrew and Arabic.
_RANGES = ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x0E01, 0x0E2E), (0x0904, 0x0939), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0660, 0x0669), (0x0966, 0x096F))


def _keyed(key: bytes, *said: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(said).encode(), key=key[:64], digest_size=8).digest(), "big")


@functools.lru_cache(1 << 16)
def _cycle(key: bytes, before: str, members: str | tuple[str, ...]) -> dict[str, str]:
    """Each member with the next one of a keyed cycle through all: one to one, and none stays."""
    order = sorted(set(members), key=lambda m: _keyed(key, before, m))
    return {m: order[(k + 1) % len(order)] for k, m in enumerate(order)}


def letter(c: str, key: bytes, before: str) -> str:
    """What a canonical letter or digit becomes after ``before``; other characters stay."""
    alphabet = _CLASS.get(c)
    if alphabet:
        return _cycle(key, before, alphabet)[c]
    for lo, hi in _RANGES:
        if lo <= ord(c) <= hi:
            size = hi - lo + 1
            return chr(lo + (ord(c) - lo + 1 + _keyed(key, before, str(lo)) % (size - 1)) % size)
    return c


def _plain(c: str) -> str:
    """One lower-case character for one character."""
    low = c.lower()
    return "σ" if low == "ς" else low if len(low) == 1 else unicodedata.normalize("NFD", low)[0]


def _as(shown: str, new: str) -> str:
    return new.upper() if shown != shown.lower() and len(new.upper()) == 1 else new


_OBFUSCATED = re.compile(r"[(\[](at|dot)[)\]]", re.I)
_INTERNATIONAL = re.compile(r"\+|00")
#: The trunk zero that is not dialled after a country's prefix.
_TRUNK = re.compile(r"\(0\)")
_PART = re.compile(r"[^\s.,\-–]+")


def _said(mention: str, kind: str) -> Iterator[tuple[int, str, bool]]:
    """(place, canonical character, whether it stays) of what makes up the value of a mention that is no name."""
    plain = [*map(_plain, mention)]
    skip: set[int] = set()
    keep = 0
    if kind == "phone":
        prefix = _INTERNATIONAL.match(mention)
        if prefix:
            skip.update(range(prefix.end()))
            for m in _TRUNK.finditer(mention):
                skip.update(range(*m.span()))
        digits = [k for k, c in enumerate(plain) if c.isdigit() and k not in skip]
        keep = 0 if not prefix or not digits else 1 if plain[digits[0]] in "17" else 2
        for n, k in enumerate(digits):
            yield k, plain[k], n < keep
        return
    if kind == "email":
        for m in _OBFUSCATED.finditer(mention):
            skip.update(range(*m.span()))
            plain[m.start()] = "@" if m[1].lower() == "at" else "."
            skip.discard(m.start())
    for k, c in enumerate(plain):
        if k not in skip and (c.isalnum() or kind == "email" and not c.isspace()):
            yield k, c, False


def name_parts(mention: str) -> list[tuple[int, int, str]]:
    """(start, end, role) of a name's parts; roles are given, initial, particle and family."""
    parts = [*_PART.finditer(mention)]
    if not parts:
        return []
    if len(parts) == 1 and _script(mention[0]) in ("CJK", "HIRAGANA", "KATAKANA"):
        return [(*parts[0].span(), "family")]
    comma = mention.find(",")
    if comma >= 0:
        families = {m.start() for m in parts if m.end() <= comma}
    else:
        last = parts[-1]
        families = {last.start()}
        for m in reversed(parts[:-1]):  # parts joined by hyphens are one family name
            if mention[m.end() : last.start()] not in ("-", "–"):
                break
            families.add(m.start())
            last = m
    out = []
    for m in parts:
        role = "family" if m.start() in families else "initial" if len(m[0]) == 1 else "given"
        if m[0].islower() and m[0] in _PARTICLE_WORDS and m is not parts[0]:
            role = "particle"
        out.append((*m.span(), role))
    return out


def canonical(mention: str, kind: str) -> str:
    """The value that a mention writes: equal for all its ways of being written, name parts in one order."""
    if kind != "name":
        prefix = "+" if kind == "phone" and _INTERNATIONAL.match(mention) else ""
        return prefix + "".join(c for _, c, _ in _said(mention, kind))
    parts: dict[str, list[str]] = {}
    for a, b, role in name_parts(mention):
        parts.setdefault("given" if role == "initial" else role, []).append("".join(filter(str.isalnum, map(_plain, mention[a:b]))))
    return " ".join(f"{role} {'-'.join(parts[role])}" for role in sorted(parts))


@functools.lru_cache(8)
def _listed() -> tuple[dict, dict]:
    """Listed given names by (script, gender, initial), and family names by script."""
    given: dict[tuple, tuple] = {}
    for name in sorted(set(GIVEN)):
        at = (_script(name[0]), gender(name), _plain(name[0]))
        given[at] = (*given.get(at, ()), name)
    family: dict[str, tuple] = {}
    for name in sorted(set(FAMILY)):
        family[_script(name[0])] = (*family.get(_script(name[0]), ()), name)
    return given, family


_BY_PLAIN = {"".join(map(_plain, n)): n for n in GIVEN}
_FAMILY_BY_PLAIN = {"".join(map(_plain, n)): n for n in FAMILY}


@functools.lru_cache(64)
def _initials(script: str) -> tuple[str, ...]:
    """Initials of listed names of both genders."""
    given, _ = _listed()
    return tuple(sorted({i for s, g, i in given if s == script and (s, "f", i) in given and (s, "m", i) in given}))


def _initial(c: str, key: bytes) -> str:
    """The initial that names with this one get; one to one among those of listed names, and among the others."""
    used = _initials(_script(c))
    if c in used:
        return _cycle(key, "initial", used)[c]
    rest = tuple(x for x in _CLASS if x not in used and _script(x) == _script(c) and _CLASS[x] in (_CLASS.get(c), _CLASS.get("a"), _CLASS.get("b")))
    return _cycle(key, "initial", rest)[c] if c.isascii() and c in rest and len(rest) > 1 else letter(c, key, "initial")


def _given(plain: str, key: bytes) -> str:
    known = _BY_PLAIN.get(plain)
    if known and plain[0] in _initials(_script(plain[0])):
        given, _ = _listed()
        script, sex = _script(plain[0]), gender(known)
        own, others = given[script, sex, plain[0]], given[script, sex, _initial(plain[0], key)]
        order = sorted(own, key=lambda n: _keyed(key, "given", n)).index(known)
        pool = sorted(others, key=lambda n: _keyed(key, "other", n))
        first, more = pool[order % len(pool)], order // len(pool)
        if not more:
            return first
        # fewer names begin with that letter: a second one is set behind
        every = sorted((n for (s, g, _), names in given.items() if (s, g) == (script, sex) for n in names), key=lambda n: _keyed(key, "second", n))
        return f"{first}-{every[more - 1]}"
    out = [_initial(plain[0], key)]
    for k in range(1, len(plain)):
        stays = k == len(plain) - 1 and plain[k] in "aая"  # which carries gender
        out.append(plain[k] if stays else letter(plain[k], key, "given\0" + plain[:k]))
    return "".join(out).capitalize()


def _family(plain: str, key: bytes) -> str:
    known = _FAMILY_BY_PLAIN.get(plain)
    if known:
        return _cycle(key, "family", _listed()[1][_script(plain[0])])[known]
    return "".join(letter(c, key, "family\0" + plain[:k]) for k, c in enumerate(plain)).capitalize()


@functools.lru_cache(1 << 16)
def surrogate(mention: str, kind: str, key: bytes) -> str:
    """The mention with its value replaced, in its own format."""
    if kind == "name":
        out, at = [], 0
        for a, b, role in name_parts(mention):
            shown = mention[a:b]
            letters = "".join(filter(str.isalnum, map(_plain, shown)))
            if role == "particle" or not letters:
                new = shown
            elif role == "initial":
                new = _initial(letters, key).upper()
            else:
                new = _given(letters, key) if role == "given" else _family(letters, key)
                new = new.upper() if shown.isupper() and len(shown) > 1 else new.lower() if shown.islower() else new
            out += [mention[at:a], new]
            at = b
        return "".join([*out, mention[at:]])
    chars, before = [*mention], kind + "\0"
    for k, c, stays in _said(mention, kind):
        if not stays:
            chars[k] = _as(mention[k], letter(c, key, before)) if c not in "@." or kind != "email" else mention[k]
        before += c
    return "".join(chars)
