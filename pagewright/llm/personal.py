"""Personal information in free text: mentions, and typed placeholders holding surrogates.

Mail addresses, phone and identity numbers, street addresses and full names are
found, overlaps settled in that order of types. Names are told by listed given or
family names, by initials and endings, and by what stands beside them: a title, a
verb of speech, a verb of meeting. Identity numbers are told by the words before
them or by their check digits. A mention becomes a placeholder of its type around
a keyed surrogate (``surrogates``), such as ``[NAME Petra Ravumen]``; ``collisions``
checks over all rows that distinct values kept distinct surrogates, and one each.
"""

from __future__ import annotations

import functools
import os
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm.surrogates import FAMILY, GIVEN, PARTICLES, canonical, surrogate
from pagewright.session import spread

TYPES = ("email", "id_number", "phone", "address", "name")

# Endings of family names.
ENDINGS = "aro ay berger eira ek enko er ez idze ides ini ian ić ivić lund mann oglu or ov ova quist sen ska ski sky son ssen stein wick yan".split()
STREETS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Terrace|Square|Sq|Close|Row|Drive|Dr|Court|Crescent|Gardens|Place|Hill|Quay|Walk|Way|Boulevard|Blvd"
NOT_STREETS = "the|a|an|old|of|this|that|our|my|his|her|their|long|narrow|main|no|another|one|every|each|same|next|last|first|whole|empty|and|or|by|on|in|at|to|from|per|for"

_U = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĶŁĽŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽА-ЯЁ"
_L = r"[^\W\d_]"
_S = r"(?:[^\S\n]+\n?[^\S\n]*|\n[^\S\n]*)"  # blanks with at most one line break
_CAP = rf"[{_U}](?:{_L}|['’])*"

_AT = re.compile(rf"@|[(\[](?:at|AT)[)\]]")
_DOMAIN = re.compile(rf"{_S}?[\w\-]+(?:(?:\.|{_S}?[(\[](?:dot|DOT)[)\]]{_S}?)[\w\-]+)+")

_KEYWORD = (
    r"(?:passport|ssn|social\s+security|national\s+insurance|identity\s+(?:card|number|document)|personal\s+(?:number|id)|id\s+(?:card|number)"
    r"|national\s+id|tax\s+(?:number|id)|taxpayer\s+(?:number|id)|dni|nie|nif|nino|pesel|personnummer|reisepass|personalausweis|driving\s+licen[cs]e)"
)
_IDNUM = (
    rf"(?:[A-Z]{{1,3}}-?\d{{6,9}}[A-Z]?|\d{{8}}-?[A-Z]|\d{{6}}-\d{{4}}|\d{{3}}[\- ]\d{{2}}[\- ]\d{{4}}|\d{{2}}(?:{_S}\d{{3}}){{3}}"
    rf"|[A-Z]{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?[A-Z]|\d{{3}}(?:{_S}\d{{2}}){_S}\d{{4}}|\d{{7,12}})"
)
ID_NUMBER = re.compile(rf"\b(?i:{_KEYWORD})(?:(?:\s*[,:#]|\s+(?i:no\.?|number|nr\.?|was|is|card))+\s*|\s+)({_IDNUM})(?![\w])")

#: Numbers of a form, told without words before them if their check digits hold.
_CHECKED = re.compile(r"(?<![\w\-/.])(?:(\d{8})-?([A-HJ-NP-TV-Z])|([XYZ])(\d{7})-?([A-HJ-NP-TV-Z])|(\d{6})[\-+](\d{4})|(\d{11}))(?![\w]|[\-/.]\w)")
_SIX_DIGITS = re.compile(r"\d{6}")
#: One of these stands in every identity number.
_SIX_OR_MORE = re.compile(r"\d(?:[-\s]*\d){5}")

_SEP = rf"(?:[ .\-/\xa0]|\n)"
PHONE = re.compile(
    rf"(?<![\w/+.\-])(?:(?:\+|00)[1-9]\d{{0,2}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d(?:{_SEP}?\d){{5,12}}"
    rf"|\(0?\d{{2,4}}\){_SEP}?\d{{2,4}}(?:{_SEP}\d{{2,4}}){{1,3}}"
    rf"|0\d{{1,4}}(?:{_SEP}?\d){{6,9}}"
    rf"|[2-9]\d{{2}}(?:\.\d{{3}}\.|-\d{{3}}-|[ \n]\d{{3}}[ \n\-])\d{{4}})(?![\w]|[\-/.:]\w)"
)
_DIGITS = re.compile(r"[+(]?\d[\d ().\-/\n\xa0]{6,}\d")
_NOT_PHONE = re.compile(r"(?i)(?:isbn|issn|serial|ref\.?|booking|ticket|order|invoice|no\.)[\s:#]*$")

_NO = r"\d{1,4}(?:[ ]?[A-Da-d](?![^\W\d_]))?"
_NUMBER = re.compile(r"(?<![\w.,:/\-])\d{1,4}(?:[ ]?[A-Da-d])?(?![\w/:])(?![.,\-]\w)")
_AFTER_NUMBER = re.compile(
    rf",?{_S}(?:(?:{_CAP}(?:-{_CAP})?{_S}){{1,3}}(?:{STREETS})\b"
    rf"|(?!(?:{NOT_STREETS})\b){_L}{{3,}}{_S}(?:street|road|lane|avenue|terrace|square|close|row)(?!\w)"
    rf"|(?i:rue|avenue|boulevard|place|quai|chemin|impasse|allée){_S}(?:(?:de la|de l['’]|du|des|de|d['’]){_S}?)?(?:{_CAP}(?:[\- ]{_CAP})*|{_L}+))"
)
_BEFORE_NUMBER = re.compile(
    rf"(?<!\w)(?:(?i:calle|avenida|plaza|paseo|via|viale|piazza|corso){_S}(?:(?:de los|de las|de la|del|de|della|dei|delle|di){_S})?(?:{_CAP}(?:{_S}{_CAP})*|{_L}+),?{_S}"
    rf"|(?i:ul\.|al\.|ulica|ул\.|улица){_S}{_CAP}(?:{_S}{_CAP})*,?{_S}(?:д\.{_S})?"
    rf"|{_L}+(?:straße|strasse|str\.|gasse|weg|platz|allee|gatan|gade|vägen|STRASSE|GASSE|WEG){_S})$"
)

_ends = "|".join(ENDINGS)
_TYPICAL = re.compile(rf"(?:{_ends}|ин|ов|ев|ова|ева|ина|ын|ский|ская|енко|ук|юк|чук|ец|уна)$", re.I)
_family = rf"{_CAP}(?:-{_CAP})?"
_FULL = re.compile(rf"(?<![\w.])([{_U}](?:{_L}+|\.(?:{_S}?[{_U}]\.){{0,2}}))(?=(?:{_S}[{_U}]\.){{0,2}}{_S}?(?:(?:{PARTICLES}){_S})?({_family})(?!\w))")
_TURNED = re.compile(rf"(?<![\w\-])({_family})(?=,{_S}({_CAP})(?!\w))")
_lower = re.compile(rf"\b(?:{'|'.join(n.lower() for n in GIVEN)}){_S}({_L}+(?:{_ends}))\b")
_KNOWN = frozenset(GIVEN) | {n.upper() for n in GIVEN}
_KNOWN_LOWER = frozenset(n.lower() for n in GIVEN)
#: Before "Family, Given" these tell of a place and a clause opened by the given name.
_PLACE = re.compile(rf"(?:of|near|past|and|between|behind|in|Saint|Lake|Port|Upper|Lower|Cape|Fort|Mount|San|Santa){_S}$")
# Capitalised words that follow or precede a given name without being a family name.
_NOT_FAMILY = frozenset(
    "Street Road Lane Avenue Terrace Square Close Row Port Cape Lake Mount Fort Saint Upper Lower New Old North South East West January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
)


# Words that open clauses and stand capitalised after a given name that ends a line or clause.
_STOP = frozenset(
    """A An The This That These Those We I You He She It They Our My His Her Their Its And But Or So Then There Here When Where While What Who Why How If As At In On Of
    To From For With By After Before Later Now Not No Yes Is Was Were Are Had Has Have Did Do Dr Mr Mrs Ms Tel Email Phone Der Die Das Wir Und Ich Le La Les El Los Las""".split()
)


# Titles before full names, verbs that only people are the subject or the object of.
TITLES = frozenset("dr prof professor doctor mr mrs ms miss mx sir lady captain nurse herr frau señor señora sr sra don doña monsieur madame mme mlle signor signora господин госпожа доктор".split())
SPEECH = frozenset("said says asked asks told wrote writes replied answered phoned rang called laughed shouted whispered promised sagte fragte schrieb rief antwortete dit demanda écrivit répondit dijo preguntó escribió respondió сказал сказала спросил спросила ответил ответила".split())
MEETING = frozenset("met thanked asked told invited visited phoned rang married signed named traf fragte dankte rencontra remercia conoció saludó встретил встретила".split())
# Words that open names of places.
PLACES = frozenset("Port Cape Lake Mount Fort Saint St Upper Lower New Old North South East West Great Little Glass Grand Hotel Café Cafe Bay Isle River Castle Villa San Santa Los Las El La Le".split())
# Family names in ideographs; those of one character need a title behind.
HAN = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 欧阳 司马 诸葛 上官".split()
HAN_SHORT = "王李张劉刘陈陳杨楊赵趙黄周吴徐孙胡朱高林何郭马罗"
HAN_TITLES = "先生|女士|小姐|老师|さん|様|氏|くん|ちゃん"
_HAN_NAME = re.compile(
    rf"(?:(?:{'|'.join(HAN)})[一-鿿]{{1,2}}(?=(?:{HAN_TITLES})|[^一-鿿]|$)"
    rf"|[{HAN_SHORT}][一-鿿]{{1,2}}?(?={HAN_TITLES}))"
)
_HAS_HAN = re.compile("[一-鿿]")
_NEXT_WORD = re.compile(r"[\s,\"”’]*([^\W\d_]+)")
_FAMILIES = frozenset(FAMILY) | {n.upper() for n in FAMILY}


def _stands_as_name(text: str, start: int, end: int) -> bool:
    """Whether a title or verb beside two capitalised words tells of a person."""
    before = text[slice(*_word_before(text, start))].strip().rstrip(".").lower()
    if before in TITLES or before in MEETING:
        return True
    after = _NEXT_WORD.match(text, end)
    return after is not None and after[1] in SPEECH


# Words that open sentences before a family name without being a given name.
_KNOWN_OPENERS = frozenset("Dear Young Poor Uncle Aunt Cousin Today Yesterday Tomorrow Perhaps Maybe Only Even Both Meanwhile Finally Every Another Some Any Most Once Twice".split())


def _names_in(text: str) -> Iterator[tuple[int, int]]:
    for m in _FULL.finditer(text):
        given, family = m[1], m[2]
        if family in _NOT_FAMILY:
            continue
        known = given in _KNOWN
        if known or given[-1] == ".":
            # after a known given name any family name, after initials a typical or listed one
            fine = _TYPICAL.search(family) or (known and family.capitalize() not in _STOP and family.capitalize() not in _NOT_FAMILY) or family in _FAMILIES
        else:
            fine = given not in PLACES and given not in _STOP and given not in _NOT_FAMILY and family.capitalize() not in _STOP and (
                (family in _FAMILIES and given.capitalize() not in _KNOWN_OPENERS) or _stands_as_name(text, m.start(), m.end(2))
            ) and given.lower() not in TITLES
        if fine:
            yield m.start(), m.end(2)
    for m in _TURNED.finditer(text):
        if m[2] in _KNOWN and m[1] not in _KNOWN and m[1] not in _NOT_FAMILY and (_TYPICAL.search(m[1]) or m[1] in _FAMILIES) and not m[1].endswith("ova"):
            if not _PLACE.search(text, *_word_before(text, m.start())):
                yield m.start(), m.end(2)
    if not _KNOWN_LOWER.isdisjoint(text.split()):
        for m in _lower.finditer(text):
            yield m.span()
    if not text.isascii() and _HAS_HAN.search(text):
        for m in _HAN_NAME.finditer(text):
            yield m.span()


def _local_part(text: str, end: int) -> int:
    """Where the mailbox before an @ begins, with at most a blank and a line break between; ``end`` if there is none."""
    at = end
    if at and text[at - 1] == "\n":
        at -= 1
    if at and text[at - 1].isspace() and text[at - 1] != "\n":
        at -= 1
    last = at
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.+-"):
        at -= 1
    return at if at < last else end


def _mails_in(text: str) -> Iterator[tuple[int, int]]:
    for m in _AT.finditer(text):
        start = _local_part(text, m.start())
        after = start < m.start() and _DOMAIN.match(text, m.end())
        if after:
            yield start, after.end()


def _phones_in(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        at = run.start()
        while at < run.end():
            m = PHONE.search(text, at, min(run.end() + 3, len(text)))
            if not m:
                break
            at = m.end()
            if 9 <= sum(map(str.isdigit, m[0])) <= 15 and not _NOT_PHONE.search(text, *_word_before(text, m.start())):
                yield m.span()


def _word_before(text: str, at: int) -> tuple[int, int]:
    """The span of the word before a place, over blanks, colons and number signs, and of those."""
    k = at
    while k and (text[k - 1].isspace() or text[k - 1] in ":#"):
        k -= 1
    while k and (text[k - 1].isalnum() or text[k - 1] == "."):
        k -= 1
    return k, at


# Small words inside names of streets.
_IN_STREETS = frozenset("de los las la del della dei delle di д".split())


def _street_start(text: str, end: int, floor: int) -> int:
    """Where a street before a number can begin at the earliest: no name of one holds three small words besides the usual."""
    at, small = end, 0
    while at > floor and small < 3:
        while at > floor and not text[at - 1].isalnum():
            at -= 1
        last = at
        while at > floor and text[at - 1].isalnum():
            at -= 1
        if at < last and not text[at].isupper() and text[at:last] not in _IN_STREETS:
            small += 1
    return at


def _addresses_in(text: str) -> Iterator[tuple[int, int]]:
    low = 0  # a street's words hold no number, so each is looked for behind the number before
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        after = _AFTER_NUMBER.match(text, b)
        if after:
            yield a, after.end()
        elif a and text[a - 1].isspace():
            before = _BEFORE_NUMBER.search(text, _street_start(text, a, low), a)
            if before:
                yield before.start(), b
        low = b


def _checked_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Identity numbers of Spain, Sweden and Poland by their check digits."""
    if not _SIX_DIGITS.search(text):
        return
    for m in _CHECKED.finditer(text):
        dni, dni_letter, nie, nie_digits, nie_letter, born, rest, pesel = m.groups()
        if dni or nie:
            number = int(dni) if dni else int("XYZ".index(nie) * 10**7 + int(nie_digits))
            good = "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23] == (dni_letter or nie_letter)
        elif born:
            doubled = [int(c) * (2 - k % 2) for k, c in enumerate(born + rest)]
            good = "01" <= born[2:4] <= "12" and "01" <= born[4:] <= "31" and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
        else:
            weights = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1)
            good = int(pesel[2:4]) % 20 in range(1, 13) and "01" <= pesel[4:6] <= "31" and sum(w * int(c) for w, c in zip(weights, pesel)) % 10 == 0
        if good:
            yield m.span()


def find_mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of every mention, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []

    def add(spans: Iterator[tuple[int, int]], kind: str) -> None:
        for a, b in spans:
            if not any(a < end and start < b for start, end, _ in found):
                found.append((a, b, kind))

    add(_mails_in(text), "email")
    if _SIX_OR_MORE.search(text):
        add((m.span(1) for m in ID_NUMBER.finditer(text)), "id_number")
    add(_checked_numbers(text), "id_number")
    add(_phones_in(text), "phone")
    add(_addresses_in(text), "address")
    add(_names_in(text), "name")
    found.sort()
    return found


@functools.cache
def _own_secret() -> str:
    return secrets.token_hex(32)


def secret_of(spark: SparkSession) -> str:
    """The key of surrogates: the session's pagewright.secret, else PAGEWRIGHT_SECRET, else one drawn for this process.

    Surrogates are the same in every run only with a key that is set.
    """
    return spark.conf.get("pagewright.secret", None) or os.environ.get("PAGEWRIGHT_SECRET") or _own_secret()


def redact(text: str, key: bytes) -> str:
    out, at = [], 0
    for a, b, kind in find_mentions(text):
        out += [text[at:a], f"[{kind.upper()} {surrogate(text[a:b], kind, key)}]"]
        at = b
    return "".join([*out, text[at:]])


def mentions(df: DataFrame, key: str, text: str, *, secret: str | None = None) -> DataFrame:
    """(key, pii_type, start_char, end_char, mention, value) of every mention, and with a ``secret`` (surrogate, entity, surrogate_entity).

    ``value`` is the mention in lower case with letters and digits only, the
    entities are the canonical values of mention and surrogate. Null and
    empty texts give none; repeated rows give repeated mentions; other columns
    are ignored. A map without a shuffle of more than small scans.
    """
    kind = df.schema[key].dataType.simpleString()
    names = ["pii_type", "start_char", "end_char", "mention", "value"] + (["surrogate", "entity", "surrogate_entity"] if secret else [])
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * (len(names) - 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for a, b, what in find_mentions(value):
                    said = value[a:b]
                    found = (row, what, a, b, said, "".join(filter(str.isalnum, said.lower())))
                    if secret:
                        other = surrogate(said, what, secret.encode())
                        found += (other, canonical(said, what), canonical(other, what))
                    rows.append(found)
            columns = [*zip(*rows)] or [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=["key", *names])

    return (
        spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
        .where(F.length("text") > 0)
        .mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} {'int' if n.endswith('_char') else 'string'}" for n in names))
        .withColumnRenamed("key", key)
    )


def redacted(df: DataFrame, key: str, text: str, *, secret: str = "") -> DataFrame:
    """(key, text): every text with its mentions replaced; null and empty texts stay as they are."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, secret.encode()) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return (
        df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(run, f"key {kind}, text string")
        .withColumnsRenamed({"key": key, "text": text})
    )


def collisions(found: DataFrame) -> DataFrame:
    """(pii_type, surrogate, n): surrogates that two or more values share, and values that have two or more surrogates.

    Each letter's cycle is one to one, so two values meet only where the letters made for
    one spell a listed name or a second name set behind; this tells whether it happened.
    """
    values = found.select("pii_type", "entity", "surrogate_entity").distinct()

    def twice(by: str) -> DataFrame:
        return values.groupBy("pii_type", by).agg(F.min("surrogate_entity").alias("shown"), F.count("*").alias("n")).where("n > 1").select("pii_type", F.col("shown").alias("surrogate"), "n")

    return twice("surrogate_entity").unionAll(twice("entity"))
