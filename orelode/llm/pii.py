"""Replacing personal data by surrogates: keyed, of the same type and format, distinct for distinct entities.

An entity is read as a number with mixed digits: each of its variable characters is a digit whose radix is the size of its
class (a decimal digit, a lower-case vowel, an octet of two figures, ...). A keyed Feistel network P permutes that domain,
and the surrogate of x is P^-1(P(x) + 1). That is a bijection without fixed points, so equal entities get equal surrogates
everywhere, different ones different ones, and none stays as it was; no table of entities has to be gathered.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import unused, with_workers

KINDS = ("email", "phone", "ip", "card", "iban", "secret", "name", "ssn")
KEY = b"orelode-surrogates"
ROUNDS = 8

# Letters of each script, vowels and consonants apart, so that names stay readable and keep their script.
CLASSES = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåæ", "èéêë", "ìíîï", "òóôöõø", "ùúûü", "çčćñńšśžźßł",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "άέήίόύώ",
]
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
SIGNS = "!#$%&()*+-./:<=>?@[\\]^_`{|}~"  # of secrets without letters and digits

# Titles before names; the title stays.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Don", "Doña"]

SECRET_WORDS = "password|passwd|pwd|secret|token|api[_-]?key"
# Texts without this match no rule. Arrow's word boundary knows ASCII only, so it stands beside titles alone; `ignore_case` holds for all.
MAYBE = r"[@\p{Nd}]|\b(?:" + "|".join(TITLES) + r")\b|" + SECRET_WORDS + r"|AKIA|ASIA|gh[pousr]_|sk[-_]"
EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"(?i:\b(?:" + SECRET_WORDS + r")\b[\"']?\s*[=:]\s*[\"']?)([^\s\"',;]{6,})|\b(?:AKIA|ASIA)([A-Z0-9]{16})\b|\bgh[pousr]_([A-Za-z0-9]{30,})|\bsk[-_]([A-Za-z0-9]{20,})")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])")
SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
NAME = re.compile(r"\b(" + "|".join(TITLES) + r")(\.? )((?:[^\W\d_a-z][^\W\d_]+)(?:[ -][^\W\d_a-z][^\W\d_]+){0,2})")


SHORTEST = 3  # letters of a name that is looked for without its title

# Common given names by script and gender.
GIVEN = {
    ("latin", "f"): "anna maria sofia laura julia emma sarah lena clara marie claire camille lucia carmen elena isabel alice martha helen ruth nina eva paula petra monika sabine brigitte sophie chloe ines",
    ("latin", "m"): "john peter paul thomas michael david james robert hans karl klaus stefan jan pierre jean louis henri antoine carlos juan pedro miguel luis pablo diego mark martin felix max georg",
    ("cyrillic", "f"): "анна мария елена ольга ирина наталья светлана татьяна", ("cyrillic", "m"): "иван пётр алексей сергей дмитрий андрей михаил николай",
    ("greek", "f"): "μαρία ελένη σοφία άννα κατερίνα", ("greek", "m"): "γιώργος νίκος δημήτρης κώστας γιάννης",
}


@lru_cache(1)
def _lists() -> dict[str, list[str]]:
    """For each listed given name the list that it is in."""
    return {n: names.split() for names in GIVEN.values() for n in names.split()}


def _plain(c: str) -> str:
    """A letter's lower-case form, if case can be put back without loss; otherwise the letter itself."""
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c else c


@lru_cache(1)
def _class_of() -> dict[str, str]:
    """For every letter in its plain form the class that it is shifted in: one of CLASSES, or by script and case.

    Letters that would be alone in their class join Latin ones, so none lacks a partner.
    """
    groups: dict[tuple, list[str]] = defaultdict(list)
    listed = {c: k for k in CLASSES for c in k}
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isalnum() and not c.isdecimal() and _plain(c) == c:
            paired = len(c.upper()) == 1 and c.upper() != c and _plain(c.upper()) == c
            groups[(listed[c], True) if paired and c in listed else (unicodedata.name(c, "").split(" ")[0].split("-")[0], paired, c.isupper())].append(c)
    for key in [k for k, members in groups.items() if len(members) == 1]:
        groups["LATIN", key[1], False] += groups.pop(key)
    classes = ["".join(m) for m in groups.values()]
    return {c: k for k in classes for c in k}


def letters_of(c: str) -> str | None:
    return _class_of().get(c)


def digits_of(c: str) -> str | None:
    """The ten digits of the script of a digit."""
    return "".join(chr(ord(c) - unicodedata.decimal(c) + i) for i in range(10)) if c.isdecimal() else None


class Surrogates:
    """Keyed surrogates. Values that differ only in case or separators count as one entity."""

    def __init__(self, key: bytes = KEY):
        self.key = hashlib.sha256(key).digest()
        self.known: dict[tuple[str, str], str] = {}

    def _mix(self, tag: str, turn: int, half: int) -> int:
        data = f"{tag}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def shift(self, tag: str, digits: list[int], radixes: list[int]) -> list[int]:
        """The next number after `digits` on the keyed cycle through all numbers with these radixes."""
        middle = len(digits) // 2
        sizes, halves = [1, 1], [0, 0]
        for at, (d, r) in enumerate(zip(digits, radixes, strict=True)):
            side = int(at >= middle)
            halves[side] = halves[side] * r + d
            sizes[side] *= r
        if sizes[0] * sizes[1] < 2:
            return digits
        tag = f"{tag}|{'.'.join(map(str, radixes))}"
        for turn in range(ROUNDS):
            side = turn % 2
            halves[side] = (halves[side] + self._mix(tag, turn, halves[1 - side])) % sizes[side]
        number = (halves[0] * sizes[1] + halves[1] + 1) % (sizes[0] * sizes[1])
        halves = list(divmod(number, sizes[1]))
        for turn in reversed(range(ROUNDS)):
            side = turn % 2
            halves[side] = (halves[side] - self._mix(tag, turn, halves[1 - side])) % sizes[side]
        out = []
        for side, part in ((1, radixes[middle:]), (0, radixes[:middle])):
            rest = halves[side]
            for r in reversed(part):
                rest, d = divmod(rest, r)
                out.append(d)
        return out[::-1]

    def _letters(self, kind: str, text: str, classes: Callable[[str], str | None], fixed: set[int] = frozenset(), firm: set[int] = frozenset()) -> str:
        """Shift the characters that have a class, in a canonical form without case; all others stay.

        Those at `fixed` stay too, but where nothing else can be shifted, only those of them that are `firm` do.
        """
        places, digits, radixes, alphabets = [], [], [], []
        for i, c in enumerate(text):
            if i not in fixed and (alphabet := classes(_plain(c))):
                places.append(i)
                digits.append(alphabet.index(_plain(c)))
                radixes.append(len(alphabet))
                alphabets.append(alphabet)
        if not places and fixed - firm:
            return self._letters(kind, text, classes, firm, firm)
        rigid = "".join(c.lower() for i, c in enumerate(text) if i not in set(places) and (c.isalnum() or i in fixed))
        new = list(text)
        for i, d, alphabet in zip(places, self.shift(f"{kind}|{rigid}", digits, radixes), alphabets, strict=True):
            new[i] = alphabet[d].upper() if _plain(text[i]) != text[i] else alphabet[d]
        return "".join(new)

    def email(self, text: str) -> str:
        """Letters and digits of the local part and of the domain, but for the top level and a reserved `example`."""
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        at, fixed, firm = len(local) + 1, set(), set()
        for i, label in enumerate(labels):
            if i == len(labels) - 1 or label.lower() == "example":
                fixed |= set(range(at, at + len(label)))
            if i < len(labels) - 1 and label.lower() == "example":
                firm |= set(range(at, at + len(label)))
            at += len(label) + 1
        return self._letters("email", text, lambda c: LETTERS if c in LETTERS else digits_of(c) or letters_of(c), fixed, firm)

    def phone(self, text: str) -> str:
        """Digits, but for the country code and the exchange 555."""
        fixed, firm = set(range(*m.span())) if (m := re.match(r"\+\d{1,3}(?=\D)|\+\d", text)) else set(), set()
        if m := re.search(r"(?<!\d)555(?!\d)", text):
            firm = set(range(*m.span()))
        return self._letters("phone", text, digits_of, fixed | firm, firm)

    def ip(self, text: str) -> str:
        """Each octet keeps its number of figures."""
        low, sizes = [0, 0, 10, 100], [0, 10, 90, 156]
        octets = [str(int(x)) for x in text.split(".")]
        new = self.shift("ip", [int(x) - low[len(x)] for x in octets], [sizes[len(x)] for x in octets])
        return ".".join(str(d + low[len(x)]) for d, x in zip(new, octets, strict=True))

    def card(self, text: str) -> str:
        """The first digit stays, the last is made to fit the check sum again."""
        digits = re.sub(r"\D", "", text)
        body = digits[0] + "".join(map(str, self.shift(f"card|{digits[0]}", [int(c) for c in digits[1:-1]], [10] * (len(digits) - 2))))
        check = next(c for c in DIGITS if luhn(body + c))
        new = iter(body + check)
        return "".join(next(new) if c.isdigit() else c for c in text)

    def iban(self, text: str) -> str:
        """The country stays; the account's figures and letters keep their class, and the check figures are made to fit."""
        bare = text.replace(" ", "")
        body = self._letters(f"iban|{bare[:2]}", bare[4:], lambda c: LETTERS if c in LETTERS else DIGITS if c in DIGITS else None)
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{bare[:2]}00")) % 97
        new = iter(f"{bare[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def secret(self, text: str) -> str:
        if re.fullmatch(r"[0-9a-f]+", text):
            return self._letters("hex", text, lambda c: HEX if c in HEX else None)
        sets = {}
        for i, c in enumerate(text):
            if c in DIGITS or c in LETTERS or c in LETTERS.upper():
                sets[i] = DIGITS if c in DIGITS else LETTERS if c in LETTERS else LETTERS.upper()
            elif alphabet := digits_of(c) or letters_of(_plain(c)):
                sets[i] = alphabet if _plain(c) == c else alphabet.upper()
        sets = sets or {i: SIGNS for i, c in enumerate(text) if c in SIGNS}
        places, sets = list(sets), list(sets.values())
        new = list(text)
        for i, s, d in zip(places, sets, self.shift("secret", [s.index(text[i]) for i, s in zip(places, sets, strict=True)], [len(s) for s in sets]), strict=True):
            new[i] = s[d]
        return "".join(new)

    def ssn(self, text: str) -> str:
        return self._letters("ssn", text, digits_of)

    def name(self, text: str) -> str:
        """Word by word, so that a family name alone matches the full name.

        A listed given name becomes another of its list, so its gender and script stay. Other words keep script, case,
        length and last letter, and never become a listed name, so no two names fall together.
        """
        return re.sub(r"[^\W\d_]+", lambda m: self._word(m[0]), text)

    def _word(self, word: str) -> str:
        names = _lists().get(word.lower())
        if names:
            (at,) = self.shift(f"given|{names[0]}", [names.index(word.lower())], [len(names)]) if len(names) > 1 else (0,)
            return names[at].upper() if word.isupper() and len(word) > 1 else names[at].capitalize()
        new = word
        while True:
            new = self._letters("name", new, letters_of, {len(new) - 1})
            if new.lower() not in _lists():
                return new

    def of(self, kind: str, text: str) -> str:
        if (new := self.known.get((kind, text))) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            new = self.known[kind, text] = getattr(self, kind)(text)
        return new


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entities(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, stop, kind) in order, without overlap; of overlapping ones the kind found first stands."""
    spans: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, stop: int, kind: str) -> None:
        if not any(a < stop and start < b for a, b in taken):
            taken.append((start, stop))
            spans.append((start, stop, kind))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    for m in SECRET.finditer(text):
        add(*m.span(m.lastindex), "secret")
    if re.search(r"\d", text):
        for m in IBAN.finditer(text):
            if iban_ok(m[0]):
                add(*m.span(), "iban")
        for m in CARD.finditer(text):
            if luhn(re.sub(r"\D", "", m[0])):
                add(*m.span(), "card")
        for m in IP.finditer(text):
            add(*m.span(), "ip")
        for m in SSN.finditer(text):
            add(*m.span(), "ssn")
        for m in PHONE.finditer(text):
            add(*m.span(), "phone")
    told = set()
    for m in NAME.finditer(text):
        add(*m.span(3), "name")
        told |= {w for w in re.findall(r"[^\W\d_]+", m[3]) if len(w) >= SHORTEST}
    if told:  # the same names without a title, anywhere in the text
        for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(told, key=lambda w: (-len(w), w)))) + r")(?![^\W_])", text):
            add(*m.span(), "name")
    return sorted(spans)


def replace_all(text: str, surrogates: Surrogates) -> tuple[str, dict[str, int]]:
    """The text with its surrogates, and how many entities of each kind it had."""
    out, at, count = [], 0, dict.fromkeys(KINDS, 0)
    for start, stop, kind in entities(text):
        out += [text[at:start], surrogates.of(kind, text[start:stop])]
        at = stop
        count[kind] += 1
    return "".join([*out, text[at:]]), count


def pseudonymise(docs: DataFrame, key: bytes = KEY, counts: bool = True) -> DataFrame:
    """docs with the entities in `text` replaced, and with counts, a column n_<kind> for each kind.

    Null texts stay null with counts of 0; other columns are kept, but columns named as the counts are replaced. Nothing is
    shuffled: a surrogate depends on key and entity only, so repeated texts and entities agree wherever they are.
    """
    with_workers(docs.sparkSession)

    @F.arrow_udf("text string, " + ", ".join(f"n_{k} bigint" for k in KINDS))
    def judge(texts: pa.Array) -> pa.Array:
        surrogates = _surrogates(key)
        maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE, ignore_case=True), False)
        new, count = texts.to_pylist(), {k: [0] * len(texts) for k in KINDS}
        for i in pc.indices_nonzero(maybe).to_pylist():
            new[i], found = replace_all(new[i], surrogates)
            for k, n in found.items():
                count[k][i] = n
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), *(pa.array(count[k], pa.int64()) for k in KINDS)], names=["text", *(f"n_{k}" for k in KINDS)])

    more = [f"n_{k}" for k in KINDS] if counts else []
    rest = [c for c in docs.columns if c not in more]
    (judged,) = unused(docs.columns, "judged")
    rows = docs.withColumn(judged, judge(F.col("text").cast("string")))
    return rows.select(*(F.col(judged)["text"].alias("text") if c == "text" else F.col(c) for c in rest), *(F.col(judged)[c].alias(c) for c in more))


_made: dict[bytes, Surrogates] = {}


def _surrogates(key: bytes) -> Surrogates:
    if key not in _made:
        _made[key] = Surrogates(key)
    return _made[key]


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
