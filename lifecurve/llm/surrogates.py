"""Keyed surrogates for personal data (operator 2).

Detected: e-mail addresses, IPv4 addresses, phone numbers (international with + or 00 by the lengths of their
country, national ones of North America, Britain, France and Germany, those with an area in brackets), card and
account numbers (13 to 19 digits, plain or in the groups of issuers), IBANs (by the length of their country),
social security numbers, secrets (long hexadecimal strings; what follows token, key, secret or password and = or :)
and persons (a title and one or two capitalised names, and every further mention of such a name in the same text).

Each shape has its own bounds, so a number that follows an entity is not taken in. International phones, whose length
varies, end before whatever another shape has found.

A surrogate is made by a keyed permutation of all values of the same kind and shape, so it needs no table:
different entities never share one, the same entity has the same one everywhere, and none keeps its own.
The canonical form (digits of a number, lower case of an address) is written position by position as digits
of a mixed radix; a Feistel network keyed by (key, kind, shape) permutes those numbers, a shift in between
rules out fixed points. Format is put back from the original: separators, case, country code, check digit
(Luhn) class, top-level domain. Given names known in a list turn into another of the same gender and script;
other names keep script, case, length, vowel pattern and last letter, and walk on while they meet the list.

``surrogates`` also checks over all documents that distinct entities have distinct surrogates and that no
entity kept its own; a failure would be a defect and ends the query.

Odd input: null texts stay null, empty ones empty, both without entities; overlapping findings go to the one
that starts first, then to the longer; repeated rows are repeated; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache, reduce
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifecurve.llm.common import map_slices, materialize, slices

DEFAULT_KEY = "lifecurve-surrogates"
ROUNDS = 8
#: Given names by (gender, script).
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carmen Charlotte Clara Claire Elena Elizabeth Emma Eva Hannah Helen Ingrid Isabel Jane Julia Karin Laura Linda Lucia Maria Marie Mary Nina Olivia Patricia Petra Rosa Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("m", "latin"): "Adam Alexander Andreas Antonio Carlos Charles Daniel David Emil Felix Francisco Frank George Hans Henry Hugo Jack James Jean John Jorge Juan Karl Louis Luis Manuel Mark Martin Michael Otto Paul Peter Pierre Robert Thomas William".split(),
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Надежда Ольга Полина Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Глеб Дмитрий Евгений Иван Кирилл Максим Николай Олег Павел Роман Сергей Фёдор".split(),
}
#: Titles by gender; others say nothing about it.
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Sra Señora Госпожа".split(), "m": "Mr Herr Monsieur Sr Señor Господин".split(), "": "Dr Prof".split()}
#: Vowels and consonants of each script, lower case.
ALPHABETS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "cyrillic": ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
}
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"

TITLE_OF = {t: g for g, ts in TITLES.items() for t in ts}
PERSON = re.compile(r"\b(" + "|".join(sorted(TITLE_OF, key=len, reverse=True)) + r")\b\.? +([^\W\d_]+(?:[-'’][^\W\d_]+)*)(?: +([^\W\d_]+(?:[-'’][^\W\d_]+)*))?")
#: A word that can be a name, and the ending that is not part of it.
NAME, POSSESSIVE = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"), re.compile(r"['’][sS]\Z")
EMAIL_LEFT, EMAIL_RIGHT = re.compile(r"[A-Za-z0-9._%+\-]+\Z"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Where a number may begin and end.
BEGIN, END = r"(?<![\w.])(?<![0-9]-)", r"(?!\w)"
SSN = re.compile(BEGIN + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END)
ACCOUNT = re.compile(BEGIN + r"(?<![+(])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,4})" + END)
#: What may follow four groups of four digits: a card of 17 to 19 digits.
FIFTH = re.compile(r"([ -])([0-9]{1,3})" + END)
IBAN = re.compile(r"(?<![\w.])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Length of an IBAN by country.
IBAN_LENGTH = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24,
    FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32,
    LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22,
    SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
#: National phones: North America, France, Britain, Germany.
NATIONAL = re.compile(
    BEGIN + r"(?<!\+)(?:(?P<america>(?:\+?1[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4})"
    r"|0[1-9](?:[ .\-][0-9]{2}){4}|0[1-9][0-9] [0-9]{4} [0-9]{4}|0[1-9][0-9]{2} [0-9]{3} [0-9]{4}|0[1-9][0-9]{3} [0-9]{3} ?[0-9]{3}|0[1-9][0-9]{1,3}[ /\-][0-9]{5,8})" + END
)
ABROAD = re.compile(BEGIN + r"(?:\+|00(?=[1-9])|\()(?=[0-9])")
RUN = re.compile(r"[ ().\-]{0,2}([0-9]+)")
#: Digits of a phone after the country code; elsewhere 6 to 12.
ABROAD_LENGTH = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (8, 11), "40": (9, 9),
    "41": (9, 9), "43": (7, 12), "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (7, 11), "52": (10, 10), "54": (10, 11), "55": (10, 11), "57": (10, 10),
    "61": (9, 9), "81": (9, 10), "82": (8, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "351": (9, 9), "353": (7, 9), "358": (6, 11), "380": (9, 9), "420": (9, 9), "421": (9, 9),
}
#: Countries whose numbers keep the zero in front.
KEEPS_ZERO = {"1", "39"}
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
SECRET = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/\-]{8,}={0,2})")
HEXRUN = re.compile(r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)")


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "").split(" ")[0].lower()
    return name if name in ALPHABETS else "latin"


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


class Permuter:
    """Keyed permutations of strings, without fixed points."""

    def __init__(self, key: str):
        self.key = key.encode()
        self.given = {k: sorted(v) for k, v in GIVEN.items()}
        self.known = {n.lower(): k for k, names in self.given.items() for n in names}

    def _round(self, label: bytes, n: int, value: int, modulus: int) -> int:
        said = hmac.new(self.key, label + n.to_bytes(2, "big") + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big"), hashlib.sha256).digest()
        while len(said) * 8 < modulus.bit_length() + 64:
            said += hashlib.sha256(self.key + said).digest()
        return int.from_bytes(said, "big") % modulus

    def number(self, label: str, value: int, a: int, b: int) -> int:
        """Another number below a * b, one to one."""
        total, mark = a * b, label.encode()
        if total < 2:
            return value

        def turn(x: int, back: bool) -> int:
            high, low = divmod(x, b)
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if r % 2:
                    low = (low + sign * self._round(mark, r, high, b)) % b
                else:
                    high = (high + sign * self._round(mark, r, low, a)) % a
            return high * b + low

        shift = 1 + self._round(mark, ROUNDS, 0, total - 1)
        return turn((turn(value, False) + shift) % total, True)

    def string(self, kind: str, text: str, alphabets: list[str]) -> str:
        """Another string over the same alphabets (one per position; of length 1: the sign stays)."""
        free = [(k, alphabet) for k, alphabet in enumerate(alphabets) if len(alphabet) > 1]
        if not free:
            return text
        radices = [len(alphabet) for _, alphabet in free]
        value = 0
        for (k, alphabet), radix in zip(free, radices, strict=True):
            value = value * radix + alphabet.index(text[k])
        cut = (len(free) + 1) // 2
        a, b = reduce(mul, radices[:cut], 1), reduce(mul, radices[cut:], 1)
        fixed = "".join("\0" if len(alphabet) > 1 else text[k] for k, alphabet in enumerate(alphabets))
        value = self.number(f"{kind}|{radices}|{fixed}", value, a, b)
        out = list(text)
        for (k, alphabet), radix in zip(reversed(free), reversed(radices), strict=True):
            value, d = divmod(value, radix)
            out[k] = alphabet[d]
        return "".join(out)

    def by_class(self, kind: str, text: str) -> str:
        """Digits stay digits, letters letters of their alphabet, everything else itself."""
        return self.string(kind, text, [DIGITS if c in DIGITS else LETTERS if c in LETTERS else c for c in text])

    def name(self, word: str, gender: str) -> str:
        """Canonical lower-case name to another one."""
        listed = self.known.get(word)
        if listed:
            names = self.given[listed]
            at = [n.lower() for n in names].index(word)
            return names[self.number(f"given|{listed}", at, len(names), 1)].lower()
        script = script_of(word)
        vowels, consonants = ALPHABETS[script]
        alphabets = [vowels if c in vowels else consonants if c in consonants else c for c in word]
        if sum(len(x) > 1 for x in alphabets[:-1]) >= 2:
            alphabets[-1] = word[-1]
        out = self.string("name", word, alphabets)
        while out in self.known:
            out = self.string("name", out, alphabets)
        return out


def like_case(word: str, model: str) -> str:
    """Letters in the case that the model has there."""
    if len(word) == len(model):
        return "".join(w.upper() if m.isupper() else w for w, m in zip(word, model, strict=True))
    return word.upper() if model.isupper() and len(model) > 1 else word[:1].upper() + word[1:] if model[:1].isupper() else word


def put_digits(digits: str, model: str) -> str:
    """The model with its digits replaced one by one."""
    feed = iter(digits)
    return "".join(next(feed) if c in DIGITS else c for c in model)


def cards(text: str) -> list[tuple[int, int, str, str]]:
    """Card and account numbers; a fifth group belongs to the number only if its check digit says so."""
    out = []
    for m in ACCOUNT.finditer(text):
        digits, end = "".join(c for c in m[0] if c in DIGITS), m.end()
        if m[2] and len(digits) == 16:
            more = FIFTH.match(text, end)
            longer = digits + more[2] if more and more[1] == m[2] else ""
            if longer and int(longer[-1]) == luhn(longer[:-1]) and int(digits[-1]) != luhn(digits[:-1]):
                digits, end = longer, more.end()
        if 13 <= len(digits) <= 19:
            out.append((m.start(), end, "account", digits))
    return out


def ibans(text: str) -> list[tuple[int, int, str, str]]:
    """IBANs, as long as their country has them."""
    out = []
    for m in IBAN.finditer(text):
        need, taken, end = IBAN_LENGTH.get(m[0][:2], 0), [], m.start()
        while len(taken) < need and end < m.end():
            taken += [text[end]] if text[end] != " " else []
            end += 1
        if need and len(taken) == need and not (text[end : end + 1].isalnum() or text[end : end + 1] == "_"):
            out.append((m.start(), end, "iban", "".join(taken).lower()))
    return out


def at_home_digits(digits: str, america: bool = False) -> str:
    """A national number as it follows any country code: without the zero or the one in front."""
    if america:
        return digits[-10:]
    return digits[1:] if digits.startswith("0") else digits


def phones(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """National phones, and those whose end follows from the country's lengths; none goes into what is taken.

    The canonical form is the national number alone, so a phone is one entity with and without +, 00 or country code.
    """
    out = [(*m.span(), "phone", at_home_digits("".join(c for c in m[0] if c in DIGITS), bool(m["america"]))) for m in NATIONAL.finditer(text)]
    at_home = {f[0] for f in out}
    starts = sorted(a for a, _ in taken)
    for m in ABROAD.finditer(text):
        if m.start() in at_home:
            continue
        k = bisect_left(starts, m.start())
        stop = starts[k] if k < len(starts) else len(text)
        ends, digits, at = [], "", m.end()
        while (run := RUN.match(text, at, stop)) and len(digits) + len(run[1]) <= 15:
            digits, at = digits + run[1], run.end()
            ends.append((at, len(digits)))
        code = next((digits[:n] for n in (3, 2, 1) if digits[:n] in ABROAD_LENGTH), "") if m[0] != "(" else ""
        least, most = ABROAD_LENGTH.get(code, (7, 13) if code == "" else (6, 12))
        ends = [(e, n) for e, n in ends if not (text[e : e + 1].isalnum() or text[e : e + 1] == "_")]
        zero = int(bool(code) and code not in KEEPS_ZERO and digits[len(code) : len(code) + 1] == "0")  # +44 (0)20
        fit = [(e, n) for e, n in ends if least <= n - len(code) - zero <= most] or [(e, n) for e, n in ends if n >= 7][:1]
        if fit:
            e, n = fit[-1]
            rest = digits[len(code) : n] if code else at_home_digits(digits[:n]) if m[0] == "(" else digits[max(0, min(3, n - 10)) : n]
            if code and code not in KEEPS_ZERO and rest.startswith("0"):
                rest = rest[1:]
            out.append((m.start(), e, "phone", rest))
    return out


def titled(text: str) -> list[tuple[int, int, str, str]]:
    """Names behind a title; an ending 's is not part of them."""
    out = []
    for m in PERSON.finditer(text):
        gender = TITLE_OF[m[1]]
        for k in (2, 3):
            if not (m[k] and m[k][0].isupper()):
                break
            word = POSSESSIVE.sub("", m[k])
            out.append((m.start(k), m.start(k) + len(word), "person", f"{gender if k == 2 and m[3] else ''}|{word.lower()}"))
            if word != m[k]:
                break
    return out


def untitled(text: str, people: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The names of ``people`` wherever else they stand, in any case: one look-up per word, whatever their number."""
    names = {value.partition("|")[2] for *_, value in people}
    names = {n for n in names if len(n) > 1 and n.capitalize() not in TITLE_OF}
    if not names:
        return []
    there, out = {f[:2] for f in people}, []
    for m in NAME.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_") or text[m.end() : m.end() + 1].isalnum() or text[m.end() : m.end() + 1] == "_":
            continue
        whole = POSSESSIVE.sub("", m[0])
        # The word as it stands, or the parts of a double name.
        at = m.start()
        for part in [whole] if whole.lower() in names else re.split(r"([-'’])", whole):
            if part.lower() in names and (at, at + len(part)) not in there:
                out.append((at, at + len(part), "person", f"|{part.lower()}"))
            at += len(part)
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of what stands in a text, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        left = EMAIL_LEFT.search(text, max(0, at - 64), at)
        right = EMAIL_RIGHT.match(text, at + 1)
        if left and right:
            found.append((left.start(), right.end(), "email", text[left.start() : right.end()].lower()))
        at = text.find("@", at + 1)
    for m in IPV4.finditer(text):
        parts = m[0].split(".")
        if all(int(p) < 256 for p in parts):
            found.append((m.start(), m.end(), "ipv4", ".".join(str(int(p)) for p in parts)))
    found += [(*m.span(), "ssn", "".join(c for c in m[0] if c in DIGITS)) for m in SSN.finditer(text)] + cards(text) + ibans(text)
    found += phones(text, [f[:2] for f in found])
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret", m[1]) for m in SECRET.finditer(text)]
    found += [(*m.span(), "secret", m[0]) for m in HEXRUN.finditer(text)]
    people = titled(text)
    found += people
    found += untitled(text, people)
    found.sort(key=lambda f: (f[0], -f[1]))
    out, end = [], 0
    for f in found:
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return out


class Surrogates:
    """Surrogates of canonical forms under one key."""

    def __init__(self, key: str = DEFAULT_KEY):
        self.permuter = Permuter(key)
        self.made: dict[tuple[str, str], str] = {}

    def canonical(self, kind: str, value: str) -> str:
        """The surrogate's canonical form."""
        done = self.made.get((kind, value))
        if done is None:
            if len(self.made) > 100_000:
                self.made.clear()
            done = self.made[kind, value] = getattr(self, f"_{kind}")(value)
        return done

    def _email(self, value: str) -> str:
        local, _, domain = value.partition("@")
        labels, _, top = domain.rpartition(".")
        if sum(c.isalnum() for c in local) < 2:
            local, labels = self.permuter.by_class("email", f"{local}@{labels}").split("@")
            return f"{local}@{labels}.{top}"
        return f"{self.permuter.by_class('local', local)}@{self.permuter.by_class('domain', labels)}.{top}"

    def _ipv4(self, value: str) -> str:
        a, b, c, d = map(int, value.split("."))
        n = self.permuter.number("ipv4", ((a * 256 + b) * 256 + c) * 256 + d, 1 << 16, 1 << 16)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    def _phone(self, value: str) -> str:
        return self.permuter.string("phone", value, [DIGITS[1:] if k == 0 and c != "0" else DIGITS for k, c in enumerate(value)])

    def _account(self, value: str) -> str:
        gap = (int(value[-1]) - luhn(value[:-1])) % 10
        body = self.permuter.string(f"account{gap}", value[:-1], [DIGITS] * (len(value) - 1))
        return body + str((luhn(body) + gap) % 10)

    def _iban(self, value: str) -> str:
        right = lambda body: 98 - int("".join(str(int(c, 36)) for c in f"{body}{value[:2]}00")) % 97
        said, body = int(value[2:4]), value[4:]
        if not 2 <= said <= 98:
            return value[:4] + self.permuter.by_class(f"iban{value[:4]}", body)
        gap = (said - right(body)) % 97
        body = self.permuter.by_class(f"iban{value[:2]}{gap}", body)
        return f"{value[:2]}{2 + (right(body) - 2 + gap) % 97:02d}{body}"

    def _ssn(self, value: str) -> str:
        return self.permuter.string("ssn", value, [DIGITS] * len(value))

    def _secret(self, value: str) -> str:
        plain = value.lower()
        if all(c in HEX for c in plain) and value in (plain, value.upper()):
            return like_case(self.permuter.string("hex", plain, [HEX] * len(plain)), value) if value == plain else self.permuter.string("HEX", plain, [HEX] * len(plain)).upper()
        alphabets = [DIGITS if c in DIGITS else LETTERS if c in LETTERS else LETTERS.upper() if c in LETTERS.upper() else c for c in value]
        out = self.permuter.string("secret", value, alphabets)
        while all(c in HEX for c in out.lower()) and out in (out.lower(), out.upper()):
            out = self.permuter.string("secret", out, alphabets)
        return out

    def _person(self, value: str) -> str:
        gender, _, word = value.partition("|")
        return f"{gender}|{self.permuter.name(word, gender)}"

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        """The text with surrogates, and what was found."""
        found, parts, at = find(text), [], 0
        for start, end, kind, value in found:
            said, new = text[start:end], self.canonical(kind, value)
            if kind in ("phone", "account", "ssn"):  # of a phone, what stands before the national number stays
                digits = "".join(c for c in said if c in DIGITS)
                new = put_digits(digits[: len(digits) - len(new)] + new, said)
            elif kind == "iban":
                feed = iter(new.upper())
                new = "".join(c if c == " " else next(feed) for c in said)
            elif kind == "email":
                new = like_case(new, said)
            elif kind == "person":
                new = like_case(new.partition("|")[2], said)
            parts += [text[at:start], new]
            at = end
        return "".join(parts) + text[at:] if found else text, found


@lru_cache(maxsize=4)
def maker(key: str) -> Surrogates:
    return Surrogates(key)


def entities(docs: DataFrame, key: str = DEFAULT_KEY, *, text_col: str = "text") -> DataFrame:
    """(kind, value, surrogate, n) of every distinct entity, counted over all documents."""

    def run(batches):
        made = maker(key)
        for part in slices(batches):
            counts: dict[tuple[str, str], int] = {}
            for t in part.column("text").to_pylist():
                for _, _, kind, value in find(t) if t else ():
                    if kind == "person":
                        value = "|" + value.partition("|")[2]
                    counts[kind, value] = counts.get((kind, value), 0) + 1
            rows = [(k, v, made.canonical(k, v), n) for (k, v), n in counts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "value", "surrogate", "n"])

    found = map_slices(docs.select(F.col(text_col).alias("text")), run, "kind string, value string, surrogate string, n long")
    return found.groupBy("kind", "value", "surrogate").agg(F.sum("n").alias("n"))


def collisions(found: DataFrame) -> DataFrame:
    """(kind, surrogate, n) of surrogates that several entities share or that are their own entity."""
    groups = found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("value") == F.col("surrogate")).cast("int")).alias("own"))
    return groups.where("n > 1 or own > 0").select("kind", "surrogate", "n")


def surrogates(docs: DataFrame, key: str = DEFAULT_KEY, *, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, kinds) of every row: the text with surrogates, and the kinds in order.

    With ``check`` the result is written once together with its entities, and the query ends if two of these share a surrogate.
    """

    def run(batches):
        made = maker(key)
        for part in slices(batches):
            done = [made.replace(t) if t else (t, []) for t in part.column("text").to_pylist()]
            listed = []
            for _, found in done:
                values = {(kind, "|" + value.partition("|")[2] if kind == "person" else value) for _, _, kind, value in found} if check else ()
                listed.append([{"kind": k, "value": v, "surrogate": made.canonical(k, v)} for k, v in sorted(values)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), pa.array([[x[2] for x in f] for _, f in done], pa.list_(pa.string())), pa.array(listed, pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "value", "surrogate")])))],
                names=["doc_id", "text", "n_entities", "kinds", "entities"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = map_slices(rows, run, "doc_id long, text string, n_entities long, kinds array<string>, entities array<struct<kind: string, value: string, surrogate: string>>")
    if not check:
        return out.drop("entities")
    out = materialize(out)
    found = out.select(F.inline("entities")).distinct()
    bad = collisions(found).limit(3).collect()
    if bad:
        raise RuntimeError(f"entities share surrogates: {[r['kind'] for r in bad]}")
    return out.drop("entities")
