"""Personal data replaced by surrogates of the same kind and form.

A surrogate comes from a keyed permutation of all strings of the same form: digits stay digits, vowels vowels, letters
keep their case and script, check digits stay right, networks and country codes stay. The same entity gets the same
surrogate in every document and in every way of writing it (coreference), and as a permutation never maps two things
to one, different entities stay different; ``checked`` makes sure of that over the whole corpus. Given names go round
a keyed cycle of the names of their script and gender. A name once found is replaced wherever it stands in its text.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.shared import text_passes, written

#: Given names by script and gender. Fixed values.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Camille Carla Carmen Charlotte Claire Clara Diana Elena Elizabeth Emma Eva Hannah Helen Ines Isabel Jane Julia Karen Laura Lena Linda Lucia Maria Marie Marta Mary Monika Nina Nora Olivia Paula Petra Rosa Sabine Sarah Sofia Sophie Susan Teresa Ursula".split(),
    ("latin", "m"): "Adam Albert Alexander Andreas Antonio Arthur Bernd Carlos Charles Daniel David Diego Emil Felix Francisco Frank George Hans Henry Hugo Jacques James Jan Jean Johannes John Jorge Jose Juan Karl Klaus Louis Luis Manuel Marcel Mark Martin Michael Miguel Oliver Otto Pablo Paul Peter Pierre Robert Stefan Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Павел Сергей".split(),
    ("greek", "f"): "Αθηνά Άννα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιάννης Γιώργος Δημήτρης Κώστας Νίκος".split(),
}
OF_GIVEN = {name: (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}
NAMED = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(OF_GIVEN))})(?=\s)")
#: What stands between the words of a name: white space of any length with one line break at most.
APART = r"(?:[^\S\n]++\n?+|\n)[^\S\n]*+"
#: Words in lower case before a family name. Fixed values.
PARTICLES = rf"(?:(?:van|von|vom|zu|zum|zur|de|del|della|der|den|di|da|dos|das|du|la|le|las|los|ter|ten|af|av){APART})*"


def family_name(small: str) -> str:
    """A capital and letters, joined by hyphens or after O' and the like; ``small``: letters that do not begin a name."""
    return rf"((?:[^\W\d_]['’])?[^\W\d_{small}][^\W\d_]+(?:-[^\W\d_{small}][^\W\d_]*)*)"


#: Titles before a family name. Fixed values.
TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sra?|Don|Doña)\b\.?{APART}(?:(?:Dr|Prof)\b\.?{APART})*+((?:[^\W\d_]\w*{APART})?){PARTICLES}{family_name('a-zà-ÿ')}")
#: Letters that stand for each other: same script, same sound class.
LETTERS = ("bcdfghjklmnpqrstvwxz", "aeiouy", "бвгджзклмнпрстфхцчшщ", "аеёиоуыэюя", "βγδζθκλμνξπρστφχψ", "αεηιουω", "äöü", "àâèéêëîïôùû", "áíóú", "0123456789", "άέήίόύώ", "ñçłśšžčćřňďťńźżşğđ", "ąęěůőűøåæœãõ", "іїєґўј")
CLASS = {c: (k, i) for k, letters in enumerate(LETTERS) for i, c in enumerate(letters)}


@lru_cache(1 << 14)
def class_of(c: str) -> tuple[str, int] | None:
    """The letters that a lower-case letter or digit stands among, and its place there; None for other characters."""
    if c in CLASS:
        k, at = CLASS[c]
        return LETTERS[k], at
    if c == "ς" or not (c.isalpha() or c.isdecimal()):  # a final sigma is a sigma: it stays, so that capitals agree
        return None
    letters = page_letters(ord(c) >> 8, *_sort(c))
    return letters, letters.index(c)


def _sort(c: str) -> tuple[str, str, bool]:
    """Script, category and whether there is one capital that leads back."""
    upper = c.upper()
    return unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), upper != c and len(upper) == 1 and upper.lower() == c


@lru_cache(256)
def page_letters(page: int, script: str, category: str, cased: bool) -> str:
    """The letters of one sort, outside the classes, among 256 code points; lower-case ones."""
    return "".join(c for c in map(chr, range(page << 8, page + 1 << 8)) if c not in CLASS and (c.isalpha() or c.isdecimal()) and c.lower() == c and _sort(c) == (script, category, cased))


def form_of(letters: str) -> str:
    k = LETTERS.index(letters) if letters in LETTERS else -1
    return chr(97 + k) if k >= 0 else f"<{letters[0]}>"


DIGITS = re.compile(r"(?<![\w.])[+(]?\d[\d .()\-/]{5,}\d(?!\w)")
IPV4 = re.compile(r"(?<!\d)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d)")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
DATE = re.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})")
#: A date of this or the last century beside other numbers.
BESIDE = re.compile(r"(?:^|(?<= ))(?:(?:19|20)\d\d([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d)(?= |$)")
#: Entities of a form of their own, which stand out of a run of digits, spaces and signs; in the order in which they are taken.
CLEAR = [(kind, re.compile(pattern)) for kind, pattern in (
    ("phone", r"(?<![\d.])\d{2}(?:\.\d{2}){4}(?!\.?\d)"),
    ("ipv4", IPV4.pattern),
    ("ssn", rf"(?:^|(?<=[ (])){SSN.pattern}(?=[.)\-/]*(?: |$))"),
    ("card", r"(?:^|(?<=[ (]))\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{6}\1\d{4,5})(?=[.)\-/]*(?: |$))"),
    ("phone", r"(?:^|(?<= ))(?:\+\d{1,3}[ .\-]?|1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[.\-]\d{4}(?=[.)\-/]*(?: |$))"),
    ("phone", r"(?:^|(?<= ))\d{3}-\d{4}(?= (?:\(?\d{3}[) \-]|$)|$)"),
)]
#: Parts of a run that is no entity as a whole: dates, phones in threes and fours, numbers, phones after an exit sign or zero.
PARTS = [(kind, re.compile(pattern)) for kind, pattern in (
    ("date", rf"(?:^|(?<=[ /(])){DATE.pattern}(?=[.)\-/]*(?: |$))"),
    ("card", r"(?:^|(?<=[ /(]))\d{13,19}(?=[.)\-/]*(?: |$)|/)"),
    ("number", r"(?:^|(?<=[ /(]))(?:\d{9,12}|\d{20,30})(?=[.)\-/]*(?: |$)|/)"),
    ("ssn", rf"(?:^|(?<=[ /(])){SSN.pattern}(?=[.)\-/]*(?: |$)|/)"),
    ("phone", r"(?:^|(?<=[ /]))(?:\+?1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?=[.)\-/]*(?: |$)|/)"),
    ("phone", r"(?:^|(?<=[ /]))(?:\+|\(0?|0)(?:\d[.()\-/]*| (?![(0]))*\d"),
)]
#: How tokens of well-known services begin, and how long they are at least. Fixed values.
TOKEN = re.compile(
    r"(?<![0-9A-Za-z_\-])(?:gh[pousr]_(?=[0-9A-Za-z]{36})|github_pat_(?=\w{22})|glpat-(?=[\w\-]{20})|hf_(?=[0-9A-Za-z]{30})|(?:AKIA|ASIA)(?=[0-9A-Z]{16}(?![0-9A-Za-z]))|AIza(?=[\w\-]{35})|xox[abprs]-(?=[\w\-]{10})"
    r"|sk-(?=(?:[a-z]+-)*[0-9A-Za-z_\-]{20})(?:[a-z]+-)*|[sr]k_live_(?=[0-9A-Za-z]{16})|eyJ(?=[\w\-]+\.eyJ[\w\-]+\.[\w\-]{8}))([0-9A-Za-z_\-]+(?:\.[\w\-]+)*)"
)
#: A value of eight characters at least that is named as secret; it has a letter and a digit.
ASSIGNED = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|(?:api|access|secret|private)[_-]?key|(?:auth|access)?[_-]?token)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?((?=[^\s\"']*[a-z])(?=[^\s\"']*\d)[\w!@#$%^&*+/=.~\-]{8,})")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
MAC = re.compile(r"(?<![0-9A-Za-z:\-])[0-9A-Fa-f]{2}([:\-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Za-z:\-])")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
LOCAL, DOMAIN = re.compile(r"[\w.%+\-][\w.%+\-'’]*$"), re.compile(r"[^\W_](?:[^\W_]|-)*(?:\.[^\W_](?:[^\W_]|-)*)+")
FAMILY = re.compile(rf"{APART}{PARTICLES}{family_name('a-zà-ÿа-яα-ω')}")
#: Words for a passport; its number, of letters and digits, comes after one. Fixed values.
PASSES = [w for word in ("passport", "passeport", "pasaporte", "reisepass") for w in (word, word.capitalize(), word.upper())]
PASSPORT = re.compile(rf"\b(?:{'|'.join(PASSES)})\b\W{{0,3}}(?i:(?:no|nr|number|nummer|num[eé]ro)\b\W{{0,3}})?((?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{{6,9}})(?![0-9A-Za-z])")


#: Letters of a text up to which it is one number that is permuted.
WHOLE = 256


class Surrogates:
    """Keyed permutations; one key gives the same surrogates everywhere."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permuted = lru_cache(200_000)(self._permuted)

    def _round(self, data: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest())

    def _permuted(self, kind: str, size: int, value: int) -> int:
        """A permutation of range(size): a Feistel network of 8 rounds, walked until it is back in range."""
        if size < 2:
            return value
        half = (size.bit_length() + 1) // 2
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for i in range(8):
                seed = f"{kind}|{size}|{i}|{right}".encode()
                f = self._round(seed)
                if half > 256:
                    f |= self._round(seed + b"+") << 256 if half <= 512 else int.from_bytes(hashlib.shake_256(self.key + seed).digest(half // 8 + 1))
                left, right = right, left ^ (f & mask)
            value = left << half | right
            if value < size:
                return value

    def _halved(self, kind: str, known: list[tuple]) -> list[int]:
        """A permutation of the letters of a long text, in time that grows with its length: the places of each half are moved by what the other is, four times."""
        own, half = [at for _, _, at in known], len(known) // 2
        for i in range(4):
            by, moved = (own[:half], range(half, len(own))) if i % 2 == 0 else (own[half:], range(half))
            seed = self._round(f"{kind}|{len(own)}|{i}|{by}".encode()).to_bytes(32)
            steps = hashlib.shake_256(self.key + seed).digest(4 * len(moved))
            for k, j in enumerate(moved):
                own[j] = (own[j] + int.from_bytes(steps[4 * k : 4 * k + 4])) % len(known[j][1])
        return own

    def by_class(self, kind: str, text: str) -> str:
        """Each letter or digit replaced within its class or, outside the classes, its script's page; case and other characters stay."""
        lower = text.lower()
        if len(lower) != len(text):
            return self.opaque(kind, lower)
        known = [(i, *found) for i, c in enumerate(lower) if (found := class_of(c))]
        size, value = 1, 0
        for _, letters, at in known if len(known) <= WHOLE else ():
            size, value = size * len(letters), value * len(letters) + at
        form, out = list(lower), list(text)
        for i, letters, _ in known:
            form[i] = form_of(letters)
        if len(known) > WHOLE:
            for (i, letters, _), at in zip(known, self._halved(f"{kind}|{''.join(form)}", known)):
                out[i] = letters[at].upper() if text[i] != lower[i] and _sort(letters[at])[2] else letters[at]
            return "".join(out)
        new = self.permuted(f"{kind}|{''.join(form)}", size, value)
        if new == value and any(c.isalpha() and c not in CLASS for c in lower):
            return self.opaque(kind, lower)
        for i, letters, _ in reversed(known):
            new, at = divmod(new, len(letters))
            out[i] = letters[at].upper() if text[i] != lower[i] and _sort(letters[at])[2] else letters[at]
        return "".join(out)

    def opaque(self, kind: str, text: str) -> str:
        return f"{kind}-{self._round(f'{kind}|{text}'.encode()) % (1 << 96):024x}"

    def digits(self, kind: str, text: str, keep: int = 0) -> str:
        """The digits after the first ``keep`` replaced; the other characters stay where they are."""
        own = re.sub(r"\D", "", text)
        rest = own[keep:]
        new = iter(own[:keep] + str(self.permuted(f"{kind}|{own[:keep]}", 10 ** len(rest), int(rest or 0))).zfill(len(rest)) if rest else own)
        return "".join(next(new) if c.isdigit() else c for c in text)

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        *labels, top = domain.split(".")
        return f"{self.by_class('local', local)}@{'.'.join([*(self.by_class('label', x) for x in labels), top])}"

    def ipv4(self, text: str) -> str:
        a, b, c, d = map(int, text.split("."))
        value = a << 24 | b << 16 | c << 8 | d
        bits = next((n for n, net in ((24, 10 << 24), (24, 127 << 24), (16, 192 << 24 | 168 << 16), (20, 172 << 24 | 16 << 16)) if value >> n == net >> n), 0)
        if bits:
            value = value >> bits << bits | self.permuted(f"ip{value >> bits}", 1 << bits, value & (1 << bits) - 1)
        else:  # a public address stays public: walk past the networks above
            while True:
                value = self.permuted("ip", 1 << 32, value)
                if not any(value >> n == net >> n for n, net in ((24, 10 << 24), (24, 127 << 24), (16, 192 << 24 | 168 << 16), (20, 172 << 24 | 16 << 16))):
                    break
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def card(self, text: str) -> str:
        """First digit and length stay; the last digit stays as far from the right check digit as it was."""
        own = re.sub(r"\D", "", text)
        body = own[1:-1]
        off = int(own[-1]) - check_digit(own[:-1])
        new = own[0] + str(self.permuted(f"card|{own[0]}", 10 ** len(body), int(body))).zfill(len(body))
        given = iter(new + str((check_digit(new) + off) % 10))
        return "".join(next(given) if c.isdigit() else c for c in text)

    def iban(self, text: str) -> str:
        own = text.replace(" ", "")
        body = self.by_class(f"iban|{own[:2]}", own[4:])
        check = int(own[2:4])
        if 2 <= check <= 98:  # right ones are; 00, 01 and 99, never right, stay
            check = 2 + (check - iban_check(own) + iban_check(own[:2] + "00" + body) - 2) % 97
        given = iter(f"{own[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(given) for c in text)

    def ipv6(self, text: str) -> str:
        """The first 16 bits, which tell what kind of address it is, stay."""
        value = int(ipaddress.IPv6Address(text))
        new = str(ipaddress.IPv6Address(value >> 112 << 112 | self.permuted(f"ipv6|{value >> 112}", 1 << 112, value & (1 << 112) - 1)))
        return new.upper() if text.upper() == text else new

    def mac(self, text: str) -> str:
        """The two bits that tell group and local addresses stay."""
        value = int(re.sub(r"[:\-]", "", text), 16)
        kind, rest = value >> 40 & 3, (value >> 42) << 40 | value & (1 << 40) - 1
        rest = self.permuted(f"mac|{kind}", 1 << 46, rest)
        new = f"{(rest >> 40) << 42 | kind << 40 | rest & (1 << 40) - 1:012x}"
        new = text[2].join(new[i : i + 2] for i in range(0, 12, 2))
        return new.upper() if text.upper() == text else new

    def given(self, name: str) -> str:
        """The next of the names of one script and gender; a name of no list is replaced letter by letter."""
        if name not in OF_GIVEN:
            return self.given(name.title()).upper() if name.isupper() and name.title() in OF_GIVEN else self.by_class("given", name)
        (group, i), n = OF_GIVEN[name], len(GIVEN[OF_GIVEN[name][0]])
        order = sorted(range(n), key=lambda k: self._round(f"{group}|{k}".encode()))
        return GIVEN[group][order[(order.index(i) + 1) % n]]

    def of(self, kind: str, text: str) -> str:
        if kind in ("email", "ipv4", "ipv6", "mac", "card", "iban", "given"):
            return getattr(self, kind)(text)
        if kind == "phone":
            code = len(re.match(r"\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", text)[1]) if re.match(r"\+\d", text) else 0
            return self.digits(kind, text, code)
        if kind == "secret":
            size, value = 16 ** len(text), int(text, 16)
            new = f"{self.permuted('secret', size, value):0{len(text)}x}"
            return new.upper() if text.upper() == text else new
        return self.by_class(kind, text) if kind in ("family", "token") else self.digits(kind, text)


def check_digit(body: str) -> int:
    return -sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body))) % 10


def right_card(own: str) -> bool:
    return check_digit(own[:-1]) == int(own[-1])


def iban_check(own: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in own[4:] + own[:2] + "00")) % 97


def normal(kind: str, text: str) -> str:
    """What two ways of writing one entity have in common."""
    if kind in ("email", "family", "given", "secret"):
        return text.lower()
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(text))
    if kind == "mac":
        return re.sub(r"[:\-]", "", text).lower()
    if kind in ("phone", "card", "ssn", "number"):
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "ipv4":
        return ".".join(str(int(x)) for x in text.split("."))
    return text.replace(" ", "") if kind == "iban" else text


def find(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each entity, in order, without overlap; of two that overlap the earlier, then longer, stays."""
    out: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        domain, back = DOMAIN.match(text, at + 1, at + 255), 64  # no domain name is longer
        local = LOCAL.search(text[max(0, at - back) : at]) if domain else None
        while local and len(local[0]) == back < at:  # a local part may be of any length
            back *= 2
            local = LOCAL.search(text[max(0, at - back) : at])
        if local:
            out.append((at - len(local[0]), domain.end(), "email"))
        at = text.find("@", at + 1)
    for m in SECRET.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            out.append((m.start(), m.end(), "secret"))
    for m in TOKEN.finditer(text):
        out.append((m.start(1), m.end(), "token"))
    for m in PASSPORT.finditer(text) if any(w in text for w in PASSES) else ():
        out.append((m.start(1), m.end(1), "token"))
    named = "=" in text or ":" in text  # without either nothing is named, and no IPv6 address stands
    for m in ASSIGNED.finditer(text) if named else ():
        if not SECRET.fullmatch(m[1]) and not TOKEN.search(m[1]):
            out.append((m.start(1), m.end(), "token"))
    for m in IPV6.finditer(text) if named else ():
        if is_ipv6(m[0]):
            out.append((m.start(), m.end(), "ipv6"))
    for m in MAC.finditer(text):
        out.append((m.start(), m.end(), "mac"))
    for m in IBAN.finditer(text):
        if 15 <= len(m[0].replace(" ", "")) <= 34:
            out.append((m.start(), m.end(), "iban"))
    for m in DIGITS.finditer(text):
        out += _numbers(m)
    for m in TITLED.finditer(text):
        first = m[1].strip()
        if first and first[0] != first[0].lower() or first in OF_GIVEN:
            out.append((m.start(1), m.start(1) + len(first), "given"))
        out.append((m.start(2), m.end(2), "family"))
    for m in NAMED.finditer(text):
        if family := FAMILY.match(text, m.end()):
            out += [(m.start(), m.end(), "given"), (family.start(1), family.end(1), "family")]
    names = {text[a:b]: kind for a, b, kind in out if kind in ("given", "family")}
    if names:  # wherever else they stand, in capitals too
        names |= {n.upper(): kind for n, kind in names.items() if len(n.upper()) == len(n)}
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)", text):
            out.append((m.start(), m.end(), names[m[0]]))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, end = [], 0
    for x in out:
        if x[0] >= end:
            kept.append(x)
            end = x[1]
    return kept


def is_ipv6(text: str) -> bool:
    """Whether it is an address of three groups at least, with a digit."""
    if sum(bool(g) for g in text.split(":")) < 3 or not any(c.isdigit() for c in text):
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def _numbers(m: re.Match) -> list[tuple[int, int, str]]:
    """The entities in a run of digits, spaces and signs: those of a form of their own, then what is left between them."""
    found, free = _taken(CLEAR, m[0], [(0, len(m[0]))])
    for a, b in free:
        if (whole := _whole(m[0], a, b)) is not None:
            found += whole
            continue
        parts, rest = _taken(PARTS, m[0], [(a, b)])
        found += [x for x in parts if x[2] != "date"]
        for c, d in rest:
            found += _whole(m[0], c, d) or []
    return [(m.start() + a, m.start() + b, kind) for a, b, kind in found]


def _taken(patterns: list[tuple[str, re.Pattern]], text: str, free: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """What the patterns, one after another, find in the free stretches of a run, and the stretches still free."""
    found = []
    for kind, pattern in patterns:
        left = []
        for a, b in free:
            at = a
            for x in pattern.finditer(text[a:b]):
                if kind == "phone" and not 7 <= sum(c.isdigit() for c in x[0]) <= 15:
                    continue
                if kind != "card" or not x[0].isdigit() or right_card(x[0]):
                    found.append((a + x.start(), a + x.end(), kind))
                    left.append((at, a + x.start()))
                    at = a + x.end()
            left.append((at, b))
        free = [(a, b) for a, b in left if b - a >= 7]
    return found, free


def _whole(text: str, a: int, b: int) -> list[tuple[int, int, str]] | None:
    """The entity that a stretch of a run is, [] if it is a date or short, None if it may hold several."""
    inner = re.search(r"[+(]?\d(?:.*\d)?", text[a:b])
    if not inner:
        return []
    own, a, b = inner[0], a + inner.start(), a + inner.end()
    n = sum(c.isdigit() for c in own)
    if n < 7 or DATE.fullmatch(own):
        return []
    if BESIDE.search(own):
        return None
    if SSN.fullmatch(own):
        return [(a, b, "ssn")]
    if 13 <= n <= 19 and re.fullmatch(r"\d{4}(?:[ -]\d{2,6}){2,4}", own):
        return [(a, b, "card")]
    if 13 <= n <= 19 and own.isdigit():  # of digits alone only a right check digit tells a card from any other number
        return [(a, b, "card")] if right_card(own) else []
    if n <= 15 and (own[0] in "+(" or re.search(r"[ .)\-/]", own)):
        return [(a, b, "phone")]
    if own.isdigit():
        return [(a, b, "number")] if 9 <= n <= 30 else []
    return None


def replaced(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, what was there, surrogate) of each entity."""
    out, entities, end = [], [], 0
    for a, b, kind in find(text):
        own = text[a:b]
        new = surrogates.of(kind, own)
        out += [text[end:a], new]
        entities.append((kind, own, new))
        end = b
    out.append(text[end:])
    return "".join(out), entities


@lru_cache(8)
def surrogates_for(key: bytes) -> Surrogates:
    return Surrogates(key)


ENTITIES = "array<struct<kind:string,digest:string,surrogate:string>>"


def with_entities(docs: DataFrame, key: bytes, column: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, ``n_chars`` (if there) the new length, and the entities as ``column``.

    ``digest`` is a keyed digest of what was there. All other columns stay; a null text stays null with no entities;
    repeated rows are replaced alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = surrogates_for(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("digest", pa.string()), ("surrogate", pa.string())]))
        for part, texts in text_passes(batches):
            new, found = [], []
            for t in texts:
                after, entities = (None, []) if t is None else replaced(t, made)
                new.append(after)
                found.append([{"kind": k, "digest": hashlib.blake2b(normal(k, a).encode(), key=made.key, digest_size=16).hexdigest(), "surrogate": normal(k, b)} for k, a, b in entities])
            columns = {c: part.column(c) for c in part.schema.names}
            columns["text"] = pa.array(new, part.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found, kind)], names=[*columns, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T._parse_datatype_string(ENTITIES))]))


def collisions(found: DataFrame, column: str = "entities") -> DataFrame:
    """(kind, surrogate, n) of surrogates that stand for more than one entity, over all documents."""
    each = found.select(F.explode(column).alias("e")).select("e.kind", "e.surrogate", "e.digest").distinct()
    return each.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def checked(docs: DataFrame, key: bytes, column: str, attempts: int = 3) -> DataFrame:
    """``with_entities``, written to the shared folder and free of collisions; with any, the key is salted anew."""
    for i in range(attempts):
        found = written(with_entities(docs, key if not i else hashlib.blake2b(key, salt=i.to_bytes(16)).digest(), column), "surrogates")
        if collisions(found, column).isEmpty():
            return found
    raise RuntimeError(f"surrogates collide under each of {attempts} keys")


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, entities) of every document, as ``with_entities``, checked over all of them."""
    return checked(docs.select("doc_id", "text"), key, "entities")


def redacted(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates, with the columns that it has, checked over all documents."""
    column = max(docs.columns, key=len) + "_entities"  # a name that no column has
    return checked(docs, key, column).drop(column)
