"""Surrogates for personal data: keyed, of one type and format, distinct.

Detected: e-mail addresses (of any script), IP addresses (both kinds, shortened
ones too), Luhn-valid card numbers, IBANs with right check digits, US social
security numbers, phone numbers, access keys, tokens and JWTs by their form,
values after ``token=``, ``secret=``, ``api_key=``, ``password=`` and the like,
and names: after a form of address or a phrase such as "my name is" in several
languages, a listed given name before a capitalised word, and Chinese, Japanese
and Korean names before or after a word that goes with names. Later bare
mentions of a name follow.

Every kind of entity is mapped onto itself by a keyed permutation that is one
single cycle, so nothing stays as it is, distinct values get distinct
surrogates, and the same value gets the same one in all documents, without any
state. Restricting the cycle to a part (by walking on to the next member of the
part) keeps all this, which is the collision check: a card's number stays valid,
an address of a private network stays in it, and a name that isn't listed never
meets a listed one. Digits stay digits of their script, letters letters of their
script (vowels vowels in names), hex hex; separators, top-level domains, country
codes, prefixes of keys and check digits' validity stay. Case is put back from
the original, so spellings in other case are one entity.

Listed given names move within their gender and script, listed surnames within
theirs. Other names are spelled anew and keep the ending that tells the gender.
As with any permutation, the surrogate of one entity may be the original of
another; it never is its own.

Defined results: a null text stays null with no entities; empty texts and texts
without entities are returned unchanged. Null ids and repeated rows give a row
each. Empty tables give empty results. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import id_type, map_text

_TITLES = (
    "Mr Mister Sir Mrs Ms Miss Madam Dr Prof Professor Herr Herrn Frau Doktor Monsieur Mme Madame Mlle Docteur Señor Sr Señora Sra Señorita Don Doña Doctor "
    "господин г-н госпожа г-жа Господин Госпожа κύριος κυρία κος κα Κύριος Κυρία Κος Κα"
).split()
_GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Charles Daniel Matthew Mark Paul Steven Andrew Kenneth George Edward Brian Kevin Peter Hans Karl Stefan Pierre Jean Luc Carlos Juan Luis Miguel Pablo Antonio Jorge Frank Henry Jacob Oliver Samuel Benjamin Nathan Gerhard Wolfgang Jürgen Dieter Heinz François Michel Alain Philippe Javier Diego Fernando Rafael Andrés".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Laura Anna Helen Julia Sophie Claire Marie Camille Ingrid Petra Heike Carmen Lucia Isabel Elena Maria Rosa Ana Olivia Emma Hannah Charlotte Grace Monika Sabine Ursula Renate Nathalie Isabelle Monique Pilar Teresa Sofía Beatriz".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Александр Павел Олег Максим Артём Юрий Виктор".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Дарья Вера Людмила Марина Галина Ксения".split(),
    ("m", "greek"): "Γιώργος Γιάννης Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης Χρήστος".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
}
_FAMILY = {
    "latin": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Rogers Reed Cook Morgan Bell Murphy Bailey Cooper Richardson Cox Howard Ward Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Dubois Moreau Laurent Bernard Girard Lefevre Petit Durand Leroy Roux García Martínez López González Pérez Sánchez Ramírez Torres Rodríguez Fernández Gómez Díaz Hernández Moreno".split(),
    "cyrillic": "Иванов Петров Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков Зайцев Соловьёв Васильев Павлов Фёдоров".split(),
    "greek": "Παπαδόπουλος Παπαδάκης Αντωνίου Γεωργίου Δημητρίου Ιωάννου Νικολάου Οικονόμου".split(),
}
_POOL = {name.casefold(): pool for pool in (*_GIVEN.values(), *_FAMILY.values()) for name in pool}
_FIRST = {name.casefold() for pool in _GIVEN.values() for name in pool}
#: Surnames of one character, and characters of given names.
_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_HANGUL = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민"
#: Endings that tell the gender of a surname or given name; they stay.
_ENDINGS = tuple(sorted("ова ева ёва ина ына ская цкая ов ев ёв ин ын ский цкий ая ий ой ός ος ης ας ου ή α a o e us".split(), key=len, reverse=True))
_VOWELS = ("aeiou", "аеёиоуыэюя", "αεηιουω")
_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώ")
_NETWORKS = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/8", "240.0.0.0/4")]

_UPPER = "A-ZÀ-ÖØ-Þ" + "".join(chr(c) for c in range(0x100, 0x180) if unicodedata.category(chr(c)) == "Lu") + "А-ЯЁΆΈ-ΏΑ-Ϋ"
_TITLE = "|".join(sorted(map(re.escape, _TITLES), key=len, reverse=True))
_PHRASE = r"[Mm]y name is|[Nn]ame:|[Ss]igned by|[Aa]uthor:|[Mm]ein Name ist|[Ii]ch hei(?:ß|ss)e|[Jj]e m['’]appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут|[Ии]мя:|[Μμ]ε λένε|[Όό]νομα:"
_NAME = rf"[{_UPPER}][\w’'-]*"
_OTHER = rf"(?!(?:{_TITLE})\b){_NAME}"
_KEYWORD = r"token|secret|api[_-]?key|access[_-]?key|client[_-]?secret|password|passwd|pwd"

#: Whether a text can hold anything at all; one pass of a linear-time matcher. Its \b, \d and (?i) know fewer characters
#: than those of ``_ENTITY``, so it has digits of any script, both Turkish i, and what follows a title in place of \b.
_HINT = rf"[\pN@]|(?i:[s\x{{17f}}]ecret|pa[s\x{{17f}}]{{2}}w|pwd|to[k\x{{212a}}]en|(?:ap[iıİ]|acce[s\x{{17f}}]{{2}}).?[k\x{{212a}}]ey|bearer)|eyJ|gh[pousr]_|github_pat|xox|AKIA|ASIA|AIza|_live_|PRIVATE|(?:{_TITLE})\.?[ ][{_UPPER}]|(?:{_PHRASE})[ ]|(?i:{"|".join(sorted(_FIRST))})[ ](?:[{_UPPER}]\.[ ])?[{_UPPER}]|先生|女士|小姐|さん|様|氏|씨|我叫|名前は|이름은|::"
_ENTITY = re.compile(
    rf"""(?:(?<!\w)|(?=[\W\d一-鿿가-힣]))(?:  # nothing starts inside of a word
    (?P<email>(?<![\w.%+-])[\w.%+-]{{1,64}}@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{{2,}})
    |(?P<key>(?<![\w-])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{{20,}}|github_pat_[0-9A-Za-z_]{{22,}}|xox[abprs]-[0-9A-Za-z-]{{10,}}|AIza[0-9A-Za-z_-]{{35}}|[sr]k_live_[0-9A-Za-z]{{16,}}))
    |(?P<jwt>(?<![\w-])eyJ[\w-]{{8,}}\.[\w-]{{8,}}\.[\w-]*)
    |(?:-----BEGIN[ ][A-Z ]*PRIVATE[ ]KEY-----\s)(?P<block>[A-Za-z0-9+/=\s]{{16,}})(?=-----END)
    |(?:(?i:\bbearer[ ]))(?P<bearer>[A-Za-z0-9_\-.~+/]{{16,}}=*)
    |(?:(?i:\b\w*?(?:{_KEYWORD})\b["']?\s*[=:]\s*["']?))(?P<secret>[A-Za-z0-9_\-.~+/!$%^&*]{{8,}}=*)
    |(?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
    |(?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
    |(?P<ip>(?<![\d.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\d|\.\d))
    |(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}}|::(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{1,4}}:){{2,7}}:)(?![\w:]))
    |(?P<card>(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){{12,18}}(?![ -]?\d))
    |(?P<phone>(?<![\w+])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,4}}){{2,4}}|\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]\d{{3,4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}}|[2-9]\d\d[2-9]\d{{6}})(?![\d\w]))
    |(?:(?i:\b(?:phone|tel|mobile|cell|fax|call|telefon|téléphone|teléfono|тел|τηλ)\b[.:]*[ ]?))(?P<dialled>\d(?:[ .-]?\d){{6,14}}(?![\d\w]))
    |(?P<name>\b(?:{_TITLE})\b\.?[ ](?P<given>{_OTHER})(?:[ ](?:[{_UPPER}]\.[ ])?(?P<family>{_OTHER}))?)
    |(?P<said>(?:{_PHRASE.replace(" ", "[ ]")})[ ](?P<given2>{_OTHER})(?:[ ](?:[{_UPPER}]\.[ ])?(?P<family2>{_OTHER}))?)
    |(?P<pair>\b(?P<given3>{_NAME})[ ](?:[{_UPPER}]\.[ ])?(?P<family3>{_OTHER}))
    |(?:我叫|姓名：|姓名:)(?P<han1>[{_HAN}][一-鿿]{{1,2}}?(?=[，。、,. ]|$)|[{_HAN}][一-鿿]{{1,2}})|(?P<han2>[{_HAN}][一-鿿]{{1,2}})(?=先生|女士|小姐)|(?P<han3>(?<![一-鿿])[一-鿿]{{2,4}})(?=さん|様|氏)|名前は(?P<han4>[一-鿿]{{2,4}})
    |(?:이름은[ ])(?P<hangul1>[{_HANGUL}][가-힣]{{2}})|(?P<hangul2>(?<![가-힣])[{_HANGUL}][가-힣]{{1,2}})(?=[ ]?씨))""",
    re.X,
)
_KINDS = {"dialled": "phone", "bearer": "secret", "block": "secret", **{f"han{i}": "east" for i in range(1, 5)}, "hangul1": "east", "hangul2": "east"}
_NAMED = {"name": "", "said": "2", "pair": "3"}
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|AIza|[sr]k_live_|eyJ")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c else c


def _class(c: str) -> tuple | None:
    kind, name = unicodedata.category(c), unicodedata.name(c, "")
    return (kind, name.split(" ")[0], "WITH" in name) if kind == "Lo" or kind == "Ll" and _lower(c.upper()) == c else None


@lru_cache(1 << 14)
def alphabet(c: str, spoken: bool = False) -> str:
    """The characters that a lower-case ``c`` may become: digits or letters of its script, ``c`` among them; ``spoken``: vowels apart."""
    if unicodedata.category(c) == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    for letters in _LETTERS:
        if c in letters:
            vowels = next((v for v in _VOWELS if v[0] in letters), "") if spoken else ""
            return "".join(x for x in letters if (x in vowels) == (c in vowels))
    if (kind := _class(c)) is None:
        return c
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if _class(x) == kind and not any(x in letters for letters in _LETTERS))


class Surrogates:
    """Keyed surrogates; the same key gives the same ones anywhere."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key).digest()

    def _mask(self, bits: int, *what: object) -> int:
        out, got, i = 0, 0, 0
        while got < bits:
            out = out << 512 | int.from_bytes(hashlib.blake2b(repr((i, *what)).encode(), key=self.key).digest(), "big")
            got, i = got + 512, i + 1
        return out & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: object, back: bool = False) -> int:
        """A permutation of 0..n-1, or its inverse: a Feistel network over the next even number of bits, walked until it lands inside."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for i in range(8):
                if back:
                    a, b = b ^ self._mask(half, tweak, n, 7 - i, a), a
                else:
                    a, b = b, a ^ self._mask(half, tweak, n, i, b)
            x = a << half | b
            if x < n:
                return x

    def step(self, x: int, n: int, tweak: object) -> int:
        """The next of 0..n-1 in a keyed order that is one cycle through all."""
        return self.permute((self.permute(x, n, tweak) + 1) % n, n, tweak, True)

    def shape(self, s: str, tweak: object, fixed: Callable[[int], bool] = lambda i: False, loose: bool = False, spoken: bool = False, bad: Callable[[str], bool] = lambda x: False) -> str:
        """The next string of the shape of ``s`` that isn't ``bad``; ``loose``: whatever separates its letters and digits."""
        low = [_lower(c) for c in s]
        hexed = not spoken and all("a" <= c <= "f" or "0" <= c <= "9" or not c.isalnum() or fixed(i) for i, c in enumerate(low)) and any("0" <= c <= "9" for i, c in enumerate(low) if not fixed(i))
        sets = [c if fixed(i) else "abcdef" if hexed and "a" <= c <= "f" else alphabet(c, spoken) for i, c in enumerate(low)]
        free = [(i, letters) for i, letters in enumerate(sets) if len(letters) > 1]
        kept = tuple(x for x in sets if not loose or x[0].isalnum())
        x, n = 0, 1
        for i, letters in free:
            x, n = x * len(letters) + letters.index(low[i]), n * len(letters)
        if n == 1:  # nothing that an alphabet has; such values are spelled by a keyed hash
            return "".join(chr(97 + self._mask(16, tweak, s, i) % 26) if c.isalnum() and not fixed(i) else c for i, c in enumerate(s))
        while True:
            x = y = self.step(x, n, (tweak, kept))
            out = list(s)
            for i, letters in reversed(free):
                y, r = divmod(y, len(letters))
                out[i] = letters[r].upper() if s[i] != low[i] else letters[r]
            if not bad(found := "".join(out)):
                return found

    def email(self, s: str) -> str:
        top = s.rindex(".")
        return self.shape(s, "email", lambda i: i >= top)

    def secret(self, s: str) -> str:
        return self.shape(s, "secret")

    def key_(self, s: str) -> str:
        n = len(m[0]) if (m := _PREFIX.match(s)) else 0
        return self.shape(s, "key", lambda i: i < n)

    def ssn(self, s: str) -> str:
        return self.shape(s, "ssn", loose=True)

    def ip6(self, s: str) -> str:
        return self.shape(s, "ip6")

    def phone(self, s: str) -> str:
        code = len(m[0]) if (m := re.match(r"\+\d{1,3}(?=\D)|\+\d", s)) else 0
        return self.shape(s, "phone", lambda i: i < code, True)

    def ip(self, s: str) -> str:
        """Another address of the same special network, or of none."""
        at = ipaddress.ip_address(".".join(str(int(x)) for x in s.split(".")))
        for net in _NETWORKS:
            if at in net:
                return str(net[self.step(int(at) - int(net[0]), net.num_addresses, ("ip", str(net)))])
        x = int(at)
        while True:
            x = self.step(x, 1 << 32, "ip")
            if not any(ipaddress.ip_address(x) in net for net in _NETWORKS):
                return str(ipaddress.ip_address(x))

    def card(self, s: str) -> str:
        digits = [i for i, c in enumerate(s) if c.isdigit()]
        out = self.shape(s, "card", lambda i: i in (digits[0], digits[-1]), True)
        return next(x for x in (out[: digits[-1]] + d for d in "0123456789") if luhn("".join(c for c in x if c.isdigit())))

    def iban(self, s: str) -> str:
        out = self.shape(s, "iban", lambda i: i < 4, True)
        check = 98 - _mod97(out[:2] + "00" + out[4:].replace(" ", ""))
        return f"{out[:2]}{check:02d}{out[4:]}"

    def name(self, s: str) -> str:
        """Another name of the gender and script, in the case of ``s``."""
        if pool := _POOL.get(s.casefold()):
            at = [x.casefold() for x in pool].index(s.casefold())
            x = pool[self.step(at, len(pool), ("listed", pool[0]))]
            return x.upper() if len(s) > 1 and s.isupper() else x
        low = s.lower()
        keep = len(s) - next((len(e) for e in _ENDINGS if low.endswith(e) and len(s) > len(e) + 1), 0)
        return self.shape(s, "name", lambda i: i >= keep, spoken=True, bad=lambda x: x.casefold() in _POOL)

    def east(self, s: str) -> str:
        """A Chinese, Japanese or Korean name: a listed surname becomes another one."""
        for names in (_HAN, _HANGUL):
            if s[0] in names:
                return names[self.step(names.index(s[0]), len(names), ("surname", names[0]))] + self.shape(s[1:], "east")
        return self.shape(s, "east", bad=lambda x: x[0] in _HAN + _HANGUL)

    def of(self, kind: str, s: str) -> str:
        if kind in ("key", "jwt"):
            return self.key_(s)
        return getattr(self, "name" if kind in ("given", "family") else kind)(s)


def _valid(kind: str, s: str) -> bool:
    digits = "".join(c for c in s if c.isdigit())
    if kind == "card":
        return luhn(digits)
    if kind == "iban":
        return _mod97(s.replace(" ", "")) == 1
    if kind == "ip":
        return all(int(x) < 256 for x in s.split("."))
    if kind == "ip6":
        try:
            return int(ipaddress.ip_address(s)) > 1 and len(s) > 6 and any(c.isdigit() for c in s)
        except ValueError:
            return False
    if kind == "secret":
        return any(c.isalnum() for c in s) and (len(digits) > 0 or len(s) >= 12)
    return kind != "phone" or 7 <= len(digits) <= 15


class Document:
    """The entities of one text and their surrogates."""

    def __init__(self, text: str, make: Surrogates) -> None:
        self.make, self.text = make, text
        self.found: list[tuple[int, int, str, str]] = []
        at = 0
        while m := _ENTITY.search(text, at):
            group = m.lastgroup
            if (number := _NAMED.get(group)) is None:
                kind = _KINDS.get(group, group)
                at = m.end()
                if _valid(kind, m[group]):
                    self.found.append((*m.span(group), kind, m[group]))
                else:
                    at = m.start() + 1
                continue
            given, family = f"given{number}", f"family{number}"
            if group == "pair" and m[given].casefold() not in _FIRST:
                at = m.end(given)
                continue
            at = m.end()
            only = m[family] is None and group == "name"
            for part in (given, family):
                if m[part]:
                    self.found.append((*m.span(part), "family" if only or part == family else "given", m[part]))
        self._mentions()

    def _mentions(self) -> None:
        names = {s.casefold(): kind for *_, kind, s in self.found if kind in ("given", "family") and len(s) > 1}
        if not names:
            return
        taken = sorted((a, b) for a, b, *_ in self.found)
        words = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b", re.I)
        i = 0
        for m in words.finditer(self.text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if (i == len(taken) or m.end() <= taken[i][0]) and m[0][0].isupper() and m[0].casefold() in names:
                self.found.append((*m.span(), names[m[0].casefold()], m[0]))

    def replaced(self) -> tuple[str, int]:
        out, at = [], 0
        for a, b, kind, s in sorted(self.found):
            out += [self.text[at:a], self.make.of(kind, s)]
            at = b
        return "".join([*out, self.text[at:]]), len(self.found)


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, entities) for each row: the text with surrogates, and how many places were replaced."""
    make = Surrogates(key)
    schema = T.StructType([T.StructField("doc_id", id_type(docs, doc_id)), T.StructField("text", T.StringType()), T.StructField("entities", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(1)
        hint = pc.fill_null(pc.match_substring_regex(column, _HINT), False)
        changed, counts = [], []
        for t in column.filter(hint).to_pylist():
            t, n = Document(t, make).replaced()
            changed.append(t)
            counts.append(n)
        texts = pc.replace_with_mask(column, hint, pa.array(changed, column.type))
        n = pc.replace_with_mask(pa.nulls(len(column), pa.int64()).fill_null(0), hint, pa.array(counts, pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), texts, n], schema.names)

    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", schema, run)
