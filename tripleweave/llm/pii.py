"""Personal data replaced by keyed surrogates.

Detected entities: e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, account and card
numbers, IBANs, secret tokens in hexadecimal, keys with a vendor's prefix, and names: after a title, or a
common given name with a family name. A surrogate is a keyed permutation of all strings of the entity's
own format: letters stay letters of their script and case, vowels vowels, digits digits, separators
stay. What makes a format valid stays too: a card's check digit fits (or is as far off as it was), an
IBAN keeps its country and gets its check digits, an address stays in its private block or public, a
vendor's prefix stays. A title stays, and a name's last letter, so gender markers agree. Since each
format is permuted, two different entities never share a surrogate (distinctness) and one entity has the
same one everywhere (coreference), without a table of all entities. Names are replaced word by word, so
"Ann Smith" and "Smith" still agree.

The collision check finds surrogates that are somebody's real data: all distinct entities of all
documents (of names, their words) are joined with their surrogates, and each entity found draws anew,
with another key, until its surrogate is nobody's data and nobody else's surrogate. A format may be
full: after every ATTEMPTS draws the surrogate gets one character more, so every entity finds one and
none keeps real data. These exceptions are broadcast up to MAX_EXCEPTIONS; beyond, they are joined with
the entities of each text, with the same result.

Defined cases: a null text stays null and has no entity. Overlapping finds go to the one that starts
first, then to the longer. Repeated rows are treated alike. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tripleweave.llm.scratch import dropped, written
from tripleweave.llm.sieve import bitmap, place_of, sifted
from tripleweave.llm.textmap import arrow_map, pieces, unused, with_text_columns

KEY = b"replace this key in production"
MAX_EXCEPTIONS, ATTEMPTS = 200_000, 6

TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Sir", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mademoiselle", "Señor", "Señora", "Señorita", "Don", "Doña",
    "Господин", "Госпожа", "Κύριος", "Κυρία",
)
#: Given names that, before a capitalized word, make a person's name without a title.
GIVEN = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Matthew", "Anthony", "Steven", "Paul", "Andrew", "Kevin", "Brian", "George", "Peter",
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Lisa", "Nancy", "Margaret", "Emily", "Laura", "Rebecca", "Anna", "Emma",
    "Hans", "Jürgen", "Wolfgang", "Stefan", "Klaus", "Ursula", "Sabine", "Monika", "Petra", "Jean", "Pierre", "Michel", "Philippe", "Nicolas", "Nathalie", "Isabelle", "Sophie", "Camille",
    "José", "Juan", "Carlos", "Luis", "Javier", "María", "Carmen", "Isabel", "Lucía", "Elena", "Иван", "Сергей", "Дмитрий", "Анна", "Мария", "Ольга", "Γιώργος", "Νίκος", "Ελένη",
)
#: How a vendor's key begins; what follows is secret.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "sk_live_", "sk_test_", "pk_live_", "sk-", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "xoxb-", "xoxp-", "xoxa-", "glpat-", "npm_")
_NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
_PATTERNS = (
    ("email", "@", re.compile(r"[^\W_][\w.+-]*@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,}")),
    ("secret", None, re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")),
    ("ipv4", ".", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)", re.ASCII)),
    ("phone", None, re.compile(r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)(?<!\d[ .-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![ .-]?\d)(?!\w)", re.ASCII)),
    ("number", None, re.compile(r"(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{3}-\d{2}-\d{4})(?!\w)", re.ASCII)),
)
_KEY = re.compile(rf"(?<![0-9A-Za-z_-])({'|'.join(map(re.escape, KEY_PREFIXES))})(?=[\w-]*\d)[\w-]{{16,}}", re.ASCII)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)", re.ASCII)
_GIVEN = frozenset(GIVEN)
_UNTITLED = re.compile(rf"(?<!\w)(?:{'|'.join(GIVEN)})(?: [^\W\d_]\.)?(?: {_NAME}){{1,2}}")
_TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? ")
_NAMED = re.compile(_NAME)
_DIGIT = re.compile(r"\d")

#: The alphabets within which characters are permuted. A character in none of them stays.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çðñýþßÿ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ", "ÇÐÑÝÞ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
_OF = {c: a for a in ALPHABETS for c in a}


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    text: str


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _is_ipv6(text: str) -> bool:
    """An address with some digits, no sequence of colons or a time of day."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(c != ":" for c in text) > 3


def found(text: str) -> list[Entity]:
    """The entities of a text, in order."""
    out = []
    digits = _DIGIT.search(text) is not None
    for kind, sign, pattern in _PATTERNS:
        if (digits or kind in ("email", "secret")) and (sign is None or sign in text):
            out += [Entity(kind, m.start(), m.end(), m.group()) for m in pattern.finditer(text)]
    if any(x in text for x in KEY_PREFIXES):
        out += [Entity("key", m.start(), m.end(), m.group()) for m in _KEY.finditer(text)]
    if digits:
        out += [Entity("iban", m.start(), m.end(), m.group()) for m in _IBAN.finditer(text) if _iban_rest(m.group().replace(" ", "")) == 1]
    if text.count(":") > 1:
        out += [Entity("ipv6", m.start(), m.end(), m.group()) for m in _IPV6.finditer(text) if _is_ipv6(m.group())]
    if not _GIVEN.isdisjoint(text.split()):
        for m in _UNTITLED.finditer(text):
            words = m.group().split(" ")
            while len(words) > 1 and not words[-1][0].isupper():
                words.pop()
            if len(words) > 1 and words[-1][-1] != ".":
                whole = " ".join(words)
                out.append(Entity("person", m.start(), m.start() + len(whole), whole))
    if any(t in text for t in TITLES):
        for m in _TITLE.finditer(text):
            start = at = m.end()
            for _ in range(3):
                name = _NAMED.match(text, at + (at > start))
                if not name or not name.group()[0].isupper() or name.group() in TITLES or (at > start and text[at] != " "):
                    break
                at = name.end()
            if at > start:
                out.append(Entity("person", start, at, text[start:at]))
    out.sort(key=lambda e: (e.start, -e.end))
    kept: list[Entity] = []
    for e in out:
        if not kept or e.start >= kept[-1].end:
            kept.append(e)
    return kept


def permuted(number: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network of eight rounds, walked until it is within."""
    if size < 2:
        return number
    half = -(-(size - 1).bit_length() // 2)
    width, low = -(-half // 8), (1 << half) - 1
    while True:
        a, b = number >> half, number & low
        for r in range(8):
            mac = hmac.digest(key, f"{tweak}|{size}|{r}|".encode() + b.to_bytes(width, "big"), "sha256")
            while len(mac) < width:
                mac += hashlib.sha256(mac).digest()
            a, b = b, a ^ (int.from_bytes(mac[:width], "big") & low)
        number = a << half | b
        if number < size:
            return number


def _permuted_text(text: str, key: bytes, tweak: str, alphabets: dict[str, str] = _OF) -> str:
    number, size, radix = 0, 1, []
    for c in text:
        a = alphabets.get(c)
        if a:
            number, size = number * len(a) + a.index(c), size * len(a)
        radix.append(a)
    number, out = permuted(number, size, key, tweak + "|" + "".join("-" if a is None else chr(33 + ALPHABETS.index(a)) if a in ALPHABETS else "h" for a in radix)), []
    for c, a in zip(reversed(text), reversed(radix)):
        if a:
            number, i = divmod(number, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


_HEX_LOW = dict.fromkeys("0123456789abcdef", "0123456789abcdef")
_HEX_UP = dict.fromkeys("0123456789ABCDEF", "0123456789ABCDEF")


#: Blocks of addresses that stay themselves: first address and bits that vary.
BLOCKS = ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24), (169 << 24 | 254 << 16, 16))


def _ipv4(text: str, key: bytes) -> str:
    a, b, c, d = map(int, text.split("."))
    n = a << 24 | b << 16 | c << 8 | d
    block = lambda n: next(((first, bits) for first, bits in BLOCKS if n >> bits == first >> bits), None)
    own = block(n)
    if own:
        n = own[0] | permuted(n - own[0], 1 << own[1], key, "ipv4")
    else:
        n = permuted(n, 1 << 32, key, "ipv4")
        while block(n):
            n = permuted(n, 1 << 32, key, "ipv4")
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def luhn_rest(digits: list[int]) -> int:
    """0 if the last digit is the check digit of those before."""
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(digits))) % 10


def _number(text: str, key: bytes) -> str:
    at = [i for i, c in enumerate(text) if c in "0123456789"]
    if len(at) < 13:
        return _permuted_text(text, key, "number")
    rest = luhn_rest([int(text[i]) for i in at])
    made = list(_permuted_text(text[: at[-1]], key, f"number|{rest}") + "0" + text[at[-1] + 1 :])
    made[at[-1]] = str((rest - luhn_rest([int(made[i]) for i in at])) % 10)
    return "".join(made)


def _iban(text: str, key: bytes) -> str:
    rest = _permuted_text(text[4:], key, f"iban|{text[:2]}")
    return f"{text[:2]}{98 - _iban_rest(text[:2] + '00' + rest.replace(' ', '')):02d}{rest}"


def _made(kind: str, text: str, key: bytes) -> str:
    if kind == "ipv4":
        return _ipv4(text, key)
    if kind == "number":
        return _number(text, key)
    if kind == "iban":
        return _iban(text, key)
    if kind in ("secret", "ipv6"):
        return _permuted_text(text, key, kind, _HEX_UP if text.upper() == text else _HEX_LOW)
    if kind == "key":
        prefix = next(x for x in KEY_PREFIXES if text.startswith(x))
        return prefix + _permuted_text(text[len(prefix) :], key, f"{kind}|{prefix}")
    if kind == "email":
        local, _, domain = text.partition("@")
        labels, dot, top = domain.rpartition(".")
        return f"{_permuted_text(local, key, kind)}@{_permuted_text(labels, key, 'domain')}{dot}{top}"
    if kind == "person":
        return _permuted_text(text[:-1], key, kind) + text[-1] if len(text) > 2 else _permuted_text(text, key, kind)
    return _permuted_text(text, key, kind)


def _longer(kind: str, text: str, more: int) -> str:
    """The text with ``more`` characters of its own sort put in, for formats that are full. Addresses and card numbers have one length, which isn't full."""
    if not more or kind in ("ipv4", "ipv6", "iban") or (kind == "number" and sum(c.isdigit() for c in text) > 12):
        return text
    at = next((i for i in range(1, len(text)) if text[i] in _OF and text[i].islower()), None)
    at = next((i for i, c in enumerate(text) if c in _OF), 0) if at is None else at
    alphabet = _OF.get(text[at] if text else "", "0123456789")
    return text[: at + 1] + alphabet[0] * more + text[at + 1 :]


def surrogate(kind: str, text: str, key: bytes = KEY, more: int = 0) -> str:
    """The surrogate of an entity, with ``more`` characters more than it has; of a name, word by word."""
    if kind == "person" and " " in text:
        return " ".join(surrogate(kind, w, key, more) for w in text.split(" "))
    return _made(kind, _longer(kind, text, more), key)


def units(e: Entity) -> list[str]:
    """What of an entity is replaced on its own: the words of a name, else the whole."""
    return e.text.split(" ") if e.kind == "person" else [e.text]


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind``, ``original``: each distinct entity of all documents once; of names, each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch, 0):
                got = sorted({(e.kind, u) for t in texts if t for e in found(t.decode("utf-8", "replace")) for u in units(e)})
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.string()) for i in (0, 1)], names=["kind", "original"])

    return arrow_map(docs.select(docs[text].cast("string")), run, "kind string, original string").distinct()


def _with_surrogates(df: DataFrame, key: bytes, more: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, x, key, more) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["kind", "original", "surrogate"])

    dealt = df.select("kind", "original").repartition(df.sparkSession.sparkContext.defaultParallelism, "original")
    return arrow_map(dealt, run, "kind string, original string, surrogate string")


def exceptions(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """The collision check: ``kind``, ``original``, ``surrogate`` of the entities whose surrogate is somebody's real data, with the ones that they get instead.

    Each round draws with another key for those still open, until none is. A draw is taken if it is
    nobody's real data, nobody's first surrogate and no other's draw.
    """
    every = written(entities(docs, text), "entities")
    first = written(_with_surrogates(every, key), "surrogates")
    real = every.select("kind", F.col("original").alias("surrogate"))
    open_ = written(first.join(real.hint("merge"), ["kind", "surrogate"], "left_semi").select("kind", "original"), "open")
    taken, out = real.union(first.select("kind", "surrogate")), first.select("kind", "original", "surrogate").limit(0)
    attempt = 0
    while not open_.isEmpty():
        attempt += 1
        drawn = written(_with_surrogates(open_, key + b"|%d" % attempt, attempt // ATTEMPTS), "drawn")
        good = drawn.join(taken.hint("merge"), ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("original").alias("original"))
        good = written(good, "good").select("kind", "original", "surrogate")
        out = out.union(good)
        taken = taken.union(good.select("kind", "surrogate"))
        open_ = written(open_.join(good.hint("merge"), ["kind", "original"], "left_anti"), "open")
    out = written(out, "exceptions")
    dropped(every, first)
    return out


def replaced(text: str, key: bytes = KEY, walked: dict[tuple[str, str], str] | None = None) -> tuple[str, list[Entity]]:
    got, out, at = found(text), [], 0
    for e in got:
        out += [text[at : e.start], " ".join((walked or {}).get((e.kind, u)) or surrogate(e.kind, u, key) for u in units(e))]
        at = e.end
    return "".join([*out, text[at:]]), got


def _rows(texts: list[bytes | None], key: bytes, walked: Iterable[dict[tuple[str, str], str]]) -> list:
    rows = [replaced(t.decode("utf-8", "replace"), key, w) if t is not None else (None, []) for t, w in zip(texts, walked)]
    return [[x for x, _ in rows], [len(e) for _, e in rows], [[x.kind for x in e] for _, e in rows]]


def pseudonymized(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), key: bytes = KEY) -> DataFrame:
    """The kept columns, the text with surrogates, ``n_entities`` and ``kinds`` (of each entity, in order)."""
    fields = [T.StructField(unused(keep, n), k) for n, k in (("text", T.StringType()), ("n_entities", T.LongType()), ("kinds", T.ArrayType(T.StringType())))]
    found_out = exceptions(docs, text, key)
    if found_out.count() > MAX_EXCEPTIONS:
        return _joined(docs, text, keep, key, fields, found_out)
    sent = docs.sparkSession.sparkContext.broadcast({(r.kind, r.original): r.surrogate for r in found_out.collect()})
    return with_text_columns(docs, text, keep, fields, lambda texts: _rows(texts, key, repeat(sent.value)))


def _joined(docs: DataFrame, text: str, keep: tuple[str, ...], key: bytes, fields: list[T.StructField], walked: DataFrame) -> DataFrame:
    """As :func:`pseudonymized`, for any number of exceptions: each text gets its own by a join.

    A text is found again by a 64-bit hash. Texts with the same hash get the exceptions of both, which
    changes nothing. Texts without exceptions aren't shuffled.
    """
    keep = tuple(keep)
    names = [f"__k{i}" for i in range(len(keep))]
    source = docs.select(docs[text].cast("string").alias("__text"), *[docs[c].alias(n) for c, n in zip(keep, names)]).withColumn("__place", F.xxhash64("__text"))

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, 0):
                got = sorted({(p, e.kind, u) for p, t in zip(part.column(1).to_pylist(), texts) if t for e in found(t.decode("utf-8", "replace")) for u in units(e)})
                kinds = (pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], k) for i, k in enumerate(kinds)], names=["place", "kind", "original"])

    occurs = arrow_map(source.select("__text", "__place"), occurring, "place long, kind string, original string")
    own = F.collect_set(F.struct("kind", "original", "surrogate")).alias("__walked")
    of = written(occurs.join(walked, ["kind", "original"]).groupBy("place").agg(own), "walked").withColumnRenamed("place", "__place")
    bits = bitmap(of, place_of(F.col("__place")))
    none = F.lit(None).cast(of.schema["__walked"].dataType).alias("__walked")
    columns = ["__text", "__walked", *names]
    given = sifted(source, "__place", bits, False).select("__text", none, *names).union(sifted(source, "__place", bits, True).join(of, "__place", "left").select(*columns))
    out = T.StructType([T.StructField(c, docs.schema[c].dataType, True) for c in keep] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, 0):
                own = ({(w["kind"], w["original"]): w["surrogate"] for w in ws or ()} for ws in part.column(1).to_pylist())
                made = [pa.array(x, k) for x, k in zip(_rows(texts, key, own), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *made], names=out.names)

    return arrow_map(given, run, out)
