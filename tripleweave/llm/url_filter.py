"""URL filtering: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

All terms are found in one pass over the lower-cased host and path. A term counts only between
boundaries: the characters beside it are not letters or digits. One strict term rejects; so do
two or more distinct soft terms (whose weights, each once, reach a limit that a caller may raise). An allow or block rule that fits the url
decides before the vocabulary.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed. Repeated rows are judged each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleweave.llm.textmap import unused, with_text_columns

#: Fixed by the query's contract, in its order.
CONTRACT_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: A strict term rejects alone. Both lists are defaults; ``vocabulary`` reads others from a table.
STRICT = (
    "porn", "porno", "pornography", "xxx", "hardcore", "hentai", "escort", "escorts", "camgirl", "camgirls", "upskirt", "milf", "bdsm", "casino", "casinos", "sportsbook",
    "viagra", "cialis", "levitra", "malware", "phishing", "keygen", "warez", "botnet", "cryptojacking",
)
#: Soft terms and their weights.
SOFT = {
    "adult": 2, "ads": 1, "affiliate": 1, "bet": 1, "bets": 1, "betting": 2, "bingo": 2, "bonus": 1, "cash": 1, "cheap": 1, "click": 1, "clickbait": 2, "coupon": 1, "coupons": 1, "crack": 1,
    "credit": 1, "dating": 1, "deal": 1, "deals": 1, "diet": 1, "discount": 1, "erotic": 2, "farm": 1, "forex": 1, "free": 1, "gamble": 2, "gambling": 2, "giveaway": 1, "hookup": 2, "jackpot": 2,
    "loan": 1, "loans": 1, "lottery": 2, "lotto": 2, "miracle": 1, "mortgage": 1, "naked": 2, "nude": 2, "payday": 2, "pharma": 1, "pills": 2, "poker": 2, "popup": 1, "prize": 1, "prizes": 1,
    "proxy": 1, "referral": 1, "replica": 1, "roulette": 2, "scam": 1, "sex": 2, "sexy": 2, "slot": 1, "slots": 2, "spam": 2, "spins": 1, "torrent": 2, "torrents": 2, "track": 1, "tracker": 1,
    "weightloss": 1, "win": 1, "winner": 1, "winners": 1,
}
#: Terms that a vocabulary may have: it is held by each worker.
MAX_TERMS = 1_000_000
#: Any two distinct soft terms reach it.
SOFT_LIMIT = 2
_EDGE = re.compile(r"[^\W_]")


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path: it fits that host and all its subdomains, where the url's path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        a, slash, b = self.text.partition("/")
        return slash + b


class Rules:
    """Finds the longest rule that fits, looking only at the rules of the url's own host and parent domains."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.of: dict[str, list[Rule]] = {}
        for r in sorted((Rule(*x) for x in rules), key=lambda r: (-len(r.text), r.text)):
            self.of.setdefault(r.host, []).append(r)

    def fitting(self, host: str, path: str) -> Rule | None:
        best, labels = None, host
        while True:
            r = next((r for r in self.of.get(labels, ()) if path.startswith(r.path)), None)
            if r is not None and (best is None or len(r.text) > len(best.text)):
                best = r
            labels, dot, rest = labels.partition(".")
            if not dot:
                return best
            labels = rest


class Vocabulary:
    def __init__(self, strict: Sequence[str] = STRICT, soft: dict[str, int] = SOFT, limit: int = SOFT_LIMIT):
        import ahocorasick

        self.limit, self.automaton = limit, ahocorasick.Automaton()
        for term, weight in {**soft, **dict.fromkeys(strict, 0)}.items():
            self.automaton.add_word(term, (term, weight))
        self.automaton.make_automaton()

    def count(self, text: str) -> tuple[int, dict[str, int]]:
        """How often strict terms occur, and the distinct soft terms with their weights."""
        strict, soft = 0, {}
        for end, (term, weight) in self.automaton.iter(text):
            a, b = end - len(term), end + 1
            if (a < 0 or not _EDGE.match(text[a])) and (b == len(text) or not _EDGE.match(text[b])):
                if weight:
                    soft[term] = weight
                else:
                    strict += 1
        return strict, soft

    def rejects(self, strict: int, soft: dict[str, int]) -> bool:
        return strict > 0 or (len(soft) > 1 and sum(soft.values()) >= self.limit)


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, int]]:
    """The strict and soft terms of a table (term, weight): a null weight is strict. Terms are lower-cased; empty ones and repeats go, of several weights the largest stays, strict before all."""
    term = F.lower(F.trim("term"))
    sums = terms.where(term != "").groupBy(term.alias("term")).agg(F.max(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight"))
    rows = sorted(sums.limit(MAX_TERMS + 1).collect())
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary has {MAX_TERMS} terms at most")
    return tuple(r.term for r in rows if r.strict), {r.term: int(r.weight) for r in rows if not r.strict and r.weight > 0}


_LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    return rest[:end].translate(_LOWER), re.split(r"[?#]", rest[end:], maxsplit=1)[0]


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = CONTRACT_RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), strict: Sequence[str] = STRICT, soft: dict[str, int] = SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """The kept columns, ``host``, ``path``, ``rule``, ``verdict``, ``n_strict``, ``soft_terms`` and ``soft_weight``. Only the url column is read besides those kept; nothing is shuffled."""
    rules = tuple(rules)
    made: list = []

    def kernel(texts: list[bytes | None]) -> list:
        if not made:
            made.extend((Rules(rules), Vocabulary(strict, soft, limit)))
        book, words = made
        rows = []
        for t in texts:
            host, path = parts(t.decode("utf-8", "replace") if t is not None else None)
            rule = book.fitting(host, path) if host or path else None
            n, found = words.count((host + path).lower())
            verdict = rule.verdict if rule else "block" if words.rejects(n, found) else "allow"
            rows.append((host, path, rule.text if rule else None, verdict, n, sorted(found), sum(found.values())))
        return [list(x) for x in zip(*rows)]

    kinds = (("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType()), ("n_strict", T.LongType()), ("soft_terms", T.ArrayType(T.StringType())), ("soft_weight", T.LongType()))
    return with_text_columns(pages, url, keep, [T.StructField(unused(keep, n), k) for n, k in kinds], kernel)


def allowed(pages: DataFrame, **options) -> DataFrame:
    """The rows, with all their columns, whose verdict is allow."""
    out = judged(pages, keep=tuple(pages.columns), **options)
    return out.where(out[unused(pages.columns, "verdict")] == "allow").select(*pages.columns)
