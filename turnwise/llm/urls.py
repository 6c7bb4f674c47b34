"""URL filters: rules per host and path, and a weighted vocabulary found by one Aho-Corasick pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_OUT = 4096


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for ``host`` and its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that are always applied.
BASE_RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
# Strict terms reject alone. Soft terms reject if ``SOFT_TERMS`` different ones occur whose weights reach ``LIMIT``.
STRICT = ("casino", "hentai", "jackpot", "nsfw", "porn", "sportsbook", "viagra", "warez", "xxx")
SOFT = {
    "adult": 3, "ads": 2, "bet": 2, "bets": 3, "bonus": 1, "cam": 2, "cams": 2, "cheap": 2, "crack": 2, "dating": 2,
    "escort": 3, "farm": 1, "free": 1, "girls": 2, "keygen": 3, "loan": 2, "loans": 2, "nude": 3, "payday": 2, "pharmacy": 2,
    "pills": 3, "poker": 3, "replica": 2, "sex": 3, "sexy": 2, "slots": 3, "spam": 3, "torrent": 3, "track": 2, "win": 1, "x": 1,
}
LIMIT, SOFT_TERMS = 4, 2
SCHEMA = (
    "page_id long, host string, path string, rule string, verdict string, "
    "n_strict long, n_soft long, n_soft_terms long, soft_weight long, terms string"
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def scanned_text(url: Column) -> Column:
    """The lower-cased url in which every percent escape is a blank."""
    return F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "%[0-9a-f]{2}", " ")


def _in_word(char: str) -> bool:
    return char >= "\x80" or "a" <= char <= "z" or "0" <= char <= "9"


@dataclass(frozen=True)
class Hits:
    n_strict: int
    n_soft: int
    soft: tuple[str, ...]
    weight: int
    strict: tuple[str, ...]

    def rejected(self, limit: int, soft_terms: int) -> bool:
        return self.n_strict > 0 or (len(self.soft) >= soft_terms and self.weight >= limit)


class Vocabulary:
    """Strict and soft terms in one automaton; a hit counts where no letter or digit goes on at either end."""

    def __init__(self, strict: Sequence[str], soft: dict[str, int]):
        self.soft = soft
        self.machine = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.machine.add_word(term, (term, term in strict))
        self.machine.make_automaton()

    def hits(self, text: str) -> Hits:
        strict, soft = [], []
        for last, (term, is_strict) in self.machine.iter(text):
            first = last + 1 - len(term)
            before, after = text[first - 1 : first] if first else "", text[last + 1 : last + 2]
            if not (before and _in_word(before)) and not (after and _in_word(after)):
                (strict if is_strict else soft).append(term)
        distinct = tuple(sorted(set(soft)))
        return Hits(len(strict), len(soft), distinct, sum(self.soft[t] for t in distinct), tuple(sorted(set(strict))))


class Rules:
    """Rules by host; the longest that fits a url wins, and of equal ones the first given."""

    def __init__(self, rules: Sequence[UrlRule]):
        self.by_host: dict[str, list[UrlRule]] = {}
        for rule in sorted(rules, key=lambda r: -len(r.path)):
            self.by_host.setdefault(rule.host, []).append(rule)

    def fitting(self, host: str, path: str) -> UrlRule | None:
        best, at = None, 0
        while at >= 0:
            own = next((r for r in self.by_host.get(host[at:], ()) if path.startswith(r.path)), None)
            if own and (best is None or len(own.name) > len(best.name)):
                best = own
            at = host.find(".", at) + 1 or -1
        return best


@cache
def _tools(rules: tuple[UrlRule, ...], strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> tuple[Rules, Vocabulary]:
    return Rules(rules), Vocabulary(strict, dict(soft))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule] = BASE_RULES,
    strict: Sequence[str] = STRICT,
    soft: dict[str, int] | None = None,
    limit: int = LIMIT,
    soft_terms: int = SOFT_TERMS,
) -> DataFrame:
    """A verdict on the ``url`` of every row of ``pages``.

    The longest rule that fits decides. Without one the vocabulary does: every term is looked for in the
    whole lower-cased url (percent escapes are blanks) by one Aho-Corasick pass, a hit has to end at
    word edges, and a url is blocked for one strict hit, or for ``soft_terms`` different soft terms whose
    weights add up to ``limit``.

    Result: one row per row of ``pages``, repeated rows included: page_id as it is (also null), host,
    path, rule (null if none fits), verdict (``block`` or ``allow``), the places of strict and of soft
    terms, the number and weight of different soft terms, and all different terms joined by commas. A
    null url, and one without ``://``, has an empty host and path and so fits no rule; a null url is
    allowed. Ties between equally long rules go to the first given. Other columns are not read; an empty
    table gives an empty result. Nothing is shuffled; a task holds one Arrow batch, the rules and the terms.
    """
    fixed = tuple(rules), tuple(strict), tuple((SOFT if soft is None else soft).items())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, vocabulary = _tools(*fixed)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                part = whole.slice(at, ROWS_OUT)
                hosts, paths, texts = (part.column(i).to_pylist() for i in (1, 2, 3))
                fits = [chosen.fitting(h, p) for h, p in zip(hosts, paths)]
                found = [vocabulary.hits(t) for t in texts]
                verdicts = [
                    r.verdict if r else "block" if h.rejected(limit, soft_terms) else "allow" for r, h in zip(fits, found)
                ]
                counts = [(h.n_strict, h.n_soft, len(h.soft), h.weight) for h in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array([r and r.name for r in fits], pa.string()),
                        pa.array(verdicts, pa.string()),
                        *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)),
                        pa.array([",".join(sorted(h.strict + h.soft)) for h in found], pa.string()),
                    ],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    url = F.col("url").cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        scanned_text(url).alias("scanned"),
    )
    return rows.mapInArrow(judge, SCHEMA)
