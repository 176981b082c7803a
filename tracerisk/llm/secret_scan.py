"""Secret scans: Boolean trigram queries, an inverted index of each block of texts, verification."""

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracerisk.llm.common import with_columns

# Strings that a part of a pattern may stand for before it counts as open.
MOST_STRINGS, MOST_CHARS = 128, 16
SPANS = "array<struct<kind:string,start:int,end:int>>"
PLACEHOLDER = "[SECRET]"

# What follows the first line of a PEM key: all up to its END line, or, where that is missing before
# the next key, header lines and base64 (also quoted, indented, or with escaped line ends).
_GAP = r"""(?:[\s"'>,|#*+]|\\[nrt])"""
_WORD_END = r"""(?=[\s"'\\,]|\Z)"""
_LINE_END = r"""(?=[\x20\t\r,]*+(?:[\n"']|\\[nr]|\Z))"""
PEM_REST = (
    r"(?s:(?!-----BEGIN )(?!-----END ).)*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    rf"|(?:{_GAP}*+[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+)*+"
    rf"(?:(?:{_GAP}++[A-Za-z0-9+/=]{{16,}}+{_WORD_END})++(?:{_GAP}++[A-Za-z0-9+/=]++{_LINE_END})?"
    rf"|{_GAP}++[A-Za-z0-9+/=]++{_GAP}*+\Z)"
)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has `least` characters or more.

    Redaction also takes what `rest` matches right after a match.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    rest: str = ""

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


# Fixed values.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ignore_case=True,
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", rest=PEM_REST),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{24,}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,20}://[^\x09-\x0D\x20:/@]{1,200}:[^\x09-\x0D\x20/@]{1,200}@"),
)
RULES = BASE_RULES + MORE_RULES

# A trigram query: None holds for any text, a bytes object asks for that trigram,
# ("and" | "or", queries) combines.
Query = None | bytes | tuple


def _all_of(queries: Iterable[Query]) -> Query:
    found = tuple(dict.fromkeys(q for q in queries if q is not None))
    return None if not found else found[0] if len(found) == 1 else ("and", found)


def _any_of(queries: Iterable[Query]) -> Query:
    found = tuple(dict.fromkeys(queries))
    if not found or None in found:
        return None

    def needs(q: Query) -> set:
        return {q} if isinstance(q, bytes) or q[0] == "or" else set(q[1])

    # An alternative that asks for all that another does, and more, adds nothing.
    found = tuple(q for q in found if not any(needs(x) < needs(q) for x in found))
    return found[0] if len(found) == 1 else ("or", found)


def _holds(strings: Iterable[str]) -> Query:
    """A text with one of the strings has these trigrams; A-Z count as a-z."""

    def one(s: str) -> Query:
        b = s.encode("utf-8", "surrogatepass")
        b = b.lower()  # of bytes: A-Z only
        return _all_of(b[i : i + 3] for i in range(len(b) - 2)) if len(b) > 2 else None

    return _any_of(one(s) for s in sorted(strings))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """Trigrams that every text with a match has; None if none is mandatory.

    Follows the parsed pattern: literals, small classes, alternatives and options
    are multiplied out to the strings they stand for; where that ends (open
    repeats, large classes), the strings so far give a condition.
    """

    def sequence(items) -> tuple[set[str] | None, Query]:
        strings, conditions, closed = {""}, [], True
        for item in items:
            found, query = part(*item)
            if found is not None and len(strings) * len(found) <= MOST_STRINGS:
                strings = {a + b for a in strings for b in found}
                continue
            closed = False
            conditions.append(_holds(strings))
            strings = {""} if found is None else found
            conditions.append(query)
        if closed:
            return strings, None
        return None, _all_of([*conditions, _holds(strings)])

    def part(kind, value) -> tuple[set[str] | None, Query]:
        if kind is op.LITERAL:
            return {chr(value)}, None
        if kind is op.IN:
            chars = set()
            for what, x in value:
                if what is op.LITERAL:
                    chars.add(chr(x))
                elif what is op.RANGE and x[1] - x[0] < MOST_CHARS:
                    chars |= {chr(i) for i in range(x[0], x[1] + 1)}
                else:
                    return None, None
            return (chars, None) if len(chars) <= MOST_CHARS else (None, None)
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            return {""}, None
        if kind is op.SUBPATTERN:
            return sequence(value[3])
        if kind is op.ATOMIC_GROUP:
            return sequence(value)
        if kind is op.BRANCH:
            ways = [sequence(x) for x in value[1]]
            strings = set().union(*(s for s, _ in ways if s is not None))
            if all(s is not None for s, _ in ways) and len(strings) <= MOST_STRINGS:
                return strings, None
            return None, _any_of(q if s is None else _holds(s) for s, q in ways)
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            strings, query = sequence(inner)
            if strings is None:
                return None, query if least else None
            if most == 1:
                return strings | ({""} if not least else set()), None
            times = {""}
            for _ in range(min(least, 8)):
                if len(times) * len(strings) > MOST_STRINGS:
                    return None, _holds(times)
                times = {a + b for a in times for b in strings}
            return (times, None) if least == most <= 8 else (None, _holds(times))
        return None, None

    found, query = sequence(parser.parse(pattern, flags))
    return _holds(found) if found is not None else query


def trigrams_of(query: Query) -> set[bytes]:
    if query is None or isinstance(query, bytes):
        return {query} - {None}
    return set().union(*map(trigrams_of, query[1]))


class Scanner:
    """The rules, their trigram queries, and the search of a block of texts."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r, re.compile(r.pattern, r.flags)) for r in rules]
        self.rests = [re.compile(r.rest, re.ASCII) if r.rest else None for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.trigrams = sorted(set().union(*map(trigrams_of, self.queries)))
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.trigrams, 1):
            self.number[int.from_bytes(t, "big")] = i
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def index(self, texts: Sequence[str]) -> dict[bytes, np.ndarray]:
        """Posting lists (sorted text numbers) of the trigrams that the rules ask for."""
        raw = [t.encode() for t in texts]
        # Two bytes that UTF-8 never has keep trigrams inside their text.
        joined = self.lower[np.frombuffer(b"\xff\xff".join(raw), np.uint8)].astype(np.uint32)
        if len(joined) < 3:
            return {}
        codes = joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]
        ids = self.number[codes]
        at = np.flatnonzero(ids)
        starts = np.cumsum([0, *(len(r) + 2 for r in raw[:-1])])
        text = np.searchsorted(starts, at, "right") - 1
        keys = np.unique(ids[at].astype(np.int64) * len(raw) + text)
        ids, text = keys // len(raw), keys % len(raw)
        cuts = np.searchsorted(ids, np.arange(1, len(self.trigrams) + 2))
        return {t: text[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.trigrams)}

    def candidates(self, query: Query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
        if isinstance(query, bytes):
            return postings.get(query, np.empty(0, np.int64))
        parts = [self.candidates(q, postings) for q in query[1]]
        parts.sort(key=len)
        found = parts[0]
        for x in parts[1:]:
            if query[0] == "or":
                found = np.union1d(found, x)
            elif len(found):
                found = np.intersect1d(found, x, assume_unique=True)
        return found

    def spans(self, texts: Sequence[str], whole: bool = False) -> list[list[tuple[int, int, int]]]:
        """Per text (start, rule number, end) of every secret, sorted; `whole` adds each rule's `rest`."""
        out: list[list] = [[] for _ in texts]
        postings = self.index(texts)
        for k, ((rule, regex), query) in enumerate(zip(self.rules, self.queries, strict=True)):
            some = range(len(texts)) if query is None else self.candidates(query, postings)
            for i in some:
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        more = self.rests[k].match(texts[i], m.end()) if whole and self.rests[k] else None
                        out[i].append((m.start(), k, more.end() if more else m.end()))
        for found in out:
            found.sort()
        return out


def _scanner(rules: Sequence[Rule]):
    """Built once in each Python worker."""
    made: list[Scanner] = []

    def get() -> Scanner:
        if not made:
            made.append(Scanner(rules))
        return made[0]

    return get


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add `spans`: kind, start and end (code points, end exclusive) of every secret.

    Each block of whole texts gets an inverted index of the trigrams that the rules
    ask for. A rule's Boolean trigram query, derived from its pattern, intersects
    and unites the posting lists, and the pattern verifies the candidates; a rule
    without mandatory trigrams reads every text. Matches of a rule are leftmost and
    don't overlap; those of different rules may. Spans are in order of start, then of rules.

    No shuffle, one row per row. A null or empty text has no spans. A column
    `spans` of `docs` is replaced; without rules no text has spans.
    """
    rules = tuple(rules)
    scanner = _scanner(rules)

    def run(texts):
        found = scanner().spans(texts) if rules else [[] for _ in texts]
        kinds = [r.kind for r in rules]
        return [[[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in found]]

    return with_columns(docs, text, f"spans {SPANS}", run, keep)


def redact_secrets(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    placeholder: str = PLACEHOLDER,
) -> DataFrame:
    """Replace every secret by `placeholder`; spans that overlap or touch become one.

    Where a rule only marks the beginning of a secret (the first line of a PEM key),
    its `rest` goes too: the body of the key, with its END line or without.

    A null text stays null. All other columns, and their order, stay.
    """
    rules = tuple(rules)
    scanner = _scanner(rules)

    def run(texts):
        out = []
        for value, found in zip(texts, scanner().spans(texts, whole=True), strict=True):
            pieces, done = [], 0
            for k, (start, _, end) in enumerate(found):
                if start > done or k == 0:
                    pieces += [value[done:start], placeholder]
                done = max(done, end)
            out.append("".join([*pieces, value[done:]]) if found else value)
        return [out]

    columns, was_null = docs.columns, "_was_null"
    marked = docs.withColumn(was_null, F.col(text).isNull())
    done = with_columns(marked, text, f"{text} string", run)
    return done.withColumn(text, F.when(~F.col(was_null), F.col(text))).select(*columns)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def span_text(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """`kind:start:end` of the spans (of some kinds, all by default), comma-joined."""
    some = spans if kinds is None else F.filter(spans, lambda s: s.kind.isin(*kinds))
    joined = F.transform(
        some, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    )
    return F.array_join(joined, ",")
