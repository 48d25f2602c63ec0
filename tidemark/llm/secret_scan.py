"""Secret scanning with a trigram inverted index.

Every rule is a regular expression.  From its parse tree follows a Boolean
query over trigrams that each matching text satisfies; letters are folded to
lower case.  A block of documents is indexed once: postings (bit sets of the
block's documents) of just the trigrams that some query names.  Queries
intersect and unite postings, and the expressions run over the candidates
alone.  A rule without mandatory trigrams scans every document.

Spans are code points, end exclusive.  Matches of one rule are leftmost and
do not overlap; rules may overlap each other.

Defined results: null and empty texts have no spans; rows are independent;
columns named as outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import held, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's rules.  A run of hex digits of 24 or more is what the
#: leftmost runs of any length leave once shorter ones are dropped.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further rules, by the public formats of the tokens.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"\b[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,100}@"),
)
RULES = BASE + MORE

# A query is True (every text), or ("and" | "or", set of trigrams and queries).
ALL = True
MOST_STRINGS, LONGEST = 32, 12


def _and(*parts):
    parts = {p for p in parts if p is not ALL}
    return ALL if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _or(*parts):
    parts = set(parts)
    return ALL if ALL in parts or not parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings: frozenset[str]):
    """What a text satisfies that holds one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return ALL
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


@dataclass(frozen=True)
class _Info:
    """All strings an expression matches (``exact``), else its possible beginnings and ends, and a query."""

    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: object = ALL


_EMPTY = frozenset(("",))
_ANY = _Info(None, _EMPTY, _EMPTY)


def _bounded(x: _Info) -> _Info:
    exact, prefix, suffix, query = x.exact, x.prefix, x.suffix, x.query
    if exact is not None and (len(exact) > MOST_STRINGS or max(map(len, exact)) > LONGEST):
        query, prefix, suffix, exact = _and(query, _of_strings(exact)), exact, exact, None
    if exact is None:
        query = _and(query, _of_strings(prefix), _of_strings(suffix))
        prefix, suffix = frozenset(p[:2] for p in prefix), frozenset(s[-2:] for s in suffix)
    return _Info(exact, prefix, suffix, query)


def _then(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None:
        return _bounded(_Info(frozenset(x + y for x in a.exact for y in b.exact), _EMPTY, _EMPTY, _and(a.query, b.query)))
    ends, starts = a.exact or a.suffix, b.exact or b.prefix
    across = frozenset(x + y for x in ends for y in starts)
    prefix = frozenset(x + y for x in a.exact for y in starts) if a.exact is not None else a.prefix
    suffix = frozenset(x + y for x in ends for y in b.exact) if b.exact is not None else b.suffix
    return _bounded(_Info(None, prefix, suffix, _and(a.query, b.query, _of_strings(across))))


def _either(parts: list[_Info]) -> _Info:
    if all(p.exact is not None for p in parts):
        return _bounded(_Info(frozenset().union(*(p.exact for p in parts)), _EMPTY, _EMPTY, _or(*(p.query for p in parts))))
    parts = [p if p.exact is None else _Info(None, p.exact, p.exact, _and(p.query, _of_strings(p.exact))) for p in parts]
    return _bounded(_Info(None, frozenset().union(*(p.prefix for p in parts)), frozenset().union(*(p.suffix for p in parts)), _or(*(p.query for p in parts))))


def _letters(items) -> _Info:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value))
        elif op is sre.RANGE and value[1] - value[0] < 64:
            found.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return _ANY
    found = {c.lower() for c in found}
    return _Info(frozenset(found), _EMPTY, _EMPTY) if len(found) <= 6 and all(c.isascii() for c in found) else _ANY


def _info(tree) -> _Info:
    out = _Info(_EMPTY, _EMPTY, _EMPTY)
    for op, value in tree:
        if op is sre.LITERAL:
            part = _Info(frozenset((chr(value).lower(),)), _EMPTY, _EMPTY) if value < 128 else _ANY
        elif op is sre.IN:
            part = _letters(value)
        elif op is sre.SUBPATTERN:
            part = _info(value[-1])
        elif op is sre.ATOMIC_GROUP:
            part = _info(value)
        elif op is sre.BRANCH:
            part = _either([_info(x) for x in value[1]])
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            part = _info(inner)
            if low == 0:
                part = _either([part, _Info(_EMPTY, _EMPTY, _EMPTY)]) if high == 1 else _ANY
            elif (low, high) != (1, 1):
                once = part
                for _ in range(min(low, 4) - 1):
                    part = _then(part, once)
                if high != low or low > 4:
                    strings = part.exact
                    part = _Info(None, strings or part.prefix, strings or part.suffix, part.query)
        else:
            part = _ANY
        out = _then(out, part)
    return out


def trigram_query(pattern: str):
    """A query that every text with a match satisfies; True if there is no mandatory trigram."""
    x = _info(sre_parser.parse(pattern))
    return _and(x.query, _of_strings(x.exact)) if x.exact is not None else _and(x.query, _of_strings(x.prefix), _of_strings(x.suffix))


def trigrams_of(query) -> set[str]:
    if query is ALL:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


class Index:
    """Postings of the named trigrams over one block of documents."""

    def __init__(self, names: list[str], texts: list[bytes], table: np.ndarray) -> None:
        self.n = len(texts)
        self.number = {t: k for k, t in enumerate(names)}
        joined = b"\0\0\0".join([t.lower() for t in texts])
        size = np.array([len(t) + 3 for t in texts], dtype=np.int64)
        self.bits = np.zeros((len(names), self.n), dtype=bool)
        if len(joined) > 2:
            raw = np.frombuffer(joined, dtype=np.uint8)
            code = raw[:-2].astype(np.uint32) << 16
            code |= raw[1:-1].astype(np.uint32) << 8
            code |= raw[2:]
            kind = table[code]
            at = np.flatnonzero(kind)
            self.bits[kind[at] - 1, np.searchsorted(np.cumsum(size), at, side="right")] = True

    def candidates(self, query) -> np.ndarray:
        if query is ALL:
            return np.ones(self.n, dtype=bool)
        if isinstance(query, str):
            return self.bits[self.number[query]]
        parts = [self.candidates(q) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Scanner:
    """Spans of all rules over blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.names = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        if len(self.names) > 65000:
            raise ValueError("the rules name too many trigrams")
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for k, t in enumerate(self.names):
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = k + 1

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every text, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = Index(self.names, [t.encode() for t in texts], self.table)
        for number, (rule, pattern, query) in enumerate(self.rules):
            group, least = rule.group, rule.least
            for k in np.flatnonzero(index.candidates(query)).tolist():
                for m in pattern.finditer(texts[k]):
                    if m.end(group) - m.start(group) >= least:
                        out[k].append((m.start(), number, m.end()))
        for spans in out:
            spans.sort()
        return out


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return held(("secrets", rules), lambda: Scanner(rules))


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without the text but with ``secrets``: array of (kind, start, end) by start, then rule order."""
    keep = [c for c in docs.columns if c not in (text_col, "secrets")]
    source = docs.select(*keep, text_of(text_col).alias("_td_text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            at = 0
            sizes = np.cumsum([len(x) for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()])
            while at < batch.num_rows:
                # Blocks of about 4 MB; a longer text is a block of its own.
                done = int(sizes[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, done + (4 << 20), side="right")))
                part = batch.slice(at, stop - at)
                found = scanner.scan(part.column(part.num_columns - 1).to_pylist())
                rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.list_(span))], names=[*keep, "secrets"])
                at = stop

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return source.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("secrets", spans)]))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``, overlapping spans together."""
    names = docs.columns
    own = [c for c in names if c != text_col]
    source = docs.select(*own, text_of(text_col).alias("_td_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            clean = []
            for k in range(0, len(texts), 500):
                for text, spans in zip(texts[k : k + 500], scanner.scan(texts[k : k + 500]), strict=True):
                    parts, at, open_end = [], 0, 0
                    for s, _, e in spans:
                        if s >= open_end:
                            parts += [text[at:s], mark]
                        open_end = at = max(open_end, e)
                    clean.append("".join([*parts, text[at:]]))
            cols = {c: batch.column(i) for i, c in enumerate(own)} | {text_col: pa.array(clean, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return source.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: spans of all rules in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs)
    spans = F.col("secrets")

    def joined(xs):
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda x: x["kind"].isin(*(r.kind for r in BASE)))
    return out.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
