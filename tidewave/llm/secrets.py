"""Secret scans through an inverted index of trigrams.

Each rule's regular expression gives a Boolean query over trigrams that every match must contain. A block of
documents is indexed by the trigrams that some rule asks for; a rule's candidates are the intersection and union of
their postings, and only candidates are searched by the regular expression. A rule without mandatory trigrams
searches every document. Blocks are what a task reads at once, so an index never outgrows a task, and a trigram
that all documents have only fills the postings of each block.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as parser  # the standard library's own view of a pattern
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewave.llm.common import LOWER, distinct, free_name, slices, table, utf8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Drops matches that are too short: length of this group, at least so many characters.
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE_RULES = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a whole run in any case, as it is greedy
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    # only where a token begins, so that a long run isn't searched again from each of its places
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (every document may match), a trigram, ("and", queries) or ("or", queries).
Query = object
#: A class of characters with more members than this after lower-casing ends a literal run.
MOST_LETTERS = 6
#: So many strings at most are kept for one run of a pattern.
MOST_STRINGS = 24


def both(kind: str, parts: list) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_strings(strings: set[str]) -> Query:
    """What a document has that contains one of the strings."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def letters(kind, value, ignore_case: bool) -> set[str] | None:
    """The lower-case letters that one place of a pattern allows, None if many."""
    if kind is parser.LITERAL:
        return {chr(value).encode().lower().decode()} if value < 128 else None
    if kind is parser.IN:
        found: set[str] = set()
        for k, v in value:
            span = (v, v) if k is parser.LITERAL else v if k is parser.RANGE else None
            if span is None or span[1] > 127 or span[1] - span[0] > 2 * MOST_LETTERS:
                return None
            found |= {chr(c).lower() for c in range(span[0], span[1] + 1)}
        return found if len(found) <= MOST_LETTERS else None
    return None


def trigram_query(pattern: str, ignore_case: bool = False) -> Query:
    """The Boolean trigram query that each match of a pattern satisfies, over lower-cased ASCII."""

    def walk(items) -> tuple[set[str] | None, Query]:
        """(the strings that the items are exactly, or None, what a match must have otherwise)"""
        run: set[str] = {""}
        exact, must = True, []

        def end_run() -> None:
            nonlocal run, exact
            must.append(of_strings(run))
            run, exact = {""}, False

        for kind, value in items:
            options: set[str] | None = None
            inner: Query = True
            if kind is parser.SUBPATTERN:
                options, inner = walk(value[3])
            elif kind is parser.BRANCH:
                parts = [walk(x) for x in value[1]]
                if all(s is not None for s, _ in parts):
                    options = set().union(*(s for s, _ in parts))
                else:
                    inner = both("or", [both("and", [q, of_strings(s) if s is not None else True]) for s, q in parts])
            elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT):
                low, high, body = value
                strings, q = walk(body)
                if strings is not None and (low, high) == (0, 1):
                    options = strings | {""}
                elif strings is not None and low == high and low <= 8:
                    options = {""}
                    for _ in range(low):
                        options = {a + b for a in options for b in strings}
                        if len(options) > MOST_STRINGS:
                            options = None
                            break
                elif low >= 1:
                    inner = both("and", [q, of_strings(strings) if strings is not None else True])
            else:
                options = letters(kind, value, ignore_case)
            if options is not None and len(run) * len(options) <= MOST_STRINGS:
                run = {a + b for a in run for b in options}
                continue
            end_run()
            must.append(inner)
            if options is not None and len(options) <= MOST_STRINGS:
                run = set(options)
        if exact:
            return run, both("and", must)
        must.append(of_strings(run))
        return None, both("and", must)

    strings, query = walk(parser.parse(pattern, re.ASCII))
    return both("and", [query, of_strings(strings)]) if strings is not None else query


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


class Index:
    """Postings of the wanted trigrams over one block of documents."""

    def __init__(self, wanted: list[str]):
        self.place = {t: i + 1 for i, t in enumerate(wanted)}
        self.lookup = np.zeros(1 << 21, np.uint16)  # by three 7-bit characters
        for t, i in self.place.items():
            a, b, c = t.encode()
            self.lookup[a << 14 | b << 7 | c] = i
        self.fold = np.frombuffer(LOWER, np.uint8).astype(np.int32)
        self.fold[128:] = 0  # no rule asks for other bytes; 0 is in no trigram

    def build(self, data: np.ndarray, at: np.ndarray) -> None:
        self.docs = len(at) - 1
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        low = self.fold[data]
        found = self.lookup[low[:-2] << 14 | low[1:-1] << 7 | low[2:]]
        pos = np.flatnonzero(found)
        doc = np.searchsorted(at, pos, "right") - 1
        whole = pos + 3 <= at[doc + 1]  # not over a document's end
        pair = distinct(found[pos[whole]].astype(np.int64) * self.docs + doc[whole])
        kinds, docs = pair // self.docs, pair % self.docs
        cuts = np.flatnonzero(np.diff(kinds)) + 1
        for part_kind, part in zip(kinds[np.r_[0, cuts]] if len(kinds) else [], np.split(docs, cuts), strict=False):
            self.postings[int(part_kind)] = part

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.docs)
        if isinstance(query, str):
            return self.postings.get(self.place[query], np.zeros(0, np.int64))
        sets = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return distinct(np.concatenate(sets))
        sets.sort(key=len)
        out = sets[0]
        for s in sets[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, s, assume_unique=True)
        return out


class Scanner:
    """Searches blocks of documents by some rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(n, r, r.compiled(), trigram_query(r.pattern, r.ignore_case)) for n, r in enumerate(rules)]
        self.index = Index(sorted(set().union(*(trigrams(q) for *_, q in self.rules))))

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text's matches, sorted."""
        self.index.build(*utf8(texts))
        found: list[list] = [[] for _ in range(len(texts))]
        for n, rule, compiled, query in self.rules:
            for d in self.index.candidates(query):
                if text := texts[int(d)].as_py():
                    found[d] += [(a, n, b) for a, b in rule.spans(text, compiled)]
        return [sorted(f) for f in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """Finds each rule's leftmost non-overlapping matches in docs.text of every row.

    Returns the columns in carry and spans, an array of (kind, start, end) in code points, end exclusive, by
    start and then by the rules' order. A null or empty text has no spans. Spans of several kinds may overlap.
    Rows that repeat give rows that repeat; an empty table gives no rows; columns not carried are ignored. Very long
    texts are searched whole, in time that grows with their length. One pass over the rows, no shuffle.
    """
    fields = [f for f in docs.schema.fields if f.name in carry]
    source = free_name(carry, "text")
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "spans array<struct<kind:string,start:bigint,end:bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in slices(whole, source):
                spans = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in f] for f in scanner.spans(batch.column(source))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(spans, kind)], names=[*names, "spans"])

    return docs.select(*[f"`{n}`" for n in names], docs["text"].alias(source)).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with each maximal run of overlapping spans replaced."""
    out, upto = [], 0
    for start, end in sorted(spans):
        if start >= upto:
            out += [text[upto:start], mark]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with all its columns, secrets in text replaced by the mark; n_chars, where docs has it, is counted again.
    Null texts stay null."""
    names = docs.columns
    counted = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = batch.column("text")
                new = [t if not t or not s else redact(t, [(a, b) for a, _, b in s], mark) for t, s in zip(texts.to_pylist(), scanner.spans(texts), strict=True)]
                arrays = list(batch.columns)
                arrays[names.index("text")] = pa.array(new, texts.type)
                if counted >= 0:
                    arrays[counted] = pa.array([None if t is None else len(t) for t in new], arrays[counted].type)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """The digest columns, from the spans that the operator finds."""
    from pyspark.sql import functions as F

    base = [r.kind for r in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *[count(k) for k in base], F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
