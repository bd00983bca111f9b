"""Secret scans by assignment-aware lexing.

Each whole text is read as source or configuration syntax: a lexer yields (name, value) pairs from `name = x`, `name: x`,
`name := x`, `name => x`, `"name": x`, `table["name"] = x`, `name: type = x`, `<name>x</name>` and indented blocks behind
`name: |`. A value is a literal (quoted, with escapes, prefixes, three quotes or backticks, or bare), a sum or row of
literals and names, or a bracketed list of those, each taken for itself; a name that is called is no literal. Names known to
hold a literal pass it on: a value refers to the values it is made of, so sums of any length cost what is written. A literal
counts as a secret by the sensitivity of the names it reaches and its own length and entropy; of a sum the characters are
counted together. Spans found that way are of kind `literal` and come on top of three base kinds:

assign  a password, secret, token or key name, = or :, and a value of 8 or more characters
access  AKIA and capitals or digits, 16 or more characters in all
hex     32 or more lower-case hexadecimal digits

Offsets count code points, the end is exclusive. Every text is one row and stays in its task.

Defined results: a null text counts as empty; no span gives counts 0 and empty strings; repeated rows give repeated
results; an empty table gives an empty result; other columns are not read.
"""

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_or_empty

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

# A name starts where no name character stands before it, so that a long run is tried once; behind it may stand a quote,
# the end of a subscript and a type.
PAIR = re.compile(r"""(?<![\w.-])([A-Za-z_][\w.-]*)["'`]?[ \t]*\]?[ \t]*"""
                  r"""(?::[ \t]*[A-Za-z_][\w.]*(?:[<\[][\w., ]*[>\]])?\??[ \t]*=(?![=>])|:=|=>|=(?![=>])|:(?![:=/]))[ \t]*""", re.ASCII)
TAG = re.compile(r"<([A-Za-z_][\w.-]*)(?:[ \t][^<>\n]*)?>([^<>]*)</\1[ \t]*>", re.ASCII)
BLOCK = re.compile(r"[|>][+-]?[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\Z))+)")
# Quoted with prefixes, three quotes, one kind of quote or backticks, each with escapes; the last group is a bare word.
TERM = re.compile(
    r"[bBfFrRuU]{0,2}(?:"
    r'"""((?:[^"\\]|\\.|"(?!""))*)"""'
    r"|'''((?:[^'\\]|\\.|'(?!''))*)'''"
    r'|"((?:[^"\\\n]|\\.)*)"'
    r"|'((?:[^'\\\n]|\\.)*)'"
    r"|`((?:[^`\\]|\\.)*)`)"
    r"|([A-Za-z0-9_+/=.$-]+)", re.DOTALL)
BARE = 6
SPACE, SPACES = re.compile(r"[ \t]*"), re.compile(r"\s*")
QUOTED = re.compile(r"""[bBfFrRuU]{0,2}["'`]""")
# How telling a target's name is.
SENSITIVE = (
    (re.compile(r"passw(or)?d|passphrase|secret|private_?key|api_?key|access_?key|credential|(^|_)(pwd|pass)$"), 1.0),
    (re.compile(r"token|auth|bearer|signing|encryption_?key"), 0.9),
    (re.compile(r"(^|_)(key|salt|hash)$"), 0.6),
)
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|0+|changeme.*|example.*|placeholder.*|your[_-].*|<.*>|none|null|true|false|undefined)$")
# A random literal of 8 characters passes under every telling name, with two repeats too: 0.6 * 2.5 / 3.5.
LEAST = 0.42


def sensitivity(name: str) -> float:
    name = re.sub(r"[.-]", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).lower()
    return max((weight for pattern, weight in SENSITIVE if pattern.search(name)), default=0.0)


class Value:
    """A literal (`span`, `text`) or a sum of values (`parts`): how often each character stands in it, and its length."""

    __slots__ = ("span", "text", "parts", "counts", "length")

    def __init__(self, text=None, span=None, parts=()):
        self.text, self.span, self.parts = text, span, parts
        self.counts = Counter(text or "")
        for part in parts:
            self.counts.update(part.counts)
        self.length = len(text) if text is not None else sum(part.length for part in parts)

    def strength(self) -> float:
        """0 for what is too short or a placeholder, else up to 1 with entropy."""
        if self.length < 8 or self.text is not None and PLACEHOLDER.match(self.text):
            return 0.0
        bits = -sum(n / self.length * math.log2(n / self.length) for n in self.counts.values())
        return min(1.0, bits / 3.5)


def _values(text: str, at: int, held: dict) -> list:
    """The values at `at`: one, or those of a list."""
    found, row, depth = [], [], 0

    def close():
        if row:
            found.append(row[0] if len(row) == 1 else Value(parts=tuple(row)))
            row.clear()

    while True:
        at = (SPACES if depth else SPACE).match(text, at).end()
        char = text[at:at + 1]
        if char and char in "([":
            depth, at = depth + 1, at + 1
            continue
        if depth and char and char in ")]":
            depth, at = depth - 1, at + 1
            if not depth:
                break
            continue
        if depth and char == ",":
            close()
            at += 1
            continue
        term = TERM.match(text, at)
        if term is None:
            break
        group, at = term.lastindex, term.end()
        if group < BARE:
            row.append(Value(term[group], term.span(group)))
        elif text[at:at + 1] == "(":
            break  # a call
        elif term[BARE] in held:
            values = held[term[BARE]]
            if len(values) == 1:
                row += values
            else:
                close()
                found += values
        else:
            row.append(Value(term[BARE], term.span(BARE)))
        after = (SPACES if depth else SPACE).match(text, at).end()
        if text[after:after + 1] == "+":
            at = after + 1
        elif not QUOTED.match(text, after) and not (depth and text[after:after + 1] in (",", ")", "]")):
            break
    close()
    return [v for v in found if v.length]


def _stripped(text: str, start: int) -> list:
    body = text.strip()
    start += len(text) - len(text.lstrip())
    return [Value(body, (start, start + len(body)))] if body else []


def lex(text: str):
    """(name, values) of each assignment; names that hold values by then stand for them."""
    held: dict = {}
    tags = TAG.finditer(text) if "</" in text else iter(())
    tag = next(tags, None)
    for pair in PAIR.finditer(text):
        while tag is not None and tag.start() < pair.start():
            yield tag[1], _stripped(tag[2], tag.start(2))
            tag = next(tags, None)
        block = BLOCK.match(text, pair.end())
        values = _stripped(block[1], block.start(1)) if block else _values(text, pair.end(), held)
        if values:
            held[pair[1]] = values
            yield pair[1], values
    for tag in [tag, *tags] if tag is not None else ():
        yield tag[1], _stripped(tag[2], tag.start(2))


def literals(text: str, least: float = LEAST) -> dict:
    """(start, end) of each literal that reaches a sensitive name, with its best score."""
    hits = []
    for name, values in lex(text):
        weight = sensitivity(name)
        if weight:
            hits += [(score, value) for value in values if (score := weight * value.strength()) >= least]
    found, seen = {}, set()
    # From the best score on; every value is followed once. All are held by `hits` while their ids count.
    for score, top in sorted(hits, key=lambda h: -h[0]):
        open_ = [top]
        while open_:
            value = open_.pop()
            if id(value) not in seen:
                seen.add(id(value))
                open_ += value.parts
                if value.span and value.span[1] > value.span[0]:
                    found.setdefault(value.span, score)
    return found


def base_spans(text: str) -> list:
    """(start, kind number, end) of the base kinds, in order."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_col="doc_id", text_col="text", least=LEAST) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_literal and best_score of every whole text."""
    settle(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                named = literals(text, least) if "=" in text or ":" in text or "</" in text else {}
                spans = sorted(base + [(start, 3, end) for start, end in named])
                counts = Counter(kind for _, kind, _ in base)
                out.append((counts[0], counts[1], counts[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                            len(named), max(named.values(), default=0.0)))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal", "best_score"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long, best_score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
