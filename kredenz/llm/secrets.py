"""Secret scans: base patterns, and literals that flow into names which sound secret.

The assignment scan reads source and configuration syntax (``name = "x"``, ``"name": "x"``,
``name: type = x``, ``NAME=x``, ``name => x``, ``--name=x``, ``<name>x</name>``, ``key="name" value="x"``,
concatenations, ``a = b = "x"``) into pairs of a name and a value. A value is a node: the literals
that stand in it and the earlier values it mentions. Names are looked up in reading
order, so a constant reaches every name it is handed to. Names are weighed by their words;
from the weightiest on, each marks the literals that reach it, each literal once. What is kept is
``weight(name) * quality(literal) >= THRESHOLD``.

Everything is linear in the text: patterns are possessive and begin where a word begins, a
value is read once by its own pair, and marking visits a node once. Texts are whole, of any
length; a null text is empty. Rows come back one for one, in any number of copies; null ids stay. An
empty table gives no rows. Of the other columns only those named in ``keep`` are returned,
and ``spans`` is the operator's own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from kredenz.llm.batches import slices, texts

THRESHOLD = 0.5

#: The base patterns, their least lengths and the order of kinds at one start.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "literal")

PAIR = re.compile(
    r"""(?<![\w$.-])-*+(?P<name>[^\W\d][\w$]*+(?:[.-][\w$]++)*+)(?:\\?["'`])?+\]?+[ \t]*+"""
    r"""(?::[ \t]*+[A-Za-z_][\w.\[\], |]*+(?==[^=]))?+(?P<op>=>|:=|[?+]?=(?!=)|:(?![:/]))"""
)
INDEXED = re.compile(r"""\[[ \t]*+["'](?P<name>[^"'\n]++)["'][ \t]*+\][ \t]*+(?P<op>=(?!=))""")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)>(?P<value>[^<>]*+)</(?P=name)>")
STRING = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+(?={q})") for q in "\"'`"}
PREFIX = re.compile(r"""(?:[rRbBuUfF@$]{1,2}|(?:str|String|bytes|SecretStr|Buffer\.from|lit)[ \t]*\()(?=["'`])""")
REFERENCE = re.compile(r"\$?\{?(?P<path>[^\W\d][\w$]*+(?:\.[\w$]++)*+)\}?")
BARE = re.compile(r"[A-Za-z0-9+/_.~@!%^&*$#-]++={0,2}")
JOIN = re.compile(r"\)?[ \t]*+(?:\+|\.\.|\|\||\?\?|\?:|&(?!&)|or\b|\.(?=[ \t]*+[\"'$]))[ \t]*+\n?[ \t]*+")
CALL = re.compile(r"\([^()\n]*+\)")
BLANK = re.compile(r"[ \t]*+")
SPACE = re.compile(r"\s*+")
ENDS = re.compile(r"[ \t]*+(?:[;,)}\]\n#\r\"'`]|//|\\|\||\Z)")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

SECRET = frozenset("password passwd passwort pwd pw pass passphrase passcode secret secrets token tokens credential credentials cred creds apikey accesskey secretkey privatekey bearer jwt otp".split())
KEY_OF = frozenset("api access private secret signing encryption encrypt master session auth shared account service client license deploy ssh hmac aes storage subscription".split())
HALF = frozenset("key auth authorization salt pin seed signature sig cookie cert hash hmac dsn".split())
ABOUT = frozenset(
    "name names count counts counter length len size url uri path file filename dir type kind id ids field label hint policy "
    "regex pattern limit max min ttl expiry expires expiration header prefix suffix error message prompt placeholder format "
    "enabled required visible index column param attempts retries timeout version algorithm strength reset endpoint".split()
)
PLACEHOLDER = re.compile(
    r"(?i)(?:change[-_ ]?me|example|sample|placeholder|redacted|dummy|default|undefined|(?:your|my|insert|enter|put|some)[-_ ].*"
    r"|(.)\1*|<.*>|\$?\{.*\}|\{\{.*\}\}|%\(?.*\)?s|none|null|true|false|todo|tbd|n/?a|pass(?:word)?|secret|token|key|required|optional|string)"
)


def weight(name: str) -> float:
    """How surely ``name`` names a secret, by its words; the last path component counts."""
    last = re.split(r"[.\s]", name)[-1] or name
    parts = [p.lower() for p in WORD.findall(last)]
    if not parts:
        return 0.0
    joined = "".join(parts)
    if any(p in SECRET for p in parts) or joined in SECRET:
        found = 1.0
    elif any(b in ("key", "keys") and a in KEY_OF for a, b in zip(parts, parts[1:])):
        found = 1.0
    elif any(p in HALF for p in parts):
        found = 0.6
    else:
        return 0.0
    return found * (0.3 if parts[-1] in ABOUT or parts[0] in ("is", "has", "num", "max", "min") else 1.0)


def quality(value: str, quoted: bool) -> float:
    """How much ``value`` looks like a secret, from its length, variety and kinds of characters."""
    n = len(value)
    if n < 6 or PLACEHOLDER.fullmatch(value):
        return 0.0
    if re.match(r"[a-z][a-z0-9+.-]*://[^@\s]*$|\.{0,2}/", value, re.I):
        return 0.2
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    found = min(1.0, bits / 40)
    mixed = len({c.isdigit() and "0" or c.isupper() and "A" or c.islower() and "a" or "-" for c in value})
    if any(c.isspace() for c in value):
        return found * 0.4
    if quoted:
        return min(1.0, found + 0.15 * mixed)
    return found if mixed > 1 and any(c.isdigit() for c in value) else 0.0


class Literal(NamedTuple):
    start: int
    end: int
    quoted: bool


@dataclass(slots=True)
class Value:
    """What a name holds: literals that stand in it and the values of names it mentions."""

    literals: list[Literal] = field(default_factory=list)
    uses: list["Value"] = field(default_factory=list)
    end: int = 0


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str | None
    score: float | None


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns that are long enough."""
    found = [Span("assign", *m.span(), m[1], None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [Span("access", *m.span(), None, None) for m in ACCESS.finditer(text)]
    return found + [Span("hex", *m.span(), None, None) for m in HEX.finditer(text)]


def read_string(text: str, at: int) -> tuple[int, int, int] | None:
    """``start, end, next`` of the string that opens at ``at``; None if it doesn't close."""
    quote = text[at]
    if quote != "`" and text.startswith(quote * 3, at):
        end = text.find(quote * 3, at + 3)
        return None if end < 0 else (at + 3, end, end + 3)
    m = STRING[quote].match(text, at + 1)
    return m and (at + 1, m.end(), m.end() + 1)


def read_value(text: str, at: int, known: dict[str, Value]) -> tuple[Value, str | None]:
    """The value that begins at ``at``, and the name it consists of if it is one."""
    value, inside, first, alone = Value(), False, True, None
    at = BLANK.match(text, at).end()
    if text.startswith("\\", at) and text[at + 1 : at + 2] in ('"', "'"):  # a string inside a string
        end = text.find(text[at : at + 2], at + 2, end_of_line(text, at))
        if end >= 0:
            value.literals.append(Literal(at + 2, end, True))
            value.end = end
        return value, None
    while True:
        if text.startswith("(", at) and first:
            inside, at = True, SPACE.match(text, at + 1).end()
        m = PREFIX.match(text, at)
        at = m.end() if m else at
        opens = text[at : at + 1]
        if opens and opens in "\"'`":
            string = read_string(text, at)
            if string is None:
                break
            value.literals.append(Literal(string[0], string[1], True))
            at, alone = string[2], None
        else:
            bare, name = BARE.match(text, at), REFERENCE.match(text, at)
            called = name and CALL.match(text, name.end())
            if called:  # what a call returns isn't known; what it is joined to is
                m = JOIN.match(text, called.end())
                if not m:
                    break
                first, at = False, m.end()
                continue
            if name and text[name.end() : name.end() + 1] == "(":
                break
            path = name["path"] if name else ""
            held = known.get(path) or known.get(re.sub(r"^(?:self|this)\.", "", path))
            if held and (not bare or bare.end() <= name.end()):
                value.uses.append(held)
                at = name.end()
            elif bare and first and ENDS.match(text, bare.end()) or bare and first and text[bare.end() : bare.end() + 1].isspace():
                value.literals.append(Literal(bare.start(), bare.end(), False))
                at = bare.end()
            elif name:
                at = name.end()
            else:
                break
            alone = path if first and name else None
        first, value.end = False, at
        m = JOIN.match(text, at)
        if m:
            at, alone = m.end(), None
            continue
        step = SPACE.match(text, at).end() if inside else BLANK.match(text, at).end()
        if step < len(text) and text[step] in "\"'" and value.literals and value.literals[-1].quoted and step > at:
            at = step  # neighbouring strings are one
            continue
        return value, alone
    return value, None


def end_of_line(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """Every name with what is assigned to it, in reading order."""
    known: dict[str, Value] = {}
    waiting: Value | None = None  # of ``a`` in ``a = b = ...``
    label, label_end = None, -1
    sites = [(m.start("name"), m.end(), m["name"], m["op"]) for m in PAIR.finditer(text)]
    sites += [(m.start("name"), m.end(), m["name"], m["op"]) for m in INDEXED.finditer(text)]
    sites += [(m.start("name"), m.start("value"), m["name"], "<>") for m in ELEMENT.finditer(text)]
    for start, end, name, op in sorted(sites):
        if op == "<>":
            yield name, Value([Literal(end, text.find("<", end), True)])
            continue
        value, alone = read_value(text, end, known)
        if op == "+=" and name in known:
            value.uses.append(known[name])
        if waiting and waiting.end == start:
            waiting.uses.append(value)
        waiting = None
        if alone and PAIR.match(text, value.end - len(alone)):
            waiting = value = Value(end=value.end - len(alone))
        names, lower = [name], name.lower()
        if lower == "value" and label and 0 <= start - label_end < 80:
            names.append(label)
        label = None
        if lower in ("key", "name", "id") and len(value.literals) == 1 and not value.uses:
            label, label_end = text[value.literals[0].start : value.literals[0].end], value.end
            if weight(label):  # a name, not a value
                continue
        for n in names:
            if value.literals or value.uses or waiting:
                known[n] = value
            else:
                known.pop(n, None)
            yield n, value


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a name which sounds secret, with the weightiest such name."""
    marked = [(weight(name), name, value) for name, value in pairs(text)]
    marked = [m for m in marked if m[0] > 0]
    marked.sort(key=lambda m: -m[0])
    seen: set[int] = set()
    best: dict[tuple[int, int], Span] = {}
    for w, name, value in marked:
        ahead = [value]
        while ahead:
            node = ahead.pop()
            if id(node) in seen:
                continue
            seen.add(id(node))
            ahead += node.uses
            if node.literals:
                whole = "".join(text[p.start : p.end] for p in node.literals)
                score = round(w * quality(whole, node.literals[0].quoted), 6)
                for p in node.literals:
                    if score >= THRESHOLD and p.end > p.start:
                        best.setdefault((p.start, p.end), Span("literal", p.start, p.end, name, score))
    return list(best.values())


def spans_of(text: str) -> list[Span]:
    """Base spans and literals by start, then kind."""
    found = base_spans(text)
    if "=" in text or ":" in text or "</" in text:
        found += literal_spans(text)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "spans array<struct<kind: string, start: long, end: long, name: string, score: double>>"
SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
)


def secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``spans``, the secrets of each whole text, in one pass without a shuffle."""
    kept = StructType([docs.schema[c] for c in keep])
    given = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)], F.col("text").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [[s._asdict() for s in spans_of(t.as_py())] for t in texts(part, "_text")]
                columns = [part.column(k) for k in range(len(keep))] + [pa.array(found, SPAN_TYPE)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "spans"])

    return given.mapInArrow(run, StructType([*kept.fields, *StructType.fromDDL(SPANS).fields]))
