"""Secrets in texts: patterns, and assignments read as source and configuration files write them.

Three patterns always count (``base_spans``). Beside them every text is read as a list of assignments: a name, an operator and
an expression of literals, names and interpolations, whether it is a program, JSON, YAML, an ini or env file, markup or a
command line. A constant keeps what it was assigned, and a literal reaches every name that its constant is assigned
to, through any number of steps and in either order. A literal is a secret if the name that it reaches says so and the
literal can be one: score of the name times plausibility of the literal. Names are judged by their words
("client_secret", not "secretary"), literals by length, kinds of characters, entropy and what placeholders look like.

A text is read once and constants form a graph that is walked once for each score a name can have, so
time grows with the length of a text. Rows are only mapped; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table

#: Kinds of spans, in the order in which spans of one start come.
BASE_KINDS, KINDS = ("assign", "access", "hex"), ("assign", "access", "hex", "literal", "flow")
#: Score that a span of the method needs.
LEAST_SCORE = 0.5

# The patterns of the contract. Lengths of the last two are in the pattern, since a match that is too short has no longer one inside.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# Words of names and how surely what they are given is a secret; pairs of words count as a whole
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 1.0,
    "api key": 1.0, "access key": 1.0, "secret key": 1.0, "private key": 1.0, "signing key": 1.0, "encryption key": 1.0, "auth key": 1.0, "master key": 1.0, "account key": 1.0,
    "pass": 0.7, "bearer": 0.8, "authorization": 0.8, "auth": 0.7, "pin": 0.6, "key": 0.45, "salt": 0.45, "cookie": 0.45, "session": 0.45, "signature": 0.45,
}
#: Last words of names that speak of a secret without being one.
ABOUT_SECRETS = set("count max min num number len length size limit type name field url uri path file dir folder expiry expires timeout ttl regex pattern policy hint label prompt placeholder error message reset header endpoint param strength rule rules format prefix suffix column table class input form enabled required".split())
AMOUNTS = {"max", "min", "num", "count", "total"}  # as first words
SETTERS = {"set", "with", "use", "add", "put"}
KEYED, VALUED = {"key", "name", "id", "property", "param", "variable"}, {"value", "content", "default", "val"}
SCHEMES = {"bearer", "basic", "token"}
_PLACEHOLDER = re.compile(
    r"(?:<.*>|\$\{.*\}|\{\{?.*\}?\}|%.*%|\[.*\]|(.)\1*|(?:your|my|some|enter|insert|replace|change|example|sample|dummy|fake|todo|none|null|undefined|redacted|removed|hidden|placeholder|default|required|optional|string|value)(?:[\W_].*|me|this|it)?|.*(?:placeholder|changeme|redacted|example).*|(?:x{3,}|\*{3,}|\.{3,}).*)",
    re.I | re.S,
)
_REFERENCE = re.compile(r"\$\{([A-Za-z_][\w.]*)[^{}]*\}|\{\{\s*([A-Za-z_][\w.]*)\s*\}\}|\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)|%\(([A-Za-z_]\w*)\)s|%([A-Za-z_]\w*)%|#\{([A-Za-z_][\w.]*)\}")
_TARGET = re.compile(r"""(?<![\w$.\-])([^\W\d][\w$.\-]*+)(["'`]?+\]?+(?:\[\w*+\])?+)(?:[\x20\t]*+(=>|:=|\+=|=(?![=~>])|:(?![:/])|,(?=\s*+["'`])|\()|(>))""")
_OPTION = re.compile(r"(?<![\w$.\-])--([^\W\d][\w\-]*+)(?:=|[\x20\t]++(?=[^\s\-=]))")
_SPACE, _LINE_SPACE = re.compile(r"\s*+"), re.compile(r"[\x20\t]*+")
_STRING = re.compile(r"""[bBrRuUfF@]{0,2}(?:"{3}((?:[^"\\]|\\.|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""", re.S)
_NAME = re.compile(r"[^\W\d][\w$.]*+")
_BARE = re.compile(r"""(?:\$\{[^{}\s]*+\}|\{\{[^{}\n]*+\}\}|[^\s"'`,;(){}\[\]<>#&|])++""")
_JOIN = re.compile(r"\+|\.(?!\d)|\|\||\?\?|%|\bor\b|\\\n")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_words(name: str) -> list[str]:
    """The words of a name in any of the usual spellings, in lower case and without a plural's s."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return [w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w for w in words]


def _score_of_name(name: str) -> float:
    words = name_words(name)
    if not words:
        return 0.0
    score = max(NAME_SCORES.get(w, 0.0) for w in [*words, *map(" ".join, zip(words, words[1:]))])
    return score * (0.3 if words[-1] in ABOUT_SECRETS or words[0] in AMOUNTS else 1.0)


class _Names(dict):
    """Scores of names, emptied when it has grown large."""

    def __missing__(self, name: str) -> float:
        if len(self) > 200_000:
            self.clear()
        score = self[name] = _score_of_name(name)
        return score


NAMES = _Names()


def plausibility(text: str, quoted: bool) -> float:
    """How well a literal can be a secret, from 0 to 1.2 (long and random)."""
    n = len(text)
    if n < 6 or _PLACEHOLDER.fullmatch(text):
        return 0.0
    if text.startswith("-----BEGIN ") and "PRIVATE" in text:
        return 1.0
    if any(c.isspace() for c in text) or re.match(r"(?:~|\.{1,2})?/|[A-Za-z]:\\|\w+://|www\.", text) or re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z]+(?:[._][a-z]+)+", text):
        return 0.0
    counts = Counter(text)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits, letters = sum(c.isdigit() for c in text) >= (1 if quoted else 2), any(c.isalpha() for c in text)
    mixed = digits + any(c.islower() for c in text) + any(c.isupper() for c in text) + any(not c.isalnum() for c in text)
    if n >= 24 and entropy >= 3.3 and digits and letters:
        return 1.2
    if n >= 8 and entropy * n >= 20 and (digits and letters or mixed >= 3):
        return 1.0
    if n >= 20 and entropy * n >= 60 and quoted:
        return 0.85
    return 0.55 if quoted and entropy * n >= 8 else 0.2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the three patterns, leftmost and without overlaps within a kind, sorted."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)] + [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class _Value:
    """What an assignment assigns: its own literals, and names of others."""

    literals: list[tuple[int, int, bool]] = field(default_factory=list)  # start, end, whether quoted
    names: list[tuple[str, int]] = field(default_factory=list)  # with the place where they are used
    start: int = 0
    bare: tuple[int, int] | None = None  # a single name without quotes, a literal if nothing has that name
    reached: float = 0.0  # best score of a name that it has reached


@dataclass
class _Assignment:
    names: list[str]
    place: int
    value: _Value


def _literal(text: str, start: int, end: int, quoted: bool, value: _Value) -> None:
    held = text[start:end]
    names = [(next(g for g in m.groups() if g), start) for m in _REFERENCE.finditer(held)] if "{" in held or "$" in held or "%" in held else []
    value.names += names
    if not names or _REFERENCE.sub("", held).strip():
        value.literals.append((start, end, quoted))


def _expression(text: str, at: int) -> tuple[_Value, int]:
    """The value that begins at ``at``, and where it ends: literals and names with what joins them, in parentheses and calls too."""
    at = _LINE_SPACE.match(text, at).end()
    if not (m := _STRING.match(text, _SPACE.match(text, at).end())):
        bare = _BARE.match(text, at)
        if bare and not _NAME.fullmatch(bare[0]) and not text.startswith("(", bare.end()):  # a value of a configuration file
            value = _Value(start=at)
            _literal(text, at, bare.end(), False, value)
            return value, bare.end()
    else:
        at = m.start()
    value, depth, last, end = _Value(start=at), 0, "", at
    while True:
        if m := _STRING.match(text, at):
            group = m.lastindex
            _literal(text, *m.span(group), True, value)
            at, last = m.end(), "term"
        elif last != "term" and (m := _NAME.match(text, at)):
            called = text.startswith("(", m.end())
            if not called and m[0].lower() in SCHEMES and (bare := _BARE.match(text, _LINE_SPACE.match(text, m.end()).end())) and bare.start() > m.end():
                _literal(text, *bare.span(), False, value)
                return value, bare.end()
            if not called:
                value.names.append((m[0], m.start()))
            at, last = m.end(), "call" if called else "term"
        elif last != "term" and depth and (m := _BARE.match(text, at)) and m[0][0].isdigit():
            at, last = m.end(), "term"
        elif text.startswith("(", at) and last != "term":
            at, depth, last = at + 1, depth + 1, "open"
        elif text.startswith(")", at) and depth:
            at, depth, last = at + 1, depth - 1, "term"
        elif text.startswith(",", at) and depth:
            at, last = at + 1, "join"
        elif last == "term" and (m := _JOIN.match(text, at)):
            at, last = m.end(), "join"
        else:
            break
        end = at
        at = (_SPACE if last != "term" or depth else _LINE_SPACE).match(text, at).end()
        if at == len(text):
            break
    if len(value.names) == 1 and not value.literals and depth == 0 and text[value.start : end] == value.names[0][0]:
        value.bare = (value.start, end)
    return value, end


def assignments(text: str) -> list[_Assignment]:
    """All names with what they are given, in the order of the text."""
    found: list[_Assignment] = []
    asked = ""  # a name that a literal gave, as in key="password" value="..."
    options = list(_OPTION.finditer(text)) if "--" in text else []
    for m in heapq.merge(_TARGET.finditer(text), options, key=lambda m: m.start(1)) if options else _TARGET.finditer(text):
        op = (m[3] or m[4]) if m.re is _TARGET else "--"
        name, start, end = m[1], m.start(1), m.end()
        if op == "(":
            words = re.match(r"(?:[\w$]+\.)*+([a-z]+)(?=[A-Z_])", name)
            if not words or words[1] not in SETTERS or not NAMES[name]:
                continue
            name = name.rpartition(".")[2][len(words[1]) :]
        elif op == "," and m[2][:1] not in {'"', "'", "`"}:
            continue
        if op == ">":
            close = text.find("<", end)
            if text[m.start() - 1 : m.start()] != "<" or close < 0:
                continue
            value = _Value(start=end)
            held = text[end:close]
            _literal(text, end + len(held) - len(held.lstrip()), close - len(held) + len(held.rstrip()), True, value)
        else:
            value, _ = _expression(text, end)
        if not value.literals and not value.names:
            continue
        names = [name]
        if found and found[-1].value.start == start:  # a = b = "...", name: type = "..."
            names = found.pop().names
            names.append(name)
        last = name_words(name)[-1:]
        if asked and last and last[0] in VALUED:
            names.append(asked)
        asked = ""
        if last and last[0] in KEYED and len(value.literals) == 1 and not value.names:
            held = text[slice(*value.literals[0][:2])]
            asked = held if len(held) < 200 and NAMES[held] >= LEAST_SCORE else ""
        elif last and last[0] in KEYED and len(value.names) == 1 and not value.literals:
            asked = value.names[0][0] if NAMES[value.names[0][0]] >= LEAST_SCORE else ""
        found.append(_Assignment(names, start, value))
    return found


def method_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """``(kind, start, end, name, score)`` of literals that a sensitive name is given, "literal", or that reach one through constants, "flow"."""
    held = assignments(text)
    if not any(NAMES[n] for a in held for n in a.names):
        return []
    bound: dict[str, list[_Assignment]] = {}
    for a in held:
        for name in a.names:
            bound.setdefault(name.rpartition(".")[2], []).append(a)

    def meant(name: str, place: int) -> _Assignment | None:
        """The last assignment before a use, else the first after it."""
        of = bound.get(name.rpartition(".")[2])
        if not of:
            return None
        lo, hi = 0, len(of)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if of[mid].place < place else (lo, mid)
        before = of[lo - 1] if lo else None
        if before is not None and before.value.start <= place and any(p == place for _, p in before.value.names):  # its own right side
            before = of[lo - 2] if lo > 1 else None
        return before or of[min(lo, len(of) - 1)]

    found: dict[tuple[int, int], tuple[str, str, float]] = {}

    def tell(start: int, end: int, kind: str, name: str, score: float) -> None:
        if score >= LEAST_SCORE and ((start, end) not in found or score > found[start, end][2]):
            found[start, end] = (kind, name, score)

    for a in held:
        name = max(a.names, key=NAMES.__getitem__)
        score = NAMES[name]
        if not score:
            continue
        open_values = [(a.value, "literal")]
        while open_values:
            value, kind = open_values.pop()
            if value.reached >= score:
                continue
            value.reached = score
            whole = "".join(text[s:e] for s, e, _ in value.literals)
            for s, e, quoted in value.literals:
                tell(s, e, kind, name, score * plausibility(whole if len(value.literals) > 1 and quoted else text[s:e], quoted))
            for used, place in value.names:
                of = meant(used, place)
                if of is not None:
                    open_values.append((of.value, "flow"))
                elif value.bare:
                    tell(*value.bare, kind, name, score * plausibility(text[slice(*value.bare)], False))
    return sorted((kind, s, e, name, min(score, 1.0)) for (s, e), (kind, name, score) in found.items())


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text by start and kind; those of the method only where no base span holds them."""
    if not text:
        return []
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "name": None, "score": 1.0} for k, s, e in base]
    added = method_spans(text)
    if added:
        ends, far = [], 0
        for _, s, e in base:
            far = max(far, e)
            ends.append((s, far))
        i, far = 0, -1
        for kind, s, e, name, score in sorted(added, key=lambda x: x[1]):
            while i < len(ends) and ends[i][0] <= s:
                far, i = ends[i][1], i + 1
            if e > far:
                out.append({"kind": kind, "start": s, "end": e, "name": name, "score": score})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without their texts, with ``secrets``: ``(kind, start, end, name, score)`` of every span, in code points, ends exclusive.

    Null and empty texts have an empty array. Whole texts are read. A column ``secrets`` is replaced, others
    stay; repeated rows give equal arrays. No rows: no rows.
    """
    names = [c for c in docs.columns if c not in {text_col, "secrets"}]
    schema = docs.select(*names, F.lit(None).cast("array<struct<kind:string,start:int,end:int,name:string,score:double>>").alias("secrets")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([spans_of(t.as_py()) for t in b.column(len(names))], kind)], names=[*names, "secrets"])

    return docs.select(*names, F.col(text_col)).mapInArrow(run, schema)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every document; spans are written ``kind:start:end``, with commas."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda held: F.concat_ws(",", F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
