"""Personal data by anchor expansion: one automaton finds anchors, local parsers expand and validate around them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.session import free_name, ship, table

#: Base kinds in the order in which ties are listed; the method adds the others.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_STRETCH = re.compile(r"[^\s<>\"'`{}|\\^]*")
_HOST = re.compile(r"[^\s<>\"'`{}|\\^/?#]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_AFTER_CUE = re.compile(r"(?:[ \t]*(?:[:#=.]|\b(?:no|nr|num|number|id|is)\b\.?))*[ \t]*", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z0-9](?:[ -]?[A-Za-z0-9])*")
_AFTER_SECRET = re.compile(r"[\"']?[ \t]{0,4}(?:[:=]|=>|\bis\b)[ \t]{0,4}[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9+/_.~-]{8,200}")
_KEY_ID = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_CLOSING = ".,;:!?)]*_"
_SCHEMES = ("http://", "https://", "ftp://", "mailto:")
_CUES = ("account", "acct", "iban", "konto", "kontonummer", "cuenta", "compte", "ssn", "passport", "customer id", "user id")
_SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "private_key")
_KEY_IDS = ("AKIA", "ASIA")
#: A cue's connectors and its identifier lie within so many characters, each.
_NEAR = 64


def _anchors() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    made.add_word("@", ("at", 1))
    made.add_word("+", ("plus", 1))
    for digit in "0123456789":
        made.add_word(digit, ("digit", 1))
    for kind, cues in (("scheme", _SCHEMES), ("cue", _CUES), ("secret", _SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                made.add_word(form, (kind, len(form)))
    for form in _KEY_IDS:
        made.add_word(form, ("key", len(form)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    """Expand each at-sign to both sides; a match ends before the next one may begin."""
    out, free = [], 0
    for at in ats:
        if at < free:
            continue
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
    return out


def ips(text: str, digits: list[int]) -> list[tuple[str, int, int]]:
    """From each first digit of a run, four numbers with dots between, each at most 255."""
    out, free = [], 0
    for at in digits:
        if at >= free and not (at > free and "0" <= text[at - 1] <= "9"):
            m = _IP.match(text, at)
            if m:
                free = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out.append(("ip", at, free))
    return out


def cards(text: str, digits: list[int]) -> list[tuple[str, int, int]]:
    out, free = [], 0
    for at in digits:
        m = _CARD.match(text, at) if at >= free else None
        if m:
            free = m.end()
            number = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(number) <= 19 and luhn(number):
                out.append(("card", at, free))
    return out


def phones(text: str, pluses: list[int]) -> list[tuple[str, int, int]]:
    out, free = [], 0
    for at in pluses:
        m = _PHONE.match(text, at) if at >= free else None
        if m:
            free = m.end()
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", at, free))
    return out


def pages(text: str, schemes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Addresses of pages: a scheme expands to the next blank or quote, without closing punctuation; its host must have
    a dot. Schemes inside an address are part of it, and a stretch and its host are measured once for all schemes in them."""
    out, free, stop, trimmed, host, last, named = [], 0, -1, -1, -1, -1, False
    for start, end in schemes:
        if start < free or (start and text[start - 1].isalnum()):
            continue
        if end > stop:
            trimmed = stop = _STRETCH.match(text, end).end()
            while trimmed > end and text[trimmed - 1] in _CLOSING:
                trimmed -= 1
        if end > host:  # all schemes before the host's end share it, and what follows its last at-sign
            host = _HOST.match(text, end, max(end, trimmed)).end()
            last = text.rfind("@", end, host)
            named = last >= 0 and bool(_DOMAIN.match(text, last + 1, host))
        if trimmed > end and (named if last >= end else _DOMAIN.match(text, end, host)):
            out.append(("url", start, trimmed))
            free = trimmed
    return out


def _account(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """A cue as a word of its own, a few connectors, then an identifier with six digits or more."""
    if (start and text[start - 1].isalnum()) or text[end : end + 1].isalpha():
        return None
    at = _AFTER_CUE.match(text, end, end + _NEAR).end()
    iban = _IBAN.match(text, at)
    if iban:
        for stop in sorted({m.end() for m in re.finditer(r"(?=( |$))", iban[0])} | {len(iban[0])}, reverse=True):
            if stop and iban_ok(iban[0][:stop]):
                return ("iban", at, at + stop)
    token = _TOKEN.match(text, at, at + _NEAR)
    if token and at > end:
        stop = 0  # pieces up to the first that has no digit
        for piece in re.finditer(r"[A-Za-z0-9]+", token[0]):
            if not any(c.isdigit() for c in piece[0]):
                break
            stop = piece.end()
        if stop <= 34 and sum(c.isdigit() for c in token[0][:stop]) >= 6:
            return ("account", at, at + stop)
    return None


def _secret(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """A cue, a sign of assignment, then a word of eight or more characters with a digit."""
    if (start and text[start - 1].isalpha()) or text[end : end + 1].isalnum():
        return None
    after = _AFTER_SECRET.match(text, end)
    value = _SECRET.match(text, after.end()) if after else None
    return ("secret", *value.span()) if value and any(c.isdigit() for c in value[0]) else None


def _key(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The fixed begin of a key id as a word of its own, and sixteen capitals or digits."""
    rest = None if start and text[start - 1].isalnum() else _KEY_ID.match(text, end)
    return ("secret", start, rest.end()) if rest else None


_PARSERS = {"cue": _account, "secret": _secret, "key": _key}


def spans_of(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, base)`` by start, then kind; offsets count code points, the end is exclusive.

    Anchors are found in one pass. Each parser begins at its anchors and, but for bounded stretches, never looks at what
    it has read before, so the time grows with the text.
    """
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {}
    for end, (kind, size) in anchors.iter(text):
        found.setdefault(kind, []).append((end - size + 1, end + 1))
    digits = [at for at, _ in found.get("digit", ())]
    base = [("email", s, e) for s, e in emails(text, [at for at, _ in found.get("at", ())])]
    base += ips(text, digits) + cards(text, digits) + phones(text, [at for at, _ in found.get("plus", ())])
    added = set(pages(text, sorted(found.get("scheme", ()))))
    added |= {x for kind, parse in _PARSERS.items() for at, end in found.get(kind, ()) if (x := parse(text, at, end))}
    ends: list[int] = []  # of base spans run together, to see which added ones meet one
    starts: list[int] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    rows = [(*x, True) for x in base]
    for x in added:
        k = bisect_left(starts, x[2]) - 1
        if k < 0 or ends[k] <= x[1]:
            rows.append((*x, False))
    return sorted(rows, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``spans``: personal data in the whole text of every row (null or empty text: none).

    Long texts are read once from end to end. Repeated rows, ties and null ids are treated as any other; an empty table
    gives none; further columns pass through. An existing column named ``spans`` is replaced.
    """
    ship(docs.sparkSession)

    @F.arrow_udf(_SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = _anchors()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for texts in batches:
            yield pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans_of(x.as_py(), anchors)] for x in texts], kind)

    return docs.withColumn("spans", find(F.col("text")))


#: What is masked; an address of a page is not personal in itself.
MASKED = tuple(k for k in KINDS if k != "url")


def mask(docs: DataFrame, kinds: tuple[str, ...] = MASKED) -> DataFrame:
    """The columns of ``docs`` with each span of ``text`` replaced by its kind in brackets; spans that overlap merge."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = _anchors()
        for texts in batches:
            out = []
            for text in texts:
                x, at, parts = text.as_py(), 0, []
                for kind, start, end, _ in spans_of(x, anchors):
                    if kind not in kinds:
                        continue
                    if start >= at:
                        parts += [x[at:start], f"[{kind.upper()}]"]
                    at = max(at, end)
                out.append(x if x is None else "".join([*parts, x[at:]]))
            yield pa.array(out, pa.string())

    name = free_name("masked", docs)  # the optimizer would otherwise run the function for each use of the column
    return docs.withColumn(name, masked(F.col("text"))).select(*[F.col(name).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
