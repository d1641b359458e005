"""Personal data by anchors: Aho-Corasick finds them, local parsers expand and validate each.

Anchors are at-signs, plus signs, digits, schemes (`://`) and identifier cues. Base kinds, leftmost and without
overlaps within a kind; a match that fails its check is dropped and its characters are not tried again:

- email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
- ip `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`, each part at most 255
- card `[0-9]([\\x20-]?[0-9])+`, 16 to 19 digits that pass the Luhn check
- phone `\\+[0-9][\\x20().0-9-]+[0-9]`, 8 to 15 digits

Added kinds: `url`, an address `scheme://user:password@host...` up to white space or a quote, and `account`, the
value of 6 or more letters and digits, a digit among them, behind an identifier cue (see `CUES`) and `:`, `=` or
`#`. Spans of different kinds may overlap. Positions are code points, ends exclusive. Null and empty texts have
no spans; repeated rows are scanned alike; extra columns are not read; an empty table gives an empty result. A
text of any length takes time linear in its length: a parser only reads on behind its own anchor, up to where the
next one of its kind starts, and the end of an address is found once for all schemes within it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import read_table

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

#: Words that announce an identifier; looked for in lower, upper and title case.
CUES = ("account", "acct", "api_key", "apikey", "iban", "passport", "passwd", "password", "secret", "ssn", "token")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_STOP = re.compile("[ \t\n\x0b\x0c\r\"'<>`]")

Span = tuple[str, int, int]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, ("digit" if c in _DIGITS else c, 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


_scanner: list[ahocorasick.Automaton] = []


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at` that starts at `floor` or later."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    n, end = len(text), at + 1
    while end < n and text[end] in _LABEL:
        end += 1
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < n and text[end] == "." and text[end + 1] in _LABEL:
        end += 2
        labels += 1
        while end < n and text[end] in _LABEL:
            end += 1
    return (start, end) if labels else None


def _phone(text: str, plus: int) -> tuple[int, int, int] | None:
    """(start, end, digits) of the number behind a plus sign."""
    n, i = len(text), plus + 1
    if i >= n or text[i] not in _DIGITS:
        return None
    digits, end, count = 1, -1, 1
    i += 1
    while i < n and text[i] in _PHONE:
        if text[i] in _DIGITS:
            digits += 1
            if i >= plus + 3:
                end, count = i + 1, digits
        i += 1
    return (plus, end, count) if end > 0 else None


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    k = 0
    while k + 3 < len(runs):
        four = runs[k : k + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            k += 4
            if all(e - s <= 3 or not text[s : e - 3].strip("0") for s, e in four) and all(int(text[max(s, e - 3) : e]) <= 255 for s, e in four):
                yield four[0][0], four[3][1]
        else:
            k += 1


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    k = 0
    while k < len(runs):
        last, digits = k, runs[k][1] - runs[k][0]
        while last + 1 < len(runs) and runs[last + 1][0] == runs[last][1] + 1 and text[runs[last][1]] in " -":
            last += 1
            digits += runs[last][1] - runs[last][0]
        if 16 <= digits <= 19 and _luhn("".join(text[s:e] for s, e in runs[k : last + 1])):
            yield runs[k][0], runs[last][1]
        k = last + 1


def _url_stop(text: str, at: int) -> int:
    """The end of what may be an address that goes on at `at`."""
    end = _STOP.search(text, at)
    return end.start() if end else len(text)


def _url(text: str, at: int, end: int) -> tuple[int, int] | None:
    """An address with user information; `at` is the place of `://` and `end` the end of the address."""
    start = at
    while start > 0 and text[start - 1] in _ALNUM:
        start -= 1
    slash = text.find("/", at + 3, end)
    user, sign, rest = text[at + 3 : slash if slash >= 0 else end].rpartition("@")
    return (start, end) if start < at and sign and ":" in user and rest[:1] in _ALNUM and rest else None


def _account(text: str, end: int) -> tuple[int, int] | None:
    """The value behind an identifier cue that ends at `end`."""
    n, i, sign = len(text), end, False
    while i < n and i < end + 8 and text[i] in " \t:=#\"'":
        sign |= text[i] in ":=#"
        i += 1
    if not sign:
        return None
    start = i
    while i < n and (text[i] in _ALNUM or text[i] in "_-"):
        i += 1
    value = text[start:i]
    return (start, i) if len(value) >= 6 and any(c in _DIGITS for c in value) else None


def spans_in(text: str) -> list[Span]:
    """(kind, start, end) of all kinds, by kind and then start."""
    if not _scanner:
        _scanner.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    runs: list[list[int]] = []
    email_end = phone_end = url_end = account_end = url_stop = 0
    for last, (what, width) in _scanner[0].iter(text):
        if what == "digit":
            if runs and runs[-1][1] == last:
                runs[-1][1] = last + 1
            else:
                runs.append([last, last + 1])
        elif what == "@":
            if got := _email(text, last, email_end):
                email_end = got[1]
                found["email"].append(got)
        elif what == "+":
            if last >= phone_end and (number := _phone(text, last)):
                phone_end = number[1]
                if 8 <= number[2] <= 15:
                    found["phone"].append(number[:2])
        elif what == "scheme":
            if last >= url_stop:
                url_stop = _url_stop(text, last + 1)
            if last >= url_end and (got := _url(text, last - width + 1, url_stop)):
                url_end = got[1]
                found["url"].append(got)
        elif last >= account_end and (got := _account(text, last + 1)):
            account_end = got[1]
            found["account"].append(got)
    digits = [(a, b) for a, b in runs]
    found["ip"].extend(_ips(text, digits))
    found["card"].extend(_cards(text, digits))
    return [(k, a, b) for k in KINDS for a, b in found[k]]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, pii: array of (kind, start, end) of the text, by kind and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_in(x)] if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], ["doc_id", "pii"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pii array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by `<KIND>` of its first span."""
    out, at, end = [], 0, -1
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], f"<{kind.upper()}>"]
        end = b
    return "".join(out) + text[max(end, 0) :]


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with the spans in `text` replaced by their kinds, and `n_chars`, where there is one, counted anew; null stays null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(x, s) if x and (s := spans_in(x)) else x for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(*kinds: str):
    return lambda x: x["kind"].isin(*kinds)


def op9(spark, sf_dir: str) -> DataFrame:
    got = find_pii(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return got.select("doc_id", *counts, F.sha2(_joined(F.filter("pii", _is(*BASE))), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))
