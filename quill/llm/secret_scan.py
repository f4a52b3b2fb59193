"""Operator 5: secret scans with multipart credential linking.

Strong spans come from three fixed patterns (assign, access, hex) and always count.
Weak parts are things that are no secret by themselves: identifiers (client or user
ids), opaque strings (16 or more characters of base64 or base64url with digits and both
cases, or of hex; 20 or more of one case with three digits) and endpoints (URLs,
host:port). Parts are joined by intervals: a weak part is reported only when its scope
holds a part of a complementary role. Scopes are a text's paragraphs (blank lines end
them), whatever their length; with `reach`, parts must also lie within that many code
points. An identifier's own value is no opaque string, and in a URL a string between
slashes must be opaque by itself. The roles: an identifier or an endpoint needs a secret (assign,
hex or opaque), an opaque string needs an identifier or an endpoint; access spans are
identifiers. The join runs over sorted starts with running ends, so a text with many
parts makes no pairs.

Null text: no spans. Repeated rows: each is scanned. An empty table gives no rows;
other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.common import slices, table

KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""\b(?:client_?id|user(?:name)?|login|account|tenant_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/=_-])", re.A)
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z]).{16}|[0-9a-f]{16,}=*\Z|[0-9A-F]{16,}=*\Z|(?=(?:[A-Za-z]*[0-9]){3})(?:[a-z0-9]{20,}|[A-Z0-9]{20,})=*\Z", re.A)
_ENDPOINT = re.compile(r"\b(?:https?|ftp|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}:[0-9]{2,5}\b", re.A)
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")
_SECRETS, _PLACES = {"assign", "hex", "opaque"}, {"access", "ident", "endpoint"}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each fixed pattern; assignments of values under 6 characters are dropped after they were passed."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class _Intervals:
    """Of parts sorted by start: does one that meets [start, end) exist? Running ends answer in one search."""

    def __init__(self, parts: list[tuple[int, int]]):
        parts = sorted(parts)
        self.starts, self.ends, most = [p[0] for p in parts], [], -1
        for _, end in parts:
            self.ends.append(most := max(most, end))

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def _opaque_spans(text: str, idents: _Intervals, endpoints: _Intervals) -> Iterator[tuple[str, int, int]]:
    for m in _OPAQUE.finditer(text):
        start, end = m.span()
        if idents.meets(start, end):
            continue
        runs = re.finditer("[^/]+", m[0]) if endpoints.meets(start, end) else [re.match(".*", m[0])]
        yield from (("opaque", start + r.start(), start + r.end()) for r in runs if _MIXED.match(r[0]))


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers, endpoints and opaque strings. A weak part that touches a base span is part of it and is left out."""
    taken = _Intervals([(s, e) for _, s, e in base])
    weak = [(kind, m.start(), m.end()) for kind, pattern in (("ident", _IDENT), ("endpoint", _ENDPOINT)) for m in pattern.finditer(text)]
    weak += _opaque_spans(text, *(_Intervals([w[1:] for w in weak if w[0] == kind]) for kind in ("ident", "endpoint")))
    return [w for w in weak if not taken.meets(w[1], w[2])]


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int | None = 200) -> list[tuple[str, int, int]]:
    """The weak parts that a complementary part makes credible."""
    weak = weak_parts(text, base)
    if not weak:
        return []
    cuts = [m.start() for m in _SCOPE_END.finditer(text)]
    scope = lambda at: bisect.bisect_right(cuts, at)
    secrets: dict[int, list] = {}
    places: dict[int, list] = {}
    for kind, start, end in base + weak:
        (secrets if kind in _SECRETS else places).setdefault(scope(start), []).append((start, end))
    found = ({k: _Intervals(v) for k, v in secrets.items()}, {k: _Intervals(v) for k, v in places.items()})
    out = []
    for kind, start, end in weak:
        other = found[kind in _SECRETS].get(scope(start))
        if other and (reach is None or other.meets(start - reach, end + reach)):
            out.append((kind, start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """A row for each row of (doc_id, text): doc_id, base and linked, both array<struct<kind, start, end>> by start and then kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base = [base_spans(t or "") for t in batch.column(1).to_pylist()]
            linked = [linked_spans(t or "", b, reach) for t, b in zip(batch.column(1).to_pylist(), base)]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in x], pa.list_(_SPAN)) for x in (base, linked)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "linked"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id long, base {spans}, linked {spans}")


def redact_secrets(docs: DataFrame, reach: int | None = None, mask: str = "[secret]") -> DataFrame:
    """The rows of docs with every found span replaced by `mask` and n_chars set anew; spans that overlap are masked as one. Rows without secrets, and null texts, stay as they are."""

    def clean(text: str) -> str:
        base = base_spans(text)
        out, at = [], 0
        for _, start, end in sorted(base + linked_spans(text, base, reach), key=lambda s: s[1:]):
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    @F.pandas_udf("string")
    def redacted(texts):
        return texts.map(clean, na_action="ignore")

    out = docs.withColumn("text", redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _by_start(spans: Column) -> Column:
    ordinal = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), ordinal(s).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(_by_start(F.concat("base", "linked"))).alias("spans"))
