"""Secret scans through an incremental blob ledger (operator 4).

Every version of every document is content-addressed: its blob is the SHA-256 of the
text. The ledger holds (digest, version, spans) for each pair of blob and rule version
that was ever scanned. A scan looks at pairs that are not there, appends what it found,
and joins the findings back to all rows that hold the blob. Copies and earlier versions
of the corpus cost a join; a changed rule set has another version and is scanned anew.

Spans are in code points, end exclusive. Matches of a kind are leftmost and do not
overlap; those that are too short are dropped after matching. Null texts count as empty,
which hold no secret. Repeated rows, null ids and ids that occur twice are answered row
by row. A text of any length is scanned whole, in time linear in its length. An empty
table gives an empty result; other columns pass through `redact` and
are ignored by `scan`.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarium.llm.common import (
    CHUNK_BYTES,
    chunks,
    column,
    complete_ledger,
    content_digest,
    fresh,
    id_and_text,
    map_batches,
    new_path,
    whole_text,
)


#: Bytes of findings up to which they are broadcast to all rows, so that no text is shuffled.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    either_case: bool = False
    #: Literal text without which there is no match; spares most texts the pattern.
    needs: tuple[str, ...] = ()
    #: What the run of `head_characters` that ends where the pattern begins must hold, and so many characters behind it.
    #: Looking back from the few places where the pattern fits keeps long texts linear.
    head: str = ""
    head_characters: str = ""
    behind_head: int = 0


BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        either_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, needs=("AKIA",)),
    Rule("hex", r"[0-9a-f]+", least=32),
)

#: Formats that issuers document themselves.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", needs=("PRIVATE KEY-----",)),
    Rule(
        "jwt",
        r"\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
        needs=(".eyJ",),
        head="eyJ",
        head_characters=string.ascii_letters + string.digits + "_-",
        behind_head=8,
    ),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{0,256}:[^\s/@]++@", needs=("://",)),
)
RULES = BASE + MORE


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def _compiled(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.either_case else 0))) for r in rules]


def _matches(text: str, rule: Rule, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap."""
    if not rule.head:
        for match in pattern.finditer(text):
            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                yield match.start(), match.end()
        return
    allowed, free, match = frozenset(rule.head_characters), 0, pattern.search(text)
    while match:
        start = match.start()
        while start > free and text[start - 1] in allowed:
            start -= 1
        start = text.find(rule.head, start, max(0, match.start() - rule.behind_head))
        if start >= 0:
            yield start, match.end()
            free = match.end()
        match = pattern.search(text, match.end() if start >= 0 else match.start() + 1)


def find_spans(text: str, compiled: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the rules' order."""
    found = []
    for place, (rule, pattern) in enumerate(compiled):
        if rule.needs and not any(part in text for part in rule.needs):
            continue
        found += [(start, place, end) for start, end in _matches(text, rule, pattern)]
    return [(compiled[place][0].kind, start, end) for start, place, end in sorted(found)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scanning(rules: tuple[Rule, ...], version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(rules)
        for batch in chunks(batches, 1, CHUNK_BYTES):
            spans = [joined(find_spans(text.as_py() or "", compiled)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(spans), pa.string()), pa.array(spans, pa.string())],
                ["digest", "version", "spans"],
            )

    return run


def _findings(texts: DataFrame, ledger_path: str | None, rules: tuple[Rule, ...]) -> DataFrame:
    version = rules_version(rules)
    path = ledger_path or new_path(texts.sparkSession, "blob-ledger")
    return complete_ledger(texts, path, version, "spans string", _scanning(rules, version))


def scan(
    docs: DataFrame,
    ledger_path: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, digest, spans): spans is kind:start:end, comma-joined.

    ledger_path keeps findings between runs; without it, the ledger serves this call alone.
    """
    texts = id_and_text(docs, id_column, text_column).withColumn("digest", content_digest(F.col("text")))
    return texts.select("doc_id", "digest").join(_findings(texts, ledger_path, rules), "digest").select("doc_id", "digest", "spans")


def of_kinds(spans, kinds: tuple[str, ...]):
    """Of a spans column, the entries of some kinds, as an array."""
    each = F.filter(F.split(spans, ","), lambda s: F.substring_index(s, ":", 1).isin(*kinds))
    return F.when(spans == "", F.array().cast("array<string>")).otherwise(each)


def redacted(text: str, spans: str) -> str:
    """The text with each span, or run of spans that overlap, replaced by the kind of the first."""
    parts, at = [], 0
    for entry in spans.split(",") if spans else ():
        kind, start, end = entry.split(":")
        if int(start) >= at:
            parts += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join(parts) + text[at:]


def redact(
    docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, text_column: str = "text"
) -> DataFrame:
    """All rows and columns; secrets in the texts are replaced by the name of their kind.

    Only blobs with findings are joined to the rows, and texts without are left alone. The
    findings are broadcast if they are counted to be at most BROADCAST_BYTES; beyond
    that, rows and findings are joined by shuffle, and Spark splits a hot digest.
    """
    digest, spans = fresh(docs.columns, "digest", "spans")
    keyed = docs.withColumn(digest, content_digest(whole_text(text_column)))
    texts = keyed.select(column(digest).alias("digest"), whole_text(text_column).alias("text"))
    found = _findings(texts, ledger_path, rules).filter(F.col("spans") != "")
    size = found.agg(F.sum(F.length("spans") + 64)).first()[0] or 0
    found = found.select(F.col("digest").alias(digest), F.col("spans").alias(spans))
    rows = keyed.join(found.hint("broadcast" if size <= BROADCAST_BYTES else "merge"), digest, "left")
    at, width = docs.columns.index(text_column), len(docs.columns)
    rows = rows.select(*map(column, docs.columns), column(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:width])
            if batch.column(width).null_count < batch.num_rows:
                pairs = zip(columns[at].to_pylist(), batch.column(width).to_pylist(), strict=True)
                columns[at] = pa.array([redacted(t, s) if s else t for t, s in pairs], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:width])

    return map_batches(rows, run, docs.schema)
