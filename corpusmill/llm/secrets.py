"""Secret scanning with one combined automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, Rule
from .utf8 import rows

#: The base rules (fixed values).
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", least_tail=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{8,}", least=32),  # as many states as it takes to have few false starts
)
#: Public formats of other tokens and keys, which add spans (fixed values).
FORMATS = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x0A\x0D]*-----END [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + FORMATS


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    """Compiled once, in the driver."""
    return Automaton(rules)


def _spans(shared, kinds: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            out, texts = [], list(rows(batch.column(1)))
            for raw, found in zip(texts, machine.scan_all(texts), strict=True):
                if found and not raw.max() < 128:  # bytes to code points
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
                out.append([{"kind": kinds[k], "start": a, "end": b} for a, k, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "spans"],
            )

    return scan


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document's secrets: doc_id, spans (kind, start, end; code points).

    Takes ``doc_id`` and ``text``; other columns are ignored. All rules'
    regexes are one automaton that reads each byte of the whole text once; it
    tells where matches end, and only the bytes of a match are read again,
    backwards, for where it begins. Matches of a kind are leftmost and do not overlap; spans are by start, then
    rule. Null and empty texts have none. Repeated rows are scanned as rows.
    An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(automaton(tuple(rules)))  # as large as the rules make it
    return docs.select("doc_id", "text").mapInArrow(
        _spans(shared, [r.kind for r in rules]), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>"
    )


def redacted(text: str | None, spans: list[dict], mark: str = "[{kind}]") -> str:
    """The text with each span replaced; overlapping spans become one."""
    out, at, text = [], 0, text or ""
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] > at:
            if s["start"] >= at:
                out += [text[at : s["start"]], mark.format(kind=s["kind"])]
            at = s["end"]
    return "".join([*out, text[at:]])


def brute_force(text: str | None, formats: bool = False) -> list[tuple[int, str, int]]:
    """The spans by Python's regex engine, for tests: base kinds, or with ``formats`` all."""
    import re

    text, out = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    for k, rule in enumerate(FORMATS if formats else (), 3):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule.regex, text) if len(m[0]) >= rule.least]
    return [(a, RULES[k].kind, b) for a, k, b in sorted(out)]


def digest(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
