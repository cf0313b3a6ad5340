"""Secret scans with multipart credential linking.

Base detectors find assignments of secret-like keywords, access identifiers and long hexadecimal runs; they are always
reported. Three weak detectors find parts that mean little alone: user or client identifiers (``id``), mixed 40-character
keys and values of vague keywords (``key``), and addresses (``endpoint``). A part's scope is the interval from ``scope``
code points before its start to ``scope`` after its end. Within a document, parts are joined with the complementary
parts whose spans meet their scope (an interval join by binary search over sorted starts and running ends): a weak key
is reported if an identifier meets its scope, a weak identifier if a key or base secret does, and an endpoint only if
both do. No pair is listed, so a document of n candidates costs n log n.

Documents never interact: nothing is shuffled. Null and empty texts have no spans. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of starts; the first three are base kinds.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
SPANS = "array<struct<kind:string,start:long,end:long>>"

_CI = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _CI)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters or more: a run's later starts are shorter
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
WEAK_ID = re.compile(r"""(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", _CI)
WEAK_KEY = re.compile(r"""(?:pwd|pass|auth|private_?key|signature|sas|key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", _CI)
KEY40 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9_.:@%-]+|(?:host|server|endpoint|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:-]{4,}""", _CI)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("id", m.start(1), m.end(1)) for m in WEAK_ID.finditer(text)]
    found += [("key", m.start(1), m.end(1)) for m in WEAK_KEY.finditer(text)]
    for m in KEY40.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s):
            found.append(("key", m.start(), m.end()))
    return found + [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]


def _meets(parts: np.ndarray, others: np.ndarray, scope: int) -> np.ndarray:
    """For each (start, end) of ``parts`` whether an interval of ``others`` meets it, widened by ``scope``."""
    if not len(parts) or not len(others):
        return np.zeros(len(parts), bool)
    others = others[np.argsort(others[:, 0], kind="stable")]
    reach = np.maximum.accumulate(others[:, 1])  # the largest end so far
    before = np.searchsorted(others[:, 0], parts[:, 1] + scope, "left")  # those that start before the scope's end
    return (before > 0) & (reach[np.maximum(before - 1, 0)] > parts[:, 0] - scope)


def link(base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], scope: int) -> list[tuple[str, int, int]]:
    """Base spans and the weak ones whose complementary parts co-occur, by start, then kind, then end."""
    out = set(base)
    if weak:
        at = lambda spans, *kinds: np.array([s[1:] for s in spans if s[0] in kinds], np.int64).reshape(-1, 2)
        taken = {s[1:] for s in base}
        weak = sorted({w for w in weak if w[1:] not in taken})
        ids = np.concatenate([at(base, "access"), at(weak, "id")])
        keys = np.concatenate([at(base, "assign", "hex"), at(weak, "key")])
        for kind, needs in (("key", (ids,)), ("id", (keys,)), ("endpoint", (ids, keys))):
            own = at(weak, kind)
            hit = np.ones(len(own), bool)
            for other in needs:
                hit &= _meets(own, other, scope)
            out.update((kind, int(a), int(b)) for a, b in own[hit])
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_text(text: str | None, scope: int) -> list[tuple[str, int, int]]:
    return link(base_spans(text), weak_spans(text), scope) if text else []


def secret_spans(text: Column, *, scope: int = 240) -> Column:
    """The secrets of a text, as an array of (kind, start, end)."""

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, scope)] for t in texts], dtype=object)

    return scan(text)


def scan_secrets(docs: DataFrame, *, text: str = "text", scope: int = 240, name: str = "secrets") -> DataFrame:
    """``docs`` with the array of its secrets' spans."""
    return docs.withColumn(name, secret_spans(F.col(text), scope=scope))


def redact(docs: DataFrame, *, text: str = "text", scope: int = 240, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; overlapping spans make one."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            parts, last = [], 0
            for _, a, b in scan_text(t, scope):
                if a >= last:
                    parts += [t[last:a], mask]
                last = max(last, b)
            out.append("".join([*parts, t[last:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, masked(F.col(text)))
