"""Secret scans with one combined deterministic automaton.

All rules are compiled to a single minimal automaton (see automaton.py); one table look-up per byte
serves every rule. A rule's match end comes from the automaton, its start from the rule's reversed
automaton, and its length condition is checked on the matched bytes alone.

Edge cases: null text counts as empty; empty text has no spans; repeated rows, null ids and extra
columns pass through; an empty table gives an empty result. Any length of text is scanned whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import free_name, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the group whose length counts, and that least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False


# The three base kinds of the output contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*", 0, 24),
)
# Published formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
MASK = b"[SECRET]"


@functools.lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]):
    from lexiloom.llm.automaton import backwards, combined

    table, events, final = combined([(r.pattern, r.fold) for r in rules])
    back = [backwards(r.pattern, r.fold) for r in rules]
    exact = [re.compile(r.pattern.encode(), re.IGNORECASE * r.fold) for r in rules]
    return table, events, final, back, exact


def scan(raw: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """Spans (start, rule number, end) in bytes, sorted; each rule's own do not overlap."""
    table, events, final, back, exact = _compiled(rules)
    state, ends = 0, []
    for at, byte in enumerate(raw):
        state = table[state + byte]
        if state < 0:
            state, mask = events[~state]
            ends.append((at, mask))
    if mask := final[state >> 8]:
        ends.append((len(raw), mask))
    spans, floor = [], [0] * len(rules)
    for end, mask in ends:
        for k, rule in enumerate(rules):
            if not mask >> k & 1:
                continue
            rows, accepts = back[k]
            s, at, start = 0, end, end
            while at > floor[k]:
                s = rows[s][raw[at - 1]]
                if s < 0:
                    break
                at -= 1
                if accepts[s]:
                    start = at
            floor[k] = end
            if rule.group:
                found = exact[k].fullmatch(raw[start:end])
                length = len(found[rule.group])
            else:
                length = end - start
            if length >= rule.least:
                spans.append((start, k, end))
    return sorted(spans)


def in_characters(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if not spans or raw.isascii():
        return spans
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(heads[a]), k, int(heads[b])) for a, k, b in spans]


def redacted(raw: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text with every span, overlapping ones joined, replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [raw[at:start], MASK]
        at = max(at, end)
    return b"".join([*out, raw[at:]])


FOUND = "struct<spans:array<struct<kind:string,start:bigint,end:bigint>>,redacted:binary>"


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = RULES, redact: bool = True) -> DataFrame:
    """Adds a struct of all spans (code points) and, if asked, of the redacted text, null where nothing was found."""
    kinds = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("spans", pa.list_(span)), ("redacted", pa.binary())])

    @F.arrow_udf(FOUND)
    def scanned(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in texts:
            raw = raw.as_py() or b""
            spans = scan(raw, rules)
            rows.append({
                "spans": [{"kind": kinds[k], "start": a, "end": b} for a, k, b in in_characters(raw, spans)],
                "redacted": redacted(raw, spans) if redact and spans else None,
            })
        return pa.array(rows, kind)

    return docs.withColumn(free_name(docs, out), scanned.asNondeterministic()(utf8(docs[text])))


def _listed(spans, kinds=None):
    """kind:start:end of the given kinds, comma-joined, in the order of the scan."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the base spans' digest, and all spans."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = find_secrets(kept, redact=False).select("doc_id", F.col("secrets.spans").alias("s"))
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in base]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("s"), base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans")
    )


def brute_digest(text: str | None) -> tuple[list[int], str]:
    """Counts and base digest of one text by plain regex search, for tests."""
    text, spans, counts = text or "", [], []
    for k, rule in enumerate(BASE_RULES):
        pattern = {"hex": r"[0-9a-f]+"}.get(rule.kind, rule.pattern)
        hits = [m for m in re.finditer(pattern, text, (re.IGNORECASE | re.ASCII) * rule.fold) if len(m[rule.group]) >= rule.least]
        counts.append(len(hits))
        spans += [(m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}") for m in hits]
    return counts, hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()
