"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the 13-word windows of the benchmark items (an item of fewer words is one window).
Symbols are words. For each class of lengths, a shift table over blocks of two words tells how far
the search may jump; where the shift is zero, a bucket chosen by the suffix block, then by the
prefix block, lists the test strings to compare word by word.

Items are collected in blocks of bounded size. One block is broadcast and searched in the projection that
returns the rows. Of several, each is searched over all texts in a job of its own, which keeps the texts with
hits alone, by a digest; its broadcast goes before the next begins, so that no process ever holds two.
The hits of all blocks then join the rows.

Edge cases: null and empty texts have no words and are clean; null or wordless items have no
windows; an item with a null id still marks words but is not listed; repeated items count once by
id; repeated rows are judged one by one; an empty table on either side gives clean or no rows.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import free_name, fresh, utf8, words, write_shared

WINDOW = 13
#: Bytes of item text that one pass over the documents holds in memory.
BLOCK_BYTES = 4 << 20
MARKS = "struct<n_words:bigint,spans:array<int>,items:array<bigint>>"


class WuManber:
    """Searches word lists for test strings of one class of lengths."""

    def __init__(self, patterns: dict[tuple, set]) -> None:
        self.least = m = min(map(len, patterns))
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.buckets[pattern[m - b : m]][pattern[:b]].append((pattern, tuple(items)))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, text: list[bytes], spans: list[tuple[int, int]], items: set) -> None:
        m, b, n, shift, default = self.least, self.block, len(text), self.shift, self.default
        at = m
        while at <= n:
            key = tuple(text[at - b : at])
            jump = shift.get(key, default)
            if jump:
                at += jump
                continue
            start = at - m
            for pattern, found in self.buckets[key].get(tuple(text[start : start + b]), ()):
                if tuple(text[start : start + len(pattern)]) == pattern:
                    spans.append((start, start + len(pattern)))
                    items.update(found)
            at += 1


def compile_items(items: list[tuple[int | None, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each class of window lengths (1, 2-3, 4-7, 8 and more), so that short items keep no long ones from jumping."""
    classes: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, raw in items:
        tokens = words(raw)
        for start in range(max(1, len(tokens) - window + 1) if tokens else 0):
            part = tuple(tokens[start : start + window])
            classes[4 if len(part) == window else len(part).bit_length()][part] |= {item} - {None}
    return [WuManber(patterns) for patterns in classes.values()]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans, flat."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[int | None, bytes]]]]:
    """The number of blocks, and an iterator of them: lists of (id, bytes), each of about block_bytes at most, spread by hash."""
    rows = items.select(items[item_id].cast("long").alias("i"), utf8(items[text]).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.length("t") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n))
    return n, ([(r.i, bytes(r.t)) for r in part.collect()] for part in parts)


def mark_contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    out: str = "marks", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds a struct: the number of words, the disjoint hit spans [start, end, ...] in words, the ids of the items found."""
    context, out = docs.sparkSession.sparkContext, free_name(docs, out)
    n, blocks = item_blocks(items, item_id, item_text, block_bytes)
    if n == 1:
        search = _searching(context.broadcast(compile_items(next(blocks), window)))
        return docs.withColumn(out, search(utf8(docs[text]), F.lit(None).cast(MARKS)))
    key, found = fresh(docs, "text_digest", "text_hits")
    texts = docs.select(F.md5(utf8(docs[text])).alias("k"), utf8(docs[text]).alias("t")).where("t is not null")
    tables = []
    for block in blocks:
        shared = context.broadcast(compile_items(block, window))
        # Of equal texts one hit is enough.
        tables.append(write_shared(texts.mapInArrow(_finding(shared), _HITS).dropDuplicates(["k"]).hint("rebalance"), "hits")[0])
        shared.destroy()
    # At most one row for each text and block.
    hits = functools.reduce(DataFrame.union, tables).groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    hits = hits.select(F.col("k").alias(key), F.struct(F.lit(0).cast("long").alias("n_words"), "spans", "items").alias(found))
    joined = docs.join(hits, F.md5(utf8(docs[text])) == F.col(key), "left")
    return joined.withColumn(out, _searching(context.broadcast([]))(utf8(docs[text]), F.col(found))).drop(key, found)


_HITS = "k string, spans array<int>, items array<long>"


def _finding(shared):
    """Texts (k, t) to the hits of those that have any."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, all_spans, all_items = [], [], []
            for k, raw in zip(*batch.columns):
                spans, items = [], set()
                tokens = words(raw.as_py())
                for searcher in shared.value:
                    searcher.search(tokens, spans, items)
                if spans:
                    keys.append(k.as_py())
                    all_spans.append(merged(spans))
                    all_items.append(sorted(items))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.int64()))], ["k", "spans", "items"])

    return find


def _searching(shared):
    """The function that counts a text's words, searches for one broadcast block of items and adds hits found before."""
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])

    @F.arrow_udf(MARKS)
    def searched(texts: pa.Array, before: pa.Array) -> pa.Array:
        counts, all_spans, all_items = [], [], []
        for raw, old in zip(texts, before):
            tokens = words(raw.as_py() or b"")
            spans, items = [], set()
            for searcher in shared.value:
                searcher.search(tokens, spans, items)
            if old.is_valid:
                flat = old["spans"].as_py()
                spans += zip(flat[::2], flat[1::2])
                items.update(old["items"].as_py())
            counts.append(len(tokens))
            all_spans.append(merged(spans))
            all_items.append(sorted(items))
        columns = [pa.array(x, field.type) for x, field in zip((counts, all_spans, all_items), kind)]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return searched.asNondeterministic()


def n_hit(marks: str):
    """Words inside the spans of a struct of marks."""
    return F.expr(
        f"coalesce(aggregate(sequence(0, size({marks}.spans) - 2, 2), 0L, "
        f"(a, i) -> a + {marks}.spans[i + 1] - {marks}.spans[i]), 0L)"
    )


def hits(marks: str = "marks"):
    return F.when(F.size(F.col(f"{marks}.spans")) > 0, n_hit(marks)).otherwise(F.lit(0).cast("long"))


def contaminated(marks: str = "marks"):
    """The rule of contamination: at least one word in twenty is hit."""
    return (hits(marks) > 0) & (20 * hits(marks) >= F.col(f"{marks}.n_words"))


def digest(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, hit words, items found and their digest, and the verdict."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    marked = mark_contamination(kept, items, block_bytes=block_bytes).select("doc_id", "marks")
    ids = F.array_join(F.array_sort(F.transform("marks.items", lambda x: x.cast("string"))), ",")
    return marked.select(
        "doc_id",
        F.col("marks.n_words").alias("n_words"),
        hits().alias("n_hit"),
        F.size("marks.items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
p as (
  select distinct item_id, len(ws[s : s + 12]) as n, array_to_string(ws[s : s + 12], ' ') as k
  from (select item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) as s from b where len(ws) > 0)),
lens as (select distinct n from p),
g as (
  select doc_id, s, n, array_to_string(ws[s : s + n - 1], ' ') as k
  from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as s from w, lens where len(ws) >= n)),
m as (select g.doc_id, g.s, g.n, p.item_id from g join p on g.k = p.k and g.n = p.n),
h as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as i from m) group by 1),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join h using (doc_id) left join t using (doc_id)
"""
