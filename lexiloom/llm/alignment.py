"""Alignment of two tokenizations of a text: where both cut, which tokens overlap, and how usual each overlap is.

Tokenizer A is a byte-level BPE (a tokenizers JSON file), B a SentencePiece BPE with byte fallback. A text is encoded with a space before it, which
B adds by itself. Byte offsets at which tokens of both end cut the tokens into groups; two tokens are linked if their bytes overlap. The
count of a pair of ids is how many links of the whole corpus hold it.

The relational part runs on stretches: pieces of text that begin at a space after a visible character. A cuts before such a
space whatever stands around it, as its pattern takes a space only in front of a word or among white space; B does, as none of
its pieces has a space inside. So both tokenizations of a text are those of its stretches, one after the other, and equal
stretches are aligned once, with their number in the corpus. Tokens are exploded with their places, ends are windowed sums of lengths, tokens
of A and B with one stretch and end meet in a group-by (a full outer equi-join that needs no second shuffle), groups are numbered by a running count of cuts, and
links come from the same window: every distinct end closes exactly one link, that of the next token of A and of B that ends there or behind. So
links are never paired up within a group, and a group of any length takes linear work. Pairs are counted over all links, weighted by
the stretches' numbers, and joined back. A sorted aggregate keeps the windows' order instead of hashing, which would sort anew.

How it scales. Texts are coded in chunks of about CHUNK_BYTES: a chunk sends each of its distinct stretches once, with a count, however often it
occurs, and gets their alignments back by stretch; a chunk's codes and its stretches meet in one group of bounded size. Up to BROADCAST_PAIRS pairs are sent to all
executors; joins by more are salted, as a few pairs stand in many stretches. Nothing goes through the driver but the tokenizers' files, which it sends to all executors (about 3 MB).

Edge cases: texts that are null, empty, not UTF-8, or that a tokenizer does not give back byte by byte (with these files: those
with U+2581) have no tokens and no part in counts: zeros, and an empty string for groups. Special tokens' strings are text. Repeated rows count each; null ids stay null;
extra columns are not carried; an empty table gives an empty result. A model with a space inside a piece is refused, as is one that changes texts in other ways.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import delete_shared, write_shared

#: Folder of the tokenizers' files, and their names.
TOKENIZERS, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a chunk; and how many pairs with their counts (24 bytes each) are sent to all executors; of more, each is copied SALTS times and its links are dealt among the copies.
CHUNK_BYTES, BROADCAST_PAIRS, SALTS = 12 << 20, 1 << 19, 8
#: Codes of documents that are looked at together.
BLOCK_CODES = 1 << 20
#: A pair of ids is one number, with B's id in the lower bits.
B_BITS = 24
MARK = "▁"
MARK_BYTES = MARK.encode()
# The ends of white space beyond ASCII in UTF-8, behind which no stretch begins.
SPACES = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E, 0x200B, 0x2060, 0xFEFF))


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        # A byte stands for itself if it is printable, else for the next free code point from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(back[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space inside, so that texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = tuple(np.array([len(x) for x in spelled], np.int64) for spelled in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id(MARK)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and B of texts that begin with a space."""
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [ids if len(t) > 1 else [self.blank] for ids, t in zip(b, texts)]

    def restored(self, text: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join([self.a_bytes[i] for i in a]) == text == b"".join([self.b_bytes[i] for i in b])


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(files) -> Pair:
    """The tokenizers of broadcast files, loaded once in a process."""
    a, b = files.value
    key = (hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest())
    if key not in _PAIRS:
        _PAIRS[key] = Pair(a, b)
    return _PAIRS[key]


def read_files(a_path: str, b_path: str) -> tuple[bytes, bytes]:
    """The tokenizers' files, read where the plan is built."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = a.read(), b.read()
    if json.loads(files[0])["pre_tokenizer"] is None:
        raise ValueError("tokenizer A has to cut words before it merges bytes")
    return files


def stretch_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches begin in the bytes of texts that each begin with a space; starts: where the texts begin."""
    after, before = data[1:] == 32, data[:-1]
    cut = np.flatnonzero(after & (before > 32) & (before != 127))
    for space in SPACES:
        last = np.frombuffer(space, np.uint8)
        hit = before[cut] == last[-1]
        for k in range(1, len(last)):
            hit &= data[np.maximum(cut - k, 0)] == last[-1 - k]
        cut = cut[~hit]
    is_start = np.zeros(len(data), bool)
    is_start[cut + 1] = True
    is_start[starts] = True
    return np.flatnonzero(is_start)


def _encodable(text: str | bytes, pair: Pair) -> bool:
    """Whether both tokenizers give a text back, for texts of which that is not certain."""
    try:
        text = text.decode() if isinstance(text, bytes) else text
    except UnicodeDecodeError:
        return False
    (a,), (b,) = pair.encode([" " + text])
    return pair.restored((" " + text).encode(), a, b)


def code_chunk(ids: pa.Array, texts: list[bytes | None], pair: Pair, number: int, schema: pa.Schema) -> pa.RecordBatch:
    """One row: ids of documents, stretches of each, all their codes, and the chunk's distinct stretches with their counts."""
    kept = []
    for text in texts:
        if text and (MARK_BYTES in text or not _valid(text)) and not _encodable(text, pair):
            text = None
        kept.append(b" " + text if text else b"")
    sizes = np.fromiter((len(t) for t in kept), np.int64, len(kept))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(kept), np.uint8)
    if not len(data):
        codes, distinct, counts, per_doc = np.zeros(0, np.int32), [], [], np.zeros(len(kept), np.int32)
    else:
        starts = stretch_starts(data, (ends - sizes)[sizes > 0])
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        raw = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(raw)
        # Frequent stretches get small codes, which compress well.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        codes, counts, distinct = rank[raw], counts[order], coded.dictionary.take(pa.array(order))
        upto = np.searchsorted(starts, ends)
        per_doc = np.diff(np.concatenate([[0], upto])).astype(np.int32)
    packed = pa.compress(codes.tobytes(), codec="zstd", asbytes=True)
    row = {
        "chunk": pa.array([number], pa.int64()), "ids": pa.ListArray.from_arrays([0, len(ids)], ids), "sizes": pa.array([per_doc.tobytes()], pa.binary()),
        "codes": pa.array([packed], pa.binary()), "n_codes": pa.array([len(codes)], pa.int64()),
        "stretches": pa.ListArray.from_arrays([0, len(distinct)], pa.array(distinct, pa.binary()).cast(pa.string())), "counts": pa.array([np.asarray(counts, np.int64)], pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_arrays([row[f.name].cast(f.type) for f in schema], schema=schema)


def _valid(text: bytes) -> bool:
    if text.isascii():
        return True
    try:
        text.decode()
        return True
    except UnicodeDecodeError:
        return False


def chunks(docs: DataFrame, files, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents coded in chunks of about so many bytes, each of one partition: see code_chunk."""
    from pyspark import TaskContext

    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    of_id = rows.schema["id"].dataType.simpleString()
    fields = f"chunk long, ids array<{of_id}>, sizes binary, codes binary, n_codes long, stretches array<string>, counts array<long>"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number, schema = _pair(files), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            if schema is None:
                id_type = batch.schema.field("id").type
                kinds = (pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
                schema = pa.schema([(f.split()[0], t) for f, t in zip(fields.split(", "), kinds)])
            raws = batch.column("text").to_pylist()
            at = size = 0
            for i, raw in enumerate(raws):
                size += len(raw or b"")
                if size >= chunk_bytes or i == len(raws) - 1:
                    yield code_chunk(batch.column("id").slice(at, i + 1 - at), raws[at : i + 1], pair, number, schema)
                    number, at, size = number + 1, i + 1, 0

    return rows.mapInArrow(coded, fields)


def encode_stretches(pair: Pair, stretches: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For A and B: all ids of these stretches, and how many tokens each has. Stretches are encoded as one text, apart from those behind which none may begin."""
    data = np.frombuffer(b"".join(stretches), np.uint8)
    ends = np.cumsum([len(x) for x in stretches])
    begins = np.zeros(len(data) + 1, bool)
    begins[stretch_starts(data, np.zeros(1, np.int64))] = True
    begins[-1] = True
    alone = np.flatnonzero(~begins[ends])
    alone = np.append(alone, len(stretches) - 1) if len(alone) and alone[-1] < len(stretches) - 1 else alone
    joined = np.setdiff1d(np.arange(len(stretches)), alone)
    texts = [b"".join([stretches[i] for i in joined])] * bool(len(joined)) + [stretches[i] for i in alone]
    coded = pair.encode([t.decode() for t in texts])
    if not all(pair.restored(t, a, b) for t, a, b in zip(texts, *coded)):
        raise ValueError("a tokenizer does not give a text back")
    sizes = np.array([len(x) for x in stretches], np.int64)
    out_ids, out_counts = [], []
    for ids, spelled in zip(coded, pair.sizes):
        counts, parts = np.zeros(len(stretches), np.int64), [None] * len(stretches)
        if len(joined):
            flat = np.array(ids[0], np.int32)
            at = np.concatenate([[0], np.searchsorted(np.cumsum(spelled[flat]), np.cumsum(sizes[joined]), "left") + 1])
            counts[joined] = np.diff(at)
        if not len(alone):
            out_ids.append(flat)
        else:
            for k, i in enumerate(joined):
                parts[i] = flat[at[k] : at[k + 1]]
            for k, i in enumerate(alone):
                parts[i] = np.array(ids[k + bool(len(joined))], np.int32)
                counts[i] = len(parts[i])
            out_ids.append(np.concatenate(parts))
        out_counts.append(counts)
    return out_ids, out_counts


def tokenized(stretches: DataFrame, files) -> DataFrame:
    """(sid, stretch, n, t) of (stretch, n): sid is a number, to be stored, and t has the ids of A and B and their bytes (a, a_len, b, b_len)."""
    listed, short = pa.list_(pa.int32()), pa.list_(pa.int16())
    kind = pa.struct([("a", listed), ("a_len", short), ("b", listed), ("b_len", short)])

    @F.arrow_udf("struct<a: array<int>, a_len: array<short>, b: array<int>, b_len: array<short>>")
    def tokens(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], kind)
        pair, fields = _pair(files), []
        for flat, counts, spelled in zip(*encode_stretches(pair, texts.cast(pa.binary()).to_pylist()), pair.sizes):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            fields += [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (flat, spelled[flat].astype(np.int16))]
        return pa.StructArray.from_arrays(fields, fields=list(kind))

    return stretches.select(F.monotonically_increasing_id().alias("sid"), "stretch", "n", tokens("stretch").alias("t"))


def exploded(stored: DataFrame) -> DataFrame:
    """(sid, kind, pos, id, bytes, stretch, n): the tokens of every stretch, kind 0 of A and 1 of B; and a row of kind 2 with the stretch and its number, which no other row has.

    Stretches are dealt by sid while their tokens are one row: all that is keyed by sid and more, from here on, needs no other exchange.
    """
    no_text = (F.lit(None).cast("string").alias("stretch"), F.lit(None).cast("long").alias("n"))
    kinds = [F.struct(F.lit(i).alias("kind"), F.col(f"t.{k}").alias("ids"), F.col(f"t.{k}_len").alias("lens"), *no_text) for i, k in enumerate("ab")]
    own = F.struct(F.lit(2).alias("kind"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<short>").alias("lens"), F.col("stretch"), F.col("n"))
    by_kind = stored.repartition("sid").select("sid", F.explode(F.array(*kinds, own)).alias("k"))
    rows = by_kind.select("sid", "k.kind", "k.stretch", "k.n", F.posexplode_outer(F.arrays_zip("k.ids", "k.lens")).alias("pos", "x"))
    return rows.select("sid", "kind", "pos", F.col("x.ids").alias("id"), F.col("x.lens").alias("bytes"), "stretch", "n")


def aligned(tokens: DataFrame) -> DataFrame:
    """(sid, stretch, n, n_a, n_b, n_groups, groups, links) of tokens as above; groups as text, links as pairs of ids."""
    key = ["sid"]
    before = Window.partitionBy(*key, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = tokens.withColumn("end", F.when(F.col("kind") < 2, F.sum("bytes").over(before)).otherwise(-1))
    met = ends.groupBy(*key, "end", "stretch").agg(*[F.max(F.when(F.col("kind") == i, F.col("id"))).alias(k) for i, k in enumerate("ab")], F.max("n").alias("n"))
    back = Window.partitionBy(*key).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    linked = met.select(
        *key, "end", "a", "b", "stretch", "n", F.sum(cut.cast("int")).over(back).alias("group"),
        (F.last("a", True).over(back).cast("long") * (1 << B_BITS) + F.last("b", True).over(back)).alias("link"),
    )
    # Groups are numbered from the end; ids of a group are written A first, and within A and B in the order of their ends.
    item = lambda r, i, k: F.struct((-r["group"]).alias("group"), F.lit(i).alias("kind"), r["end"].alias("end"), r[k].alias("id"))
    items = lambda rows: F.array_sort(F.filter(F.flatten(F.transform(rows, lambda r: F.array(item(r, 0, "a"), item(r, 1, "b")))), lambda x: x["id"].isNotNull()))

    def written(order: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.get(order, i - 1)
            mark = F.when(i == 0, "").when(last["group"] != x["group"], ";").when(last["kind"] != x["kind"], "|").otherwise(",")
            return F.concat(mark, x["id"].cast("string"))

        return F.array_join(F.transform(order, one), "")

    row = F.when(F.col("end") >= 0, F.struct("group", "end", "a", "b", "link"))
    whole = linked.groupBy(*key).agg(
        F.max("stretch").alias("stretch"), F.max("n").alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max("group").alias("n_groups"), F.collect_list(row).alias("rows")
    )
    text = F.get(F.transform(F.array(items(F.col("rows"))), written), F.lit(0))
    return whole.select("sid", "stretch", "n", "n_a", "n_b", "n_groups", text.alias("groups"), F.transform("rows", lambda r: r["link"]).alias("links"))


def pair_counts(stretches: DataFrame) -> DataFrame:
    """(pair, a, b, count, best) of aligned stretches: links of the corpus that hold the pair, and whether no pair with the same b has more."""
    counts = stretches.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1).cast("int")
    told = counts.select("pair", F.shiftright("pair", B_BITS).cast("int").alias("a"), b.alias("b"), "count")
    return told.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def scored(stretches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Aligned stretches (with their number, sid) and, of their links, how many are the best of their b, and the sum of their counts."""
    whole = F.struct("stretch", "n_a", "n_b", "n_groups", "groups")  # of its links, n_a + n_b - n_groups, the number is known
    # A stretch's first link carries what else is known of it, so that it needs no join of its own.
    links = stretches.select("sid", whole.alias("whole"), F.posexplode("links").alias("at", "pair"))
    links = links.select("sid", F.when(F.col("at") == 0, F.col("whole")).alias("whole"), "pair")
    told = pairs.select("pair", "count", "best")
    if pairs.count() <= BROADCAST_PAIRS:
        joined = links.join(F.broadcast(told), "pair")
    else:
        salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = links.withColumn("salt", F.pmod("sid", F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = joined.groupBy("sid").agg(
        F.max("whole").alias("whole"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum")
    )
    return sums.select("whole.*", "n_best", "count_sum")


#: What is added up over a document's stretches.
SUMS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
#: Of these, what is not told by the groups' text.
SENT = ("n_a", "n_best", "count_sum")


def used_stretches(coded: DataFrame, stretches: DataFrame) -> DataFrame:
    """(of_chunk, code) and the scores of every chunk's stretches."""
    held = coded.select(F.col("chunk").alias("of_chunk"), F.posexplode("stretches").alias("code", "stretch"))
    return held.join(stretches, "stretch").select("of_chunk", "code", *SENT, "groups")


def gathered(coded: DataFrame, used: DataFrame, as_text: bool) -> DataFrame:
    """A row for each document of the chunks, from the scores of their stretches."""
    of_id = coded.schema["ids"].dataType.elementType
    schema = f"doc_id {of_id.simpleString()}, {', '.join(f'{c} long' for c in SUMS)}, groups string"

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pa.array(np.argsort(right.column("code").to_numpy()))
        values = {c: right.column(c).take(order).to_numpy() for c in SENT}
        written = right.column("groups").take(order)
        groups_, commas = (pc.count_substring(written, x).to_numpy().astype(np.int64) for x in "|,")
        # A group has a list of each, and a list has a comma less than ids.
        values |= {"n_groups": groups_, "n_b": commas + 2 * groups_ - values["n_a"]}
        texts, out = written.to_pylist(), []
        for row in left.select(["sizes", "codes", "n_codes"]).to_pylist():
            codes = np.frombuffer(pa.decompress(row["codes"], 4 * row["n_codes"], codec="zstd", asbytes=True), np.int32) if row["n_codes"] else np.zeros(0, np.int32)
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int32).astype(np.int64))])
            sums, groups, at = {c: [] for c in SUMS}, [], 0
            while at < len(ends) - 1:
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_CODES, "right")) - 1)
                block, cuts = codes[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at]
                for c in SUMS:
                    total = np.concatenate([[0], np.cumsum(values[c][block])])
                    sums[c].append(total[cuts[1:]] - total[cuts[:-1]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    text = ";".join([texts[i] for i in block[a:b].tolist()])
                    groups.append(text if as_text or not text else hashlib.sha256(text.encode()).hexdigest())
                at = upto
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *sums[c]]), pa.int64()) for c in SUMS]
            out.append((columns, pa.array(groups, pa.string())))
        ids = left.column("ids").combine_chunks()
        names = ["doc_id", *SUMS, "groups"]
        tables = [pa.table([ids[i].values, *columns, groups], names=names) for i, (columns, groups) in enumerate(out)]
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], ids.type.value_type), *[pa.array([], pa.int64())] * len(SUMS), pa.array([], pa.string())], names=names)

    told = coded.groupBy("chunk").cogroup(used.groupBy("of_chunk")).applyInArrow(merge, schema)
    # Between two cuts, tokens of A and B that end overlap one by one: each but one of both closes a link of its own.
    n_links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return told.select("doc_id", "n_a", "n_b", "n_groups", n_links, "n_best", "count_sum", "groups")


#: While tables are written, shuffle files go when a write ends, and what windows have sorted is aggregated in that order.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.useObjectHashAggregateExec": "false"}


@contextlib.contextmanager
def _writing(spark):
    before = {name: spark.conf.get(name, None) for name in WRITING}
    for name, value in WRITING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def align(
    docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}", chunk_bytes: int = CHUNK_BYTES,
    doc_id: str = "doc_id", text: str = "text", as_text: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """For each document doc_id, SUMS and groups (`a1,a2|b1;a3|b2,b3`, or the text's SHA-256 in hex); and the counts of pairs (pair, a, b, count, best)."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(read_files(a_path, b_path))
    with _writing(spark):
        coded, coded_path = write_shared(chunks(docs, files, chunk_bytes, doc_id, text), "chunks", "zstd")
        distinct = coded.select(F.explode(F.arrays_zip("stretches", "counts")).alias("x")).groupBy(F.col("x.stretches").alias("stretch")).agg(F.sum("x.counts").alias("n"))
        stored, stored_path = write_shared(tokenized(distinct, files), "stretches", "zstd")
        known, known_path = write_shared(aligned(exploded(stored)), "aligned")
        delete_shared(spark, stored_path)
        pairs, _ = write_shared(pair_counts(known), "pairs")
        done, done_path = write_shared(scored(known, pairs), "scored")
        delete_shared(spark, known_path)
        used, _ = write_shared(used_stretches(coded, done), "used", "zstd")
        codes, _ = write_shared(coded.select("chunk", "ids", "sizes", "codes", "n_codes"), "codes")
        delete_shared(spark, done_path, coded_path)
    return gathered(codes, used, as_text), pairs


def digest(docs: DataFrame) -> DataFrame:
    rows, _ = align(docs, as_text=False)
    return rows.withColumnRenamed("groups", "groups_sha256")
