"""Language-model scores by cross-entropy difference.

Two bigram models, of a target corpus and of all documents as background, share one vocabulary, one
smoothing and one mass: background counts are scaled to the target's size, so that losses differ by
content and not by corpus size. A document's score is its mean loss per token (in bits) under the
target less that under the background; lower is more like the target. A document's own counts are left out of both
models when it is scored: else every document would be known to the background, and those of the target to both.

Counts come from every document and are kept for each word and each pair of words (by 62 bits of
hash), in tables that grow with the input:

1. Rows are packed into chunks of about CHUNK_BYTES of text, kept in the shared folder.
2. A chunk's keys and their counts are sent by range of keys. Ranges hold the keys of about
   RANGE_BYTES of text, so there are more of them for more input.
3. A range adds up its keys over all chunks and sends each chunk the sums of the keys that it asked
   for, in its order. A chunk derives its keys from its texts again, so no keys are sent back.

Edge cases: null and empty texts have no tokens, losses and score 0; without target documents the
target model is the smoothed background vocabulary alone; repeated rows count as often as they
occur, and each leaves out its own counts alone; null labels are no target; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lexiloom.llm.common import delete_shared, free_name, fresh, slices, write_shared
from lexiloom.llm.hashing import mix, word_hashes

#: The smoothing's vocabulary, as a power of 2; that of the documents, if it is larger.
WORD_BITS = 20
CHUNK_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
#: Bits of a key.
KEY_BITS = 63
#: The weight of the unigram model in each context.
KAPPA = 2.0
#: Target ids up to which they are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_START = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SCORES = StructType([StructField("n_tokens", LongType()), *(StructField(c, DoubleType()) for c in ("target_loss", "background_loss", "ce_diff"))])


def token_slots(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of a batch: keys of the word (even), of the word before it (-1: none), of the pair (odd); and the texts' offsets."""
    hashes, offsets = word_hashes(raws)
    before = np.concatenate([[_START], hashes[:-1]]) if len(hashes) else hashes
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = _START
    even = lambda x: (x >> np.uint64(2) << np.uint64(1)).astype(np.int64)
    word, context, pair = even(hashes), even(before), even(mix(before * _PAIR + hashes)) + 1
    context[first] = -1
    return word, context, pair, offsets


def _keys(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct keys, sorted, after key 0 for the start of a text; places of each token's word, context and pair in them; offsets."""
    word, context, pair, offsets = token_slots(raws)
    keys, place = np.unique(np.concatenate([[0], word, pair]).astype(np.int64), return_inverse=True)
    at = place[1 : len(word) + 1]
    before = np.where(context < 0, 0, np.concatenate([[0], at[:-1]])) if len(at) else at
    return keys, at, before, place[len(word) + 1 :], offsets


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers, byte by byte of equal weight, compressed."""
    planes = np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _expand(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def _raws(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


_PACKED = "chunk long, size long, packed binary"


def _packer(text: str, chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to chunks of rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk = [], 0, TaskContext.get().partitionId() << 32

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_pydict({"chunk": [chunk], "size": [size], "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            raws = _raws(batch.column(text))
            for a, b in slices(raws, chunk_bytes // 8):
                held.append(batch.slice(a, b - a))
                size += sum(map(len, raws[a:b]))
                if size >= chunk_bytes or sum(len(x) for x in held) >= 1 << 16:
                    yield packed()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield packed()

    return pack


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


_COUNTS = "part long, chunk long, keys binary, target binary, both binary"


def _counter(text: str, flag: str, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks to their counts by range of keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("packed")):
                rows = _unpacked(blob.as_py())
                keys, word, _, pair, offsets = _keys(_raws(rows.column(text)))
                if not len(word):
                    continue
                sizes = np.diff(offsets)
                chosen = np.asarray(rows.column(flag).to_pylist(), bool)
                counts = []
                for texts in (chosen, np.ones(len(sizes), bool)):
                    tokens = np.repeat(texts, sizes)
                    counts.append(np.bincount(np.concatenate([word[tokens], pair[tokens]]), minlength=len(keys)))
                    counts[-1][0] = (texts & (sizes > 0)).sum()
                parts, starts = np.unique(keys >> (KEY_BITS - bits), return_index=True)
                ends = [*starts[1:], len(keys)]
                cut = lambda x: pa.array([_squeeze(x[a:b]) for a, b in zip(starts, ends)], pa.binary())
                gaps = np.diff(keys, prepend=0)
                gaps[starts] = keys[starts]
                yield pa.RecordBatch.from_pydict(
                    {"part": parts, "chunk": np.full(len(parts), chunk, np.int64), "keys": cut(gaps), "target": cut(counts[0]), "both": cut(counts[1])}
                )

    return count


_SUMS = "part long, chunk long, target binary, both binary, words long, target_tokens long, tokens long"


def _sum(rows: pa.Table) -> pa.Table:
    """Adds up a range's counts over all chunks; each chunk gets the sums of its keys, one row also the range's totals."""
    asked = [np.cumsum(_expand(x.as_py())) for x in rows.column("keys")]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    sums = []
    for name in ("target", "both"):
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate([_expand(x.as_py()) for x in rows.column(name)]))
        sums.append(total)
    cuts = np.cumsum([0, *map(len, asked)])
    back = lambda total: pa.array([_squeeze(total[place[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary())
    word = (keys % 2 == 0) & (keys > 0)
    once = lambda n: pa.array([int(n), *[0] * (len(asked) - 1)], pa.int64())
    return pa.table(
        {
            "part": rows.column("part"), "chunk": rows.column("chunk"), "target": back(sums[0]), "both": back(sums[1]),
            "words": once(word.sum()), "target_tokens": once(sums[0][word].sum()), "tokens": once(sums[1][word].sum()),
        }
    )


def losses(counts: np.ndarray, own: tuple[np.ndarray, ...], tokens: np.ndarray, vocabulary: int, scale: float, word: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Bits for each token, from a model's counts by place less a document's own of word, context and pair; tokens: all others'."""
    unigram = (scale * (counts[word] - own[0]) + 1) / (scale * tokens + vocabulary)
    seen = counts[context] - own[1]
    return -np.log2((scale * (counts[pair] - own[2]) + KAPPA * unigram) / (scale * seen + KAPPA))


def _own(word: np.ndarray, context: np.ndarray, pair: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each token, how often its word, its context and its pair occur in its text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    out = []
    for key in (word, pair):
        _, place, n = np.unique(text * (np.int64(key.max(initial=0)) + 1) + key, return_inverse=True, return_counts=True)
        out.append(n[place])
    # A context is the word before it; the start of a text occurs once in it.
    before = np.concatenate([[1], out[0][:-1]]) if len(word) else out[0]
    return out[0], np.where(context == 0, 1, before), out[1]


def _scorer(text: str, flag: str, name: str, sums: tuple[int, int], vocabulary: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk and its keys' counts to its rows with scores."""
    scale = sums[0] / sums[1] if sums[1] else 1.0

    def scored(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        rows = pa.concat_tables([_unpacked(x.as_py()) for x in chunk.column("packed")])
        _, word, context, pair, offsets = _keys(_raws(rows.column(text)))
        sizes = np.diff(offsets)
        counts, some, means = counts.sort_by("part"), sizes > 0, []
        own = _own(word, context, pair, sizes)
        chosen = np.asarray(rows.column(flag).to_pylist(), bool)
        for model, tokens, by, texts in (("target", sums[0], 1.0, chosen), ("both", sums[1], scale, np.ones(len(sizes), bool))):
            mean = np.zeros(len(sizes))
            if some.any():
                found = np.concatenate([_expand(x.as_py()) for x in counts.column(model)])
                mine = np.repeat(texts, sizes)
                bits = losses(found, tuple(x * mine for x in own), tokens - np.repeat(texts * sizes, sizes), vocabulary, by, word, context, pair)
                mean[some] = np.add.reduceat(bits, offsets[:-1][some]) / sizes[some]
            means.append(mean)
        columns = [pa.array(sizes.astype(np.int64)), *(pa.array(x) for x in (*means, means[0] - means[1]))]
        return rows.drop_columns([flag]).append_column(name, pa.StructArray.from_arrays(columns, _SCORES.names))

    return scored


def score(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "lm", chunk_bytes: int | None = None, range_bytes: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Adds a struct of tokens, both losses and their difference; the target is the documents whose id is in targets' one column.

    Also returns the paths of the shared tables that the result reads. chunk_bytes and range_bytes (CHUNK_BYTES and
    RANGE_BYTES if not given) take memory in proportion, but a chunk sends a row to every range that has one of its
    keys: on inputs above some TB, where such a row holds few keys, larger ones move less.
    """
    chunk_bytes, range_bytes, out = chunk_bytes or CHUNK_BYTES, range_bytes or RANGE_BYTES, free_name(docs, out)
    key, own, flag = fresh(docs, "target_id", "own_id", "is_target")
    ids = targets.select(F.col(targets.columns[0]).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.withColumn(own, F.col(doc_id).cast("long")).join(ids, F.col(own) == F.col(key), "left")
    rows = rows.select(*docs.columns, F.coalesce(F.col(flag), F.lit(False)).alias(flag))
    chunks, packed_path = write_shared(rows.mapInArrow(_packer(text, chunk_bytes), _PACKED), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    bits = max(5, (size // range_bytes).bit_length())
    counts = chunks.select("chunk", "packed").mapInArrow(_counter(text, flag, bits), _COUNTS)
    sums, sums_path = write_shared(counts.groupBy("part").applyInArrow(_sum, _SUMS), "sums")
    words, target, both = (x or 0 for x in sums.agg(F.sum("words"), F.sum("target_tokens"), F.sum("tokens")).first())
    scored = _scorer(text, flag, out, (target, both), max(1 << WORD_BITS, words))
    schema = StructType([*docs.schema.fields, StructField(out, _SCORES)])
    pairs = chunks.select("chunk", "packed").groupBy("chunk").cogroup(sums.select("chunk", "part", "target", "both").groupBy("chunk"))
    return pairs.applyInArrow(scored, schema), [packed_path, sums_path]


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: tokens, losses and their difference, with documents labelled as good as the target."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scored, spent = score(kept, labels.where(F.col("quality") == 1).select("doc_id"))
    found, _ = write_shared(scored.select("doc_id", "lm.*"), "lm-scores")
    delete_shared(docs.sparkSession, *spent)
    return found
