"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is its target share of all bytes over its present share. Each document's count is
the inverse of the Poisson distribution with that mean at a uniform number taken from a hash of
seed and id, so any executor, at any time, draws the same count. Copies are exploded and dealt to
partitions by a hash of seed, id and copy, then sorted by it: a global shuffle in one exchange.

Rates above 32 are split into equal pieces, each inverted by itself; a sum of Poisson counts is
Poisson, and no table of probabilities underflows.

Edge cases: null text has no bytes; null sources are a source of their own; a source without bytes
has rate 1; rows without an id are named by a digest of their text, so that they are not dealt to one
partition; repeated rows get equal counts; extra columns pass through, and a result column whose name
one of them has gets an underscore after it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import checkpoint, fresh

SEED = "mix-1"
#: The largest mean of one inversion, and the terms of its distribution; beyond them lies less than 2**-80.
PIECE, TERMS = 32, 112
#: Sources up to which the table of rates (about 1 KB each) is broadcast; beyond, the join is salted.
BROADCAST_SOURCES, SALTS = 20_000, 64


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, default: float, ratio: float, text: str, source: str) -> tuple[DataFrame, int]:
    """Per source: rate, number of pieces and the cumulative probabilities of one piece; and how many sources there are."""
    sizes = checkpoint(
        docs.groupBy(docs[source].alias("source")).agg(F.sum(F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")).alias("size"))
    )
    weight = F.lit(float(default))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    total = sizes.agg(F.count("*"), F.sum("size"), F.sum(weight)).first()
    count, size, all_weights = total[0], float(total[1] or 0), float(total[2] or 1) or 1.0
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.lit(float(ratio)) * (weight / F.lit(all_weights)) * F.lit(size) / F.col("size").cast("double"))
    cdf = F.expr(
        f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-lam), 'c', array(exp(-lam))), "
        "(s, k) -> named_struct('p', s.p * lam / k, 'c', array_append(s.c, s.c[k - 1] + s.p * lam / k)), s -> s.c)"
    )
    rates = sizes.withColumn("rate", rate).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE).cast("int")))
    return rates.withColumn("lam", F.col("rate") / F.col("pieces")).select("source", "rate", "pieces", cdf.alias("cdf")), count


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, default: float = 1.0, ratio: float = 1.0, seed: str = SEED,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The documents' columns for every copy, and rate, n_copies, copy and shuffle_key (with underscores where taken); in shuffled order.

    weights: target weights by source; sources not named have the default weight. ratio: bytes out over bytes in.
    """
    rates, count = source_rates(docs, weights, default, ratio, text, source)
    key, salt, info, drawn, named, rate, n_copies, copy, shuffle = fresh(
        docs, "mix_source", "mix_salt", "mix_rate", "mix_count", "mix_name", "rate", "n_copies", "copy", "shuffle_key"
    )
    rates = rates.select(F.col("source").alias(key), F.struct("rate", "pieces", "cdf").alias(info))
    if count <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), docs[source].eqNullSafe(rates[key]))
    else:
        spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(docs[doc_id]), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, (salted[salt] == spread[salt]) & salted[source].eqNullSafe(spread[key])).drop(salt)
    name = F.col(named)
    unit = lambda i: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name, i.cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    inverse = lambda u: F.size(F.filter(F.col(info)["cdf"], lambda c: c < u))
    counts = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.col(info)["pieces"] - 1), lambda i: inverse(unit(i))), F.lit(0), lambda a, n: a + n
    )
    untold = F.concat(F.lit("null:"), F.md5(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")))
    copies = (
        joined.withColumn(named, F.coalesce(F.col(f"`{doc_id}`").cast("string"), untold)).withColumn(drawn, counts).where(F.col(drawn) > 0)
        .select(
            *[F.col(f"`{c}`") for c in docs.columns], named,
            F.col(info)["rate"].alias(rate), F.col(drawn).alias(n_copies),
            F.explode(F.sequence(F.lit(0), F.col(drawn) - 1)).alias(copy),
        )
        .withColumn(shuffle, F.md5(F.concat_ws(":", F.lit(seed), F.lit("shuffle"), name, F.col(copy).cast("string"))))
        .drop(named)
    )
    return copies.repartition(F.col(shuffle)).sortWithinPartitions(shuffle)


ORACLE = f"""
with recursive sizes as (
  select source, sum(strlen(coalesce(text, '')))::bigint as size from documents group by source),
rates as (
  select source, case when size = 0 then 1.0::double else 1.0::double * (1.0::double / (count(*) over ())::double)
    * (sum(size) over ())::double / size::double end as rate from sizes),
pieces as (
  select source, rate, greatest(1, ceil(rate / {PIECE}))::int as pieces, rate / greatest(1, ceil(rate / {PIECE}))::int as lam from rates),
cdf as (
  select source, lam, 0 as k, exp(-lam) as p, exp(-lam) as c from pieces
  union all select source, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) from cdf where k < {TERMS}),
tables as (select source, list(c order by k) as cdf from cdf group by source),
draws as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, coalesce(d.doc_id::varchar, 'null:' || md5(coalesce(d.text, ''))) as name, p.rate, t.cdf, unnest(generate_series(0, p.pieces - 1)) as i
  from documents d join pieces p on d.source is not distinct from p.source join tables t on d.source is not distinct from t.source),
units as (
  select *, (('0x' || substr(md5('{SEED}:' || name || ':' || i::varchar), 1, 12))::bigint + 0.5) / 281474976710656.0 as u from draws),
counts as (
  select doc_id, text, lang, source, n_chars, name, rate, sum(len(list_filter(cdf, lambda c: c < u)))::int as n_copies
  from units group by all)
select * exclude (name), md5('{SEED}:shuffle:' || name || ':' || copy::varchar) as shuffle_key from (
  select *, unnest(generate_series(0, n_copies - 1))::int as copy from counts where n_copies > 0)
"""
