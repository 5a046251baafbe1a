"""Quality rules judged by host, in DataFrame functions only.

Every document is measured by itself: words, characters in words, symbols, repeated lines, and words in five-word
windows that occur twice or more. Rules on these measures say which documents fail. Failures are then added up by
host (the documents' source, or the domain of a URL), and each host's rate is shrunk towards the rate of all
hosts by a beta prior whose mean and strength are fitted to the hosts themselves by moments: a host of
few documents is judged mostly by the others, one of many by its own. A host whose shrunk rate is over HOST_LIMIT is
rejected with all its documents; documents that fail the base rules are rejected wherever they are.

Measuring shuffles nothing. Failures are added up in tasks before they are shuffled, so a host with a third of all documents
sends one row a task. Only rejected hosts are joined back: up to BROADCAST_HOSTS of them are sent to all
executors, more are joined with a salt.

Edge cases: a null or empty text has no words and fails; a null host is a host of its own; repeated rows are measured and
counted each; extra columns pass through, and a result column whose name one of them has gets an underscore after it; an empty table
gives an empty result; with one host, or equal rates, the prior is as strong as MOST_STRENGTH documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh, write_shared

WORD, GAP, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", "[#*$%&|<>]"
#: Words in a window, and the rules' limits: fewest words, most repeated words in a hundred, symbols a word, lines in a hundred that repeat.
WINDOW, LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES = 5, 10, 20, 0.1, 30
#: The shrunk rate of failing documents over which a host is rejected.
HOST_LIMIT = 0.5
#: The prior counts as at least and at most so many documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
BROADCAST_HOSTS, SALTS = 20_000, 64
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def host_of(url: Column) -> Column:
    """The domain of a URL in lower case, without user, port and a leading www.; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _covered(starts: Column) -> Column:
    """Positions in windows at these ascending starts."""
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"))
    return F.aggregate(starts, first, step, lambda s: s["n"])


def _alike(order: Column, field: str) -> Column:
    """Of an array of structs in ascending order, those that have a neighbour with the same field."""
    at = lambda k: F.get(order, k)[field]
    return F.filter(order, lambda x, k: F.coalesce(x[field] == at(k - 1), F.lit(False)) | F.coalesce(x[field] == at(k + 1), F.lit(False)))


def repeated_words(words: Column) -> Column:
    """Words of an array that stand in a window that occurs twice or more, the first occurrence included.

    Hashes of the windows only rule out: where all differ, so do the windows. Otherwise windows with equal hashes are written out, sorted and compared.
    """
    last = F.size(words) - WINDOW
    hashes = F.transform(words, lambda w, i: F.when(i <= last, F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])))

    def exact(h: Column) -> Column:
        order = F.sort_array(F.transform(F.slice(h, 1, last + 1), lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        text = lambda x: F.struct(F.concat_ws(" ", F.slice(words, x["at"] + 1, WINDOW)).alias("w"), x["at"].alias("at"))
        written = _once(order, lambda o: F.sort_array(F.transform(_alike(o, "h"), text)))
        return _once(written, lambda o: _covered(F.array_sort(F.transform(_alike(o, "w"), lambda x: x["at"]))))

    # The last places have no window: their null counts as one more value.
    found = _once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < last + 2, exact(h)).otherwise(0))
    return F.when(last < 0, 0).otherwise(found)


def measured(docs: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """The documents with a column for each of MEASURES, under these names, all long."""
    words, whole, lines = fresh(docs, *names, "rule_words", "rule_text", "rule_lines")[len(names) :]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    split = F.array_remove(F.split(body, GAP), "")
    with_word = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    # The generators keep Catalyst from inlining the arrays wherever they are used, in lambdas once for each element.
    rows = docs.select("*", F.explode(F.array(F.struct(split.alias("words"), with_word.alias("lines")))).alias(words))
    array = F.col(words)["words"]
    values = (
        F.size(array), F.length(F.array_join(array, "")), F.regexp_count(body, F.lit(SYMBOLS)), F.size(F.col(words)["lines"]),
        F.size(F.col(words)["lines"]) - F.size(F.array_distinct(F.col(words)["lines"])), repeated_words(array),
    )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.cast("long").alias(n) for v, n in zip(values, names)])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def rule_failed(n_words: Column, n_symbols: Column, n_lines: Column, n_dup_lines: Column, n_repeat_words: Column) -> Column:
    """Any rule: the base rules, symbols a word, or repeated lines."""
    return base_failed(n_words, n_repeat_words) | (n_symbols > MOST_SYMBOLS * n_words) | (100 * n_dup_lines > MOST_DUP_LINES * n_lines)


def host_rates(counts: DataFrame) -> DataFrame:
    """(host, n, failed, rate, shrunk) of one row (host, n, failed) for each host.

    The hosts' failures are taken as binomial with beta-distributed rates. Their squared deviations, weighted by documents, exceed what equal
    rates would give by the correlation rho within a host; the prior then counts as (1 - rho) / rho documents.
    """
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = counts.agg(F.count("*").cast("double").alias("hosts"), F.sum(n).alias("all"), F.sum(failed).alias("bad"), F.sum(n * n).alias("squares"), F.sum(failed * failed / n).alias("spread"))
    mean = F.col("bad") / F.col("all")
    noise = mean * (1 - mean)
    excess = F.col("spread") - F.col("all") * mean * mean - noise * (F.col("hosts") - 1)
    room = noise * (F.col("all") - F.col("squares") / F.col("all") - (F.col("hosts") - 1))
    rho = F.when(room > 0, excess / F.when(room > 0, room))
    strength = F.when(rho > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), (1 - rho) / rho))).otherwise(F.lit(MOST_STRENGTH))
    prior = sums.select(F.coalesce(mean, F.lit(0.0)).alias("mean"), strength.alias("strength")).first()
    shrunk = (failed + F.lit(prior.mean) * F.lit(prior.strength)) / (n + F.lit(prior.strength))
    return counts.select("host", "n", "failed", (failed / n).alias("rate"), shrunk.alias("shrunk"))


def host_counts(rows: DataFrame, host: Column, failed: Column) -> DataFrame:
    """(host, n, failed): documents and failing documents of each host."""
    return rows.groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("failed"))


def with_verdicts(rows: DataFrame, host: str, salt_by: str, rejected: DataFrame, out: str) -> DataFrame:
    """A boolean column: whether the row's host is one of the rejected (host)."""
    key, salt, mark = fresh(rows, "rejected_host", "host_salt", "host_mark")
    hosts = rejected.select(F.col("host").alias(key), F.lit(True).alias(mark))
    keep = [F.col(f"`{c}`") for c in rows.columns]
    if rejected.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(hosts), F.col(f"`{host}`").eqNullSafe(F.col(key)), "left")
    else:
        spread = hosts.select(key, mark, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        salted = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{salt_by}`")), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, (salted[salt] == spread[salt]) & salted[f"`{host}`"].eqNullSafe(spread[key]), "left")
    return joined.select(*keep, F.coalesce(F.col(mark), F.lit(False)).alias(out))


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> tuple[DataFrame, DataFrame, list[str]]:
    """The documents without their text but with MEASURES, base_failed, host_failed and kept; the hosts' rates; and the names those columns got.

    Measures are written once to the shared folder, as both the hosts' rates and the result read them, and so are the hosts' counts; the files go with the driver.
    """
    names = fresh(docs, *MEASURES, "base_failed", "host_failed", "kept")
    base, by_host, kept = names[len(MEASURES) :]
    told, _ = write_shared(measured(docs, names[: len(MEASURES)], text).drop(text), "host-rules")
    n_words, _, n_symbols, n_lines, n_dup_lines, n_repeat_words = (F.col(n) for n in names[: len(MEASURES)])
    failed = rule_failed(n_words, n_symbols, n_lines, n_dup_lines, n_repeat_words)
    counts, _ = write_shared(host_counts(told, F.col(f"`{host}`"), failed), "hosts")
    rates = host_rates(counts)
    judged = with_verdicts(told, host, doc_id, rates.where(F.col("shrunk") > limit), by_host)
    columns = [c for c in docs.columns if c != text] + names[: len(MEASURES)]
    bad = base_failed(n_words, n_repeat_words)
    return judged.select(*[F.col(f"`{c}`") for c in columns], bad.alias(base), by_host, (~bad & ~F.col(by_host)).alias(kept)), rates, names


def digest(docs: DataFrame) -> DataFrame:
    judged, _, _ = apply_rules(docs.select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


ORACLE = f"""
with texts as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
split as (select r, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from texts),
windows as (select r, i, words[i:i + {WINDOW - 1}] as w from (select r, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) as i from split)),
twice as (select r, unnest(list(i)) as i from windows group by r, w having count(*) > 1),
hit as (select r, count(*) as n from (select distinct r, unnest(generate_series(i, i + {WINDOW - 1})) as at from twice) group by r),
measures as (
  select s.r, doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words
  from split s left join hit on s.r = hit.r),
judged as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
    n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words or n_symbols > {MOST_SYMBOLS}::double * n_words
      or 100 * n_dup_lines > {MOST_DUP_LINES} * n_lines as failed from measures),
hosts as (select source, count(*)::double as n, sum(failed::int)::double as f from judged group by source),
sums as (select count(*)::double as h, sum(n) as t, sum(f) / sum(n) as m, sum(n * n) as q, sum(f * f / n) as d from hosts),
fitted as (
  select m, case when m * (1 - m) * (t - q / t - (h - 1)) > 0 then (d - t * m * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (t - q / t - (h - 1))) end as rho from sums),
prior as (select m, case when rho > 0 then greatest({LEAST_STRENGTH}::double, least({MOST_STRENGTH}::double, (1 - rho) / rho)) else {MOST_STRENGTH}::double end as s from fitted),
verdicts as (select source, (f + m * s) / (n + s) > {HOST_LIMIT}::double as bad from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad as kept, bad as host_failed
from judged j join verdicts v on j.source is not distinct from v.source
"""
