"""Host rules against brute force: measures, the fitted prior, verdicts joined back, odd rows and clashing names."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lexiloom.llm import host_rules
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, source string, kept string, N_WORDS string"


def brute(text):
    text = text or ""
    words = re.findall(host_rules.WORD, text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    hit = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(host_rules.WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(host_rules.SYMBOLS, text)), len(lines), len(lines) - len(set(lines)), len(hit)


def fails(m):
    return m[0] < 10 or 100 * m[5] > 20 * m[0], m[0] < 10 or 100 * m[5] > 20 * m[0] or m[2] > 0.1 * m[0] or 100 * m[4] > 30 * m[3]


def prior(hosts):
    h, n = len(hosts), sum(x for x, _ in hosts)
    m = sum(f for _, f in hosts) / n
    excess = sum(x * (f / x - m) ** 2 for x, f in hosts) - m * (1 - m) * (h - 1)
    room = m * (1 - m) * (n - sum(x * x for x, _ in hosts) / n - (h - 1))
    rho = excess / room if room > 0 else 0
    return m, max(1.0, min(1000.0, (1 - rho) / rho)) if rho > 0 else 1000.0


def corpus():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "bb", "çé", "d#", "e|", "\U0001f600x", " ", "f g"])
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "a b c d", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "x\x1cy z", "\x00 \x00 q"]
    for n in (5, 9, 10, 30, 200, 200):
        texts += [rnd.choice([" ", "\n", "\r\n", "\t "]).join(word() for _ in range(n)) for _ in range(12)]
    texts += ["same line here\n" * 9, "same line here \nsame line here\n" * 4, "# * $ % & | < > " * 3, "long words in here %d " * 20_000]
    texts += [" ".join(str(i) for i in range(40)), "w " * 5 + " ".join(str(i) for i in range(60))]
    return [(i, t, None if i % 7 == 0 else f"host{i % 5}", "x", "x") for i, t in enumerate(texts * 2)]


def test_measures_and_verdicts_against_brute_force(spark, monkeypatch):
    rows = corpus() + [(1000 + i, "junk", "bad.example", "x", "x") for i in range(40)] + [(2000, " ".join(map(str, range(50))), "bad.example", "x", "x")]
    rows += [rows[20], rows[20], *[(3000 + i, f"{i} " + " ".join(map(str, range(50))), f"host{i % 5}", "x", "x") for i in range(400)]]
    docs = spark.createDataFrame(rows, COLUMNS)
    counts = defaultdict(lambda: [0, 0])
    for _, text, source, *_ in rows:
        counts[source][0] += 1
        counts[source][1] += fails(brute(text))[1]
    mean, strength = prior(list(counts.values()))
    bad = {h for h, (n, f) in counts.items() if (f + mean * strength) / (n + strength) > host_rules.HOST_LIMIT}
    assert "bad.example" in bad and bad != set(counts)
    want = Counter()
    for i, text, source, *_ in rows:
        m = brute(text)
        want[(i, *m, fails(m)[0], source in bad, not fails(m)[0] and source not in bad)] += 1
    for most in (host_rules.BROADCAST_HOSTS, 0):  # sent to all executors, and joined with a salt
        monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", most)
        judged, rates, names = host_rules.apply_rules(docs)
        assert [c for c in judged.columns if c not in names] == ["doc_id", "source", "kept", "N_WORDS"]
        assert names[0] == "n_words_" and names[-1] == "kept_"
        assert Counter(tuple(r) for r in judged.select("doc_id", *names).collect()) == want
        for r in rates.collect():
            assert [r.n, r.failed] == counts[r.host] and r.shrunk == pytest.approx((r.failed + mean * strength) / (r.n + strength))


def test_few_documents_are_judged_by_the_others(spark):
    rates = host_rules.host_rates(spark.createDataFrame([("tiny", 1, 1), *[(f"h{i}", 1000, 50 + i % 3) for i in range(30)]], "host string, n long, failed long"))
    assert {r.host: r.shrunk < 0.1 for r in rates.collect()}["tiny"]
    one = host_rules.host_rates(spark.createDataFrame([("only", 10, 4)], "host string, n long, failed long")).first()
    assert one.shrunk == pytest.approx(0.4)


def test_no_documents(spark):
    judged, rates, _ = host_rules.apply_rules(spark.createDataFrame([], COLUMNS))
    assert judged.count() == 0 and rates.count() == 0


def test_plan_has_no_python(spark):
    text = host_rules.measured(spark.createDataFrame(corpus(), COLUMNS), list(host_rules.MEASURES))._jdf.queryExecution().toString()
    assert "Python" not in text and "Exchange" not in text


def test_domains(spark):
    urls = [("https://www.Example.org:80/a?b=http://c.net", "example.org"), ("http://u:p@h.io", "h.io"), ("no url", None), ("", None), (None, None), ("ftp://x.y#z", "x.y")]
    got = spark.createDataFrame(urls, "url string, want string").select(host_rules.host_of(F.col("url")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
