"""Stored collections: repeated and null ids, wildcards by ranges of rotations, spelling by an automaton over blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.config import AnalyzerConfig
from lexiloom.operators import index, permuterm, spelling, tolerant
from lexiloom.plans import catalogue, stored
from lexiloom.plans.workbench import Collection
from lexiloom.sources import collection as sources

PLAIN = AnalyzerConfig(norm="none")
ROWS = [
    (1, "alpha beta gamma"), (1, "zeta delta"), (None, "one two three"), (None, "one two. two three"), (2, "alpha delta alpha delta"),
    (2, "alpha delta alpha delta"), (3, None), (4, ""), (5, "two three one two"), (6, "one two one three one two three"),
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plain = Collection(docs, PLAIN)
    return plain, stored.build(plain, str(tmp_path_factory.mktemp("store")))


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("text", ["alpha delta", "one two three", "two", "one two", "alpha", "", "missing words here", "alpha delta alpha", "one three one two"])
@pytest.mark.parametrize("method", ["positional", "biword", "false_positives"])
def test_phrases_with_repeated_and_null_ids(both, text, method):
    plain, kept = both
    assert rows(kept.phrase(text, method)) == rows(plain.phrase(text, method))


def test_every_other_stored_query(both):
    plain, kept = both
    assert rows(kept.lookup("alpha, two, none")) == rows(plain.lookup("alpha, two, none"))
    assert rows(kept.samples()) == rows(plain.samples())
    entries = [json.loads(r.entry) for r in kept.samples().where("kind = 'positional'").collect()]
    assert [e["term"] for e in entries] == ["alpha", "beta", "delta", "gamma", "one"] and entries[-1]["docs"].keys() == {"5", "6"}
    assert kept.defaults().keys() == plain.defaults().keys() and kept.defaults()["lookup"] == plain.defaults()["lookup"]
    assert rows(kept.wildcard_grams("al*a")) == rows(plain.wildcard_grams("al*a"))
    assert rows(kept.phonetic("alfa")) == rows(plain.phonetic("alfa"))
    assert rows(kept.phrase()) == rows(plain.phrase(kept.defaults()["phrase"]))


def vocabulary(n=3000):
    rnd = random.Random(8)
    letters = "abcdeéñ日\U0001f600"
    return sorted({"".join(rnd.choice(letters[: rnd.choice([3, 5, 9])]) for _ in range(rnd.randrange(1, 10))) for _ in range(n)} | {"a" * 40, "b"})


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(w,) for w in vocabulary()], "term string").cache()


def test_wildcards_are_ranges_of_rotations(terms, tmp_path):
    rnd = random.Random(9)
    path = str(tmp_path / "permuterm")
    permuterm.permuterm_pairs(terms).repartitionByRange(4, "rotation").sortWithinPartitions("rotation").write.parquet(path)
    pairs = terms.sparkSession.read.parquet(path)
    assert pairs.count() == sum(len(w) + 1 for w in vocabulary())
    words = vocabulary()
    patterns = ["*", "**", "a*", "*a", "*a*", "a*b*c", "ab*", "nostar", "*é*日*", "a%*", "a_*", "$*", "*$*", "\\*"]
    for _ in range(25):
        w = rnd.choice(words)
        cut = sorted(rnd.randrange(len(w) + 1) for _ in range(2))
        patterns.append(rnd.choice([f"{w[:cut[0]]}*{w[cut[1]:]}", f"*{w[cut[0]:cut[1]]}*", f"{w[:1]}*{w[cut[0]:cut[1]]}*{w[-1:]}"]))
    wanted = {p: [r.term for r in tolerant.wildcard(terms, p).collect()] for p in patterns}
    for p in patterns:
        assert [r.term for r in permuterm.permuterm_lookup(pairs, p).collect()] == wanted[p], p
    plan = permuterm.permuterm_lookup(pairs, "a*b")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(rotation,b$a), StringStartsWith(rotat" in plan


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_automaton_is_the_distance():
    words = vocabulary(400)
    for word, most in (("abcab", 2), ("", 1), ("日é\U0001f600a", 1), ("aaaa", 3), ("badce", 0)):
        a = spelling.automaton(word, most)
        for w in words:
            state = 0
            for c in w:
                state = state if state < 0 else a.next[state * (len(a.letters) + 1) + a.letters.find(c) + 1]
            found = a.distance[state] if state >= 0 else -1
            true = edit_distance(word, w)
            assert found == (true if true <= most else -1), (word, w)


def test_spelling_over_blocks(terms):
    blocks = spelling.term_blocks(terms, 16).cache()
    words = vocabulary()
    assert sorted(r.prefix + x for r in blocks.collect() for x in r.rests) == sorted(words)
    for word, most in (("abcab", 2), ("Éab", 1), ("日é\U0001f600a", 2), ("aaaa", 0), ("x" * 30, 2), ("", 1)):
        got = [(r.term, r.distance) for r in spelling.spell_lookup(blocks, word, most).collect()]
        want = sorted(((d, w) for w in words if (d := edit_distance(word.lower(), w)) <= most))
        assert [(d, w) for w, d in got] == want
        assert got == [(r.term, r.distance) for r in tolerant.spell_suggest(terms, word, most).collect()]
    told = spelling.spell_blocks(blocks, "abcab", 1).first()
    assert told.terms == len(words) and told.blocks == blocks.count() and 0 < told.blocks_read < told.blocks and told.terms_read < told.terms / 2


def test_no_terms(spark, tmp_path):
    kept = stored.build(Collection(spark.createDataFrame([(1, None)], "doc_id long, text string"), PLAIN), str(tmp_path))
    assert kept.wildcard("*").count() == kept.spell("word").count() == kept.samples().count() == kept.phrase("a b").count() == 0
    assert kept.spell_blocks("word").first().asDict() == {"blocks": 0, "blocks_read": 0, "terms": 0, "terms_read": 0}


def leaves(df):
    """Rows that come out of each scan of a query that has run, and the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, out = [plan], []
    while todo:
        node = todo.pop()
        if "Adaptive" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        if "Scan parquet" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out, plan.toString()


def test_point_reads_open_only_files_of_their_range_and_skip_by_bloom_filters(spark, tmp_path):
    words = [f"w{i:05d}" for i in range(0, 4000, 2)]
    docs = spark.createDataFrame([(i, " ".join(words[k] for k in range(i, 2000, 50))) for i in range(50)], "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept = stored.build(Collection(docs, PLAIN), str(tmp_path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = spark.read.parquet(f"{kept.path}/ranges/tokens").collect()
    assert len(ranges) > 1 and all(r.first <= r.last for r in ranges)
    assert len(kept.at("tokens", "w00100").inputFiles()) == 1
    assert kept.at("tokens", "w00100").count() == 1 and kept.at("tokens", "w00100", "w03998", "w00101").count() == 2
    assert leaves(kept.at("tokens", "w00101"))[0] == [0]  # within a range, but in no Bloom filter
    assert leaves(kept.at("tokens", "w00100"))[0] != [0]
    assert kept.at("tokens", "zzz").count() == 0 and kept.at("tokens").count() == 0
    told = {r.query_term: r for r in kept.read_latency("w00100, w00101", 3).collect()}
    assert told["w00100"].in_corpus and not told["w00101"].in_corpus and told["w00100"].search_p50_us <= told["w00100"].search_p99_us


def test_a_rare_term_leaves_out_rows_of_the_others_before_they_are_shuffled(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, ("rare " if i == 7 else "") + "common words in common places " * 5) for i in range(300)], "doc_id long, text string")
    plain = Collection(docs, PLAIN)
    kept = stored.build(plain, str(tmp_path))
    for text, methods in (("rare common words", ("positional", "biword", "false_positives")), ("common words", ("positional",)), ("absent common", ("biword",))):
        for method in methods:
            want = rows(plain.phrase(text, method))
            for most in (stored.RARE_ROWS, 0):
                monkeypatch.setattr(stored, "RARE_ROWS", most)
                assert rows(kept.phrase(text, method)) == want, (text, method, most)
    monkeypatch.setattr(stored, "RARE_ROWS", 1 << 20)
    plan = leaves(kept.phrase("rare common words"))[1]
    assert "LeftSemi" in plan and plan.index("Exchange") < plan.index("LeftSemi")  # the join is below the exchange


def test_a_query_builds_only_the_tables_it_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "_STORES", {})
    monkeypatch.setattr(catalogue, "scratch_path", lambda *_: str(tmp_path))
    written = lambda: sorted(p.name for p in tmp_path.iterdir() if p.name != "ranges")
    catalogue.QUERIES["stored_defaults"](spark, "/root/testdata/sf0.001").collect()
    assert written() == ["arrays", "counts", "terms"]
    before = (tmp_path / "arrays" / "_SUCCESS").stat().st_mtime_ns
    catalogue.QUERIES["stored_phrase_rare"](spark, "/root/testdata/sf0.001").collect()
    assert written() == ["arrays", "counts", "terms", "tokens"] and (tmp_path / "arrays" / "_SUCCESS").stat().st_mtime_ns == before
    catalogue.QUERIES["stored_samples"](spark, "/root/testdata/sf0.001").collect()
    assert written() == ["arrays", "biwords", "counts", "grams", "terms", "tokens"]


def test_terms_are_counted_without_a_row_for_each_occurrence(spark):
    arrays = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["b"]), (3, []), (3, None), (4, ["a", "a"])], "row long, tokens array<string>")
    counts = index.term_counts(arrays)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in counts.collect()} == {("a", 3, 2), ("b", 3, 2)}


def test_ranges_of_a_store_grow_in_number_and_their_manifest_sorts_nothing(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["common"] * 40 + [f"w{i:03d}", "then", f"z{i % 7}"])) for i in range(60)], "doc_id long, text string")
    plain = Collection(docs, catalogue.PLAIN)
    monkeypatch.setattr(stored, "RANGE_BYTES", {"arrays": 200, "counts": 200, "terms": 200})
    kept = stored.build(plain, str(tmp_path), ("tokens", "biwords", "counts"))
    ranges = sorted(spark.read.parquet(f"{tmp_path}/ranges/tokens").collect(), key=lambda r: r.file)
    assert len(ranges) > 4 and sum(r.first == "common" for r in ranges) > 2  # more than shuffle partitions; one term over several files
    for r in ranges:
        held = [x.term for x in spark.read.parquet(r.file).select("term").distinct().collect()]
        assert all(r.first <= t <= r.last for t in held)
    for text in ("common w007", "w059 then z3", "then z6", "z6", "common"):
        assert rows(kept.phrase(text)) == rows(plain.phrase(text)), text
    assert [r.n_rows for r in kept.at("counts", "common").collect()] == [60]


def test_a_manifest_is_made_without_a_sort_of_the_index(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("cast(id as string) as term").sort("term").write.parquet(str(tmp_path / "t"))
    plans = []
    frame = type(spark.range(1))
    real = frame.coalesce
    monkeypatch.setattr(frame, "coalesce", lambda self, n: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self, n))
    sources.store_ranges(spark, str(tmp_path / "t"), "term", str(tmp_path / "m"))
    assert plans[0].count("Sort [") == 1 and "EqualTo(_tmp_metadata_row_index,0)" in plans[0]  # of the files' first rows alone
    assert [(r.first, r.last) for r in spark.read.parquet(str(tmp_path / "m")).orderBy("first").collect()][-1][1] == "99"


def test_terms_are_counted_without_a_sort_of_each_row(spark):
    arrays = spark.createDataFrame([(1, ["b", "a", "b", None])], "row long, tokens array<string>")
    assert "lambda" not in index.term_counts(arrays)._jdf.queryExecution().executedPlan().toString()
