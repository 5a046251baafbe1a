import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import lemma, porter
from lexiloom.functions.config import AnalyzerConfig
from lexiloom.operators import dictionary, evaluate, index, phrase, tolerant
from lexiloom.plans import catalogue, oracle, stored
from lexiloom.plans.workbench import Collection
from lexiloom.sources import collection as sources
from lexiloom.sources import lexicon as sources_lexicon
from lexiloom.streaming import ingest

PLAIN = AnalyzerConfig(norm="none")
TEXTS = {
    0: "Web-scale search engines rank pages. Search engines rank pages quickly.",
    1: "Geese and wolves were running. The children saw the geese.",
    2: "Search engines help. The engine ranks fast; engines rank few ranked pages.",
    3: "Robert met Rupert to recieve 42 boxes.",
    4: "",
    5: "the of and",
    6: "pages",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def plain(docs):
    return Collection(docs, PLAIN)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_indexes(plain):
    inverted = {r.term: (r.df, list(r.docs)) for r in plain.index("inverted").collect()}
    assert inverted["pages"] == (3, [0, 2, 6]) and "the" not in inverted
    positions = {(r.term, r.doc_id): list(r.positions) for r in plain.index("positional").collect()}
    assert positions["search", 0] == [2, 6]
    nested = {r.term: r.docs for r in index.positional_map(plain.tokens).collect()}
    assert nested["search"][0] == [2, 6]
    pairs = {r.biword: list(r.docs) for r in plain.index("biword").collect()}
    assert pairs["search engines"] == [0, 2]
    grams = {r.gram: list(r.terms) for r in plain.index("kgram").collect()}
    assert grams["$r"] == ["rank", "ranked", "ranks", "recieve", "robert", "running", "rupert"]
    assert {r.code: list(r.terms) for r in plain.index("soundex").collect()}["R163"] == ["robert", "rupert"]
    sample = index.index_sample(plain.index("inverted"), "term", 2).collect()
    assert [json.loads(r.entry)["term"] for r in sample] == ["42", "boxes"]


def test_phrases(docs, plain):
    found = plain.phrase("search engines rank").collect()
    assert [(r.doc_id, list(r.positions)) for r in found] == [(0, [2, 3, 4])]
    assert ids(plain.phrase("search engines rank", "biword")) == [0, 2]
    assert ids(plain.phrase("search engines rank", "false_positives")) == [2]
    assert ids(plain.phrase("search engines", "false_positives")) == []
    assert ids(plain.phrase("pages")) == ids(plain.phrase("pages", "biword")) == [0, 2, 6]
    assert ids(plain.phrase("the of")) == ids(plain.phrase("the of", "biword")) == []
    assert ids(plain.phrase("no such words")) == []
    terms = ["search", "engines", "rank"]
    assert [(r.doc_id, list(r.positions)) for r in phrase.positional_lookup(plain.tokens, terms).collect()] == [(0, [2, 3, 4])]
    assert ids(phrase.biword_lookup(index.biword_postings(plain.arrays), terms)) == [0, 2]
    doubled = docs.sparkSession.createDataFrame([(0, "go go stop go"), (1, "go stop")], "doc_id long, text string")
    assert [list(r.positions) for r in Collection(doubled, PLAIN).phrase("go go").collect()] == [[0, 1]]
    assert [list(r.positions) for r in phrase.positional_lookup(Collection(doubled, PLAIN).tokens, ["go", "go"]).collect()] == [[0, 1]]


def test_stemmed_phrase(docs):
    stemmed = Collection(docs)
    assert ids(stemmed.phrase("search engine ranks")) == [0]
    assert 2 in ids(stemmed.phrase("engine ranking", "biword"))


def test_lookup(plain):
    got = {r.query_term: (r.in_corpus, list(r.docs)) for r in plain.lookup("pages, Geese wolves,missing, the ,").collect()}
    assert got == {"pages": (True, [0, 2, 6]), "Geese wolves": (True, [1]), "missing": (False, []), "the": (False, [])}
    assert plain.lookup().count() == 4


def test_tolerant(plain):
    terms = lambda df: [r.term for r in df.collect()]
    assert terms(plain.wildcard("ra*")) == ["rank", "ranked", "ranks"]
    assert terms(plain.wildcard("*n*s")) == ["engines", "ranks"]
    assert terms(plain.wildcard("Ra*")) == [] and terms(plain.wildcard("rank")) == []
    assert len(terms(plain.wildcard("*"))) == plain.terms.count()
    assert set(terms(plain.wildcard("r*k"))) <= set(terms(tolerant.wildcard_candidates(plain.terms, "r*k")))
    assert [(r.term, r.distance) for r in plain.spell("rnak").collect()] == [("rank", 2)]
    assert [(r.term, r.distance) for r in plain.spell("rank", 1).collect()] == [("rank", 0), ("ranks", 1)]
    assert terms(plain.phonetic("Robart")) == ["robert", "rupert"] and terms(plain.phonetic("4")) == []
    queries = plain.docs.sparkSession.createDataFrame([("rnak",), ("bxes",)], "query string")
    joined = {(r.query, r.term) for r in tolerant.spell_join(plain.terms, queries).collect()}
    assert joined == {("rnak", "rank"), ("bxes", "boxes")}
    assert set(tolerant.default_queries(plain.terms)) == {"wildcard", "spelling", "phonetic"}


def brute_soundex(term):
    digits = {c: d for d, cs in zip("123456", ("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R")) for c in cs}
    upper = term.upper()
    out, last = upper[0], digits.get(upper[0], "")
    for c in upper[1:]:
        d = digits.get(c, "")
        out += d if d != last else ""
        last = d
    return (out + "000")[:4]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_whole_vocabulary(spark, tmp_path):
    words = "schön schon été étés naïve señor señores thanedble thañedble tänzer straße über übers mañana Дом дома boxes córpora attion áttion 42 x9"
    spark.createDataFrame([(i, w) for i, w in enumerate([words, "schöne " + words])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: getattr(catalogue, name)(spark, str(tmp_path)).collect()
    terms = {w.lower() for w in words.split()} | {"schöne"}
    letters = {w for w in terms if w.isalpha()}
    codes = {(r.code, t) for r in run("soundex_index") for t in r.terms.split(",")}
    assert codes == {(brute_soundex(w), w) for w in letters}
    assert [r.term for r in run("phonetic")] == sorted(w for w in letters if brute_soundex(w) == brute_soundex(catalogue.NAME))
    queries = catalogue.SPELLED
    near = {(q, w, brute_distance(q, w)) for q in queries for w in terms if brute_distance(q, w) <= 2}
    assert {tuple(r) for r in run("spell_join")} == near and ("señro", "señor", 2) in near
    lemmas = {r.term: r.lemma for r in run("lemmas")}
    assert terms <= set(lemmas) and lemmas["étés"] == "étés" and lemmas["boxes"] == "box"


def test_stages(plain, docs):
    row = plain.stages(0).first()
    assert row.stage1_hyphen.startswith("Web scale") and row.stage4_stop[:2] == ["web", "scale"]
    assert list(Collection(docs).stages(0).first().stage5_norm[:3]) == ["web", "scale", "search"]
    assert list(Collection(docs, AnalyzerConfig(norm="lemma")).stages(1).first().stage5_norm)[:2] == ["goose", "wolf"]
    assert list(Collection(docs, AnalyzerConfig(norm="both")).stages(1).first().stage5_norm)[:2] == ["goos", "wolf"]


def test_evaluation(docs, spark):
    queries = evaluate.test_queries(docs)
    assert queries == ["web scale", "geese wolves", "search engines"]
    rows = {r.query: r for r in Collection(docs).compare().collect()}
    assert list(rows["geese wolves"].lemma_retrieved) == [1] and rows["geese wolves"].lemma_F1 == 1.0
    assert list(rows["search engines"].stem_retrieved) == [0, 2] and rows["search engines"].stem_P == 1.0
    summary = {r.method: r for r in Collection(docs).summary().collect()}
    assert set(summary) == {"stem", "lemma"} and {r.winner for r in summary.values()} <= {"stem", "lemma", "tie"}
    assert abs(summary["stem"].delta + summary["lemma"].delta) < 1e-9
    truth = {(r.query, r.doc_id) for r in evaluate.ground_truth(docs, ["rank page"]).collect()}
    assert truth == {("rank page", 0), ("rank page", 2)}


def test_empty_collection(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    c = Collection(empty, PLAIN)
    for df in (c.tokens, c.index("inverted"), c.index("kgram"), c.phrase("a phrase here"), c.wildcard("a*"), c.spell("a"), c.phonetic("robert")):
        assert df.count() == 0
    assert [r.in_corpus for r in c.lookup("word").collect()] == [False]
    assert evaluate.test_queries(empty) == list(evaluate.FALLBACK_QUERIES)
    assert {r.vocab_size for r in c.summary().collect()} == {0}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two\n")
    (tmp_path / "b.txt").write_text("Über alles")
    (tmp_path / "c.md").write_text("not read")
    for strict in (True, False):
        got = {r.doc_id: r.text for r in sources.read_text(spark, str(tmp_path), strict).collect()}
        assert got == {"a.txt": "line one\nline two\n", "b.txt": "Über alles"}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("the later a")
    both = sources.read_text(spark, [str(tmp_path), str(tmp_path / "sub")])
    assert {r.doc_id: r.text for r in both.collect()} == {"a.txt": "the later a", "b.txt": "Über alles"}
    versions = spark.createDataFrame([(1, 2, "new"), (1, 1, "old"), (1, None, "no order"), (None, 1, "x"), (2, None, "only")], "doc_id int, v int, text string")
    assert {(r.doc_id, r.text) for r in sources.last_of_each(versions, "v").collect()} == {(1, "new"), (None, "x"), (2, "only")}
    docs = sources.read_text(spark, str(tmp_path))
    sources.store(docs, str(tmp_path / "store"))
    assert sources.read_table(spark, str(tmp_path / "store")).count() == 2
    sources.store_index(Collection(docs, PLAIN).index("inverted"), str(tmp_path / "index"), "term")
    assert spark.read.parquet(str(tmp_path / "index")).count() == 5
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    with pytest.raises(Exception):
        sources.read_text(spark, str(tmp_path)).collect()


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("search engines")
    for expected in (2, 4):
        query = ingest.index_stream(ingest.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), PLAIN)
        query.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (tmp_path / "in" / "b.txt").write_text("rank pages")


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "positions"]


LEXICON = [("quux", "noun"), ("zorn", "noun"), ("run", "verb")]
IRREGULAR = [("quuxen", "quux")]


@pytest.fixture(scope="module")
def lexical(spark):
    return {"lexicon": spark.createDataFrame(LEXICON, "word string, pos string"), "exceptions": spark.createDataFrame(IRREGULAR, "form string, lemma string")}


@pytest.mark.parametrize("words", [lemma.LEXICON_WORDS, 1, 0])
def test_a_callers_lexicon_reaches_every_query(spark, lexical, monkeypatch, words):
    """With forms sent to executors, with words packed, and with terms joined."""
    monkeypatch.setattr(lemma, "LEXICON_WORDS", words)
    docs = spark.createDataFrame([(0, "Two quuxen saw zorns and geese."), (1, "One quux."), (2, "")], "doc_id long, text string")
    c = Collection(docs, AnalyzerConfig(norm="lemma"), **lexical)
    assert {r.doc_id: list(r.tokens) for r in c.arrays.collect()} == {0: ["two", "quux", "saw", "zorn", "geese"], 1: ["one", "quux"], 2: []}
    assert {r.query_term: (r.in_corpus, list(r.docs)) for r in c.lookup("quuxen, zorns, geese, goose").collect()} == {
        "quuxen": (True, [0, 1]), "zorns": (True, [0]), "geese": (True, [0]), "goose": (False, []),
    }
    assert ids(c.phrase("two quuxen")) == ids(c.phrase("two quuxen", "biword")) == [0]
    assert list(c.stages(0).first().stage5_norm) == ["two", "quux", "saw", "zorn", "geese"]
    rows = {r.query: r for r in c.compare(["quuxen", "geese"]).collect()}
    assert list(rows["quuxen"].lemma_retrieved) == [0, 1] and list(rows["quuxen"].stem_retrieved) == [0]
    assert {r.method: r.vocab_size for r in c.summary(["quuxen"]).collect()} == {"stem": 7, "lemma": 6}
    both = Collection(docs, AnalyzerConfig(norm="both"), **lexical)
    assert list(both.arrays.where("doc_id = 0").first().tokens) == ["two", "quux", "saw", "zorn", "gees"]


@pytest.mark.parametrize("words", [lemma.LEXICON_WORDS, 0])
def test_lemmas_of_rows_with_one_id_or_none(spark, monkeypatch, words):
    monkeypatch.setattr(lemma, "LEXICON_WORDS", words)
    texts = [(1, "geese ran"), (1, "wolves slept"), (None, "boxes"), (None, "boxes"), (2, None), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {norm: sorted((str(r.doc_id), list(r.tokens)) for r in Collection(docs, AnalyzerConfig(norm=norm)).arrays.collect()) for norm in ("none", "lemma", "both")}
    assert found["lemma"] == [("1", ["goose", "ran"]), ("1", ["wolf", "slept"]), ("2", []), ("3", []), ("None", ["box"]), ("None", ["box"])]
    assert [(i, len(t)) for i, t in found["none"]] == [(i, len(t)) for i, t in found["lemma"]] == [(i, len(t)) for i, t in found["both"]]
    assert [list(r.stage5_norm) for r in Collection(docs, AnalyzerConfig(norm="lemma")).stages(1).orderBy("stage0_raw").collect()] == [["goose", "ran"], ["wolf", "slept"]]


def test_lemmas_by_forms_by_packed_words_and_by_join(spark, monkeypatch):
    rnd = random.Random(2)
    nouns = sorted({"".join(rnd.choice("aefhimnsxyz") for _ in range(rnd.randint(1, 5))) for _ in range(400)})
    terms = sorted({n[: len(n) - len(new)] + s for n in nouns for s, new in lemma.DETACHMENTS if n.endswith(new)} | set(nouns) | {"none", "zzz"})
    lexicon = spark.createDataFrame([(n, "noun") for n in nouns] + [("zzz", "verb")], "word string, pos string")
    exceptions = spark.createDataFrame([(terms[5], "odd"), (terms[9], terms[9])], "form string, lemma string")
    joined = {r.term: r.lemma for r in lemma.lemma_map(spark.createDataFrame([(t,) for t in terms], "term string"), lexicon, exceptions).collect()}
    forms = lemma.lemma_forms(lexicon, exceptions)
    assert joined == {t: forms.get(t, t) for t in terms}
    monkeypatch.setattr(lemma, "LEXICON_WORDS", 2)
    packed = lemma.lemma_forms(lexicon, exceptions)
    assert isinstance(packed, lemma.PackedLemmas) and joined == dict(zip(terms, packed.many(terms))) and packed.many([None]) == [None]
    monkeypatch.setattr(lemma, "PACKED_WORDS", 3)
    assert lemma.lemma_forms(lexicon, exceptions) is None


def test_two_million_words_without_an_exchange_of_documents(spark):
    lexicon = spark.range(2_000_000).select(F.concat(F.lit("n"), F.conv(F.col("id").cast("string"), 10, 36)).alias("word"), F.lit("noun").alias("pos"))
    lexicon = lexicon.select(F.lower("word").alias("word"), "pos")
    docs = spark.createDataFrame([(1, "n1abs nzzzzzs n0 boxes"), (2, None)], "doc_id long, text string")
    c = Collection(docs, AnalyzerConfig(norm="lemma"), lexicon)
    assert "Exchange" not in c.arrays._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: list(r.tokens) for r in c.arrays.collect()} == {1: ["n1ab", "nzzzzzs", "n0", "boxes"], 2: []}


def test_spelling_in_bulk_against_brute_force(spark):
    rnd = random.Random(8)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 9))) for _ in range(300)} | {"x" * 5000, "ab" * 2500, "aaaa" * 30, "aaaa" * 30 + "b"}
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    asked = rnd.sample(sorted(words), 40) + ["", "a", "zz", "abca" * 30, "aaaa" * 30]
    queries = spark.createDataFrame([(q,) for q in asked] + [(None,)], "query string")
    for far in (1, 2, 3):
        got = {tuple(r) for r in tolerant.spell_join(terms, queries, far).collect()}
        assert got == {(q, w, d) for q in asked for w in words if abs(len(q) - len(w)) <= far and (d := brute_distance(q, w)) <= far}
    assert tolerant.spell_join(terms, queries.where("false")).count() == 0
    assert [r.term for r in tolerant.spell_suggest(terms, "X" * 4999, 1).collect()] == ["x" * 5000]


def test_indexes_in_chunks(spark, plain, monkeypatch):
    whole = {r.term: (r.df, list(r.docs)) for r in plain.index("inverted").collect()}
    assert {r.term: (r.df, list(r.docs)) for r in index.inverted_index(plain.tokens).collect()} == whole
    twice = Collection(plain.docs.union(plain.docs), PLAIN)
    assert {r.term: (r.df, list(r.docs)) for r in twice.index("inverted").collect()} == whole
    monkeypatch.setattr(index, "CHUNK", 2)
    got: dict = {}
    for r in plain.index("inverted").collect():
        assert r.df == whole[r.term][0] and list(r.docs) == sorted(r.docs) and r.chunk < -(-r.df // 2)
        got.setdefault(r.term, []).extend(r.docs)
    assert {t: sorted(d) for t, d in got.items()} == {t: d for t, (_, d) in whole.items()}
    assert len([r for r in plain.lookup("pages").collect()]) in (1, 2)
    grams = plain.index("kgram").where("gram = '$r'").collect()
    assert sorted(t for r in grams for t in r.terms) == ["rank", "ranked", "ranks", "recieve", "robert", "running", "rupert"]


@pytest.mark.parametrize("norm", ["none", "stem"])
def test_stored_collection(docs, tmp_path, norm):
    c = Collection(docs, AnalyzerConfig(norm=norm))
    kept = stored.build(c, str(tmp_path))
    text = lambda df: sorted(map(str, df.collect()))
    for query in ("search engines rank", "search engines", "pages", "the of", "no such words", "engines rank pages"):
        for method in ("positional", "biword", "false_positives"):
            assert text(kept.phrase(query, method)) == text(c.phrase(query, method)), (query, method)
    assert text(kept.lookup("pages, Geese wolves, missing")) == text(c.lookup("pages, Geese wolves, missing"))
    assert text(kept.lookup()) == text(c.lookup())
    assert text(kept.wildcard("r*k*")) == text(c.wildcard("r*k*")) and text(kept.spell("rnak")) == text(c.spell("rnak"))
    assert text(kept.phonetic("Robart")) == text(c.phonetic("Robart"))
    times = {r.query_term: r for r in kept.lookup_latency("pages, missing", iterations=50).collect()}
    assert times["pages"].in_corpus and not times["missing"].in_corpus and min(min(r.search_us, r.retrieval_us) for r in times.values()) > 0
    plan = kept.phrase("search engines")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_evaluation_reports(docs, spark):
    c = Collection(docs)
    summary = {r.method: r for r in c.summary().collect()}
    nested = json.loads(c.summary_json().first().summary)
    assert set(nested) == {"stemming", "lemmatization"}
    assert nested["stemming"]["vocab_size"] == summary["stem"].vocab_size and nested["lemmatization"]["lexical_validity"] == f"{summary['lemma'].lexical_validity}%"
    why = c.justification().first()
    higher = lambda a, b: "stem" if a > b else "lemma" if b > a else "tie"
    assert why.winner == higher(why.stem_score, why.lemma_score) and why.higher_compression == higher(why.stem_compression_rate, why.lemma_compression_rate)
    assert why.higher_validity == higher(why.stem_lexical_validity, why.lemma_lexical_validity)


def test_leading_documents(spark):
    texts = [(i, "a the") for i in range(90)] + [(90, "web search pages"), (91, "x"), (92, "two words")]
    late = spark.createDataFrame(texts, "doc_id long, text string")
    assert evaluate.test_queries(late) == ["web search", "two words", "lung cancer"]
    assert Collection(late, PLAIN).defaults()["phrase"] == "web search"


def test_phrase_report(plain):
    row = plain.phrase_report("search engines rank").first()
    assert list(row.tokens) == ["search", "engines", "rank"] and list(row.pairs) == ["search engines", "engines rank"]
    assert (row.n_biword, row.n_positional, row.n_false_positives) == (2, 1, 1)
    one, none = plain.phrase_report("pages").first(), plain.phrase_report("the").first()
    assert list(one.pairs) == ["pages"] and (one.n_biword, one.n_positional, one.n_false_positives) == (3, 3, 0)
    assert (list(none.tokens), list(none.pairs), none.n_biword) == ([], [], 0)


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "index.noun").write_text("  1 preamble\ngoose n 4 3 @ ~ #m 4 1 02\nice_cream n 1 1 @ 1 0 03\n")
    (tmp_path / "index.verb").write_text("run v 41 6 @ 41 30 01\n")
    (tmp_path / "noun.exc").write_text("geese goose\noxen ox\nbrethren brother brethren\n")
    lexicon, exceptions = sources_lexicon.read_lexicon(spark, str(tmp_path))
    assert {tuple(r) for r in lexicon.collect()} == {("goose", "noun"), ("ice cream", "noun"), ("run", "verb")}
    assert {tuple(r) for r in exceptions.collect()} == {("geese", "goose"), ("oxen", "ox"), ("brethren", "brother"), ("brethren", "brethren")}
    docs = spark.createDataFrame([(0, "geese oxen")], "doc_id long, text string")
    assert list(Collection(docs, AnalyzerConfig(norm="lemma"), lexicon, exceptions).arrays.first().tokens) == ["goose", "ox"]


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).selectExpr("id as doc_id", "'a b' as text").coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).selectExpr("id as doc_id", "'a b' as text").repartition(8 * cores).write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/many")
    assert sources.read_table(spark, f"{tmp_path}/one").rdd.getNumPartitions() == cores
    many = spark.read.parquet(f"{tmp_path}/many")
    assert sources.spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions() and sources.read_table(spark, f"{tmp_path}/many").count() == 100


def test_defaults(docs, spark):
    c = Collection(docs, PLAIN)
    assert c.defaults() == {"phrase": "web scale", "lookup": "42, boxes, children, missingword", "wildcard": "b*s", "spelling": "boxe", "phonetic": "boxes"}
    assert [r.doc_id for r in c.phrase().collect()] == [0]
    grams = c.wildcard_grams("ra*ed").first()
    assert list(grams.grams) == ["$r", "ra", "ed", "d$"] and grams.n_candidates == 1
    assert {r.kind for r in c.samples().collect()} == {"biword", "positional", "kgram"}
    tiny = Collection(spark.createDataFrame([(0, "zz")], "doc_id long, text string"), PLAIN)
    assert tiny.lookup().count() == 1 and tiny.defaults()["spelling"] == "word" and tiny.phrase().count() == 0


def test_stems_in_sql_are_stems():
    """The oracle's rules and the stemmer's, written apart, agree."""
    rnd = random.Random(5)
    ends = ["s", "ed", "ing", "ies", "ied", "eed", "ational", "alli", "ally", "logi", "bli", "fulli", "ness", "ement", "ion", "sion", "e", "ll", "y", "ous", "izer", "iviti", "ical", ""]
    words = {"".join(rnd.choice("aeiouybcdlnstxyz") for _ in range(rnd.randint(1, 7))) + rnd.choice(ends) + rnd.choice(ends) for _ in range(20_000)} | set(porter.IRREGULAR)
    words |= {"éclairs", "straßen", "überly", "naïveness"}
    con = duckdb.connect()
    con.execute("create table words (term varchar)")
    con.executemany("insert into words values (?)", [(w,) for w in sorted(words)][:8000])
    got = dict(con.execute(f"with {oracle.stems('select term from words', 'stems')} select term, stem from stems").fetchall())
    assert got == {w: porter.stem(w) for w in got} and len(got) == 8000
