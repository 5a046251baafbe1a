"""The analyzer and its parts as DuckDB SQL, made from the same steps as the columns."""

from __future__ import annotations

from lexiloom.functions.config import STOP_WORDS, AnalyzerConfig
from lexiloom.functions.text import STEPS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def word_tokens(text: str) -> str:
    for pattern, replacement in STEPS:
        for k in "123":
            replacement = replacement.replace(f"${k}", f"\\{k}")
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return f"list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+'))"


def without_stop_words(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: lower(w) not in ({', '.join(map(quoted, STOP_WORDS))}))"


def arrays(cfg: AnalyzerConfig, name: str = "arrays", abbreviations: str = "", ordinals: bool = False) -> str:
    """A common table (doc_id, tokens). abbreviations: a common table of words that keep their period; with ordinals, numbers before a word in lower case do, too."""
    text = "replace(text, '-', ' ')" if cfg.hyphens else "text"
    text = f"lower({text})" if cfg.lowercase else text
    if abbreviations:
        text = _with_periods_kept(text, abbreviations, ordinals)
    tokens = without_stop_words(word_tokens(text)) if cfg.stopwords else word_tokens(text)
    return f"{name} as (select doc_id, {tokens} as tokens from documents)"


def _with_periods_kept(text: str, abbreviations: str, ordinals: bool) -> str:
    """The text with an underscore before the period of every abbreviation and ordinal, so that it is no token; word by word, for there is no looking ahead or behind."""
    pieces = f"regexp_extract_all({text}, '\\s+|[^\\s]+')"
    # A piece of white space stands between two others; the last piece has nothing behind it.
    known = rf"regexp_extract(x, '^(?:.*[\s;@#$%&?!\"()\[\]{{}}<>«»“”„‘’`])?([\p{{L}}\p{{N}}]+)\.[,;:)\]]*$', 1)"
    marked = rf"regexp_replace(x, '\.([,;:)\]]*)$', '_.\1')"
    number = rf"regexp_full_match({known}, '.*\p{{N}}')"
    listed = f"{known} in (select word from {abbreviations})" + (f" and not {number}" if ordinals else "")
    ordinal = rf" or (regexp_full_match({known}, '\p{{N}}+') and suffix(x, '.') and regexp_matches(coalesce(p[i + 2], ''), '^\p{{Ll}}'))" if ordinals else ""
    return f"(select string_agg(case when i < len(p) - 1 and {known} <> '' and ({listed}{ordinal}) then {marked} else x end, '' order by i) from (select p, unnest(p) as x, unnest(generate_series(1, len(p))) as i from (select {pieces} as p)))"


def abbreviations() -> str:
    """Common tables that end in abbreviations (word, n_with, n_without, score)."""
    from lexiloom.operators.abbreviations import RATE, RUN, THRESHOLD

    letters, inner = "length(replace(word, '.', ''))::double", "(length(word) - length(replace(word, '.', '')))"
    return f"""runs as (select unnest(regexp_extract_all(lower(replace(coalesce(text, ''), '-', ' ')), {quoted(RUN)})) as run from documents),
marked as (select run, suffix(run, '.') and not suffix(run, '..') and run <> '.' as ends from runs),
counts as (select case when ends then left(run, length(run) - 1) else run end as word, sum(ends::int)::bigint as n_with, sum((not ends)::int)::bigint as n_without from marked group by 1),
scored as (select *, 2 * (n_with * (ln({RATE}::double) - ln(p)) + n_without * (ln((1 - {RATE})::double) - ln(1 - p))) * exp(-{letters}) * ({inner} + 1) * pow({letters}, -n_without) as score
from counts, (select least(sum(n_with) / sum(n_with + n_without), 1 - 1e-9) as p from counts) where n_with > 0 and regexp_matches(word, '\\p{{L}}')),
abbreviations as (select word, n_with, n_without, score from scored where score >= {THRESHOLD})"""


def tokens(cfg: AnalyzerConfig, **options) -> str:
    """Common tables (doc_id, tokens) and (doc_id, pos, term)."""
    return arrays(cfg, **options) + ", tokens as (select doc_id, unnest(generate_series(0, len(tokens) - 1))::int as pos, unnest(tokens) as term from arrays)"


def pairs() -> str:
    """A common table of biwords."""
    return "biwords as (select distinct doc_id, tokens[i] || ' ' || tokens[i + 1] as biword from (select doc_id, tokens, unnest(generate_series(1, len(tokens) - 1)) as i from arrays))"


def soundex(term: str) -> str:
    """The Soundex contract: digits for letters, 0 for all others, equal runs collapsed, zeros dropped; the first letter is kept."""
    upper = f"upper(replace({term}, 'ß', 'ss'))"
    out = f"regexp_replace(translate({upper}, 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000000111122222222334556'), '[^0-6]', '0', 'g')"
    for d in "123456":
        out = f"regexp_replace({out}, '{d}+', '{d}', 'g')"
    return f"rpad({upper}[1] || substr(replace(substr({out}, 2), '0', ''), 1, 3), 4, '0')"


# Letters of the test tables, and their kin, that take two bytes.
ACCENTED = "àáâãäçèéêëìíîïñòóôõöùúûüýß"


def distance(a: str, b: str) -> str:
    """The edit distance by letters: the built-in counts bytes, so accented letters become control characters."""
    single = lambda x: f"translate({x}, '{ACCENTED}', {' || '.join(f'chr({i + 1})' for i in range(len(ACCENTED)))})"
    return f"levenshtein({single(a)}, {single(b)})::int"


def kgrams(k: int = 2) -> str:
    """A common table (gram, term) over terms."""
    return f"grams as (select distinct substr('$' || term || '$', i::int, {k}) as gram, term from (select term, unnest(generate_series(1, length(term) + 3 - {k})) as i from (select distinct term from tokens)))"


# ---- stems, by the rules as published, over a vocabulary


def _shape(word: str) -> str:
    """c for consonants and v for vowels, letter by letter."""
    letters = f"list_prepend('', regexp_extract_all({word}, '.'))"
    return f"list_reduce({letters}, lambda p, c: p || case when c in ('a', 'e', 'i', 'o', 'u') or (c = 'y' and suffix(p, 'c')) then 'v' else 'c' end)"


def _turns(cut: int) -> str:
    """The measure of the word less its last letters."""
    return f"len(regexp_extract_all(left(p, length(w) - {cut}), 'v+c+'))"


def _less(cut: int) -> str:
    return f"left(w, length(w) - {cut})"


def _longest(rules: dict[str, str], condition) -> str:
    """The longest suffix that fits decides; condition: what must hold of the word less so many letters."""
    cases = [
        f"when suffix(w, '{s}') then case when {condition(s)} then {_less(len(s))} || '{new}' else w end" for s, new in sorted(rules.items(), key=lambda r: -len(r[0]))
    ]
    return f"case {' '.join(cases)} else w end"


def stems(source: str, name: str) -> str:
    """Common tables that end in name (term, stem) for a query of distinct lower-case terms."""
    from lexiloom.functions.porter import IRREGULAR, STEP2, STEP3, STEP4

    short = "(right(left(p, {n}), 3) = 'cvc' and left(w, {n})[-1] not in ('w', 'x', 'y'))"
    irregular = " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in IRREGULAR.items())
    positive = lambda s: f"{_turns(len(s))} > 0"
    n = "(length(w) - k)"
    cut, shape = f"left(w, {n})", f"left(p, {n})"
    second = {a: b for a, b in STEP2 if a not in ("abli", "alli")} | {"bli": "ble", "fulli": "ful"}
    steps = [
        f"case when length(w) = 4 and suffix(w, 'ies') then {_less(1)} when suffix(w, 'sses') or suffix(w, 'ies') then {_less(2)} when suffix(w, 'ss') then w when suffix(w, 's') then {_less(1)} else w end",
        # k: letters of the ending to take off, 0 for none; then what the rest needs.
        f"""case when suffix(w, 'ied') then left(w, length(w) - case when length(w) = 4 then 1 else 2 end)
        when suffix(w, 'eed') then case when {_turns(3)} > 0 then {_less(1)} else w end
        when k = 0 or not contains({shape}, 'v') then w
        when suffix({cut}, 'at') or suffix({cut}, 'bl') or suffix({cut}, 'iz') then {cut} || 'e'
        when {n} > 1 and {cut}[-1] = {cut}[-2] and suffix({shape}, 'c') then case when {cut}[-1] in ('l', 's', 'z') then {cut} else left(w, {n} - 1) end
        when len(regexp_extract_all({shape}, 'v+c+')) = 1 and ({short.format(n=n)} or {shape} = 'vc') then {cut} || 'e' else {cut} end""",
        f"case when suffix(w, 'y') and length(w) > 2 and p[-2] = 'c' then {_less(1)} || 'i' else w end",
        f"case when suffix(w, 'alli') and {_turns(4)} > 0 then {_less(2)} else w end",
        f"case when suffix(w, 'alli') then w when suffix(w, 'logi') then case when {_turns(3)} > 0 then {_less(1)} else w end else {_longest(second, positive)} end",
        _longest(dict(STEP3), positive),
        _longest({s: "" for s in STEP4}, lambda s: f"{_turns(len(s))} > 1" + (f" and {_less(3)}[-1] in ('s', 't')" if s == "ion" else "")),
        f"case when suffix(w, 'e') and ({_turns(1)} > 1 or ({_turns(1)} = 1 and not {short.format(n='(length(w) - 1)')})) then {_less(1)} else w end",
        f"case when suffix(w, 'll') and {_turns(1)} > 1 then {_less(1)} else w end",
    ]
    tables = [f"{name}0 as (select term, term as w, length(term) <= 2 or term in ({', '.join(map(quoted, IRREGULAR))}) as done from ({source}))"]
    for i, step in enumerate(steps):
        ending = "case when suffix(w, 'ing') then 3 when suffix(w, 'ed') then 2 else 0 end"
        tables.append(f"{name}{i + 1} as materialized (select term, case when done then w else {step} end as w, done from (select *, {_shape('w')} as p, {ending} as k from {name}{i}))")
    tables.append(f"{name} as (select term, case term {irregular} else w end as stem from {name}{len(steps)})")
    return ", ".join(tables)
