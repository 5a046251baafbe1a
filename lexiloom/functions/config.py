"""Analyzer options and fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass

NORMS = ("none", "stem", "lemma", "both")


@dataclass(frozen=True)
class AnalyzerConfig:
    """Options of the analyzer; a plan-time constant. norm: none, stem, lemma, or both (lemma, then stem).

    abbreviations: words, in lower case, that keep a period after them, so that they are no tokens, unless they end the text;
    operators.abbreviations finds those of a collection. ordinals: numbers before a period and a word in lower case are treated alike.
    """

    hyphens: bool = True
    lowercase: bool = True
    stopwords: bool = True
    norm: str = "stem"
    abbreviations: tuple[str, ...] = ()
    ordinals: bool = False

    def __post_init__(self) -> None:
        if self.norm not in NORMS:
            raise ValueError(f"norm must be one of {', '.join(NORMS)}")


# English stop words that are purely alphanumeric, with the stubs that contractions leave.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()
)

# Words that the tokeniser splits in two.
SPLIT_WORDS = {"cannot": "can not", "gonna": "gon na", "gotta": "got ta", "wanna": "wan na", "lemme": "lem me", "gimme": "gim me"}
