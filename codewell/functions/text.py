"""Text analysis as column expressions: paragraphs, tokens, stop words. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words that can occur as runs of a-z.
STOPWORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven
    isn ma mightn mustn needn shan shouldn wasn weren won wouldn""".split()
)
# Unicode line boundaries besides CR LF, and white space.
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: lines are trimmed, a blank line closes a paragraph, its lines are joined by one space.

    NULL gives NULL; a text of blank lines gives an empty array.
    """
    lines = F.transform(F.split(text, f"\r\n|[{LINE_ENDS}]", -1), lambda x: F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+\\z", ""))
    pieces = F.filter(F.split(F.array_join(lines, "\n"), "\n\n+", -1), lambda p: F.regexp_replace(p, "\n", "") != "")
    return F.transform(pieces, lambda p: F.regexp_replace(F.regexp_replace(p, "^\n|\n\\z", ""), "\n", " "))


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Maximal runs of a-z of the lower-cased text without stop words, repeats kept, in order."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " ", -1)
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords)) if stopwords else F.filter(words, lambda w: w != "")
