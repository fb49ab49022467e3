"""Display helpers: tags, escaping, snippets and highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import Lexicon, let


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(tags, "[,，、;；\\s]+"), lambda x: F.trim(x)), lambda x: x != "")


ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def plain_excerpt(text: Column, chars: int = 160) -> Column:
    """Trimmed, cut to chars with an ellipsis, escaped."""
    own = F.trim(text)
    return escape_html(F.when(F.length(own) > chars, F.concat(F.substring(own, 1, chars), F.lit("…"))).otherwise(own))


def snippet_start(terms: Column, wanted: list[str], width: int = 24, lead: int = 6) -> Column:
    """First token of the window with most query terms: windows start `lead` tokens before a hit; ties go to the first.
    Null without a hit. One sorted array of hits, no explode."""
    places = F.filter(F.transform(terms, lambda t, i: F.when(t.isin(wanted), i)), lambda i: i.isNotNull())

    def best(places: Column) -> Column:
        def window(p: Column, i: Column) -> Column:
            s = F.greatest(p - lead, F.lit(0))
            # places differ, so a window's hits are among the few before and after this one
            near = F.slice(places, F.greatest(i - lead, F.lit(0)) + 1, F.lit(lead + width))
            return F.struct((-F.size(F.filter(near, lambda x: (x >= s) & (x < s + width)))).alias("n"), s.alias("s"))

        return F.array_min(F.transform(places, window))["s"]

    return let(places, best)


def escaped(s: str) -> str:
    for a, b in ESCAPES:
        s = s.replace(a, b)
    return s


def marked(text: str, tokens: list[dict], terms: set[str], begin: int = 0, end: int | None = None) -> str:
    """The text from begin to end with its matches in <em>, everything else escaped; nothing of it is lost."""
    out, at, end = [], begin, len(text) if end is None else end
    for t in tokens:
        if t["term"] in terms and t["start"] >= at and t["end"] <= end:
            out += [escaped(text[at : t["start"]]), "<em>", escaped(text[t["start"] : t["end"]]), "</em>"]
            at = t["end"]
    return "".join([*out, escaped(text[at:end])])


def snippet(text: str | None, terms: set[str], lexicon: Lexicon | None = None, width: int = 24, chars: int = 240, lead: int = 6) -> str:
    """The window of `width` tokens with most matches, marked; cut between tokens, so markup is never split."""
    text = text or ""
    tokens = (lexicon or Lexicon()).analyze(text)
    if not tokens:
        own = text.strip()
        return escaped(own[:chars] + "…" if len(own) > chars else own)
    hits = [i for i, t in enumerate(tokens) if t["term"] in terms]
    starts = [max(0, h - lead) for h in hits]
    first = min(starts, key=lambda s: (-sum(s <= h < s + width for h in hits), s)) if hits else 0
    window = tokens[first : first + width]
    while len(window) > 1 and window[-1]["end"] - window[0]["start"] > chars:
        window.pop()
    a, b = window[0]["start"], window[-1]["end"]
    return ("…" if a > 0 else "") + marked(text, window, terms, a, b) + ("…" if b < len(text) else "")
