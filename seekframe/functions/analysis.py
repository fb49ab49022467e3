"""Text analysis: mixed Han / Latin / digit text to terms with offsets and positions.

Everything but the cutting of Han runs is one regular expression inside the JVM. Only rows that have Han characters go
to a Python worker, where a dictionary cuts their runs by forward and backward maximum matching.

Offsets are code points. Texts may be null (no tokens).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = "㐀-䶿一-鿿豈-﫿"
#: Runs: Han; ASCII letters; digits, with inner points and commas.
RUNS = rf"[{HAN}]+|[a-z]+|[0-9]+(?:[.,][0-9]+)*"
LATIN_RUNS = r"[a-z]+|[0-9]+(?:[.,][0-9]+)*"
#: Particles that are left out on request.
STOPWORDS = ("的", "了", "着", "过", "吗", "呢", "吧", "啊", "呀", "哦", "嗯", "啦", "么")


def _folding() -> tuple[str, str]:
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {"　": " ", "‘": "'", "’": "'", "´": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
    pairs |= {chr(c): chr(c + 32) for c in range(65, 91)}
    pairs = {a: b.lower() if "A" <= b <= "Z" else b for a, b in pairs.items()}
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()
_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)


def fold(text: Column) -> Column:
    """Full-width forms, quotes and dashes to ASCII and A-Z to a-z, one character for one."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def char_type(c: str) -> str:
    """han, latin, digit or other; accented letters, kana and surrogates are other, that is, boundaries."""
    if "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "豈" <= c <= "﫿":
        return "han"
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return "latin"
    return "digit" if "0" <= c <= "9" else "other"


def latin_terms(text: Column) -> Column:
    """array<string>: the Latin and numeric terms of a text in order."""
    return F.regexp_extract_all(fold(text), F.lit(LATIN_RUNS), F.lit(0))


class Lexicon:
    """Words with frequencies and their longest length; sent to the workers that cut Han runs."""

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.freq: dict[str, int] = {}
        self.longest = 1
        for word in words:
            self.add(word)

    def add(self, word: str, freq: int = 1) -> None:
        self.freq[word] = max(freq, self.freq.get(word, 0))
        self.longest = max(self.longest, len(word))

    def __contains__(self, word: str) -> bool:
        return word in self.freq

    def __len__(self) -> int:
        return len(self.freq)

    def longest_match(self, text: str, at: int) -> int:
        """Length of the longest word at a place, or -1."""
        for n in range(min(self.longest, len(text) - at), 0, -1):
            if text[at : at + n] in self.freq:
                return n
        return -1

    def starts_with(self, prefix: str) -> bool:
        return any(w.startswith(prefix) for w in self.freq)

    def forward(self, run: str) -> list[str]:
        out, at = [], 0
        while at < len(run):
            n = max(1, self.longest_match(run, at))
            out.append(run[at : at + n])
            at += n
        return out

    def backward(self, run: str) -> list[str]:
        out, end = [], len(run)
        while end:
            n = next((n for n in range(min(self.longest, end), 1, -1) if run[end - n : end] in self.freq), 1)
            out.append(run[end - n : end])
            end -= n
        return out[::-1]

    @staticmethod
    def _cost(cut: list[str]) -> int:
        return 100 * len(cut) + sum(len(w) == 1 for w in cut)

    @staticmethod
    def _spread(cut: list[str]) -> int:
        mean = sum(map(len, cut)) / len(cut)
        return round(1000 * sum((len(w) - mean) ** 2 for w in cut) / len(cut))

    def cut(self, run: str) -> list[str]:
        """Of both directions the one with fewer words (and singles); then the more uneven one; then forward."""
        a, b = self.forward(run), self.backward(run)
        if a == b:
            return a
        if self._cost(a) != self._cost(b):
            return a if self._cost(a) < self._cost(b) else b
        return b if self._spread(b) > self._spread(a) else a

    def analyze(self, text: str | None, stopwords: bool = False) -> list[dict]:
        import re

        out = []
        for m in re.finditer(RUNS, (text or "").translate(_TABLE)):
            words, at = (self.cut(m[0]), m.start()) if char_type(m[0][0]) == "han" else ([m[0]], m.start())
            for w in words:
                if not (stopwords and w in STOPWORDS):
                    out.append({"term": w, "start": at, "end": at + len(w), "position": len(out)})
                at += len(w)
        return out


TOKEN = "array<struct<term:string,start:int,`end`:int,position:int>>"


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once: inside a lambda an expression would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_sums(values: Column) -> Column:
    """An array of ints as its running sums, by adding what is 1, 2, 4, ... before."""

    def step(held: Column, reach: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i >= reach, x + F.get(held, i - reach)).otherwise(x))

    return F.aggregate(F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda k: k < F.size(values)), values, step)


def latin_tokens(text: Column) -> Column:
    """array of (term, start, end, position) of a text without Han, in built-in functions."""

    def of(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["gaps"], 1, F.size(x["terms"])), x["terms"], lambda gap, term: F.length(gap) + F.length(term))
        return let(F.struct(x["terms"].alias("terms"), let(lengths, running_sums).alias("ends")), token)

    def token(x: Column) -> Column:
        return F.transform(x["terms"], lambda t, i: F.struct(t.alias("term"), (F.get(x["ends"], i) - F.length(t)).alias("start"), F.get(x["ends"], i).alias("end"), i.alias("position")))

    return let(F.struct(latin_terms(text).alias("terms"), F.split(fold(text), LATIN_RUNS, -1).alias("gaps")), of).cast(TOKEN)


def term_arrays(rows: DataFrame, text: str, keys: list[str], lexicon: Lexicon | None = None, stopwords: bool = False) -> DataFrame:
    """(keys..., terms): the terms of each row in order. Rows with Han are cut by the lexicon in Arrow batches, all others
    are split by the JVM. Without a lexicon no row is sent to Python and Han characters are boundaries."""
    native = lambda df: df.select(*keys, latin_terms(F.col(text)).alias("terms"))
    if lexicon is None:
        return native(rows)
    mixed = F.coalesce(F.col(text), F.lit("")).rlike(f"[{HAN}]")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(terms=[[t["term"] for t in lexicon.analyze(value, stopwords)] for value in batch[text]])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return native(rows.filter(~mixed)).unionByName(rows.filter(mixed).select(*keys, text).mapInPandas(cut, f"{kinds}, terms array<string>"))


def tokens(rows: DataFrame, text: str, keys: list[str], lexicon: Lexicon | None = None, stopwords: bool = False) -> DataFrame:
    """(keys..., term, position): the tokens of each row."""
    return term_arrays(rows, text, keys, lexicon, stopwords).select(*keys, F.posexplode("terms").alias("position", "term")).select(*keys, "term", "position")


def places_by_term(terms: Column) -> Column:
    """array of (term, positions) of an array of terms: sorted once, cut where the term changes."""

    def starts(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
        return let(F.struct(s.alias("s"), first.alias("first")), cut)

    def cut(x: Column) -> Column:
        def one(a: Column, j: Column) -> Column:
            n = F.coalesce(F.get(x["first"], j + 1), F.size(x["s"])) - a
            return F.struct(F.get(x["s"], a)["term"].alias("term"), F.slice(x["s"], a + 1, n)["position"].alias("positions"))

        return F.transform(x["first"], one)

    return let(F.array_sort(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("position")))), starts)


def counts_by_term(terms: Column) -> Column:
    """array of (term, tf) of an array of terms, in the order of terms."""

    def starts(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull())
        return let(F.struct(s.alias("s"), first.alias("first")), cut)

    def cut(x: Column) -> Column:
        end = lambda j: F.coalesce(F.get(x["first"], j + 1), F.size(x["s"]))
        return F.transform(x["first"], lambda a, j: F.struct(F.get(x["s"], a).alias("term"), (end(j) - a).cast("long").alias("tf")))

    return let(F.sort_array(terms), starts)


def query_terms(query: str, lexicon: Lexicon | None = None) -> list[str]:
    """The distinct terms of a query in order."""
    return list(dict.fromkeys(t["term"] for t in (lexicon or Lexicon()).analyze(query)))


def normalize_entry(entry: str) -> str:
    """A dictionary entry: folded, lower-cased below U+3000, without white space."""
    return "".join(c.lower() if c < "　" else c for c in entry.translate(_TABLE) if not c.isspace())


def dictionary_words(lines: DataFrame) -> DataFrame:
    """(word) of dictionary lines (value): comments go, entries are split at white space and commas, folded, lower-cased
    below U+3000, distinct."""
    parts = F.explode(F.split(F.col("value"), "[\\s,，、]+"))
    words = lines.filter(~F.trim("value").startswith("#")).select(parts.alias("word")).filter(~F.col("word").startswith("#"))
    letters = F.transform(F.split(fold(F.col("word")), ""), lambda c: F.when(c < "\u3000", F.lower(c)).otherwise(c))
    return words.select(F.regexp_replace(F.array_join(letters, ""), "\\s", "").alias("word")).filter("word <> ''").distinct()
