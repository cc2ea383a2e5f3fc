"""Full-text search with a posting table: English stems, positions, web-style queries and a rank by distance and frequency.

`postings` makes a row for each (document, term) with the term's positions, a document's rows at once; `write_index` writes them in buckets by the
term's hash, so a search reads the buckets of its terms only. A search gathers the postings of its terms by document, tests
the query and computes the rank with built-in functions, and joins the documents' rows to the k best alone.

Words are letters and digits; a number may have a point. Stop words are no terms, but count as positions. The rank follows
a relational database's: for one word, or alternatives, the mean over the query's terms of
w * (1 + 1/4 + 1/9 + ...) / (pi^2 / 6) over a term's occurrences; for words that must all be there, 1 - product(1 - c) with
c = sqrt(w * w / (1.005 + 0.05 * exp(distance / 1.5 - 2))) over pairs of occurrences of different terms; w = 0.1.

Edge cases: null and empty texts have no terms; a query of stop words alone finds nothing; a query that a document without
any of its terms satisfies (only negations) reads all documents; repeated ids share their postings.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

WEIGHT = 0.1
BUCKETS = 64
#: Positions beyond count as the last, and no more of a term's positions are kept.
LAST_POSITION, MOST_POSITIONS = 16_383, 256
#: Words of documents that a task holds at a time, if no document has more.
HELD_WORDS = 500_000
WORD = r"\d+\.\d+|[\p{L}\p{N}]+"

# The English stop words of the text search configuration.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# The published rules of the English (Porter 2) stemmer.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
AS_IS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    """Where what follows the first non-vowel after a vowel begins, from `start` on."""
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word)
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    second = _region(w, first)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in AS_IS:
        return w
    # participles
    if (e := _ending(w, ("eed", "eedly"))) is not None:
        w = w[: len(w) - len(e)] + "ee" if len(w) - len(e) >= first else w
    elif (e := _ending(w, ("ed", "edly", "ing", "ingly"))) is not None and re.search("[aeiouy]", w[: len(w) - len(e)]):
        w = w[: len(w) - len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLE):
            w = w[:-1]
        elif len(w) <= first and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # endings after the first region's start
    e = _ending(w, SECOND)
    if e and len(w) - len(e) >= first and (e != "ogi" or w.endswith("logi")) and (e != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: len(w) - len(e)] + SECOND[e]
    e = _ending(w, THIRD)
    if e and len(w) - len(e) >= (second if e == "ative" else first):
        w = w[: len(w) - len(e)] + THIRD[e]
    e = _ending(w, FOURTH)
    if e and len(w) - len(e) >= second and (e != "ion" or w.endswith(("sion", "tion"))):
        w = w[: len(w) - len(e)]
    if w.endswith("e") and (len(w) - 1 >= second or (len(w) - 1 >= first and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.lower()


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes come to `most` at most, or of one."""
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if held:
        yield first, len(sizes)


def _posted(key: list[str]):
    """Documents' words -> key, term, positions. Each word of some documents is stemmed once, and their postings are made by
    one sort of numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("_words")).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in _cuts(sizes, HELD_WORDS):
                b, n = batch.slice(i, j - i), sizes[i:j]
                coded = b.column("_words").flatten().dictionary_encode()
                terms: dict[str, int] = {}
                number = np.array([-1 if w in STOP_WORDS else terms.setdefault(stem(w), len(terms)) for w in coded.dictionary.to_pylist()])
                term = number[coded.indices.to_numpy()]
                doc = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(n) - n, n), LAST_POSITION)
                group, at = (doc * max(len(terms), 1) + term)[term >= 0], at[term >= 0]
                order = np.argsort(group, kind="stable")  # positions stay in order
                group, at = group[order], at[order]
                new = np.ones(len(group), bool)
                new[1:] = (group[1:] != group[:-1]) | (at[1:] != at[:-1])
                group, at = group[new], at[new]
                begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
                place = np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))
                group, at = group[place < MOST_POSITIONS], at[place < MOST_POSITIONS]
                one, count = np.unique(group, return_counts=True)
                doc, term = np.divmod(one, max(len(terms), 1))
                positions = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(doc)) for c in key), pa.array(list(terms), pa.string()).take(pa.array(term)), positions], [*key, "term", "positions"])

    return work


def postings(docs: DataFrame, key: list[str], text: str = "search_text") -> DataFrame:
    """Documents -> key, term, positions (ascending, from 1). Documents of one key have rows of their own; a search takes
    them together."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select(*key, words.alias("_words"))
    return rows.mapInArrow(_posted(key), StructType([*(rows.schema[c] for c in key), StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))]))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(posted: DataFrame, folder: str) -> None:
    """Postings in folders by the term's hash, sorted by term, so that a term's rows are found by the files' statistics. A
    bucket is dealt to several tasks by document, as a common term may fill it."""
    rows = posted.withColumn("bucket", _bucket(F.col("term")))
    rows.repartition("bucket", F.pmod(F.xxhash64(*[c for c in posted.columns if c not in ("term", "positions")]), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(folder)


@dataclass(frozen=True)
class Word:
    """A term, or a phrase of terms with their distances from the first; negated or not."""

    terms: tuple[str, ...]
    at: tuple[int, ...]
    wanted: bool = True


@dataclass(frozen=True)
class Query:
    """Alternatives of words that must all hold."""

    alternatives: tuple[tuple[Word, ...], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({t for a in self.alternatives for w in a for t in w.terms})

    @property
    def together(self) -> bool:
        """Ranked by pairs: the query is a conjunction or a phrase."""
        only = self.alternatives[0] if len(self.alternatives) == 1 else ()
        return len(only) > 1 or (len(only) == 1 and only[0].wanted and len(only[0].terms) > 1)

    @property
    def open(self) -> bool:
        """Whether a document without any of the terms matches."""
        return any(all(not w.wanted for w in a) for a in self.alternatives)


def parse(query: str) -> Query:
    """Words are joined by and; "or" between words makes alternatives, - before a word or phrase negates it, quotes make a
    phrase, in which stop words keep their places. Anything else is punctuation."""
    out: list[list[Word]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if not minus and word.lower() == "or":
            out.append([])
            continue
        words = re.findall(r"\d+\.\d+|[^\W_]+", (phrase or word).lower())
        kept = [(stem(w), k) for k, w in enumerate(words) if w not in STOP_WORDS]
        if kept:
            out[-1].append(Word(tuple(t for t, _ in kept), tuple(k - kept[0][1] for _, k in kept), not minus))
    return Query(tuple(tuple(a) for a in out if a))


def _holds(word: Word, positions: dict[str, Column]) -> Column:
    if len(word.terms) == 1:
        test = positions[word.terms[0]].isNotNull()
    else:  # where the phrase may begin, by each of its terms
        begins = [F.transform(positions[t], lambda p: p - F.lit(k)) for t, k in zip(word.terms, word.at, strict=True)]  # noqa: B023
        test = F.coalesce(F.size(functools.reduce(F.array_intersect, begins)) > 0, F.lit(False))
    return test if word.wanted else ~test


def _rank(query: Query, positions: dict[str, Column]) -> Column:
    terms = query.terms
    if query.together and len(terms) > 1:
        rest = F.lit(1.0)
        for i, a in enumerate(terms):
            for b in terms[:i]:
                near = lambda x, y: F.when(F.abs(x - y) > 100, F.lit(1e-30)).otherwise(1 / (F.lit(1.005) + 0.05 * F.exp(F.abs(x - y) / F.lit(1.5) - 2)))
                other = positions[b]
                pairs = F.flatten(F.transform(positions[a], lambda x: F.transform(F.filter(other, lambda y: y != x), lambda y: 1 - WEIGHT * F.sqrt(near(x, y)))))  # noqa: B023  called at once
                rest = rest * F.coalesce(F.aggregate(pairs, F.lit(1.0), lambda s, c: s * c), F.lit(1.0))
        return F.when(rest == 1.0, F.lit(1e-20)).otherwise(1 - rest)
    each = (F.coalesce(F.aggregate(F.sequence(F.lit(1), F.size(positions[t])), F.lit(0.0), lambda s, j: s + WEIGHT / (j * j)), F.lit(0.0)) for t in terms)
    # equal but for the order of the terms that were added is equal
    return F.round(functools.reduce(lambda x, y: x + y, each) / F.lit(len(terms) * math.pi**2 / 6), 12)


def matches(posted: DataFrame, query: str | Query, key: list[str], docs: DataFrame | None = None) -> DataFrame:
    """key, score of the documents that match. `docs` (their keys) is read only if documents without terms may match."""
    query = parse(query) if isinstance(query, str) else query
    names = {t: f"_p{i}" for i, t in enumerate(query.terms)}
    near = posted.where(F.col("term").isin(list(names)))
    if "bucket" in posted.columns:
        near = near.where(F.col("bucket").isin([r[0] for r in posted.sparkSession.createDataFrame([(t,) for t in names], "t string").select(_bucket(F.col("t"))).collect()]) if names else F.lit(False))
    rows = near.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.collect_list(F.when(F.col("term") == t, F.col("positions"))).alias(c) for t, c in names.items()])
    whole = lambda c: F.when(F.size(c) == 1, F.get(c, 0)).when(F.size(c) > 1, F.slice(F.array_sort(F.array_distinct(F.flatten(c))), 1, MOST_POSITIONS))  # noqa: E731  of all documents of the key
    rows = rows.withColumns({c: whole(F.col(c)) for c in names.values()})
    if query.open:
        if docs is None:
            raise ValueError("documents without any of the query's terms match it: docs is needed")
        rows = docs.select(*key).distinct().join(rows, key, "left")
    positions = {t: F.col(c) for t, c in names.items()}
    test = functools.reduce(lambda x, y: x | y, (functools.reduce(lambda x, y: x & y, (_holds(w, positions) for w in a)) for a in query.alternatives), F.lit(False))
    return rows.where(test).select(*key, (_rank(query, positions) if names else F.lit(None)).cast("double").alias("score"))


def search(posted: DataFrame, docs: DataFrame, query: str, key: list[str], k: int, order: list[Column] | None = None) -> DataFrame:
    """The k rows of `docs` of the greatest score, ties by `order`, with score and rank."""
    found = docs.join(F.broadcast(matches(posted, query, key, docs).orderBy(F.col("score").desc()).limit(k)), key) if not order else docs.join(matches(posted, query, key, docs), key)
    by = [F.col("score").desc(), *(order or [F.col(c) for c in key])]
    return found.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)))
