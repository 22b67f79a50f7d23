"""Text expressions: tokens, query matching, cover-density ranks, trigram similarity, lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_TOKEN = r"[^\p{L}\p{N}]+"
#: Default weight of a lexeme in cover-density ranking (fixed value).
WEIGHT = 0.1
#: Trigram similarity above which a path matches (fixed value).
SIMILARITY_CUT = 0.15
#: Line boundaries beyond \n that split lines (fixed values).
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def tokens(text: Column) -> Column:
    """Lower-cased letter and digit runs, in order."""
    return F.array_remove(F.split(F.lower(text), NOT_TOKEN, -1), "")


#: Runs of letters and digits that a single one of these joins: hosts, files, paths, addresses, hyphenated words, numbers.
JOINT = "[-./@]"
COMPOUND = rf"[\p{{L}}\p{{N}}]+(?:{JOINT}[\p{{L}}\p{{N}}]+)*+"  # possessive: no stack for each part


def compound_tokens(text: Column) -> Column:
    """Tokens, each compound whole and then by its parts, all at places of their own: `foo-bar` is foo-bar, foo, bar.

    The scheme of an address is a word before it: `http://a.b/c` is http, a.b/c, a, b, c.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(COMPOUND), F.lit(0))

    def both(run: Column) -> Column:
        parts = F.split(run, JOINT, -1)
        return F.when(run.rlike(JOINT), F.concat(F.array(run), parts)).otherwise(F.array(run))  # few are split

    return F.flatten(F.transform(runs, both))


def compounds_of(text: str) -> list[str]:
    """compound_tokens() of a search's words."""
    letters = r"[^\W_]+"
    out = []
    for run in re.findall(rf"{letters}(?:{JOINT}{letters})*", text.lower()):
        parts = re.split(JOINT, run)
        out += [run, *parts] if len(parts) > 1 else parts
    return out


def tokens_for(compounds: bool):
    """The tokenizer of texts, with compounds or without."""
    return compound_tokens if compounds else tokens


def lines(text: Column) -> Column:
    """Lines without their ends; a break at the end opens no line, and empty text has none."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("int")


def like_literal(text: str) -> str:
    """A pattern for LIKE with every wildcard of user text kept live except the escape character itself."""
    return text.replace("\\", "\\\\")


@dataclass
class Branch:
    """One conjunction of a search: single words, phrases (several words) and both, negated."""

    words: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    without: list[list[str]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys([*self.words, *[w for p in self.phrases for w in p]]))


def parse_search(query: str, compounds: bool = False) -> list[Branch]:
    """Web-style search: words are ANDed, "..." is a phrase, `or` separates branches, - negates. Never raises.

    compounds: a compound is the phrase of itself and its parts, as compound_tokens() places them.
    """
    branches, now = [], Branch()
    for sign, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not quoted and bare.lower() == "or" and not sign:
            branches.append(now)
            now = Branch()
            continue
        words = compounds_of(quoted or bare) if compounds else re.findall(r"[^\W_]+", (quoted or bare).lower())
        if not words:
            continue
        if sign:
            now.without.append(words)
        elif len(words) == 1:
            now.words.append(words[0])
        else:
            now.phrases.append(words)
    branches.append(now)
    return [b for b in branches if b.words or b.phrases or b.without]


def matches(token_list: Column, branches: list[Branch]) -> Column:
    """Whether tokens satisfy a parsed search; an empty search matches nothing."""
    joined = F.concat(F.lit(" "), F.array_join(token_list, " "), F.lit(" "))

    def has(words: list[str]) -> Column:
        return F.array_contains(token_list, words[0]) if len(words) == 1 else joined.contains(f" {' '.join(words)} ")

    out = F.lit(False)
    for b in branches:
        test = F.lit(True)
        for w in b.words:
            test = test & has([w])
        for p in b.phrases:
            test = test & has(p)
        for n in b.without:
            test = test & ~has(n)
        out = out | test
    return out


def places(token_list: Column, terms: list[str]) -> Column:
    """(pos, term) of each occurrence of a term."""
    marked = F.transform(token_list, lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    return F.filter(marked, lambda m: m["term"].isin(terms))


def cover_ranks(rows: DataFrame, key: str, branches: list[list[str]], carry: list[str] = ()) -> DataFrame:
    """(key, carry, rank). rows: key, carry (one value a key), pos, term; a key without places has one row with nulls.

    Rank: over the branches, the sum over minimal covers of all terms of WEIGHT / (1 + other words
    inside). For each occurrence the latest place of every term up to it gives the cover that ends there; these covers
    begin later and later, and of those with one beginning the first, the shortest, counts. One shuffle
    by key serves all branches.
    """
    order = Window.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    terms = list(dict.fromkeys(t for b in branches for t in b))
    rows = rows.withColumn("_nth", F.row_number().over(order))
    for i, t in enumerate(terms):
        rows = rows.withColumn(f"_t{i}", F.last(F.when(F.col("term") == t, F.struct("pos", "_nth")), ignorenulls=True).over(upto))
    part = F.lit(0.0)
    for j, branch in enumerate(branches):
        ends = [F.col(f"_t{terms.index(t)}") for t in branch]
        full = ends[0].isNotNull()
        for e in ends[1:]:
            full = full & e.isNotNull()
        rows = rows.withColumn(f"_b{j}", F.when(full, F.least(*ends) if len(ends) > 1 else ends[0]))
        rows = rows.withColumn(f"_p{j}", F.lag(f"_b{j}").over(order))
        begin = F.col(f"_b{j}")
        noise = (F.col("pos") - begin["pos"]) - (F.col("_nth") - begin["_nth"])
        part = part + F.when(begin.isNotNull() & ~begin.eqNullSafe(F.col(f"_p{j}")), F.lit(WEIGHT) / (F.lit(1) + noise)).otherwise(0.0)
    return rows.groupBy(key).agg(*[F.first(c).alias(c) for c in carry], F.sum(part).alias("rank"))


def cover_density(docs: DataFrame, key: str, token_column: str, terms: list[str]) -> DataFrame:
    """(key, rank) of docs in which all terms occur. Only places of query terms leave the scan."""
    hits = docs.select(key, F.explode(places(F.col(token_column), terms)).alias("m")).select(key, "m.pos", "m.term")
    return cover_ranks(hits, key, [terms]).where("rank > 0")


def trigrams(text: Column) -> Column:
    """The set of 3-grams of lower-cased alphanumeric words, each padded by two spaces before and one after."""
    words = tokens(text)
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram sets, as a float."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0).cast("float")
